"""Data side of model calls: the model is passed in, the rules around it live here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lorequarry.functions.text import unfence
from lorequarry.operators.chunking import longest_chunks
from lorequarry.operators.judged import VERDICTS, effective_refusal, parse_verdict
from lorequarry.shared import materialize

NO_CONTEXT_ANSWER = "The material does not cover this question."
Encoder = Callable[[list[str]], np.ndarray]


def with_retry(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``attempts`` times, the pause doubling; the last failure is raised."""

    def tried(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(wait * 2**attempt)
        return None

    return tried


def hashed_bag(size: int = 64) -> Encoder:
    """An encoder without a model: tokens hashed into ``size`` signed counts, scaled to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                mark = int(md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
                out[row, mark % size] += 1 if mark >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(rows: DataFrame, key: str, text: str, load: Callable[[], Encoder] = hashed_bag) -> DataFrame:
    """``(key, embedding)``; ``load`` builds the encoder once for each task, before its first batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            vectors = encode(frame["text"].fillna("").tolist())
            yield pd.DataFrame({"key": frame["key"], "embedding": [v.astype(np.float32).tolist() for v in vectors]})

    plain = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return plain.mapInPandas(run, "key long, embedding array<float>").withColumnRenamed("key", key)


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def call_model(rows: DataFrame, model: Callable[..., str], out: str, concurrency: int = 3, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``(row_id, out, error)``: ``model`` called with the other columns of ``rows``, in ``concurrency`` tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(model, attempts, wait)
        for frame in frames:
            made = []
            for values in zip(*(frame[c] for c in frame.columns if c != "row_id")):
                try:
                    made.append((call(*values), None))
                except Exception as error:
                    made.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame({"row_id": frame["row_id"], out: [a for a, _ in made], "error": [e for _, e in made]}, dtype=object)

    return rows.repartition(concurrency).mapInPandas(run, f"row_id long, {out} string, error string")


def answer(rows: DataFrame, model: Callable[[str, str], str], concurrency: int = 3, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``(row_id, answer, error)`` of ``(row_id, question, context)``.

    A blank context is refused by rule and never reaches the model; the rest is
    spread over ``concurrency`` tasks.  A call that fails every attempt leaves a
    null answer and its error.
    """
    blank = _blank("context")
    ruled = rows.where(blank).select("row_id", F.lit(NO_CONTEXT_ANSWER).alias("answer"), F.lit(None).cast("string").alias("error"))

    asked = rows.where(~blank).select(F.col("row_id").cast("long"), "question", "context")
    called = call_model(asked, model, "answer", concurrency, attempts, wait)
    return ruled.select(F.col("row_id").cast("long"), "answer", "error").unionByName(called)


def first_sentence(question: str, context: str) -> str:
    """A stand-in for an answering model: the first line of the context after its source line."""
    lines = context.split("\n")
    return lines[1] if len(lines) > 1 else lines[0]


def rule_verdict(rows: DataFrame) -> DataFrame:
    """Verdicts that need no judge: a negative item without context that was refused.

    ``(row_id, context_sufficient, faithful, relevant, refusal_appropriate)`` of ``(row_id, kind, context)``.
    """
    ruled = rows.where((F.col("kind") == "negative") & _blank("context"))
    return ruled.select("row_id", F.lit(False).alias("context_sufficient"), *(F.lit(True).alias(c) for c in ("faithful", "relevant", "refusal_appropriate")))


def valid_evidence(chosen: DataFrame) -> DataFrame:
    """``(row_id, evidence)`` of ``(row_id, picked array<int>, n)``: distinct picks between 0 and n - 1, in order."""
    inside = F.filter("picked", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("n")))
    return chosen.select("row_id", F.array_sort(F.array_distinct(inside)).alias("evidence"))


def judge(rows: DataFrame, model: Callable[[str, str, str], str], concurrency: int = 3, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``(row_id, judge, judge_error)`` of ``(row_id, kind, question, context, answer)``.

    A negative item without context has its verdict by rule; all others are put
    to ``model(question, context, answer)``, whose JSON is read.  What cannot be
    read, or failed every attempt, leaves a null verdict and an error; rows
    without an answer have neither.
    """
    by_rule = rule_verdict(rows)
    struct = F.struct(*VERDICTS, F.array().cast("array<string>").alias("unsupported_claims"), F.lit("").alias("reason"), F.lit("rule").alias("source"))
    ruled = by_rule.select(F.col("row_id").cast("long"), struct.alias("judge"), F.lit(None).cast("string").alias("judge_error"))
    rest = rows.join(by_rule.select("row_id"), "row_id", "left_anti")
    asked = rest.where("answer is not null").select(F.col("row_id").cast("long"), "question", F.coalesce("context", F.lit("")).alias("context"), "answer")
    said = call_model(asked, model, "said", concurrency, attempts, wait).withColumn("v", parse_verdict(F.col("said")))
    read = F.struct(*(F.col(f"v.{c}") for c in (*VERDICTS, "unsupported_claims", "reason")), F.lit("model").alias("source"))
    valid = F.coalesce(F.col("v.valid"), F.lit(False))
    judged = said.select(
        "row_id", F.when(valid, read).alias("judge"), F.when(~valid, F.coalesce("error", F.lit("the verdict cannot be read"))).alias("judge_error")
    )
    silent = rest.where("answer is null").select(
        F.col("row_id").cast("long"), F.lit(None).cast(judged.schema["judge"].dataType).alias("judge"), F.lit(None).cast("string").alias("judge_error")
    )
    return ruled.unionByName(judged).unionByName(silent)


def run_items(
    items: DataFrame, answering: Callable[[str, str], str], judging: Callable[[str, str, str], str], concurrency: int = 3, attempts: int = 3, wait: float = 1.0
) -> DataFrame:
    """Items ``(item_id, kind, question, context)`` answered and judged: with ``answer, generation_error, judge, judge_error, abstained``.

    Append the result to a run log; ``pending`` items of a log go on where it stops.
    """
    rows = materialize(items.withColumn("row_id", F.monotonically_increasing_id()), "items")
    answered = materialize(answer(rows, answering, concurrency, attempts, wait).withColumnRenamed("error", "generation_error"), "answers")
    both = rows.join(answered, "row_id")
    judged = materialize(judge(both, judging, concurrency, attempts, wait), "verdicts")
    refused = effective_refusal(F.col("generation_error"), F.col("answer"), F.col("judge"))
    return both.join(judged, "row_id").withColumn("abstained", refused).drop("row_id")


def generated_questions(chunks: DataFrame, model: Callable[[str], str], per_source: int = 2, concurrency: int = 5, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``(source, question, evidence_chunk_ids)``: questions that a model makes of the longest chunks of each source.

    The model sees the chunks numbered from 0 and answers with JSON, a list of
    ``{"question": ..., "evidence": [numbers]}``, fenced or not.  Questions
    without text, or without a number that is one of a chunk, are left out.
    """
    picked = longest_chunks(chunks, per_source).join(chunks.select("row_id", "chunk_id", "page_content"), "row_id")
    listed = picked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "page_content"))).alias("c"))
    shown = F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]\n"), x["page_content"])), "\n\n")
    rows = materialize(listed.withColumn("row_id", F.monotonically_increasing_id()).withColumn("shown", shown), "picks")
    said = call_model(rows.select("row_id", "shown"), model, "said", concurrency, attempts, wait)
    made = F.from_json(unfence(F.col("said")), "array<struct<question: string, evidence: array<int>>>")
    asked = said.select("row_id", F.posexplode(made).alias("n", "q")).select("row_id", "n", F.trim("q.question").alias("question"), F.col("q.evidence").alias("picked"))
    keyed = asked.join(rows.select("row_id", "source", "c"), "row_id").withColumn("n", F.size("c"))
    inside = F.array_sort(F.array_distinct(F.filter("picked", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("n")))))
    kept = keyed.withColumn("inside", inside).where("question <> '' and size(inside) > 0")
    return kept.select("source", "question", F.transform("inside", lambda i: F.get(F.col("c"), i)["chunk_id"]).alias("evidence_chunk_ids"))
