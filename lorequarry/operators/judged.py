"""Evaluation runs with a judge: parsing verdicts, refusals, rates, latency, sampling and resuming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorequarry.functions.text import normalize_bool, unfence
from lorequarry.operators.metrics import wilson
from lorequarry.operators.scans import pick_by_rank

_BRACE = re.compile("[{}]")
VERDICTS = ("context_sufficient", "faithful", "relevant", "refusal_appropriate")


def balanced_object(text: str | None) -> str | None:
    """From the first opening brace to the one that closes it, braces in strings counting too; None if there is none."""
    begin = text.find("{") if text else -1
    if begin < 0:
        return None
    open_braces = 0
    for brace in _BRACE.finditer(text, begin):
        open_braces += 1 if brace[0] == "{" else -1
        if not open_braces:
            return text[begin : brace.end()]
    return None


def extract_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, json)`` with the first balanced object of each text, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([balanced_object(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "json"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, json string").withColumnRenamed("key", key)


def parse_verdict(answer: Column) -> Column:
    """Struct of the four verdicts, unsupported claims, reason and ``valid``: whether all verdicts can be read."""
    fields = ", ".join(f"{v} string" for v in VERDICTS)
    raw = F.from_json(unfence(answer), f"{fields}, unsupported_claims array<string>, reason string")
    flags = [normalize_bool(raw[v]).alias(v) for v in VERDICTS]
    valid = F.lit(True)
    for flag in (normalize_bool(raw[v]) for v in VERDICTS):
        valid = valid & flag.isNotNull()
    claims = F.coalesce(raw["unsupported_claims"], F.array().cast("array<string>")).alias("unsupported_claims")
    return F.struct(*flags, claims, F.coalesce(raw["reason"], F.lit("")).alias("reason"), valid.alias("valid"))


def effective_refusal(error: Column, answer: Column, judge: Column) -> Column:
    """Failed or blank answers refuse; else only where the context was insufficient and refusing proper."""
    blank = F.coalesce(F.regexp_replace(answer, r"(?U)[\s\x1c-\x1f]+", "") == "", F.lit(True))
    failed = F.coalesce(error != "", F.lit(False)) | blank
    proper = (judge["context_sufficient"] == F.lit(False)) & judge["refusal_appropriate"]
    return F.when(failed, True).when(judge.isNull(), False).otherwise(F.coalesce(proper, F.lit(False)))


def rates(flags: DataFrame) -> DataFrame:
    """``(metric, value, hits, n, low, high)`` of long rows ``(metric, v)``; nulls do not count."""
    sums = flags.groupBy("metric").agg(F.count_if("v").alias("hits"), F.count("v").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return sums.select(
        "metric", F.round(F.try_divide(F.col("hits"), F.col("n")), 9).alias("value"), "hits", "n",
        F.round(low, 9).alias("low"), F.round(high, 9).alias("high"),
    )


def run_flags(runs: DataFrame) -> DataFrame:
    """Long rows ``(metric, v)`` of the flags that make up the summary of judged runs."""
    judge = F.col("judge")
    refused = effective_refusal(F.col("generation_error"), F.col("answer"), judge)
    answerable, negative = F.col("kind") == "answerable", F.col("kind") == "negative"
    answered = answerable & judge.isNotNull() & ~refused
    measures = {
        "answered": F.when(answerable, answered),
        "abstained": F.when(answerable, refused),
        "faithful": F.when(answered, judge["faithful"]),
        "relevant": F.when(answered, judge["relevant"]),
        "unsupported_claims": F.when(answered, F.coalesce(F.size(judge["unsupported_claims"]) > 0, F.lit(False))),
        "refusal_correct": F.when(negative & judge.isNotNull(), judge["refusal_appropriate"]),
        "judge_error": F.col("judge_error").isNotNull(),
        "generation_error": F.col("generation_error").isNotNull(),
    }
    pairs = F.array(*(F.struct(F.lit(name).alias("metric"), flag.alias("v")) for name, flag in measures.items()))
    return runs.select(F.explode(pairs).alias("p")).select("p.metric", "p.v")


def hit_faithful(runs: DataFrame) -> DataFrame:
    """``(hit, faithful, n)`` of answered answerable runs; null counts as false."""
    judge = F.col("judge")
    refused = effective_refusal(F.col("generation_error"), F.col("answer"), judge)
    answered = runs.where((F.col("kind") == "answerable") & judge.isNotNull() & ~refused)
    no = F.lit(False)
    return answered.groupBy(F.coalesce("retrieval_hit", no).alias("hit"), F.coalesce(judge["faithful"], no).alias("faithful")).agg(
        F.count(F.lit(1)).alias("n")
    )


def latencies(values: DataFrame) -> DataFrame:
    """``(measure, n, p50, p95)`` of ``(measure, ms)``: averaging median, lower nearest-rank p95."""
    n = F.col("_n")
    picks = {
        "low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.floor(F.lit(0.95) * (n - 1)), 
    }
    counts = values.where("ms is not null").groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
    picked = pick_by_rank(values, ["measure"], "ms", picks)
    return counts.join(picked, "measure").select("measure", "n", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")


def last_runs(runs: DataFrame, key: str = "item_id", order: tuple[str, ...] = ("run_at", "row_id")) -> DataFrame:
    """The last row of each key; aggregated map-side, so a key that is run very often is no hot task."""
    latest = F.max_by(F.struct("*"), F.struct(*order))
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("_r")).select("_r.*")


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that have no run yet."""
    return items.join(done.select(key), key, "left_anti")


def seeded_order(seed: int, ident: Column) -> Column:
    """Portable pseudo-random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")))


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same in every run and engine."""
    return rows.orderBy(seeded_order(seed, F.col(ident)), ident).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, one of each stratum a round in order of stratum; ``turn`` is the round from 1."""
    turn = F.row_number().over(W.partitionBy(stratum).orderBy(seeded_order(seed, F.col(ident)), ident))
    # no stratum gives more than n rows, which the ranked window cuts off map-side
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def build_context(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """``(row_id, context)``: numbered blocks ``[i] source#id`` and text, by rank, of ``(row_id, ids, sources)``.

    Ids without a text are left out and numbers closed up; no block gives an empty context.
    """
    ranked = lists.select("row_id", F.posexplode(F.arrays_zip("ids", "sources")).alias("rank", "p")).select(
        "row_id", "rank", F.col("p.ids").alias("chunk_id"), F.coalesce("p.sources", F.lit("?")).alias("source")
    )
    joined = ranked.join(texts.select("chunk_id", "text"), "chunk_id")
    blocks = joined.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "chunk_id", "text"))).alias("b"))
    lines = F.transform(
        "b",
        lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["source"], F.lit("#"), x["chunk_id"], F.lit("\n"), x["text"]),
    )
    made = blocks.select("row_id", F.array_join(lines, "\n\n").alias("context"))
    return lists.select("row_id").join(made, "row_id", "left").select("row_id", F.coalesce("context", F.lit("")).alias("context"))


def fallback_questions(items: DataFrame) -> DataFrame:
    """``(item_id, source, question)``: for items without evidence, the questions of items with evidence that share a source.

    Questions of a source are distinct before the join, so an often named source
    costs its questions once for each item in need.
    """
    named = items.select(
        "item_id", F.explode(F.array_distinct("expected_sources")).alias("source"), "question",
        F.coalesce(F.size("evidence_chunk_ids") > 0, F.lit(False)).alias("ok"),
    ).where("source is not null")
    pool = named.where("ok and question is not null").select("source", "question").distinct()
    return named.where("not ok").select("item_id", "source").distinct().join(pool, "source").select("item_id", "source", "question")


def index_drift(index: DataFrame, docs: DataFrame) -> DataFrame:
    """``(n_index, n_docs, only_index, only_docs)`` of two id lists ``(chunk_id)``, one row."""
    a = index.where("chunk_id is not null").select("chunk_id").distinct().withColumn("x", F.lit(1))
    b = docs.where("chunk_id is not null").select("chunk_id").distinct().withColumn("y", F.lit(1))
    return a.join(b, "chunk_id", "full").agg(
        F.count("x").alias("n_index"), F.count("y").alias("n_docs"),
        F.count_if(F.col("y").isNull()).alias("only_index"), F.count_if(F.col("x").isNull()).alias("only_docs"),
    )
