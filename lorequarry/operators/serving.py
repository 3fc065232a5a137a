"""Data side of serving: tenant-scoped history, fixed-window limits and the filter of a token stream, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lorequarry.operators.scans import range_slices

FALLBACK = "Sorry, no answer could be generated."


def history(messages: DataFrame, limit: int = 20, owner: str | None = None, thread: str | None = None) -> DataFrame:
    """The last messages of a thread (of every thread where none is named), newest first; ``limit`` is clamped to 1 to 100."""
    kept = max(1, min(100, limit))
    rows = messages
    if owner is not None:
        rows = rows.where(F.col("owner") == owner)
    if thread is not None:
        rows = rows.where(F.col("thread_id") == thread)
    order = W.partitionBy("owner", "thread_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)


def _jumps(span: int):
    """Of one key's requests in one slice: its size, and where the windows end up that open at one of its first requests.

    Only requests within ``span`` of the slice's start, or the next one, can be the
    first to open a window in it, whatever window is open before; ``last`` is the
    last opening reached from each of them.
    """

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["micros"].to_numpy(np.int64))
        following = np.searchsorted(t, t + span)
        last = np.arange(len(t))
        for n in range(len(t) - 1, -1, -1):
            if following[n] < len(t):
                last[n] = last[following[n]]
        first = int(np.searchsorted(t, t[0] + span, side="right")) + 1
        return pd.DataFrame(
            {"slice": [rows["slice"].iloc[0]], "key": [rows["key"].iloc[0]], "n": [len(t)], "heads": [t[:first]], "last": [last[:first]], "opened": [t[last[:first]]]}
        )

    return summarise


def _entries(span: int):
    """Of one key's summaries, one a slice: the window that is open where each slice begins, and the rank of its first request."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        opened, at, seen = None, 0, 0
        found = []
        for r in rows.itertuples():
            if opened is not None:
                found.append((r.slice, r.key, opened, seen - at))
            heads = np.asarray(r.heads)
            first = 0 if opened is None else int(np.searchsorted(heads, opened + span))
            if first < len(heads):
                opened, at = int(r.opened[first]), seen + int(r.last[first])
            seen += r.n
        return pd.DataFrame(found, columns=["slice", "key", "opened", "held"])

    return chain


def rate_limit(requests: DataFrame, quota: int = 20, window_seconds: int = 60, slices: int | None = None) -> DataFrame:
    """``(key, at, id, count, allowed)`` of requests ``(key, at, id)``.

    The first request of a key opens a window of fixed length; every request in
    it counts, rejected ones too; the first after its end opens the next.  Rows
    are ordered in slices of about as many rows each.  A key that reaches over
    several slices (two a slice at most) is summarised in each of them, and the
    window open at each border follows from the summaries; a hot key is spread
    like any other rows.
    """
    span = window_seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, opened, count = None, 0, 0
        for batch in batches:
            counts = []
            for s, k, t, before, held in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5, 6))):
                if (s, k) != group:
                    group, opened, count = (s, k), before, held
                if opened is None or t >= opened + span:
                    opened, count = t, 0
                count += 1
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:4], pa.array(counts, pa.int64())], names=["key", "at", "id", "count"])

    rows = requests.where("key is not null and at is not null").select(
        F.col("key").cast("string").alias("key"), "at", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros")
    )
    sliced = range_slices(rows, ["key", "micros", "id"], slices)
    edges = sliced.groupBy("slice").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = edges.select("slice", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))
    over = ends.groupBy("key").agg(F.count(F.lit(1)).alias("in_slices")).where("in_slices > 1")
    reaching = F.broadcast(ends.join(over, "key").select("slice", "key"))  # two rows a slice at most
    summary = "slice int, key string, n long, heads array<long>, last array<long>, opened array<long>"
    parts = sliced.join(reaching, ["slice", "key"]).select("slice", "key", "micros").groupBy("slice", "key").applyInPandas(_jumps(span), summary)
    entries = parts.groupBy("key").applyInPandas(_entries(span), "slice int, key string, opened long, held long")
    placed = sliced.join(F.broadcast(entries), ["slice", "key"], "left").select("slice", "key", "at", "id", "micros", "opened", F.coalesce("held", F.lit(0)).alias("held"))
    sorted_rows = placed.repartition("slice").sortWithinPartitions("slice", "key", "micros", "id")
    kind = rows.schema["at"].dataType.simpleString()
    return sorted_rows.mapInArrow(fold, f"key string, at {kind}, id long, count long").withColumn("allowed", F.col("count") <= quota)


def stream_filter(parts: DataFrame) -> DataFrame:
    """``(thread, seq, content)`` of what a reader sees of ``(thread, seq, type, content)``; ``seq`` is any sortable type.

    With a tool message, only what follows the first one; without, everything.
    Empty contents and tool messages are never shown; a thread that shows nothing
    gets a fixed text with a null ``seq``.
    """
    tools = parts.where("type = 'tool'").groupBy("thread").agg(F.min("seq").alias("first_tool"))
    threads = parts.select("thread").distinct()
    said = parts.where("type <> 'tool' and content is not null and content <> ''")
    shown = said.join(tools, "thread", "left").where("first_tool is null or seq > first_tool").select("thread", "seq", "content")
    silent = threads.join(shown.select("thread").distinct(), "thread", "left_anti")
    none = F.lit(None).cast(parts.schema["seq"].dataType)
    return shown.unionByName(silent.select("thread", none.alias("seq"), F.lit(FALLBACK).alias("content")))
