"""Retrieval metrics of ranked id lists, intervals, bootstrap and random baselines; all as column expressions or joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorequarry.operators.draws import digit_blocks, md5_heads
from lorequarry.operators.scans import pick_by_rank, start_offsets
from lorequarry.shared import materialize


def distinct_ids(ids: Column) -> Column:
    """Distinct non-null elements; empty for null."""
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def _list(ids: Column) -> Column:
    return F.coalesce(ids, F.array().cast("array<string>"))


def recall_any(found: Column, gold: Column) -> Column:
    return (F.size(F.array_intersect(_list(found), distinct_ids(gold))) > 0).cast("double")


def recall_all(found: Column, gold: Column) -> Column:
    wanted = distinct_ids(gold)
    return ((F.size(wanted) > 0) & (F.size(F.array_except(wanted, _list(found))) == 0)).cast("double")


def coverage(found: Column, evidence: Column) -> Column:
    wanted = distinct_ids(evidence)
    share = F.size(F.array_intersect(wanted, _list(found))) / F.size(wanted)
    return F.when(F.size(wanted) > 0, share).otherwise(0.0)


def precision_at(found: Column, gold: Column, k: int) -> Column:
    """Hits among the first k over k itself, however many were returned."""
    if k <= 0:
        return F.lit(0.0)
    wanted = distinct_ids(gold)
    return F.size(F.filter(F.slice(_list(found), 1, k), lambda x: F.array_contains(wanted, x))) / F.lit(float(k))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    wanted = distinct_ids(gold)
    place = F.array_position(F.transform(_list(found), lambda x: F.coalesce(F.array_contains(wanted, x), F.lit(False))), True)
    return F.when(place > 0, 1.0 / place).otherwise(0.0)


def ndcg_at(found: Column, gold: Column, k: int) -> Column:
    wanted = distinct_ids(gold)
    gains = F.transform(
        F.slice(_list(found), 1, max(k, 1)),
        lambda x, i: F.when(F.array_contains(wanted, x), 1 / F.log2(i.cast("double") + 2)).otherwise(0.0),
    )
    ideal, total = [], 0.0
    for rank in range(1, max(k, 1) + 1):
        total += 1 / math.log2(rank + 1)
        ideal.append(F.lit(total))
    best = F.element_at(F.array(*ideal), F.least(F.size(wanted), F.lit(max(k, 1))))
    gained = F.aggregate(gains, F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(wanted) > 0) & F.lit(k > 0), F.try_divide(gained, best)).otherwise(0.0)


def retrieval_metrics(rows: DataFrame, k: int = 3) -> DataFrame:
    """Metrics of rows ``(row_id, strategy, ids, sources, gold, gold_sources, expected_sources, evidence)``.

    Chunk metrics are null where gold is empty, those on evidence also where evidence is.
    """
    has_gold = F.size(distinct_ids(F.col("gold"))) > 0
    has_evidence = has_gold & (F.size(distinct_ids(F.col("evidence"))) > 0)
    ids, sources = F.col("ids"), F.col("sources")
    return rows.select(
        "row_id",
        "strategy",
        recall_any(sources, F.col("expected_sources")).alias("source_strict"),
        recall_any(sources, F.col("gold_sources")).alias("source_relaxed"),
        F.size(distinct_ids(sources)).cast("double").alias("diversity"),
        F.when(has_gold, recall_any(ids, F.col("gold"))).alias("chunk_any"),
        F.when(has_evidence, recall_all(ids, F.col("evidence"))).alias("chunk_all"),
        F.when(has_evidence, coverage(ids, F.col("evidence"))).alias("evidence_coverage"),
        F.when(has_gold, precision_at(ids, F.col("gold"), k)).alias("chunk_precision"),
        F.when(has_gold, reciprocal_rank(ids, F.col("gold"))).alias("mrr"),
        F.when(has_gold, ndcg_at(ids, F.col("gold"), k)).alias("ndcg"),
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, within 0 and 1; (0, 0) for no trials."""
    share, square = hits / n, z * z
    middle = (share + square / (2 * n)) / (1 + square / n)
    half = z * F.sqrt(share * (1 - share) / n + square / (4 * n * n)) / (1 + square / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0)
    return low, F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


BINARY = ("source_strict", "source_relaxed", "chunk_any", "chunk_all")


def strategy_summary(metrics: DataFrame, names: tuple[str, ...] = BINARY) -> DataFrame:
    """``(strategy, metric, value, hits, n, low, high)``: means of binary metrics with their intervals; nulls leave the mean."""
    long = metrics.unpivot(["strategy"], list(names), "metric", "v")
    sums = long.groupBy("strategy", "metric").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).cast("long").alias("hits"), F.count("v").alias("n")
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return sums.select(
        "strategy", "metric", F.try_divide(F.col("hits"), F.col("n")).alias("value"), "hits", "n",
        F.round(low, 9).alias("low"), F.round(high, 9).alias("high"),
    )


CONTINUOUS = ("chunk_precision", "evidence_coverage", "mrr", "ndcg", "diversity")


def strategy_means(metrics: DataFrame, names: tuple[str, ...] = CONTINUOUS) -> DataFrame:
    """``(strategy, metric, value, n)``: means of metrics that are no shares of hits; nulls leave the mean."""
    long = metrics.unpivot(["strategy"], list(names), "metric", "v")
    return long.groupBy("strategy", "metric").agg(F.avg("v").alias("value"), F.count("v").alias("n"))


#: Values that are broadcast to their draws (16 MB); more are joined.
HELD = 1_000_000
Statistic = Callable[[Column, Column], Column]


def weighted_mean(v: Column, times: Column) -> Column:
    return F.sum(times * v) / F.sum(times)


def _drawn_sums(held, seed: int):
    """``(rep, mean)`` of repetitions ``(rep)``; ``held`` are the values by place."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            reps = batch.column(0).to_pylist()
            sums = np.zeros(len(reps))
            for digits, _ in digit_blocks(len(v)):
                for i, rep in enumerate(reps):
                    at = md5_heads(f"{seed}:{rep}:".encode(), digits)
                    at -= at // np.uint32(len(v)) * np.uint32(len(v))
                    sums[i] += v[at].sum()
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int32()), pa.array(sums / len(v))], names=["rep", "mean"])

    return draw


def _resampled_means(values: DataFrame, reps: int, seed: int, statistic: Statistic = weighted_mean) -> DataFrame:
    """``(rep, mean)``: each repetition draws as many values as there are, by a portable hash of (seed, rep, draw)."""
    values = materialize(values, "resampled")
    spark, many = values.sparkSession, values.count()
    if statistic is weighted_mean and 0 < many <= HELD and values.where("v is null").isEmpty():
        held = values.orderBy("key").select(F.col("v").cast("double")).toArrow()["v"].to_numpy()
        tasks = min(reps, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        numbers = spark.range(0, reps, 1, tasks).select(F.col("id").cast("int").alias("rep"))
        return numbers.mapInArrow(_drawn_sums(spark.sparkContext.broadcast(held), seed), "rep int, mean double")
    counts = values.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    placed = values.join(start_offsets(counts, "key", "c"), "key").select(F.col("offset").alias("place"), "v")
    size = placed.agg(F.count(F.lit(1)).alias("n"))  # one row
    draws = placed.select(F.col("place").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string")))
    at = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % F.col("n")
    picked = draws.crossJoin(F.broadcast(size)).select("rep", at.alias("place"))
    if many <= HELD:
        # the values go to the draws, of which only sums are shuffled
        drawn = picked.withColumn("times", F.lit(1)).join(F.broadcast(placed), "place")
    else:
        drawn = picked.groupBy("rep", "place").agg(F.count(F.lit(1)).alias("times")).join(placed, "place")
    return drawn.groupBy("rep").agg(statistic(F.col("v"), F.col("times")).alias("mean"))


def _bounds(means: DataFrame, reps: int, confidence: float) -> DataFrame:
    alpha = (1 - confidence) / 2
    low, high = int(alpha * reps), min(reps - 1, int((1 - alpha) * reps))
    rounded = means.select(F.lit(1).alias("one"), F.round("mean", 12).alias("mean"))
    return pick_by_rank(rounded, ["one"], "mean", {"low": F.lit(low), "high": F.lit(high)}).drop("one")


def bootstrap_interval(
    values: DataFrame, reps: int = 2000, seed: int = 42, confidence: float = 0.95, statistic: Statistic = weighted_mean
) -> DataFrame:
    """``(low, high)`` of a statistic of ``v`` in ``values (key, v)``, ``key`` being unique; one row.

    ``statistic`` is an aggregate of a value and how often it was drawn; the mean where none is given.

    Work is reps x rows; up to HELD values a mean is drawn where its repetition is, for other statistics only sums
    are shuffled, beyond that the draws.
    """
    return _bounds(_resampled_means(values, reps, seed, statistic), reps, confidence)


def paired_bootstrap(pairs: DataFrame, reps: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """``(mean_diff, low, high, p_value)`` of ``a - b`` in ``pairs (key, a, b)``; one row, none without pairs.

    A null on either side is an unequal pair and raises.
    """
    unequal = F.col("a").isNull() | F.col("b").isNull()
    diff = F.when(unequal, F.raise_error(F.lit("unequal pairs"))).otherwise(F.col("a") - F.col("b"))
    checked = materialize(pairs.select("key", diff.alias("v")), "paired")
    means = materialize(_resampled_means(checked, reps, seed), "means")
    tail = means.agg(
        (F.count_if(F.round("mean", 12) <= 0) / reps).alias("below"), (F.count_if(F.round("mean", 12) >= 0) / reps).alias("above")
    )
    point = checked.agg(F.avg("v").alias("mean_diff"))
    return _bounds(means, reps, confidence).crossJoin(tail).crossJoin(point).select(
        F.round("mean_diff", 9).alias("mean_diff"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"),
        F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p_value"),
    )


def chance_of_hit(total: Column, marked: Column, k: int) -> Column:
    """Chance that k draws without replacement hold one of the marked; the share of misses as a product."""
    misses = F.lit(1.0)
    for i in range(k):
        misses = misses * (total - marked - i) / (total - i)
    return F.when(total - marked < k, F.when(marked > 0, 1.0).otherwise(0.0)).otherwise(1 - misses)


def random_baseline(items: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """``(baseline, n)``: mean chance that k random chunks hold one of an item's gold sources."""
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("total"))  # one row
    named = items.select("item_id", F.explode_outer("gold_sources").alias("source")).join(counts, "source", "left")
    marked = named.groupBy("item_id").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("marked")).crossJoin(F.broadcast(total))
    chance = chance_of_hit(F.col("total"), F.col("marked"), k)
    return marked.agg(F.round(F.avg(chance), 9).alias("baseline"), F.count(F.lit(1)).alias("n"))


def random_baseline_chunk(items: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """``(baseline, n)``: the same for gold chunks; items without gold stay in the denominator."""
    total = chunks.agg(F.count(F.lit(1)).alias("total"))  # one row
    marked = items.select(F.size(distinct_ids(F.col("gold_chunk_ids"))).alias("marked")).crossJoin(F.broadcast(total))
    chance = F.when(F.col("marked") > 0, F.when(F.col("total") - F.col("marked") < k, 1.0).otherwise(chance_of_hit(F.col("total"), F.col("marked"), k))).otherwise(0.0)
    return marked.agg(F.round(F.avg(chance), 9).alias("baseline"), F.count(F.lit(1)).alias("n"))
