"""Running aggregates and global numbering without one task per key (two-level prefix scans)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorequarry.shared import materialize


def range_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` with ``slice``: ranges of the order that hold about as many rows each, numbered along it.

    Written once, as the borders are sampled.  Rows equal in ``order`` share a slice.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()), "slices")


def carry_of_slices(sliced: DataFrame, key: str, value: str, total: str = "max") -> DataFrame:
    """``(slice, key, carry)``: the largest (or summed) ``value`` of a key in the slices before, for keys that reach over a border.

    ``sliced`` is in ranges that are ordered by ``key`` first, so a slice shares
    at most its first and its last key with others: two rows a slice at most.
    """
    edges = sliced.groupBy("slice").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    at_edge = sliced.join(F.broadcast(edges), "slice").where((F.col(key) == F.col("_lo")) | (F.col(key) == F.col("_hi")))
    totals = at_edge.groupBy("slice", key).agg((F.max(value) if total == "max" else F.sum(value)).alias("_top"))
    before = W.partitionBy(key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    over = F.max("_top") if total == "max" else F.sum("_top")
    return totals.withColumn("carry", over.over(before)).where("carry is not null").drop("_top")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_of: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the largest ``value`` of the key up to and with each row.

    ``slice_of`` must not fall along ``order``; each (key, slice) is ordered on
    its own and takes the carry of the slices before it.
    """
    sliced = df.withColumn("_slice", slice_of)
    totals = sliced.groupBy(*keys, "_slice").agg(F.max(value).alias("_top"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.max("_top").over(before)).drop("_top")
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = sliced.withColumn("_here", F.max(value).over(inside))
    return here.join(carry, [*keys, "_slice"]).withColumn(out, F.greatest("_here", "_carry")).drop("_slice", "_here", "_carry")


def start_offsets(counts: DataFrame, key: str, count: str, slices: int | None = None) -> DataFrame:
    """``(key, offset)``: how many items come before each key, over all keys in order; ``key`` is distinct and of any sortable type."""
    sliced = range_slices(counts.select(key, count), [key], slices)
    totals = sliced.groupBy("slice").agg(F.sum(count).alias("_n"))
    # one row a slice
    carry = totals.select(
        "slice", F.coalesce(F.sum("_n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry")
    )
    inside = W.partitionBy("slice").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    here = sliced.withColumn("_here", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return here.join(F.broadcast(carry), "slice").select(key, (F.col("_here") + F.col("_carry")).alias("offset"))


def pick_by_rank(values: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Order statistics of each key: ``picks`` maps a name to a rank from 0, a column over ``_n``.

    Equal values are counted first; the distinct values are then ordered in
    slices of about as many values each, with the carry of the slices before.
    Keys are not null.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sliced = range_slices(counted.withColumn("_key", F.struct(*keys)), ["_key", value], slices)
    carry = F.broadcast(carry_of_slices(sliced, "_key", "_c", "sum"))
    inside = W.partitionBy("slice", "_key").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    here = sliced.withColumn("_sum", F.sum("_c").over(inside)).join(carry, ["slice", "_key"], "left")
    sizes = sliced.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = here.withColumn("_last", F.col("_sum") + F.coalesce("carry", F.lit(0))).join(sizes, list(keys))
    hit = lambda rank: (rank >= F.col("_last") - F.col("_c")) & (rank < F.col("_last"))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(hit(rank), F.col(value))).alias(name) for name, rank in picks.items()))
