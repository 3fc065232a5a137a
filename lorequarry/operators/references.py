"""Referential integrity: references to records that are missing, deleted or late.

Method.  Parent keys are mapped to integers, sorted and compressed into runs of
contiguous integers.  A reference is matched as-of to the run that starts at or
before its key; a key beyond that run's end belongs to no parent.  References
that hit a run are then judged in time by a second as-of match: among the
parent's rows indexed up to the reference's time, the latest end of life decides.

Scale.  Parent rows, keys and references are reduced by map-side aggregation
before anything is ordered.  Ordered passes run inside slices: ranges of the order
itself that hold about as many rows each (sampled by ``repartitionByRange``),
whatever the spread of the keys and however often one of them is used.  A run ends
with its slice; of the times of one key that lie in several slices, what an earlier
slice tells a later one is a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorequarry.operators.scans import carry_of_slices, range_slices
from lorequarry.shared import materialize

_HEX_KEY = "^[0-9a-f]{16}$"
_FOREVER = "9999-12-31 00:00:00"


def clean_key(col: Column) -> Column:
    """Trimmed (all Unicode blanks), lower-case key; null for null or blank."""
    bare = F.lower(F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f\p{Cf}]+|[\s\x1c-\x1f\p{Cf}]+$", ""))
    return F.when(bare != "", bare)


def integer_key(col: Column) -> Column:
    """16 hex digits as a signed 64-bit integer that keeps their order; null for other keys."""
    high = F.conv(F.substring(col, 1, 8), 16, 10).cast("long") - F.lit(1 << 31)
    low = F.conv(F.substring(col, 9, 8), 16, 10).cast("long")
    return F.when(col.rlike(_HEX_KEY), F.shiftleft(high, 32) + low)


def _runs_of(sliced: DataFrame) -> DataFrame:
    """Contiguous runs ``(slice, run_start, run_end)`` of distinct integer keys in slices."""
    w = W.partitionBy("slice").orderBy("key")
    island = F.col("key").cast("decimal(20,0)") - F.row_number().over(w)
    runs = sliced.select("slice", "key", island.alias("island")).groupBy("slice", "island")
    return runs.agg(F.min("key").alias("run_start"), F.max("key").alias("run_end")).drop("island")


def contiguous_runs(keys: DataFrame, slices: int | None = None) -> DataFrame:
    """Compress distinct integer keys (column ``key``) into runs ``(slice, run_start, run_end)``.

    Runs end at slice borders, so each slice is ordered on its own.  An empty
    table gives no runs; null keys are ignored; repeats are one key.
    """
    return _runs_of(range_slices(keys.where("key is not null").select("key").distinct(), ["key"], slices))


def match_runs(keys: DataFrame, parents: DataFrame, slices: int | None = None) -> DataFrame:
    """Distinct ``key`` of ``keys`` with ``known``: whether a parent key equals it (as-of run match)."""
    sides = parents.select("key", F.lit(True).alias("parent"), F.lit(False).alias("probe")).unionByName(
        keys.select("key", F.lit(False).alias("parent"), F.lit(True).alias("probe"))
    )
    distinct = sides.where("key is not null").groupBy("key").agg(F.max("parent").alias("parent"), F.max("probe").alias("probe"))
    return _match_sliced(range_slices(distinct, ["key"], slices)).select("key", "known")


def _match_sliced(sliced: DataFrame) -> DataFrame:
    """The probes of ``(slice, key, parent, probe, ...)`` with ``known``: within the run that starts at or before them."""
    runs = _runs_of(sliced.where("parent")).select("slice", F.col("run_start").alias("key"), "run_end", F.lit(0).alias("is_probe"))
    both = runs.unionByName(sliced.where("probe").withColumn("is_probe", F.lit(1)), allowMissingColumns=True)
    preceding = W.partitionBy("slice").orderBy("key", "is_probe").rowsBetween(W.unboundedPreceding, 0)
    return (
        both.withColumn("last_end", F.last("run_end", ignorenulls=True).over(preceding))
        .where("is_probe = 1")
        .withColumn("known", F.coalesce(F.col("last_end") >= F.col("key"), F.lit(False)))
    )


def explode_references(
    items: DataFrame, id_col: str, time_col: str, fields: Sequence[str]
) -> DataFrame:
    """``(item_id, field_name, chunk_id, at)``, distinct; null and blank elements are no references."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("ids")) for f in fields))
    return (
        items.select(F.col(id_col).alias("item_id"), F.col(time_col).alias("at"), F.explode(pairs).alias("p"))
        .select("item_id", "at", F.col("p.field_name").alias("field_name"), F.explode("p.ids").alias("raw"))
        .select("item_id", "field_name", clean_key(F.col("raw")).alias("chunk_id"), "at")
        .where("chunk_id is not null")
        .distinct()
    )


def _known_ids(refs: DataFrame, versions: DataFrame, slices: int | None) -> DataFrame:
    """``(chunk_id, known)`` of every id that is referred to; ids that are no integers are matched by equality."""
    sides = versions.select("chunk_id", F.lit(True).alias("parent"), F.lit(False).alias("probe")).unionByName(
        refs.select("chunk_id", F.lit(False).alias("parent"), F.lit(True).alias("probe"))
    )
    ids = sides.groupBy("chunk_id").agg(F.max("parent").alias("parent"), F.max("probe").alias("probe"))
    keyed = materialize(ids.withColumn("key", integer_key(F.col("chunk_id"))), "ids")
    hexed = _match_sliced(range_slices(keyed.where("key is not null"), ["key"], slices)).select("chunk_id", "known")
    return hexed.unionByName(keyed.where("key is null and probe").select("chunk_id", F.col("parent").alias("known")))


def _lives(refs: DataFrame, versions: DataFrame, slices: int | None) -> DataFrame:
    """References with ``life_end``: the latest end among the versions of their id indexed up to their time; null if there is none."""
    none = F.lit(None).cast("timestamp_ntz")
    events = versions.select("chunk_id", "t", F.lit(0).alias("is_ref"), "ends").unionByName(
        refs.select("*", F.col("judged_at").alias("t"), F.lit(1).alias("is_ref"), none.alias("ends")), allowMissingColumns=True
    )
    sliced = range_slices(events, ["chunk_id", "t", "is_ref", "item_id"], slices)
    inside = W.partitionBy("slice", "chunk_id").orderBy("t", "is_ref").rowsBetween(W.unboundedPreceding, 0)
    carry = carry_of_slices(sliced, "chunk_id", "ends")
    here = sliced.withColumn("top", F.max("ends").over(inside)).where("is_ref = 1")
    return here.join(F.broadcast(carry), ["slice", "chunk_id"], "left").withColumn("life_end", F.greatest("top", "carry"))


def orphan_references(
    items: DataFrame,
    parents: DataFrame,
    fields: Sequence[str] = ("evidence_chunk_ids", "gold_chunk_ids"),
    id_col: str = "item_id",
    time_col: str = "created_at",
    slices: int | None = None,
) -> DataFrame:
    """References of ``items`` that do not hold: ``(item_id, field_name, chunk_id, reason, at)``, distinct.

    ``parents`` has ``chunk_id, indexed_at, deleted_at``; other columns are ignored.
    A reference holds if a parent row is indexed at or before the item's time and
    not deleted by then.  Otherwise it is ``missing`` (no such key), ``late``
    (every row is indexed after the item) or ``deleted``.
    A parent row without ``indexed_at`` counts as indexed never; an item without
    a time is judged at the end of time, where only deletion can fail it.
    Null arrays, null and blank elements are no references; repeats are one row.
    Keys that are not 16 hex digits have no place among the integers and are
    matched by equality.
    """
    far = F.lit(_FOREVER).cast("timestamp_ntz")
    rows = parents.select(
        clean_key(F.col("chunk_id")).alias("chunk_id"),
        F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), far).alias("t"), F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), far).alias("ends"),
    )
    versions = materialize(rows.where("chunk_id is not null").groupBy("chunk_id", "t").agg(F.max("ends").alias("ends")), "versions")
    named = explode_references(items, id_col, time_col, fields).withColumn("at", F.col("at").cast("timestamp_ntz"))
    refs = materialize(named.withColumn("judged_at", F.coalesce("at", far)), "references")
    known = materialize(refs.join(_known_ids(refs, versions, slices), "chunk_id"), "known")
    life = _lives(known.where("known"), versions, slices)
    reason = (
        F.when(F.col("life_end").isNull(), "late")
        .when((F.col("life_end") > F.col("judged_at")) | (F.col("life_end") == far), "holds")
        .otherwise("deleted")
    )
    columns = ["item_id", "field_name", "chunk_id", "reason", "at"]
    judged = life.withColumn("reason", reason).where("reason <> 'holds'").select(*columns)
    return judged.unionByName(known.where("not known").withColumn("reason", F.lit("missing")).select(*columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct orphan references per field, month of the item's time and reason."""
    return (
        orphans.select("item_id", "field_name", "chunk_id", "reason", F.date_format("at", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy("field_name", "month", "reason")
        .agg(F.count(F.lit(1)).alias("references"))
    )
