"""Gold labels widened by near-duplicates of the evidence (character trigram Jaccard, exact).

The join goes through the rarest trigrams only: a set that shares t of its union
with another must share one of its first |A| - ceil(t |A|) + 1 trigrams in order
of rarity (prefix filter).  The order need not be the true one, only the same for
all, so it is taken from a sample.  Inside the join, sizes, the places of the
shared trigram (what follows it must be enough) and the parities of 512 parts of
the sets, which differ in no more bits than the sets in trigrams, discard what
cannot be alike; survivors are verified.  Large tables are joined in rounds.
"""

from __future__ import annotations

import gc
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lorequarry.functions.text import without_blanks
from lorequarry.operators import grams
from lorequarry.operators.metrics import distinct_ids
from lorequarry.shared import materialize

#: Texts that the order of the trigrams is taken from.
SAMPLE = 1 << 15
#: Rows of a round of the join.
ROUND_ROWS = 1 << 24
#: Classes of size in a factor of e; a row on the left is repeated for each class its partners may have.
_CLASSES = 16


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, source, text)``: of each id the first row (by row_id) that has content."""
    first = F.min_by(F.struct("source", F.col("page_content").alias("text")), "row_id")
    rows = chunks.where("page_content is not null and chunk_id is not null")
    return rows.groupBy("chunk_id").agg(first.alias("r")).select("chunk_id", "r.source", "r.text")


def _gram_order(texts: DataFrame) -> np.ndarray:
    """Place of each slot in the order from rare to common."""
    share = SAMPLE / max(texts.count(), SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    hits = some.select("id", "bare").mapInArrow(grams.slot_hits, "slot long, hits long").groupBy("slot").agg(F.sum("hits").alias("hits")).toArrow()
    counts = np.zeros(grams.SLOTS, np.int64)
    counts[hits["slot"].to_numpy()] = hits["hits"].to_numpy()
    places = np.empty(grams.SLOTS, np.uint64)
    places[np.argsort(counts, kind="stable")] = np.arange(grams.SLOTS, dtype=np.uint64)
    return places


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) * _CLASSES)


def _candidates(signed: DataFrame, threshold: float, part: int, parts: int) -> DataFrame:
    """``(a, b)`` that meet in a trigram of this round and may be alike."""
    odd = [f"odd{i}" for i in range(grams.PARITIES)]
    rows = signed.select("id", "is_left", "is_right", "size", *odd, F.posexplode("prefix").alias("place", "gram"))
    rows = rows.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)

    def side(flag: str, name: str, kind: Column) -> DataFrame:
        key = F.shiftleft(F.col("gram"), 9).bitwiseOR(F.col("kind"))
        return rows.where(flag).withColumn("kind", kind).select(key.alias("key"), *(F.col(c).alias(f"{c}_{name}") for c in ("id", "size", "place", *odd)))

    # b has enough trigrams if |A| - place >= t / (1 + t) * (|A| + |B|)
    most = F.least(F.col("size") / threshold, (F.col("size") - F.col("place")) * ((1 + threshold) / threshold) - F.col("size")) + 1e-6
    least = F.col("size") * threshold - 1e-6
    fits = F.when(most >= least, F.sequence(_size_class(F.greatest(least, F.lit(1.0))), _size_class(F.greatest(most, least, F.lit(1.0)))))
    a, b = side("is_left", "a", F.explode(fits)), side("is_right", "b", _size_class(F.col("size").cast("double")))
    size_a, size_b = F.col("size_a"), F.col("size_b")
    within = (size_a >= size_b * threshold - 1e-6) & (size_b >= size_a * threshold - 1e-6)
    enough = F.least(size_a - F.col("place_a"), size_b - F.col("place_b")) >= (size_a + size_b) * (threshold / (1 + threshold)) - 1e-6
    unlike = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in odd))
    near = unlike <= (size_a + size_b) * ((1 - threshold) / (1 + threshold)) + 1e-6
    met = a.join(b, "key").where((F.col("id_a") != F.col("id_b")) & within & enough & near)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of texts ``(chunk_id, text, is_left, is_right)``."""
    numbered = texts.select(F.monotonically_increasing_id().alias("id"), "chunk_id", without_blanks(F.col("text")).alias("bare"), "is_left", "is_right")
    texts = materialize(numbered.where(F.length("bare") > 2), "bare")
    kind = "id long, is_left boolean, is_right boolean, size int, prefix array<long>, " + ", ".join(f"odd{i} long" for i in range(grams.PARITIES))
    sign = grams.signer(_gram_order(texts), threshold)
    signed = materialize(texts.select("id", "bare", "is_left", "is_right").mapInArrow(sign, kind), "signed")
    # a prefix of the left is repeated for about half of the classes that lie within the threshold
    times = F.col("is_right").cast("int") + F.col("is_left").cast("int") * (_CLASSES // 4)
    rows = signed.agg(F.sum(F.size("prefix") * times)).first()[0] or 0
    parts, found = -(-rows // ROUND_ROWS) or 1, []
    for part in range(parts):
        found.append(materialize(_candidates(signed, threshold, part, parts), "candidates"))
        if part + 1 < parts:  # frees the shuffle files of the round
            gc.collect()
            signed.sparkSession._jvm.System.gc()
    pairs = reduce(DataFrame.unionByName, found).distinct()
    side = lambda n: texts.select(F.col("id").alias(f"id_{n}"), F.col("chunk_id").alias(n), F.col("bare").alias(f"bare_{n}"))
    both = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).join(side("a"), "id_a").join(side("b"), "id_b")
    sized = both.select("a", "bare_a", "b", "bare_b").where("a <> b").mapInArrow(grams.overlaps, "a string, b string, shared long, whole long")
    return sized.select("a", "b", (F.col("shared") / F.col("whole")).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity)`` of texts ``(chunk_id, text)``, a from ``left``, b from ``right``, a <> b."""
    mark = lambda df, l, r: df.select("chunk_id", "text", F.lit(l).alias("l"), F.lit(r).alias("r"))
    union = mark(left, True, False).unionByName(mark(right, False, True))
    return _pairs(union.groupBy("chunk_id", "text").agg(F.max("l").alias("is_left"), F.max("r").alias("is_right")), threshold)


def evidence_pairs(items: DataFrame, chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity)``: chunks alike to a chunk that some item names as evidence."""
    texts = chunk_texts(chunks)
    named = items.select(F.explode("evidence_chunk_ids").alias("chunk_id"), F.lit(True).alias("named")).distinct()
    marked = texts.join(named, "chunk_id", "left").select("chunk_id", "text", F.coalesce("named", F.lit(False)).alias("is_left"), F.lit(True).alias("is_right"))
    return _pairs(marked, threshold)


def expand_gold(items: DataFrame, chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(item_id, gold_chunk_ids, added_chunks, added_sources, ambiguous)`` of distinct items.

    Gold is the evidence and every chunk alike to a piece of it; an item is
    ambiguous if that adds any.
    """
    evidence = items.select("item_id", F.explode(distinct_ids(F.col("evidence_chunk_ids"))).alias("a"))
    alike = evidence_pairs(items, chunks, threshold).select("a", F.col("b").alias("chunk_id"))
    rows = chunks.where("page_content is not null and chunk_id is not null")
    sources = rows.groupBy("chunk_id").agg(F.min_by("source", "row_id").alias("source"))  # no text is sent for them
    added = evidence.join(alike, "a").select("item_id", "chunk_id").distinct()
    added = added.join(evidence.withColumnRenamed("a", "chunk_id"), ["item_id", "chunk_id"], "left_anti").join(sources, "chunk_id")
    grown = added.groupBy("item_id").agg(F.collect_set("chunk_id").alias("more"), F.collect_set("source").alias("more_sources"))
    base = items.select("item_id", distinct_ids(F.col("evidence_chunk_ids")).alias("own"), distinct_ids(F.col("expected_sources")).alias("expected"))
    none = F.array().cast("array<string>")
    joined = base.join(grown, "item_id", "left")
    more = F.coalesce("more", none)
    return joined.select(
        "item_id",
        F.array_sort(F.concat("own", more)).alias("gold_chunk_ids"),
        F.size(more).alias("added_chunks"),
        F.size(F.array_except(F.coalesce("more_sources", none), "expected")).alias("added_sources"),
        (F.size(more) > 0).alias("ambiguous"),
    )


def label_stats(expanded: DataFrame) -> DataFrame:
    """``(items, ambiguous_items, ambiguous_rate, added_chunk_labels, added_source_labels)``, one row."""
    return expanded.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("ambiguous").alias("ambiguous_items"),
        F.round(F.avg(F.col("ambiguous").cast("double")), 9).alias("ambiguous_rate"),
        F.sum("added_chunks").alias("added_chunk_labels"),
        F.sum("added_sources").alias("added_source_labels"),
    )


def missing_evidence(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id)``: evidence ids that no chunk has."""
    named = items.select(F.explode("evidence_chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()
    return named.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
