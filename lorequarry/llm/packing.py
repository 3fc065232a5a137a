"""Texts put together into containers of a fixed number of tokens (problem 8).

Method: shortest-pack-first over the length histogram.  Only the histogram of
token counts, at most ``capacity`` numbers, reaches the driver.  Lengths are
placed longest first, each into the shortest packs that still have room, and
packs of equal content are one pattern with a count.  The patterns are then
joined back to the texts by rank: the r-th text of a length takes the r-th slot
of that length.

A text longer than a container, and only such a text, is split into full
containers and a rest.  Ranks come from a two-level prefix sum over (length,
salt), so a length that a third of all texts share is ranked in many tasks.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lorequarry.llm.codepoints import pieces as slices
from lorequarry.shared import materialize

#: Texts for each salt: a length that all of them share is ranked in parts of about as many.
RANKED = 200_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Word pattern of the vocabulary (fixed value, published with it).
DEFAULT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(
    documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """``(doc_id, n_tokens)`` of the whole texts; 0 for null and empty ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in slices(batches, 1):
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many containers follow each; all items are placed.

    Ties between patterns of equal room go to the one opened first.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a container of {capacity}")
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                # no pack has room: open as many as fill up with this length alone
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    by_room[capacity - fit * length].append([(length,) * fit, full])
                if rest:
                    by_room[capacity - rest * length].append([(length,) * rest, 1])
                break
            packs = by_room[room]
            pattern, count = packs[0]
            take = min(left, count)
            if take == count:
                packs.pop(0)
            else:
                packs[0][1] -= take
            by_room[room - length].append([(*pattern, length), take])
            left -= take
    return [(pattern, count) for room in sorted(by_room) for pattern, count in by_room[room]]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first slot of each pattern that holds it, its first container, and its slots a container."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    container = 0
    for pattern, count in patterns:
        for length, times in Counter(pattern).items():
            rows[length].append((used[length], container, times))
            used[length] += times * count
        container += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            ranks = batch.column(4).to_numpy(zero_copy_only=False)
            container = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, base, times = slots[int(length)]
                at = np.searchsorted(first, ranks[own], side="right") - 1
                container[own] = base[at] + (ranks[own] - first[at]) // times[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(container)],
                names=["doc_id", "piece_no", "start_token", "n_tokens", "container_id"],
            )

    return place


def pack_documents(
    documents: DataFrame,
    capacity: int = 2048,
    vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str = DEFAULT_PATTERN,
    text_col: str = "text",
    id_col: str = "doc_id",
    salts: int | None = None,
) -> DataFrame:
    """``(doc_id, piece_no, start_token, n_tokens, container_id)``: every document's place.

    A container holds at most ``capacity`` tokens.  Documents that fit are one
    piece; longer ones are cut into full containers and a rest.  Null and empty
    texts have no tokens and no container, but are listed.  Repeated documents
    are placed each; rows that repeat an id are placed each, too.  The result
    depends on ids and lengths only, not on how the table is partitioned.
    ``salts`` parts the texts of one length; one for every ``RANKED`` texts where
    it is not given.
    """
    counts = materialize(token_counts(documents, vocabulary, pattern, text_col, id_col), "token-counts")
    salts = salts or 1 + counts.count() // RANKED
    last = F.greatest(F.floor((F.col("n_tokens") - 1) / capacity), F.lit(0))
    parts = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no")).select(
        "doc_id",
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * capacity).alias("start_token"),
        F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"),
    )
    filled = parts.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    sizes = materialize(filled.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in sizes.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = slot_table(pack_histogram(histogram, capacity))
    before = W.partitionBy("n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = (
        filled.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["n_tokens", "salt"])
        .select("doc_id", "piece_no", "start_token", "n_tokens", (F.col("offset") + F.col("row") - 1).alias("rank"))
    )
    schema = "doc_id long, piece_no int, start_token long, n_tokens long, container_id long"
    empty = parts.where("n_tokens <= 0").withColumn("container_id", F.lit(None).cast("long"))
    return ranked.mapInArrow(_place(slots), schema).unionByName(empty)


def container_fill(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(containers, tokens, unused, fill)`` of a placement, one row; ``fill`` is null without containers."""
    used = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return total.select("containers", "tokens", (room - F.col("tokens")).alias("unused"), F.try_divide(F.col("tokens"), room).alias("fill"))
