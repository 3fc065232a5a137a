"""Near-duplicate texts with small edits (problem 7).

Two texts are alike if their sets of distinct three-character substrings, white
space removed and case kept, share at least ``threshold`` of their union.

Method: pivot distance tables.  A text is a bit vector over the hashed gram
space, which is cut into ``BLOCKS`` blocks.  Every subset of blocks set to ones
is a reference fingerprint, 2**BLOCKS of them.  The Hamming distance to any of
them is a signed sum of the distances to the all-zero blocks, so the table
holds BLOCKS numbers per text, and the maximum coordinate difference of two
texts over all 2**BLOCKS references is the sum of the absolute differences of
those numbers.  By the triangle inequality it never exceeds the Hamming distance
of the two vectors, which for alike texts is at most
(1 - t) / (1 + t) * (|A| + |B|): what is discarded cannot be alike.  Survivors
are verified on their exact gram sets.

Pairs are first brought together by bands of min-hash values (an equi-join;
see MISS for the chance to miss a pair at the threshold), never by a product of
all texts.  Unlike texts of similarity s meet in a band of r values with a chance
of s**r, so with fixed bands the pairs that meet grow with the square of the
texts.  Therefore r follows the table: a sample tells how often unlike texts
would meet, and more texts get longer bands, and more of them for the same MISS
(``plan_bands``).  The bands are joined in rounds, each of which sends a few
bands of a text at once.  Equal texts collapse into one class beforehand, so a
group of copies of any size is one row in the bands.  A band row carries, beside
its key, the parities of the table's coordinates: coordinates of unlike parity
differ by one at least, so the bits that differ are a lower bound of the same
maximum, tested inside the join.  Whole tables, and then texts, are joined once
to each distinct pair that is left.

``exact`` brings pairs together by prefixes instead, and then no link is lost:
grams are ordered from rare to common, and a text that shares ``t`` of a union of
grams with another shares one of its first |A| - ceil(t |A|) + 1.  The order
needs no list of grams, only how often each of ``SLOTS`` hash slots is hit.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorequarry.llm.codepoints import code_points, mix, pieces
from lorequarry.shared import materialize

BLOCKS = 256
_WORDS = BLOCKS // 64
_PARITIES = [f"odd{n}" for n in range(_WORDS)]
_SIGNATURE = "id long, size int, pivots binary, " + ", ".join(f"{p} long" for p in _PARITIES)
#: Slots whose hits order the grams (8 MB, broadcast once).
SLOTS = 1 << 20
_SLOT_SHIFT = np.uint64(44)
#: A pair at the threshold misses all bands with about this chance, more alike pairs with less.
MISS = 1e-6
#: Most min-hash values in a band, and bands that one pass over the grams fills.
MOST_ROWS, _A_PASS = 24, 16
#: Texts and min-hash values of the sample, and what a band row costs, in pairs that meet.
SAMPLE, _SKETCH, _ROW_COST = 1024, 64, 8
#: Band rows of a round; a round has 8 bands at least.
_ROUND_ROWS, _ROUND_BANDS = 1 << 23, 8
_EMPTY = np.uint32(0xFFFFFFFF)
_GOLDEN = 0x9E3779B97F4A7C15
_BATCH_CHARS = 1 << 16


def _grams(codes: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of three code points as numbers of ``bits`` bits a code point, and the text of each."""
    wide = codes.astype(np.uint64)
    grams = wide[:-2] << np.uint64(2 * bits) | wide[1:-1] << np.uint64(bits) | wide[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    inside = np.arange(len(grams)) + 3 <= offsets[owner + 1]
    return grams[inside], owner[inside]


def fold_high(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points above 16 bits in the places of the surrogates, which no text holds, and a table that leads back; as they are where there are too many."""
    if not len(codes) or not codes.max() >> 16:
        return codes, None
    high = codes >> 16 > 0
    own, place = np.unique(codes[high], return_inverse=True)
    if len(own) > 0x800 or (codes >> 11 == 0x1B).any():
        return codes, None
    folded, back = codes.copy(), np.arange(1 << 16, dtype=np.uint64)
    folded[high], back[0xD800 : 0xD800 + len(own)] = 0xD800 + place, own
    return folded, back


def packed_grams(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
    """Sorted distinct (text, gram) as one 64-bit number each; None where they do not fit."""
    if len(offsets) > 1 << 16 or len(codes) < 3 or codes.max() >> 16:
        return None
    grams, owner = _grams(codes, offsets, 16)
    keys = np.sort(grams | owner.astype(np.uint64) << np.uint64(48))
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def gram_sets(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-character substrings of each text as exact 63-bit numbers, text by text, and their offsets."""
    n = len(offsets) - 1
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    folded, back = fold_high(codes)
    keys = packed_grams(folded, offsets)
    if keys is not None:
        low = np.uint64(0xFFFF)
        places = [keys >> np.uint64(32) & low, keys >> np.uint64(16) & low, keys & low]
        a, b, c = places if back is None else (back[p] for p in places)
        grams = a << np.uint64(42) | b << np.uint64(21) | c
        owner = (keys >> np.uint64(48)).astype(np.int64)
    else:
        grams, owner = _grams(codes, offsets, 21)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
        grams, owner = grams[new], owner[new]
    return grams, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]


def shared_grams(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the gram sets of two columns of texts, and of their intersections, row by row."""
    left, right = code_points(a), code_points(b)
    folded, _ = fold_high(np.concatenate([left[0], right[0]]))
    x, y = packed_grams(folded[: len(left[0])], left[1]), packed_grams(folded[len(left[0]) :], right[1])
    if x is not None and y is not None:
        owners = [(k >> np.uint64(48)).astype(np.int64) for k in (x, y, np.intersect1d(x, y, assume_unique=True))]
        return tuple(np.bincount(o, minlength=len(a)) for o in owners)
    (ga, oa), (gb, ob) = gram_sets(*left), gram_sets(*right)
    shared = [
        len(np.intersect1d(ga[oa[i] : oa[i + 1]], gb[ob[i] : ob[i + 1]], assume_unique=True)) for i in range(len(a))
    ]
    return np.diff(oa), np.diff(ob), np.array(shared, np.int64)


def pivot_table(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hamming distances of each gram set to the zero reference of each block (texts x BLOCKS)."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    block = (mix(grams) >> np.uint64(56)).astype(np.int64)
    return np.bincount(owner * BLOCKS + block, minlength=n * BLOCKS).reshape(n, BLOCKS)


@cache
def _draws(bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Where an empty bin looks in turn, and the order of all bins for one that found nothing there."""
    own = np.arange(bins, dtype=np.uint64)
    first = [(mix(own * np.uint64(_GOLDEN) + np.uint64(t + 1)) % np.uint64(bins)).astype(np.int64) for t in range(32)]
    return first, mix(own[:, None] * np.uint64(bins) + own + np.uint64(77))


def minima(mixed: np.ndarray, offsets: np.ndarray, turn: int, bins: int) -> np.ndarray:
    """Min-hash values of non-empty sets of mixed grams (texts x bins), the least hash of each of ``bins`` bins of grams.

    All come from one pass over the grams.  An empty bin takes over the value of
    the first filled one in an order of its own, so that two sets agree in each
    value with the chance of their similarity, however small they are.
    """
    n = len(offsets) - 1
    h = mix(mixed + np.uint64((2 * turn + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
    cell = np.repeat(np.arange(n) * bins, np.diff(offsets)) + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    table = np.full(n * bins, _EMPTY, np.uint32)
    np.minimum.at(table, cell, h.astype(np.uint32))
    table = table.reshape(n, bins)
    row, col = np.nonzero(table == _EMPTY)
    filled, (first, order) = table.copy() if len(row) else table, _draws(bins)
    for draw in first:
        if not len(row):
            return table
        table[row, col] = taken = filled[row, draw[col]]
        left = taken == _EMPTY
        row, col = row[left], col[left]
    edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
    for a, b in zip(edges, [*edges[1:], len(row)]):
        some = np.flatnonzero(filled[row[a]] != _EMPTY)
        if len(some):
            table[row[a], col[a:b]] = filled[row[a], some[order[np.ix_(col[a:b], some)].argmin(axis=1)]]
    return table


def band_keys(grams: np.ndarray, offsets: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band keys of each non-empty gram set (texts x bands), from ``rows`` min-hash values each."""
    mixed, n = mix(grams ^ np.uint64(0x5BF03635DA2B4C1F)), len(offsets) - 1
    keys = []
    for turn in range(-(-bands // _A_PASS)):
        values = minima(mixed, offsets, turn, rows * _A_PASS).reshape(n, _A_PASS, rows)
        key = np.broadcast_to(np.arange(turn * _A_PASS, (turn + 1) * _A_PASS, dtype=np.uint64), (n, _A_PASS))
        for r in range(rows):
            key = mix(key * np.uint64(0x100000001B3) ^ values[:, :, r])
        keys.append(key.astype(np.uint32))
    return np.concatenate(keys, axis=1)[:, :bands]


def bands_needed(rows: int, threshold: float) -> int:
    """Bands of ``rows`` values by which a pair at the threshold is missed with a chance of MISS at most."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(threshold**rows, 1 - 1e-9))))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0, _BATCH_CHARS):
        grams, offsets = gram_sets(*code_points(batch.column(0)))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            table = minima(mix(grams), np.r_[offsets[some], offsets[-1]], 0, _SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in table], pa.binary())], names=["sketch"])


def plan_bands(agreeing: np.ndarray, texts: int, threshold: float) -> tuple[int, int]:
    """Values in a band and bands that cost least: ``agreeing`` counts the sampled pairs by the sketch values they share."""
    far = agreeing[: math.ceil(_SKETCH * threshold)]  # alike pairs meet anyway

    def cost(rows: int) -> float:
        chance = sum(int(many) * math.comb(x, rows) for x, many in enumerate(far)) / math.comb(_SKETCH, rows)
        return bands_needed(rows, threshold) * (_ROW_COST + texts * chance / max(int(agreeing.sum()), 1))

    rows = min(range(1, MOST_ROWS + 1), key=cost)
    return rows, bands_needed(rows, threshold)


def _sampled_agreement(texts: DataFrame) -> np.ndarray:
    """How many pairs of the given texts share 0, 1, ... values of their sketches; some SAMPLE texts are expected."""
    sketches = [r.sketch for r in texts.select("bare").mapInArrow(_sketches, "sketch binary").limit(4 * SAMPLE).collect()]
    values = np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, _SKETCH)
    same = np.zeros((len(values), len(values)), np.uint8)
    for n in range(_SKETCH):
        same += values[:, n, None] == values[None, :, n]
    return np.bincount(same[np.triu_indices(len(values), 1)], minlength=_SKETCH + 1)


def _slot_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in pieces(batches, 0, _BATCH_CHARS):
        grams, _ = gram_sets(*code_points(batch.column(0)))
        total += np.bincount((mix(grams) >> _SLOT_SHIFT).astype(np.int64), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "hits"])


def _slot_table(texts: DataFrame) -> np.ndarray:
    """How often the grams of all texts hit each slot; at most SLOTS rows reach the driver."""
    hits = texts.select("bare").mapInArrow(_slot_hits, "slot long, hits long").groupBy("slot").agg(F.sum("hits").alias("hits"))
    table = np.zeros(SLOTS, np.int64)
    for batch in hits.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def prefix_keys(grams: np.ndarray, offsets: np.ndarray, hits: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest grams of each set that one alike must share one of, as hashes, and how many of each set."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = mix(grams)
    order = np.lexsort((h, hits[(h >> _SLOT_SHIFT).astype(np.int64)], owner))
    place = np.arange(len(h)) - np.repeat(offsets[:-1], sizes)
    needed = np.where(sizes > 0, sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, 0)
    return h[order][place < np.repeat(needed, sizes)], needed


def _signatures(threshold: float, plan: tuple[int, int, int] | None = None, hits=None):
    """Of ``(id, text)``: size of the gram set, its pivot table and its keys.

    ``plan``: values in a band, bands, and bands of a round, a column of keys for
    each round.  Where ``hits`` orders the grams, one column of prefix keys instead.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _BATCH_CHARS):
            grams, offsets = gram_sets(*code_points(batch.column(1)))
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            packed, rounds = np.full(len(sizes), b"", object), []
            odd = np.zeros((len(sizes), _WORDS), np.int64)
            inner = np.r_[offsets[some], offsets[-1]]
            if len(some):
                table = pivot_table(grams, inner)
                packed[some] = _pack(table)
                odd[some] = np.packbits((table & 1).astype(np.uint8), axis=1).view(np.int64)
            if hits is None:
                rows, bands, a_round = plan
                keys = band_keys(grams, inner, rows, bands).view(np.int32) if len(some) else np.zeros((0, bands), np.int32)
                for first in range(0, bands, a_round):
                    part = keys[:, first : first + a_round]
                    rounds.append((part.reshape(-1), np.where(sizes > 0, part.shape[1], 0)))
            else:
                keys, numbers = prefix_keys(grams, offsets, hits.value, threshold)
                rounds.append((keys.view(np.int64), numbers))
            columns = {"id": batch.column(0), "size": pa.array(sizes.astype(np.int32)), "pivots": pa.array(packed, pa.binary())}
            columns |= {p: pa.array(odd[:, n]) for n, p in enumerate(_PARITIES)}
            for n, (keys, numbers) in enumerate(rounds):
                columns[f"keys{n}"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(numbers)].astype(np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_pydict(columns)

    return sign


def _pack(table: np.ndarray) -> list[bytes]:
    """A row of the table as bytes: half a byte a coordinate where all fit, else one, else four."""
    top = table.max(axis=1)
    half = (table[:, 0::2] << 4 | table[:, 1::2] & 15).astype(np.uint8)
    return [
        half[i].tobytes() if most < 16 else (row.astype(np.uint8) if most < 256 else row.astype("<u4")).tobytes()
        for i, (row, most) in enumerate(zip(table, top))
    ]


def _unpack(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    width = np.array([len(v) for v in values], np.int64)
    out = np.zeros((len(values), BLOCKS), np.int32 if (width > BLOCKS).any() else np.int16)

    def rows(size: int, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(v for v in values if len(v) == size), kind).reshape(-1, size // np.dtype(kind).itemsize)

    short = rows(BLOCKS // 2, "u1")
    out[width == BLOCKS // 2, 0::2], out[width == BLOCKS // 2, 1::2] = short >> 4, short & 15
    out[width == BLOCKS] = rows(BLOCKS, "u1")
    out[width == 4 * BLOCKS] = rows(4 * BLOCKS, "<u4")
    return out


def within_reach(size_a, size_b, threshold: float):
    """Largest Hamming distance two gram sets of these sizes may have and still be alike."""
    return np.floor((1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-6)


def _discard_far(threshold: float):
    """Keep the pairs whose largest coordinate difference is within reach of the threshold."""

    def discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            far = np.abs(_unpack(batch.column(4)) - _unpack(batch.column(5))).sum(axis=1)
            near = far <= within_reach(size_a, size_b, threshold)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return discard


def _verify(threshold: float):
    top, bottom = round(threshold * 10_000), 10_000

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, _BATCH_CHARS):
            size_a, size_b, shared = shared_grams(batch.column(2), batch.column(3))
            union = size_a + size_b - shared
            good = (union > 0) & (shared * bottom >= union * top)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared / np.maximum(union, 1))], names=["a", "b", "similarity"]
            ).filter(pa.array(good))

    return verify


def text_classes(rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id") -> DataFrame:
    """``(id, digest, bare)``: each row with its text without white space; rows without letters and digits are left out."""
    bare = F.regexp_replace(F.col(text_col), r"(?U)[\s\x1c-\x1f]+", "")
    row_id = F.col(id_col).cast("long")
    # white space holds no letters: the text itself is asked, else its white space would be removed twice
    some = rows.where(row_id.isNotNull() & F.col(text_col).rlike(r"[\p{L}\p{N}]"))
    return some.select(row_id.alias("id"), bare.alias("bare")).select("id", F.unhex(F.md5("bare")).alias("digest"), "bare")


def _free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs removed, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicate_classes(
    rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id", threshold: float = 0.8, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, class_id)`` and links ``(a, b, similarity)`` between classes, a < b.

    A class holds the rows of one text (white space aside), named by its
    smallest id.  Links are all pairs of classes at or above ``threshold``.
    Null, blank and letterless texts belong to no class; texts of fewer than
    three characters have no grams and are linked to nothing but their copies.
    By bands a link at the threshold is lost with a chance of MISS; with ``exact``
    none is, for more work where many texts share rare grams.
    """
    spark = rows.sparkSession
    texts = text_classes(rows, text_col, id_col)
    digests = materialize(texts.select("id", "digest"), "digests")
    classes = digests.groupBy("digest").agg(F.min("id").alias("class_id"))
    members = materialize(digests.join(classes, "digest").select("id", "class_id"), "members")
    # one text a class
    single = texts.select("id", "bare").join(members.where("id <> class_id").select("id"), "id", "left_anti")
    hits, plan, rounds = None, None, 1
    if exact:
        hits = spark.sparkContext.broadcast(_slot_table(texts))
    else:
        n = members.where("id = class_id").count()
        part = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(max(1, n // SAMPLE))) == 0)
        many, bands = plan_bands(_sampled_agreement(text_classes(part, text_col, id_col)), n, threshold)
        a_round = min(bands, max(_ROUND_BANDS, _ROUND_ROWS // max(n, 1)))
        plan, rounds = (many, bands, a_round), -(-bands // a_round)
    schema = ", ".join([_SIGNATURE, *(f"keys{n} array<{'long' if exact else 'int'}>" for n in range(rounds))])
    heads = materialize(single.mapInArrow(_signatures(threshold, plan, hits), schema), "signatures")
    tables = heads.select("id", "size", "pivots")
    side = lambda df, name: df.select(*(F.col(c) if c == "key" else F.col(c).alias(f"{c}_{name}") for c in df.columns))
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in _PARITIES), F.lit(0))
    reach = (1 - threshold) / (1 + threshold) * (F.col("size_a") + F.col("size_b")) + 1e-6
    near_size = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-6
    within = F.expr("id_a < id_b") & near_size & (apart <= reach)
    key = F.col("key") if exact else F.shiftleft(F.col("band").cast("long"), 32) + F.col("key")
    met = []
    for n in range(rounds):
        if rounds > 1:
            _free_shuffles(spark)
        banded = heads.select("id", "size", *_PARITIES, F.posexplode(f"keys{n}").alias("band", "key")).select(
            key.alias("key"), "id", "size", *_PARITIES
        )
        met.append(materialize(side(banded, "a").join(side(banded, "b"), "key").where(within).select("id_a", "id_b").distinct(), "met"))
    met = reduce(DataFrame.unionByName, met).distinct() if rounds > 1 else met[0]
    pairs = (
        met.join(side(tables, "a"), "id_a")
        .join(side(tables, "b"), "id_b")
        .select("id_a", "id_b", "size_a", "size_b", "pivots_a", "pivots_b")
        .mapInArrow(_discard_far(threshold), "id_a long, id_b long")
    )
    if rounds > 1:
        pairs = materialize(pairs, "pairs")
        _free_shuffles(spark)
    heads_texts = texts.select("id", "bare")
    links = (
        pairs.join(side(heads_texts, "a"), "id_a")
        .join(side(heads_texts, "b"), "id_b")
        .select("id_a", "id_b", "bare_a", "bare_b")
        .mapInArrow(_verify(threshold), "a long, b long, similarity double")
    )
    return members, links


def near_duplicate_pairs(
    rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id", threshold: float = 0.8
) -> DataFrame:
    """``(row_a, row_b)``, row_a < row_b: every pair of rows that is alike, copies included."""
    members, links = near_duplicate_classes(rows, text_col, id_col, threshold)
    left = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    across = links.join(left, "a").join(right, "b")
    copies = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y")
    return across.select("x", "y").unionByName(copies.select("x", "y")).select(
        F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")
    )


def near_duplicate_rows(
    rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id", threshold: float = 0.8
) -> DataFrame:
    """``(row_id, class_id, copies, links)``: one row each, with the size of its class and the classes it is linked to."""
    members, links = near_duplicate_classes(rows, text_col, id_col, threshold)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    )
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")).join(degree, "class_id", "left")
    return members.join(sizes, "class_id").select(
        F.col("id").alias("row_id"), "class_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
