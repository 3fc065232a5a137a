"""Records that differ only in their dress: white space, case, punctuation, field order (problem 6).

Method: Merkle-style bottom-up hashing.  Leaves are reduced to lower-case
letters and digits; an object is an unordered node (its child digests are
sorted), a list an ordered one; plain text is a single leaf.  Records are grouped
by root digest, and every copy is confirmed by comparing its full canonical
structure with that of a row of the same digest.

Scale: a row travels as two 16-byte digests, made once and written.  Groups are
counted with map-side aggregation and never gathered: a group's only state is its
smallest id and its count.  Rows look their group up in two parts: the groups that
hold more than one row in ``HEAVY`` are at most ``HEAVY`` and are broadcast, all
other groups are too small to weigh on a task.  The text that copies are compared
with is repeated for every ``SPREAD`` copies.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorequarry.shared import materialize

#: A group is broadcast if it holds more than a share of 1 / HEAVY of all rows.
HEAVY = 1024
#: Copies of one content that are compared in one place.
SPREAD = 20_000

_SEPARATOR = re.compile(r"[:=：＝]")
_KEY = re.compile(r"[^\W\d](?:[\w./-]| (?! ))*+")
_SEMICOLON = re.compile(r"[;；]")
_BLANKS = "\ufeff\u3000\u00a0 \t\r\n"
_NO_LETTER = re.compile(r"[\W_]+")

Node = str | tuple


def bare(text: str) -> str:
    """Letters (L*) and digits (N*) in lower case."""
    rough = _NO_LETTER.sub("", text.lower())
    # \w also holds marks and connectors that are neither letters nor digits
    return rough if rough.isalnum() else "".join(c for c in rough if c.isalnum())


def _json_record(text: str):
    if not (text.startswith("{") and text.endswith("}")):
        return None
    try:
        return json.loads(text, object_pairs_hook=lambda p: ("{}", p), parse_float=str, parse_int=str, parse_constant=str, strict=False)
    except (ValueError, RecursionError):
        return None


def _field(part: str) -> tuple[str, str] | None:
    """Key and value of ``key: value`` or ``key=value``; the key may be quoted or stand behind a list mark."""
    sign = _SEPARATOR.search(part)
    if not sign or part.startswith("//", sign.end()):
        return None
    key = part[: sign.start()].lstrip().lstrip("\"'`*-").strip().rstrip("\"'`*").rstrip()
    value = part[sign.end() :].strip()
    return (key, value.removesuffix(",").rstrip()) if _KEY.fullmatch(key) else None


def _fields(text: str) -> list[tuple[str, str]] | None:
    """Fields written ``key: value`` or ``key=value``, one a line or between semicolons."""
    lines = [x for x in text.splitlines() if x.strip()]
    for parts in (lines, [x for x in _SEMICOLON.split(text) if x.strip()]):
        if len(parts) > 1:
            found = []
            for part in parts:
                if (field := _field(part)) is None:
                    break
                found.append(field)
            else:
                return found
    return None


def is_record(text: str) -> bool:
    """Whether a text is a JSON object or consists of ``key: value`` fields."""
    stripped = text.strip(_BLANKS)
    return _json_record(stripped) is not None or _fields(stripped) is not None


def canonical(value) -> Node:
    """Structure with bare leaves; objects list their fields in sorted order, without empty keys and values."""
    if isinstance(value, tuple):
        fields = sorted(((bare(k), canonical(v)) for k, v in value[1]), key=repr)
        return ("{}", *fields)
    if isinstance(value, list):
        return ("[]", *(canonical(v) for v in value))
    return bare("" if value is None else str(value).lower() if isinstance(value, bool) else value)


def structure(text: str) -> tuple[Node, str]:
    """Canonical structure of a text, and all its letters and digits in order."""
    flat = bare(text)
    stripped = text.strip(_BLANKS)
    record = _json_record(stripped)
    if record is None and (fields := _fields(stripped)):
        record = ("{}", fields)
    if record is None or len(record[1]) < 2:
        return flat, flat
    try:
        node = canonical(record)
        digest(node)
    except RecursionError:  # nested beyond reason: compared as plain text
        return flat, flat
    return node, flat


def digest(node: Node) -> bytes:
    """Digest of a node from the digests of its children."""
    if isinstance(node, str):
        return hashlib.blake2b(node.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    kind, *children = node
    if kind == "{}":
        below = sorted(digest(k) + digest(v) for k, v in children)
    else:
        below = [digest(c) for c in children]
    return hashlib.blake2b(kind.encode() + b"".join(below), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, roots, flats = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            node, flat = structure(text)
            if flat:
                kept.append(row)
                flats.append(hashlib.blake2b(flat.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                roots.append(digest(node) if not isinstance(node, str) else flats[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(roots, pa.binary()), pa.array(flats, pa.binary())],
            names=["id", "root", "flat"],
        )


def same_content(a: str, b: str) -> bool:
    """Full comparison; a record and a plain text agree if their letters and digits do."""
    x, flat_x = structure(a)
    y, flat_y = structure(b)
    return x == y or (flat_x == flat_y and (isinstance(x, str) or isinstance(y, str)))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield batch.select([0, 1]).filter(pa.array([same_content(x, y) for x, y in zip(a, b)], pa.bool_()))


def digest_rows(rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id") -> DataFrame:
    """``(id, root, flat)`` of every row with letters or digits, written once."""
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = texts.where("text is not null and id is not null").mapInArrow(_digests, "id long, root binary, flat binary")
    return materialize(made, "digests")


def content_groups(digests: DataFrame) -> DataFrame:
    """``(root, flat, keep_id, n, copies, witness_id)``: each digest pair with its rows, and the smallest id and the size of its group.

    Plain texts whose letters and digits equal those of a record join the
    record's group.  ``witness_id`` is a row that shares the pair's content by
    itself, not through another member.
    """
    classes = materialize(
        digests.groupBy("root", "flat").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")), "contents"
    )
    records = classes.where("root <> flat").groupBy("flat").agg(F.min("root").alias("record"), F.min_by("keep", "root").alias("near"))
    roots = classes.groupBy("root").agg(F.min("keep").alias("own"))
    plain = F.col("root") == F.col("flat")
    labelled = (
        classes.join(roots, "root")
        .join(records, "flat", "left")
        .withColumn("label", F.when(plain, F.coalesce("record", "root")).otherwise(F.col("root")))
        .withColumn("witness_id", F.when(plain, F.coalesce("near", "own")).otherwise(F.col("own")))
    )
    groups = labelled.groupBy("label").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("copies"))
    return labelled.join(groups, "label").select("root", "flat", "keep_id", "n", "copies", "witness_id")


def _with_group(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group: those of the heaviest digest pairs by broadcast, the others by an even join."""
    total = digests.agg(F.count(F.lit(1)).alias("total"))  # one row
    weighed = groups.crossJoin(F.broadcast(total)).withColumn("heavy", F.col("n") * HEAVY > F.col("total")).drop("total")
    heavy = F.broadcast(weighed.where("heavy"))  # fewer than HEAVY rows, as their shares sum up to 1 at most
    keys = ["root", "flat"]
    light = digests.join(heavy.select(*keys), keys, "left_anti").join(weighed.where("not heavy"), keys)
    return digests.join(heavy, keys).unionByName(light)


def _confirmed_copies(digests: DataFrame, rows: DataFrame, text_col: str, id_col: str) -> DataFrame:
    groups = materialize(content_groups(digests).where("copies > 1"), "groups")
    places = F.floor(F.col("copies") / SPREAD).cast("int") + 1
    pairs = (
        _with_group(digests, groups)
        .where("id <> keep_id")
        .select("keep_id", F.col("id").alias("copy_id"), "witness_id", F.pmod(F.xxhash64("id"), places).cast("int").alias("place"))
    )
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with_copy = pairs.join(texts.select(F.col("id").alias("copy_id"), F.col("text").alias("copy_text")), "copy_id")
    asked = groups.groupBy("witness_id").agg(F.max(places).alias("places"))
    witnesses = texts.select(F.col("id").alias("witness_id"), F.col("text").alias("witness_text")).join(asked, "witness_id")
    spread = witnesses.select("witness_id", "witness_text", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    return (
        with_copy.join(spread, ["witness_id", "place"])
        .select("keep_id", "copy_id", "witness_text", "copy_text")
        .mapInArrow(_confirm, "keep_id long, copy_id long")
    )


def dressed_copies(rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id") -> DataFrame:
    """``(keep_id, copy_id)``: the smallest id of each content with every other row of that content.

    Null texts and texts without letters and digits are left out.
    """
    return _confirmed_copies(digest_rows(rows, text_col, id_col), rows, text_col, id_col)


def distinct_contents(rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id") -> DataFrame:
    """``(keep_id, copies, content)``: one row for each distinct content, with its number of rows.

    Only confirmed copies are counted; a row that shares a digest but not the
    structure would be a content of its own.  Ties of the smallest id (repeated
    ids) keep one of the equal contents.  Null texts and texts without letters
    and digits are left out.
    """
    digests = digest_rows(rows, text_col, id_col)
    copies = _confirmed_copies(digests, rows, text_col, id_col).distinct().withColumnRenamed("copy_id", "id")
    counted = (
        digests.select("id")
        .join(copies, "id", "left")
        .groupBy(F.coalesce("keep_id", "id").alias("keep_id"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    texts = rows.select(F.col(id_col).cast("long").alias("keep_id"), F.col(text_col).alias("content"))
    return counted.join(texts.where("content is not null"), "keep_id").groupBy("keep_id", "copies").agg(
        F.min("content").alias("content")
    )
