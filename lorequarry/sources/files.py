"""Readers and writers for the files around the tables: markdown folders, JSON test sets, run logs, index tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorequarry.operators.chunking import enrich, recursive_chunks, with_section_paths
from lorequarry.operators.judged import effective_refusal
from lorequarry.operators.lexical import LexicalIndex, open_lexical_index, store_lexical_index
from lorequarry.operators.models import Encoder, embed, hashed_bag
from lorequarry.operators.scans import start_offsets
from lorequarry.shared import materialize

ITEM_SCHEMA = (
    "question string, expected_sources array<string>, evidence_chunk_ids array<string>, evidence_coverage_mode string, "
    "generator_version string, gold_chunk_ids array<string>, gold_sources array<string>, label_ambiguous boolean"
)


#: Field of a log line that holds the time of its append.
APPENDED = "_appended"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, source, text)`` of all ``*.md`` files below a folder; ``source`` is the path within it.

    ``doc_id`` numbers the files by path.  The folder listing, not the texts, is
    what is ordered.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    plain = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), rf"^.*?\Q{plain}\E/", "")
    rows = files.select(path.alias("source"), F.col("value").alias("text"))
    paths = rows.select("source").distinct().withColumn("n", F.lit(1))
    order = start_offsets(paths, "source", "n").select("source", F.col("offset").cast("long").alias("doc_id"))
    return rows.join(order, "source").select("doc_id", "source", "text")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of test items, with the defaults of missing fields."""
    rows = spark.read.schema(ITEM_SCHEMA).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, none) for c in ("expected_sources", "evidence_chunk_ids", "gold_chunk_ids")}
    filled["gold_sources"] = F.coalesce("gold_sources", "expected_sources", none)
    return rows.withColumns(filled).withColumn("evidence_coverage_mode", F.coalesce("evidence_coverage_mode", F.lit("any")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(question)`` of a JSON list of strings or of objects, or of an object with such a list under ``questions``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    body = F.when(F.col("t").startswith("{"), F.get_json_object("t", "$.questions")).otherwise(F.col("t"))
    entries = F.from_json(body, "array<string>")  # objects stay JSON text
    one = text.select(F.explode(entries).alias("e"))
    return one.select(F.when(F.col("e").startswith("{"), F.get_json_object("e", "$.question")).otherwise(F.col("e")).alias("question"))


def read_run_log(spark: SparkSession, path: str, schema: str, key: str = "item_id") -> DataFrame:
    """A log of one JSON object a line: broken lines are skipped, the last line of each key wins.

    Lines are in the order of the appends that wrote them; lines of other origin
    in the order of their file's last change, its name and their place in it.
    """
    file = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", F.coalesce(F.get_json_object("value", f"$.{APPENDED}").cast("long"), F.unix_micros(file["file_modification_time"])).alias("at"),
        # the splits of a file are read in any order; within one, the id rises
        file["file_path"].alias("file"), file["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    parsed = lines.withColumn("r", F.from_json("value", schema)).where(f"r is not null and r.{key} is not null")
    return parsed.groupBy(f"r.{key}").agg(F.max_by("r", F.struct("at", "file", "block", "line")).alias("r")).select("r.*")


def resume_runs(spark: SparkSession, path: str, schema: str, key: str = "item_id") -> DataFrame:
    """The last run of each item in a log, with ``abstained`` worked out again from its error, answer and verdict."""
    runs = read_run_log(spark, path, schema, key)
    return runs.withColumn("abstained", effective_refusal(F.col("generation_error"), F.col("answer"), F.col("judge")))


def append_run_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log, marked with the time of the append in microseconds; a task's lines appear only once it is committed."""
    rows.withColumn(APPENDED, F.lit(time.time_ns() // 1000)).write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def build_index(docs: DataFrame, path: str, load: Callable[[], Encoder] = hashed_bag) -> None:
    """Split, enrich, embed and store documents ``(doc_id, source, text)`` as an index: chunks with vectors, and postings.

    Chunks are searched by ``chunk_index``, their number over all documents;
    ``chunk_id`` is their stable name.  ``load`` makes the encoder.
    """
    chunks = with_section_paths(recursive_chunks(docs), docs).join(docs.select("doc_id", "source"), "doc_id")
    ids = enrich(chunks)
    rows = materialize(chunks.select("doc_id", "piece", "source", "start", "text").join(ids, ["doc_id", "piece"]), "chunks")
    vectors = embed(rows, "chunk_index", "text", load)
    store_index(rows.join(vectors, "chunk_index"), path, "chunk_index")


def store_index(chunks: DataFrame, path: str, ident: str = "chunk_id") -> None:
    """Store chunks ``(ident, text, embedding, ...)`` and the postings of their texts; ``ident`` is an integer."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    store_lexical_index(stored.select(F.col(ident).cast("long").alias("chunk_id"), "text"), f"{path}/lexical")


def open_index(spark: SparkSession, path: str, ident: str = "chunk_id") -> tuple[DataFrame, LexicalIndex]:
    """What ``hybrid_search`` takes of a stored index: its chunks, by ``ident`` as ``chunk_id``, and its postings."""
    chunks = spark.read.parquet(f"{path}/chunks")
    if ident != "chunk_id":
        chunks = chunks.withColumnRenamed("chunk_id", "name").withColumnRenamed(ident, "chunk_id")
    return chunks, open_lexical_index(spark, f"{path}/lexical")


def index_check(chunks: DataFrame) -> DataFrame:
    """``(chunks, without_id, without_vector, repeated_ids)`` of an index's chunks, one row."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("chunk_id", F.lit("")) == "").alias("without_id"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated_ids"),
    )


def load_or_build_index(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The stored index, built first where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lexical/totals/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build_index(docs, path)
    return spark.read.parquet(f"{path}/chunks")


CONVERSATION_SCHEMA = "id bigint, owner string, thread_id string, role string, content string, created_at timestamp"


def ensure_conversations(spark: SparkSession, name: str) -> None:
    """Create the conversation table where it is missing and add columns it lacks; running it again changes nothing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CONVERSATION_SCHEMA}) USING parquet PARTITIONED BY (owner)")
    have = {c.name for c in spark.catalog.listColumns(name)}
    for column in CONVERSATION_SCHEMA.split(", "):
        if column.split(" ")[0] not in have:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({column})")


def append_conversations(rows: DataFrame, name: str) -> None:
    """Append messages to the conversation table, by column name."""
    names = rows.sparkSession.table(name).columns
    rows.select(*names).write.mode("append").insertInto(name)
