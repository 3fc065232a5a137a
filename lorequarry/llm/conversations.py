"""Conversations rebuilt from message rows (problem 3).

Method: keyed streaming state with event-time watermarks, in two streams.

The first buffers messages.  Each distinct one, late and redelivered ones
included, waits in state under its own key (owner, thread, time segment, time,
digests) until the watermark closes the segment.  What a batch closes is cut into
slices of its order (owner, thread, time, id); a slice of a thread is reduced to
one part: its number of turns, first and last speaker, and what is wrong inside.

The second keeps the conversations.  Its state is keyed by thread, a session that
holds the parts seen so far; it is closed when the watermark has passed its last
message by ``idle``, or by the end of the stream, and only then validated and
emitted.  A thread that speaks again after it was closed opens a new session; the
verdict of the thread is that of its sessions in order.

State holds ids, times, roles and digests, never contents.  Messages behind the
watermark are dropped and counted (``late_messages``).  A stream is ended by an
explicit record of its own column, not by a message.

Scale.  A thread is never gathered, nor is a stretch of its time: a row of the
first state is one message, a slice is bounded in rows whatever thread or day they
are of, and a thread has at most as many parts as there are slices.  A thread that
holds a third of all rows, on one day or many, is spread like any other rows.
State, slices and verdicts live in the cluster's shared folder and are replayed
exactly once after a lost executor; a later run on the same place goes on where
the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lorequarry.shared import scratch_path

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
#: How speakers are written; u takes a user's turn, a an assistant's, s none, x is unknown.
_SPEAKERS = {"user": "u", "human": "u", "assistant": "a", "ai": "a", "system": "s", "tool": "s"}
_EDGES = r"(?U)^[\s\x00-\x1f\p{Cf}]+|[\s\x00-\x1f\p{Cf}]+$"
_VISIBLE = r"[^\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{2800}\p{M}]"
#: The time of the record that ends a stream, in microseconds; a message from a day before it on counts as one without a time.
_END = 9_200_000_000_000_000_000
_DAY = 86_400_000_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def speaker(role: Column) -> Column:
    """One letter for a role, read without case and outer blanks."""
    plain = F.lower(F.regexp_replace(role, _EDGES, ""))
    known = F.create_map(*(F.lit(x) for pair in _SPEAKERS.items() for x in pair))
    return F.coalesce(known[plain], F.lit("x"))


def _slim(messages: DataFrame) -> DataFrame:
    ended = F.col("ended") if "ended" in messages.columns else F.lit(False)
    return messages.select(
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.col("owner").isNull().alias("no_owner"),
        F.coalesce("thread_id", F.lit("")).alias("thread_id"),
        F.col("thread_id").isNull().alias("no_thread"),
        F.when(ended | (F.unix_micros("created_at") < _END - _DAY), F.col("created_at")).alias("at"),
        F.col("id").cast("long").alias("id"),
        speaker(F.col("role")).alias("who"),
        F.coalesce(F.col("content").rlike(_VISIBLE), F.lit(False)).alias("visible"),
        # two digests of role and content tell redelivered rows from others
        F.xxhash64("role", "content").alias("digest"),
        F.coalesce(F.hash("content", "role"), F.lit(0)).alias("digest2"),
    )


_KEYS = ["owner", "no_owner", "thread_id", "no_thread"]


def closed_messages(messages: DataFrame, lateness: str = "3 days", segment: str = "1 day") -> DataFrame:
    """Distinct messages of the closed segments of a stream (or a table), in append mode.

    ``(owner, no_owner, thread_id, no_thread, at, id, who, visible)``; rows equal
    in thread, role, content and time are one, of the smallest id.  Messages up
    to ``lateness`` behind the newest are waited for.  Messages without a time
    belong to no segment and pass at once.
    """
    slim = _slim(messages)
    timed = (
        slim.where("at is not null")
        .withWatermark("at", lateness)
        .groupBy(F.window("at", segment), *_KEYS, F.unix_micros("at").alias("micros"), "digest", "digest2", "who", "visible")
        .agg(F.min("id").alias("id"))
        .select(*_KEYS, F.timestamp_micros("micros").alias("at"), "id", "who", "visible")
    )
    untimed = slim.where("at is null").select(*_KEYS, F.lit(None).cast("timestamp").alias("at"), "id", "who", "visible")
    return timed.unionByName(untimed)


def _conversation_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and state on disk."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return own


def _folder(spark: SparkSession, path: str) -> str:
    """``path``, made where it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def _files(spark: SparkSession, path: str, files_each: int | None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_each is not None:
        reader = reader.option("maxFilesPerTrigger", files_each)
    if status.isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def _with_end(stream: DataFrame, place: str, time: str) -> DataFrame:
    """``stream`` with ``ended``, true for the record that ``_end_stream`` puts into ``place``."""
    end = stream.sparkSession.readStream.schema(f"{time} timestamp").parquet(_folder(stream.sparkSession, place))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != time else F.col(time) for f in stream.schema]
    return stream.withColumn("ended", F.lit(False)).unionByName(end.select(*rest, F.lit(True).alias("ended")))


def _end_stream(spark: SparkSession, place: str, time: str) -> None:
    spark.range(1).select(F.timestamp_micros(F.lit(_END)).alias(time)).coalesce(1).write.mode("append").parquet(place)


def sliced_messages(messages: DataFrame, slices: int | None = None) -> DataFrame:
    """``messages`` with ``slice``, a range of their order by thread, time and id that holds a bounded share of all rows."""
    n = slices or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = messages.repartitionByRange(n, *_KEYS, "at", "id", "who")
    return ranges.withColumn("slice", F.spark_partition_id())


def _turns(sliced: DataFrame) -> DataFrame:
    """Visible messages of users and assistants, with their place in the slice and the speaker before."""
    inside = W.partitionBy(*_KEYS, "batch", "slice").orderBy("at", "id", "who")
    # a message without a time has no place among the turns
    return sliced.where(F.col("visible") & F.col("who").isin("u", "a") & F.col("at").isNotNull()).select(
        *_KEYS, "batch", "slice", "at", "id", "who", (F.row_number().over(inside) - 1).alias("place"), F.lag("who").over(inside).alias("before")
    )


_THREAD = "owner string, no_owner boolean, thread_id string, no_thread boolean"
_SLICED = _THREAD + ", at timestamp, id bigint, who string, visible boolean, slice int, batch bigint"
_PART = "turns bigint, first string, last string, speaks boolean, broken boolean, waiting boolean"


_PARTS = f"{_THREAD}, batch bigint, slice int, at timestamp, {_PART}"
_VERDICTS = f"{_THREAD}, order struct<batch: bigint, slice: int>, part struct<{_PART}>, defect string"


def _parts(sliced: DataFrame) -> DataFrame:
    """One row for each slice of a thread: its place in the order, its time, and what it tells the next slice."""
    inside = W.partitionBy(*_KEYS, "batch", "slice").orderBy("at", "id", "who")
    turn = F.col("visible") & F.col("who").isin("u", "a")
    # the speaker before among the turns of the slice; other messages are passed over
    timed = turn & F.col("at").isNotNull()
    seen = sliced.withColumn("turn", F.when(timed, F.col("who"))).withColumn(
        "before", F.last("turn", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    )
    twice = lambda who: F.coalesce(F.max((F.col("turn") == who) & (F.col("before") == who)), F.lit(False))
    order = F.struct("at", "id", "who")
    odd = F.max(F.col("visible") & ((F.col("who") == "x") | F.col("at").isNull()))
    return seen.groupBy(*_KEYS, "batch", "slice").agg(
        F.max("at").alias("at"), F.count("turn").alias("turns"),
        F.min_by("turn", F.when(timed, order)).alias("first"), F.max_by("turn", F.when(timed, order)).alias("last"),
        F.max(turn).alias("speaks"), (odd | twice("a")).alias("broken"), twice("u").alias("waiting"),
    )


def _merged(parts: Column) -> Column:
    """Parts of a thread in order as one: neighbours that speak alike are at fault."""
    none = F.lit(None).cast(T.StructType.fromDDL(_PART))
    fields = [f.name for f in T.StructType.fromDDL(_PART)]
    alike = lambda a, b, who: F.coalesce((a["last"] == who) & (b["first"] == who), F.lit(False))

    def add(a: Column, b: Column) -> Column:
        both = F.struct(
            (a["turns"] + b["turns"]).alias("turns"), F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(b["last"], a["last"]).alias("last"),
            (a["speaks"] | b["speaks"]).alias("speaks"), (a["broken"] | b["broken"] | alike(a, b, "a")).alias("broken"),
            (a["waiting"] | b["waiting"] | alike(a, b, "u")).alias("waiting"),
        )
        only = F.struct(*(b[f].alias(f) for f in fields))
        return F.when(a.isNull(), only).otherwise(both)

    return F.aggregate(F.array_sort(parts), none, add)


def _defect(part: Column) -> Column:
    """What is wrong with a whole conversation; null for a sound one."""
    broken = part["broken"] | F.coalesce(part["first"] == "a", F.lit(False))
    waiting = part["waiting"] | F.coalesce(part["last"] == "u", F.lit(False))
    return F.when(~part["speaks"], "empty").when(broken, "broken").when(waiting, "no_reply")


def closed_conversations(parts: DataFrame, idle: str = "3650 days") -> DataFrame:
    """``(thread, order, part, defect)`` of the conversations of a stream (or a table) of parts that were closed, in append mode.

    Parts come in the order of their threads' times, as the first stream closes them.
    """
    fields = [f.name for f in T.StructType.fromDDL(_PART)]
    entry = F.struct("batch", "slice", *fields)
    sessions = (
        parts.withWatermark("at", "0 seconds")
        .groupBy(F.session_window("at", idle).alias("open"), *_KEYS)
        .agg(F.collect_list(entry).alias("parts"), F.max("ended").alias("ended"))
    )
    made = sessions.where("not ended").select(*_KEYS, F.array_min("parts").alias("order"), _merged(F.col("parts")).alias("part"))
    order = F.struct(F.col("order.batch").alias("batch"), F.col("order.slice").alias("slice")).alias("order")
    return made.select(*_KEYS, order, "part", _defect(F.col("part")).alias("defect"))


class Replay:
    """Both streams over all messages stored under ``path``, run until they are used up.

    ``place`` keeps state and results; a second run on it reads only new files.
    With ``final`` the stream is ended and every conversation closed; without,
    those that may still go on stay in state.  All new files are one batch unless
    ``files_each`` cuts them; a message later than ``lateness`` behind the newest
    of an earlier batch is dropped and counted.
    """

    def __init__(
        self, spark: SparkSession, path: str, place: str | None = None, slices: int | None = None, lateness: str = "3 days",
        segment: str = "1 day", idle: str = "3650 days", final: bool = True, files_each: int | None = None,
    ):
        self.spark = spark
        self.place = place or scratch_path(spark, "conversations")
        own = _conversation_session(spark)
        sliced, parts = (_folder(spark, f"{self.place}/{x}") for x in ("sliced", "parts"))

        def write(batch: DataFrame, number: int) -> None:
            # every action on a batch runs its state again
            once = batch.persist()
            cut = sliced_messages(once, slices).withColumn("batch", F.lit(number).cast("long"))
            cut.write.mode("overwrite").parquet(f"{sliced}/n={number}")
            once.unpersist()
            own_slices = batch.sparkSession.read.schema(_SLICED).parquet(f"{sliced}/n={number}")
            made = _parts(own_slices)
            # a part without a time goes with the newest so far
            earlier = batch.sparkSession.read.schema(_PARTS).option("recursiveFileLookup", True).parquet(parts).where(F.col("batch") < number)
            newest = own_slices.select("at").unionByName(earlier.select("at")).agg(F.coalesce(F.max("at"), F.timestamp_micros(F.lit(0))).alias("newest"))  # one row
            timed = made.crossJoin(F.broadcast(newest)).withColumn("at", F.coalesce("at", "newest"))
            timed.select(*T.StructType.fromDDL(_PARTS).fieldNames()).write.mode("overwrite").parquet(f"{parts}/n={number}")

        end = f"{self.place}/end-of-messages"
        messages = _with_end(_files(own, path, files_each), end, "created_at")
        closed = closed_messages(messages, lateness, segment).writeStream.foreachBatch(write).outputMode("append")
        closed = closed.option("checkpointLocation", f"{self.place}/messages-state").trigger(availableNow=True)
        self.late = 0
        if files_each is not None:  # the end must not overtake the files
            self._run(closed)
        if final:
            _end_stream(own, end, "created_at")
        if final or files_each is None:
            self._run(closed)

        end = f"{self.place}/end-of-parts"
        stream = _with_end(own.readStream.schema(_PARTS).option("recursiveFileLookup", True).parquet(parts), end, "at")
        if final:
            _end_stream(own, end, "at")
        judged = closed_conversations(stream, idle).writeStream.format("parquet").outputMode("append").option("path", f"{self.place}/verdicts")
        judged.option("checkpointLocation", f"{self.place}/conversations-state").trigger(availableNow=True).start().awaitTermination()

    def _run(self, stream) -> None:
        query = stream.start()
        query.awaitTermination()
        for progress in query.recentProgress:
            self.late += sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def late_messages(self) -> DataFrame:
        """``(late)``, one row: messages of this run that came behind the watermark and were left out."""
        return self.spark.createDataFrame([(self.late,)], "late long")

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.place}/{what}")

    def sliced(self) -> DataFrame:
        """The closed messages with their ``batch`` and ``slice``."""
        return self._read("sliced", _SLICED)

    def parts(self) -> DataFrame:
        """One row for each slice of a thread."""
        return self._read("parts", _PARTS)

    def threads(self) -> DataFrame:
        """``(thread, defect)``: the verdict of each thread, over its closed conversations in order."""
        closed = self.spark.read.schema(_VERDICTS).parquet(f"{self.place}/verdicts")
        listed = closed.groupBy(*_KEYS).agg(F.collect_list(F.struct("order.*", "part.*")).alias("parts"))
        return listed.select(*_KEYS, _defect(_merged(F.col("parts"))).alias("defect"))


def _named() -> list[Column]:
    return [F.when(~F.col("no_owner"), F.col("owner")).alias("owner"), F.when(~F.col("no_thread"), F.col("thread_id")).alias("thread_id")]


def dropped_threads(spark: SparkSession, path: str, slices: int | None = None) -> DataFrame:
    """``(owner, thread_id, defect)`` of the threads that are dropped, one row each.

    The first that holds: ``empty``, no message of a user or an assistant is left
    once those without visible content are out; ``broken``, a message left has an
    unknown role or no time, or an assistant speaks without a user before it
    since the last assistant; ``no_reply``, a user gets no answer before the next
    user or the end.  Rows equal in thread, role, content and time are one
    message (of the smallest id).  A null owner or thread id is a value of its
    own.  A stream without messages drops nothing.
    """
    return Replay(spark, path, slices=slices).threads().where("defect is not null").select(*_named(), "defect")


def sound_turns(spark: SparkSession, path: str, slices: int | None = None) -> DataFrame:
    """``(owner, thread_id, turn, role, content, created_at, id)``: the sound threads as numbered turns."""
    run = Replay(spark, path, slices=slices)
    chain = W.partitionBy(*_KEYS).orderBy("batch", "slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = run.parts().select(*_KEYS, "batch", "slice", F.coalesce(F.sum("turns").over(chain), F.lit(0)).alias("offset"))
    sound = run.threads().where("defect is null").select(*_KEYS)
    lines = _turns(run.sliced()).join(offsets.join(sound, _KEYS, "left_semi"), [*_KEYS, "batch", "slice"]).select(
        *_named(), (F.col("offset") + F.col("place")).alias("turn"),
        F.when(F.col("who") == "u", "user").otherwise("assistant").alias("role"), "id", F.col("at").alias("created_at"),
    )
    contents = spark.read.parquet(path).select("id", "content")
    return lines.join(contents, "id").select("owner", "thread_id", "turn", "role", "content", "created_at", "id")
