"""Session settings and the folder that every executor can read.

Long lineages are cut by writing a table below the cluster's shared folder
(``spark.checkpoint.dir``).  Such a table outlives the executor that wrote it,
so a lost executor costs a re-read and never a wrong or failed job.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one where the session names none and runs in one machine."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lorequarry-")
    return f"file://{_local_dir}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below this application's part of the shared folder, which is removed when the driver ends."""
    if spark.sparkContext.applicationId not in _cleaned:
        _cleaned.add(spark.sparkContext.applicationId)
        atexit.register(_remove_at_exit, spark)
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lorequarry/{spark.sparkContext.applicationId}"


def _remove_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove_scratch(spark)
    except Exception:  # the session has ended before; its folder stays for the cluster to clear
        pass


def remove_scratch(spark: SparkSession) -> None:
    """Delete all tables this application has written to the shared folder; results not yet read are lost."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def build_session(app: str = "lorequarry", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
