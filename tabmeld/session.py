"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Engine-wide SQL settings: names are case-sensitive, time is UTC, plans adapt at run time.
SQL_SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN: list[str] = []


def build_session(app_name: str = "tabmeld", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the engine settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine settings to a session that somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="tabmeld-")
    return _LOCAL_SCRATCH[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which :func:`clear_scratch` deletes."""
    path = f"{shared_dir(spark)}/tabmeld/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str, rows_per_file: int = 0, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    The result survives lost executors and is computed a single time, however many
    branches read it. ``rows_per_file`` bounds what a reader of long rows decodes at a time; ``compression``
    is Parquet's, where the default takes too much space.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    writer = writer.option("compression", compression) if compression else writer
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables and exports this process wrote; call it when nothing reads them any more."""
    context = spark.sparkContext
    n_paths = len(_WRITTEN)
    while _WRITTEN:
        path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return n_paths
