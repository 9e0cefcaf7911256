"""File catalogue: which files each dataset holds, without reading any content."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.sources import decode

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"

# Extensions in the order in which their files follow each other.
EXTENSION_RANK = {"xlsx": 0, "xls": 1, "csv": 2}


def normal_root(root: str) -> str:
    """Root without trailing slash; a plain relative path becomes absolute."""
    root = root.rstrip("/") or "/"
    if not root.startswith("/") and not re.match(_SCHEME, root):
        root = os.path.abspath(root)
    return root


def file_format(file_name: Column) -> Column:
    """Format by lower-cased extension: ``excel``, ``csv`` or ``unknown``."""
    extension = F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1))
    return (
        F.when(extension.isin("xlsx", "xls"), F.lit("excel"))
        .when(extension == "csv", F.lit("csv"))
        .otherwise(F.lit("unknown"))
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below a dataset folder.

    ``status`` is ``supported``, ``unsupported`` (legacy binary workbooks), ``lock``,
    ``own_output`` (an earlier merge result of that dataset), ``nested`` (deeper than the
    dataset folder) or ``ignored``. Spark's file listing leaves out empty files and names that
    start with ``_`` or ``.``; table files of that kind are added by a listing of the dataset
    folders in tasks, and ``visible`` is false for the names. ``file_seq`` orders the files of
    a dataset.
    """
    root = normal_root(root)
    plain_root = re.sub(_SCHEME, "", root).rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            "path", "length", "modificationTime", F.col("_metadata.file_path").alias("file_path"), F.lit(True).alias("visible")
        )
    )
    files = files.unionByName(_unlisted(spark, root))
    plain = F.regexp_replace("path", _SCHEME, "")
    parts = F.split(F.substring(plain, F.lit(len(plain_root) + 2), F.length(plain)), "/")
    files = files.withColumn("_parts", parts).where(F.size("_parts") >= 2)
    name = F.element_at("_parts", -1)
    dataset = F.element_at("_parts", 1)
    extension = F.regexp_extract(name, r"\.([^.]*)$", 1)
    status = (
        F.when(F.size("_parts") > 2, "nested")
        .when(name.startswith("~$"), "lock")
        .when(name.startswith(F.concat(dataset, F.lit("_merged."))), "own_output")
        .when(extension.isin("xlsx", "csv"), "supported")
        .when(extension == "xls", "unsupported")
        .otherwise("ignored")
    )
    rank = F.lit(9)
    for known, order in EXTENSION_RANK.items():
        rank = F.when(extension == known, order).otherwise(rank)
    return files.select(
        dataset.alias("dataset"),
        name.alias("file_name"),
        "path",
        "file_path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        file_format(name).alias("file_format"),
        F.concat(rank.cast("string"), F.lit(":"), F.element_at(F.split("file_path", "/"), -1)).alias("file_seq"),
        status.alias("status"),
        "visible",
    )


def _unlisted(spark: SparkSession, root: str) -> DataFrame:
    """Empty and hidden table files of the dataset folders; one task lists a folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    entries = system.listStatus(hadoop_path) if system.exists(hadoop_path) else []
    # One entry per dataset; hidden folders hold no datasets.
    folders = [(e.getPath().toString(),) for e in entries if e.isDirectory() and e.getPath().getName()[0] not in "_."]
    found = decode.unlisted_files

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                rows = [(path, size, modified, uri, name[0] not in "_.") for name, path, uri, size, modified in found(folder)]
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "length", "modificationTime", "file_path", "visible"]
    schema = "path string, length bigint, modificationTime timestamp, file_path string, visible boolean"
    tasks = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(folders, "folder string").repartition(tasks).mapInPandas(listing, schema)


def select_datasets(
    files: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Keep the included datasets, then drop the excluded ones."""
    if include is not None:
        files = files.where(F.col("dataset").isin(*include)) if include else files.limit(0)
    if exclude:
        files = files.where(~F.col("dataset").isin(*exclude))
    return files


def supported_files(files: DataFrame) -> DataFrame:
    """The files that a merge counts: workbooks (legacy ones too) and CSV, without lock files."""
    return files.where(F.col("status").isin("supported", "unsupported"))


def check_root(spark: SparkSession, root: str) -> list[str]:
    """Errors that make a root unusable; empty when it holds at least one dataset folder."""
    try:
        files = list_files(spark, root)
        if not files.isEmpty():
            return []
        anything = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(normal_root(root))
        names = [row["path"] for row in anything.select("path").limit(1).collect()]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return [f"Directory does not exist: {root}"]
        raise
    if names and re.sub(_SCHEME, "", names[0]) == re.sub(_SCHEME, "", normal_root(root)):
        return [f"Path is not a directory: {root}"]
    return [f"No dataset folder with files found in: {root}"]
