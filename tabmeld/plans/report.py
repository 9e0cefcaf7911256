"""Run reports as DataFrames."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.functions.names import column
from tabmeld.plans.consolidate import Consolidation, _literal_path
from tabmeld.plans.sink import read_output


def run_summary(spark: SparkSession, run: Consolidation) -> DataFrame:
    """One row of totals over the per-dataset status."""
    return summarize(run.status_table(spark), run.success, run.n_errors)


def summarize(status: DataFrame, success: bool, n_errors: int) -> DataFrame:
    """Totals over a status table; skipped single-file datasets count as processed."""
    processed = F.count_if(F.col("status").isin("merged", "skipped_single_file", "no_files"))
    return status.agg(
        F.lit(success).alias("success"),
        processed.alias("processed_datasets"),
        F.count("*").alias("total_datasets"),
        F.coalesce(F.sum("n_merged"), F.lit(0)).alias("total_files_merged"),
        F.count_if(F.col("status") == "skipped_single_file").alias("skipped_single_file"),
        F.lit(n_errors).cast("bigint").alias("errors"),
    )


def metric_table(summary: DataFrame) -> DataFrame:
    """The summary row as (metric, value) rows."""
    text = summary.select([F.col(name).cast("string").alias(name) for name in summary.columns])
    return text.unpivot([], summary.columns, "metric", "value")


SHAPE_SCHEMA = "dataset string, written boolean, n_rows bigint, columns array<string>"
PREVIEW_SCHEMA = "dataset string, row int, record string"


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """All parts, by a plan whose depth grows with the logarithm of their number."""
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def output_shapes(spark: SparkSession, run: Consolidation, written: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Per dataset: whether its output was written, and its shape, read back from the output."""
    lacking = [(name, False, None, None) for name, *_ in run.status if name not in written]
    parts = [spark.createDataFrame(lacking, SHAPE_SCHEMA)]
    for name, *_ in run.status:
        if name in written:
            table = read_output(spark, written[name], fmt)
            names = F.array(*[F.lit(c) for c in table.columns]).cast("array<string>")
            counted = table.agg(F.count("*").alias("n_rows"))
            parts.append(counted.select(F.lit(name).alias("dataset"), F.lit(True).alias("written"), "n_rows", names.alias("columns")))
    return _stacked(parts)


def output_previews(
    spark: SparkSession, run: Consolidation, written: dict[str, str], fmt: str = "parquet", n_rows: int = 3
) -> DataFrame:
    """The first rows of each written output, as JSON records numbered from 1.

    Outputs are sorted across files that are numbered by name, so only the first files are read, until
    they have given enough rows. Datasets without an output have no rows here.
    """
    found = []
    for name, *_ in run.status:
        if name not in written:
            continue
        table = read_output(spark, written[name], fmt)
        records: list[str] = []
        for file in sorted(table.inputFiles()):
            if len(records) == n_rows:
                break
            rows = read_output(spark, _literal_path(unquote(file)), fmt, table.schema)
            record = F.to_json(F.struct(*[column(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("record")
            records += [row["record"] for row in rows.select(record).take(n_rows - len(records))]
        found += [(name, place, record) for place, record in enumerate(records, start=1)]
    return spark.createDataFrame(found, PREVIEW_SCHEMA)
