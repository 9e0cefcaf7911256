"""Writing the merged results."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.operators.union import union_by_name
from tabmeld.plans.consolidate import Consolidation

# Quotes inside a cell are doubled, blanks kept; NULL is an empty cell and empty text a quoted one.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_output(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A written result; CSV cells may hold line breaks. Without ``schema`` CSV cells are text."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # A null marker that no cell holds, so that quoted empty cells stay empty text.
        reader = reader.options(**CSV_OPTIONS).option("multiLine", True).option("nullValue", "\x00")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_outputs(
    run: Consolidation,
    output_path: str,
    fmt: str = "parquet",
    single_file: bool = False,
    mode: str = "errorifexists",
    parallel: int = 4,
) -> dict[str, str]:
    """Write each merged dataset to ``<output_path>/<dataset>_merged``; returns the paths.

    Datasets are independent jobs, ``parallel`` of them at a time. A failed write is
    recorded as an error, the dataset's status becomes ``failed`` without merged files, and
    the others go on. ``single_file`` funnels a result through one
    task and is meant for small results only.
    """

    def write(item: tuple[str, DataFrame]) -> tuple[str, str, Exception | None]:
        name, table = item
        path = f"{output_path.rstrip('/')}/{name}_merged"
        try:
            out = table.coalesce(1) if single_file else table
            out.write.mode(mode).format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {})).save(path)
        except Exception as error:
            return name, path, error
        return name, path, None

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = list(pool.map(write, run.outputs.items()))
    failed = {name: f"Error saving merged dataset {path}: {error}" for name, path, error in done if error}
    run.errors += failed.values()
    run.status = [
        (name, "failed", n_files, 0, n_rows, failed[name]) if name in failed else (name, state, n_files, n_merged, n_rows, error)
        for name, state, n_files, n_merged, n_rows, error in run.status
    ]
    return {name: path for name, path, error in done if not error}


def stacked(spark: SparkSession, run: Consolidation) -> DataFrame:
    """All merged datasets in one table with a ``dataset`` column."""
    parts = []
    for name, table in run.outputs.items():
        if "dataset" in table.columns:
            raise ValueError(f"dataset '{name}' already has a column named 'dataset'")
        parts.append(table.select(F.lit(name).alias("dataset"), "*"))
    return union_by_name(spark, parts)


def write_partitioned(spark: SparkSession, run: Consolidation, output_path: str, mode: str = "errorifexists") -> str:
    """Write all merged datasets as one Parquet table partitioned by dataset.

    One table has one type per column: a name under which another dataset holds text is text
    here for all datasets. :func:`write_outputs` keeps the types of each dataset.
    """
    stacked(spark, run).write.mode(mode).partitionBy("dataset").parquet(output_path)
    return output_path
