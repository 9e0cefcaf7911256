"""Row scans: one reader per dialect, whichever headers its files have."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.functions.cells import null_if_missing, null_if_missing_value
from tabmeld.sources import decode
from tabmeld.sources.ranges import KEEPS, read_lines, scan_records
from tabmeld.sources.workbook_parts import scan_large_workbooks

# Rows handed to Spark at a time by the workbook reader.
WORKBOOK_BLOCK_ROWS = 50_000
# Workbooks from this size on are cut into parts that many tasks parse.
SPLIT_BYTES = 1 << 20

RECORD = "_record"
PROVENANCE = ("_file", "_block", "_row")


@dataclass(frozen=True)
class Dialect:
    """How CSV files are written; one scan reads all files of a dialect."""

    charset: str = "UTF-8"
    sep: str = ","
    quote: str = '"'
    skip_lead: bool = True
    multiline: bool = False


def cell(position: int) -> str:
    """Name of the string column that holds the cells at a 0-based position."""
    return f"c{position}"


def _csv_options(dialect: Dialect, width: int) -> dict[str, str]:
    return {
        "sep": dialect.sep,
        "quote": dialect.quote,
        "escape": dialect.quote,
        "ignoreLeadingWhiteSpace": str(dialect.skip_lead),
        "maxColumns": str(max(20_480, width + 1_024)),
        "columnNameOfCorruptRecord": RECORD,
    }


def _record_schema(width: int) -> T.StructType:
    fields = [T.StructField(cell(i), T.StringType()) for i in range(width)]
    return T.StructType([*fields, T.StructField(RECORD, T.StringType())])


def scan_csv(spark: SparkSession, folder: str, width: int, dialect: Dialect) -> DataFrame:
    """All records of the CSV files of a folder as strings ``c0..``, with provenance.

    ``_record`` holds the raw text of a record whose field count is not ``width``. For folders whose
    files all have one header and one dialect that Spark can split by line.
    """
    raw = (
        spark.read.schema(_record_schema(width))
        .options(**_csv_options(dialect, width))
        .option("header", True)
        .option("encoding", dialect.charset)
        # Field counts need whole records, whichever columns a query reads.
        .option("columnPruning", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def scan_files(files: DataFrame, width: int, dialect: Dialect) -> DataFrame:
    """The same for a table of files with ``file_path`` and ``size``, whatever their names and charset.

    ``_record`` holds the raw text of every record. Files are split by ranges of lines; where quoted
    line breaks were found, ranges are cut into records instead.
    """
    places = files.select("file_path", "size", F.lit(dialect.charset).alias("charset"))
    if dialect.multiline:
        records = scan_records(places, dialect.sep, dialect.quote, dialect.skip_lead).where(F.trim("text") != "")
    else:
        lines = read_lines(places, True)
        records = lines.where(~F.col("_first") & (F.trim("value") != "")).select(F.col("value").alias("text"), *PROVENANCE)
    names = ", ".join(f"{cell(i)} string" for i in range(width))
    parsed = F.from_csv("text", f"{names}, {RECORD} string", _csv_options(dialect, width))
    return records.select(
        parsed.alias("p"), F.col("text").alias(RECORD), *PROVENANCE
    ).select(*[F.col(f"p.{cell(i)}") for i in range(width)], RECORD, *PROVENANCE)


def line_code(line: Column, sep: str, mark: str, skip_lead: bool) -> Column:
    """The code of a line under one dialect."""
    whole, opened = decode.quoted_field(sep, mark, skip_lead), decode.open_quote(sep, mark, skip_lead)
    closing = f"^(?:[^{mark}]|{mark}{mark})*+{mark}"

    def ends_inside(text: Column) -> Column:
        return F.regexp_replace(text, whole, "x").rlike(opened)

    inside = ~line.rlike(closing) | ends_inside(F.regexp_replace(line, closing, "x"))
    code = ends_inside(line).cast("int") + F.lit(2) * inside.cast("int")
    return F.when(F.contains(line, F.lit(mark)), code).otherwise(F.lit(KEEPS))


def then(first: Column, second: Column) -> Column:
    """The code of two pieces of text, one after the other."""

    def after(state: Column) -> Column:
        return F.pmod(F.floor(second / F.when(state == 1, 2).otherwise(1)), F.lit(2)).cast("int")

    return after(F.pmod(first, F.lit(2))) + F.lit(2) * after(F.floor(first / 2))


def field_count(record: Column, dialect: Dialect) -> Column:
    """Number of fields in a raw record: delimiters outside quoted fields, plus one.

    A quote opens a field only where the field starts; any other one is a plain character.
    """
    whole = decode.quoted_field(dialect.sep, dialect.quote, dialect.skip_lead)
    bare = F.regexp_replace(record, f"{whole}|{decode.open_quote(dialect.sep, dialect.quote, dialect.skip_lead)}(?s:.*)", "x")
    return F.length(bare) - F.length(F.replace(bare, F.lit(dialect.sep), F.lit(""))) + 1


def is_overlong(width: Column, widest: int, dialect: Dialect) -> Column:
    """True for records with more fields than the ``width`` of their file's header.

    ``widest`` is the number of cells scanned; short records are padded instead.
    """
    record = F.col(RECORD)
    # Spark refuses a scan that reads nothing but the raw record, hence a look at one cell.
    readable = F.length(F.concat_ws("", record, cell(0))) >= 0
    # Delimiters inside quotes count here too, so few records need the costly count.
    may_be = F.length(record) - F.length(F.replace(record, F.lit(dialect.sep), F.lit(""))) >= width
    # Last, so that only records that are too long are parsed for it.
    over = may_be & (field_count(record, dialect) > width) & readable
    return F.when(record.isNull(), F.lit(widest) > width).otherwise(over)


def good_rows(scan: DataFrame, widest: int, dialect: Dialect, width: Column | None = None) -> DataFrame:
    """Records that fit their header, with missing-value tokens as NULL.

    Without ``width`` all headers are as wide as the scan. Further columns of ``scan`` stay.
    """
    width = F.lit(widest) if width is None else width
    names = [cell(i) for i in range(widest)]
    others = [name for name in scan.columns if name not in names and name != RECORD]
    fitting = scan.where(~is_overlong(width, widest, dialect))
    return fitting.select(*[null_if_missing(name).alias(name) for name in names], *others)


def rejected_rows(scan: DataFrame, widest: int, dialect: Dialect, width: Column | None = None, *carry: str) -> DataFrame:
    """Records with too many fields: their leading cells and their raw text, and the columns in ``carry``."""
    width = F.lit(widest) if width is None else width
    cells = [F.col(cell(i)) for i in range(widest)]
    return scan.where(is_overlong(width, widest, dialect)).select(
        F.col("_file").alias("file_path"),
        field_count(F.col(RECORD), dialect).alias("n_fields"),
        width.alias("n_columns"),
        F.slice(F.array(*cells), 1, width).alias("cells"),
        F.regexp_replace(RECORD, "[\r\n]+$", "").alias("record"),
        *carry,
    )


def scan_workbooks(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of the first sheet of each workbook, as ``cells`` and ``dated`` arrays.

    ``files`` needs a ``file_path``, its ``size`` and the ``width`` of each header. A workbook of less
    than ``split_bytes`` is decoded by one task, block by block; a longer one is cut into parts.
    """
    rows_of = decode.workbook_rows
    block_rows = WORKBOOK_BLOCK_ROWS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, width in zip(batch["file_path"], batch["width"]):
                block = []
                for number, cells, dated in rows_of(uri, width):
                    block.append((uri, 0, number, cells, dated))
                    if len(block) == block_rows:
                        yield pd.DataFrame(block, columns=names)
                        block = []
                yield pd.DataFrame(block, columns=names)

    names = [*PROVENANCE, "cells", "dated"]
    schema = "_file string, _block bigint, _row bigint, cells array<string>, dated array<boolean>"
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    small, large = files.where(F.col("size") < split_bytes), files.where(F.col("size") >= split_bytes)
    rows = small.select("file_path", "width").repartition(tasks).mapInPandas(read, schema)
    if not large.isEmpty():
        rows = rows.unionByName(scan_large_workbooks(large))
    known = F.transform("cells", null_if_missing_value)
    return rows.select(known.alias("cells"), "dated", *PROVENANCE)
