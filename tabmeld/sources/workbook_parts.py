"""Large workbooks read by many tasks.

A workbook is a zip file, so one task has to inflate its sheet; that is the cheap part. The task
cuts the stream at row borders into parts of bounded size and writes them, as they come, to a
table; other tasks parse the parts. Shared strings are cut the same way and become a table of their
own, from which every part gets just the strings that its cells name.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.session import materialize
from tabmeld.sources import decode

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of XML in a part, and bytes inflated at a time.
PART_BYTES = 2 << 20
_BLOCK = 1 << 18
# Parts in a file of the table that holds them: Parquet readers decode thousands of rows of a file together.
PARTS_PER_FILE = 8

PART_SCHEMA = (
    "file_path string, width int, kind string, part int, before bigint, root binary, xml binary, "
    "from_1904 boolean, date_styles array<int>"
)
_PREFIX = rb"(?:[A-Za-z_][\w.-]*:)?"
_TAG = {kind: re.compile(rb"<" + _PREFIX + name + rb"(?=[\s/>])") for kind, name in (("sheet", b"row"), ("strings", b"si"))}
_END = {kind: re.compile(rb"</" + _PREFIX + name + rb"\s*>") for kind, name in (("sheet", b"sheetData"), ("strings", b"sst"))}
_ROOT = {kind: re.compile(rb"<" + _PREFIX + name + rb"\b[^>]*>") for kind, name in (("sheet", b"worksheet"), ("strings", b"sst"))}
_ROW = re.compile(rb"<" + _PREFIX + rb"row((?:\s[^>]*)?)>")
_NUMBER = re.compile(rb"\sr=[\"'](\d+)")
_SHARED = re.compile(
    rb"\st=[\"']s[\"'][^>]*>\s*(?:<" + _PREFIX + rb"f\b.*?</" + _PREFIX + rb"f>\s*)?<" + _PREFIX + rb"v[^>]*>\s*(\d+)", re.DOTALL
)


def _blocks(archive, member: str) -> Iterator[bytes]:
    with archive.open(member) as stream:
        while block := stream.read(_BLOCK):
            yield block


def can_be_cut(archive, member: str) -> bool:
    """Whether every tag in the stream is one: it is UTF-8 without comments and CDATA sections."""
    last = b""
    for block in _blocks(archive, member):
        if not last and block[:2] in (b"\xff\xfe", b"\xfe\xff") or b"<!" in last[-1:] + block:
            return False
        last = block
    return True


def cut(archive, member: str, kind: str, part_bytes: int = PART_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """(root tag, whole elements) of a stream, ``part_bytes`` or a little more at a time."""
    tag, end, root, held = _TAG[kind], _END[kind], b"", b""
    for block in _blocks(archive, member):
        held += block
        if not root:
            first = tag.search(held)
            if not first:
                continue
            root, held = _ROOT[kind].search(held)[0], held[first.start() :]
        if len(held) < part_bytes:
            continue
        starts = [found.start() for found in tag.finditer(held)]
        if starts[-1]:
            yield root, held[: starts[-1]]
            held = held[starts[-1] :]
    if root:
        last = end.search(held)
        yield root, held[: last.start()] if last else held


def last_row_number(xml: bytes, before: int) -> int:
    """Number of the last row of a part; rows without a number follow the one before."""
    for attributes in _ROW.findall(xml):
        found = _NUMBER.search(attributes)
        before = int(found[1]) if found else before + 1
    return before


def workbook_parts(uri: str, width: int, part_bytes: int = PART_BYTES) -> Iterator[tuple]:
    """Rows of PART_SCHEMA; a workbook that can't be cut is one part of kind ``whole``."""
    with decode.open_file(uri) as handle:
        book = decode.Workbook(handle)
        strings = "xl/sharedStrings.xml"
        members = [("sheet", book.sheet)] + ([("strings", strings)] if strings in book.archive.namelist() else [])
        if not all(can_be_cut(book.archive, member) for _, member in members):
            yield uri, width, "whole", 0, 0, None, None, False, []
            return
        facts = (book.epoch.year == 1904, sorted(book.date_styles))
        for kind, member in members:
            before = 0
            for part, (root, xml) in enumerate(cut(book.archive, member, kind, part_bytes)):
                yield uri, width, kind, part, before, root, xml, *facts
                before = last_row_number(xml, before) if kind == "sheet" else before + len(_TAG[kind].findall(xml))


def _elements(root: bytes, xml: bytes, tag: str) -> Iterator:
    """Elements of a part, each forgotten after its turn."""
    import io
    from xml.etree.ElementTree import iterparse

    name = re.match(rb"<([^\s/>]+)", root)[1]
    for _, node in iterparse(io.BytesIO(root + xml + b"</" + name + b">")):
        if node.tag == decode.Workbook._MAIN + tag:
            yield node
            node.clear()


def part_strings(before: int, root: bytes, xml: bytes) -> list[tuple[int, str]]:
    """(number, text) of the shared strings in a part."""
    return [(before + at, decode.Workbook.text(node)) for at, node in enumerate(_elements(root, xml, "si"))]


def part_rows(part: dict, strings: dict[int, str]) -> Iterator[tuple[int, list]]:
    """(row number, cells) of a part, blank rows between two others included."""
    cells = decode.Cells(strings, set(part["date_styles"]), part["from_1904"])
    number, last = part["before"], None
    for node in _elements(part["root"], part["xml"], "row"):
        number = int(node.get("r") or number + 1)
        row = cells.of_row(node)
        if any(text is not None for text, _ in row):
            for blank in range(last + 1, number) if last is not None else ():
                yield blank, []
            yield number, row
            last = number


def scan_large_workbooks(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows below the header of the first sheet of each workbook: _file, _block, _row, cells, dated.

    ``files`` has ``file_path`` and ``width``. No task holds more than a part of a sheet, the strings
    that it names, and a part of the shared strings.
    """
    parts_of, rows_of, strings_of, shared = workbook_parts, part_rows, part_strings, _SHARED
    whole_rows = decode.workbook_rows
    names = [field.split()[0] for field in PART_SCHEMA.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, width in zip(batch["file_path"], batch["width"]):
                for row in parts_of(uri, width, part_bytes):
                    yield pd.DataFrame([row], columns=names)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # A batch holds many parts; each becomes objects in its turn.
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1).to_pylist()[0]

    def read_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            found = strings_of(row["before"], row["root"], row["xml"])
            columns = [[row["file_path"]] * len(found), [number for number, _ in found], [text for _, text in found]]
            types = [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_path", "number", "text"])

    def read_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            numbers = list({int(number) for number in shared.findall(row["xml"])})
            columns = [[row["file_path"]] * len(numbers), [row["part"]] * len(numbers), numbers]
            types = [pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_path", "part", "number"])

    def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_file", "part", "number", "blank", "cells", "dated"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_())]
        for row in one_by_one(batches):
            width = row["width"]
            strings = {s["number"]: s["text"] for s in row.pop("strings") or ()}
            block = []
            for number, cells in rows_of(row, strings):
                padded = cells[:width] + [(None, False)] * (width - len(cells))
                texts, dated = [text for text, _ in padded], [date for _, date in padded]
                block.append((row["file_path"], row["part"], number, not cells, texts, dated))
            columns = list(zip(*block)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def read_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, width in zip(batch["file_path"], batch["width"]):
                rows = [(uri, 0, *row) for row in whole_rows(uri, width)]
                yield pd.DataFrame(rows, columns=["_file", "_block", "_row", "cells", "dated"])

    spark = files.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    out_schema = "_file string, _block bigint, _row bigint, cells array<string>, dated array<boolean>"
    parts = files.select("file_path", "width").repartition(tasks).mapInPandas(split, PART_SCHEMA)
    parts = materialize(parts, "workbook_parts", PARTS_PER_FILE, "zstd")
    sheets, texts = parts.where("kind = 'sheet'"), parts.where("kind = 'strings'")
    key = ["file_path", "part"]
    strings = texts.repartition(tasks, *key).mapInArrow(read_strings, "file_path string, number bigint, text string")
    named = sheets.join(texts.select("file_path").distinct(), "file_path", "left_semi").repartition(tasks, *key)
    named = named.mapInArrow(read_names, "file_path string, part int, number bigint")
    held = named.join(strings, ["file_path", "number"]).groupBy(*key).agg(F.collect_list(F.struct("number", "text")).alias("strings"))
    parsed = sheets.join(held, key, "left").mapInArrow(
        read_rows, "_file string, part int, number bigint, blank boolean, cells array<string>, dated array<boolean>"
    )
    rows = materialize(parsed, "workbook_rows")
    # One row per part: the header is the first row with a cell, blank rows at borders are put in.
    ends = rows.where(~F.col("blank")).groupBy("_file", "part").agg(
        F.min("number").alias("low"), F.max("number").alias("high"), F.any_value(F.size("cells")).alias("width")
    )
    by_part = Window.partitionBy("_file").orderBy("part")
    ends = materialize(
        ends.withColumn("before", F.lag("high").over(by_part)).withColumn("header", F.min("low").over(Window.partitionBy("_file"))),
        "workbook_ends",
    )
    nothing = lambda value: F.array_repeat(value, F.col("width"))
    gaps = ends.where("low > before + 1").select(
        "_file", F.explode(F.sequence(F.col("before") + 1, F.col("low") - 1)).alias("number"), "header",
        nothing(F.lit(None).cast("string")).alias("cells"), nothing(F.lit(False)).alias("dated"),
    )
    headers = ends.select("_file", "part", "header")
    found = rows.join(headers, ["_file", "part"]).select("_file", "number", "header", "cells", "dated").unionByName(gaps)
    placed = found.where("number > header").select(
        "_file", F.lit(0).cast("bigint").alias("_block"), (F.col("number") - F.col("header") - 1).alias("_row"), "cells", "dated"
    )
    whole = parts.where("kind = 'whole'").select("file_path", "width").repartition(tasks).mapInPandas(read_whole, out_schema)
    return placed.unionByName(whole)
