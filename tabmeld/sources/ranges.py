"""Lines of text files by byte ranges: any charset, any file name, paths as rows.

Spark's own readers list folders themselves, leave out names that start with ``_`` or ``.``, and
read UTF-16 files whole. Here every range of a file is one row of a table that tasks work through,
so file names never pass the driver and a file of any size is read by many tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.session import materialize
from tabmeld.sources import decode

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of one range at most; a line belongs to the range in which it begins. A task holds some copies of
# a range, so this bounds its memory.
RANGE_BYTES = 4 << 20
# Bytes read at a time beyond a range, until its last line ends.
MORE_BYTES = 1 << 16
# Lines handed to Spark at a time.
BATCH_LINES = 10_000

# What a line does to the state "inside quotes": bit 0 is the state after it if it starts outside
# quotes, bit 1 if it starts inside. 2 leaves the state, 1 flips it, 0 and 3 set it.
KEEPS = 2

LINE_SCHEMA = "value string, _file string, _block bigint, _row bigint, _first boolean"

_SPARK_CHARSET = {"UTF-8": "utf-8", "ISO-8859-1": "latin-1"}


def text_unit(charset: str, mark: bytes) -> tuple[str, int]:
    """(Python codec, bytes of a unit) of a file; ``mark`` is its first two bytes."""
    if charset != "UTF-16":
        return _SPARK_CHARSET[charset], 1
    return ("utf-16-be" if mark == b"\xfe\xff" else "utf-16-le"), 2


def find_break(data: bytes, unit: int, codec: str, start: int = 0) -> int:
    """Place after the first line feed at or after ``start``, in whole units; -1 if there is none."""
    mark = "\n".encode(codec)
    at = data.find(mark, start)
    while at >= 0 and at % unit:
        at = data.find(mark, at + 1)
    return at + unit if at >= 0 else -1


def range_bytes(handle, size: int, begin: int, end: int, charset: str) -> tuple[bytes, int]:
    """UTF-8 bytes of the lines that begin in [begin, end), and where the first one begins.

    The file is read from the unit before ``begin``, so a line that begins right there is seen.
    Bytes of UTF-8 files are not looked at, so what is not valid stays as it is.
    """
    codec, unit = text_unit(charset, handle.read_at(2, 0) if size > 1 else b"")
    begin, end = begin - begin % unit, min(size, end - end % unit if end < size else size)
    low = max(0, begin - unit)
    data = handle.read_at(end - low, low)
    start = 0
    if begin:
        start = find_break(data, unit, codec)
        if start < 0 or low + start >= end:
            return b"", size
    # The last line goes on to its line feed, unless the range ends with one.
    at = len(data)
    if low + at < size and data[at - unit : at] != "\n".encode(codec):
        parts = [data]
        while low + at < size:
            more = handle.read_at(min(MORE_BYTES, size - low - at), low + at)
            stop = find_break(more, unit, codec)
            parts.append(more if stop < 0 else more[:stop])
            at += len(parts[-1])
            if stop >= 0:
                break
        data = b"".join(parts)
    data = data[start:]
    if charset != "UTF-8":
        data = data.decode(codec, "replace").encode("utf-8")
    return (data if begin else data.removeprefix(b"\xef\xbb\xbf")), low + start


def _lines(data: bytes, lone_returns: bool) -> pa.Array:
    """Lines without their ends, as one Arrow array."""
    raw = np.frombuffer(data, np.uint8)
    ends = raw == 10
    if lone_returns:
        # A carriage return ends a line too, and one before a line feed belongs to it.
        returns = raw == 13
        returns[:-1] &= raw[1:] != 10
        ends |= returns
    stops = np.flatnonzero(ends)
    starts = np.concatenate(([0], stops + 1))
    stops = np.append(stops, len(raw))
    if starts[-1] == len(raw):  # what follows the last line end is no line
        starts, stops = starts[:-1], stops[:-1]
    held = stops - starts
    returned = (held > 0) & (raw[np.maximum(stops - 1, 0)] == 13)
    # Line ends go; the rest of the bytes moves together.
    ends[stops[returned] - 1] = True
    held -= returned
    kept = raw[~ends]
    offsets = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])


def header_begins_before(handle, size: int, begin: int, charset: str) -> bool:
    """Whether the lines before ``begin`` hold more than blanks; almost always the head tells."""
    codec, unit = text_unit(charset, handle.read_at(2, 0) if size > 1 else b"")
    at = 0
    while at < begin:
        text = handle.read_at(min(MORE_BYTES, begin - at), at).decode(codec, "ignore")
        if text.strip("﻿ \t\r\n"):
            return True
        at += MORE_BYTES
    return False


def read_range(uri: str, size: int, begin: int, end: int, charset: str, lone_returns: bool) -> Iterator[pa.RecordBatch]:
    """Lines that begin in a range, in batches; ``_first`` marks a file's first line that is not blank."""
    with decode.open_file(uri) as handle:
        data, start = range_bytes(handle, size, begin, end, charset)
        seek_first = data and not header_begins_before(handle, size, start, charset)
    lines = _lines(data, lone_returns)
    del data
    for low in range(0, len(lines), BATCH_LINES):
        part = lines.slice(low, BATCH_LINES)
        first = np.zeros(len(part), bool)
        if seek_first:
            at = next((i for i, line in enumerate(part.cast(pa.binary()).to_pylist()) if line.strip(b" \t\r")), None)
            if at is not None:
                first[at], seek_first = True, False
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [part, pa.array([uri] * n, pa.string()), pa.array(np.full(n, begin)), pa.array(np.arange(begin + low, begin + low + n)), pa.array(first)],
            names=["value", "_file", "_block", "_row", "_first"],
        )


def file_ranges(files: DataFrame, most: int | None = None) -> DataFrame:
    """(file_path, size, charset, begin, end), one row per range of a file with bytes.

    Ranges are as long as Spark's own file splits may be, but not longer than RANGE_BYTES.
    """
    if most is None:
        spark = files.sparkSession
        split = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
        most = min(RANGE_BYTES, int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split)))
    begins = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(max(2, most)).cast("long"))
    ranges = files.where("size > 0").select("file_path", "size", "charset", F.explode(begins).alias("begin"))
    return ranges.withColumn("end", F.least(F.col("begin") + most, F.col("size")))


def read_lines(files: DataFrame, lone_returns: bool = False) -> DataFrame:
    """Lines of files, with provenance, as ``value``, ``_file``, ``_block``, ``_row`` and ``_first``.

    ``files`` has ``file_path``, ``size`` and ``charset`` (UTF-8, ISO-8859-1 or UTF-16 with a byte
    order mark). Lines end with a line feed, or with it after a carriage return; with
    ``lone_returns`` also with a carriage return alone, which may only stand inside a line of a
    range then. ``_block`` is where the range begins; ``_row`` rises along the file.
    """
    read = read_range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read(row["file_path"], row["size"], row["begin"], row["end"], row["charset"], lone_returns)

    ranges = file_ranges(files)
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(tasks).mapInArrow(run, LINE_SCHEMA)


def combined(first: int, second: int) -> int:
    """The code of two pieces of text, one after the other."""
    return (second >> (first & 1) & 1) | (second >> (first >> 1 & 1) & 1) << 1


def quote_coder(sep: str, mark: str, skip_lead: bool) -> Callable[[pa.Array], Iterator[tuple[int, int]]]:
    """(place, code) of the lines that change the quoting state, under one dialect."""
    whole = re.compile(decode.quoted_field(sep, mark, skip_lead).encode())
    opened = re.compile(decode.open_quote(sep, mark, skip_lead).encode())
    closing = re.compile(f"^(?:[^{mark}]|{mark}{mark})*+{mark}".encode())

    def ends_inside(line: bytes) -> bool:
        return opened.search(whole.sub(b"x", line)) is not None

    def codes(lines: pa.Array) -> Iterator[tuple[int, int]]:
        raw = lines.cast(pa.binary())
        for at in np.flatnonzero(pc.match_substring(raw, mark).to_numpy(zero_copy_only=False)).tolist():
            line = raw[at].as_py()
            closed = closing.match(line)
            inside = closed is None or ends_inside(b"x" + line[closed.end() :])
            code = int(ends_inside(line)) + 2 * int(inside)
            if code != KEEPS:
                yield at, code

    return codes


# Spaces and what is left of a line end: no record.
_BLANK = re.compile(rb" *\r{0,2}")


def range_effect(row: dict, codes: Callable) -> tuple[int, int | None]:
    """What a range does to the quoting state, and the place of its first line that is not blank."""
    with decode.open_file(row["file_path"]) as handle:
        data, _ = range_bytes(handle, row["size"], row["begin"], row["end"], row["charset"])
    lines = _lines(data, False)
    code = KEEPS
    for _, own in codes(lines):
        code = combined(code, own)
    raw = lines.cast(pa.binary())
    first = next((row["begin"] + at for at in range(len(raw)) if not _BLANK.fullmatch(raw[at].as_py())), None)
    return code, first


def _starts(lines: pa.Array, state: int, codes: Callable) -> tuple[np.ndarray, int]:
    """Places of the lines that start outside quotes, and the state after the last line."""
    outside, low = np.zeros(len(lines), bool), 0
    for at, code in codes(lines):
        outside[low : at + 1] = not state
        state, low = code >> state & 1, at + 1
    outside[low:] = not state
    return np.flatnonzero(outside), state


# A carriage return at the end of a record, or before a last line end other than a line feed.
_LAST_RETURN = re.compile(rb"\r(?=(?:\r|\r\n|\xc2\x85|\xe2\x80[\xa8\xa9])?\Z)")


def _without_returns(texts: pa.Array) -> pa.Array:
    """Records without a carriage return at their end; almost none has one."""
    raw = texts.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset + 1 : raw.offset + 1 + len(raw)]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    near = np.zeros(len(raw), bool)
    for back in range(1, 5):
        near |= (ends >= back) & (data[np.maximum(ends - back, 0)] == 13) if len(data) else False
    found = np.flatnonzero(near).tolist()
    if not found:
        return texts
    some = raw.to_pylist()
    for at in found:
        some[at] = _LAST_RETURN.sub(b"", some[at])
    return pa.array(some, pa.binary()).view(pa.string())


def read_records(row: dict, codes: Callable) -> Iterator[pa.RecordBatch]:
    """Records that begin in a range, the last one read on to its end; the file's header is left out."""
    with decode.open_file(row["file_path"]) as handle:
        end, size, charset = row["end"], row["size"], row["charset"]
        data, _ = range_bytes(handle, size, row["begin"], end, charset)
        lines = _lines(data, False)
        del data
        starts, state = _starts(lines, row["state"], codes)
        more, step = [lines], MORE_BYTES
        while len(starts) and state and end < size:
            data, _ = range_bytes(handle, size, end, min(size, end + step), charset)
            end, step = min(size, end + step), min(2 * step, RANGE_BYTES)
            after = _lines(data, False)
            others, state = _starts(after, state, codes)
            more.append(after[: others[0]] if len(others) else after)
            if len(others):
                break
    if not len(starts):
        return
    lines = pa.concat_arrays(more)
    borders = np.append(starts, len(lines)).astype(np.int32)
    texts = _without_returns(pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), lines), "\n"))
    places = row["begin"] + starts
    kept = pa.array(places != (-1 if row["header"] is None else row["header"]))
    texts, places = texts.filter(kept), places[kept.to_numpy(zero_copy_only=False)]
    for low in range(0, len(texts), BATCH_LINES):
        part = texts.slice(low, BATCH_LINES)
        n = len(part)
        columns = [part, pa.array([row["file_path"]] * n, pa.string()), pa.array(np.full(n, row["begin"])), pa.array(places[low : low + n])]
        yield pa.RecordBatch.from_arrays(columns, names=["text", "_file", "_block", "_row"])


def scan_records(files: DataFrame, sep: str, mark: str, skip_lead: bool) -> DataFrame:
    """Records (``text``, ``_file``, ``_block``, ``_row``) of files with quoted line breaks, without each file's header.

    ``files`` is as for :func:`read_lines`. A first pass gives one row per range: a code of what it does to the
    quoting state, and codes combine along the file. With the state at its begin, every range is cut into records
    where it stands; no text is shuffled. A record belongs to the range in which it begins.
    """
    coder, effect, read, combine, keeps = quote_coder, range_effect, read_records, combined, KEEPS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coder(sep, mark, skip_lead)
        for batch in batches:
            found = [effect(row, codes) for row in batch.to_pylist()]
            columns = [*batch.columns, pa.array([c for c, _ in found], pa.int32()), pa.array([f for _, f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "code", "first"])

    def settle(table: pa.Table) -> pa.Table:
        """States at the begin of each range of one file, and the place of its header in the range that holds it."""
        table = table.sort_by("begin")
        code, states = keeps, []
        for own in table.column("code").to_pylist():
            states.append(code & 1)
            code = combine(code, own)
        firsts = table.column("first").to_pylist()
        header = next((at for at, first in enumerate(firsts) if first is not None), None)
        headers = [first if at == header else None for at, first in enumerate(firsts)]
        table = table.drop_columns(["code", "first"])
        return table.append_column("state", pa.array(states, pa.int32())).append_column("header", pa.array(headers, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coder(sep, mark, skip_lead)
        for batch in batches:
            for row in batch.to_pylist():
                yield from read(row, codes)

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    place = "file_path string, size bigint, charset string, begin bigint, end bigint"
    measured = file_ranges(files).repartition(tasks).mapInArrow(measure, f"{place}, code int, first bigint")
    settled = materialize(measured.groupBy("file_path").applyInArrow(settle, f"{place}, state int, header bigint"), "ranges")
    return settled.repartition(tasks).mapInArrow(run, "text string, _file string, _block bigint, _row bigint")
