"""Per-file helpers that run inside tasks: open a file, probe a CSV head, read a sheet.

Each call sees one file. Functions here are shipped to executors by value, so the
package need not be installed there.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from urllib.parse import quote, unquote
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes read from a CSV file at first; what they leave open is settled by a scan of the whole file.
HEAD_BYTES = 1 << 20

# Delimiters in the order in which they are tried.
DELIMITERS = (",", ";", "\t", "|")

# Readers of last resort for UTF-8 files: comma with default options, then apostrophes.
FALLBACKS = ({"sep": ",", "quotechar": '"'}, {"sep": ",", "quotechar": "'"})

NO_TABLE = "no encoding and delimiter gave a table"

# Built-in spreadsheet number formats that show dates or times.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def locate(uri: str):
    """(file system, path) of a Hadoop-style URI, through Arrow's file systems."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), unquote(uri)
    if scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    if scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return fs.FileSystem.from_uri(unquote(uri))


def open_file(uri: str):
    """Random-access handle on a Hadoop-style URI."""
    system, path = locate(uri)
    return system.open_input_file(path)


def unlisted_files(folder: str) -> Iterator[tuple]:
    """(name, path, uri, size, modified) of table files in a folder that Spark's listing leaves out."""
    from pyarrow import fs

    system, path = locate(quote(folder, safe="/:"))
    for info in system.get_file_info(fs.FileSelector(path)):
        name = info.base_name
        table = name.lower().endswith((".csv", ".xlsx", ".xls"))
        if info.type == fs.FileType.File and table and (name[0] in "_." or not info.size):
            yield name, f"{folder}/{name}", f"{quote(folder, safe='/:')}/{quote(name)}", info.size, info.mtime


def decode_head(data: bytes, complete: bool) -> tuple[str, str]:
    """(Spark charset, text) of a file head: BOM first, then UTF-8, then Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        charset, text = "UTF-16", data[: len(data) // 2 * 2].decode("utf-16", "replace")
    else:
        if not complete:
            data = data[: data.rfind(b"\n") + 1] or data
        try:
            charset, text = "UTF-8", data.decode("utf-8-sig")
        except UnicodeDecodeError:
            charset, text = "ISO-8859-1", data.decode("latin-1")
    return charset, text if complete else whole_records(text)


def whole_records(text: str) -> str:
    """Cut a head after its last line break that is not inside quotes."""
    end = text.rfind("\n") + 1
    odd = text.count('"', 0, end) % 2
    while end and odd:
        start = text.rfind("\n", 0, end - 1) + 1
        odd = (odd + text.count('"', start, end)) % 2
        end = start
    return text[:end] or text


def quoted_field(sep: str, mark: str, skip_lead: bool) -> str:
    """Pattern of a whole quoted field, where a field starts; doubled quotes stand for one."""
    return f"{field_start(sep, skip_lead)}{mark}(?:[^{mark}]|{mark}{mark})*+{mark}"


def open_quote(sep: str, mark: str, skip_lead: bool) -> str:
    """Pattern of a quote at the start of a field; once whole fields are gone, one that stays open."""
    return field_start(sep, skip_lead) + mark


def field_start(sep: str, skip_lead: bool) -> str:
    lead = "" if not skip_lead else " *" if sep == "\t" else "[ \t]*"
    return f"(?:^|(?<={re.escape(sep)})){lead}"


def has_open_quote(line: str, sep: str, mark: str, skip_lead: bool) -> bool:
    """True if a line that starts outside quotes ends inside them."""
    bare = re.sub(quoted_field(sep, mark, skip_lead), "x", line)
    return re.search(open_quote(sep, mark, skip_lead), bare) is not None


def read_head(text: str, attempt: dict, rows: int | None) -> pd.DataFrame | None:
    try:
        return pd.read_csv(io.StringIO(text), on_bad_lines="skip", dtype=str, nrows=rows, **attempt)
    except Exception:
        return None


def dialect(charset: str, attempt: dict, text: str, names: Sequence[str]) -> dict:
    sep, mark, skip_lead = attempt["sep"], attempt["quotechar"], "skipinitialspace" in attempt
    return {
        "status": "ok",
        "charset": charset,
        "sep": sep,
        "quote": mark,
        "skip_lead": skip_lead,
        "header": [str(name) for name in names],
        "multiline": any(mark in line and has_open_quote(line, sep, mark, skip_lead) for line in text.splitlines()),
    }


def probe_csv(data: bytes, complete: bool) -> dict:
    """Dialect and header of one CSV file, from its head (all of it when ``complete``).

    The first delimiter that gives two columns and a row wins; files without one fall to the
    readers of last resort. A head can't tell whether a quote is open at the end of the file, in
    which case the last of these readers counts, so its header comes back as ``alt_header``.
    """
    charset, text = decode_head(data, complete)
    rows = None if complete else 500
    found, one_column, settled = None, True, True
    for mark in DELIMITERS:
        attempt = dict(sep=mark, quotechar='"', skipinitialspace=True)
        table = read_head(text, attempt, rows)
        settled = settled and table is not None and len(table) > 0
        if table is not None and len(table.columns) > 1:
            one_column = False
            if len(table) > 0:
                found = dialect(charset, attempt, text, table.columns)
                break
    if found is None and charset == "UTF-8" and (complete or one_column):
        tables = ((attempt, read_head(text, attempt, rows)) for attempt in FALLBACKS)
        found = next((dialect(charset, a, text, t.columns) for a, t in tables if t is not None), None)
    if found is None:
        # A header and a record of one column under every delimiter stay what they are in a longer head, and
        # so does a charset other than UTF-8 that whole lines or a mark show.
        final = complete or (one_column and settled and charset != "UTF-8" and b"\n" in data)
        return {"status": "failed", "error": NO_TABLE, "final": final}
    if not complete:
        table = read_head(text, FALLBACKS[-1], rows)
        found["alt_header"] = None if table is None else [str(name) for name in table.columns]
    return found


def probe_csv_file(uri: str, size: int) -> dict:
    """Probe with a growing head, until it gives a table or the file ends."""
    head = HEAD_BYTES
    with open_file(uri) as handle:
        data = handle.read(head)
        while True:
            found = probe_csv(data, size <= head)
            if found.pop("final", True):
                return found
            data += handle.read(head)
            head *= 2


class Cells:
    """Cells of a sheet's row elements as (text, is_date)."""

    _MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def __init__(self, strings, date_styles: set[int], from_1904: bool):
        self.strings, self.date_styles = strings, date_styles
        self.epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)

    @classmethod
    def text(cls, node) -> str:
        """Text of a string element, without readings of it."""
        if node.find(cls._MAIN + "r") is None and node.find(cls._MAIN + "rPh") is None:
            return node.findtext(cls._MAIN + "t") or ""
        skip = {id(t) for run in node.iter(cls._MAIN + "rPh") for t in run.iter(cls._MAIN + "t")}
        return "".join(t.text or "" for t in node.iter(cls._MAIN + "t") if id(t) not in skip)

    def of_row(self, row) -> list[tuple[str | None, bool]]:
        cells: list[tuple[str | None, bool]] = []
        for cell in row.iterfind(self._MAIN + "c"):
            position = self._position(cell.get("r"), len(cells))
            cells.extend([(None, False)] * (position - len(cells)))
            cells.append(self._cell(cell))
        return cells

    @staticmethod
    def _position(reference: str | None, default: int) -> int:
        if not reference:
            return default
        position = 0
        for letter in reference.rstrip("0123456789"):
            position = position * 26 + ord(letter) - 64
        return position - 1

    def _cell(self, cell) -> tuple[str | None, bool]:
        kind = cell.get("t") or "n"
        if kind == "inlineStr":
            inline = cell.find(self._MAIN + "is")
            return (None if inline is None else self.text(inline) or None), False
        value = cell.findtext(self._MAIN + "v")
        if value is None or value == "" or kind == "e":
            return None, False
        if kind == "s":
            return self.strings[int(value)], False
        if kind == "b":
            return ("True" if value == "1" else "False"), False
        if kind == "d":
            return datetime.fromisoformat(value).isoformat(" "), True
        if kind != "n":
            return value, False
        number = float(value)
        if int(cell.get("s") or 0) in self.date_styles:
            moment = self.epoch + timedelta(milliseconds=round(number * 86_400_000))
            return moment.isoformat(" "), True
        return (str(int(number)) if number.is_integer() else repr(number)), False


class SharedStrings:
    """Shared strings by number, read from their stream no further than somebody asks for."""

    def __init__(self, nodes: Iterator):
        self.nodes, self.known = nodes, []

    def __getitem__(self, number: int) -> str:
        while len(self.known) <= number:
            node = next(self.nodes)
            self.known.append(Cells.text(node))
            node.clear()
        return self.known[number]


class Workbook(Cells):
    """Streaming reader for the first sheet of an .xlsx file."""

    _REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def __init__(self, handle):
        self.archive = zipfile.ZipFile(handle)
        members = set(self.archive.namelist())
        self.sheet, from_1904 = self._first_sheet()
        strings = SharedStrings(self._elements("xl/sharedStrings.xml", "si")) if "xl/sharedStrings.xml" in members else []
        super().__init__(strings, self._date_styles() if "xl/styles.xml" in members else set(), from_1904)

    def _elements(self, member: str, *tags: str):
        wanted = {self._MAIN + tag for tag in tags}
        with self.archive.open(member) as stream:
            for _, node in iterparse(stream):
                if node.tag in wanted:
                    yield node

    def _first_sheet(self):
        target, from_1904 = None, False
        for node in self._elements("xl/workbook.xml", "workbookPr", "sheet"):
            if node.tag.endswith("workbookPr"):
                from_1904 = node.get("date1904") in ("1", "true")
            elif target is None:
                target = node.get(self._REL)
        with self.archive.open("xl/_rels/workbook.xml.rels") as stream:
            for _, node in iterparse(stream):
                if node.get("Id") == target:
                    path = node.get("Target")
                    return (path.lstrip("/") if path.startswith("/") else "xl/" + path), from_1904
        raise ValueError("workbook has no sheet")

    def _date_styles(self) -> set[int]:
        custom, dates = set(), set()
        for node in self._elements("xl/styles.xml", "numFmt", "cellXfs"):
            if node.tag.endswith("numFmt"):
                bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", node.get("formatCode") or "").lower()
                if re.search("[dmyhs]", bare) and bare != "general":
                    custom.add(int(node.get("numFmtId")))
            else:
                for position, style in enumerate(node):
                    number = int(style.get("numFmtId") or 0)
                    if number in DATE_FORMAT_IDS or number in custom:
                        dates.add(position)
        return dates

    def rows(self) -> Iterator[list[tuple[str | None, bool]]]:
        """Rows as (text, is_date) cells; gaps are blank rows, trailing blank rows are left out."""
        held, last = 0, 0
        with self.archive.open(self.sheet) as stream:
            for _, node in iterparse(stream):
                if node.tag != self._MAIN + "row":
                    continue
                number = int(node.get("r") or last + 1)
                cells = self.of_row(node)
                node.clear()
                held += number - last - 1
                last = number
                if all(text is None for text, _ in cells):
                    held += 1
                    continue
                for _ in range(held):
                    yield []
                held = 0
                yield cells


def header_names(cells: list[tuple[str | None, bool]], blank_as_empty: bool) -> list[str]:
    """Header texts; blank cells are numbered and repeats get a suffix, as for CSV files."""
    if blank_as_empty:
        return [text or "" for text, _ in cells]
    names: list[str] = []
    for position, (text, _) in enumerate(cells):
        name = base = text if text is not None else f"Unnamed: {position}"
        repeat = 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def probe_workbook(uri: str, blank_as_empty: bool) -> dict:
    with open_file(uri) as handle:
        first = next((cells for cells in Workbook(handle).rows() if cells), None)
    if first is None:
        return {"status": "failed", "error": "empty sheet"}
    return {"status": "ok", "header": header_names(first, blank_as_empty)}


def workbook_rows(uri: str, width: int) -> Iterator[tuple[int, list[str | None], list[bool]]]:
    """Data rows below the header, cut or padded to the header width."""
    with open_file(uri) as handle:
        rows = iter(Workbook(handle).rows())
        for cells in rows:
            if cells:
                break
        for number, cells in enumerate(rows):
            cells = cells[:width] + [(None, False)] * (width - len(cells))
            yield number, [text for text, _ in cells], [dated for _, dated in cells]
