"""Text files by byte ranges, and large workbooks in parts, against plain reading of whole files."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest

from tabmeld.plans.consolidate import consolidate
from tabmeld.sources import decode, ranges, workbook_parts
from tabmeld.sources.decode import workbook_rows
from workload.exports import sheet_bytes


@pytest.mark.parametrize("charset", ["UTF-8", "ISO-8859-1", "UTF-16", "UTF-16BE"])
def test_ranges_give_every_line_once(tmp_path, charset):
    """U+0A0A and U+0D0D look like line ends to a reader of single bytes."""
    rng = random.Random(charset)
    wide = ["ਊ", "਍"] if charset != "ISO-8859-1" else ["x"]
    for case in range(60):
        text = "".join(rng.choice(["a", "é", "\n", "\r\n", "bb", " ", "\r", *wide]) for _ in range(rng.randint(0, 60)))
        codec = {"UTF-16": "utf-16-le", "UTF-16BE": "utf-16-be"}.get(charset, charset)
        mark = {"UTF-16": b"\xff\xfe", "UTF-16BE": b"\xfe\xff", "UTF-8": rng.choice([b"", b"\xef\xbb\xbf"])}.get(charset, b"")
        data = mark + text.encode(codec)
        path = tmp_path / f"{case}.csv"
        path.write_bytes(data)
        want = [line.removesuffix("\r") for line in text.split("\n")]
        if not text.split("\n")[-1]:
            want.pop()
        first = next((i for i, line in enumerate(want) if line.strip(" \t\r")), None)
        for size in (2, 3, 7, 16, 1000):
            got = []
            for low in range(0, len(data), size):
                end = min(len(data), low + size)
                for batch in ranges.read_range(str(path), len(data), low, end, charset.removesuffix("BE"), False):
                    got += batch.to_pylist()
            assert [row["value"] for row in got] == want
            assert [i for i, row in enumerate(got) if row["_first"]] == ([] if first is None else [first])
            places = [(row["_block"], row["_row"]) for row in got]
            assert places == sorted(set(places))


@pytest.mark.parametrize("charset", ["UTF-8", "UTF-16"])
def test_ranges_give_every_record_once(tmp_path, charset):
    """Records of quoted line breaks belong to the range in which they begin, whatever its size."""
    rng = random.Random(charset)
    for case in range(60):
        pieces = ["a", ",", '"', '""', "\r\r\n", "\n", "\n", "\r\n", " ", ',"x', '"\n', "é"]
        text = rng.choice(["", "\n", "  \r\n"]) + "k,v\n" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        data = b"\xff\xfe" + text.encode("utf-16-le") if charset == "UTF-16" else text.encode()
        path = tmp_path / f"{case}.csv"
        path.write_bytes(data)
        lines = [line.removesuffix("\r") for line in text.split("\n")]
        if not lines[-1] and not text.split("\n")[-1]:
            lines.pop()
        want, inside = [], False
        for line in lines:
            want = [*want[:-1], want[-1] + "\n" + line] if inside else [*want, line]
            # Outside quotes a quote opens a field only where the field starts.
            rest = line if not inside else None
            if inside and (closed := re.match('(?:[^"]|"")*+"', line)):
                rest = "x" + line[closed.end() :]
            inside = decode.has_open_quote(rest, ",", '"', True) if rest is not None else True
        del want[next(i for i, record in enumerate(want) if record.strip(" \r"))]
        codes = ranges.quote_coder(",", '"', True)
        for size in (2, 3, 7, 16, 1000):
            parts = [{"file_path": str(path), "size": len(data), "charset": charset, "begin": low, "end": min(len(data), low + size)}
                     for low in range(0, len(data), size)]
            state, got, header = ranges.KEEPS, [], True
            for part in parts:
                code, first = ranges.range_effect(part, codes)
                row = {**part, "state": state & 1, "header": first if header else None}
                header = header and first is None
                got += [r for batch in ranges.read_records(row, codes) for r in batch.to_pylist()]
                state = ranges.combined(state, code)
            assert [row["text"] for row in got] == [record.removesuffix("\r") for record in want]
            places = [(row["_block"], row["_row"]) for row in got]
            assert places == sorted(set(places))


def test_records_with_line_breaks_are_not_shuffled(spark, tmp_path):
    """All text went through several shuffles, windows and joins, which failed on 1 GB."""
    from tabmeld.sources.scan import Dialect, scan_files

    path = tmp_path / "a.csv"
    path.write_text('k,v\n1,"two\nlines"\n2,x\n')
    files = spark.createDataFrame([(path.as_uri(), path.stat().st_size)], "file_path string, size bigint")
    rows = scan_files(files, 2, Dialect(multiline=True))
    assert sorted((r["c0"], r["c1"]) for r in rows.collect()) == [("1", "two\nlines"), ("2", "x")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any(node in plan for node in ("Window", "Join", "Aggregate"))


def test_lone_returns_end_lines():
    got = ranges._lines(b"a\rb\r\nc\r\r\nd\n\re", True).to_pylist()
    assert got == ["a", "b", "c", "", "d", "", "e"]
    assert ranges._lines(b"", True).to_pylist() == []


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_charset_is_read_by_many_tasks(spark, write, small_splits):
    data = [(i, f"né{i}", f'two\nlines, "{i}"' if i % 7 == 0 else "plain") for i in range(150)]
    text = "k,v,w\r\n" + "".join('{},{},"{}"\r\n'.format(k, v, w.replace('"', '""')) for k, v, w in data)
    write("u/a.csv", text.encode("utf-16"))
    root = write("u/b.csv", b"\xfe\xff" + "k,v,w\n1000,x,y\n".encode("utf-16-be"))
    run = consolidate(spark, root)
    assert sorted(tuple(r) for r in run.outputs["u"].collect()) == sorted([*data, (1000, "x", "y")])
    blocks = run.ordered["u"].select("__row_order._block").distinct().count()
    assert blocks > 15


def test_hidden_names_are_read(spark, write, small_splits):
    lines = "".join(f"{i},x{i}\n" for i in range(100))
    write("h/a.csv", "k,v\n" + lines)
    write("h/_b.csv", "k,v\n" + lines)
    root = write("h/.c d%.csv", "v,k\ny,7\n")
    run = consolidate(spark, root)
    assert run.outputs["h"].count() == 201 and run.outputs["h"].where("v = 'y'").first()["k"] == 7
    assert {s[:4] for s in run.status} == {("h", "merged", 3, 3)} and not run.warnings


def test_rejects_hold_the_raw_text(spark, write):
    """Of the widest header and others, of UTF-16, and of records with line breaks."""
    odd = ['1 , "x" ,zz', '"2",  y  , "z ""q"" "', "3,,"]
    write("r/a.csv", "a,b\n5,6\n" + "\n".join(odd) + "\n")
    write("r/b.csv", ("a,b\n7,8\n" + "\n".join(odd) + "\n").encode("utf-16"))
    write("r/c.csv", 'a,b\n9,"two\nlines"\n10,"l\nm" , n\n')
    root = write("r/d.csv", "a,b,c\n1,2,3\n4, 5 ,6,7\n")
    run = consolidate(spark, root)
    got = sorted((r["file_path"].rsplit("/", 1)[-1], r["n_fields"], r["record"]) for r in run.rejects.collect())
    want = [(name, 3, text) for name in ("a.csv", "b.csv") for text in odd]
    assert got == sorted([*want, ("c.csv", 3, '10,"l\nm" , n'), ("d.csv", 4, "4, 5 ,6,7")])


def shared_workbook(rows, prefix="", numbered=True) -> bytes:
    """A workbook whose texts are shared strings; ``rows`` maps row numbers to values, None for blank."""
    texts: dict[str, int] = {}
    lines = []
    for number, values in rows.items():
        cells = []
        for at, value in enumerate(values):
            place = f' r="{chr(65 + at)}{number}"' if numbered else ""
            if isinstance(value, str):
                cells.append(f'<{prefix}c{place} t="s"><{prefix}v>{texts.setdefault(value, len(texts))}</{prefix}v></{prefix}c>')
            elif value is not None or not numbered:
                cells.append(f"<{prefix}c{place}><{prefix}v>{'' if value is None else value}</{prefix}v></{prefix}c>")
        place = f' r="{number}"' if numbered else ""
        lines.append(f"<{prefix}row{place}>{''.join(cells)}</{prefix}row>" if cells else f"<{prefix}row{place}/>")
    plain = sheet_bytes(["x"], [])
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    name = f"xmlns:{prefix[:-1]}" if prefix else "xmlns"
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as source, zipfile.ZipFile(buffer, "w") as target:
        for member in source.namelist():
            if member != "xl/worksheets/sheet1.xml":
                target.writestr(member, source.read(member))
        body = "".join(lines)
        target.writestr("xl/worksheets/sheet1.xml", f'<{prefix}worksheet {name}="{space}"><{prefix}sheetData>{body}</{prefix}sheetData></{prefix}worksheet>')
        items = "".join(f"<si><t>{t}</t></si>" if "&" not in t else f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts)
        target.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}">{items}</sst>')
    return buffer.getvalue()


@pytest.mark.parametrize("part_bytes", [1, 200, 5000, 1 << 20])
def test_parts_of_workbooks_equal_whole_reading(spark, tmp_path, part_bytes):
    rng = random.Random(part_bytes)
    rows = {3: ["k", "v", "w"]}
    number = 3
    for i in range(300):
        number += rng.choice([1, 1, 1, 2, 4])
        rows[number] = rng.choice([[i, f"t{i % 11}", "same"], [i, None, "ab&amp;c"], [None] * 3, [], [i], [i, "x", "y", "more"]])
    books = {
        "shared.xlsx": shared_workbook(rows),
        "prefix.xlsx": shared_workbook(rows, prefix="x:"),
        "unnumbered.xlsx": shared_workbook({n: v for n, v in rows.items() if v}, numbered=False),
        "inline.xlsx": sheet_bytes(["k", "v"], [(i, f"s{i}" if i % 3 else None) for i in range(80)]),
        "header only.xlsx": sheet_bytes(["k", "v"], []),
    }
    held = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(books["inline.xlsx"])) as source, zipfile.ZipFile(held, "w") as target:
        for member in source.namelist():
            target.writestr(member, source.read(member).replace(b"<sheetData>", b"<sheetData><!-- <row -->"))
    books["comment.xlsx"] = held.getvalue()
    for name, data in books.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / name), 3) for name in books], "file_path string, width int")
    got = sorted((r["_file"], r["_row"], r["cells"], r["dated"]) for r in workbook_parts.scan_large_workbooks(files, part_bytes).collect())
    want = sorted((uri, *row) for name in books for uri in [str(tmp_path / name)] for row in workbook_rows(uri, 3))
    assert got == want and len(got) > 1000


def _peak(work) -> int:
    """Most bytes of Python and numpy objects held while ``work`` runs."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_range_is_held_a_few_times_only():
    """An index of eight bytes for every byte of a range filled the workers."""
    data = b"".join(b"%d,%s\r\n" % (i, b"N" * 60) for i in range(50_000))
    assert _peak(lambda: ranges._lines(data, True)) < 8 * len(data)
    assert ranges.RANGE_BYTES <= 4 << 20


def test_a_file_that_gives_no_table_is_not_read_whole(tmp_path, monkeypatch):
    """One column in a charset other than UTF-8: no longer head can change the verdict."""
    from tabmeld.sources import decode

    monkeypatch.setattr(decode, "HEAD_BYTES", 1 << 12)
    path = tmp_path / "words.csv"
    path.write_bytes("tête\n".encode("latin-1") * 200_000)
    size = path.stat().st_size
    found = []
    assert _peak(lambda: found.append(decode.probe_csv_file(str(path), size))) < size
    assert found == [{"status": "failed", "error": decode.NO_TABLE}]
    # A UTF-8 letter cut by the end of a head without a line end is no proof of another charset.
    path.write_bytes(("x" + "é" * 4000 + ",b\n1,2\n").encode())
    assert decode.probe_csv_file(str(path), path.stat().st_size)["header"] == ["x" + "é" * 4000, "b"]


def test_a_workbook_is_written_row_by_row(tmp_path):
    from workload.exports import write_sheet

    rows = ((i, f"text {i % 5}", None) for i in range(60_000))
    path = tmp_path / "a.xlsx"
    with open(path, "wb") as out:
        assert _peak(lambda: write_sheet(out, ["k", "v", "n"], rows, True)) < 2 << 20
    got = [cells for _, cells, _ in workbook_rows(str(path), 3)]
    assert got == [[str(i), f"text {i % 5}", None] for i in range(60_000)]


def test_parts_are_read_from_small_files(spark, tmp_path, monkeypatch):
    """A reader decodes thousands of rows of a Parquet file at once, and each is a part."""
    from tabmeld.session import _WRITTEN

    monkeypatch.setattr(workbook_parts, "_BLOCK", 1000)
    path = tmp_path / "a.xlsx"
    path.write_bytes(sheet_bytes(["k", "v"], [(i, f"s{i}") for i in range(2000)], True))
    files = spark.createDataFrame([(path.as_uri(), path.stat().st_size, 2)], "file_path string, size bigint, width int")
    rows = workbook_parts.scan_large_workbooks(files, 1000)
    assert rows.count() == 2000
    written = next(p for p in reversed(_WRITTEN) if "workbook_parts" in p)
    parts = spark.read.parquet(written)
    assert parts.count() > 5 * workbook_parts.PARTS_PER_FILE
    per_file = parts.groupBy("_metadata.file_path").count()
    assert per_file.agg({"count": "max"}).first()[0] <= workbook_parts.PARTS_PER_FILE


def test_parts_are_written_closely(spark, tmp_path):
    """Inflated sheets took nearly twice the space of their workbooks."""
    import pyarrow.parquet as pq

    from tabmeld.session import _WRITTEN

    path = tmp_path / "a.xlsx"
    path.write_bytes(sheet_bytes(["k", "v"], [(i, f"s{i}") for i in range(2000)], True))
    files = spark.createDataFrame([(path.as_uri(), path.stat().st_size, 2)], "file_path string, size bigint, width int")
    workbook_parts.scan_large_workbooks(files, 1000)
    written = next(p for p in reversed(_WRITTEN) if "workbook_parts" in p)
    name = spark.read.parquet(written).select("_metadata.file_path").first()[0].removeprefix("file:")
    assert pq.ParquetFile(name).metadata.row_group(0).column(0).compression == "ZSTD"
