"""Raw files in, merged datasets out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabmeld.plans.consolidate import consolidate
from tabmeld.plans.options import MergeOptions
from tabmeld.plans.report import metric_table, output_shapes, run_summary
from tabmeld.plans.sink import stacked, write_outputs
from tabmeld.sources import decode
from tabmeld.sources.catalog import list_files
from workload.exports import sheet_bytes


def rows(df, *order):
    return [tuple(row) for row in df.orderBy(*order).collect()]


@pytest.mark.parametrize("together", [False, True])
def test_many_datasets_in_one_run(spark, write, tmp_path, together):
    base = "Advertiser,Seller Domain,Impressions,Clicks,Media Cost (Adv Currency)\n"
    for n in (1, 2, 3):
        write(f"plain/f{n}.csv", base + f"a,d{n},{n},{n},1.5\nb,d{n},1,NA,2\n")
    write("missing/a.csv", "Advertiser,Clicks\nx,1\n")
    write("missing/b.csv", "Advertiser,Device,More\ny,pc,2\n")
    write("plural/a.csv", "Brand,n\nx,1\n")
    write("plural/b.csv", "Brands,n\ny,2\n")
    write("plural/c.csv", "Brand,n\nz,3\n")
    write("conflict/a.csv", "Brand,Brands\n,x\ny,\n")
    write("conflict/b.csv", "Brand,n\nz,1\n")
    write("types/a.csv", "i,b,m\n007,True,1\n")
    write("types/b.csv", "i,b,m\n2.5,False,abc\n")
    write("types/c.csv", "i,b,m\n3,,\n")
    write("single/a.csv", "a,b\n1,2\n")
    write("lock/~$a.xlsx", "x")
    write("lock/notes.txt", "x")
    write("lock/lock_merged.csv", "a,b\n9,9\n")
    write("lock/a.csv", "a,b\n1,2\n")
    write("lock/b.csv", "a,b\n3,4\n")
    write("dup/a.csv", "id,ID,v\n1,,x\n,2,y\n")
    write("dup/b.csv", "ID,v\n3,z\n")
    write("legacy/a.xls", b"\xd0\xcf\x11\xe0")
    write("legacy/b.csv", "a,b\n1,2\n")
    write("bad/a.csv", b"caf\xe9\n1\n")
    root = write("bad/b.xlsx", b"not a zip")
    run = consolidate(spark, root, {"together": together})
    status = {name: state for name, state, *_ in run.status}
    assert status == {
        "plain": "merged", "missing": "merged", "plural": "merged", "conflict": "failed", "types": "merged",
        "single": "skipped_single_file", "lock": "merged", "dup": "merged", "legacy": "merged", "bad": "failed",
    }
    out = run.outputs
    assert out["plain"].count() == 6
    assert dict(out["plain"].dtypes)["Clicks"] == "bigint"
    assert out["missing"].columns == ["Advertiser", "Device", "More", "Clicks"]
    assert rows(out["missing"], "Advertiser") == [("x", None, None, 1), ("y", "pc", 2, None)]
    assert rows(out["plural"], "Brand") == [("x", 1), ("y", 2), ("z", 3)]
    assert [tuple(r) for r in run.renames.collect()] == [("plural", "Brands", "Brand")]
    assert any("Same-file column conflict in a.csv (both 'Brand' and 'Brands')" in e for e in run.errors)
    assert dict(out["types"].dtypes) == {"i": "double", "b": "boolean", "m": "string"}
    assert rows(out["types"], "i") == [(2.5, False, "abc"), (3.0, None, None), (7.0, True, "1")]
    assert rows(out["lock"], "a") == [(1, 2), (3, 4)]
    assert rows(out["dup"], "ID") == [(1, "x"), (2, "y"), (3, "z")]
    extras = {(r["column_name"], r["file_path"].rsplit("/", 1)[-1]) for r in run.extra_columns.where("dataset = 'missing'").collect()}
    assert extras == {("Clicks", "a.csv")}
    assert any("legacy binary workbook" in text for _, text in run.warnings)

    summary = run_summary(spark, run).first()
    assert (summary["processed_datasets"], summary["total_datasets"], summary["skipped_single_file"]) == (8, 10, 1)
    assert summary["total_files_merged"] == 3 + 2 + 3 + 3 + 2 + 2 + 1
    assert metric_table(run_summary(spark, run)).count() == 6
    written = write_outputs(run, str(tmp_path / "out"))
    shapes = {r["dataset"]: r["n_rows"] for r in output_shapes(spark, run, written).collect()}
    assert shapes["plain"] == 6 and shapes["single"] is None
    assert stacked(spark, run).count() == sum(n for n in shapes.values() if n)
    again = write_outputs(run, str(tmp_path / "out"))
    assert again == {} and any("Error saving" in e for e in run.errors)


@pytest.mark.parametrize("together", [False, True])
def test_dialects_and_bad_records(spark, write, together):
    write("d/a.csv", "a,b,t\n1,2,x\n3,4,y,z\n5\n\n6,7,\n8,9,,\n")
    write("d/b.csv", "a;b;t\n10;11;é\n".encode("latin-1"))
    write("d/c.csv", "a\tb\tt\n\t12\t \"q \"\"w\"\"\"\n".encode("utf-8-sig"))
    root = write("d/e [x].csv", "a|b|t\n13|14|\"li\nne\"\n".encode("utf-16"))
    run = consolidate(spark, root, {"sort_by": ["b"], "sort_ascending": True, "together": together})
    assert [tuple(r) for r in run.outputs["d"].collect()] == [
        (1, 2, "x"), (6, 7, None), (10, 11, "é"), (None, 12, 'q "w"'), (13, 14, "li\nne"), (5, None, None)
    ]
    rejects = rows(run.rejects.select("n_fields", "record"), "record")
    assert rejects == [(4, "3,4,y,z"), (4, "8,9,,")]
    assert run.rejects.count() == 2


def test_long_files_are_split_and_verified(spark, write, monkeypatch):
    """Late surprises: bytes that are not UTF-8, and a quoted line break, past the probed head."""
    monkeypatch.setattr(decode, "HEAD_BYTES", 64)
    lines = "".join(f"{i},n{i}\n" for i in range(2000))
    write("late/a.csv", "k,é\n".encode() + lines.encode() + b"9999,caf\xe9\n")
    write("late/b.csv", "k,v\n" + lines + '8888,"two\nlines"\n')
    root = write("late/c.csv", "k,v\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        run = consolidate(spark, root)
        out = run.outputs["late"]
        assert out.count() == 6002
        assert out.where("k = 9999").first()[1] == "café"
        assert out.where("k = 8888").first()["v"] == "two\nlines"
        found = {r["file_name"]: (r["charset"], r["multiline"]) for r in run.files.collect()}
        assert found == {"a.csv": ("ISO-8859-1", False), "b.csv": ("UTF-8", True), "c.csv": ("UTF-8", False)}
        options = {"group_by": ["g"], "max_rows_before_aggregate": 1, "aggregate_columns": {"k": "first", "v": "last"}}
        data = "g,k,v\n" + "".join(f"x,{'' if i < 5 else i},{i if i < 1990 else ''}\n" for i in range(2000))
        root = write("../order/x/a.csv", data).replace("/root", "/order")
        write("../order/x/b.csv", "g,k,v\nx,-1,-1\n")
        got = consolidate(spark, root, options).outputs["x"].first()
        assert (got["k"], got["v"]) == (5, -1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_head_is_cut_at_a_record_end():
    text = 'a,b\n1,"x\ny"\n2,"open\nstill'
    assert decode.whole_records(text) == 'a,b\n1,"x\ny"\n'
    found = decode.probe_csv(text.encode(), complete=False)
    assert found["header"] == ["a", "b"] and found["sep"] == ","


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        (b"a;b\n1;2\n", ("UTF-8", ";", '"', ["a", "b"])),
        (b"only\n1\n", ("UTF-8", ",", '"', ["only"])),
        (b"a,b\n", ("UTF-8", ",", '"', ["a", "b"])),
        (b"a,,a\n1,2,3\n", ("UTF-8", ",", '"', ["a", "Unnamed: 1", "a.1"])),
        (b'a,b\n"x,y\n1,2\n', ("UTF-8", ",", "'", ["a", "b"])),
    ],
)
def test_probe_choices(data, expected):
    found = decode.probe_csv(data, complete=True)
    assert (found["charset"], found["sep"], found["quote"], found["header"]) == expected


def test_probe_failures():
    assert decode.probe_csv(b"", complete=True)["status"] == "failed"
    assert decode.probe_csv(b"caf\xe9\n1\n", complete=True)["status"] == "failed"


def test_workbooks(spark, write):
    from datetime import datetime

    header = ["id", None, "When", "Text", "id"]
    data = [(1, 2.5, datetime(2024, 1, 2, 3, 4, 5), "x & <y>", True), (None,) * 5, (3, 7, None, "NA", False), (4,)]
    write("books/a.xlsx", sheet_bytes(header, data))
    root = write("books/b.xlsx", sheet_bytes(["ID", "When"], [(5, datetime(2020, 2, 29))]))
    out = consolidate(spark, root).outputs["books"]
    assert out.columns == ["ID", "Unnamed: 1", "When", "Text", "id.1"]
    assert dict(out.dtypes)["When"] == "timestamp"
    assert rows(out, "ID") == [
        (None, None, None, None, None),
        (1, 2.5, datetime(2024, 1, 2, 3, 4, 5), "x & <y>", True),
        (3, 7.0, None, None, False),
        (4, None, None, None, None),
        (5, None, datetime(2020, 2, 29), None, None),
    ]


def test_row_gate_sort_and_overrides(spark, write):
    text = "g,v,w\n" + "".join(f"{'ab'[i % 2]},{i},{i}\n" for i in range(10))
    for name in ("tall", "equal", "own"):
        write(f"{name}/1.csv", text)
        write(f"{name}/2.csv", "g,v,w\n,100,1\n" if name == "tall" else "g,v,w\na,0,0\n")
    root = write("own/3.csv", "g,v,w\na,0,0\n")
    options = {
        "group_by": "g", "max_rows_before_aggregate": 10, "aggregate_columns": {"v": "SUM"}, "sort_by": "v",
        "subdirectories": {"equal": {"max_rows_before_aggregate": 11}, "own": {"aggregate_columns": {"v": "count"}, "sort_ascending": True}},
    }
    run = consolidate(spark, root, options)
    assert [tuple(r) for r in run.outputs["tall"].collect()] == [("b", 25), ("a", 20)]
    assert run.outputs["equal"].count() == 11 and run.outputs["equal"].columns == ["g", "v", "w"]
    assert [tuple(r) for r in run.outputs["own"].collect()] == [("b", 5), ("a", 7)]


def test_arithmetic_on_text_fails_only_its_dataset(spark, write):
    for name, cell in (("good", "1"), ("text", "x")):
        write(f"{name}/1.csv", f"g,v\na,{cell}\n")
        root = write(f"{name}/2.csv", f"g,v\na,{cell}\n")
    run = consolidate(spark, root, {"group_by": ["g"], "max_rows_before_aggregate": 1, "aggregate_columns": {"v": "sum"}})
    assert {s[0]: s[1] for s in run.status} == {"good": "merged", "text": "failed"}
    assert run.outputs["good"].first()["v"] == 2


def test_conflict_policy_merges_columns(spark, write):
    write("c/a.csv", "Brand,Brands,n\n,x,1\ny,w,2\n")
    root = write("c/b.csv", "Brand,n\nz,3\n")
    for policy in ("keep_first", {"Brand": "Brand"}):
        out = consolidate(spark, root, {"conflict_policy": policy}).outputs["c"]
        assert rows(out, "n") == [("x", 1), ("y", 2), ("z", 3)]
    second = consolidate(spark, root, {"conflict_policy": "keep_second"}).outputs["c"]
    assert sorted(second.columns) == ["Brand", "n"] or sorted(second.columns) == ["Brands", "n"]
    assert second.count() == 3


def test_preflight(spark, write):
    write("a/1.csv", "k,v\n1,2\n")
    write("a/2.csv", "k\n1\n")
    root = write("b/1.csv", "k,v\n1,2\n")
    run = consolidate(spark, root, {"sort_by": ["v"]})
    assert not run.success and run.outputs == {} and len(run.errors) == 1
    assert "1 file(s) lack required columns, first '2.csv': ['v']" in run.errors[0]
    assert [tuple(r) for r in run.findings(spark).collect()] == [("a", "2.csv", "error", "missing required columns: v")]
    report = consolidate(spark, root, {"sort_by": ["v"], "preflight": "report"})
    assert report.success and report.outputs["a"].count() == 2


def test_every_lacking_file_counts(spark, write):
    for n in range(30):
        root = write(f"a/{n}.csv", "k\n1\n")
    run = consolidate(spark, root, {"sort_by": ["v"]})
    assert len(run.errors) == 1 and run.n_errors == 30 and run.findings(spark).count() == 30
    assert run_summary(spark, run).first()["errors"] == 30


def test_unknown_option_values_are_refused():
    for key in ("conflict_policy", "on_duplicate", "preflight", "null_keys", "median"):
        with pytest.raises(ValueError, match=key):
            MergeOptions.from_dict({key: "keep_frist"})
    with pytest.raises(ValueError, match="subdirectories.d.conflict_policy"):
        MergeOptions.from_dict({"subdirectories": {"d": {"conflict_policy": "no"}}})


def test_untrimmed_variants_are_settled(spark, write):
    write("c/a.csv", "Brand ,Brands,n\n,x,1\ny,w,2\n")
    root = write("c/b.csv", "Brand,n\nz,3\n")
    out = consolidate(spark, root, {"clean_columns": False, "conflict_policy": "keep_first"}).outputs["c"]
    assert sorted(out.columns) == ["Brand", "n"] and rows(out, "n") == [("x", 1), ("y", 2), ("z", 3)]


def test_one_bad_policy_refuses_its_dataset_only(spark, write):
    for name in ("good", "bad"):
        write(f"{name}/a.csv", "Brand,Brands,n\n,x,1\n")
        root = write(f"{name}/b.csv", "Brand,n\nz,3\n")
    run = consolidate(spark, root, {"conflict_policy": {"Other": "Other"}, "subdirectories": {"good": {"conflict_policy": "keep_first"}}})
    assert {s[0]: s[1] for s in run.status} == {"bad": "failed", "good": "merged"}
    assert any("no kept name given" in e for e in run.errors)


@pytest.mark.parametrize("head", [64, 1 << 20])
def test_quotes_decide_alike_at_any_size(spark, write, monkeypatch, head):
    """The same files, probed by their head or whole."""
    monkeypatch.setattr(decode, "HEAD_BYTES", head)
    body = "".join(f"{i},n{i}\n" for i in range(300))
    for name in "ab":
        write(f"open/{name}.csv", "k,v\n" + body + '-1,"open\n-2,z\n')
        write(f"closed/{name}.csv", "k,v\n" + body + '-1,"two\nlines, ""x"""\n-2,5"z\n')
        root = write(f"lost/{name}.csv", "k,v\n" + body + "-1,\"open\n-2,'z\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        run = consolidate(spark, root)
        found = {r["dataset"]: (r["quote"], r["multiline"]) for r in run.files.where("status = 'ok'").collect()}
        assert found == {"open": ("'", False), "closed": ('"', True)}
        tail = lambda name: sorted(tuple(r) for r in run.outputs[name].where("k < 0").collect())
        assert tail("open") == [(-2, "z")] * 2 + [(-1, '"open')] * 2
        assert tail("closed") == [(-2, '5"z')] * 2 + [(-1, 'two\nlines, "x"')] * 2
        assert run.outputs["closed"].count() == run.outputs["open"].count() == 604
        assert {s[0]: s[1] for s in run.status}["lost"] == "failed"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_breaks_are_read_in_splits(spark, write):
    """Records cross splits of a few bytes; more scan tasks than files."""
    import random

    rng = random.Random(4)
    cells = ["plain", "a,b", 'q"uo"te', "two\nlines", "\n\n", '"', "x\n\"y\"\n", "é"]
    data = [(i, rng.choice(cells), rng.choice(cells)) for i in range(200)]
    quote = lambda t: '"' + t.replace('"', '""') + '"' if set(t) & set('",\n') else t
    text = "k,v,w\n" + "".join(f"{k},{quote(v)},{quote(w)}\n" for k, v, w in data)
    write("s/a.csv", text)
    root = write("s/b.csv", ("k,v,w\n1000,x,\"l\n1\"\n1001,ü,\n").encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        out = consolidate(spark, root).outputs["s"]
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted([*data, (1000, "x", "l\n1"), (1001, "ü", None)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stray_quotes_hide_no_fields(spark, write):
    write("q/a.csv", 'a,b,c\n1,5"x,6"y,extra\n2,5"x,6\n3,"p, ""q""" ,7\n')
    root = write("q/b.csv", "a,b,c\n4,x,8\n")
    run = consolidate(spark, root)
    assert rows(run.outputs["q"], "a") == [(2, '5"x', 6), (3, 'p, "q"', 7), (4, "x", 8)]
    assert [(r["n_fields"], r["record"]) for r in run.rejects.collect()] == [(4, '1,5"x,6"y,extra')]


def test_hidden_files_are_read_and_empty_ones_reported(spark, write):
    write("d/a.csv", "a,b\n1,2\n")
    write("d/_b.csv", "a,b\n3,4\n")
    root = write("d/c.csv", "")
    run = consolidate(spark, root)
    assert [s[:4] for s in run.status] == [("d", "merged", 3, 2)] and run.outputs["d"].count() == 2
    assert {r["file_name"] for r in run.findings(spark).collect()} == {"c.csv"}


def test_csv_output_reads_back(spark, tmp_path):
    import pandas as pd

    from tabmeld.plans.consolidate import Consolidation
    from tabmeld.plans.sink import read_output

    data = [(1, 'say "hi", ok'), (2, " blanks "), (3, "two\nlines"), (4, ""), (5, None), (6, "\\"), (7, '\\"')]
    table = spark.createDataFrame(data, "k int, v string")
    run = Consolidation(success=True, outputs={"t": table}, status=[("t", "merged", 2, 2, 7, None)])
    path = write_outputs(run, str(tmp_path / "csv"), fmt="csv", single_file=True)["t"]
    assert rows(read_output(spark, path, "csv", table.schema), "k") == data
    frame = pd.concat(pd.read_csv(f, keep_default_na=False) for f in (tmp_path / "csv" / "t_merged").glob("part-*"))
    assert frame.sort_values("k")["v"].tolist() == [v or "" for _, v in data]
    assert output_shapes(spark, run, {"t": path}, "csv").first()["n_rows"] == 7
    assert write_outputs(run, str(tmp_path / "csv"), fmt="csv") == {}
    assert run.status[0][1] == "failed" and run_summary(spark, run).first()["total_files_merged"] == 0


def test_unusable_roots(spark, write, tmp_path):
    assert "does not exist" in consolidate(spark, str(tmp_path / "nowhere")).errors[0]
    root = write("alone.csv", "a,b\n1,2\n")
    assert "No dataset folder" in consolidate(spark, root).errors[0]
    assert "not a directory" in consolidate(spark, root + "/alone.csv").errors[0]


def test_listing_reports_what_it_leaves_out(spark, write):
    write("d/a.csv", "a\n1\n")
    write("d/deep/b.csv", "a\n1\n")
    root = write("d/A.CSV", "a\n1\n")
    found = {r["file_name"]: (r["status"], r["file_format"]) for r in list_files(spark, root).collect()}
    assert found == {"a.csv": ("supported", "csv"), "b.csv": ("nested", "csv"), "A.CSV": ("ignored", "csv")}


def test_staged_run_gives_the_same_rows(spark, write):
    write("s/a.csv", "a,b\n1,x\n2,y\n")
    root = write("s/b.csv", "a,c\n3,z\n")
    plain = consolidate(spark, root).outputs["s"]
    staged = consolidate(spark, root, {"stage": True}).outputs["s"]
    assert plain.schema == staged.schema and rows(plain, "a") == rows(staged, "a")


def test_options_coercions():
    options = MergeOptions.from_dict(
        {"columns": [" a ", ""], "group_by": "g", "max_rows_before_aggregate": "0", "large_file_threshold_mb": "-1",
         "subdir_include": "x", "aggregate_columns": {"v": "MAX"}, "sort_by": None, "column_canonical_patterns": [{"base": "b"}],
         "subdirectories": {"d": {"columns": [], "group_by": None}, "e": "junk"}}
    )
    assert options.base.columns == ("a",) and options.base.group_by == ("g",)
    assert options.base.max_rows_before_aggregate is None and options.large_file_threshold_mb is None
    assert options.subdir_include == ("x",) and options.base.aggregate_columns == {"v": "max"}
    assert options.rules.patterns == () and set(options.subdirectories) == {"d"}
    assert options.for_dataset("d").columns == ("a",) and options.for_dataset("d").group_by == ()
    assert options.for_dataset("z").required() == ["a", "g", "v"]


def test_keys_only_table_keeps_missing_keys(spark, write):
    write("k/1.csv", "g,h\na,1\n,1\n")
    root = write("k/2.csv", "g,h\na,1\n")
    out = consolidate(spark, root, {"group_by": ["g", "h"], "max_rows_before_aggregate": 1}).outputs["k"]
    assert rows(out, "g") == [(None, 1), ("a", 1)]


def test_name_change_log_and_scratch(spark, write):
    from tabmeld.session import clear_scratch

    write("n/1.csv", " id ,b\n1,2\n")
    root = write("n/2.csv", "ID,b\n1,2\n")
    run = consolidate(spark, root)
    assert [r["change"] for r in run.name_changes.collect()] == ["'id ' → 'ID'"]
    assert run.outputs["n"].count() == 2
    assert clear_scratch(spark) > 0 and clear_scratch(spark) == 0


def test_headers_of_one_dialect_share_a_scan(spark, write):
    """Differing headers, widths and folds: one scan, per-file places, per-file record checks."""
    write("d/a.csv", "ID,Flag,x\n1,f,7\n2,g,8\n")
    write("d/b.csv", "x,ID\n9,3\n9,4,5\n9,4,5,6\n\"1,1\",5\n")
    write("d/c.csv", "Flag,id,ID\n,,6\nh,7,8,z\nh,7,8\n")
    write("d/e.csv", "x,Flags,Flag,ID\n1,p,,9\n2,,q,10\n3\n")
    root = write("d/f.csv", "Flag;ID\nk;11\n")
    run = consolidate(spark, root, {"conflict_policy": "keep_second"})
    out = run.outputs["d"]
    assert rows(out.select("ID", "Flag", "x"), "ID", "x") == [
        (None, None, "3"), (1, "f", "7"), (2, "g", "8"), (3, None, "9"), (5, None, "1,1"), (6, None, None),
        (7, "h", None), (9, "p", "1"), (10, "q", "2"), (11, "k", None),
    ]
    found = run.rejects.select(F.element_at(F.split("file_path", "/"), -1), "n_fields", "n_columns", "cells", "record")
    assert sorted(tuple(row) for row in found.collect()) == [
        ("b.csv", 3, 2, ["9", "4"], "9,4,5"), ("b.csv", 4, 2, ["9", "4"], "9,4,5,6"),
        ("c.csv", 4, 3, ["h", "7", "8"], "h,7,8,z"),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(" csv") == 2


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_many_files_are_joined_with_their_places(spark, write, monkeypatch, limit):
    monkeypatch.setattr("tabmeld.plans.consolidate.BROADCAST_BYTES", limit)
    for n in range(12):
        root = write(f"d/f{n:02d}.csv", f"a,b\n{n},x\n" if n % 2 else f"b,c,a\ny,1,{n}\n")
    out = consolidate(spark, root).outputs["d"]
    assert rows(out.select("a", "b", "c"), "a") == [(n, "x", None) if n % 2 else (n, "y", 1) for n in range(12)]


def test_shapes_and_previews(spark, write, tmp_path):
    from tabmeld.plans.consolidate import Consolidation
    from tabmeld.plans.report import output_previews, output_shapes
    from tabmeld.plans.sink import write_outputs

    nothing = Consolidation(success=False)
    assert output_shapes(spark, nothing, {}).count() == output_previews(spark, nothing, {}).count() == 0
    for i in range(5):
        write(f"d{i}/a.csv", "k,v\n" + "".join(f"{j},x {j}\n" for j in range(40)))
        root = write(f"d{i}/b [1].csv", "v,k,w\ny,-1,\"q, r\"\n")
    root = write("lone/a.csv", "k,v\n1,2\n")
    run = consolidate(spark, root, {"sort_by": ["k"], "sort_ascending": True})
    for fmt in ("parquet", "csv"):
        written = write_outputs(run, f"{tmp_path}/out {fmt}", fmt=fmt)
        shapes = {r["dataset"]: (r["written"], r["n_rows"], r["columns"]) for r in output_shapes(spark, run, written, fmt).collect()}
        assert shapes == {**{f"d{i}": (True, 41, ["v", "k", "w"]) for i in range(5)}, "lone": (False, None, None)} or fmt == "csv"
        rows = output_previews(spark, run, written, fmt).collect()
        assert [(r["dataset"], r["row"]) for r in rows] == [(f"d{i}", n) for i in range(5) for n in (1, 2, 3)]
        import json

        first = json.loads(rows[0]["record"])
        assert {c: str(v) for c, v in first.items()} == {"k": "-1", "v": "y", "w": "q, r"}
        assert [str(json.loads(r["record"])["k"]) for r in rows[:3]] == ["-1", "0", "1"]


def test_number_of_jobs_does_not_grow_with_datasets(spark, write):
    """Aggregates, orders, rejects and types of many datasets, from as many jobs as of a few."""
    options = {"group_by": ["g"], "max_rows_before_aggregate": 1, "aggregate_columns": {"k": "first", "v": "last"}, "sort_by": ["g"],
               "sort_ascending": True, "preflight": "report", "together": True}
    jobs = {}
    for n in (3, 12):
        for i in range(n):
            write(f"../many{n}/d{i}/b.csv", f"g;k;v\nx;{i};a\ny;7;\nx;9;z\n")
            write(f"../many{n}/d{i}/c.csv", f"v,g,k\nlast,x,1\n,y,{i}.5\na,b,c,d\n")
            root = write(f"../many{n}/d{i}/a.csv", "g,K,more\nx,,1\n").replace("/root", f"/many{n}")
        spark.sparkContext.setJobGroup(f"many{n}", "")
        run = consolidate(spark, root, options)
        spark.sparkContext.setJobGroup("other", "")
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many{n}"))
        for i in (0, n - 1):
            assert [tuple(r) for r in run.outputs[f"d{i}"].select("g", "k", "v").collect()] == [("x", float(i), "last"), ("y", 7.0, None)]
        assert run.rejects.count() == n and run.rejects.select("record").distinct().first()[0] == "a,b,c,d"
        apart = consolidate(spark, root, {**options, "together": False})
        assert {s[:5] for s in run.status} == {s[:5] for s in apart.status}
        last = f"d{n - 1}"
        assert run.outputs[last].schema == apart.outputs[last].schema and run.outputs[last].collect() == apart.outputs[last].collect()
    assert jobs[12] <= jobs[3] + 2
