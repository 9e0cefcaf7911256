"""Union, typing, aggregation, order and layout operators on small frames."""

from __future__ import annotations

import random
import statistics

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.operators import aggregate, layout
from tabmeld.operators.aggregate import SKETCH_ERROR, aggregate_by, median_sketches, merge_sketches, sketch_medians
from tabmeld.operators.order import rank_rows, sort_rows
from tabmeld.operators.spread import hot_join, hot_keys, salted_left_join
from tabmeld.operators.typing import reconcile_text
from tabmeld.operators.union import common_type, reindex, union_by_name


def test_union_of_nothing_and_one(spark):
    assert union_by_name(spark, []).columns == []
    one = spark.range(3)
    assert union_by_name(spark, [one]) is one


def test_union_column_order_and_row_count(spark):
    parts = [spark.range(2).selectExpr("id AS b", "id AS a"), spark.range(3).selectExpr("id AS c", "id AS a")] * 3
    out = union_by_name(spark, parts)
    assert out.columns == ["b", "a", "c"]
    assert out.count() == 15


def test_union_never_coerces_implicitly(spark):
    flags = spark.createDataFrame([(True,)], "x boolean")
    numbers = spark.createDataFrame([(7,)], "x int")
    out = union_by_name(spark, [flags, numbers])
    assert sorted(row["x"] for row in out.collect()) == ["7", "true"]


def test_common_type():
    assert common_type([T.IntegerType(), T.LongType()]) == T.LongType()
    assert common_type([T.IntegerType(), T.DoubleType()]) == T.DoubleType()
    assert common_type([T.LongType(), T.StringType()]) == T.StringType()
    assert common_type([T.NullType()]) == T.DoubleType()


@pytest.mark.parametrize(
    ("cells", "kind", "values"),
    [
        (["1", "007", " 5 ", None], "bigint", [1, 7, 5, None]),
        (["1", "2.5", "1e3", "-.5", "inf"], "double", [1.0, 2.5, 1000.0, -0.5, float("inf")]),
        (["True", "FALSE"], "boolean", [True, False]),
        (["True", "1"], "string", ["True", "1"]),
        (["1d", "2"], "string", ["1d", "2"]),
        (["0x1p3"], "string", ["0x1p3"]),
        (["99999999999999999999"], "double", [1e20]),
        (["1,234"], "string", ["1,234"]),
        (["2024-01-01"], "string", ["2024-01-01"]),
        ([None, None], "double", [None, None]),
    ],
)
def test_text_reads_as_narrowest_type(spark, cells, kind, values):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, x string").coalesce(1)
    out = reconcile_text(df, ["x"])
    assert dict(out.dtypes)["x"] == kind
    assert [row["x"] for row in out.orderBy("i").collect()] == values


def test_reindex_handles_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b (c)` int, `x``y` int")
    assert reindex(df, ["x`y", "nope", "a.b (c)"]).columns == ["x`y", "nope", "a.b (c)"]


SAMPLE = [("a", 1, 1.0, "x", True), ("a", 2, None, None, False), ("a", 3, 4.0, "z", True), (None, 4, 9.0, "n", True), ("b", 5, None, None, None)]
SAMPLE_SCHEMA = "k string, n int, v double, s string, f boolean"


def sample(spark):
    return spark.createDataFrame(SAMPLE, SAMPLE_SCHEMA)


def test_aggregate_functions(spark):
    df = sample(spark)
    results = {}
    for function in aggregate.AGGREGATES:
        out = aggregate.aggregate_by(df.select("k", "n", "v"), ["k"], {"v": function}, skip=["n"], order=F.col("n"))
        results[function] = {row["k"]: row["v"] for row in out.collect()}
    assert results["sum"] == {"a": 5.0, "b": 0.0}
    assert results["count"] == {"a": 2, "b": 0}
    assert results["mean"] == {"a": 2.5, "b": None}
    assert results["first"] == {"a": 1.0, "b": None}
    assert results["last"] == {"a": 4.0, "b": None}
    assert results["median"] == {"a": 2.5, "b": None}
    assert results["std"]["a"] == pytest.approx(statistics.stdev([1.0, 4.0]))
    assert results["std"]["b"] is None


def test_booleans_count_as_numbers(spark):
    out = aggregate.aggregate_by(sample(spark).select("k", "f"), ["k"])
    assert {row["k"]: row["f"] for row in out.collect()} == {"a": 2, "b": 0}


def test_arithmetic_on_text_is_refused_before_running(spark):
    with pytest.raises(aggregate.AggregateError, match="needs numbers"):
        aggregate.aggregate_by(sample(spark).select("k", "s"), ["k"], {"s": "mean"})


def test_no_value_columns_gives_distinct_keys_with_null(spark):
    out = aggregate.aggregate_by(sample(spark).select("k"), ["k"])
    assert sorted(str(row["k"]) for row in out.collect()) == ["None", "a", "b"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "k string, v double")
    row = aggregate.aggregate_by(df, ["k"], {"v": "sum"}).first()
    assert row["v"] == 2.0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_aggregation_does_not_depend_on_partitions(spark, parts):
    rows = [(random.Random(i).choice("abc"), i, float(i * 37 % 101), f"t{i * 7 % 13}") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v double, s string").repartition(parts)
    chosen = {"v": "median", "s": "first"}
    out = aggregate.aggregate_by(df, ["k"], chosen, order=F.col("i"), skip=["i"])
    expected = {}
    for key in "abc":
        mine = [r for r in rows if r[0] == key]
        expected[key] = (statistics.median(r[2] for r in mine), mine[0][3])
    assert {row["k"]: (row["v"], row["s"]) for row in out.collect()} == expected


@pytest.mark.parametrize("null_keys", ["drop", "keep"])
def test_ranked_median_equals_builtin(spark, null_keys):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3, 3, 3, 10])) for _ in range(400)]
    df = spark.createDataFrame(rows + [("only nulls", None)], "k string, v int").repartition(7)
    got = [
        {tuple(row) for row in aggregate.aggregate_by(df, ["k"], {"v": "median"}, median=way, null_keys=null_keys).collect()}
        for way in ("ranked", "builtin")
    ]
    assert got[0] == got[1]
    assert len(got[0]) == (3 if null_keys == "drop" else 4)


@pytest.mark.parametrize("case", ["distinct", "ties", "skewed", "few"])
def test_bracketed_median_of_large_groups(spark, case):
    value = {"distinct": "id * 7919 % 100003", "ties": "id % 3", "skewed": "if(id < 40000, 5, id)", "few": "id"}[case]
    df = spark.range(5 if case == "few" else 60_001).selectExpr("if(id % 10 = 0, 'b', 'hot') AS k", f"{value} AS v", "-id AS w")
    got = aggregate.aggregate_by(df, ["k"], {"v": "median", "w": "median"})
    assert "percentile(" not in got._jdf.queryExecution().toString().lower()
    want = aggregate.aggregate_by(df, ["k"], {"v": "median", "w": "median"}, median="builtin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("wide", [False, True])
def test_median_of_rows_that_spark_takes_for_few(spark, tmp_path, monkeypatch, wide):
    """Rows that tasks make from a short list, as those of files: they are never broadcast."""
    spark.range(4).write.parquet(str(tmp_path / "list"))

    def rows(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                ids = pa.array(range(at * 30_000, at * 30_000 + 30_000))
                yield pa.RecordBatch.from_arrays([pc.cast(pc.divide(ids, 40_000), pa.string()), ids], names=["k", "v"])

    df = spark.read.parquet(str(tmp_path / "list")).mapInArrow(rows, "k string, v bigint")
    if wide:
        monkeypatch.setattr(aggregate, "BROADCAST_BYTES", 100)
    for n_rows in (None, 120_000):
        out = aggregate.aggregate_by(df, ["k"], {"v": "median"}, n_rows=n_rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan
        assert not (wide and n_rows and "BroadcastHashJoin" in plan)
        assert {r["k"]: r["v"] for r in out.collect()} == {"0": 19_999.5, "1": 59_999.5, "2": 99_999.5}


def test_rank_is_dense_and_total_over_partitions(spark):
    df = spark.range(5000).withColumn("hot", F.lit(1)).repartition(40)
    out = rank_rows(df, "hot", ties=[F.col("id")])
    assert out.where(F.col("row_rank") != F.col("id") + 1).count() == 0


@pytest.mark.parametrize("ascending", [True, False])
def test_missing_values_sort_last_both_ways(spark, ascending):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    out = [row["x"] for row in sort_rows(df, "x", ascending).collect()]
    assert out == ([1, 2, None] if ascending else [2, 1, None])


def test_salted_join_keeps_every_row_once(spark):
    big = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', 'none') AS k")
    small = spark.createDataFrame([("hot", 1)], "k string, x int")
    out = salted_left_join(big, small, ["k"], ["id"])
    assert out.count() == 1000
    assert out.where("x = 1").count() == 900


def headers(spark, layouts):
    rows = [(d, f, i, cols) for i, (d, f, cols) in enumerate(layouts)]
    return spark.createDataFrame(rows, "dataset string, file_path string, file_seq int, columns array<string>")


def test_majority_vote_and_ties(spark):
    files = headers(spark, [
        ("x", "f1", ["Brand", "Id"]), ("x", "f2", ["Brands", "Id", "More"]), ("x", "f3", ["Brands"]),
        ("tie", "g1", ["Box", "a"]), ("tie", "g2", ["Boxes", "a", "b"]),
        ("chain", "h1", ["x", "xs"]), ("chain", "h2", ["xses", "xs"]), ("chain", "h3", ["xes"]),
    ])
    out = {(r["dataset"], r["from_name"]): r["to_name"] for r in layout.canonical_renames(files).collect()}
    assert out == {
        ("x", "Brand"): "Brands", ("tie", "Box"): "Boxes",
        ("chain", "x"): "xs", ("chain", "xes"): "xs", ("chain", "xses"): "xs",
    }


def test_renames_are_idempotent(spark):
    files = headers(spark, [("x", "f1", ["Brand"]), ("x", "f2", ["Brands", "a"]), ("x", "f3", ["Brands"])])
    once = layout.apply_renames(files, layout.canonical_renames(files))
    assert layout.canonical_renames(once).count() == 0


def test_renames_move_whole_headers(spark, monkeypatch):
    files = headers(spark, [
        ("x", "f1", ["Brand", "Id", "Brand"]), ("x", "f2", ["Brands", None]), ("y", "f3", ["Brand"]),
        (None, "f4", ["Brand"]), ("x", None, ["Brand", "z"]), ("x", "f5", []), ("x", "f6", None),
    ])
    files = files.union(files.where("file_path = 'f1'").withColumn("columns", F.array(F.lit("Brand"), F.lit("More"))))
    renames = spark.createDataFrame([("x", "Brand", "Brands")], "dataset string, from_name string, to_name string")
    out = layout.apply_renames(files, renames)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row per name
    rows = sorted(out.collect(), key=str)
    found = {(r["dataset"], r["file_path"]): r["columns"] for r in rows}
    assert found == {
        ("x", "f1"): ["Brands", "Brands", "Id", "More", "Brands"], ("x", "f2"): ["Brands", None], ("y", "f3"): ["Brand"],
        (None, "f4"): ["Brand"], ("x", None): ["Brands", "z"],
    }
    monkeypatch.setattr(layout, "RENAMES_BYTES", -1)
    assert sorted(layout.apply_renames(files, renames).collect(), key=str) == rows


@pytest.mark.parametrize(
    ("policy", "expected"),
    [
        ("keep_first", [("x", "xs"), ("x", "xes"), ("b", "bs")]),
        ("keep_second", [("xs", "x"), ("xes", "x"), ("bs", "b")]),
        ({"x": "xs", "b": "b"}, [("xs", "x"), ("b", "bs")]),
    ],
)
def test_conflict_policies(spark, policy, expected):
    names = ["x", "q", "xs", "b", "xes", "bs"]
    got = layout.fold_conflicts(names, policy)
    if policy == "keep_second":
        expected = [("xs", "x"), ("bs", "b")]
    assert got == expected
    files = headers(spark, [("d", "f", names), ("d", "g", ["plain", "plain"])])
    rows = {r["file_path"]: r for r in layout.resolve_conflicts(files, policy).collect()}
    assert [(f["kept"], f["dropped"]) for f in rows["f"]["folds"]] == expected
    assert rows["f"]["columns"] == [n for n in names if n not in {d for _, d in expected}]
    assert rows["g"]["columns"] == ["plain", "plain"]


def test_structure_issues_and_verdict(spark):
    files = headers(spark, [
        ("d", "ref", ["a", "b", "Brand"]), ("d", "short", ["a", "Brands"]), ("d", "same", ["b", "a", "Brand"]),
        ("ok", "one", ["z"]), ("ok", "two", ["z"]),
    ])
    issues = layout.structure_issues(files).orderBy("file_path", "issue_type", "column_name").collect()
    assert [(i["file_path"], i["column_name"], i["column_index"], i["excel_ref"], i["issue_type"]) for i in issues] == [
        ("short", "Brands", 1, "B", "extra"), ("short", "Brand", 2, "C", "missing"), ("short", "b", 1, "B", "missing"),
    ]
    assert issues[0]["hint"] == "Possible plural/singular: 'Brands' vs 'Brand'"
    assert issues[1]["hint"] == "Possible plural/singular: 'Brand' vs 'Brands'"
    verdict = {r["dataset"]: r["success"] for r in layout.validation_verdict(files).collect()}
    assert verdict == {"d": False, "ok": True}
    assert all(r["success"] for r in layout.validation_verdict(files, allow_missing=True).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_join_equals_a_plain_join(spark, how):
    big = spark.range(5000).selectExpr("id", "CASE WHEN id < 2500 THEN 'hot' WHEN id < 4000 THEN 'warm' WHEN id < 4100 THEN NULL ELSE string(id) END AS k")
    small = spark.range(4000, 4500).selectExpr("string(id) AS k", "id AS x").union(spark.createDataFrame([("hot", 1), ("hot", 2), ("gone", 3)], "k string, x long"))
    found = {r["key"]: r["salts"] for r in hot_keys(big, big.k, 20).collect()}
    assert set(found) == {"hot", "warm"} and found["hot"] == 11 and found["warm"] == 7
    got = hot_join(big, small, "k", ["id"], how, tasks=20)
    want = big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    nothing = hot_join(big.limit(0), small, "k", ["id"], how, tasks=20)
    assert nothing.count() == 0


def test_median_sketches_merge(spark):
    """Sketches of parts give the rank that one pass gives; groups without values have none."""
    df = spark.range(30000).selectExpr("id % 3 AS g", "id % 7 AS part", "CASE WHEN id % 3 < 2 THEN double(pmod(id * 7919, 30011)) END AS x")
    stored = median_sketches(df, ["g", "part"], ["x"])
    merged = {r["g"]: r["x"] for r in sketch_medians(merge_sketches(stored, ["g"], ["x"]), ["g"], ["x"]).collect()}
    direct = {r["g"]: r["x"] for r in aggregate_by(df.drop("part"), ["g"], {"x": "median"}, median="sketch").collect()}
    assert merged[2] is None and direct[2] is None
    for g in (0, 1):
        values = sorted(r["x"] for r in df.where(df.g == g).collect())
        for value in (merged[g], direct[g]):
            assert abs(values.index(value) / len(values) - 0.5) <= 2 * SKETCH_ERROR
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", float("nan"))], "g string, x double")
    out = {r["g"]: r["x"] for r in aggregate_by(small, ["g"], {"x": "median"}, median="sketch").collect()}
    assert out == {"a": 2.0, "b": None}


def test_many_outputs_are_planned_when_asked_for(spark):
    from tabmeld.plans.consolidate import Plans

    asked = []
    outputs = Plans()
    for name in ("a", "b"):
        outputs.plan(name, lambda name=name: asked.append(name) or spark.range(1))
    assert sorted(outputs) == ["a", "b"] and len(outputs) == 2 and not asked
    assert outputs["a"].count() == 1 and outputs["a"] is outputs["a"] and asked == ["a"]


def test_issue_hints_cover_missing_columns_too(spark, tmp_path):
    import workload

    workload.load_all()
    texts = [(1, "en", "Item Cost Brands Day"), (2, "en", "Items Cost Brand Brand"), (3, "de", "Tag Tage"), (4, "de", "Tags Tag")]
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["file_path"], r["issue_type"], r["column_name"], r["hint"]) for r in workload.QUERIES["layout_issue_hints"](spark, str(tmp_path)).collect()}
    hint = "Possible plural/singular: '{}' vs '{}'".format
    assert got == {
        ("2", "missing", "Item", hint("Item", "Items")), ("2", "missing", "Brands", hint("Brands", "Brand")),
        ("2", "extra", "Items", hint("Items", "Item")), ("2", "extra", "Brand", hint("Brand", "Brands")),
        ("4", "extra", "Tags", hint("Tags", "Tag")),
    }


def test_missing_columns_by_places_and_by_joins_agree(spark, monkeypatch):
    """Repeated files and names, NULLs and odd white space included."""
    import random

    from tabmeld.operators import layout

    rng = random.Random(7)
    names = ["a", "as", "ases", "b", "bs", "bes", "c", "c s", "\u2003d", "ds", "\u2003ds", "", "s", "es", "es\u00a0", "f", None]
    rows = [(rng.choice(["x", "y", None]), str(i // 2), i // 2, rng.choices(names, k=rng.randint(0, 14))) for i in range(60)]
    headers = spark.createDataFrame([*rows, ("x", None, 1, ["a"]), ("y", "n", 2, None)], "dataset string, file_path string, file_seq int, columns array<string>")
    reference = layout.materialize(layout.reference_layout(headers), "reference")
    by_places = layout._missing_columns(headers, reference)
    monkeypatch.setattr(layout, "NAMES_BYTES", 0)
    by_joins = layout._missing_columns(headers, reference)
    assert by_places.columns == by_joins.select(by_places.columns).columns
    rows = lambda df: sorted(map(repr, df.select(by_joins.columns).collect()))
    assert rows(by_places) == rows(by_joins) and by_places.where("partner is not null").count() > 4


def test_hints_do_not_list_all_missing_names(spark):
    """A row for every reference name that a file lacks was made, and then dropped, before."""
    from tabmeld.operators import layout

    rows = [("a", "1", 1, ["x", "y", "z", "w"]), ("a", "2", 2, ["q", "x", "ys"])]
    headers = spark.createDataFrame(rows, "dataset string, file_path string, file_seq int, columns array<string>")
    issues = layout.structure_issues(headers)
    hinted = issues.where("hint IS NOT NULL")
    assert sorted((r["issue_type"], r["column_name"]) for r in hinted.collect()) == [("extra", "ys"), ("missing", "y")]
    assert "array_except" not in hinted._jdf.queryExecution().optimizedPlan().toString()
    lacking = issues.where("issue_type = 'missing'")
    assert sorted((r["column_name"], r["column_index"]) for r in lacking.collect()) == [("w", 3), ("y", 1), ("z", 2)]
    # Names are looked up, and reference names counted by place: no text is compared for those that a file lacks.
    assert "array_except(reference_columns" not in lacking._jdf.queryExecution().optimizedPlan().toString()


def test_extra_columns_count_once_and_need_a_reference(spark):
    from tabmeld.operators import layout

    rows = [("a", "1", 1, ["x", "y", "z", "w"]), ("a", "2", 2, ["q", "x", "q", "ys"]), ("b", "3", 3, None), ("b", "4", 4, ["k"])]
    headers = spark.createDataFrame(rows, "dataset string, file_path string, file_seq int, columns array<string>")
    issues = layout.structure_issues(headers, allow_missing=True).collect()
    got = sorted((r["file_path"], r["column_name"], r["column_index"], r["hint"]) for r in issues)
    assert got == [("2", "q", 0, None), ("2", "ys", 3, "Possible plural/singular: 'ys' vs 'y'")]
    pairs = layout.extra_column_files(headers).collect()
    assert sorted((r["file_path"], r["column_name"]) for r in pairs) == [("2", "q"), ("2", "ys")]
