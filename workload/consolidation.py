"""End-to-end consolidation, sinks and reports."""

from __future__ import annotations

from itertools import islice, permutations

from pyspark.sql import functions as F

from tabmeld.operators.spread import with_global_rank
from tabmeld.plans.consolidate import Consolidation, consolidate
from tabmeld.plans.report import metric_table, output_previews, output_shapes, run_summary
from tabmeld.plans.sink import read_output, stacked, write_outputs, write_partitioned
from workload import query, table
from workload.exports import new_root, write_csv, write_file, write_short_files, write_varied_headers


# Files of an export at least, and rows of a file at most.
ADS_FILES = 8
ADS_ROWS = 1_000_000


def _dealt(df, least: int = 1):
    """Rows in so many partitions as their number asks for, one file each."""
    return df.repartition(max(least, -(-df.count() // ADS_ROWS)))


# The number of files that this gives, in SQL.
_N_FILES = "greatest({least}, (count(*) + {most} - 1) // {most})"
_LINE_FILES = _N_FILES.format(least=ADS_FILES, most=ADS_ROWS)
_PEOPLE_FILES = _N_FILES.format(least=1, most=ADS_ROWS)


def _ads(spark, sf_dir, label: str) -> str:
    """lineitem as three exports with differing headers, customers and a lone table beside it."""
    root = new_root(spark, label)
    lineitem = _dealt(table(spark, sf_dir, "lineitem"), ADS_FILES)
    common = ["l_orderkey AS ` Order   Key`", "l_linestatus AS State"]
    write_csv(
        lineitem.where("l_returnflag = 'R'").selectExpr(
            *common, "l_returnflag AS Flag", "l_quantity AS Impression", "l_extendedprice AS `Media Cost (USD)`", "l_tax AS Tax"
        ), root, "ads", sep=";",
    )
    write_csv(
        lineitem.where("l_returnflag = 'A'").selectExpr(
            *common, "l_returnflag AS Flags", "l_quantity AS Impressions", "l_extendedprice AS `Media Cost (Adv)`"
        ), root, "ads",
    )
    write_csv(
        lineitem.where("l_returnflag = 'N'").selectExpr(
            *common, "l_returnflag AS Flag", "l_quantity AS Impressions", "l_extendedprice AS Spend"
        ), root, "ads", sep="\t",
    )
    customer = _dealt(table(spark, sf_dir, "customer"))
    write_csv(customer.where("c_nationkey < 10").selectExpr("c_custkey AS id", "c_mktsegment AS Segment"), root, "people")
    write_csv(
        customer.where("c_nationkey >= 10").selectExpr("c_custkey AS ID", "c_mktsegment AS Segment", "c_acctbal AS balance"),
        root, "people",
    )
    write_csv(table(spark, sf_dir, "region").coalesce(1), root, "lone")
    return root


_OPTIONS = {
    "column_aliases": {"Spend": "Media Cost"},
    "column_canonical_patterns": [{"base": "Media Cost", "canonical": "Media Cost"}],
    "group_by": ["Flag", "State"],
    "max_rows_before_aggregate": 100,
    "aggregate_columns": {"Impressions": "sum", "Media Cost": "median", "Order Key": "max"},
    "sort_by": "Media Cost",
    "preflight": "report",
    "subdirectories": {"people": {"group_by": None, "sort_by": ["balance"], "sort_ascending": True}},
}


@query(
    "consolidate_aggregated",
    """SELECT l_returnflag AS "Flag", l_linestatus AS "State", round(sum(l_quantity), 2) AS "Impressions",
       median(l_extendedprice) AS "Media Cost", max(l_orderkey) AS "Order Key" FROM lineitem GROUP BY ALL""",
)
def consolidate_aggregated(spark, sf_dir):
    """Header rules, aliases, patterns, plural vote, union, aggregation and sort from raw files."""
    out = consolidate(spark, _ads(spark, sf_dir, "aggregated"), _OPTIONS).outputs["ads"]
    return out.withColumn("Impressions", F.round("Impressions", 2))


@query(
    "consolidate_rows",
    """SELECT l_orderkey AS "Order Key", l_linestatus AS "State", l_returnflag AS "Flag", l_quantity AS "Impressions",
       l_extendedprice AS "Media Cost", CASE WHEN l_returnflag = 'R' THEN l_tax END AS "Tax" FROM lineitem""",
)
def consolidate_rows(spark, sf_dir):
    """The same files without aggregation: every row, one layout."""
    options = {key: _OPTIONS[key] for key in ("column_aliases", "column_canonical_patterns")}
    return consolidate(spark, _ads(spark, sf_dir, "rows"), options).outputs["ads"]


@query(
    "consolidate_dataset_override",
    """SELECT c_custkey AS "ID", c_mktsegment AS "Segment", CASE WHEN c_nationkey >= 10 THEN c_acctbal END AS balance,
       row_number() OVER (ORDER BY CASE WHEN c_nationkey >= 10 THEN c_acctbal END ASC NULLS LAST, c_custkey) AS place
       FROM customer""",
)
def consolidate_override(spark, sf_dir):
    """One dataset sorts upwards and does not aggregate."""
    from tabmeld.operators.order import rank_rows

    people = consolidate(spark, _ads(spark, sf_dir, "override"), _OPTIONS).outputs["people"]
    return rank_rows(people, "balance", ascending=True, ties=[F.col("ID")], rank="place")


@query(
    "consolidate_renames",
    "SELECT 'ads' AS dataset, 'Impression' AS from_name, 'Impressions' AS to_name FROM lineitem WHERE l_returnflag <> 'R' "
    "HAVING count(*) > 0 UNION ALL SELECT 'ads', 'Flags', 'Flag' FROM lineitem WHERE l_returnflag <> 'A' HAVING count(*) > 0",
)
def consolidate_renames(spark, sf_dir):
    return consolidate(spark, _ads(spark, sf_dir, "renames"), _OPTIONS).renames


@query(
    "consolidate_selected_columns",
    """SELECT NULL::DOUBLE AS "Unknown", l_quantity AS "Impressions", CASE WHEN l_returnflag = 'R' THEN l_tax END AS "Tax"
       FROM lineitem""",
)
def consolidate_columns(spark, sf_dir):
    """Only the configured columns, in configured order; absent ones as NULL."""
    options = {"columns": ["Unknown", "Impressions", "Tax"], "preflight": "report", "subdir_include": ["ads"]}
    return consolidate(spark, _ads(spark, sf_dir, "columns"), options).outputs["ads"]


@query(
    "consolidate_preflight_abort",
    """SELECT 'ads' AS dataset, 'Tax' AS missing, l_returnflag <> 'R' AS lacking, false AS success
       FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL""",
)
def preflight_abort(spark, sf_dir):
    """A file without a required column stops the whole run before anything is merged."""
    run = consolidate(spark, _ads(spark, sf_dir, "abort"), {"sort_by": ["Tax"], "subdir_include": ["ads"]})
    return run.missing_required.select(
        "dataset", F.array_join("missing", ",").alias("missing"), F.lit(True).alias("lacking"),
        F.lit(run.success or bool(run.outputs)).alias("success"),
    ).distinct()


@query(
    "consolidate_written_partitions",
    """SELECT 'ads' AS dataset, count(*) AS n_rows, round(sum(l_quantity), 2) AS total FROM lineitem
       UNION ALL SELECT 'people', count(*), 0 FROM customer""",
)
def written_partitions(spark, sf_dir):
    """All merged datasets as one table partitioned by dataset, read back."""
    run = consolidate(spark, _ads(spark, sf_dir, "partitioned"), {"preflight": "report"})
    path = write_partitioned(spark, run, new_root(spark, "written"))
    back = spark.read.parquet(path)
    return back.groupBy("dataset").agg(
        F.count("*").alias("n_rows"), F.round(F.coalesce(F.sum("Impressions"), F.lit(0.0)), 2).alias("total")
    )


@query(
    "consolidate_stacked",
    """SELECT 'people' AS dataset, c_mktsegment AS "Segment", count(*) AS n FROM customer GROUP BY ALL
       UNION ALL SELECT 'ads', NULL, count(*) FROM lineitem""",
)
def stacked_rows(spark, sf_dir):
    run = consolidate(spark, _ads(spark, sf_dir, "stacked"))
    return stacked(spark, run).groupBy("dataset", "Segment").agg(F.count("*").alias("n"))


@query(
    "consolidate_output_shapes",
    """SELECT 'ads' AS dataset, true AS written, count(*) AS n_rows, 'Order Key,State,Flag,Impressions,Media Cost,Tax' AS columns
       FROM lineitem UNION ALL SELECT 'people', true, count(*), 'ID,Segment,balance' FROM customer
       UNION ALL SELECT 'lone', false, NULL, NULL FROM region HAVING count(*) > 0""",
)
def shapes(spark, sf_dir):
    options = {key: _OPTIONS[key] for key in ("column_aliases", "column_canonical_patterns")}
    run = consolidate(spark, _ads(spark, sf_dir, "shapes"), options)
    written = write_outputs(run, new_root(spark, "outputs"))
    out = output_shapes(spark, run, written)
    ordered = F.array_join("columns", ",")
    return out.withColumn("columns", ordered)


@query(
    "consolidate_output_previews",
    """SELECT 'ads' AS dataset, row_number() OVER (ORDER BY m DESC)::INT AS row, key FROM
         (SELECT l_returnflag || '-' || l_linestatus AS key, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL) QUALIFY row <= 3
       UNION ALL SELECT 'people', row_number() OVER (ORDER BY c_acctbal, c_custkey)::INT AS row, c_custkey::VARCHAR
       FROM customer WHERE c_nationkey >= 10 QUALIFY row <= 3""",
)
def previews(spark, sf_dir):
    """The first three rows of every written output, of different columns."""
    options = {**_OPTIONS, "subdirectories": {"people": {"group_by": None, "sort_by": ["balance", "ID"], "sort_ascending": True}}}
    run = consolidate(spark, _ads(spark, sf_dir, "previews"), options)
    out = output_previews(spark, run, write_outputs(run, new_root(spark, "previewed")))
    field = lambda name: F.get_json_object("record", f"$['{name}']")
    key = F.coalesce(field("ID"), F.concat_ws("-", field("Flag"), field("State")))
    return out.select("dataset", "row", key.alias("key"))


@query(
    "consolidate_summary_table",
    f"""SELECT metric, value FROM (SELECT unnest(['success', 'processed_datasets', 'total_datasets', 'total_files_merged',
       'skipped_single_file', 'errors']) AS metric, unnest(['true', '3', '3', (3 * l.n + 2 * c.n)::VARCHAR, '1', '0']) AS value
       FROM (SELECT {_LINE_FILES} AS n FROM lineitem) l, (SELECT {_PEOPLE_FILES} AS n FROM customer) c)""",
)
def summary_table(spark, sf_dir):
    """All totals of a run: three exports of lineitem, two of customer, and a lone file."""
    return metric_table(run_summary(spark, consolidate(spark, _ads(spark, sf_dir, "summary"))))


@query(
    "consolidate_failed_write",
    f"""SELECT metric, value FROM (SELECT unnest(['success', 'processed_datasets', 'total_datasets', 'total_files_merged',
       'skipped_single_file', 'errors']) AS metric, unnest(['true', '2', '3', (2 * n)::VARCHAR, '1', '1']) AS value
       FROM (SELECT {_PEOPLE_FILES} AS n FROM customer))""",
)
def failed_write(spark, sf_dir):
    """A dataset whose output exists already is not merged, and its files do not count."""
    run = consolidate(spark, _ads(spark, sf_dir, "failed-write"))
    target = new_root(spark, "taken")
    spark.range(1).write.parquet(f"{target}/ads_merged")
    write_outputs(run, target)
    return metric_table(run_summary(spark, run))


@query("sink_csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(spark, sf_dir):
    """Whole documents, with quotes, delimiters and line breaks, written as CSV and read back."""
    documents = table(spark, sf_dir, "documents")
    run = Consolidation(success=True, outputs={"documents": documents}, status=[("documents", "merged", 1, 1, None, None)])
    written = write_outputs(run, new_root(spark, "csv"), fmt="csv")
    return read_output(spark, written["documents"], "csv", documents.schema)


def _write_files_of(df, n_rows, order, root, dataset):
    """Files of ``n_rows`` rows each, the last one of the rest, written by many tasks."""
    ranked = with_global_rank(df, order)
    # A task gets whole groups, so only the one with the last group ends in a shorter file.
    dealt = ranked.repartition(F.floor((F.col("row_rank") - 1) / n_rows)).drop("row_rank")
    write_short_files(dealt, n_rows, root, dataset)


@query(
    "consolidate_preflight_findings",
    """SELECT 'ads' AS dataset, 'error' AS level, 'missing required columns: Tax' AS message
       FROM range((SELECT ((count(*) + 49) // 50)::BIGINT FROM lineitem))""",
)
def preflight_findings(spark, sf_dir):
    """One row per file that lacks a required column, however many there are."""
    root = new_root(spark, "findings")
    lacking = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    _write_files_of(lacking, 50, [F.col("l_orderkey"), F.col("l_quantity")], root, "ads")
    run = consolidate(spark, root, {"sort_by": ["Tax"]})
    return run.findings(spark).select("dataset", "level", "message")


@query(
    "consolidate_unread_files",
    """SELECT 'o_orderstatus=' || o_orderstatus AS dataset, 'empty.csv' AS file_name, 'warning' AS level, 'merged' AS status,
       count(*) + 1 AS n_rows FROM orders GROUP BY o_orderstatus""",
)
def unread_files(spark, sf_dir):
    """An empty file of every folder is reported, a hidden one is read, and both leave the others to be merged."""
    root = new_root(spark, "unread")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").option("header", True).csv(root)
    for row in orders.select("o_orderstatus").distinct().collect():  # one folder per status
        folder = f"{root}/o_orderstatus={row['o_orderstatus']}"
        write_file(spark, f"{folder}/_x.csv", "o_orderkey,o_totalprice\n-1,2.5\n")
        write_file(spark, f"{folder}/empty.csv", "")
    run = consolidate(spark, root)
    status = run.status_table(spark).select("dataset", "status", "n_rows")
    return run.findings(spark).select("dataset", "file_name", "level").join(status, "dataset")


_POLICIES = {
    "conflict_policy": "keep_first",
    "subdirectories": {
        "second": {"conflict_policy": "keep_second"},
        "mapped": {"conflict_policy": {"Segment": "Segments"}},
        "gap": {"conflict_policy": {"Other": "Others"}},
        "strict": {"conflict_policy": "fail"},
    },
}


@query(
    "consolidate_conflict_policies",
    """SELECT dataset, kept, c_custkey AS "ID", CASE WHEN kept = 'Segment' THEN coalesce(a, b) ELSE coalesce(b, a) END AS value
       FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS b
             FROM customer), (VALUES ('first', 'Segment'), ('second', 'Segments'), ('mapped', 'Segments')) AS p(dataset, kept)
       UNION ALL SELECT dataset, 'refused', NULL, NULL FROM (VALUES ('gap'), ('strict')) AS q(dataset)""",
)
def conflict_policies(spark, sf_dir):
    """One policy per dataset; a map without an answer and ``fail`` refuse their own dataset only."""
    root = new_root(spark, "policies")
    customer = _dealt(table(spark, sf_dir, "customer")).selectExpr(
        "c_custkey AS ID", "CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS Segment",
        "CASE WHEN c_custkey % 3 < 2 THEN c_name END AS Segments",
    )
    for dataset in ("first", "second", "mapped", "gap", "strict"):
        for test in ("ID % 2 = 0", "ID % 2 = 1"):
            write_csv(customer.where(test), root, dataset)
    run = consolidate(spark, root, _POLICIES)
    parts = []
    for dataset, merged in sorted(run.outputs.items()):
        kept = next(name for name in merged.columns if name != "ID")
        parts.append(merged.select(F.lit(dataset).alias("dataset"), F.lit(kept).alias("kept"), "ID", F.col(kept).alias("value")))
    refused = run.status_table(spark).where("status = 'failed'").selectExpr(
        "dataset", "'refused' AS kept", "CAST(NULL AS BIGINT) AS ID", "CAST(NULL AS STRING) AS value"
    )
    out = refused
    for part in parts:
        out = out.union(part)
    return out


@query(
    "consolidate_status",
    """SELECT 'ads' AS dataset, 'merged' AS status, count(*) AS n_rows FROM lineitem
       UNION ALL SELECT 'people', 'merged', count(*) FROM customer
       UNION ALL SELECT 'lone', 'skipped_single_file', NULL FROM region HAVING count(*) > 0""",
)
def dataset_status(spark, sf_dir):
    run = consolidate(spark, _ads(spark, sf_dir, "status"))
    return run.status_table(spark).select("dataset", "status", "n_rows")


# One file per header: orders of the columns, and a plural in every third one.
MANY_HEADERS = 1000


@query(
    "consolidate_many_headers",
    """SELECT l_orderkey AS "ID", l_linenumber AS "Line", l_returnflag AS "Flag", l_linestatus AS "State",
       l_quantity AS "Impressions", l_extendedprice AS "Cost", l_partkey AS "Part", 1 AS n_scans FROM lineitem""",
)
def many_headers(spark, sf_dir):
    """A thousand distinct headers of one dialect: all rows in one layout, from one scan."""
    columns = [
        "l_orderkey AS id", "l_linenumber AS Line", "l_returnflag AS Flag", "l_linestatus AS State",
        "l_quantity AS Impressions", "l_extendedprice AS Cost", "l_partkey AS Part",
    ]
    headers = [list(order) for order in islice(permutations(columns), MANY_HEADERS)]
    for header in headers[::3]:
        header[header.index("l_quantity AS Impressions")] = "l_quantity AS Impression"
    root = new_root(spark, "headers")
    lines = table(spark, sf_dir, "lineitem").select(*[part.split(" AS ")[0] for part in columns])
    write_varied_headers(lines, headers, root, "ads")
    out = consolidate(spark, root).outputs["ads"]
    n_scans = out._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    return out.select("ID", "Line", "Flag", "State", "Impressions", "Cost", "Part", F.lit(n_scans).alias("n_scans"))


@query(
    "consolidate_many_datasets",
    """SELECT 'l_suppkey=' || l_suppkey AS dataset, 'merged' AS status, 2::BIGINT AS n_files, count(*) AS n_rows
       FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_linenumber < 3) > 0 AND count(*) FILTER (l_linenumber >= 3) > 0""",
)
def many_datasets(spark, sf_dir):
    """A dataset per supplier, two headers each, read together by one scan and typed by one profile."""
    root = new_root(spark, "suppliers")
    lines = table(spark, sf_dir, "lineitem").repartition("l_suppkey")
    for test, columns in (
        ("l_linenumber < 3", ["l_orderkey AS ID", "l_quantity AS Amount", "l_returnflag AS Flag"]),
        ("l_linenumber >= 3", ["l_returnflag AS Flags", "l_orderkey AS ID", "l_shipdate AS Day", "l_quantity AS Amount"]),
    ):
        part = lines.where(test).selectExpr("l_suppkey", *columns)
        part.write.mode("append").option("header", True).partitionBy("l_suppkey").csv(root)
    run = consolidate(spark, root, {"together": True})
    status = run.status_table(spark).where("status = 'merged'")
    return status.select("dataset", "status", "n_files", "n_rows")
