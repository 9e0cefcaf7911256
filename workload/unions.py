"""Union by name, type reconciliation, projections and column merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeld.functions.names import NameRules
from tabmeld.operators.aggregate import aggregate_by
from tabmeld.operators.layout import merge_status
from tabmeld.operators.order import sort_rows
from tabmeld.operators.typing import reconcile_text
from tabmeld.operators.union import (
    distinct_keys,
    empty_columns,
    merge_two_columns,
    normalize_columns,
    order_columns,
    reindex,
    rename_columns,
    union_by_name,
)
from workload import query, table

_BRANCHES_SQL = """
SELECT * EXCLUDE (l_tax) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL BY NAME SELECT * FROM lineitem WHERE l_returnflag = 'A'
UNION ALL BY NAME SELECT * EXCLUDE (l_discount) FROM lineitem WHERE l_returnflag = 'N'
"""


def branches(spark, sf_dir):
    """Three exports of lineitem, two of which lack a column."""
    lineitem = table(spark, sf_dir, "lineitem")
    parts = {flag: lineitem.where(F.col("l_returnflag") == flag) for flag in "RAN"}
    return [parts["R"].drop("l_tax"), parts["A"], parts["N"].drop("l_discount")]


@query("union_by_name_null_fill", _BRANCHES_SQL)
def union_null_fill(spark, sf_dir):
    return union_by_name(spark, branches(spark, sf_dir))


@query(
    "union_aggregate_sort",
    f"""SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 2) AS l_quantity,
        count(l_tax) AS l_tax, median(l_extendedprice) AS l_extendedprice,
        round(stddev_samp(l_discount), 6) AS l_discount
        FROM ({_BRANCHES_SQL}) GROUP BY l_returnflag, l_linestatus""",
)
def union_aggregate_sort(spark, sf_dir):
    """Flagship: union by name, group aggregation, sort by the largest total."""
    merged = union_by_name(spark, branches(spark, sf_dir)).select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_extendedprice", "l_discount"
    )
    chosen = {"l_quantity": "sum", "l_tax": "count", "l_extendedprice": "median", "l_discount": "std"}
    out = aggregate_by(merged, ["l_returnflag", "l_linestatus"], chosen, sort_groups=False)
    out = out.withColumns({"l_quantity": F.round("l_quantity", 2), "l_discount": F.round("l_discount", 6)})
    return sort_rows(out, "l_quantity", ties=[F.col("l_returnflag"), F.col("l_linestatus")])


@query("union_of_one", "SELECT * FROM supplier")
def union_of_one(spark, sf_dir):
    return union_by_name(spark, [table(spark, sf_dir, "supplier")])


@query(
    "union_widens_numbers",
    """SELECT p_partkey AS key, p_size::DOUBLE AS amount, p_brand AS code FROM part
       UNION ALL SELECT c_custkey, c_acctbal, c_nationkey::VARCHAR FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_widens(spark, sf_dir):
    """Integer and decimal columns widen; number and text columns become text."""
    return union_by_name(
        spark,
        [
            table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_size AS amount", "p_brand AS code"),
            table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_acctbal AS amount", "c_nationkey AS code"),
            table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS amount"),
        ],
    )


@query(
    "union_reconciles_text_types",
    """SELECT o_orderkey, o_custkey, o_totalprice,
       CASE o_orderstatus WHEN 'F' THEN 'n.v.' ELSE o_custkey::VARCHAR END AS mixed,
       o_orderstatus = 'F' AS flag, o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey::DOUBLE ELSE o_custkey + 0.5 END AS halves
       FROM orders""",
)
def union_reconciles(spark, sf_dir):
    """Text exports get the narrowest type that fits every value of a column."""
    orders = table(spark, sf_dir, "orders")
    texts = [
        "CAST(o_orderkey AS string) AS o_orderkey", "CAST(o_custkey AS string) AS o_custkey",
        "CAST(o_totalprice AS string) AS o_totalprice", "o_orderstatus",
    ]
    finished = orders.where("o_orderstatus = 'F'").selectExpr(
        *texts, "'n.v.' AS mixed", "'True' AS flag", "CAST(o_custkey AS string) AS halves"
    )
    others = orders.where("o_orderstatus <> 'F'").selectExpr(
        *texts, "CAST(o_custkey AS string) AS mixed", "'FALSE' AS flag",
        "CAST(CAST(o_custkey AS double) + 0.5 AS string) AS halves",
    )
    merged = union_by_name(spark, [finished, others])
    return reconcile_text(merged, merged.columns)


@query(
    "single_file_datasets_skipped",
    """SELECT o_custkey AS dataset, count(*) AS n_files,
       CASE WHEN count(*) = 1 THEN 'skipped_single_file' ELSE 'merge' END AS status
       FROM orders GROUP BY o_custkey""",
)
def single_file_datasets(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_custkey AS dataset", "o_orderkey AS file_path")
    return merge_status(files)


@query(
    "distinct_keys_keep_nulls",
    "SELECT DISTINCT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey FROM customer",
)
def keys_only(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"), "c_nationkey"
    )
    return distinct_keys(df, ["segment", "c_nationkey"])


@query("reindex_with_null_fill", "SELECT n_name, NULL::DOUBLE AS population, n_nationkey FROM nation")
def reindexed(spark, sf_dir):
    return reindex(table(spark, sf_dir, "nation"), ["n_name", "population", "n_nationkey"])


@query(
    "requested_columns_without_values",
    "SELECT unnest(['colour', 'p_unused']) AS column_name FROM (SELECT count(*) FROM part)",
)
def columns_without_values(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("p_unused", F.expr("nullif(p_brand, p_brand)"))
    return empty_columns(df, ["p_name", "p_unused", "colour", "p_size"])


@query(
    "merge_two_columns",
    """SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN value END, user_id::DOUBLE) AS amount
       FROM events""",
)
def two_columns(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("amount"), F.col("user_id").alias("amounts")
    )
    return merge_two_columns(df, "amount", "amounts", "amount")


@query("rename_to_canonical", "SELECT s_suppkey, s_name AS supplier, s_nationkey AS nation, s_acctbal FROM supplier")
def renamed(spark, sf_dir):
    return rename_columns(
        table(spark, sf_dir, "supplier"), {"s_name": "supplier", "s_nationkey": "nation", "not_there": "x"}
    )


@query("configured_column_order", "SELECT p_retailprice, p_brand, p_partkey, p_name, p_type, p_size FROM part")
def configured_order(spark, sf_dir):
    return order_columns(table(spark, sf_dir, "part"), ["p_retailprice", "not_there", "p_brand"])


@query(
    "duplicate_names_after_cleaning",
    """SELECT event_id AS "ID", coalesce(CASE WHEN event_type <> 'click' THEN event_type END, props, 'none') AS "Name",
       value AS "Unit Price" FROM events""",
)
def duplicate_names(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias(" id"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("name"),
        F.col("value").alias("Unit   Price "),
        F.col("props").alias("NAME "),
        F.lit("none").alias("Name"),
    )
    return normalize_columns(df, NameRules())
