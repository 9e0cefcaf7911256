"""Sorts, ranks and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeld.operators.order import preview, rank_rows, sort_rows, top_rows
from workload import query, table

_GAPS = "CASE WHEN value > 30 THEN NULL ELSE value END"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(~(F.col("value") > 30), F.col("value")).alias("value")
    )


@query(
    "sort_descending_nulls_last",
    f"""SELECT event_id, event_type, {_GAPS} AS value,
        row_number() OVER (ORDER BY event_type DESC NULLS LAST, {_GAPS} DESC NULLS LAST, event_id) AS row_rank
        FROM events""",
)
def sort_descending(spark, sf_dir):
    return rank_rows(_events(spark, sf_dir), ["event_type", "value"], ties=[F.col("event_id")])


@query(
    "sort_ascending_nulls_last",
    f"""SELECT event_id, event_type, {_GAPS} AS value,
        row_number() OVER (ORDER BY {_GAPS} ASC NULLS LAST, event_id) AS row_rank FROM events""",
)
def sort_ascending(spark, sf_dir):
    return rank_rows(_events(spark, sf_dir), "value", ascending=True, ties=[F.col("event_id")])


@query(
    "sort_ignores_absent_keys",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_rank
       FROM orders""",
)
def sort_absent(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rank_rows(df, ["no_such_column", "o_totalprice"], ties=[F.col("o_orderkey")])


@query(
    "sort_preview_rows",
    "SELECT * FROM nation ORDER BY n_name ASC NULLS LAST, n_nationkey LIMIT 3",
)
def preview_rows(spark, sf_dir):
    return preview(sort_rows(table(spark, sf_dir, "nation"), "n_name", ascending=True, ties=[F.col("n_nationkey")]))


@query(
    "sort_top_rows",
    """SELECT * FROM lineitem
       ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""",
)
def top(spark, sf_dir):
    ties = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return top_rows(table(spark, sf_dir, "lineitem"), 100, "l_extendedprice", ties=ties)


@query(
    "row_order_reset",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS row_index FROM orders",
)
def row_order_reset(spark, sf_dir):
    """Consecutive row numbers over files in sequence (status stands for the file)."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    ranked = rank_rows(df, [], ties=[F.col("o_orderstatus"), F.col("o_orderkey")])
    return ranked.select("o_orderkey", (F.col("row_rank") - 1).alias("row_index"))
