"""Group aggregation: the nine functions, defaults, gate, missing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmeld.operators.aggregate import (
    SKETCH_ERROR,
    aggregate_by,
    aggregate_if_tall,
    median_sketches,
    merge_sketches,
    sketch_medians,
)
from tabmeld.session import materialize
from workload import query, table

# Values above 30 are blanked and one event type loses its key, so gaps are exercised.
_EVENTS_SQL = """
SELECT event_id, nullif(event_type, 'error') AS kind,
       CASE WHEN value > 30 THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id, props
FROM events
"""


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("nullif(event_type, 'error')").alias("kind"),
        F.when(~(F.col("value") > 30), F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"),
        "props",
    )


def _one(function: str, column: str, sql: str, digits: int | None = None):
    name = f"agg_{function}"

    def run(spark, sf_dir):
        df = _events(spark, sf_dir).select("kind", column, "event_id")
        out = aggregate_by(df, ["kind"], {column: function}, order=F.col("event_id"), skip=["event_id"])
        result = F.col(column) if digits is None else F.round(column, digits)
        return out.select("kind", result.alias("result"))

    query(name, f"SELECT kind, {sql} AS result FROM ({_EVENTS_SQL}) WHERE kind IS NOT NULL GROUP BY kind")(run)


_one("sum", "value", "round(coalesce(sum(value), 0), 2)", 2)
_one("mean", "value", "round(avg(value), 6)", 6)
_one("count", "user_id", "count(user_id)")
_one("first", "props", "arg_min(props, event_id) FILTER (WHERE props IS NOT NULL)")
_one("last", "user_id", "arg_max(user_id, event_id) FILTER (WHERE user_id IS NOT NULL)")
_one("min", "value", "min(value)")
_one("max", "props", "max(props)")
_one("median", "value", "median(value)")
_one("std", "value", "round(stddev_samp(value), 6)", 6)


@query(
    "agg_median_ranked",
    "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS l_extendedprice, "
    "median(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL",
)
def median_ranked(spark, sf_dir):
    """The path for groups of any size: one distributed sort, then a lookup by rank."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    chosen = {"l_extendedprice": "median", "l_quantity": "median"}
    return aggregate_by(df, ["l_returnflag", "l_linestatus"], chosen, median="ranked")


@query(
    "agg_sum_of_missing_is_zero",
    """SELECT user_id, coalesce(sum(CASE WHEN event_type = 'click' THEN value END), 0) > 0 AS has_clicks,
       count(CASE WHEN event_type = 'click' THEN value END) AS n_clicks
       FROM events GROUP BY user_id""",
)
def sum_of_missing(spark, sf_dir):
    clicks = F.when(F.col("event_type") == "click", F.col("value"))
    df = table(spark, sf_dir, "events").select("user_id", clicks.alias("total"), clicks.alias("n_clicks"))
    out = aggregate_by(df, ["user_id"], {"total": "sum", "n_clicks": "count"})
    return out.select("user_id", (F.col("total") > 0).alias("has_clicks"), "n_clicks")


@query(
    "agg_defaults_by_type",
    """SELECT o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
       round(sum(o_totalprice), 2) AS o_totalprice, sum(o_custkey)::BIGINT AS o_custkey
       FROM orders GROUP BY o_orderpriority""",
)
def defaults_by_type(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey", "o_orderkey"
    )
    out = aggregate_by(df, ["o_orderpriority"], order=F.col("o_orderkey"), skip=["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "agg_default_function",
    """SELECT o_orderpriority, max(o_orderstatus) AS o_orderstatus, max(o_totalprice) AS o_totalprice,
       count(o_custkey) AS o_custkey FROM orders GROUP BY o_orderpriority""",
)
def default_function(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")
    return aggregate_by(df, ["o_orderpriority"], {"o_custkey": "count"}, default="max")


@query(
    "agg_unknown_function_falls_back",
    """SELECT p_brand, sum(p_size)::BIGINT AS p_size, arg_min(p_type, p_partkey) AS p_type,
       'unknown aggregate ''typo'' for column ''p_size''' AS warning FROM part GROUP BY p_brand""",
)
def unknown_function(spark, sf_dir):
    warnings: list[str] = []
    df = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    out = aggregate_by(
        df, ["p_brand"], {"p_size": "typo"}, order=F.col("p_partkey"), skip=["p_partkey"], warnings=warnings
    )
    return out.withColumn("warning", F.lit("; ".join(warnings)))


@query(
    "agg_missing_group_key",
    "SELECT *, 'group_by columns not in data: [''no_such_column'']' AS error FROM customer",
)
def missing_group_key(spark, sf_dir):
    errors: list[str] = []
    out = aggregate_by(table(spark, sf_dir, "customer"), ["c_mktsegment", "no_such_column"], errors=errors)
    return out.withColumn("error", F.lit("; ".join(errors)))


_GATE_SQL = """SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice
FROM orders GROUP BY ALL"""


def _gated(spark, sf_dir, surplus: int) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")
    threshold = orders.count() + surplus
    return aggregate_if_tall(orders, ["o_orderpriority", "o_orderstatus"], threshold, {"o_totalprice": "sum"})


@query("agg_above_row_threshold", _GATE_SQL)
def above_threshold(spark, sf_dir):
    return _gated(spark, sf_dir, -1).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("agg_at_row_threshold", "SELECT o_orderpriority, o_orderstatus, o_totalprice, o_custkey FROM orders")
def at_threshold(spark, sf_dir):
    return _gated(spark, sf_dir, 0)


@query("agg_threshold_keys_only", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def threshold_keys_only(spark, sf_dir):
    """Without chosen aggregates the pivot keeps the keys alone."""
    orders = table(spark, sf_dir, "orders")
    return aggregate_if_tall(orders, ["o_orderpriority", "o_orderstatus"], 1)


@query(
    "agg_null_keys_kept",
    f"SELECT kind, count(value) AS value, min(user_id) AS user_id FROM ({_EVENTS_SQL}) GROUP BY kind",
)
def null_keys_kept(spark, sf_dir):
    df = _events(spark, sf_dir).select("kind", "value", "user_id")
    return aggregate_by(df, ["kind"], {"value": "count", "user_id": "min"}, null_keys="keep")


@query(
    "agg_sorted_groups",
    """SELECT c_mktsegment, c_nationkey, n, row_number() OVER (ORDER BY c_mktsegment, c_nationkey) AS position
       FROM (SELECT c_mktsegment, c_nationkey, count(c_custkey) AS n FROM customer GROUP BY ALL)""",
)
def sorted_groups(spark, sf_dir):
    """Groups come out in key order; the position makes that order visible."""
    from tabmeld.operators.order import rank_rows

    df = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", F.col("c_custkey").alias("n"))
    out = aggregate_by(df, ["c_mktsegment", "c_nationkey"], {"n": "count"})
    return rank_rows(out, ["c_mktsegment", "c_nationkey"], ascending=True, rank="position")


@query(
    "agg_all_functions",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity,
       round(avg(l_extendedprice), 4) AS l_extendedprice, count(l_orderkey) AS l_orderkey,
       min(l_discount) AS l_discount, max(l_tax) AS l_tax, median(l_partkey) AS l_partkey,
       round(stddev_samp(l_suppkey), 6) AS l_suppkey
       FROM lineitem GROUP BY ALL""",
)
def all_functions(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").drop("l_shipdate", "l_linenumber")
    chosen = {
        "l_quantity": "sum", "l_extendedprice": "mean", "l_orderkey": "count", "l_discount": "min",
        "l_tax": "max", "l_partkey": "median", "l_suppkey": "std",
    }
    out = aggregate_by(df, ["l_returnflag", "l_linestatus"], chosen)
    return out.withColumns(
        {"l_quantity": F.round("l_quantity", 2), "l_extendedprice": F.round("l_extendedprice", 4),
         "l_suppkey": F.round("l_suppkey", 6)}
    )


@query(
    "agg_median_sketch",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, true AS merged_in_bounds, true AS direct_in_bounds
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def median_sketch(spark, sf_dir):
    """Medians within the stated share of the middle rank: of stored sketches per line number, merged, and of one pass."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")
    keys, name = ["l_returnflag", "l_linestatus"], ["l_extendedprice"]
    stored = materialize(median_sketches(rows, [*keys, "l_linenumber"], name), "sketches")
    merged = sketch_medians(merge_sketches(stored, keys, name), keys, name).withColumnRenamed("l_extendedprice", "merged")
    direct = aggregate_by(rows.drop("l_linenumber"), keys, {"l_extendedprice": "median"}, median="sketch")
    medians = merged.join(direct.withColumnRenamed("l_extendedprice", "direct"), keys)  # one row per group
    # A rank may be off by one value in small groups, and twice the error leaves room for the improbable.
    slack = 2 * SKETCH_ERROR * F.col("n") + 1

    def in_bounds(which: str):
        return (F.col(f"below_{which}") <= F.col("n") / 2 + slack) & (F.col(f"upto_{which}") >= F.col("n") / 2 - slack)

    ranks = rows.join(F.broadcast(medians), keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("l_extendedprice") < F.col(which)).alias(f"below_{which}") for which in ("merged", "direct")],
        *[F.count_if(F.col("l_extendedprice") <= F.col(which)).alias(f"upto_{which}") for which in ("merged", "direct")],
    )
    return ranks.select(*keys, "n", *[in_bounds(which).alias(f"{which}_in_bounds") for which in ("merged", "direct")])
