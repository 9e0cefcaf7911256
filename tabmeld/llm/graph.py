"""Connected components of an edge table, and joins with a side of checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.session import materialize

# A broadcast side has at most so many bytes, with ROW_BYTES for each row besides its texts.
BROADCAST_BYTES = 24 << 20
ROW_BYTES = 32


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if it is small in bytes; else the join shuffles it."""

    def width(field: T.StructField) -> Column:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(cell), F.lit(0))
        if isinstance(field.dataType, T.ArrayType | T.StructType | T.MapType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(cell))), F.lit(0))
        return F.lit(8)

    total = reduce(Column.__add__, map(width, df.schema.fields), F.lit(ROW_BYTES))
    held = df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")
    ).first()
    return row.n, int(row.h)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a")
    return (
        linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(linked.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the component's smallest node.

    Alternates large-star and small-star rounds until the edges stay the same: all of them then
    point from a node to its root. Each round is written to the shared folder; the driver sees a
    count and a checksum per round. A node with many edges is only ever aggregated map-side or
    joined to one row.
    """
    kept = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _signature(kept)
    while before[0]:
        kept = materialize(_small_star(_large_star(kept)), "edges")
        after = _signature(kept)
        if after == before:
            break
        before = after
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
