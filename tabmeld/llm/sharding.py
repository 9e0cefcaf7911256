"""Contiguous shards of nearly equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm.prefix import with_running_sums
from tabmeld.operators.spread import hot_join
from tabmeld.session import materialize

ROW_BYTES = 8
# A group of equal rows stays in one shard if it has at most one part in so many of a shard's bytes.
GROUP_SHARE = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed cost per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def assign_shards(df: DataFrame, order: list[str], size: str, shards: int, group: str) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that carry a positive integer ``size``.

    Rows follow each other by ``group`` and then by ``order`` (nulls first). A row goes to the shard in
    which its first byte falls when all bytes are cut into ``shards`` equal parts. Rows of one group stay
    together: the first byte of the group decides for all of them, unless the group has more than
    1 / GROUP_SHARE of a shard's bytes, in which case its rows are cut like any others. So a shard's
    bytes differ from the target by less than such a group, or a row, at either end; a row larger than
    the target leaves the shards that it spans without rows of their own. ``slot`` counts the rows of a
    shard from 0 without gaps. Only partition totals and one row per shard are gathered. Columns named
    like the results are replaced. An empty table gives an empty table; rows that tie in ``order`` are
    interchangeable. ``group`` must not be null.
    """
    kept = [name for name in df.columns if name not in ("shard", "slot")]
    # Written once: the sort samples its input, and the total needs it too.
    df = materialize(df.select(*kept), "sizes")
    keys = [F.col(name).asc_nulls_first() for name in (group, *order)]
    total = df.agg(F.sum(size).alias("_total"))
    summed = with_running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, {"_before": size, "_rank": "_one"}, "shards")
    summed = materialize(summed.crossJoin(F.broadcast(total)), "summed")  # a single row
    groups = summed.groupBy(group).agg(
        F.min("_before").alias("_start"), F.sum(size).alias("_bytes"), F.count("*").alias("_rows"), F.first("_total").alias("_all")
    )
    small = groups.where((F.col("_rows") > 1) & (F.col("_bytes") * shards * GROUP_SHARE <= F.col("_all"))).select(group, "_start")
    placed = hot_join(summed, small, group, [*order, "_rank"], "left").withColumn(
        "shard",
        F.expr(f"cast(least({shards - 1}, cast(coalesce(_start, _before) as decimal(28, 0)) * {shards} div _total) as int)"),
    )
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return (
        placed.join(F.broadcast(firsts), "shard")
        .withColumn("slot", F.col("_rank") - F.col("_first"))
        .select(*kept, "shard", "slot")
    )
