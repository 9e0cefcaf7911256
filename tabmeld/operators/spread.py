"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.session import materialize

SALTS = 32
# A key is hot if it has more rows than this share of what one task gets on average.
HOT_SHARE = 0.5
# Counters of the sketch that finds hot keys; keys beyond one in that many rows are never missed.
TRACKED = 10_000


def widen(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer partitions than the cluster has slots.

    Meant for costly row-wise work on few, large splits; a big input already has more
    partitions than slots and is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def salted_left_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Left join whose key may be hot on the ``big`` side.

    ``small`` holds one row per key. It is repeated once per salt, and the rows of ``big``
    spread over the salts by a hash of ``spread_by``, so no task gets a whole hot key.
    """
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return spread.join(copies, [*keys, "_salt"], "left").drop("_salt")


# A table of names is broadcast up to about this size, and joined by salted keys beyond it.
BROADCAST_BYTES = 16 << 20


def name_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Left join with a table of names, one row per key, that is mostly small; any key may be hot in ``big``.

    ``small`` is written first, so its size is known when the way is chosen.
    """
    small = materialize(small, "names")
    held = F.lit(64)
    for name, kind in small.dtypes:
        if kind == "string":
            held = held + F.coalesce(F.octet_length(name), F.lit(0))
    size = small.agg(F.sum(held.cast("long"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), list(keys), "left")
    return salted_left_join(big, small.hint("merge"), keys, spread_by)


def hot_keys(df: DataFrame, key: Column, tasks: int | None = None) -> DataFrame:
    """(key, salts) of the keys of ``df`` that hold too large a share of its rows for one task.

    One pass with a mergeable frequent-items sketch of bounded size; nothing is shuffled by key. A
    key gets as many salts as the tasks that its rows would fill evenly, so their number follows
    the cluster and all other keys have none. Counts may be too high by one in TRACKED rows, never
    too low by more. ``key`` must not be an array, struct or map; nulls are not counted.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(int(tasks / HOT_SHARE) + 1, TRACKED // 3)
    found = df.select(key.alias("key")).where("key is not null")
    sketch = found.agg(F.expr(f"approx_top_k(key, {most}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    share = F.col("item.count") * tasks / F.col("n")  # of what one task gets
    return (
        sketch.select("n", F.explode("top").alias("item"))
        .select(F.col("item.item").alias("key"), F.ceil(share).cast("int").alias("salts"), share.alias("_share"))
        .where(F.col("_share") > HOT_SHARE)
        .where("salts > 1")
        .drop("_share")
    )


def hot_join(
    big: DataFrame, small: DataFrame, key: str, spread_by: Sequence[str], how: str = "inner", tasks: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on one column that may be hot on the ``big`` side.

    Rows of ``small`` are repeated only for hot keys, once per salt; rows of ``big`` with such a key
    spread over its salts by a hash of ``spread_by``. ``how`` is inner, left or left_semi. ``hot`` names
    the hot keys (key, salts), a task's share each at least, where they are known without a look.
    """
    if hot is None:
        hot = materialize(hot_keys(big, F.col(key), tasks), "hot_keys")
    # At most 2 * tasks rows by the sketch's own limit.
    hot = hot.select(F.col("key").alias("_hot"), F.col("salts").alias("_salts"))
    dealt = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.expr("cast(pmod(xxhash64(%s), _salts) as int)" % ", ".join(f"`{c}`" for c in spread_by)), F.lit(0)))
    copies = small.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
    joined = dealt.drop("_hot", "_salts").join(copies.drop("_hot", "_salts"), [key, "_salt"], how)
    return joined.drop("_salt")


def with_global_rank(df: DataFrame, order: Sequence[Column], rank: str = "row_rank") -> DataFrame:
    """Add the 1-based position of each row in a total order.

    A range-partitioned sort gives every row a position in its partition; partition sizes
    (one row per partition) give the offsets. No task sees more than one range. ``order``
    should end in a unique key, so that equal leading keys spread over ranges.
    """
    sorted_rows = df.orderBy(*order).withColumn("_position", F.monotonically_increasing_id())
    rows = materialize(sorted_rows, "rank")
    partition = F.shiftright("_position", 33)
    counts = rows.groupBy(partition.alias("_range")).agg(F.count("*").alias("_n"))
    # One row per partition: at most spark.sql.shuffle.partitions of them.
    before = counts.withColumn(
        "_offset", F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)")
    ).select("_range", "_offset")
    local = F.col("_position").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_range", partition)
        .join(F.broadcast(before), "_range")
        .withColumn(rank, F.col("_offset") + local + 1)
        .drop("_range", "_offset", "_position")
    )
