"""Running sums over a total order of all rows, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.session import materialize


def with_running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], label: str) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum of ``column`` over all earlier rows.

    Rows are range-partitioned by ``order`` (rows that tie in it spread over ranges by their
    place in the input) and written once; the totals of the ranges, one row each, give every
    range its offset, and a window inside each range gives the rest. Ties in ``order`` come in
    no defined order, so ``order`` should name all columns that the result shows.
    """
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_tie"))
        .withColumn("_range", F.spark_partition_id())
    )
    rows = materialize(ranged, label)
    totals = rows.groupBy("_range").agg(*[F.sum(column).alias(f"_{new}") for new, column in sums.items()])
    # One row per range, so at most spark.sql.shuffle.partitions rows in this window.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order, F.col("_tie")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select(
        "*", *[F.coalesce(F.sum(column).over(inside), F.lit(0)).alias(f"_in_{new}") for new, column in sums.items()]
    ).join(F.broadcast(offsets), "_range")
    added = [(F.col(f"_{new}") + F.col(f"_in_{new}")).alias(new) for new in sums]
    return summed.select(*df.columns, *added)
