"""Choose one type per output column from what its cell texts read as."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.functions.cells import read_as, unreadable_as
from tabmeld.functions.names import column


@dataclass(frozen=True)
class ColumnProfile:
    """What the cells of a text column read as, all taken together."""

    mask: int

    @property
    def has_values(self) -> bool:
        return bool(self.mask & 16)

    def data_type(self) -> T.DataType:
        """The narrowest type that reads every value; numbers when there is none."""
        if not self.has_values:
            return T.DoubleType()
        for bit, kind in ((1, T.LongType()), (2, T.DoubleType()), (4, T.BooleanType()), (8, T.TimestampType())):
            if not self.mask & bit:
                return kind
        return T.StringType()


def profile_text(
    df: DataFrame, names: Sequence[str], dated: Mapping[str, Column] | None = None
) -> tuple[int, dict[str, ColumnProfile]]:
    """Row count and one profile per column, in a single aggregation over all rows.

    ``dated`` marks cells that came from a workbook date cell.
    """
    dated = dated or {}
    cells = F.array(
        *[F.struct(column(name).alias("cell"), dated.get(name, F.lit(False)).alias("dated")) for name in names]
    )
    # One narrow row per cell keeps the generated code small, however wide the table is.
    exploded = df.select(F.posexplode(cells).alias("place", "c"))
    found = (
        exploded.groupBy("place")
        .agg(F.count("*").alias("rows"), F.bit_or(unreadable_as(F.col("c.cell"), F.col("c.dated"))).alias("mask"))
        .collect()
    )
    masks = {names[row["place"]]: row["mask"] for row in found}
    n_rows = found[0]["rows"] if found else 0
    return n_rows, {name: ColumnProfile(masks.get(name, 0)) for name in names}


def apply_types(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Convert text columns to their chosen types; other columns stay."""
    return df.select(
        *[read_as(column(n), types[n]).alias(n) if n in types else column(n) for n in df.columns]
    )


def reconcile_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Profile text columns and convert each to the narrowest type that fits every value."""
    _, profiles = profile_text(df, names)
    return apply_types(df, {name: profile.data_type() for name, profile in profiles.items()})
