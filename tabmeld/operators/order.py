"""Sorting and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tabmeld.functions.names import column
from tabmeld.operators.spread import with_global_rank


def sort_keys(df: DataFrame, sort_by: Sequence[str] | str, ascending: bool = False) -> list[Column]:
    """Sort expressions: one direction for all keys, missing values last, absent keys ignored."""
    names = [sort_by] if isinstance(sort_by, str) else list(sort_by)
    present = [column(name) for name in names if name in df.columns]
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last() for key in present]


def sort_rows(
    df: DataFrame, sort_by: Sequence[str] | str, ascending: bool = False, ties: Sequence[Column] = ()
) -> DataFrame:
    """Globally sorted rows. ``ties`` settles equal keys and lets a hot key span partitions."""
    keys = sort_keys(df, sort_by, ascending)
    return df.orderBy(*keys, *ties) if keys else df


def rank_rows(
    df: DataFrame,
    sort_by: Sequence[str] | str,
    ascending: bool = False,
    ties: Sequence[Column] = (),
    rank: str = "row_rank",
) -> DataFrame:
    """The 1-based position of every row in the configured sort, as a column."""
    return with_global_rank(df, [*sort_keys(df, sort_by, ascending), *ties], rank)


def top_rows(
    df: DataFrame, k: int, sort_by: Sequence[str] | str, ascending: bool = False, ties: Sequence[Column] = ()
) -> DataFrame:
    """First ``k`` rows of the configured sort; each task keeps only its best ``k``."""
    return sort_rows(df, sort_by, ascending, ties).limit(k)


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows, for a look at the result."""
    return df.limit(n)
