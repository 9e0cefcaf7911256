"""Rules for single cells: missing-value tokens and the type a cell's text reads as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean "missing" (the documented pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cell texts that read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# The number texts that pandas reads as whole numbers and as decimals.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def null_if_missing(cell: str) -> Column:
    """NULL for every missing-value token; ``cell`` is the SQL text of a string column."""
    tokens = ", ".join(f"'{token}'" for token in NA_TOKENS)
    return F.expr(f"CASE WHEN {cell} NOT IN ({tokens}) THEN {cell} END")


def null_if_missing_value(cell: Column) -> Column:
    """The same for a value that has no name, like an item of an array."""
    return F.when(~cell.isin(*NA_TOKENS), cell)


def as_integer(cell: Column) -> Column:
    # A failing cast is slow, so only number texts reach it; an overlong one gives NULL.
    return F.when(cell.rlike(_WHOLE), cell.try_cast("bigint"))


def as_double(cell: Column) -> Column:
    return F.when(cell.rlike(_DECIMAL), cell.try_cast("double"))


def as_boolean(cell: Column) -> Column:
    return F.when(cell.isin(*TRUE_TOKENS), F.lit(True)).when(cell.isin(*FALSE_TOKENS), F.lit(False))


def unreadable_as(cell: Column, dated: Column) -> Column:
    """Bit mask of what a cell is not: 1 whole number, 2 number, 4 boolean, 8 date.

    Bit 16 marks that there is a value at all. An absent cell gives 0, so that masks of a
    column combine by OR.
    """
    return (
        F.when(cell.isNull(), 0)
        .when(as_integer(cell).isNotNull(), 16 + 4 + 8)
        .when(cell.rlike(_DECIMAL), 16 + 1 + 4 + 8)
        .when(cell.isin(*TRUE_TOKENS, *FALSE_TOKENS), 16 + 1 + 2 + 8)
        .when(dated, 16 + 1 + 2 + 4)
        .otherwise(16 + 1 + 2 + 4 + 8)
    )


def read_as(cell: Column, data_type: T.DataType) -> Column:
    """Convert cell text to the type chosen for its output column."""
    if isinstance(data_type, T.LongType):
        return as_integer(cell)
    if isinstance(data_type, T.DoubleType):
        return as_double(cell)
    if isinstance(data_type, T.BooleanType):
        return as_boolean(cell)
    if isinstance(data_type, T.TimestampType):
        return cell.try_cast("timestamp")
    return cell


def drop_nan(value: Column, data_type: T.DataType) -> Column:
    """The engine knows one missing value, NULL; NaN counts as missing."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value
