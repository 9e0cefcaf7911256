"""Group aggregation with the reference semantics: nine functions, defaults by type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.functions.cells import drop_nan
from tabmeld.functions.names import column
from tabmeld.operators.union import distinct_keys
from tabmeld.session import materialize

# The aggregate functions that an option may name.
AGGREGATES = ("sum", "mean", "count", "first", "last", "min", "max", "median", "std")
_ARITHMETIC = ("sum", "mean", "median", "std")

# Accuracy of the rank estimates that bracket a median: about 2 / MEDIAN_ACCURACY of a group's
# distinct values lie in the bracket.
MEDIAN_ACCURACY = 5_000

# Spark takes rows that tasks read from a list of files for as small as that list. Where their number is known
# to be above this, joins with their groups follow the groups' written size.
PLAIN_ROWS = 100_000
# Brackets of groups are broadcast up to about this size, and joined beyond it.
BROADCAST_BYTES = 16 << 20

# Size of a median sketch (some 50 kB for a large group). With a probability of 0.99 the rank of its
# median is off by less than a thousandth of the group's values.
SKETCH_SIZE = 4_096
SKETCH_ERROR = 0.001


class AggregateError(ValueError):
    """An aggregate does not fit its column's type."""


def is_summable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def choose_aggregates(
    schema: T.StructType,
    group_by: Sequence[str],
    chosen: Mapping[str, str] | None = None,
    default: str | None = None,
    warnings: list[str] | None = None,
) -> dict[str, str]:
    """One function per value column: the chosen one, else the default, else by type.

    An unknown name falls back to the default with a warning. Arithmetic on a column that
    holds no numbers is refused here, before anything runs.
    """
    if default is not None and default not in AGGREGATES:
        raise AggregateError(f"unknown default aggregate: {default}")
    plan: dict[str, str] = {}
    for field in schema.fields:
        if field.name in group_by:
            continue
        wanted = (chosen or {}).get(field.name)
        if wanted is not None and wanted not in AGGREGATES:
            if warnings is not None:
                warnings.append(f"unknown aggregate '{wanted}' for column '{field.name}'")
            wanted = None
        by_type = "sum" if is_summable(field.dataType) else "first"
        plan[field.name] = wanted or default or by_type
        if plan[field.name] in _ARITHMETIC and not is_summable(field.dataType):
            raise AggregateError(
                f"aggregate '{plan[field.name]}' needs numbers, column '{field.name}' is {field.dataType.simpleString()}"
            )
    return plan


def aggregate_column(name: str, function: str, kind: T.DataType, order: Column | None) -> Column:
    """Aggregate expression for one column; missing values never count."""
    value = drop_nan(column(name), kind)
    if isinstance(kind, T.BooleanType) and function in _ARITHMETIC:
        value = value.cast("bigint")
    if function in ("first", "last"):
        if order is None:
            raise AggregateError(f"'{function}' of column '{name}' needs a row order")
        pick = F.min_by if function == "first" else F.max_by
        out = pick(value, F.when(value.isNotNull(), order))
    elif function == "sum":
        out = F.coalesce(F.sum(value), F.lit(0))
    else:
        out = {
            "mean": F.avg,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "median": F.median,
            "std": F.stddev_samp,
        }[function](value)
    return out.alias(name)


def aggregate_by(
    df: DataFrame,
    group_by: Sequence[str],
    chosen: Mapping[str, str] | None = None,
    default: str | None = None,
    order: Column | None = None,
    null_keys: str = "drop",
    median: str = "auto",
    sort_groups: bool = True,
    skip: Sequence[str] = (),
    n_rows: int | None = None,
    errors: list[str] | None = None,
    warnings: list[str] | None = None,
) -> DataFrame:
    """Aggregate every value column by group.

    Rows with a missing key are dropped unless ``null_keys`` is ``keep``. A key that the
    data lacks is reported in ``errors`` and the rows come back as they are. Without value
    columns the result is the distinct keys. ``order`` decides ``first`` and ``last``;
    columns in ``skip`` (such as the row order itself) are no value columns. ``n_rows`` is
    the number of rows where it is known.

    ``median`` is ``auto`` or ``ranked`` (bracketed, for groups of any size) or ``builtin``
    (Spark's own, which holds a group's distinct values in memory), which are exact, or ``sketch``: a
    value whose rank is off by SKETCH_ERROR, from one pass over the rows.
    """
    absent = [key for key in group_by if key not in df.columns]
    if absent:
        if errors is not None:
            errors.append(f"group_by columns not in data: {absent}")
        return df
    schema = T.StructType([field for field in df.schema.fields if field.name not in skip])
    plan = choose_aggregates(schema, group_by, chosen, default, warnings)
    if not plan:
        return distinct_keys(df, group_by)
    kinds = {field.name: field.dataType for field in schema.fields}
    keys = [column(key) for key in group_by]
    rows = drop_missing_keys(df, group_by) if null_keys == "drop" else df

    medians = [name for name, function in plan.items() if function == "median"]
    apart = [] if median in ("builtin", "sketch") else medians
    sketched = medians if median == "sketch" else []
    totals = [
        _median_of(_sketch(n, kinds[n])).alias(n) if n in sketched else aggregate_column(n, f, kinds[n], order)
        for n, f in plan.items() if n not in apart
    ]
    out = rows.groupBy(*keys).agg(*(totals or [F.count("*").alias("__rows")]))
    if apart:
        medians = bracketed_medians(rows, group_by, apart, n_rows)
        out = _join_keys(out, medians.hint("merge") if _is_long(n_rows) else medians, group_by)
    out = out.select(*keys, *[column(name) for name in plan])
    return out.orderBy(*keys) if sort_groups else out


def _sketch(name: str, kind: T.DataType) -> Column:
    return F.kll_sketch_agg_double(drop_nan(column(name), kind).cast("double"), SKETCH_SIZE)


def _median_of(sketch: Column) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))


def median_sketches(rows: DataFrame, group_by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One mergeable sketch per group and column, to be stored and merged with those of other rows."""
    keys = [column(key) for key in group_by]
    return rows.groupBy(*keys).agg(*[_sketch(name, rows.schema[name].dataType).alias(name) for name in names])


def merge_sketches(sketches: DataFrame, group_by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One sketch per group of several, such as those of several days."""
    keys = [column(key) for key in group_by]
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(column(name)).alias(name) for name in names])


def sketch_medians(sketches: DataFrame, group_by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The median of every sketch; NULL for groups without values."""
    return sketches.select(*[column(key) for key in group_by], *[_median_of(column(name)).alias(name) for name in names])


def drop_missing_keys(df: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present."""
    for field in df.schema.fields:
        if field.name in group_by:
            df = df.where(drop_nan(column(field.name), field.dataType).isNotNull())
    return df


def _is_long(n_rows: int | None) -> bool:
    return n_rows is not None and n_rows > PLAIN_ROWS


def _with_known_size(brackets: DataFrame) -> DataFrame:
    """Brackets, written, with the way to join them that their size asks for."""
    brackets = materialize(brackets, "brackets")
    held = F.lit(64) + F.size("__b") * 64
    for name, kind in brackets.dtypes[:-1]:
        held = held + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    size = brackets.agg(F.sum(held.cast("long"))).first()[0] or 0
    return F.broadcast(brackets) if size <= BROADCAST_BYTES else brackets.hint("merge")


def bracketed_medians(
    rows: DataFrame, group_by: Sequence[str], names: Sequence[str], n_rows: int | None = None
) -> DataFrame:
    """Exact medians of several columns per group, without holding any group in one task.

    Rank estimates with a proven error, combined map-side, give two values between which the
    median must lie. Values below them are only counted; those between are few, are counted per
    distinct value, and the middle ranks are looked up among them. The rows are never the side of a
    join that is broadcast. Brackets of more than PLAIN_ROWS known rows are written first.
    """
    keys = [column(key) for key in group_by]
    marks = [f"__k{i}" for i in range(len(group_by))]
    # Two units of the rank error on either side of the middle.
    around = [0.5 - 2 / MEDIAN_ACCURACY, 0.5 + 2 / MEDIAN_ACCURACY]
    values = [drop_nan(column(n), rows.schema[n].dataType).cast("double").alias(f"__v{i}") for i, n in enumerate(names)]
    slim = rows.select(*[key.alias(mark) for key, mark in zip(keys, marks, strict=True)], *values)
    bracket = [
        F.struct(F.percentile_approx(f"__v{i}", around, MEDIAN_ACCURACY).alias("ends"), F.count(f"__v{i}").alias("n"))
        for i in range(len(names))
    ]
    brackets = slim.groupBy(*marks).agg(F.array(*bracket).alias("__b"))
    paired = brackets.toDF(*[f"{mark}_b" for mark in marks], "__b")
    if _is_long(n_rows):
        paired = _with_known_size(paired)
    same = [F.col(mark).eqNullSafe(F.col(f"{mark}_b")) for mark in marks]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.col("__b")[i]["n"].alias("n"),
                # Values below the bracket all count as one.
                F.when(F.col(f"__v{i}") >= F.col("__b")[i]["ends"][0], F.col(f"__v{i}")).alias("value"),
                (F.col(f"__v{i}") <= F.col("__b")[i]["ends"][1]).alias("inside"),
            )
            for i in range(len(names))
        ]
    )
    counted = (
        slim.join(paired, same, "left")  # every row has its bracket
        .select(*marks, F.inline(F.filter(cells, lambda c: c["inside"])))
        .groupBy(*marks, "place", "n", "value")
        .agg(F.count("*").alias("times"))
    )
    order = Window.partitionBy(*marks, "place").orderBy(F.col("value").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    covers = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("times") < rank)
    middle = (F.max(F.when(covers(low), F.col("value"))) + F.max(F.when(covers(high), F.col("value")))) / 2
    medians = ranked.groupBy(*marks, "place").agg(middle.alias("median"))
    wide = [F.max(F.when(F.col("place") == i, F.col("median"))).alias(name) for i, name in enumerate(names)]
    return medians.groupBy(*marks).agg(*wide)


def _join_keys(left: DataFrame, right: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Left join on the group keys in which a missing key equals a missing key."""
    renamed = right.toDF(*[f"__k{i}" for i in range(len(group_by))], *right.columns[len(group_by) :])
    same = [column(key).eqNullSafe(F.col(f"__k{i}")) for i, key in enumerate(group_by)]
    return left.join(renamed, same, "left").drop(*[f"__k{i}" for i in range(len(group_by))])


def is_tall(df: DataFrame, threshold: int | None) -> bool:
    """Strictly more rows than the threshold; counted where the rows are."""
    return threshold is not None and df.count() > threshold


def aggregate_if_tall(
    df: DataFrame,
    group_by: Sequence[str] | None,
    threshold: int | None,
    chosen: Mapping[str, str] | None = None,
    n_rows: int | None = None,
    **options,
) -> DataFrame:
    """Aggregate only above the row threshold, then keep the keys and the chosen columns."""
    if not group_by or threshold is None:
        return df
    tall = n_rows > threshold if n_rows is not None else is_tall(df, threshold)
    if not tall or any(key not in df.columns for key in group_by):
        return aggregate_by(df, group_by, chosen, n_rows=n_rows, **options) if tall else df
    # Default aggregates of other columns would be thrown away again, so they are not computed.
    skip = list(options.pop("skip", ()))
    kept = [name for name in (chosen or {}) if name in df.columns and name not in group_by and name not in skip]
    if not kept:
        keys = [column(key) for key in group_by]
        if all(name in group_by or name in skip for name in df.columns):
            return distinct_keys(df, group_by)
        rows = drop_missing_keys(df, group_by) if options.get("null_keys", "drop") == "drop" else df
        return rows.select(*keys).dropDuplicates()
    spare = [name for name in df.columns if name not in kept and name not in group_by]
    return aggregate_by(df, group_by, chosen, skip=spare, n_rows=n_rows, **options)
