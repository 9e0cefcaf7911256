"""Union by name, column projection and column merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmeld.functions.names import NameRules, clean_header, column, header_changes

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """One type for same-named columns: equal types stay, numbers widen, else text."""
    kinds = {t for t in types if not isinstance(t, T.NullType)}
    if len(kinds) == 1:
        return kinds.pop()
    if not kinds:
        return T.DoubleType()
    if all(isinstance(t, _INTEGRAL) for t in kinds):
        return T.LongType()
    if all(isinstance(t, _NUMERIC) for t in kinds):
        return T.DoubleType()
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) for t in kinds):
        return T.TimestampType()
    return T.StringType()


def union_by_name(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL BY NAME with NULL fill; columns in order of first appearance.

    Types are settled per name before the union, so no implicit coercion takes place. No
    input gives an empty table, one input is returned as it is.
    """
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    if len(parts) == 1:
        return parts[0]
    types: dict[str, list[T.DataType]] = {}
    for part in parts:
        for field in part.schema.fields:
            types.setdefault(field.name, []).append(field.dataType)
    target = {name: common_type(found) for name, found in types.items()}
    aligned = [project(part, target) for part in parts]
    while len(aligned) > 1:
        aligned = [
            aligned[i].union(aligned[i + 1]) if i + 1 < len(aligned) else aligned[i] for i in range(0, len(aligned), 2)
        ]
    return aligned[0]


def project(df: DataFrame, target: Mapping[str, T.DataType]) -> DataFrame:
    """Exactly the target columns, in order: absent ones as NULL, the rest in the target type."""
    have = {field.name: field.dataType for field in df.schema.fields}
    out = []
    for name, kind in target.items():
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        elif have[name] == kind:
            out.append(column(name))
        else:
            out.append(column(name).try_cast(kind).alias(name))
    return df.select(*out)


def reindex(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep the wanted columns in that order; absent ones come as NULL."""
    have = {field.name: field.dataType for field in df.schema.fields}
    return project(df, {name: have.get(name, T.DoubleType()) for name in wanted})


def empty_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that hold no value in any row."""
    have = set(df.columns)
    seen = df.agg(*[F.count(column(n)).alias(f"n{i}") if n in have else F.lit(0).cast("bigint").alias(f"n{i}")
                    for i, n in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("n")) for i, n in enumerate(wanted)])
    return seen.select(F.inline(pairs)).where("n = 0").select("column_name").orderBy("column_name")


def merge_two_columns(df: DataFrame, first: str, second: str, keep: str) -> DataFrame:
    """Keep one of two columns, fill its gaps from the other, drop the other."""
    other = second if keep == first else first
    if keep not in df.columns or other not in df.columns:
        return df
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    kind = common_type([kinds[keep], kinds[other]])
    filled = F.coalesce(column(keep).cast(kind), column(other).cast(kind)).alias(keep)
    return df.select(*[filled if name == keep else column(name) for name in df.columns if name != other])


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})


def order_columns(df: DataFrame, configured: Sequence[str]) -> DataFrame:
    """Configured columns first, in configured order; the others follow."""
    first = [name for name in configured if name in df.columns]
    return df.select(*[column(name) for name in [*first, *(n for n in df.columns if n not in first)]])


def merge_duplicate_names(
    cells: Sequence[tuple[str, Column]], on_duplicate: str = "coalesce"
) -> list[Column]:
    """One column per name; repeats are merged left to right, or refused."""
    by_name: dict[str, list[Column]] = {}
    for name, value in cells:
        by_name.setdefault(name, []).append(value)
    repeated = sorted(name for name, values in by_name.items() if len(values) > 1)
    if repeated and on_duplicate == "error":
        raise ValueError(f"columns share a name after cleaning: {repeated}")
    return [
        (F.coalesce(*values) if len(values) > 1 else values[0]).alias(name) for name, values in by_name.items()
    ]


def normalize_columns(
    df: DataFrame, rules: NameRules | None = None, on_duplicate: str = "coalesce"
) -> DataFrame:
    """Apply the header rules to one DataFrame's own column names."""
    names, _ = cleaned_names(df, rules or NameRules())
    values = [(new, F.col(f"_{i}")) for i, new in enumerate(names)]
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    return numbered.select(*merge_duplicate_names(values, on_duplicate))


def cleaned_names(df: DataFrame, rules: NameRules) -> tuple[list[str], list[str]]:
    """Clean names of a DataFrame, and the rename log."""
    raw = F.array(*[F.lit(name) for name in df.columns])
    one = df.sparkSession.range(1).select(raw.alias("raw")).withColumn("clean", clean_header(F.col("raw"), rules))
    row = one.select("clean", header_changes(F.col("raw"), F.col("clean")).alias("changes")).first()
    return list(row["clean"]), list(row["changes"])


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key rows; missing keys count as a value here."""
    return df.select(*[column(k) for k in keys]).dropDuplicates()
