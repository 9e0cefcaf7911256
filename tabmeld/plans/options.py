"""Merge options: a plain dict in, one resolved set per dataset out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.functions.names import NameRules

_OVERRIDES = (
    "group_by", "max_rows_before_aggregate", "aggregate_columns", "aggregate_default", "sort_by", "sort_ascending",
    "conflict_policy",
)

# The values that an option may have; ``conflict_policy`` may also be a map of names.
CHOICES = {
    "conflict_policy": ("fail", "keep_first", "keep_second"),
    "on_duplicate": ("coalesce", "error"),
    "preflight": ("abort", "report"),
    "null_keys": ("drop", "keep"),
    "median": ("auto", "builtin", "ranked", "sketch"),
}


def _check(key: str, value: Any, where: str = "") -> None:
    if key in CHOICES and value not in CHOICES[key] and not (key == "conflict_policy" and isinstance(value, Mapping)):
        raise ValueError(f"option {where}{key} must be one of {', '.join(CHOICES[key])}: {value!r}")


def _names(value: Any) -> list[str]:
    if value is None or value == "":
        return []
    items = value if isinstance(value, (list, tuple)) else [value]
    return [str(item).strip() for item in items if item]


def _whole(value: Any) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


@dataclass(frozen=True)
class DatasetOptions:
    """What one dataset's merge does."""

    columns: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    max_rows_before_aggregate: int | None = None
    aggregate_columns: Mapping[str, str] = field(default_factory=dict)
    aggregate_default: str | None = None
    sort_by: tuple[str, ...] = ()
    sort_ascending: bool = False
    conflict_policy: str | Mapping[str, str] = "fail"

    def required(self) -> list[str]:
        """Columns that every file must have."""
        return sorted({*self.columns, *self.group_by, *self.aggregate_columns, *self.sort_by})


@dataclass(frozen=True)
class MergeOptions:
    """All options of a run; ``subdirectories`` holds per-dataset overrides."""

    base: DatasetOptions = DatasetOptions()
    subdirectories: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    subdir_include: tuple[str, ...] | None = None
    subdir_exclude: tuple[str, ...] = ()
    large_file_threshold_mb: float | None = None
    rules: NameRules = NameRules()
    validate_structure: bool = True
    on_duplicate: str = "coalesce"
    preflight: str = "abort"
    null_keys: str = "drop"
    median: str = "auto"
    stage: bool = False
    parallel_datasets: int = 4
    together: bool | None = None

    @classmethod
    def from_dict(cls, given: Mapping[str, Any] | None = None) -> MergeOptions:
        """Read a dict with the documented keys, with the same coercions as an options file.

        ValueError for a value that an option does not know.
        """
        given = dict(given or {})
        for key in CHOICES:
            if key in given:
                _check(key, given[key])
        threshold = given.get("large_file_threshold_mb")
        try:
            threshold = float(threshold) if threshold is not None and float(threshold) > 0 else None
        except (TypeError, ValueError):
            threshold = None
        max_rows = _whole(given.get("max_rows_before_aggregate"))
        rules = NameRules(
            enabled=given.get("clean_columns", True),
            aliases={str(k): str(v) for k, v in (given.get("column_aliases") or {}).items()},
            patterns=tuple(
                (str(rule["base"]), str(rule["canonical"]))
                for rule in given.get("column_canonical_patterns") or ()
                if "base" in rule and "canonical" in rule
            ),
        ).with_switches(given.get("column_cleaning_options"))
        include = given.get("subdir_include")
        overrides = given.get("subdirectories") or given.get("subdirectory_config") or {}
        extra = {
            key: given[key]
            for key in ("validate_structure", "on_duplicate", "preflight", "null_keys",
                        "median", "stage", "parallel_datasets", "together")
            if key in given
        }
        for name, own in overrides.items():
            if isinstance(own, Mapping) and "conflict_policy" in own:
                _check("conflict_policy", own["conflict_policy"], f"subdirectories.{name}.")
        return cls(
            base=DatasetOptions(
                columns=tuple(_names(given.get("columns"))),
                group_by=tuple(_names(given.get("group_by"))),
                max_rows_before_aggregate=max_rows if max_rows is None or max_rows >= 1 else None,
                aggregate_columns=_functions(given.get("aggregate_columns")),
                aggregate_default=given.get("aggregate_default") or None,
                sort_by=tuple(_names(given.get("sort_by"))),
                sort_ascending=bool(given.get("sort_ascending") or False),
                conflict_policy=given.get("conflict_policy", "fail"),
            ),
            subdirectories={str(k): dict(v) for k, v in overrides.items() if isinstance(v, Mapping)},
            subdir_include=None if include is None else tuple(_names(include)),
            subdir_exclude=tuple(_names(given.get("subdir_exclude"))),
            large_file_threshold_mb=threshold,
            rules=rules,
            **extra,
        )

    def for_dataset(self, dataset: str) -> DatasetOptions:
        """``columns`` is overridden when not empty, the other keys whenever they are given."""
        own = self.subdirectories.get(dataset, {})
        given = {key: own[key] for key in _OVERRIDES if key in own}
        picked = {key: given.get(key, getattr(self.base, key)) for key in _OVERRIDES}
        return DatasetOptions(
            columns=tuple(_names(own.get("columns"))) or self.base.columns,
            group_by=tuple(_names(picked["group_by"])),
            max_rows_before_aggregate=_whole(picked["max_rows_before_aggregate"]),
            aggregate_columns=_functions(picked["aggregate_columns"]),
            aggregate_default=picked["aggregate_default"],
            sort_by=tuple(_names(picked["sort_by"])),
            sort_ascending=bool(picked["sort_ascending"]),
            conflict_policy=picked["conflict_policy"],
        )

    def required_columns(self, dataset: Column) -> Column:
        """Required columns of each row's dataset, as an array literal per override."""
        out = _array(self.base.required())
        for name in self.subdirectories:
            out = F.when(dataset == name, _array(self.for_dataset(name).required())).otherwise(out)
        return out


def _functions(value: Any) -> dict[str, str]:
    return {str(k): str(v).lower() for k, v in value.items()} if isinstance(value, Mapping) else {}


def _array(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in names]).cast("array<string>")


def options_table(spark: SparkSession, options: MergeOptions, datasets: Sequence[str]) -> DataFrame:
    """The resolved options, one row per dataset."""
    rows = []
    for name in datasets:
        own = options.for_dataset(name)
        rows.append(
            (name, list(own.columns), list(own.group_by), own.max_rows_before_aggregate, dict(own.aggregate_columns),
             own.aggregate_default, list(own.sort_by), own.sort_ascending, own.required())
        )
    return spark.createDataFrame(
        rows,
        "dataset string, columns array<string>, group_by array<string>, max_rows_before_aggregate bigint, "
        "aggregate_columns map<string,string>, aggregate_default string, sort_by array<string>, "
        "sort_ascending boolean, required array<string>",
    )
