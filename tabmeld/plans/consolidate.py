"""End-to-end consolidation of a root folder: one lazy result per dataset.

Stages: file catalogue, head probe, header cleaning, pre-flight, conflict and variant
resolution, then per dataset a union of one scan per dialect, typed, optionally aggregated,
sorted and put in column order. File facts and paths stay in DataFrames; the driver sees distinct
layouts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, MutableMapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.functions.cells import read_as, unreadable_as
from tabmeld.functions.names import clean_header, column, header_changes, strip
from tabmeld.operators import layout
from tabmeld.operators.aggregate import AggregateError, aggregate_if_tall
from tabmeld.operators.order import sort_rows
from tabmeld.operators.spread import hot_join, salted_left_join
from tabmeld.operators.typing import ColumnProfile, profile_text
from tabmeld.operators.union import order_columns, union_by_name
from tabmeld.plans.options import DatasetOptions, MergeOptions
from tabmeld.session import configure, materialize
from tabmeld.sources.catalog import check_root, list_files, normal_root, select_datasets, supported_files
from tabmeld.sources.probe import probe_catalog
from tabmeld.sources.scan import PROVENANCE, Dialect, cell, good_rows, rejected_rows, scan_csv, scan_files, scan_workbooks

ROW_ORDER = "__row_order"

STATUS_SCHEMA = "dataset string, status string, n_files bigint, n_merged bigint, n_rows bigint, error string"
DIALECT_KEYS = ("charset", "sep", "quote", "skip_lead", "multiline")
LAYOUT_KEYS = ("file_format", *DIALECT_KEYS, "header", "clean")

# From so many datasets of CSV files on, they are read by one scan per dialect, unless told otherwise.
TOGETHER = 16

# Files with their headers' places are broadcast up to about this size, and joined beyond it.
BROADCAST_BYTES = 16 << 20


class Plans(MutableMapping):
    """DataFrames by dataset, each planned when somebody asks for it, so that many datasets cost no plans."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], DataFrame]] = {}
        self._planned: dict[str, DataFrame] = {}

    def plan(self, name: str, build: Callable[[], DataFrame]) -> None:
        self._known[name] = build
        self._planned.pop(name, None)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            self._planned[name] = self._known[name]()
        return self._planned[name]

    def __setitem__(self, name: str, value: DataFrame) -> None:
        self.plan(name, lambda: value)

    def __delitem__(self, name: str) -> None:
        del self._known[name]
        self._planned.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)

    def __len__(self) -> int:
        return len(self._known)


@dataclass
class Consolidation:
    """Everything a run produced. DataFrames are lazy unless noted in the run itself."""

    success: bool
    outputs: MutableMapping[str, DataFrame] = field(default_factory=Plans)
    ordered: MutableMapping[str, DataFrame] = field(default_factory=Plans)
    status: list[tuple] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    files: DataFrame | None = None
    headers: DataFrame | None = None
    name_changes: DataFrame | None = None
    renames: DataFrame | None = None
    missing_required: DataFrame | None = None
    unread: DataFrame | None = None
    # Errors about single files, beyond the one line per dataset that ``errors`` holds.
    more_errors: int = 0
    rejects: DataFrame | None = None
    _per_file: Callable[[Callable[[DataFrame], DataFrame]], DataFrame] | None = None

    @property
    def n_errors(self) -> int:
        """Number of errors, every file counted."""
        return len(self.errors) + self.more_errors

    def findings(self, spark: SparkSession) -> DataFrame:
        """(dataset, file_name, level, message): one row per file that was not read or lacks columns."""
        parts = [spark.createDataFrame([], "dataset string, file_name string, level string, message string")]
        if self.unread is not None:
            message = F.concat(F.lit("not read: "), F.col("error"))
            parts.append(self.unread.select("dataset", "file_name", F.lit("warning").alias("level"), message.alias("message")))
        if self.missing_required is not None:
            message = F.concat(F.lit("missing required columns: "), F.array_join("missing", ", "))
            name = F.element_at(F.split("file_path", "/"), -1)
            parts.append(
                self.missing_required.select("dataset", name.alias("file_name"), F.lit("error").alias("level"), message.alias("message"))
            )
        return union_by_name(spark, parts)

    @cached_property
    def issues(self) -> DataFrame:
        """Columns that files have beyond their dataset's reference layout, with hints."""
        return self._per_file(lambda layouts: layout.structure_issues(layouts, allow_missing=True))

    @cached_property
    def extra_columns(self) -> DataFrame:
        """(dataset, column, file) for every column that the reference layout lacks."""
        return self._per_file(layout.extra_column_files).drop("file_seq")

    def status_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.status, STATUS_SCHEMA)


@dataclass(frozen=True)
class LayoutGroup:
    """Files of one dataset that share dialect, header and column mapping."""

    dataset: str
    layout_id: str
    file_format: str
    dialect: Dialect
    header: tuple[str, ...]
    clean: tuple[str, ...]
    columns: tuple[str, ...]
    folds: tuple[tuple[str, str], ...]
    n_files: int
    lead_seq: str
    lead_path: str
    reference: str
    first: str


def describe_files(probes: DataFrame, options: MergeOptions) -> DataFrame:
    """Readable files with their clean header and the layout they belong to.

    A layout is everything that decides how a file is read and mapped, so files of one
    layout are read by one scan.
    """
    # Names are compared trimmed everywhere, so they are trimmed here once; positions stay.
    clean = F.transform(clean_header(F.col("header"), options.rules), strip)
    described = probes.where("status = 'ok'").withColumn("clean", clean)
    return described.select(
        "dataset", "file_path", "file_seq", "size", *LAYOUT_KEYS,
        F.array_distinct("clean").alias("columns"),
        F.sha2(F.to_json(F.struct(*LAYOUT_KEYS)), 256).alias("layout_id"),
    )


def consolidate(spark: SparkSession, root: str, options: Mapping[str, Any] | MergeOptions | None = None) -> Consolidation:
    """Merge every dataset below ``root``; see :class:`Consolidation` for what comes back."""
    configure(spark)
    if not isinstance(options, MergeOptions):
        options = MergeOptions.from_dict(options)
    try:
        listing = list_files(spark, root)
    except AnalysisException:
        return Consolidation(success=False, errors=check_root(spark, root))
    chosen = select_datasets(listing, options.subdir_include, options.subdir_exclude)
    probes = probe_catalog(supported_files(chosen), options.large_file_threshold_mb)
    run = Consolidation(success=True, files=probes)
    files = describe_files(probes, options)
    run.headers = files.select("dataset", "file_path", "file_seq", "columns")
    changes = header_changes(F.col("header"), F.col("clean"))
    run.name_changes = files.select("dataset", "file_path", F.explode(changes).alias("change"))

    datasets, n_csv = _dataset_counts(chosen, probes)
    if not datasets and listing.isEmpty():
        return Consolidation(success=False, errors=check_root(spark, root))
    if not _preflight(run, options, datasets):
        run.status = [(name, "aborted", n_files, 0, None, None) for name, (n_files, _) in datasets.items()]
        return run

    merging = []
    for name, (n_files, n_ok) in datasets.items():
        if n_files == 0:
            run.status.append((name, "no_files", 0, 0, None, None))
        elif n_files == 1:
            run.status.append((name, "skipped_single_file", 1, 0, None, None))
        elif n_ok == 0:
            run.status.append((name, "failed", n_files, 0, None, "no readable file"))
        else:
            merging.append(name)
    if any(n_ok < n_files for n_files, n_ok in datasets.values()):
        run.unread = probes.where("status <> 'ok'").select("dataset", "file_name", "error")
        first = F.min(F.struct("file_name", "error")).alias("first")
        # One line per dataset; ``findings`` has a row per file.
        for row in run.unread.groupBy("dataset").agg(F.count("*").alias("n"), first).orderBy("dataset").collect():
            text = f"{row['n']} file(s) not read, first: {row['first']['file_name']}: {row['first']['error']}"
            run.warnings.append((row["dataset"], text))
    if not merging:
        return run

    if len(merging) < len(datasets):
        files = _of_datasets(files, merging)
    groups = _layout_groups(files)
    groups, renames, refused = _resolve(spark, run, files, groups, options)
    for name, message in refused.items():
        run.errors.append(message)
        run.status.append((name, "failed", datasets[name][0], 0, None, message))
    merging = [name for name in merging if name not in refused]
    folders = {name: _literal_path(f"{normal_root(root)}/{name}") for name in merging if _one_scan(groups[name], n_csv[name])}

    def build(name: str):
        of_dataset = files.where(F.col("dataset") == name)
        return _build_dataset(spark, name, groups[name], of_dataset, folders.get(name), renames.get(name, {}), options)

    plain = [name for name in merging if all(g.file_format == "csv" for g in groups[name])]
    together = plain if options.together or (options.together is None and len(plain) >= TOGETHER) else []
    apart = [name for name in merging if name not in set(together)]
    with ThreadPoolExecutor(max_workers=max(1, options.parallel_datasets)) as pool:
        built = dict(zip(apart, pool.map(build, apart)))
    rejects = []
    if together:
        both, over = _build_together(spark, {name: groups[name] for name in together}, files, renames, options)
        built |= both
        rejects.append(over)
    for name in merging:
        part = built[name]
        run.errors.extend(part.errors)
        run.warnings.extend((name, text) for text in part.warnings)
        failed = part.result is None
        run.status.append(
            (name, "failed" if failed else "merged", datasets[name][0], 0 if failed else datasets[name][1],
             part.n_rows, "; ".join(part.errors) or None)
        )
        if not failed:
            run.ordered.plan(name, part.result)
            run.outputs.plan(name, lambda name=name: run.ordered[name].drop(ROW_ORDER))
        rejects += part.rejects
    run.rejects = union_by_name(spark, rejects) if rejects else None
    run.status.sort(key=lambda row: row[0])
    return run


def _of_datasets(rows: DataFrame, names: Iterable[str], how: str = "left_semi") -> DataFrame:
    """Rows of the named datasets, or of all others; a join, as an expression per name is slow for many."""
    named = rows.sparkSession.createDataFrame([(name,) for name in names], "dataset string")
    return rows.join(named, "dataset", how)


def _dataset_counts(chosen: DataFrame, probes: DataFrame) -> tuple[dict[str, tuple[int, int]], dict[str, int]]:
    """Per dataset (supported files, readable files), and the CSV files of its whole folder.

    A folder with files that Spark's own readers leave out has -1 of them.
    """
    listed = (F.col("size") > 0) & F.col("file_name").endswith(".csv")
    n_csv = F.when(F.max(listed & ~F.col("visible")), -1).otherwise(F.count_if(listed))
    every = chosen.groupBy("dataset").agg(n_csv.alias("n_csv"))
    counts = probes.groupBy("dataset").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") == "ok").alias("n_ok")
    )
    rows = every.join(counts, "dataset", "left").na.fill(0).orderBy("dataset").collect()
    return {r["dataset"]: (r["n_files"], r["n_ok"]) for r in rows}, {r["dataset"]: r["n_csv"] for r in rows}


def _preflight(run: Consolidation, options: MergeOptions, datasets: Mapping[str, tuple[int, int]]) -> bool:
    """Every readable file must have every required column, or nothing is merged."""
    required = {name: options.for_dataset(name).required() for name in datasets}
    if not any(required.values()):
        return True
    lacking = layout.missing_required(run.headers, options.required_columns(F.col("dataset")))
    run.missing_required = lacking
    unreadable = [name for name, (_, n_ok) in datasets.items() if required[name] and n_ok == 0]
    run.errors += [f"dataset '{name}': no readable file, required columns cannot be checked" for name in unreadable]
    # One line per dataset; ``findings`` has a row per file.
    first = F.min_by(F.struct("file_path", "missing"), "file_seq").alias("first")
    for row in lacking.groupBy("dataset").agg(F.count("*").alias("n"), first).orderBy("dataset").collect():
        file_name = row["first"]["file_path"].rsplit("/", 1)[-1]
        run.errors.append(
            f"dataset '{row['dataset']}': {row['n']} file(s) lack required columns, first '{file_name}': {row['first']['missing']}"
        )
        run.more_errors += row["n"] - 1
    run.success = not run.errors or options.preflight != "abort"
    return run.success


def _layout_groups(files: DataFrame) -> dict[str, list[LayoutGroup]]:
    """Distinct layouts per dataset, in the order in which their files enter the union.

    The reference file (most columns, then first) leads, and the first file takes its place.
    """
    kept = [F.any_value(name).alias(name) for name in (*LAYOUT_KEYS, "columns")]
    lead = F.min(F.struct("file_seq", "file_path")).alias("lead")
    rows = files.groupBy("dataset", "layout_id").agg(*kept, F.count("*").alias("n_files"), lead).collect()
    datasets: dict[str, list] = {}
    for row in rows:
        datasets.setdefault(row["dataset"], []).append(row)
    starts, shared = {}, []
    for name, found in datasets.items():
        reference = min(found, key=lambda row: (-len(row["columns"]), row["lead"]["file_seq"]))
        first = min(found, key=lambda row: row["lead"]["file_seq"])
        starts[name] = (reference["lead"]["file_seq"], first["lead"]["file_seq"])
        if first is not reference and first["n_files"] > 1:
            shared.append(first)
    after_first = {}
    if shared:
        # Layouts that hold the first file and others: their next file decides their place.
        leads = files.sparkSession.createDataFrame(
            [(row["dataset"], row["layout_id"], row["lead"]["file_path"]) for row in shared],
            "dataset string, layout_id string, lead string",
        )
        rest = files.join(leads, ["dataset", "layout_id"]).where("file_path <> lead").groupBy("dataset", "layout_id")
        for row in rest.agg(F.min("file_seq").alias("seq")).collect():
            after_first[row["dataset"], row["layout_id"]] = row["seq"]

    out: dict[str, list[LayoutGroup]] = {}
    for name, found in sorted(datasets.items()):
        reference, first = starts[name]

        def place(row) -> str:
            seq = row["lead"]["file_seq"]
            if seq == reference:
                return ""
            if seq == first:
                return min(reference, after_first.get((name, row["layout_id"]), reference))
            return seq

        out[name] = [_layout_group(row, reference, first) for row in sorted(found, key=place)]
    return out


def _layout_group(row, reference: str, first: str) -> LayoutGroup:
    csv = row["file_format"] == "csv"
    return LayoutGroup(
        dataset=row["dataset"],
        layout_id=row["layout_id"],
        file_format=row["file_format"],
        dialect=Dialect(*[row[k] for k in DIALECT_KEYS]) if csv else Dialect(),
        header=tuple(row["header"]),
        clean=tuple(row["clean"]),
        columns=tuple(row["columns"]),
        folds=(),
        n_files=row["n_files"],
        lead_seq=row["lead"]["file_seq"],
        lead_path=row["lead"]["file_path"],
        reference=reference,
        first=first,
    )


def _layout_table(spark: SparkSession, groups: Iterable[LayoutGroup]) -> DataFrame:
    """Layouts as headers: the first file of each stands for all of its files."""
    rows = [(g.dataset, g.lead_path, g.lead_seq, list(g.columns), g.n_files, g.layout_id) for g in groups]
    return spark.createDataFrame(
        rows, "dataset string, file_path string, file_seq string, columns array<string>, n_files bigint, layout_id string"
    )


def _has_variants(groups: Sequence[LayoutGroup]) -> bool:
    names = {name.strip() for group in groups for name in group.columns}
    return any(name and (name + "s" in names or name + "es" in names) for name in names)


def _resolve(
    spark: SparkSession, run: Consolidation, files: DataFrame, groups: dict[str, list[LayoutGroup]], options: MergeOptions
):
    """Settle same-file conflicts and cross-file variants; report structure issues.

    All of it works on distinct layouts weighted by their number of files.
    """
    refused: dict[str, str] = {}
    renames: dict[str, dict[str, str]] = {}
    for name, found in groups.items():
        doubled = [g for g in found if len(g.clean) > len(g.columns)]
        if doubled and options.on_duplicate == "error":
            refused[name] = f"columns share a name after cleaning in {doubled[0].lead_path}"
    variants = [g for found in groups.values() if options.validate_structure and _has_variants(found) for g in found]
    if variants:
        table = _layout_table(spark, variants)
        # Datasets with one policy are settled together.
        chosen: dict[str, tuple[str | Mapping[str, str], list[str]]] = {}
        for name in dict.fromkeys(g.dataset for g in variants):
            policy = options.for_dataset(name).conflict_policy
            chosen.setdefault(repr(policy), (policy, []))[1].append(name)
        changed = {}
        for policy, names in chosen.values():
            part = _of_datasets(table, names)
            if policy == "fail":
                first = F.min_by(F.struct("file_path", "name_a", "name_b"), "file_seq").alias("first")
                for row in layout.same_file_conflicts(part).groupBy("dataset").agg(first).collect():
                    found = row["first"]
                    refused[row["dataset"]] = (
                        f"Same-file column conflict in {found['file_path'].rsplit('/', 1)[-1]} "
                        f"(both '{found['name_a']}' and '{found['name_b']}')"
                    )
                continue
            for row in layout.resolve_conflicts(part, policy).where("size(folds) > 0 OR refused IS NOT NULL").collect():
                if row["refused"] is not None:
                    refused[row["dataset"]] = f"dataset '{row['dataset']}', {row['file_path'].rsplit('/', 1)[-1]}: {row['refused']}"
                changed[row["dataset"], row["layout_id"]] = row
        groups = {
            name: [
                replace(
                    g, columns=tuple(changed[name, g.layout_id]["columns"]),
                    folds=tuple((f["kept"], f["dropped"]) for f in changed[name, g.layout_id]["folds"]),
                ) if (name, g.layout_id) in changed else g
                for g in found
            ]
            for name, found in groups.items()
        }
        table = _layout_table(spark, [g for found in groups.values() for g in found])
        table = _of_datasets(table, refused, "left_anti") if refused else table
        for row in layout.canonical_renames(table, weight="n_files").collect():
            renames.setdefault(row["dataset"], {})[row["from_name"]] = row["to_name"]
    run.renames = spark.createDataFrame(
        [(name, old, new) for name, found in renames.items() for old, new in sorted(found.items())],
        "dataset string, from_name string, to_name string",
    )
    final = [
        replace(g, columns=tuple(dict.fromkeys(renames.get(name, {}).get(c, c) for c in g.columns)))
        for name, found in groups.items() if name not in refused for g in found
    ]
    table = _layout_table(spark, final)
    of_layout = files.select("dataset", "layout_id", "file_path", "file_seq")
    keyed = table.select("dataset", F.col("file_path").alias("lead"), "layout_id")

    def per_file(find: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Findings about a layout's first file, repeated for each of its files."""
        led = find(table).withColumnRenamed("file_path", "lead").drop("file_seq").join(keyed, ["dataset", "lead"])
        return led.join(of_layout, ["dataset", "layout_id"]).drop("lead", "layout_id")

    run.headers = of_layout.join(table.select("dataset", "layout_id", "columns"), ["dataset", "layout_id"]).drop("layout_id")
    run._per_file = per_file
    return groups, renames, refused


def _moved(seq: Column, reference: Column, first: Column) -> Column:
    """File order of the union: the reference file leads and the first file takes its place."""
    return F.when(seq == reference, F.lit("")).when(seq == first, reference).otherwise(seq)


def _one_scan(groups: Sequence[LayoutGroup], n_csv: int) -> bool:
    """Whether Spark's own reader can read a dataset's folder: all its CSV files have one header and
    a dialect that it splits by line. All others are read by ranges, with their paths as rows."""
    found = [group for group in groups if group.file_format == "csv"]
    if len(found) != 1 or found[0].n_files != n_csv:
        return False
    return found[0].dialect.charset != "UTF-16" and not found[0].dialect.multiline


def _literal_path(path: str) -> str:
    """Path in which glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


@dataclass
class _Built:
    # Plans the finished table; None if the dataset failed.
    result: Callable[[], DataFrame] | None
    n_rows: int | None
    rejects: list[DataFrame]
    errors: list[str]
    warnings: list[str]


def _places(group: LayoutGroup, renames: Mapping[str, str]) -> dict[str, list[int]]:
    """Final name to the places of its cells, the preferred one first, in layout order."""
    own: dict[str, list[int]] = {}
    for place, name in enumerate(group.clean):
        own.setdefault(name, []).append(place)
    for kept, dropped in group.folds:
        own[kept] = own[kept] + own.pop(dropped)
    out: dict[str, list[int]] = {}
    for name, places in own.items():
        out.setdefault(renames.get(name, name), []).extend(places)
    return out


def _join_places(
    rows: DataFrame, files: DataFrame, names: Sequence[str], members: Sequence[tuple[LayoutGroup, Mapping[str, list[int]]]]
) -> DataFrame:
    """Add ``width`` and ``places`` of each row's file: per final name the places of its cells."""
    at = {name: i for i, name in enumerate(names)}
    pairs = [
        (g.layout_id, len(g.header), [(at[name], place) for name, found in places.items() if name in at for place in found])
        for g, places in members
    ]
    table = rows.sparkSession.createDataFrame(
        pairs, "layout_id string, width int, pairs array<struct<name: int, place: int>>"
    )

    def of_name(i: Column) -> Column:
        return F.transform(F.filter("pairs", lambda pair: pair["name"] == i), lambda pair: pair["place"])

    every = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), of_name)
    known = files.select("layout_id", F.col("file_path").alias("_file")).join(table, "layout_id")
    known = materialize(known.select("_file", "width", every.alias("places")), "places")
    size = sum(g.n_files for g, _ in members) * (256 + 32 * len(names))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), "_file")
    return salted_left_join(rows, known.hint("merge"), ["_file"], ["_row"])


def _first_value(places: Sequence[Any], text: Callable, dated: Callable | None) -> tuple[Column, Column]:
    """The first value at the places, and whether it comes from a date cell."""
    if not places:
        return F.lit(None).cast("string"), F.lit(False)
    is_date = F.lit(False)
    for place in reversed(places if dated else []):
        is_date = F.when(text(place).isNotNull(), dated(place)).otherwise(is_date)
    return F.coalesce(*[text(place) for place in places]), is_date


def _build_dataset(
    spark: SparkSession,
    name: str,
    groups: list[LayoutGroup],
    files: DataFrame,
    folder: str | None,
    renames: Mapping[str, str],
    options: MergeOptions,
) -> _Built:
    own = options.for_dataset(name)
    placed = [(group, _places(group, renames)) for group in groups]
    names = list(own.columns) or list(dict.fromkeys(n for _, places in placed for n in places))
    with_dates = any(group.file_format == "excel" for group in groups)
    # One scan reads all layouts of a dialect, and one all workbooks.
    scans: dict[tuple[str, Dialect], list] = {}
    for group, places in placed:
        scans.setdefault((group.file_format, group.dialect), []).append((group, places))

    parts, rejects = [], []
    for (file_format, dialect), members in scans.items():
        widest = max(len(group.header) for group, _ in members)
        varied = len(members) > 1
        if file_format == "csv":
            if folder:
                scan = scan_csv(spark, folder, widest, dialect)
            else:
                same = [F.col(key).eqNullSafe(F.lit(getattr(dialect, key))) for key in DIALECT_KEYS]
                of_dialect = files.where((F.col("file_format") == "csv") & reduce(Column.__and__, same))
                scan = scan_files(of_dialect, widest, dialect)
            width = None
            if varied:
                scan, width = _join_places(scan, files, names, members), F.col("width")
            over = rejected_rows(scan, widest, dialect, width)
            rejects.append(over.select(F.lit(name).alias("dataset"), "file_path", "n_fields", "n_columns", "cells", "record"))
            rows = good_rows(scan, widest, dialect, width)
            if varied:
                rows = rows.select(F.array(*[cell(i) for i in range(widest)]).alias("cells"), "places", *PROVENANCE)
        else:
            # Decoding a sheet costs more than writing its rows, and they are read twice.
            books = files.where(F.col("file_format") == "excel").select("file_path", "size", F.size("header").alias("width"))
            rows = materialize(scan_workbooks(books), "sheets")
            if varied:
                rows = _join_places(rows, files, names, members)
        dated = (lambda place: F.get("dated", place)) if file_format == "excel" else None
        text = (lambda place: F.get("cells", place)) if varied or dated else (lambda place: F.col(cell(place)))
        cells = []
        for i, n in enumerate(names):
            if varied:
                most = max(len(places.get(n, ())) for _, places in members)
                at = [F.get(F.get("places", F.lit(i)), F.lit(k)) for k in range(most)]
            else:
                at = [F.lit(p) for p in members[0][1].get(n, ())] if dated else members[0][1].get(n, ())
            cells.append(_first_value(at, text, dated))
        lead = members[0][0]
        rank = "0:" if file_format == "excel" else "2:"
        seq = F.concat(F.lit(rank), F.element_at(F.split("_file", "/"), -1))
        seq = _moved(seq, F.lit(lead.reference), F.lit(lead.first))
        flags = [d.alias(f"t{i}") for i, (_, d) in enumerate(cells)] if with_dates else []
        parts.append(
            rows.select(
                *[value.alias(f"v{i}") for i, (value, _) in enumerate(cells)],
                *flags,
                F.struct(seq.alias("seq"), "_block", "_row").alias(ROW_ORDER),
            )
        )
    text = union_by_name(spark, parts)
    if options.stage:
        text = materialize(text, "staged")
    texts = [f"v{i}" for i in range(len(names))]
    dated = {f"v{i}": F.col(f"t{i}") for i in range(len(names))} if with_dates else {}
    n_rows, profiles = profile_text(text, texts, dated)
    cells = {n: F.col(v) for v, n in zip(texts, names)}
    return _typed(name, lambda: text, lambda: cells, {n: profiles[v] for v, n in zip(texts, names)}, n_rows, rejects, options)


def _typed(
    name: str, text: Callable[[], DataFrame], cells: Callable[[], Mapping[str, Column]], profiles: Mapping[str, ColumnProfile],
    n_rows: int, rejects: list[DataFrame], options: MergeOptions,
) -> _Built:
    """The finished table of a dataset from its text cells and what they read as.

    Only aggregates can fail or warn, so they are tried here. The table itself is planned when it is asked for,
    as exact medians begin with a pass over the rows.
    """
    own = options.for_dataset(name)
    warnings = [f"requested column not present in any file: {n}" for n in profiles if own.columns and not profiles[n].has_values]
    errors: list[str] = []

    def typed() -> DataFrame:
        values = cells()
        return text().select(*[read_as(values[n], profiles[n].data_type()).alias(n) for n in values], ROW_ORDER)

    def build() -> DataFrame:
        return finish(typed(), own, n_rows, options, [], [])

    if own.group_by and own.max_rows_before_aggregate is not None:
        try:
            finish(typed(), own, n_rows, replace(options, median="builtin"), errors, warnings)
        except AggregateError as error:
            return _Built(None, n_rows, rejects, [f"dataset '{name}': {error}"], warnings)
    return _Built(build, n_rows, rejects, errors, warnings)


def _first_values(cells: Column) -> Column:
    """For each final name the first value at its ``places``."""

    def value(at: Column) -> Column:
        found = F.transform(at, lambda place: F.get(cells, place))
        return F.get(F.filter(found, lambda text: text.isNotNull()), F.lit(0))

    return F.transform("places", value)


def _build_together(
    spark: SparkSession, groups: Mapping[str, list[LayoutGroup]], files: DataFrame, renames: Mapping[str, Mapping[str, str]],
    options: MergeOptions,
) -> tuple[dict[str, _Built], DataFrame]:
    """Many datasets of CSV files in a fixed number of jobs: one scan per dialect over all of them, whose
    cells are staged once in the order of the datasets, and one type profile keyed by dataset and column.

    Returns what each dataset gives, and the rejected records of all.
    """
    names: dict[str, list[str]] = {}
    rows, dialects = [], {}
    for dataset, found in groups.items():
        placed = [(group, _places(group, renames.get(dataset, {}))) for group in found]
        names[dataset] = list(options.for_dataset(dataset).columns) or list(dict.fromkeys(n for _, at in placed for n in at))
        for group, at in placed:
            dialects[group.dialect] = max(dialects.get(group.dialect, 0), len(group.header))
            rows.append((dataset, group.layout_id, len(group.header), [at.get(n, []) for n in names[dataset]], group.reference, group.first))
    # One row per layout of a dataset.
    layouts = spark.createDataFrame(
        rows, "dataset string, layout_id string, width int, places array<array<int>>, reference string, first string"
    )
    csv = files.where(F.col("file_format") == "csv")
    known = materialize(
        csv.join(layouts, ["dataset", "layout_id"]).select(
            "dataset", F.col("file_path").alias("_file"), "size", *DIALECT_KEYS, "width", "places",
            _moved(F.concat(F.lit("2:"), F.element_at(F.split("file_path", "/"), -1)), F.col("reference"), F.col("first")).alias("seq"),
        ),
        "places",
    )
    total = known.agg(F.sum("size").alias("bytes"), F.sum(256 + 32 * F.size("places")).alias("held")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Files that hold more than a task's share of all bytes.
    share = F.col("size") * tasks / max(1, total.bytes or 0)
    large = known.where(share > 1).select(F.col("_file").alias("key"), F.ceil(share).cast("int").alias("salts"))

    parts, rejects = [], []
    for dialect, widest in dialects.items():
        same = [F.col(key).eqNullSafe(F.lit(getattr(dialect, key))) for key in DIALECT_KEYS]
        own = known.where(reduce(Column.__and__, same))
        scan = scan_files(own.select(F.col("_file").alias("file_path"), "size"), widest, dialect)
        at = own.select("_file", "dataset", "width", "places", "seq")
        if (total.held or 0) <= BROADCAST_BYTES:
            scan = scan.join(F.broadcast(at), "_file")
        else:
            scan = hot_join(scan, at.hint("merge"), "_file", ["_row"], hot=large)
        over = rejected_rows(scan, widest, dialect, F.col("width"), "dataset")
        rejects.append(over.select("dataset", "file_path", "n_fields", "n_columns", "cells", "record"))
        good = good_rows(scan, widest, dialect, F.col("width"))
        values = _first_values(F.array(*[cell(i) for i in range(widest)]))
        parts.append(good.select("dataset", values.alias("values"), F.struct("seq", "_block", "_row").alias(ROW_ORDER)))
    # Even ranges of rows, whatever share a dataset has; a filter on the dataset reads its ranges only.
    text = reduce(DataFrame.unionByName, parts).repartitionByRange("dataset", ROW_ORDER)
    text = materialize(text.sortWithinPartitions("dataset"), "staged")
    exploded = text.select("dataset", F.posexplode("values").alias("place", "value"))
    profiled = exploded.groupBy("dataset", "place").agg(
        F.count("*").alias("n"), F.bit_or(unreadable_as(F.col("value"), F.lit(False))).alias("mask")
    )
    masks: dict[str, dict[int, int]] = {}
    counts: dict[str, int] = {}
    for row in profiled.collect():  # one row per column of a dataset
        masks.setdefault(row["dataset"], {})[row["place"]] = row["mask"]
        counts[row["dataset"]] = row["n"]
    built = {}
    for dataset, columns in names.items():
        mine = masks.get(dataset, {})
        profiles = {n: ColumnProfile(mine.get(i, 0)) for i, n in enumerate(columns)}
        built[dataset] = _typed(
            dataset,
            lambda dataset=dataset: text.where(F.col("dataset") == dataset),
            lambda columns=columns: {n: F.get("values", F.lit(i)) for i, n in enumerate(columns)},
            profiles, counts.get(dataset, 0), [], options,
        )
    return built, reduce(DataFrame.unionByName, rejects)


def finish(
    typed: DataFrame, own: DatasetOptions, n_rows: int, options: MergeOptions, errors: list[str], warnings: list[str]
) -> DataFrame:
    """Threshold-guarded aggregation, sort and column order of a merged table."""
    out = typed
    if own.group_by and own.max_rows_before_aggregate is not None:
        out = aggregate_if_tall(
            typed, own.group_by, own.max_rows_before_aggregate, own.aggregate_columns, n_rows=n_rows,
            default=own.aggregate_default, order=F.col(ROW_ORDER), null_keys=options.null_keys,
            median=options.median, sort_groups=not own.sort_by, skip=[ROW_ORDER], errors=errors, warnings=warnings,
        )
    if own.columns:
        out = order_columns(out, own.columns)
    if own.sort_by:
        ties = [F.col(ROW_ORDER)] if ROW_ORDER in out.columns else [column(k) for k in own.group_by]
        out = sort_rows(out, own.sort_by, own.sort_ascending, ties)
    return out
