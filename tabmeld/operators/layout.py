"""Layout catalogue operators: reference layouts, plural variants, structure checks.

The operators take *headers*: one row per file with ``dataset``, ``file_path``,
``file_seq`` (any orderable type; earlier files come first) and ``columns`` (array of
clean names). A header is bounded by one file's width, so work inside a header uses array
expressions and needs no shuffle; work across files joins or aggregates on names.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmeld.functions.names import WHITE_SPACE, column_letters, is_plural_pair, let, longer_forms, plural_forms, strip, strip_all
from tabmeld.operators.spread import name_join, salted_left_join
from tabmeld.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Renames go to all tasks up to about this size, and are joined beyond it; so do the names of references.
RENAMES_BYTES = 32 << 20
NAMES_BYTES = 32 << 20


def layout_catalog(headers: DataFrame) -> DataFrame:
    """One row per (file, column) with the 0-based ordinal."""
    return headers.select(
        "dataset", "file_path", "file_seq", F.posexplode("columns").alias("ordinal", "name")
    )


def columns_per_file(catalog: DataFrame) -> DataFrame:
    """Back from the exploded catalogue to one ordered column list per file."""
    cells = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    return catalog.groupBy("dataset", "file_path", "file_seq").agg(F.transform(cells, lambda c: c["name"]).alias("columns"))


def reference_layout(headers: DataFrame) -> DataFrame:
    """Per dataset the file with the most columns (the earliest one on ties)."""
    best = F.min_by(
        F.struct("file_path", "columns"), F.struct(-F.size("columns"), F.col("file_seq"))
    ).alias("best")
    return (
        headers.groupBy("dataset")
        .agg(best)
        .select("dataset", F.col("best.file_path").alias("reference_file"), F.col("best.columns").alias("reference_columns"))
    )


def reference_columns(headers: DataFrame) -> DataFrame:
    """Reference listing: one row per dataset and reference column, 1-based position."""
    return reference_layout(headers).select(
        "dataset",
        "reference_file",
        F.size("reference_columns").alias("n_columns"),
        F.posexplode("reference_columns").alias("position", "column_name"),
    ).withColumn("position", F.col("position") + 1)


def all_column_names(headers: DataFrame) -> DataFrame:
    """Distinct names over all files, in order."""
    return headers.select(F.explode("columns").alias("column_name")).distinct().orderBy("column_name")


def plural_pairs(names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plural/singular pairs among distinct ``name`` values that share ``keys``.

    Equality on the two longer spellings replaces a comparison of all pairs.
    """
    shorter = names.select(*keys, F.col("name").alias("short_name"), F.explode(longer_forms(F.col("name"))).alias("name"))
    return shorter.join(names.select(*keys, "name"), [*keys, "name"]).select(
        *keys, "short_name", F.col("name").alias("long_name")
    )


def dataset_names(headers: DataFrame) -> DataFrame:
    """Distinct trimmed, non-blank names per dataset."""
    name = strip(F.col("name"))
    return layout_catalog(headers).select("dataset", name.alias("name")).where("name <> ''").distinct()


def _conflicts(columns: Column) -> Column:
    """All same-header pairs as array of (position of first, position of second), 1-based."""
    longs = F.array_intersect(F.flatten(F.transform(columns, longer_forms)), columns)

    def pairs_of(long_name: Column) -> Column:
        size = F.length(long_name)
        shorts = F.array(
            F.substring(long_name, F.lit(1), size - 1),
            F.when(long_name.endswith("es"), F.substring(long_name, F.lit(1), size - 2)),
        )
        places = F.transform(
            shorts,
            lambda short: F.when(
                short != "", F.struct(F.array_position(columns, short).alias("a"), F.array_position(columns, long_name).alias("b"))
            ),
        )
        return F.filter(places, lambda p: p["a"] > 0)

    ordered = F.transform(
        F.flatten(F.transform(longs, pairs_of)),
        lambda p: F.struct(F.least(p["a"], p["b"]).alias("first"), F.greatest(p["a"], p["b"]).alias("second")),
    )
    return F.array_sort(ordered)


def same_file_conflicts(headers: DataFrame) -> DataFrame:
    """First plural/singular pair inside each file that has one."""
    trimmed = F.filter(F.transform("columns", strip), lambda name: name != "")
    named = let(
        trimmed,
        lambda names: F.transform(
            F.slice(_conflicts(names), 1, 1),
            lambda pair: F.struct(
                F.element_at(names, pair["first"].cast("int")).alias("name_a"),
                F.element_at(names, pair["second"].cast("int")).alias("name_b"),
            ),
        ),
    )
    return headers.select("dataset", "file_path", "file_seq", F.inline(named))


def fold_conflicts(columns: Sequence[str], policy: str | Mapping[str, str]) -> list[tuple[str, str]]:
    """(kept, dropped) name pairs that settle one header's plural/singular conflicts, in order.

    ``columns`` are trimmed. ``policy`` is ``keep_first``, ``keep_second`` or a map from a variant
    to the name to keep; ValueError if the map names neither of two variants.
    """
    place: dict[str, int] = {}
    for position, name in enumerate(columns):
        place.setdefault(name, position)
    gone: set[str] = set()
    folds: list[tuple[str, str]] = []
    for first in sorted(place, key=place.get):
        partners = {first + "s", first + "es"}
        partners |= {first[:-1]} if first.endswith("s") else set()
        partners |= {first[:-2]} if first.endswith("es") else set()
        for second in sorted((p for p in partners if p in place and place[p] > place[first]), key=place.get):
            if first in gone:
                break
            if second in gone or not first or not second:
                continue
            if isinstance(policy, Mapping):
                keep = policy.get(first, policy.get(second))
                if keep not in (first, second):
                    raise ValueError(f"no kept name given for '{first}' and '{second}'")
            else:
                keep = first if policy == "keep_first" else second
            drop = second if keep == first else first
            folds.append((keep, drop))
            gone.add(drop)
    return folds


def resolve_conflicts(headers: DataFrame, policy: str | Mapping[str, str]) -> DataFrame:
    """Headers with trimmed names and their conflicts settled.

    Adds ``folds``, ordered (kept, dropped) pairs, and ``refused``, the reason why a header could
    not be settled (null otherwise). Only files that have a conflict reach the Arrow-batched helper.
    """
    settle = _settler(policy)
    trimmed = headers.withColumn("columns", F.transform("columns", strip))
    clash = F.arrays_overlap(F.flatten(F.transform("columns", longer_forms)), F.col("columns"))
    none = F.array().cast("array<struct<kept:string,dropped:string>>")
    clean = trimmed.where(~clash).withColumn("folds", none).withColumn("refused", F.lit(None).cast("string"))
    clashing = trimmed.where(clash).withColumn("settled", settle("columns"))
    clashing = clashing.withColumn("folds", F.col("settled.folds")).withColumn("refused", F.col("settled.refused"))
    dropped = F.transform("folds", lambda fold: fold["dropped"])
    kept = F.filter("columns", lambda name: ~F.array_contains(dropped, name))
    return clean.unionByName(clashing.withColumn("columns", kept).drop("settled"))


def _settler(policy: str | Mapping[str, str]):
    fold = fold_conflicts

    @F.pandas_udf("struct<folds:array<struct<kept:string,dropped:string>>,refused:string>")
    def settle(headers: pd.Series) -> pd.DataFrame:
        rows = []
        for names in headers:
            try:
                rows.append(([{"kept": k, "dropped": d} for k, d in fold(list(names), policy)], None))
            except ValueError as error:
                rows.append(([], str(error)))
        return pd.DataFrame(rows, columns=["folds", "refused"])

    return settle


def _stem(name: Column) -> Column:
    """The name without its trailing run of the letters e and s, which no plural ending changes."""
    return F.rtrim(name, F.lit("es"))


def _by_stem(names: DataFrame, item: Column) -> DataFrame:
    """Per dataset and stem the sorted ``item`` of each name, where names form a plural/singular pair.

    Most names are alone with their stem: they are counted out, so that lists are only made of the others.
    """
    stemmed = names.select("dataset", "name", item.alias("item"), _stem(F.col("name")).alias("stem"))
    of_stem = Window.partitionBy("dataset", "stem")
    several = stemmed.withColumn("size", F.count("*").over(of_stem)).where("size > 1")
    lists = several.groupBy("dataset", "stem").agg(F.collect_list("name").alias("names"), F.sort_array(F.collect_list("item")).alias("found"))
    return lists.where(F.arrays_overlap(F.flatten(F.transform("names", longer_forms)), F.col("names")))


def variant_groups(names: Sequence[str]) -> list[list[str]]:
    """Groups of names that plural endings connect; names without a variant are left out."""
    group = {name: name for name in names}

    def root(name: str) -> str:
        while group[name] != name:
            name = group[name]
        return name

    for name in group:
        for ending in ("s", "es"):
            short = name[: -len(ending)]
            if name.endswith(ending) and short in group:
                low, high = sorted((root(short), root(name)))
                group[high] = low
    found: dict[str, list[str]] = {}
    for name in sorted(group):
        found.setdefault(root(name), []).append(name)
    return [members for members in found.values() if len(members) > 1]


def plural_components(names: DataFrame) -> DataFrame:
    """Connected groups of plural/singular variants per dataset.

    ``names`` holds distinct (dataset, name). All variants of a name share its stem, so one
    shuffle brings them together, and the few names of a stem are settled in their row. A
    group's label is its smallest name. Names without a variant are left out.
    """
    groups_of = variant_groups

    @F.pandas_udf("array<struct<name:string,component:string>>")
    def settle(stems: pd.Series) -> pd.Series:
        return stems.map(
            lambda found: [
                {"name": name, "component": min(members)} for members in groups_of(list(found)) for name in members
            ]
        )

    return _by_stem(names, F.col("name")).select("dataset", F.inline(settle("found")))


def canonical_renames(headers: DataFrame, weight: str | None = None) -> DataFrame:
    """Majority vote over each variant group: (dataset, from_name, to_name).

    The name found in most files wins; then the one in the reference layout; then the
    smallest name. ``weight`` names a column with the number of files that a row stands for.
    """
    files = (
        headers.select("dataset", F.array_distinct(strip_all(F.col("columns"))).alias("names"),
                       (F.col(weight) if weight else F.lit(1)).alias("weight"))
        .select("dataset", "weight", F.explode("names").alias("name"))
        .where("name <> ''")
        .groupBy("dataset", "name")
        .agg(F.sum("weight").alias("n_files"))
    )
    in_reference = (
        reference_layout(headers)
        .select("dataset", F.explode("reference_columns").alias("name"))
        .select("dataset", strip(F.col("name")).alias("name"), F.lit(1).alias("in_reference"))
        .distinct()
    )
    groups_of = variant_groups

    @F.pandas_udf("array<struct<from_name:string,to_name:string>>")
    def vote(stems: pd.Series) -> pd.Series:
        def renames(found):
            place = {name: at for at, name in enumerate(found)}
            out = []
            for members in groups_of(list(place)):
                winner = min(members, key=place.get)
                out += [{"from_name": name, "to_name": winner} for name in members if name != winner]
            return out

        return stems.map(renames)

    # The winner of any group comes first.
    rank = F.struct((-F.col("n_files")).alias("votes"), (-F.coalesce("in_reference", F.lit(0))).alias("place"), "name")
    stems = _by_stem(files.join(in_reference, ["dataset", "name"], "left"), rank)
    stems = stems.select("dataset", F.transform("found", lambda item: item["name"]).alias("found"))
    return stems.select("dataset", F.inline(vote("found")))


def apply_renames(headers: DataFrame, renames: DataFrame) -> DataFrame:
    """Headers with canonical names put in; a frequent name may be in very many files.

    ``renames`` has one row per dataset and name. Up to RENAMES_BYTES of them go to all tasks, which rename
    whole headers, so that headers are shuffled as they are; more are joined name by name.
    """
    renames = materialize(renames.select("dataset", "from_name", "to_name"), "renames")
    held = F.lit(256)
    for name in renames.columns:
        held = held + F.coalesce(F.octet_length(name), F.lit(0))
    size = renames.agg(F.sum(held.cast("long"))).first()[0] or 0
    if size > RENAMES_BYTES:
        return _apply_many_renames(headers, renames)
    spelled = _renamer(headers.sparkSession, renames)
    renamed = headers.select("dataset", "file_path", "file_seq", spelled("dataset", "columns").alias("columns"))
    # Rows of one file come together, with the names at each place sorted.
    cells = F.flatten(
        F.transform(F.collect_list("columns"), lambda names: F.transform(names, lambda name, at: F.struct(at.alias("ordinal"), name.alias("name"))))
    )
    together = F.when(F.count("*") == 1, F.first("columns")).otherwise(F.transform(F.array_sort(cells), lambda c: c["name"]))
    # A file without names has no row.
    files = renamed.where(F.size("columns") > 0)
    return files.groupBy("dataset", "file_path", "file_seq").agg(together.alias("columns"))


def _renamer(spark: SparkSession, renames: DataFrame):
    tables: dict[str, dict[str, str]] = {}
    for row in renames.where("dataset IS NOT NULL AND to_name IS NOT NULL").toLocalIterator():
        tables.setdefault(row["dataset"], {})[row["from_name"]] = row["to_name"]
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("array<string>")
    def rename(datasets: pd.Series, headers: pd.Series) -> pd.Series:
        known = shared.value
        out = []
        for dataset, names in zip(datasets, headers):
            found = known.get(dataset)
            out.append(names if found is None or names is None else [found.get(name, name) for name in names])
        return pd.Series(out, dtype=object)

    return rename


def _apply_many_renames(headers: DataFrame, renames: DataFrame) -> DataFrame:
    renamed = salted_left_join(
        layout_catalog(headers), renames.withColumnRenamed("from_name", "name"), ["dataset", "name"], ["file_path"]
    )
    return columns_per_file(
        renamed.select(
            "dataset", "file_path", "file_seq", "ordinal", F.coalesce("to_name", "name").alias("name")
        )
    )


def _against_reference(headers: DataFrame, reference: DataFrame | None) -> DataFrame:
    reference = reference_layout(headers) if reference is None else reference
    compared = salted_left_join(headers, reference, ["dataset"], ["file_path"])
    return compared.where("file_path <> reference_file").select(
        "dataset",
        "file_path",
        "file_seq",
        "columns",
        "reference_columns",
        F.array_except("reference_columns", "columns").alias("missing"),
        F.array_except("columns", "reference_columns").alias("extra"),
    )


def _known_names(reference: DataFrame) -> DataFrame:
    """(dataset, column_name, column_index): each reference name at its first position."""
    names = reference.select("dataset", F.posexplode("reference_columns").alias("column_index", "column_name"))
    return names.groupBy("dataset", "column_name").agg(F.min("column_index").alias("column_index"))


def _extra_columns(headers: DataFrame, reference: DataFrame) -> DataFrame:
    """(dataset, file_path, file_seq, column_index, column_name, partner) of names that the reference lacks.

    ``partner`` is the first plural/singular partner in the reference. Names meet a table of the reference's
    names, as a set of them for every file costs far more than the file's own names.
    """
    reference = reference.where("reference_columns IS NOT NULL")  # nothing is known of what a missing header lacks
    every = F.array_distinct("columns")
    # Repeated names count once, at their first position.
    plain = F.transform("columns", lambda name, at: F.struct(at.alias("column_index"), name.alias("column_name")))
    placed = F.when(F.size(every) == F.size("columns"), plain).otherwise(_placed(every, F.col("columns")))
    others = salted_left_join(headers, reference.select("dataset", "reference_file"), ["dataset"], ["file_path"])
    cells = others.where("file_path <> reference_file").select("dataset", "file_path", "file_seq", F.inline(placed))
    known = _known_names(reference)
    forms = known.select("dataset", F.explode(plural_forms(F.col("column_name"))).alias("name"), "column_name", "column_index")
    forms = forms.where(is_plural_pair(F.col("name"), F.col("column_name"))).groupBy("dataset", "name")
    first = forms.agg(F.min_by("column_name", "column_index").alias("partner")).withColumnRenamed("name", "column_name")
    facts = known.select("dataset", "column_name", F.lit(True).alias("known")).join(first, ["dataset", "column_name"], "full")
    return name_join(cells, facts, ["dataset", "column_name"], ["file_path"]).where("known IS NULL")


def _placed(names: Column, home: Column) -> Column:
    """(column_index, column_name) of each name, by its first position in ``home``.

    Sorting puts a name's marker right before its position, so wide headers need no scan
    per name.
    """
    marks = F.transform(names, lambda name: F.struct(name.alias("name"), F.lit(-1).alias("at")))
    places = F.transform(home, lambda name, at: F.struct(name.alias("name"), at.alias("at")))

    def picked(items: Column) -> Column:
        found = F.transform(
            items,
            lambda item, at: F.when(
                item["at"] == -1,
                F.struct(F.get(items, at + 1)["at"].alias("column_index"), item["name"].alias("column_name")),
            ),
        )
        return F.array_compact(found)

    return let(F.sort_array(F.concat(marks, places)), picked)


def structure_issues(
    headers: DataFrame, allow_missing: bool = False, reference: DataFrame | None = None
) -> DataFrame:
    """Missing and extra columns of every file against its dataset's reference layout."""
    reference = materialize(reference_layout(headers) if reference is None else reference, "reference")

    def report(rows: DataFrame, kind: str, text: str) -> DataFrame:
        name, partner = F.col("column_name"), F.col("partner")
        return rows.select(
            "dataset", "file_path", "file_seq", name, "column_index", column_letters(F.col("column_index")).alias("excel_ref"),
            F.lit(kind).alias("issue_type"),
            F.concat(F.lit(text), name).alias("message"),
            F.when(
                partner.isNotNull(), F.format_string("Possible plural/singular: '%s' vs '%s'", name, partner)
            ).alias("hint"),
        )

    issues = report(_extra_columns(headers, reference), "extra", "Extra column (not in reference): ")
    if not allow_missing:
        missing = report(_missing_columns(headers, reference), "missing", "Missing column (expected by reference): ")
        issues = missing.union(issues)
    return issues


def compare_names(names: Sequence[str], known: Mapping[str, int]) -> tuple[list[int], list[tuple[int, str | None]]]:
    """Places in ``known`` of the names that a header has; places and partners of those that have one among its extra names.

    ``known`` maps the reference's names to their first places.
    """
    own = dict.fromkeys(names)
    extra = [name for name in own if name is not None and name not in known]
    near: dict[str, int] = {}
    for name in extra:
        for form in _forms(name):
            if form in known and form not in own:
                near[form] = known[form]
    if not near:
        return [known[name] for name in own if name in known], []
    others = {form for name in near for form in _forms(name)}
    others = [(_bare(name), name) for name in extra if name in others and name]

    def partner(name: str) -> str | None:
        bare = _bare(name)
        return next((other for short, other in others if short in _pairs(bare) or bare in _pairs(short)), None)

    return [known[name] for name in own if name in known], [(place, partner(name)) for name, place in near.items()]


def _pairs(name: str) -> tuple[str, str]:
    return name + "s", name + "es"


def _forms(name: str) -> list[str]:
    """As :func:`plural_forms`, without NULLs."""
    forms = [*_pairs(name)]
    forms += [name[:-1]] if name.endswith("s") and len(name) > 1 else []
    return forms + ([name[:-2]] if name.endswith("es") and len(name) > 2 else [])


def _bare(name: str) -> str:
    return name.strip(WHITE_SPACE)


def _name_comparer(spark: SparkSession, reference: DataFrame):
    """Headers against the reference's names, which go to all tasks."""
    tables: dict[str, dict[str, int]] = {}
    for row in reference.where("dataset IS NOT NULL AND reference_columns IS NOT NULL").toLocalIterator():
        known = tables.setdefault(row["dataset"], {})
        for place, name in enumerate(row["reference_columns"]):
            known.setdefault(name, place)
    shared, compare = spark.sparkContext.broadcast(tables), compare_names

    @F.pandas_udf("struct<found:array<int>,near:array<struct<place:int,partner:string>>>")
    def against(datasets: pd.Series, headers: pd.Series) -> pd.DataFrame:
        tables, found, near = shared.value, [], []
        for dataset, names in zip(datasets, headers):
            known = tables.get(dataset)
            places, pairs = (None, None) if known is None or names is None else compare(list(names), known)
            found.append(places)
            near.append(None if pairs is None else [{"place": place, "partner": partner} for place, partner in pairs])
        return pd.DataFrame({"found": pd.Series(found, dtype=object), "near": pd.Series(near, dtype=object)})

    return against


def _missing_columns(headers: DataFrame, reference: DataFrame) -> DataFrame:
    """The same for reference names that a file lacks; ``partner`` is the file's first extra one.

    Names without a partner are by far the most. They are rows of their own, whose partner is a plain NULL, so
    that a look for hints never makes them. Up to NAMES_BYTES of reference names go to all tasks, which look up a
    file's own names; a whole reference is then only counted through by place.
    """
    held = F.coalesce(F.octet_length(F.array_join("reference_columns", "")) + 64 * F.size("reference_columns"), F.lit(0))
    size = reference.agg(F.sum(held.cast("long"))).first()[0] or 0
    if size > NAMES_BYTES:
        return _missing_of_many(headers, reference)
    against = _name_comparer(headers.sparkSession, reference)
    file = ("dataset", "file_path", "file_seq")
    places = reference.select("dataset", F.posexplode("reference_columns").alias("place", "name")).groupBy("dataset", "name")
    places = places.agg(F.min("place").alias("place")).groupBy("dataset").agg(F.collect_list("place").alias("places"))
    known = materialize(reference.join(places, "dataset"), "reference_places")

    def compared(cells) -> DataFrame:
        # The reference is joined afterwards, as it would go through the function with every header.
        found = headers.select(*file, cells(against("dataset", "columns")))
        return found.join(F.broadcast(known), "dataset").where("file_path <> reference_file")

    def seen(both: Column) -> Column:
        return F.concat(both["found"], F.transform(both["near"], lambda pair: pair["place"])).alias("seen")

    none, name = F.lit(None).cast("string"), F.get("reference_columns", F.col("place"))
    alone = compared(seen).select(*file, "reference_columns", F.explode(F.array_except("places", "seen")).alias("place"))
    near = compared(lambda both: both["near"].alias("near")).select(*file, "reference_columns", F.inline("near"))
    rows = [part.select(*file, name.alias("column_name"), partner.alias("partner"), "place") for part, partner in ((alone, none), (near, F.col("partner")))]
    index = F.when(F.col("column_name").isNotNull(), F.col("place"))
    return rows[0].union(rows[1]).withColumn("column_index", index).drop("place")


def _missing_of_many(headers: DataFrame, reference: DataFrame) -> DataFrame:
    """:func:`_missing_columns` for references that are too many for every task, which meet each header by a join."""

    def partners(of: Column, among: Column) -> Column:
        return F.array_intersect(among, F.flatten(F.transform(of, plural_forms)))

    def sides(body) -> Column:
        """``body`` of the missing names, the extra ones and the missing ones with a partner, each found once a file."""
        both = F.struct(
            F.array_except("reference_columns", "columns").alias("missing"), F.array_except("columns", "reference_columns").alias("extra")
        )
        return let(both, lambda found: let(partners(found["extra"], found["missing"]), lambda few: body(found["missing"], found["extra"], few)))

    def paired(missing: Column, extra: Column, few: Column) -> Column:
        def with_partner(others: Column) -> Column:
            first = lambda name: F.try_element_at(F.filter(others, lambda other: is_plural_pair(name, other)), F.lit(1))
            return F.transform(few, lambda name: F.struct(name.alias("column_name"), first(name).alias("partner")))

        return let(partners(few, extra), with_partner)

    compared = salted_left_join(headers, reference, ["dataset"], ["file_path"]).where("file_path <> reference_file")
    file = ("dataset", "file_path", "file_seq")
    alone = compared.select(*file, F.explode(sides(lambda missing, extra, few: F.array_except(missing, few))).alias("column_name"))
    cells = alone.withColumn("partner", F.lit(None).cast("string")).union(compared.select(*file, F.inline(sides(paired))))
    return name_join(cells, _known_names(reference), ["dataset", "column_name"], ["file_path"])


def validation_verdict(
    headers: DataFrame, allow_missing: bool = False, reference: DataFrame | None = None
) -> DataFrame:
    """One row per dataset: success, and how many missing and extra columns were found."""
    reference = reference_layout(headers) if reference is None else reference
    counted = _against_reference(headers, reference).select(
        "dataset", F.size("missing").alias("missing"), F.size("extra").alias("extra")
    )
    totals = counted.groupBy("dataset").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))
    missing = F.lit(0).cast("bigint") if allow_missing else F.coalesce("missing", F.lit(0))
    extra = F.coalesce("extra", F.lit(0))
    return reference.join(totals, "dataset", "left").select(
        "dataset",
        ((missing + extra == 0) | F.lit(allow_missing)).alias("success"),
        "reference_file",
        "reference_columns",
        missing.alias("n_missing"),
        extra.alias("n_extra"),
    )


def issue_report(issues: DataFrame) -> DataFrame:
    """Issues as text lines, in file order."""
    line = F.format_string(
        "Column %s (%s): %s - %s", F.col("excel_ref"), F.col("column_name"), F.col("issue_type"), F.col("message")
    )
    full = F.concat(line, F.coalesce(F.concat(F.lit(" | Hint: "), F.col("hint")), F.lit("")))
    ordered = issues.orderBy("dataset", "file_seq", F.col("issue_type").desc(), "column_index")
    return ordered.select("dataset", "file_path", full.alias("line"))


def extra_column_files(headers: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(dataset, column, file) for every column that the reference layout lacks."""
    reference = materialize(reference_layout(headers) if reference is None else reference, "reference")
    return _extra_columns(headers, reference).select("dataset", "column_name", "file_path")


def missing_required(headers: DataFrame, required: Column) -> DataFrame:
    """Files that lack a required column; ``required`` is an array of names per row."""
    missing = F.array_sort(F.array_distinct(F.array_except(required, F.col("columns"))))
    return (
        headers.select("dataset", "file_path", "file_seq", "columns", missing.alias("missing"))
        .where(F.size("missing") > 0)
    )


def merge_status(files: DataFrame) -> DataFrame:
    """Per dataset the number of files, and whether it is merged or skipped as a single file."""
    n_files = F.count("*")
    status = F.when(n_files == 1, F.lit("skipped_single_file")).otherwise(F.lit("merge"))
    return files.groupBy("dataset").agg(n_files.alias("n_files"), status.alias("status"))
