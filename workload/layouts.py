"""Layout catalogue operators. Documents stand in for files: language is the dataset,
the distinct words of the whole text are the header."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeld.operators import layout
from tabmeld.operators.spread import widen
from tabmeld.plans.options import MergeOptions, options_table
from workload import query, table

_CATALOG_SQL = r"""
words AS (SELECT doc_id, lang, unnest(w) AS name, generate_subscripts(w, 1) AS pos
          FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\s+') AS w FROM documents)),
cat AS (SELECT lang AS dataset, doc_id AS file_seq, doc_id::VARCHAR AS file_path, name,
               row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS ordinal
        FROM words WHERE name <> '' GROUP BY lang, doc_id, name),
sizes AS (SELECT dataset, file_seq, file_path, count(*) AS n_columns FROM cat GROUP BY ALL),
ref AS (SELECT dataset, arg_min(file_path, (-n_columns, file_seq)) AS reference_file FROM sizes GROUP BY dataset),
ref_cat AS (SELECT cat.* FROM cat JOIN ref ON cat.dataset = ref.dataset AND cat.file_path = ref.reference_file)
"""
_WITH = f"WITH {_CATALOG_SQL}"
# Each step computed once and joined on a single key, so that no plan can pair rows of one file or dataset.
_STEPS = _WITH.replace("cat AS (", "cat AS MATERIALIZED (", 1)

_PAIRS_SQL = """
names AS (SELECT DISTINCT dataset, name FROM cat),
pairs AS (SELECT a.dataset, a.name AS short_name, b.name AS long_name FROM names a
          JOIN names b ON a.dataset = b.dataset AND b.name = a.name || 's'
          UNION ALL
          SELECT a.dataset, a.name, b.name FROM names a
          JOIN names b ON a.dataset = b.dataset AND b.name = a.name || 'es')
"""

_COMPONENTS_SQL = """
edges AS (SELECT dataset, short_name AS name, long_name AS other FROM pairs
          UNION SELECT dataset, long_name, short_name FROM pairs),
reach AS (SELECT dataset, name, name AS other FROM edges
          UNION SELECT r.dataset, r.name, e.other FROM reach r JOIN edges e ON r.dataset = e.dataset AND r.other = e.name),
components AS (SELECT dataset, name, min(other) AS component FROM reach GROUP BY dataset, name)
"""

_RENAMES_SQL = """
counts AS (SELECT dataset, name, count(DISTINCT file_path) AS n_files FROM cat GROUP BY dataset, name),
votes AS (SELECT c.dataset, c.component, c.name, row_number() OVER (PARTITION BY c.dataset, c.component
          ORDER BY n.n_files DESC, r.name IS NULL, c.name) AS place
          FROM components c JOIN counts n USING (dataset, name)
          LEFT JOIN ref_cat r ON r.dataset = c.dataset AND r.name = c.name),
renames AS (SELECT v.dataset, v.name AS from_name, w.name AS to_name FROM votes v
            JOIN votes w ON v.dataset = w.dataset AND v.component = w.component AND w.place = 1 WHERE v.place > 1)
"""

_ISSUES_SQL = """
missing AS (SELECT f.dataset, f.file_path, r.name AS column_name, r.ordinal AS column_index, 'missing' AS issue_type
            FROM sizes f JOIN ref ON f.dataset = ref.dataset AND f.file_path <> ref.reference_file
            JOIN ref_cat r ON r.dataset = f.dataset
            WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.file_path = f.file_path AND c.name = r.name)),
extra AS (SELECT c.dataset, c.file_path, c.name AS column_name, c.ordinal AS column_index, 'extra' AS issue_type FROM cat c
          WHERE NOT EXISTS (SELECT 1 FROM ref_cat r WHERE r.dataset = c.dataset AND r.name = c.name))
"""


def _partners(select: str, tables: str, a: str, b: str) -> str:
    """Plural/singular partners as plain equality joins, one per spelling; ``tables`` ends in a join condition."""
    spellings = (f"{b} = {a} || 's'", f"{b} = {a} || 'es'", f"{a} = {b} || 's'", f"{a} = {b} || 'es'")
    return " UNION ALL ".join(f"SELECT {select} FROM {tables} AND {spelling}" for spelling in spellings)


def headers(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda word: word != "")
    return widen(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").cast("string").alias("file_path"),
        F.col("doc_id").alias("file_seq"),
        F.array_distinct(words).alias("columns"),
    )


@query("layout_catalog", f"{_WITH} SELECT dataset, file_path, file_seq, ordinal, name FROM cat")
def catalog(spark, sf_dir):
    return layout.layout_catalog(headers(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "layout_columns_per_file",
    f"{_WITH} SELECT dataset, file_path, file_seq, string_agg(name, ' ' ORDER BY ordinal) AS columns FROM cat GROUP BY ALL",
)
def columns_per_file(spark, sf_dir):
    files = layout.columns_per_file(layout.layout_catalog(headers(spark, sf_dir)))
    return files.withColumn("columns", F.array_join("columns", " "))


@query(
    "layout_reference_file",
    f"{_WITH} SELECT dataset, reference_file, n_columns FROM ref JOIN sizes s USING (dataset) WHERE s.file_path = reference_file",
)
def reference_file(spark, sf_dir):
    return layout.reference_layout(headers(spark, sf_dir)).select(
        "dataset", "reference_file", F.size("reference_columns").cast("bigint").alias("n_columns")
    )


@query(
    "layout_reference_columns",
    f"""{_WITH} SELECT dataset, file_path AS reference_file, count(*) OVER (PARTITION BY dataset) AS n_columns,
        ordinal + 1 AS position, name AS column_name FROM ref_cat""",
)
def reference_columns(spark, sf_dir):
    out = layout.reference_columns(headers(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("n_columns", "position")})


@query("layout_all_column_names", f"{_WITH} SELECT DISTINCT name AS column_name FROM cat")
def all_column_names(spark, sf_dir):
    return layout.all_column_names(headers(spark, sf_dir))


@query("layout_plural_pairs", f"{_WITH}, {_PAIRS_SQL} SELECT * FROM pairs")
def plural_pairs(spark, sf_dir):
    return layout.plural_pairs(layout.dataset_names(headers(spark, sf_dir)), ["dataset"])


@query(
    "layout_same_file_conflicts",
    f"""{_STEPS}, forms AS MATERIALIZED (
          SELECT *, file_path || chr(1) || unnest([name || 's', name || 'es']) AS partner FROM cat),
        hits AS (SELECT f.dataset, f.file_path, f.file_seq, CASE WHEN f.ordinal < c.ordinal
            THEN {{'lo': f.ordinal, 'hi': c.ordinal, 'a': f.name, 'b': c.name}}
            ELSE {{'lo': c.ordinal, 'hi': f.ordinal, 'a': c.name, 'b': f.name}} END AS p
          FROM forms f JOIN (SELECT *, file_path || chr(1) || name AS key FROM cat) c ON c.key = f.partner)
        SELECT dataset, file_path, file_seq, min(p).a AS name_a, min(p).b AS name_b FROM hits GROUP BY dataset, file_path, file_seq""",
)
def same_file_conflicts(spark, sf_dir):
    return layout.same_file_conflicts(headers(spark, sf_dir))


@query(
    "layout_conflicts_kept_second",
    f"""{_WITH}, later AS ({_partners('a.dataset, a.file_path, a.name AS dropped, b.name AS kept, b.ordinal',
        'cat a JOIN cat b ON a.file_path = b.file_path AND b.ordinal > a.ordinal', 'a.name', 'b.name')}),
        folds AS (SELECT dataset, file_path, dropped, arg_min(kept, ordinal) AS kept FROM later GROUP BY ALL)
        SELECT c.dataset, c.file_path, count(*) - count(f.dropped) AS n_columns, count(f.dropped) AS n_folded,
        coalesce(string_agg(f.kept || '<' || f.dropped, ' ' ORDER BY c.ordinal) FILTER (WHERE f.kept IS NOT NULL), '') AS folds
        FROM cat c LEFT JOIN folds f ON f.file_path = c.file_path AND f.dropped = c.name GROUP BY c.dataset, c.file_path""",
)
def conflicts_kept_second(spark, sf_dir):
    out = layout.resolve_conflicts(headers(spark, sf_dir), "keep_second")
    folds = F.transform("folds", lambda fold: F.concat(fold["kept"], F.lit("<"), fold["dropped"]))
    return out.select(
        "dataset", "file_path", F.size("columns").cast("bigint").alias("n_columns"),
        F.size("folds").cast("bigint").alias("n_folded"), F.array_join(folds, " ").alias("folds"),
    )


@query("layout_plural_groups", f"WITH RECURSIVE {_CATALOG_SQL}, {_PAIRS_SQL}, {_COMPONENTS_SQL} SELECT * FROM components")
def plural_groups(spark, sf_dir):
    return layout.plural_components(layout.dataset_names(headers(spark, sf_dir)))


_RENAME_WITH = f"WITH RECURSIVE {_CATALOG_SQL}, {_PAIRS_SQL}, {_COMPONENTS_SQL}, {_RENAMES_SQL}"


@query("layout_majority_renames", f"{_RENAME_WITH} SELECT * FROM renames")
def majority_renames(spark, sf_dir):
    return layout.canonical_renames(headers(spark, sf_dir))


@query(
    "layout_renames_applied",
    f"""{_RENAME_WITH} SELECT c.dataset, c.file_path, c.file_seq,
        string_agg(coalesce(r.to_name, c.name), ' ' ORDER BY c.ordinal) AS columns
        FROM cat c LEFT JOIN renames r ON r.dataset = c.dataset AND r.from_name = c.name
        GROUP BY c.dataset, c.file_path, c.file_seq""",
)
def renames_applied(spark, sf_dir):
    files = headers(spark, sf_dir)
    out = layout.apply_renames(files, layout.canonical_renames(files))
    return out.withColumn("columns", F.array_join("columns", " "))


@query(
    "layout_missing_columns",
    f"""{_WITH}, {_ISSUES_SQL} SELECT dataset, column_name, column_index::INT AS column_index,
        'Missing column (expected by reference): ' || column_name AS message, count(*) AS n_files
        FROM missing GROUP BY ALL""",
)
def missing_columns(spark, sf_dir):
    """Set difference against the reference, counted per missing column."""
    issues = layout.structure_issues(headers(spark, sf_dir)).where("issue_type = 'missing'")
    return issues.groupBy("dataset", "column_name", "column_index", "message").agg(F.count("*").alias("n_files"))


@query(
    "layout_extra_columns",
    f"""{_WITH}, {_ISSUES_SQL} SELECT dataset, file_path, column_name, column_index::INT AS column_index,
        'Extra column (not in reference): ' || column_name AS message FROM extra""",
)
def extra_columns(spark, sf_dir):
    issues = layout.structure_issues(headers(spark, sf_dir), allow_missing=True)
    return issues.select("dataset", "file_path", "column_name", "column_index", "message")


@query(
    "layout_issue_hints",
    f"""{_WITH}, {_ISSUES_SQL},
        near AS ({_partners('m.dataset, m.file_path, m.issue_type, m.column_name, e.column_name AS other, e.column_index AS place',
          'missing m JOIN extra e ON m.file_path = e.file_path', 'm.column_name', 'e.column_name')}
          UNION ALL {_partners('e.dataset, e.file_path, e.issue_type, e.column_name, r.name, r.ordinal',
          'extra e JOIN ref_cat r ON r.dataset = e.dataset', 'e.column_name', 'r.name')}),
        hinted AS (SELECT dataset, file_path, issue_type, column_name, arg_min(other, place) AS partner FROM near GROUP BY ALL)
        SELECT dataset, file_path, issue_type, column_name,
        'Possible plural/singular: ''' || column_name || ''' vs ''' || partner || '''' AS hint FROM hinted""",
)
def issue_hints(spark, sf_dir):
    """Plural/singular hints of missing and extra columns."""
    issues = layout.structure_issues(headers(spark, sf_dir)).where("hint IS NOT NULL")
    return issues.select("dataset", "file_path", "issue_type", "column_name", "hint")


@query(
    "layout_issue_report",
    f"""{_STEPS}, known AS MATERIALIZED (SELECT dataset || chr(1) || name AS key, name, ordinal FROM ref_cat),
        odd AS MATERIALIZED (
          SELECT n.* FROM (SELECT DISTINCT dataset, name, dataset || chr(1) || name AS key FROM cat) n ANTI JOIN known k ON k.key = n.key),
        forms AS MATERIALIZED (SELECT key, dataset || chr(1) || unnest([name || 's', name || 'es']
          || CASE WHEN name LIKE '%s' THEN [left(name, -1)] ELSE [] END
          || CASE WHEN name LIKE '%es' THEN [left(name, -2)] ELSE [] END) AS partner FROM odd),
        hint AS MATERIALIZED (
          SELECT f.key, arg_min(k.name, k.ordinal) AS partner FROM forms f JOIN known k ON k.key = f.partner GROUP BY f.key)
        SELECT dataset, file_path, 'Column ' || CASE WHEN n < 26 THEN chr(65 + n)
        WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26)
        WHEN n < 18278 THEN chr(65 + (n - 702) // 676) || chr(65 + (n - 702) // 26 % 26) || chr(65 + (n - 702) % 26)
        ELSE chr(65 + (n - 18278) // 17576) || chr(65 + (n - 18278) // 676 % 26) || chr(65 + (n - 18278) // 26 % 26)
            || chr(65 + (n - 18278) % 26) END
        || ' (' || column_name || '): extra - Extra column (not in reference): ' || column_name
        || coalesce(' | Hint: Possible plural/singular: ''' || column_name || ''' vs ''' || partner || '''', '') AS line
        FROM (SELECT dataset, file_path, name AS column_name, ordinal::INT AS n, dataset || chr(1) || name AS key FROM cat)
        SEMI JOIN odd USING (key) LEFT JOIN hint USING (key)""",
)
def issue_report(spark, sf_dir):
    return layout.issue_report(layout.structure_issues(headers(spark, sf_dir), allow_missing=True))


@query(
    "layout_extra_column_files",
    f"{_WITH}, {_ISSUES_SQL} SELECT dataset, column_name, file_path FROM extra",
)
def extra_column_files(spark, sf_dir):
    return layout.extra_column_files(headers(spark, sf_dir))


_REQUIRED = {
    "columns": ["of"], "group_by": ["and"], "sort_by": ["the", "and"],
    "subdirectories": {
        "de": {"columns": ["der"], "group_by": ["und"], "sort_by": None},
        "fr": {"group_by": None, "aggregate_columns": {"le": "sum", "la": "count"}},
    },
}
_REQUIRED_SQL = """required AS (
  SELECT dataset, unnest(CASE dataset WHEN 'de' THEN ['der', 'und'] WHEN 'fr' THEN ['and', 'la', 'le', 'of', 'the']
         ELSE ['and', 'of', 'the'] END) AS name FROM (SELECT DISTINCT dataset FROM cat))"""


@query(
    "layout_required_columns",
    f"{_WITH}, {_REQUIRED_SQL} SELECT dataset, string_agg(name, ',' ORDER BY name) AS required FROM required GROUP BY dataset",
)
def required_columns(spark, sf_dir):
    """Columns that the resolved options of each dataset ask for."""
    options = MergeOptions.from_dict(_REQUIRED)
    datasets = headers(spark, sf_dir).select("dataset").distinct()
    return datasets.select("dataset", F.array_join(options.required_columns(F.col("dataset")), ",").alias("required"))


@query(
    "layout_preflight",
    f"""{_WITH}, {_REQUIRED_SQL} SELECT s.dataset, s.file_path, string_agg(r.name, ',' ORDER BY r.name) AS missing
        FROM sizes s JOIN required r ON r.dataset = s.dataset
        WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.file_path = s.file_path AND c.name = r.name) GROUP BY ALL""",
)
def preflight(spark, sf_dir):
    options = MergeOptions.from_dict(_REQUIRED)
    out = layout.missing_required(headers(spark, sf_dir), options.required_columns(F.col("dataset")))
    return out.select("dataset", "file_path", F.array_join("missing", ",").alias("missing"))


@query(
    "options_per_dataset",
    """SELECT dataset, CASE dataset WHEN 'de' THEN 'der' ELSE 'of' END AS columns,
       CASE dataset WHEN 'de' THEN 'und' WHEN 'fr' THEN '' ELSE 'and' END AS group_by,
       CASE dataset WHEN 'de' THEN '' ELSE 'the,and' END AS sort_by,
       CASE dataset WHEN 'fr' THEN 2 ELSE 0 END::BIGINT AS n_aggregates
       FROM (SELECT DISTINCT lang AS dataset FROM documents)""",
)
def options_per_dataset(spark, sf_dir):
    datasets = [row["dataset"] for row in headers(spark, sf_dir).select("dataset").distinct().collect()]
    out = options_table(spark, MergeOptions.from_dict(_REQUIRED), datasets)
    return out.select(
        "dataset", *[F.array_join(c, ",").alias(c) for c in ("columns", "group_by", "sort_by")],
        F.size("aggregate_columns").cast("bigint").alias("n_aggregates"),
    )
