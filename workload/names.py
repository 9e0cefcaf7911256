"""Header rules. Texts of the given tables stand in for header names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmeld.functions.names import (
    NameRules,
    canonical_name,
    clean_header,
    clean_name,
    collapse_spaces,
    column_letters,
    drop_special,
    header_changes,
    is_plural_pair,
    singular,
    standard_spelling,
    strip,
)
from tabmeld.operators.spread import widen
from workload import query, table

# White space as the engine sees it, written as an RE2 class.
SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"


def sql_strip(name: str) -> str:
    return f"regexp_replace({name}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_collapse(name: str) -> str:
    return f"regexp_replace({name}, '{SPACE}+', ' ', 'g')"


def sql_drop_special(name: str) -> str:
    return f"regexp_replace({name}, '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}-]', '', 'g')"


def sql_standard(name: str) -> str:
    return (
        f"CASE lower({name}) WHEN 'id' THEN 'ID' WHEN 'date' THEN 'Date' WHEN 'name' THEN 'Name' "
        "WHEN 'email' THEN 'Email' WHEN 'phone' THEN 'Phone' WHEN 'address' THEN 'Address' "
        "WHEN 'city' THEN 'City' WHEN 'state' THEN 'State' WHEN 'zip' THEN 'ZIP' "
        f"WHEN 'zipcode' THEN 'ZIP' WHEN 'zip_code' THEN 'ZIP' ELSE {name} END"
    )


def sql_singular(name: str) -> str:
    return (
        f"CASE WHEN {name} LIKE '%ies' AND length({name}) > 3 THEN {name}[:-4] || 'y' "
        f"WHEN {name} LIKE '%es' AND length({name}) > 2 THEN {name}[:-3] "
        f"WHEN {name} LIKE '%s' AND length({name}) > 1 THEN {name}[:-2] ELSE {name} END"
    )


# Part rows with noisy spacing around and inside the name.
_NOISY_SQL = (
    "SELECT p_partkey, chr(160) || '  ' || replace(p_name, ' ', '  ' || chr(8195) || chr(9)) || chr(10) || ' ' AS raw "
    "FROM part"
)


def _noisy(spark, sf_dir):
    raw = F.concat(
        F.lit("   "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   \t")), F.lit("\n ")
    )
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query("name_strip", f"SELECT p_partkey, {sql_strip('raw')} AS name FROM ({_NOISY_SQL})")
def name_strip(spark, sf_dir):
    return _noisy(spark, sf_dir).select("p_partkey", strip(F.col("raw")).alias("name"))


@query("name_collapse_spaces", f"SELECT p_partkey, {sql_collapse('raw')} AS name FROM ({_NOISY_SQL})")
def name_collapse(spark, sf_dir):
    return _noisy(spark, sf_dir).select("p_partkey", collapse_spaces(F.col("raw")).alias("name"))


@query("name_lowercase", "SELECT conv_id, turn, lower(text) AS name FROM conversations")
def name_lowercase(spark, sf_dir):
    rules = NameRules(strip_whitespace=False, normalize_spaces=False, lowercase=True, handle_common_variations=False)
    name = clean_name(F.col("text"), None, rules)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"))


@query("name_drop_special", f"SELECT page_id, {sql_drop_special('html')} AS name FROM pages")
def name_drop_special(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", drop_special(F.col("html")).alias("name"))


_SPELLINGS = ("id", "Date", "NAME", "e-mail", "Email", "phone", "Address", "cItY", "state", "zip", "ZipCode", "zip_code", "ids")


@query(
    "name_standard_spelling",
    f"SELECT p_partkey, {sql_standard('raw')} AS name FROM (SELECT p_partkey, "
    f"({list(_SPELLINGS)})[p_partkey % {len(_SPELLINGS)} + 1] AS raw FROM part)",
)
def name_standard(spark, sf_dir):
    spellings = F.array(*[F.lit(name) for name in _SPELLINGS])
    raw = F.element_at(spellings, (F.col("p_partkey") % len(_SPELLINGS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", standard_spelling(raw).alias("name"))


_WORDS_SQL = r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents"


def _words(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda word: word != "")
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", words.alias("words"))


@query(
    "name_singular",
    f"SELECT doc_id, array_to_string(list_transform(words, lambda w: {sql_singular('w')}), ' ') AS names FROM ({_WORDS_SQL})",
)
def name_singular(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.array_join(F.transform("words", singular), " ").alias("names"))


@query(
    "name_singular_unless_taken",
    f"""SELECT doc_id, array_to_string(list_transform(words, lambda w:
        CASE WHEN list_contains(words, {sql_singular('w')}) THEN w ELSE {sql_singular('w')} END), ' ') AS names
        FROM ({_WORDS_SQL})""",
)
def name_singular_guarded(spark, sf_dir):
    """A plural stays when its singular is already a column of the file."""
    rules = NameRules(handle_common_variations=False, normalize_plural_singular=True)
    return _words(spark, sf_dir).select("doc_id", F.array_join(clean_header(F.col("words"), rules), " ").alias("names"))


@query(
    "name_aliases",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Segment (Construction)' WHEN 'MACHINERY' THEN 'Machines'
       ELSE c_mktsegment END AS name FROM customer""",
)
def name_aliases(spark, sf_dir):
    aliases = {"BUILDING": "Segment (Construction)", "MACHINERY": "Machines"}
    name = canonical_name(F.col("c_mktsegment"), aliases, [("BUILDING", "never")])
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


@query(
    "name_patterns",
    r"""SELECT p_partkey, CASE WHEN raw = 'Brand#3 (SMALL)' THEN 'aliased'
        WHEN regexp_matches(raw, '^Brand#1\s*\([^)]*\)\s*$') THEN 'Brand one'
        WHEN regexp_matches(raw, '^Brand#2\s*\([^)]*\)\s*$') THEN 'Brand two'
        ELSE raw END AS name
        FROM (SELECT p_partkey, p_brand || CASE WHEN p_size > 25 THEN ' (' || p_type || ')' ELSE '' END AS raw FROM part)""",
)
def name_patterns(spark, sf_dir):
    raw = F.concat("p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""))
    rules = [("Brand#1", "Brand one"), ("Brand#2", "Brand two"), ("Brand#2", "never"), ("", "never")]
    name = canonical_name(raw, {"Brand#3 (SMALL)": "aliased"}, rules)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def _full_sql(line: str) -> str:
    cleaned = sql_drop_special(f"lower({sql_collapse(sql_strip(line))})")
    return sql_standard(cleaned)


_LINES_SQL = "SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents"
_ALL_RULES = NameRules(lowercase=True, remove_special_chars=True)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("raw"))


@query(
    "name_all_rules",
    f"SELECT doc_id, array_to_string(list_transform(raw, lambda x: {_full_sql('x')}), chr(10)) AS names FROM ({_LINES_SQL})",
)
def name_all_rules(spark, sf_dir):
    """Every line of a document as a header name, through all rules in order."""
    clean = clean_header(F.col("raw"), _ALL_RULES)
    return _lines(spark, sf_dir).select("doc_id", F.array_join(clean, "\n").alias("names"))


@query(
    "name_change_log",
    f"""SELECT doc_id, len(changes) AS n_changes, array_to_string(changes, chr(10)) AS changes FROM (
        SELECT doc_id, list_transform(list_filter(raw, lambda x: x <> {_full_sql('x')}),
        lambda x: '''' || x || ''' → ''' || {_full_sql('x')} || '''') AS changes FROM ({_LINES_SQL}))""",
)
def name_change_log(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("clean", clean_header(F.col("raw"), _ALL_RULES))
    changes = header_changes(F.col("raw"), F.col("clean"))
    return lines.select("doc_id", changes.alias("changes")).select(
        "doc_id", F.size("changes").cast("bigint").alias("n_changes"), F.array_join("changes", "\n").alias("changes")
    )


@query(
    "name_plural_pair_test",
    """SELECT p_partkey, coalesce(a <> '' AND b <> '' AND (a = b || 's' OR b = a || 's' OR a = b || 'es' OR b = a || 'es'), false)
       AS is_pair FROM (SELECT p_partkey, p_type AS a,
       CASE WHEN p_size < 10 THEN p_type || 's' WHEN p_size < 20 THEN p_type || 'es' WHEN p_size < 30 THEN p_type[:-2]
            WHEN p_size < 40 THEN '' ELSE p_type END AS b FROM part)""",
)
def plural_pair_test(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_type")
    other = (
        F.when(size < 10, F.concat(kind, F.lit("s "))).when(size < 20, F.concat(F.lit(" "), kind, F.lit("es")))
        .when(size < 30, F.expr("substring(p_type, 1, length(p_type) - 1)")).when(size < 40, "").otherwise(kind)
    )
    return table(spark, sf_dir, "part").select("p_partkey", is_plural_pair(kind, other).alias("is_pair"))


@query(
    "column_letters",
    """SELECT o_orderkey, CASE WHEN n < 26 THEN chr(65 + n)
       WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26)
       WHEN n < 18278 THEN chr(65 + (n - 702) // 676) || chr(65 + (n - 702) // 26 % 26) || chr(65 + (n - 702) % 26)
       ELSE chr(65 + (n - 18278) // 17576) || chr(65 + (n - 18278) // 676 % 26) || chr(65 + (n - 18278) // 26 % 26)
            || chr(65 + (n - 18278) % 26) END AS letters
       FROM (SELECT o_orderkey, o_orderkey::INT AS n FROM orders)""",
)
def letters(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", column_letters(F.col("o_orderkey")).alias("letters"))
