"""Header rules on hand-made names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabmeld.functions.names import (
    NameRules,
    clean_header,
    column_letters,
    is_plural_pair,
    singular,
    strip,
)
from tabmeld.operators.union import cleaned_names, normalize_columns


def cleaned(spark, names, **rules):
    header = F.array(*[F.lit(name) for name in names])
    return spark.range(1).select(clean_header(header, NameRules(**rules)).alias("c")).first()["c"]


def test_default_rules(spark):
    raw = ["  seller \t domain ", " date", "ZIPCODE", "Coût (€)", "\x1cname\x85", "e  mail"]
    assert cleaned(spark, raw) == ["seller domain", "Date", "ZIP", "Coût (€)", "Name", "e mail"]


def test_lowercase_runs_before_standard_spelling(spark):
    assert cleaned(spark, ["EMAIL", "Foo"], lowercase=True) == ["Email", "foo"]


def test_special_characters_keep_letters_of_any_script(spark):
    raw = ["Coût (€)", "a-b_c!", "数量#", "½ x"]
    assert cleaned(spark, raw, remove_special_chars=True) == ["Coût ", "a-b_c", "数量", "½ x"]


def test_singular_is_not_taken_when_already_a_column(spark):
    raw = ["Brands", "Brand", "Cities", "Names", "Sales", "s", "es", "ies", "bus"]
    out = cleaned(spark, raw, normalize_plural_singular=True)
    assert out == ["Brands", "Brand", "City", "Nam", "Sal", "s", "e", "i", "bu"]


@pytest.mark.parametrize(
    ("word", "one"), [("ies", "i"), ("parties", "party"), ("es", "e"), ("s", "s"), ("boxes", "box"), ("", "")]
)
def test_singular_length_guards(spark, word, one):
    assert spark.range(1).select(singular(F.lit(word)).alias("x")).first()["x"] == one


def test_aliases_win_over_patterns_and_first_pattern_wins(spark):
    rules = dict(
        aliases={"Cost (USD)": "Alias"},
        patterns=(("Cost", "Base"), ("Cost", "Second"), ("a.b", "Dotted")),
    )
    raw = ["Cost (USD)", "Cost(EUR) ", "Cost", "Cost (a) (b)", "a.b (x)", "axb (x)"]
    assert cleaned(spark, raw, **rules) == ["Alias", "Base", "Cost", "Cost (a) (b)", "Dotted", "axb (x)"]


def test_disabled_rules_change_nothing(spark):
    assert cleaned(spark, [" id "], enabled=False, aliases={"id": "x"}) == [" id "]


def test_rules_are_idempotent_without_singular(spark):
    once = cleaned(spark, ["  A   b ", "zip_code", "x\ty"], remove_special_chars=True)
    assert cleaned(spark, once, remove_special_chars=True) == once


def test_plural_pair_definition(spark):
    cases = [("Brand", "Brands", True), ("box", "boxes", True), ("a", "a", False), ("", "s", False),
             (" Brand ", "Brands", True), ("Brand", "brands", False), ("x", "xss", False)]
    for left, right, expected in cases:
        assert spark.range(1).select(is_plural_pair(F.lit(left), F.lit(right)).alias("p")).first()["p"] is expected
        assert spark.range(1).select(is_plural_pair(F.lit(right), F.lit(left)).alias("p")).first()["p"] is expected


def test_column_letters_match_counting(spark):
    rows = spark.range(0, 20_000).select("id", column_letters(F.col("id")).alias("x")).orderBy("id").collect()

    def spell(n):
        out = ""
        n += 1
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(65 + digit) + out
        return out

    assert [row["x"] for row in rows] == [spell(row["id"]) for row in rows]


def test_strip_matches_python(spark):
    texts = [chr(c) + "x" + chr(c) for c in [*range(1, 0x100), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", strip(F.col("t")).alias("s")).collect()
    assert all(row["s"] == row["t"].strip() for row in out)


def test_normalize_columns_of_a_frame(spark):
    df = spark.createDataFrame([(1, None, "a.b"), (None, 5, "c")], "` id` int, ID int, `x.y (z)` string")
    out = normalize_columns(df)
    assert out.columns == ["ID", "x.y (z)"]
    assert [tuple(row) for row in out.orderBy("ID").collect()] == [(1, "a.b"), (5, "c")]
    with pytest.raises(ValueError, match="share a name"):
        normalize_columns(df, on_duplicate="error")
    assert cleaned_names(df, NameRules())[1] == ["' id' → 'ID'"]


def test_plurals_of_wide_headers_are_not_compared_with_all_names(spark):
    import time

    n = 40_000
    raw = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("n"), i.cast("string"))),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit("s"))),
        F.array(F.lit("p7"), F.lit(" wide  name ")),
    )
    header = spark.range(1).select(F.when(F.col("id") >= 0, raw).alias("raw"))
    clean = clean_header(F.col("raw"), NameRules(normalize_plural_singular=True))
    start = time.perf_counter()
    out = header.select(clean.alias("c")).first()["c"]
    assert time.perf_counter() - start < 10
    assert out[n - 1] == f"n{n}" and out[n + 6] == "p7s" and out[n + 7] == "p8" and out[-2:] == ["p7", "wide name"]
