"""Header-name rules as Spark column expressions.

Every rule maps a string column to a string column, so one projection normalises the
headers of any number of files. Regular expressions carry ``(?U)`` because header
whitespace is Unicode whitespace.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole names (compared in lower case) and their standard spelling.
STANDARD_NAMES = {
    "id": "ID",
    "date": "Date",
    "name": "Name",
    "email": "Email",
    "phone": "Phone",
    "address": "Address",
    "city": "City",
    "state": "State",
    "zip": "ZIP",
    "zipcode": "ZIP",
    "zip_code": "ZIP",
}

# Unicode white space plus the four ASCII separator controls.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a class by code point, which is far cheaper to match than the properties that ``(?U)`` looks up.
_SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@dataclass(frozen=True)
class NameRules:
    """Which header rules run, and the alias / pattern tables."""

    enabled: bool = True
    strip_whitespace: bool = True
    normalize_spaces: bool = True
    lowercase: bool = False
    remove_special_chars: bool = False
    handle_common_variations: bool = True
    normalize_plural_singular: bool = False
    aliases: Mapping[str, str] = field(default_factory=dict)
    patterns: tuple[tuple[str, str], ...] = ()

    def with_switches(self, switches: Mapping[str, bool] | None) -> NameRules:
        return replace(self, **dict(switches or {}))


def quoted(name: str) -> str:
    """Back-quoted column reference; header names may hold dots and parentheses."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def strip(name: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(name, F.lit(WHITE_SPACE))


def strip_all(names: Column) -> Column:
    """:func:`strip` of every name of an array; one look tells whether any name has white space at all."""
    return F.when(F.array_join(names, "").rlike(_SPACE), F.transform(names, strip)).otherwise(names)


def collapse_spaces(name: Column) -> Column:
    """One plain space for every run of white space."""
    return F.regexp_replace(name, rf"{_SPACE}+", " ")


def drop_special(name: Column) -> Column:
    """Keep letters, digits, underscore, white space and hyphen."""
    return F.regexp_replace(name, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")


def standard_spelling(name: Column) -> Column:
    """Replace a whole name by its standard spelling, whatever its case."""
    return F.coalesce(_lookup(STANDARD_NAMES, F.lower(name)), name)


def singular(name: Column) -> Column:
    """Strip a plural ending: ``ies`` to ``y``, otherwise ``es``, otherwise ``s``."""
    size = F.length(name)
    return (
        F.when(name.endswith("ies") & (size > 3), F.concat(F.substring(name, F.lit(1), size - 3), F.lit("y")))
        .when(name.endswith("es") & (size > 2), F.substring(name, F.lit(1), size - 2))
        .when(name.endswith("s") & (size > 1), F.substring(name, F.lit(1), size - 1))
        .otherwise(name)
    )


def canonical_name(name: Column, aliases: Mapping[str, str], patterns: Iterable[tuple[str, str]]) -> Column:
    """Exact aliases first; then the first ``base (anything)`` rule that matches."""
    by_rule = name
    for base, canonical in reversed([rule for rule in patterns if rule[0]]):
        shape = rf"(?U)^{re.escape(base)}\s*\([^)]*\)\s*$"
        by_rule = F.when(name.rlike(shape), F.lit(canonical)).otherwise(by_rule)
    return F.coalesce(_lookup(aliases, name), by_rule) if aliases else by_rule


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once per row, so that a lambda does not compute it once per element."""
    return F.transform(F.array(value), body)[0]


def _respell(name: Column, rules: NameRules) -> Column:
    """White space, case, special characters and standard spellings, in this order."""
    out = name
    if rules.strip_whitespace:
        out = strip(out)
    if rules.normalize_spaces:
        out = collapse_spaces(out)
    if rules.lowercase:
        out = F.lower(out)
    if rules.remove_special_chars:
        out = drop_special(out)
    return let(out, standard_spelling) if rules.handle_common_variations else out


def _respell_header(raw_header: Column, rules: NameRules) -> Column:
    """:func:`_respell` of every name; one look tells whether any name has white space to deal with."""
    spaceless = replace(rules, strip_whitespace=False, normalize_spaces=False)
    return F.when(
        F.array_join(raw_header, "").rlike(_SPACE), F.transform(raw_header, lambda name: _respell(name, rules))
    ).otherwise(F.transform(raw_header, lambda name: _respell(name, spaceless)))


def _standardise(name: Column, taken: Column | None, rules: NameRules) -> Column:
    """What follows :func:`_respell`: plurals, then aliases and patterns."""

    def unless_taken(plural: Column) -> Column:
        if taken is None:
            return singular(plural)
        return let(
            singular(plural), lambda one: F.when((one != plural) & F.array_contains(taken, one), plural).otherwise(one)
        )

    out = name
    if rules.normalize_plural_singular:
        out = let(out, unless_taken)
    if rules.aliases or rules.patterns:
        out = let(out, lambda clean: canonical_name(clean, rules.aliases, rules.patterns))
    return out


def clean_name(name: Column, taken: Column | None, rules: NameRules) -> Column:
    """All header rules in order. ``taken`` is an array of names that a plural must not become."""
    if not rules.enabled:
        return name
    return _standardise(_respell(name, rules), taken, rules)


def clean_header(raw_header: Column, rules: NameRules) -> Column:
    """Clean a whole header held as an array of names."""
    if not (rules.enabled and rules.normalize_plural_singular):
        return F.transform(raw_header, lambda name: clean_name(name, None, rules))

    def cleaned(spelled: Column) -> Column:
        # Raw names that some plural's singular would collide with: found by hashing, and few, as
        # names that are no plurals collide with nothing.
        singulars = F.transform(spelled, lambda name: let(singular(name), lambda one: F.when(one != name, one)))
        return let(
            F.array_intersect(raw_header, F.array_compact(singulars)),
            lambda taken: F.transform(spelled, lambda name: _standardise(name, taken, rules)),
        )

    return let(_respell_header(raw_header, rules), cleaned)


def header_changes(raw_header: Column, clean: Column) -> Column:
    """Array of ``'raw' → 'clean'`` lines for the names that changed."""
    pairs = F.zip_with(
        raw_header,
        clean,
        lambda raw, new: F.when(raw != new, F.format_string("'%s' → '%s'", raw, new)),
    )
    return F.array_compact(pairs)


def longer_forms(name: Column) -> Column:
    """The two names that count as plurals of ``name``."""
    return F.array(F.concat(name, F.lit("s")), F.concat(name, F.lit("es")))


def shorter_forms(name: Column) -> Column:
    """The names of which ``name`` counts as a plural; NULL where there is none."""
    size = F.length(name)
    return F.array(
        F.when(name.endswith("s") & (size > 1), F.substring(name, F.lit(1), size - 1)),
        F.when(name.endswith("es") & (size > 2), F.substring(name, F.lit(1), size - 2)),
    )


def plural_forms(name: Column) -> Column:
    """Every name that forms a plural/singular pair with ``name`` (and NULLs)."""
    return F.concat(longer_forms(name), shorter_forms(name))


def is_plural_pair(left: Column, right: Column) -> Column:
    """True when one trimmed name is the other plus ``s`` or ``es``; blanks never pair."""
    a, b = strip(left), strip(right)
    match = (
        (a == F.concat(b, F.lit("s")))
        | (b == F.concat(a, F.lit("s")))
        | (a == F.concat(b, F.lit("es")))
        | (b == F.concat(a, F.lit("es")))
    )
    return F.coalesce((left != "") & (right != "") & match, F.lit(False))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a 0-based position: 0 is A, 25 is Z, 26 is AA."""
    index = index.cast("bigint")
    out = F.lit(None).cast("string")
    start = sum(26**k for k in range(1, 6))
    for width in range(5, 0, -1):
        start -= 26**width
        offset = index - F.lit(start)
        letters = [
            F.char(F.lit(65) + F.pmod(F.floor(offset / F.lit(26**place)), F.lit(26)))
            for place in range(width - 1, -1, -1)
        ]
        out = F.when(index < start + 26**width, F.concat(*letters)).otherwise(out)
    return out


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)
