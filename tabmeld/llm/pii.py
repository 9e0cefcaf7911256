"""Personal data: fixed rules, and learned selection among overlapping candidates.

Generators of high recall propose spans with regular expressions. Four of them are rules of
their own (email, ip, card, phone; a failing match is dropped). Three looser ones (contact,
number, secret) propose further spans, which may overlap each other and the rules' spans. Boosted
regression trees over format and context features give each of those a probability; a threshold
per kind, set for precision on candidates held out of the fit, selects the spans to redact.

There are no labelled spans to learn from. Teachers label candidates instead, by evidence that
the trees do not see: a contact is personal if it holds a valid address, a number if the digits
of a valid card, phone or ip meet it, a secret if a word such as "token" or "password" assigns
it. The trees see formats and neighbouring characters only, and so carry the teachers' verdict
over to candidates of the same look that no rule covers. What a teacher confirms is always
redacted; the trees decide about the rest only.

A contact or number that the rules reject counts as clean, as they test its content. A secret
without a cue counts as unlabelled: the cue is taken to stand beside a share of the secrets that
does not depend on their look, estimated from held-out secrets with a cue.

All work on rows is done by column expressions. Features have few values, so the fit needs only
one count per combination of them, which bounds what the driver gets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.session import materialize

# Quantifiers are possessive and starts are anchored where that can't change a match, so that
# long runs of digits or letters take linear time and no stack.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "contact": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9][A-Za-z0-9.-]*+",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
KINDS = (*RULES, *LOOSE)
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CUE = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|credential)[\"']?\s*[:=]\s*[\"']?$"
CONTEXT = 32

TREES = 24
RATE = 0.3
PRECISION = 0.9
FIT_PARTS = 5
# Kinds whose candidates are unlabelled, not clean, where the teacher confirms nothing.
UNLABELLED = ("secret",)


def _cuts(value: Column, limits: tuple[float, ...]) -> Column:
    """How many of the rising limits a value reaches."""
    return reduce(lambda out, at: F.when(value >= limits[at], at + 1).otherwise(out), range(len(limits)), F.lit(0))


def _without(text: Column, classes: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, classes, ""))


def luhn(digits: Column) -> Column:
    """True for a string of digits whose Luhn sum ends in 0."""
    def add(total: Column, at: Column) -> Column:
        digit = F.substring(F.reverse(digits), at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def candidates(docs: DataFrame, doc_id: Column) -> DataFrame:
    """(row, doc_id, kind, value, start, end, before, after): every match, one row with null kind if none.

    Offsets count code points, the end exclusive. ``row`` numbers the documents.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        doc_id.alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("t"),
    )
    # Cheap tests spare most texts the costly patterns.
    guards = {
        "email": F.contains("t", F.lit("@")),
        "ip": F.col("t").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("t").rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains("t", F.lit("+")),
        "contact": F.contains("t", F.lit("@")) | F.contains("t", F.lit("(at)")) | F.contains("t", F.lit("[at]")),
        "number": F.col("t").rlike(r"[0-9][\x20().\x2F-]{0,2}[0-9][\x20().\x2F-]{0,2}[0-9]"),
        "secret": F.col("t").rlike(r"[0-9]"),
    }
    patterns = RULES | LOOSE
    nothing = F.array().cast("array<string>")
    found = base.select(
        "*",
        *[
            F.when(guards[kind], F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(nothing).alias(f"m_{kind}")
            for kind, pattern in patterns.items()
        ],
    )
    cut = found.select(
        "row",
        "doc_id",
        *[f"m_{kind}" for kind in KINDS],
        *[
            F.when(F.size(f"m_{kind}") > 0, F.split("t", pattern, -1)).otherwise(nothing).alias(f"p_{kind}")
            for kind, pattern in patterns.items()
        ],
    )

    def rows(kind: str) -> Column:
        matches, gaps = F.col(f"m_{kind}"), F.col(f"p_{kind}")
        zipped = F.arrays_zip(matches.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("n"))
        made = F.transform(
            zipped,
            lambda x, at: F.struct(
                F.lit(kind).alias("kind"),
                at.alias("at"),
                x["m"].alias("value"),
                F.length(x["g"]).alias("gap"),
                F.right(x["g"], F.lit(CONTEXT)).alias("before"),
                F.left(x["n"], F.lit(CONTEXT)).alias("after"),
            ),
        )
        return F.filter(made, lambda x: x["value"].isNotNull())

    exploded = cut.select("row", "doc_id", F.explode_outer(F.concat(*[rows(kind) for kind in KINDS])).alias("c"))
    flat = exploded.select("row", "doc_id", "c.*")
    run = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("value")).over(run)
    return flat.repartition("row").select(
        "row", "doc_id", "kind", "value", "before", "after",
        ends.cast("long").alias("end"),
        (ends - F.length("value")).cast("long").alias("start"),
    )


def judge_rules(rows: DataFrame) -> DataFrame:
    """Add ``valid``: whether a match of one of the four rules passes its test (null for other kinds)."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    count = F.length(digits)
    valid = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$"))
        .when(F.col("kind") == "card", F.when(count.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", count.between(9, 15))
    )
    return rows.withColumn("valid", valid)


FEATURES = ("size", "digits", "letters", "marks", "upper", "runs", "before", "after")


def _features() -> list[Column]:
    """Small whole numbers: format of the value, and the characters beside it."""
    value, size = F.col("value"), F.length("value")
    digits, letters = _without(value, "[0-9]+"), _without(value, "[A-Za-z]+")
    marks = size - digits - letters
    upper = _without(value, "[A-Z]+")
    runs = F.length(F.regexp_replace(F.regexp_replace(value, "[^0-9]+", ""), "([0-9])\\1+", "")) + 0
    beside = lambda text, at: (
        F.when(F.length(text) == 0, 0)
        .when(F.substring(text, at, 1).rlike(r"[\s]"), 1)
        .when(F.substring(text, at, 1).rlike(r"[\"'=:(\[]"), 2)
        .when(F.substring(text, at, 1).rlike(r"[0-9A-Za-z]"), 3)
        .otherwise(4)
    )
    columns = (
        _cuts(size, (8, 10, 12, 16, 20, 32, 48)),
        _cuts(digits / size, (0.01, 0.2, 0.4, 0.6, 0.8, 1.0)),
        _cuts(letters / size, (0.01, 0.2, 0.4, 0.6, 0.8, 1.0)),
        _cuts(marks, (1, 2, 3, 4, 6)),
        _cuts(upper / size, (0.01, 0.5)),
        _cuts(runs, (1, 5, 9, 13, 16)),
        beside(F.col("before"), -1),
        beside(F.col("after"), 1),
    )
    return [column.cast("int").alias(name) for name, column in zip(FEATURES, columns, strict=True)]


@dataclass
class Selector:
    """Boosted trees of two levels for one kind, and the log odds from which a candidate is selected."""

    start: float
    trees: list[tuple]
    threshold: float


def _split(cells: list[tuple], residuals: list[float], at: list[int]) -> tuple | None:
    """(gain, feature, limit): the split of the cells ``at`` that lowers the squared error most."""
    best = None
    weight = sum(cells[i][1] for i in at)
    total = sum(cells[i][1] * residuals[i] for i in at)
    for feature in range(len(FEATURES)):
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for i in at:
            slot = sums[cells[i][0][feature]]
            slot[0] += cells[i][1]
            slot[1] += cells[i][1] * residuals[i]
        below, below_sum = 0.0, 0.0
        for limit in sorted(sums)[:-1]:
            below += sums[limit][0]
            below_sum += sums[limit][1]
            gain = below_sum**2 / below + (total - below_sum) ** 2 / (weight - below)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, feature, limit)
    return best


def _grow(cells: list[tuple], residuals: list[float], chances: list[float], at: list[int], levels: int) -> tuple:
    split = _split(cells, residuals, at) if levels else None
    if split is None:
        top = sum(cells[i][1] * residuals[i] for i in at)
        low = sum(cells[i][1] * chances[i] * (1 - chances[i]) for i in at) + 1.0
        return ("leaf", max(-4.0, min(4.0, top / low)))
    _, feature, limit = split
    left = [i for i in at if cells[i][0][feature] <= limit]
    right = [i for i in at if cells[i][0][feature] > limit]
    return ("split", feature, limit, *(_grow(cells, residuals, chances, part, levels - 1) for part in (left, right)))


def _value(tree: tuple, features: tuple) -> float:
    while tree[0] == "split":
        tree = tree[3] if features[tree[1]] <= tree[2] else tree[4]
    return tree[1]


def fit(counts: list[tuple[tuple, bool, int, int]], unlabelled: bool = False) -> Selector | None:
    """Fit one kind on (features, part held out?, candidates, positive ones) and set its threshold.

    The threshold is the lowest score, even odds at least, from which candidates held out are
    personal with the wanted precision; None without a positive candidate or such a score. With
    ``unlabelled``, a candidate that is not positive counts as personal by its estimated chance
    (Elkan and Noto), which no number of missing cues brings down for a whole look. Without a
    positive candidate on either side of the split, all are fitted and judged.
    """
    if any(not any(good for _, held, _, good in counts if held == side) for side in (True, False)):
        counts = [(features, held, n, good) for features, _, n, good in counts for held in (True, False)]
    cells = [(features, n, good) for features, held, n, good in counts if not held and n]
    if not sum(good for *_, good in cells):
        return None
    n, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((good + 1) / (n - good + 1))
    scores = [start] * len(cells)
    trees = []
    for _ in range(TREES):
        chances = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        residuals = [c[2] / c[1] - p for c, p in zip(cells, chances, strict=True)]
        tree = _grow(cells, residuals, chances, list(range(len(cells))), 2)
        trees.append(tree)
        scores = [s + RATE * _value(tree, c[0]) for s, c in zip(scores, cells, strict=True)]
    judged: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for features, held, count, positive in counts:
        if held:
            slot = judged[round(start + RATE * sum(_value(tree, features) for tree in trees), 9)]
            slot[0] += count
            slot[1] += positive
    odds = {score: math.exp(max(-30.0, min(30.0, score))) for score in judged}
    share = 1.0  # of the personal candidates, how many are positive
    if unlabelled:
        # One more that is surely positive keeps a few positives from calling everything personal.
        positives = sum(positive for _, positive in judged.values())
        told = sum(positive * odds[score] / (1 + odds[score]) for score, (_, positive) in judged.items())
        share = (told + 1) / (positives + 1)
    threshold, seen, right = None, 0, 0.0
    ordered = sorted(judged, reverse=True)
    even = math.log(share / (2 - share))  # the score at which a candidate is personal by even odds
    for at, score in enumerate(ordered):
        if score < even:  # less likely than not, however precise the scores above are
            break
        count, positive = judged[score]
        seen += count
        right += positive + (count - positive) * min(1.0, (1 - share) / share * odds[score])
        if right >= PRECISION * seen:
            # Halfway to the next lower score, as rare combinations score between those that were held out.
            threshold = max(even, (score + ordered[at + 1]) / 2) if at + 1 < len(ordered) else even
    return None if threshold is None else Selector(start, trees, threshold - 1e-6)


def _expression(tree: tuple, cell: Column) -> Column:
    if tree[0] == "leaf":
        return F.lit(float(tree[1]))
    _, feature, limit, left, right = tree
    return F.when(cell[FEATURES[feature]] <= limit, _expression(left, cell)).otherwise(_expression(right, cell))


def _selected(selector: Selector, cell: Column) -> Column:
    scores = [_expression(tree, cell) * RATE for tree in selector.trees]
    return reduce(lambda a, b: a + b, scores, F.lit(selector.start)) >= selector.threshold


def _meet(span: Column, other: Column) -> Column:
    return (span["start"] < other["end"]) & (other["start"] < span["end"])


def gather(rows: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``sure`` (the rules' valid spans) and ``loose`` (candidates with features)."""
    rank = reduce(lambda out, at: F.when(F.col("kind") == KINDS[at], at).otherwise(out), range(len(KINDS)), F.lit(-1))
    span = [rank.cast("int").alias("rank"), F.col("start"), F.col("end"), F.col("kind")]
    loose = F.struct(*span, *_features(), F.col("before").rlike(CUE).alias("cue"))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.collect_list(F.when(F.col("valid"), F.struct(*span))).alias("sure"),
        F.collect_list(F.when(F.col("kind").isin(*LOOSE), loose)).alias("loose"),
    )


def train(gathered: DataFrame, held_out: Column) -> dict[str, Selector]:
    """Fit the loose kinds on all candidates. The driver gets one count per combination of features.

    That is at most 8*7*7*6*3*6*5*5 combinations a kind, and in practice a few hundred.
    """

    def teach(cell: Column) -> Column:
        met = lambda email: F.exists("sure", lambda s: ((s["kind"] == "email") == F.lit(email)) & _meet(cell, s))
        return (
            F.when(cell["kind"] == "contact", met(True))
            .when(cell["kind"] == "number", met(False))
            .otherwise(cell["cue"])
        )

    taught = F.transform("loose", lambda c: F.struct(c.alias("cell"), teach(c).alias("positive")))
    counted = (
        gathered.where(F.size("loose") > 0)
        .select(held_out.alias("held"), F.explode(taught).alias("c"))
        .select("held", "c.cell.*", "c.positive")
        .groupBy("kind", *FEATURES, "held")
        .agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("good"))
        .collect()
    )
    by_kind: dict[str, list] = defaultdict(list)
    for row in sorted(counted):
        by_kind[row.kind].append((tuple(row[name] for name in FEATURES), row.held, row.n, row.good))
    fitted = {kind: fit(counts, kind in UNLABELLED) for kind, counts in by_kind.items()}
    return {kind: selector for kind, selector in fitted.items() if selector is not None}


def _added(kind: str, selector: Selector | None) -> Column:
    """Spans of a kind beside those in ``found``: selected ones that meet none, and cued ones that none covers.

    A valid rule's span confirms a contact or a number, and is in ``found`` itself.
    """

    def wanted(cell: Column) -> Column:
        covered = F.exists("found", lambda f: (f["start"] <= cell["start"]) & (cell["end"] <= f["end"]))
        out = F.lit(kind == "secret") & F.coalesce(cell["cue"], F.lit(False)) & ~covered
        if selector is not None:
            out = out | (_selected(selector, cell) & ~F.exists("found", lambda f: _meet(cell, f)))
        return (cell["kind"] == kind) & out

    return F.transform(F.filter("loose", wanted), lambda c: F.struct(c["rank"], c["start"], c["end"], c["kind"]))


def find_personal_data(docs: DataFrame, doc_id: Column) -> DataFrame:
    """doc_id and ``found`` for every row: an array of (rank of the kind, start, end, kind), sorted.

    The four rules' valid matches are all there, and so are secrets that a cue confirms, unless one
    rule's span covers all of them. Any other loose candidate is added if the trees select it and no
    rule's span, and no added loose span of an earlier kind in the order secret, contact, number,
    meets it. Null and empty texts and texts without matches give an empty array;
    repeated rows get equal results; long texts are searched whole; an empty table gives an empty table.
    """
    gathered = materialize(gather(judge_rules(candidates(docs, doc_id))), "candidates")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FIT_PARTS == 0
    selectors = train(gathered, held)
    out = gathered.withColumnRenamed("sure", "found")
    for kind in ("secret", "contact", "number"):
        out = out.withColumn("found", F.concat("found", _added(kind, selectors.get(kind))))
    return out.select("doc_id", F.array_sort("found").alias("found"))


def redact(text: Column, found: Column) -> Column:
    """The text with every span of ``found`` replaced by its kind in brackets; spans that meet go as one, by the first's kind."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        piece = F.concat(state["text"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.when(
            s["start"] >= state["at"], F.struct(piece.alias("text"), s["end"].alias("at"))
        ).otherwise(F.struct(state["text"].alias("text"), F.greatest(state["at"], s["end"]).alias("at")))

    return F.aggregate(
        ordered, start, add,
        lambda state: F.concat(state["text"], F.substring(text, state["at"].cast("int") + 1, F.length(text))),
    )
