"""Mixing sources to target weights by weighted sampling without replacement in each source.

A source whose target exceeds its size is first taken whole, as often as it fits (complete
epochs). The rest is drawn by the exponential keys of Efraimidis and Spirakis: each document
gets ``-ln(u) / w`` with a uniform ``u`` from a hash of its identity and its quality weight
``w``; the smallest keys of a source are taken until its token budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.llm.graph import sized
from tabmeld.llm.prefix import with_running_sums
from tabmeld.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"
# 13 hexadecimal digits: the largest whole number of them that a double holds exactly.
HASH_DIGITS = 13
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space (space, tab to carriage return); null: 0."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), " \t\n\v\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: one less the share of symbol characters, ten times over. Empty and null texts: 1."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOLS, ""))
    share = F.when(length > 0, symbols.cast("double") / length).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * F.coalesce(share, F.lit(0.0)))


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) from an MD5 hash of the parts; equal parts give equal numbers."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def source_targets(
    df: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS
) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    Sources in code point order (null last) weigh ``weights``, repeating, and share the sum of
    all sizes; no target exceeds ``most`` times its source's size, and what is over is shared
    again by weight. That is one water level: a source is full when its limit per weight lies
    below the level, so running sums over the sources by that ratio find it in one pass.
    """
    sizes = df.groupBy(F.col(source).alias("_of")).agg(F.sum(size).cast("long").alias("source_size"))
    # One row per source from here on.
    place = F.row_number().over(Window.orderBy(F.col("_of").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("source_size").cast("double") * float(most))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_of").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    levels = weighed.select(
        "*",
        (
            (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_limit").over(filling), F.lit(0.0)))
            / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filling), F.lit(0.0)))
        ).alias("_level"),
    )
    # Levels fall from the first source that is not full on, and that one has the final level.
    final = F.max(F.when(F.col("_limit") >= F.col("_level") * F.col("_weight"), F.col("_level"))).over(everything)
    return levels.withColumn("_final", final).select(
        "_of",
        "source_size",
        F.when(F.col("_final").isNull(), F.col("_limit"))
        .otherwise(F.least(F.col("_limit"), F.col("_final") * F.col("_weight")))
        .alias("target"),
    )


def mix_sources(
    df: DataFrame,
    source: str,
    size: str,
    quality: str,
    identity: Sequence[str],
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_EPOCHS,
) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` of each row in the mix and ``taken`` (their words).

    ``size`` is a whole number (0 or more) and ``quality`` positive. Every row of a source is
    taken ``floor(target / source_size)`` times; rows by rising key then share the rest, and the
    row in which the budget ends counts if it lies more than half inside. Keys depend only on
    ``identity``, so reruns agree; rows that tie in all of these columns are interchangeable.
    Null sources are one source; sources without words have the target 0; an empty table gives
    an empty table. A text longer than its target's rest is left out of the last epoch unless half of it
    fits. Columns named like the results are replaced.
    """
    added = ("source_size", "target", "copies", "taken")
    kept = [name for name in df.columns if name not in added]
    # Written once: the sort samples its input, and the targets need it too.
    keyed = materialize(
        df.select(*kept, (-F.log(uniform(*[F.col(c) for c in identity])) / F.col(quality)).alias("_key")), "keyed"
    )
    order = [F.col(source).asc_nulls_last(), F.col("_key"), *[F.col(c).asc_nulls_first() for c in identity], F.col(size)]
    summed = with_running_sums(keyed, order, {"_before": size}, "mix")
    targets = source_targets(keyed, source, size, weights, most)
    begins = Window.orderBy(F.col("_of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    targets = targets.withColumn("_begin", F.coalesce(F.sum("source_size").over(begins), F.lit(0)))
    joined = summed.join(targets, summed[source].eqNullSafe(targets["_of"]), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    inside = F.col("_before") - F.col("_begin") + F.col(size) / 2.0 <= F.col("_rest")
    return (
        joined.withColumn("_epochs", F.least(epochs, F.lit(int(most))))
        .withColumn("_rest", rest)
        .withColumn("copies", (F.col("_epochs") + F.when(inside & (F.col("_epochs") < most), 1).otherwise(0)).cast("int"))
        .withColumn("taken", (F.col(size) * F.col("copies")).cast("long"))
        .select(*kept, "source_size", "target", "copies", "taken")
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.

    A document's size is its words. Rows that are equal in doc_id, source and text share their
    copies: they come back as that many rows equal to one of them.
    """
    identity = {
        "_id": F.col("doc_id"),
        "_source": F.col("source"),
        "_md5": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
    }
    sized_rows = docs.select(
        *[column.alias(name) for name, column in identity.items()],
        word_count(F.col("text")).alias("size"),
        quality_weight(F.col("text")).alias("quality"),
    )
    taken = mix_sources(sized_rows, "_source", "size", "quality", ["_id", "_md5"], weights, most)
    decided = materialize(
        taken.groupBy(*[F.col(name).alias(f"{name}_r") for name in identity])
        .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
        .where("_copies > 0"),
        "mixed",
    )
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), *[c.alias(n) for n, c in identity.items()])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}_r")) for name in identity])
    matched = rows.join(sized(decided), same).select("_row", "_copies", "_rows", *identity)
    once = matched.where("_rows = 1").select("_row", "_copies")
    # Of rows that repeat, one stands for all.
    repeated = matched.where("_rows > 1").groupBy(*identity).agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
    every = once.unionByName(repeated.select("_row", "_copies"))
    return every.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")
