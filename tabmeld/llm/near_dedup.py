"""Near-duplicate classes by Order MinHash and banded alignment.

Words are lower-cased runs of letters and digits; k-mers are five consecutive words (a text of
one to four words is one k-mer). Two texts are near copies if

* the longest common subsequence L of their words, of n and m words, has L / (n + m - L) >= 0.8, and
* their occurrence-labelled k-mers have a Jaccard similarity of 0.5 or more, as they have if every
  fifteenth word of a text is replaced. This tells copies from texts that share a long passage.

Texts without words are near copies only of the same text.

* Sketch: 32 times, the three smallest of a text's occurrence-labelled k-mers under a hash, kept in
  text order, make one bucket key. Two texts of k-mer similarity 0.5 share one of them with a
  probability of 0.986, from 0.6 on with 0.9995.
* Stars: in every bucket each text meets the bucket's hub, the text with the most company in
  all its buckets. Verified pairs are linked, and linked texts form components.
* Rest: texts of buckets of three texts or more that still hold several components meet all texts of
  other components there, and the join drops pairs that can't be near copies. A text sets one bit for
  each of its k-mers, so bits of one text alone count k-mers that the other lacks; of the pairs that
  this leaves, the words are compared without their order. Of the pairs left, one for each text and
  component is verified first; the pairs whose texts are still in two components follow, all of them.
  Nothing is capped or sampled.
* Verification: the k-mers first, then L by banded alignment, row by row on bit vectors. A similarity
  of 0.8 allows at most (n + m) / 9 words outside the alignment, so matches further than that off
  the diagonal can't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmeld.llm.graph import components, sized
from tabmeld.llm.text import ALNUM, Words, mix, pieces, windows
from tabmeld.operators.spread import hot_join
from tabmeld.session import materialize

K = 5
SIMILARITY = 0.8
KMER_SIMILARITY = 0.5
# Bits of the signatures that bound the k-mers that two texts share; those of long texts bound it less sharply.
KMER_BITS = 2048
SKETCHES = 32
MINIMA = 3

_SEED = np.random.default_rng(31)
_FACTORS = _SEED.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _SEED.integers(1, 2**63, SKETCHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 21


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of one text's word hashes."""
    if 0 < len(hashes) < K:
        whole = np.full(1, len(hashes), np.uint64)
        for value in hashes:
            whole = whole * _STEP + value
        return mix(whole)
    return windows(hashes, np.array([0, len(hashes)]), K)[0]


def label_occurrences(values: np.ndarray) -> np.ndarray:
    """Mix into each value how often it occurred before in the array."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if new.all():
        return values
    begins = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    seen = np.empty(len(values), np.uint64)
    seen[order] = np.arange(len(values)) - begins
    return np.where(seen > 0, mix(values + seen * _STEP), values)


def _minima(values: np.ndarray, sketches: int, minima: int) -> np.ndarray:
    """One key per hash function: its smallest values in text order, joined."""
    minima = min(minima, len(values))
    keys = np.empty(sketches, np.uint64)
    block = max(1, _CELLS // len(values))
    for low in range(0, sketches, block):
        high = min(low + block, sketches)
        ranks = (values[None, :] ^ _MASKS[low:high, None]) * _FACTORS[low:high, None]
        ranks ^= ranks >> np.uint64(32)
        limit = np.partition(ranks, minima - 1, axis=1)[:, minima - 1]
        rows, places = np.nonzero(ranks <= limit[:, None])
        if len(rows) != minima * (high - low):  # equal ranks: the first places count
            firsts = np.searchsorted(rows, np.arange(high - low))
            chosen = np.arange(len(rows)) - firsts[rows] < minima
            places = places[chosen]
        picked = values[places].reshape(high - low, minima)
        joined = np.arange(low, high, dtype=np.uint64) + np.uint64(1000 * minima)
        for column in range(minima):
            joined = joined * _STEP + picked[:, column]
        keys[low:high] = mix(joined)
    return keys


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of k-mers, bucket keys) of one text's word hashes."""
    values = kmers(hashes)
    if not len(values):
        return 0, np.empty(0, np.uint64)
    return len(values), _minima(label_occurrences(values), SKETCHES, MINIMA)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in pieces(batches):
        words = Words(texts, ALNUM)
        made = [sketch(words.hashes[words.first[i] : words.first[i + 1]]) for i in range(len(texts))]
        sizes = pa.array([size for size, _ in made], pa.int32())
        keys = pa.array([key.view(np.int64) for _, key in made], pa.list_(pa.int64()))
        columns = [piece.column(i) for i in range(piece.num_columns) if piece.schema.names[i] != "text"]
        names = [name for name in piece.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, sizes, keys], names=[*names, "n", "buckets"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in pieces(batches):
        words = Words(texts, ALNUM)
        small = words.hashes.astype(np.uint32)
        cells = [small[words.first[i] : words.first[i + 1]].tobytes() for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(cells, pa.binary())], names=["key", "words"])


def common_length(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences among matches at most ``band`` off the diagonal."""
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    if not size:
        return head
    differ = np.flatnonzero(a[::-1][:size] != b[::-1][:size])
    tail = int(differ[0]) if len(differ) else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    return head + tail + _aligned(a, b, band)


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by one bit vector over the columns of the band: a bit is zero where L grows.

    Columns that the band has left keep their bits, which are counted and dropped; columns that it
    has yet to reach have ones.
    """
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, high = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    width = 2 * band + 1
    ones, top = (1 << width) - 1, 1 << (width - 1)
    state, base, length = ones, -band, 0  # bit 0 stands for column ``base``
    for row, (begin, end) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        if row:
            length += not state & 1
            state, base = state >> 1 | top, base + 1
        if begin == end:
            continue
        places = order[begin:end]
        if end - begin > 1:
            first, last = np.searchsorted(places, (base, base + width))  # rising, as the sort is stable
            places = places[first:last]
            if len(places) > 64:
                bits = np.zeros(width, np.uint8)
                bits[places - base] = 1
                match = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                match = 0
                for place in places.tolist():
                    match |= 1 << (place - base)
        else:
            offset = int(places[0]) - base
            match = 1 << offset if 0 <= offset < width else 0
        held = state & match
        if held:
            state = ((state + held) | (state & ~match)) & ones
    return length + width - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Ordered word similarity of near copies by their word hashes; exact from 0.8 on, else maybe lower than exact.

    0 for texts that share too few k-mers.
    """
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    total = len(a) + len(b)
    if not len(a) or not len(b) or kmer_similarity(a, b) < KMER_SIMILARITY:
        return 0.0
    common = common_length(a, b, int(total * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9))
    return common / (total - common)


def kmer_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the occurrence-labelled k-mers of two texts' word hashes."""
    a, b = label_occurrences(kmers(a)), label_occurrences(kmers(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        found = [
            similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
            for x, y in zip(left, right, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )


def hub_join(big: DataFrame, small: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Inner join on a text key that many rows of ``big`` may share; their task's share goes to several."""
    spot = F.xxhash64(key)
    right = small.withColumn("_spot", spot).withColumnRenamed(key, "_same")
    joined = hot_join(big.withColumn("_spot", spot), right, "_spot", spread_by)
    return joined.where(F.col(key) == F.col("_same")).drop("_spot", "_same")


def verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys that are near copies, with their similarity.

    Many pairs may share ``a``, the hub of their bucket.
    """
    first = words.select(F.col("key").alias("a"), F.col("words").alias("left"))
    second = words.select(F.col("key").alias("b"), F.col("words").alias("right"))
    met = hub_join(materialize(pairs, "pairs"), first, "a", ["b"])
    joined = met.join(second, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(_verify_rows, "a binary, b binary, similarity double").where(
        F.col("similarity") >= SIMILARITY
    )


def _lengths_fit(n: Column, m: Column) -> Column:
    """Whether texts of so many k-mers can have words enough in common."""
    return F.least(n, m) + (K - 1) >= SIMILARITY * (F.greatest(n, m) + (K - 1))


_SIGNATURE = [f"k{i}" for i in range(KMER_BITS // 64)]


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each of a text's occurrence-labelled words, and a bit for each of its labelled k-mers.

    ``n_words`` counts the words; ``w_spare`` and ``k_spare`` are how many words and k-mers share their bits with others.
    """
    names = ["n_words", "w_spare", "k_spare", *_SIGNATURE]
    for batch in batches:
        bags, rows = [], []
        for cell in batch.column("words").to_pylist():
            hashes = np.frombuffer(cell, np.uint32).astype(np.uint64)
            labelled = label_occurrences(kmers(hashes))
            flags = np.zeros(KMER_BITS, bool)
            flags[labelled & np.uint64(KMER_BITS - 1)] = True
            bags.append(np.unique(label_occurrences(hashes).astype(np.uint32)).view(np.int32))
            spare = [len(hashes), len(hashes) - len(bags[-1]), len(labelled) - int(flags.sum())]
            rows.append(np.concatenate((spare, np.packbits(flags, bitorder="little").view(np.int64))))
        columns = np.array(rows, np.int64).reshape(len(rows), len(names)).T
        cells = [pa.array(np.ascontiguousarray(column)) for column in columns]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(bags, pa.list_(pa.int32())), *cells], names=["key", "bag", *names]
        )


def _rest_pairs(members: DataFrame, linked: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) between components that share a bucket and have words enough in common.

    ``members`` has (bucket, key, n), ``linked`` (key, root) of the texts in components. ``root`` is the
    component of ``b``, and ``rank`` the number of common words.
    """
    placed = members.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("texts")
    ).where("parts > 1 and texts > 2")  # a bucket of two has been settled by its star
    # Texts outside the largest component of a bucket seek; all texts of the bucket are sought.
    texts = materialize(
        placed.join(largest, "bucket").select("bucket", "key", "n", "root", (F.col("root") != F.col("top.root")).alias("seeks")),
        "rest",
    )
    own = texts.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))  # at most 32
    schema = ", ".join(["key binary, bag array<int>, n_words long, w_spare long, k_spare long", *[f"{c} long" for c in _SIGNATURE]])
    bags = words.join(own, "key").select("key", "words").mapInArrow(_bag_rows, schema)
    bags = materialize(bags.join(own, "key"), "bags")
    met = texts.join(bags, "key")
    seekers = met.where("seeks").select("bucket", *[F.col(c).alias(f"s_{c}") for c in met.columns if c not in ("bucket", "seeks")])
    # Bits that both have, and those that share a bit: no fewer than the k-mers that both have.
    both = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseAND(F.col(f"s_{c}"))) for c in _SIGNATURE])
    most_kmers = both + F.least("k_spare", "s_k_spare")
    # A common subsequence is no longer than the number of words that both have.
    most_words = F.size(F.array_intersect("bag", "s_bag")) + F.least("w_spare", "s_w_spare")
    shared, spot = F.array_intersect("buckets", "s_buckets"), F.xxhash64("key", "s_key")
    # Conditions run in this order, cheap ones first.
    return (
        seekers.join(met, "bucket")
        .where((F.col("root") != F.col("s_root")) & _lengths_fit(F.col("n"), F.col("s_n")))
        # Two seekers meet from both sides.
        .where(~F.col("seeks") | (F.col("s_key") < F.col("key")))
        .where(most_kmers >= KMER_SIMILARITY / (1 + KMER_SIMILARITY) * (F.col("n") + F.col("s_n")) - 1e-6)
        # In one of the buckets that both share, which their hash picks, so that pairs of one group meet in several.
        .where(F.col("bucket") == F.element_at(F.array_sort(shared), (F.pmod(spot, F.size(shared)) + 1).cast("int")))
        .where(most_words >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_words") + F.col("s_n_words")) - 1e-6)
        .select(F.col("s_key").alias("a"), F.col("key").alias("b"), "root", most_words.alias("rank"))
    )


def _with_rest(members: DataFrame, linked: DataFrame, words: DataFrame) -> DataFrame:
    """(key, root) of the texts in components, those of ``linked`` joined by the links between them."""
    pairs = materialize(_rest_pairs(members, linked, words), "rest_pairs")
    if pairs.isEmpty():
        return linked

    def joined(more: DataFrame) -> DataFrame:
        edges = linked.select(F.col("key").alias("a"), F.col("root").alias("b")).union(more)
        return materialize(components(edges).select(F.col("node").alias("key"), "root"), "linked")

    # A link to one text of a component settles the pairs with its others.
    firsts = pairs.groupBy("a", "root").agg(F.max(F.struct("rank", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    firsts = materialize(firsts, "firsts")
    found = materialize(verify(firsts, words).select("a", "b"), "links")
    left = pairs.select("a", "b").join(firsts, ["a", "b"], "left_anti")
    if not found.isEmpty():
        linked = joined(found)
        for end in ("a", "b"):
            own = linked.select(F.col("key").alias(end), F.col("root").alias(f"root_{end}"))
            left = left.join(own, end, "left")
        left = left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    left = materialize(left, "left_pairs")
    found = materialize(verify(left, words).select("a", "b"), "links")
    return linked if found.isEmpty() else joined(found)


def near_classes(docs: DataFrame, row: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``row`` columns and ``key`` of every document, and (key, root) of linked texts.

    A text key that is missing from ``classes`` is alone in its class (with its exact copies).
    """
    chosen = docs.select(
        *[column.alias(name) for name, column in row.items()],
        text_key(F.col("text")).alias("key"),
        F.col("text").cast("binary").alias("text"),
    )
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text"]
    rows = materialize(
        chosen.mapInArrow(_sketch_rows, ", ".join([*kept, "n int, buckets array<bigint>"])), "sketches"
    )
    # Exact copies meet first, inside the tasks: one row per text goes on.
    texts = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    dealt = texts.select("key", "n", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("company")).where("company > 1")
    company = Window.partitionBy("key")  # at most 48 buckets
    members = materialize(
        dealt.join(shared, "bucket").withColumn("company", F.sum("company").over(company)), "members"
    )
    hubs = members.groupBy("bucket").agg(F.max(F.struct("company", "n", "key")).alias("hub"))
    stars = (
        members.join(hubs, "bucket")
        .where((F.col("key") != F.col("hub.key")) & _lengths_fit(F.col("n"), F.col("hub.n")))
        .select(F.col("hub.key").alias("a"), F.col("key").alias("b"))
        .distinct()
    )
    wanted = sized(materialize(members.select("key").distinct(), "wanted"))
    words = materialize(
        chosen.select("key", "text")
        .join(wanted, "key", "left_semi")
        .mapInArrow(_word_rows, "key binary, words binary")
        .groupBy("key")
        .agg(F.first("words").alias("words")),
        "words",
    )
    links = materialize(verify(stars, words).select("a", "b"), "links")
    linked = materialize(
        components(links).select(F.col("node").alias("key"), "root"), "linked"
    )
    return rows.drop("n", "buckets"), _with_rest(members, linked, words)


def dedup_classes(docs: DataFrame, doc_id: Column) -> DataFrame:
    """doc_id, ``class_id``, ``class_size`` and ``kept`` for every row.

    ``class_id`` is the smallest doc_id of the class (null if it has none), ``class_size`` its number
    of rows. ``kept`` marks the row with that doc_id (of several texts under one id, the one with
    the smallest key; rows equal in both are all marked). Null texts count as empty, all
    empty texts are one class, and an empty table gives an empty table. Long texts are sketched and
    aligned whole, on bit vectors as wide as the band.
    """
    rows, classes = near_classes(docs, {"doc_id": doc_id})
    # Per distinct text first, so a large group of copies is one row in all that follows.
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows"))
    placed = materialize(texts.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    first = F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("key")))
    chosen = placed.groupBy("root").agg(first.alias("first"), F.sum("_rows").alias("class_size"))
    per_text = hub_join(placed, chosen, "root", ["key"]).select(
        "key", F.col("first.id").alias("class_id"), F.col("first.key").alias("_kept_key"), "class_size"
    )
    return rows.join(per_text, "key").select(
        "doc_id",
        "class_id",
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("_kept_key"))).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies, with all its columns.

    It is the row with the smallest doc_id (nulls last), then text key, then hash of all columns;
    rows that are equal in all of that count once.
    """
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    names = [f.name for f in docs.schema]
    rows, classes = near_classes(docs, {"id": F.col("doc_id"), "hash": hashed})
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("hash").alias("hash"))
    texts = rows.groupBy("key").agg(F.min(rank).alias("rank"), F.count("*").alias("n"))
    placed = materialize(texts.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    chosen = placed.groupBy("root").agg(
        F.min(F.struct("rank.none", "rank.id", "key", "rank.hash")).alias("first"), F.sum("n").alias("n")
    ).where("n > 1")
    # Only texts of classes with several rows: the others stay as they are.
    decided = hub_join(placed, chosen.select("root", "first"), "root", ["key"]).select(
        F.col("key").alias("_key"), F.col("first.key").alias("_first_key"), F.col("first.hash").alias("_first_hash")
    )
    decided = materialize(decided, "decided")
    marked = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), text_key(F.col("text")).alias("_key"), hashed.alias("_hash")
    ).join(sized(decided), "_key", "left")
    alone = marked.where(F.col("_first_key").isNull())
    firsts = marked.where((F.col("_first_key") == F.col("_key")) & (F.col("_first_hash") == F.col("_hash")))
    # Rows that are equal in every column: one of them is as good as any other.
    once = firsts.groupBy("_key").agg(F.first("_row").alias("_row"))
    return alone.select("_row.*").unionByName(once.select("_row.*"))
