"""Benchmark passages in training texts, found by spaced-seed hashing.

A spaced seed is a fixed mask over neighbouring tokens: its hash ignores the masked places, so
a substituted token there does no harm. Test and training hashes that agree give a diagonal
(place in the text less place in the item), and the overlap around it is verified token by
token, substitutions allowed.

Tokens are lower-cased runs of letters and digits. An overlap counts as a leak if, on one
diagonal, it has at least ``min(13, item tokens)`` consecutive places of which 80 percent or
more agree, the first and the last included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm.graph import sized
from tabmeld.llm.near_dedup import text_key
from tabmeld.llm.text import ALNUM, Words, mix, pieces
from tabmeld.operators.spread import hot_join
from tabmeld.session import materialize

# Places that each mask keeps, from its first token. Any stretch of LEAST_TOKENS or more of which
# LEAST_SHARE agrees, both ends included, holds one of them: no stretch without a hit agrees that much.
MASKS = ((0, 1, 3, 5, 8, 9), (0, 2, 3, 6, 7, 10), (0, 1, 4, 5, 7, 8), (0, 1, 2, 3, 5, 6), (0, 1, 2, 8, 9, 10))
SPAN = 1 + max(mask[-1] for mask in MASKS)
LEAST_TOKENS = 13
LEAST_SHARE = 0.8
# Seeds of the test side that a task may hold in memory (24 bytes each); more are joined by Spark.
INDEX_ROWS = 2_000_000
# Bits of the filter that training hashes pass before they are joined.
FILTER_BITS = 1 << 24

_STEP = 0x9E3779B97F4A7C15


def short_masks(tokens: int) -> list[tuple[int, ...]]:
    """Masks over a whole item below LEAST_TOKENS tokens: one of them misses all substitutions that it may have.

    The places between the ends are cut into two blocks more than there may be substitutions; each
    mask leaves out as many blocks as there may be substitutions.
    """
    spare = tokens - -(-tokens * 4 // 5)  # substitutions that leave 80 percent
    if not spare:
        return [tuple(range(tokens))]
    blocks = np.array_split(np.arange(1, tokens - 1), spare + 2)
    return [
        tuple(sorted({0, tokens - 1}.union(*(block.tolist() for block in kept)))) for kept in combinations(blocks, 2)
    ]


def masks_for(lengths: set[int]) -> list[tuple[int, ...]]:
    """The fixed masks, and those of each length of items below LEAST_TOKENS."""
    return [*MASKS, *(mask for n in sorted(lengths) if 0 < n < LEAST_TOKENS for mask in short_masks(n))]


def seed_hashes(hashes: np.ndarray, first: np.ndarray, mask: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a mask at every place where it fits inside one text."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined = np.full(n, number + 1, np.uint64)
    for offset in mask:
        joined *= np.uint64(_STEP)
        joined += hashes[offset : offset + n]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    places = np.flatnonzero(left >= span)
    return mix(joined[places]), places


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(agreeing tokens, first item token, tokens) of the longest tolerant overlap on one diagonal.

    Item token i faces text token i + shift. Of overlaps of one length the one with most agreeing
    tokens counts, then the first. Zeros if no overlap is long and close enough.
    """
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    need = min(LEAST_TOKENS, len(item))
    if high - low < need or not need:
        return 0, 0, 0
    same = text[low + shift : high + shift] == item[low:high]
    agreed = np.concatenate(([0], np.cumsum(same)))
    # A stretch from i to j passes if value[j] >= value[i]: 5 * agreed - 4 * length never falls.
    value = 5 * agreed - 4 * np.arange(len(agreed))
    starts = np.flatnonzero(same)
    if len(starts) < LEAST_SHARE * need:
        return 0, 0, 0
    ends = starts + 1
    best = (0, 0, 0)
    # Largest value from each end on tells how far a start can reach.
    reach = np.maximum.accumulate(value[ends][::-1])[::-1]
    for start in starts:
        if high - low - start < max(need, best[2]):
            break
        last = int(np.searchsorted(-reach, -value[start], side="right")) - 1
        if last >= 0:
            end = int(ends[last])
            found = (int(agreed[end] - agreed[start]), int(low + start), int(end - start))
            if found[2] >= need and (found[2], found[0]) > (best[2], best[0]):
                best = found
    return best


def longest_overlap(text: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start in text, start in item, tokens, agreeing tokens) of the longest overlap on any diagonal.

    Then most agreeing tokens, then the first place in the text, then in the item decide. ``shifts``
    rise. A diagonal is left out if it is too short to win, and all that follow a whole, equal item.
    """
    best = (0, 0, 0, 0)
    for shift in shifts.tolist():
        if min(len(item), len(text) - shift) - max(0, -shift) < best[2]:
            continue
        agreed, first, length = best_overlap(text, item, shift)
        if length and (length, agreed, -first - shift, -first) > (best[2], best[3], -best[0], -best[1]):
            best = (first + shift, first, length, agreed)
            if agreed == len(item):
                break
    return best


class Diagonals:
    """Distinct diagonals of one text and one item, in space that grows with their lengths only."""

    def __init__(self, most: int):
        self.most, self.held, self.parts = most, 0, []

    def add(self, shifts: np.ndarray) -> None:
        self.parts.append(shifts)
        self.held += len(shifts)
        if self.held > 2 * self.most + 4096:
            self.parts = [self.all()]
            self.held = len(self.parts[0])

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts))


@dataclass
class Index:
    """Test items in memory: their tokens, and their seeds in the order of the hash."""

    masks: list[tuple[int, ...]]
    seeds: np.ndarray
    items: np.ndarray
    places: np.ndarray
    tokens: dict[int, np.ndarray]


def _hits(texts: list[bytes], masks: list[tuple[int, ...]], passes) -> Iterator[tuple[int, np.ndarray, list, list]]:
    """(index of the text, its tokens, hashes, places of each hash) of every text with hits."""
    words = Words(texts, ALNUM)
    found = [
        (hashes[ok], places[ok])
        for number, mask in enumerate(masks)
        for hashes, places in [seed_hashes(words.hashes, words.first, mask, number)]
        for ok in [passes(hashes)]
    ]
    hashes, places = np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])
    if not len(places):
        return
    owner = np.searchsorted(words.first, places, side="right") - 1
    order = np.lexsort((places, hashes, owner))
    hashes, places, owner = hashes[order], places[order], owner[order]
    begins = np.flatnonzero((np.diff(owner, prepend=-1) > 0) | (np.diff(hashes, prepend=hashes[:1]) != 0))
    ends = np.append(begins[1:], len(places))
    by_text = np.flatnonzero(np.diff(owner[begins], prepend=-1) > 0)
    for low, high in zip(by_text, [*by_text[1:], len(begins)], strict=True):
        text = int(owner[begins[low]])
        start = words.first[text]
        tokens = words.hashes[start : words.first[text + 1]]
        runs = [places[begins[at] : ends[at]] - start for at in range(low, high)]
        yield text, tokens, hashes[begins[low:high]], runs


def _leaks_in_memory(index: Index):
    """Rows (doc_id, item_id, ...) of the longest overlaps, with the test side in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            found, rows = [], []
            for text, tokens, hashes, runs in _hits(texts, index.masks, lambda h: _member(index.seeds, h)):
                low = np.searchsorted(index.seeds, hashes, "left")
                high = np.searchsorted(index.seeds, hashes, "right")
                seen: dict[int, Diagonals] = {}
                for places, begin, end in zip(runs, low, high, strict=True):
                    for at in range(begin, end):
                        item = int(index.items[at])
                        if item not in seen:
                            seen[item] = Diagonals(len(tokens) + len(index.tokens[item]))
                        seen[item].add(places - index.places[at])
                for item, diagonals in seen.items():
                    best = longest_overlap(tokens, index.tokens[item], diagonals.all())
                    if best[2]:
                        rows.append(text)
                        found.append((item, *best))
            yield _leak_batch(piece.column("doc_id").take(pa.array(rows, pa.int64())), found)

    return run


_LEAK = ("doc_id", "item_id", "start_word", "item_word", "n_words", "n_equal")


def _leak_batch(doc_ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * (len(_LEAK) - 1)
    return pa.RecordBatch.from_arrays([doc_ids, *[pa.array(c, pa.int64()) for c in columns]], names=list(_LEAK))


def _member(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array: a bit table rules out almost all, the rest are searched."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    bits = _filter(ordered)
    maybe = np.flatnonzero(bits[(keys >> np.uint64(40)).astype(np.int64)])
    out = np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys[maybe]), len(ordered) - 1)
    out[maybe] = ordered[at] == keys[maybe]
    return out


_filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _filter(ordered: np.ndarray) -> np.ndarray:
    """One flag per value of the upper 24 bits; built once per array and process."""
    known = _filters.get(id(ordered))
    if known is None or known[0] is not ordered:
        flags = np.zeros(FILTER_BITS, bool)
        flags[(ordered >> np.uint64(40)).astype(np.int64)] = True
        _filters.clear()
        known = _filters[id(ordered)] = (ordered, flags)
    return known[1]


def _seed_rows(masks: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            words = Words(texts, ALNUM)
            for number, mask in enumerate(masks):
                hashes, places = seed_hashes(words.hashes, words.first, mask, number)
                owner = np.searchsorted(words.first, places, side="right") - 1
                if number >= len(MASKS):  # the masks of one length are for items of that length
                    whole = words.counts()[owner] == mask[-1] + 1
                    hashes, places, owner = hashes[whole], places[whole], owner[whole]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        piece.column("item_id").take(pa.array(owner)),
                        pa.array(places - words.first[owner]),
                    ],
                    names=["hash", "item_id", "item_place"],
                )

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in pieces(batches):
        words = Words(texts, ALNUM)
        cells = [words.hashes[words.first[i] : words.first[i + 1]].tobytes() for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays(
            [piece.column("item_id"), pa.array(cells, pa.binary()), pa.array(words.counts())],
            names=["item_id", "item_tokens", "n_tokens"],
        )


def _hit_rows(masks: list[tuple[int, ...]], passes):
    """Texts with hits: their tokens, and the places of each hash."""
    kinds = {"tokens": pa.binary(), "hashes": pa.list_(pa.int64()), "places": pa.list_(pa.list_(pa.int64()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            rows, out = [], {name: [] for name in kinds}
            for text, tokens, hashes, runs in _hits(texts, masks, passes):
                rows.append(text)
                out["tokens"].append(tokens.tobytes())
                out["hashes"].append(hashes.view(np.int64))
                out["places"].append([run.tolist() for run in runs])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(out[name], kind) for name, kind in kinds.items()]],
                names=["doc_id", *kinds],
            )

    return run


def _overlap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("tokens", "item_id", "item_tokens", "met")
    for batch in batches:
        found, rows = [], []
        for row, (tokens, item, item_tokens, met) in enumerate(zip(*[batch.column(n).to_pylist() for n in names], strict=True)):
            text, test = np.frombuffer(tokens, np.uint64), np.frombuffer(item_tokens, np.uint64)
            diagonals = Diagonals(len(text) + len(test))
            for seeds in met:
                places = np.array(seeds["places"], np.int64)
                for place in seeds["item_places"]:
                    diagonals.add(places - place)
            best = longest_overlap(text, test, diagonals.all())
            if best[2]:
                rows.append(row)
                found.append((item, *best))
        yield _leak_batch(batch.column("doc_id").take(pa.array(rows, pa.int64())), found)


def _leaks_by_join(chosen: DataFrame, seeds: DataFrame, tokens: DataFrame, masks: list, schema: str) -> DataFrame:
    """The same leaks by joins on the hash and the item, for a test side of any size.

    Training hashes first pass a filter of fixed size made from all test hashes.
    """
    slot = F.shiftrightunsigned("hash", 40)
    words = (
        seeds.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    flags = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        flags[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    shared = chosen.sparkSession.sparkContext.broadcast(flags)

    def passes(hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> np.uint64(40)
        held = shared.value[(slots >> np.uint64(6)).astype(np.int64)]
        return (held >> (slots & np.uint64(63))) & np.uint64(1) > 0

    kind = chosen.schema["doc_id"].dataType.simpleString()
    hits = materialize(
        chosen.mapInArrow(
            _hit_rows(masks, passes),
            f"doc_id {kind}, tokens binary, hashes array<bigint>, places array<array<bigint>>",
        ).withColumn("hit", F.monotonically_increasing_id()),
        "hits",
    )
    met = hits.select("hit", F.explode(F.arrays_zip("hashes", "places")).alias("at")).select(
        "hit", F.col("at.hashes").alias("hash"), F.col("at.places").alias("places")
    )
    # One row per hash and item, and per hash and text, however often it repeats in them.
    held = seeds.groupBy("hash", "item_id").agg(F.collect_list("item_place").alias("item_places"))
    pairs = (
        hot_join(met, held, "hash", ["hit"])
        .groupBy("hit", "item_id")
        .agg(F.collect_list(F.struct("places", "item_places")).alias("met"))
    )
    return (
        pairs.join(hits.select("hit", "doc_id", "tokens"), "hit")
        .join(tokens.select("item_id", "item_tokens"), "item_id")
        .select("doc_id", "tokens", "item_id", "item_tokens", "met")
        .mapInArrow(_overlap_rows, schema)
    )


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: Column, index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row per (document, item) that overlap: the longest overlap's place, length and agreement.

    Overlaps are measured over whole texts. Ties go to the overlap with most agreeing words, then to
    the first in the document, then in the item. Long and repetitive texts take work in proportion
    to their diagonals; a word that many texts repeat is one row for each text and item. ``start_word`` counts the document's words from 0 and ``item_word`` the item's; ``n_equal`` of
    ``n_words`` agree; ``share`` is ``n_equal`` over the item's words. Items whose id or text is null
    and items without words leak nowhere; null and empty documents hold nothing; rows that repeat
    a doc_id are one document; a null doc_id is carried as such. Items with one id are parts of one
    item. An empty table on either side gives an empty table.
    """
    chosen = docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start_word long, item_word long, n_words long, n_equal long"
    # Parts of one item are told apart by a number of their own.
    tests = (
        items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("item_id").cast("long").alias("_item"), F.col("text").cast("binary").alias("text"))
        .distinct()
        .withColumn("item_id", F.monotonically_increasing_id())
    )
    tests = materialize(tests, "tests")
    tokens = materialize(
        tests.select("item_id", "text").mapInArrow(_token_rows, "item_id long, item_tokens binary, n_tokens long"),
        "tokens",
    )
    # Fewer than LEAST_TOKENS different lengths.
    short = {row.n_tokens for row in tokens.where(F.col("n_tokens") < LEAST_TOKENS).select("n_tokens").distinct().collect()}
    masks = masks_for(short)
    seeds = materialize(
        tests.select("item_id", "text").mapInArrow(_seed_rows(masks), "hash long, item_id long, item_place long"),
        "seeds",
    )
    # Few seeds: every task holds them. The items' tokens are about as many as their seeds.
    if max(seeds.count(), tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]) <= index_rows:
        rows = seeds.orderBy("hash", "item_id", "item_place").toArrow()
        index = Index(
            masks,
            np.sort(rows.column("hash").to_numpy().view(np.uint64)),
            np.empty(0, np.int64),
            np.empty(0, np.int64),
            {row.item_id: np.frombuffer(row.item_tokens, np.uint64) for row in tokens.collect()},
        )
        order = np.argsort(rows.column("hash").to_numpy().view(np.uint64), kind="stable")
        index.items = rows.column("item_id").to_numpy()[order]
        index.places = rows.column("item_place").to_numpy()[order]
        leaks = chosen.mapInArrow(_leaks_in_memory(index), schema)
    else:
        leaks = _leaks_by_join(chosen, seeds, tokens, masks, schema)
    longest = F.max(F.struct("n_words", "n_equal", (-F.col("start_word")).alias("s"), (-F.col("item_word")).alias("i")))
    named = leaks.join(F.broadcast(tests.select("item_id", "_item")) if tests.count() <= index_rows else tests, "item_id")
    sizes = tests.join(tokens, "item_id").groupBy("_item").agg(F.max("n_tokens").alias("_size"))
    return (
        named.groupBy("doc_id", "_item")
        .agg(longest.alias("best"))
        .join(sizes, "_item")
        .select(
            "doc_id",
            F.col("_item").alias("item_id"),
            (-F.col("best.s")).alias("start_word"),
            (-F.col("best.i")).alias("item_word"),
            "best.n_words",
            "best.n_equal",
            (F.col("best.n_equal") / F.col("_size")).alias("share"),
        )
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark passage, with all their columns."""
    key = text_key(F.col("text"))
    leaks = find_leaks(docs, items, key).select(F.col("doc_id").alias("_leak")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), key.alias("_key"))
    leaked = sized(materialize(leaks, "leaks"))
    return rows.join(leaked, F.col("_key") == F.col("_leak"), "left_anti").select("_row.*")
