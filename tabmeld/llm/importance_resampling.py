"""Documents drawn so that their n-grams resemble those of a target text.

Features are all runs of one to three words, hashed into buckets by their CRC-32. A bucket's gain
is the log ratio of its smoothed shares in the target and in the raw texts; a document's weight is
the sum of its features' gains, and the highest weights after Gumbel noise are drawn, which samples
without replacement in proportion to exp(weight).

Tasks work on whole Arrow arrays: words are lower-cased (ascii_lower), cut (split_pattern_regex,
list_flatten) and coded (dictionary_encode). Codes shifted by one and two words form the pairs and
triples; each distinct one gets its CRC once, from the CRCs of its words, and take carries bucket
gains back to the places, where segments are summed. Spark adds up the bucket counts, of which
there are BUCKETS whatever the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm.prefix import with_running_sums
from tabmeld.session import materialize

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000

# Everything but ASCII letters (lower-cased before), digits and what lies beyond ASCII.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Bytes of text that are split at once (one text at least), and places whose n-grams are coded at once.
_PIECE = 8 << 20
_PLACES = 1 << 20


def _crc_byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _crc_shift_tables(powers: int = 31) -> np.ndarray:
    """For each power of two, four tables that carry a CRC over that many zero bytes."""
    byte = _crc_byte_table()
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = byte[bits & 255] ^ (bits >> 8)  # of every single bit, over one byte
    out = np.empty((powers, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for power in range(powers):
        for part in range(4):
            column = np.zeros(256, np.uint32)
            for bit in range(8):
                column ^= np.where(values >> bit & 1, images[8 * part + bit], 0).astype(np.uint32)
            out[power, part] = column
        images = _shift(out[power], images)
    return out


def _shift(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return tables[0][crcs & 255] ^ tables[1][crcs >> 8 & 255] ^ tables[2][crcs >> 16 & 255] ^ tables[3][crcs >> 24]


_SHIFTS = _crc_shift_tables()


def crc_joined(crcs: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings followed by tails, from the CRCs of both and the tails' lengths."""
    out = crcs.copy()
    power, left = 0, lengths.copy()
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = _shift(_SHIFTS[power], out[at])
        left >>= 1
        power += 1
    return out ^ tails


class Words:
    """The words of some texts as codes of a dictionary; ``first`` has the border of each text."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
        words = pc.list_flatten(lists)
        filled = pc.not_equal(words, "")
        owner = pc.list_parent_indices(lists).filter(filled)
        coded = words.filter(filled).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.searchsorted(owner.to_numpy(zero_copy_only=False), np.arange(len(texts) + 1))
        spellings = coded.dictionary.cast(pa.binary())
        self.crcs = np.fromiter(map(zlib.crc32, spellings.to_pylist()), np.uint32, len(spellings))
        self.lengths = 1 + pc.binary_length(spellings).to_numpy(zero_copy_only=False).astype(np.int64)
        # The CRC of a blank and the word.
        self.tails = crc_joined(np.full(len(spellings), zlib.crc32(b" "), np.uint32), self.crcs, self.lengths - 1)

    def buckets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, places, buckets) of n-grams, block by block; a place is its n-gram's first word."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        for low in range(0, len(self.codes), _PLACES):
            codes = self.codes[low : low + _PLACES + LONGEST - 1]
            places = np.arange(min(_PLACES, len(self.codes) - low))
            crcs, grams = self.crcs, codes[places]  # n-gram of each place, as an index into crcs
            yield low, places, (crcs % BUCKETS).astype(np.int64)[grams]
            for step in range(1, LONGEST):
                inside = ends[low + places] > low + places + step
                places, grams = places[inside], grams[inside]
                pairs = pa.array(grams * len(self.lengths) + codes[places + step]).dictionary_encode()
                distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
                before, last = np.divmod(distinct, max(1, len(self.lengths)))
                crcs = crc_joined(crcs[before], self.tails[last], self.lengths[last])
                grams = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                of_pair = pa.array((crcs % BUCKETS).astype(np.int64))
                yield low, places, pc.take(of_pair, pairs.indices).to_numpy(zero_copy_only=False)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts hold about _PIECE bytes, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            held = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, held + _PIECE, "right")))
            yield batch.slice(low, high - low)
            low = high


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for piece in _pieces(batches):
        for _, _, buckets in Words(piece.column("text")).buckets():
            counts += np.bincount(buckets, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def _weigh_rows(gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = pa.array(gains.value)
        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            sums = np.zeros(len(words.codes) + 1, np.int64)
            for low, places, buckets in words.buckets():
                # No place comes twice in one block of n-grams of one length.
                sums[1 + low + places] += pc.take(of_bucket, pa.array(buckets)).to_numpy(zero_copy_only=False)
            np.cumsum(sums, out=sums)
            n_words = np.diff(words.first)
            n_features = sum(np.maximum(n_words - step, 0) for step in range(LONGEST))
            columns = {
                "doc_id": piece.column("doc_id"),
                "n_words": pa.array(n_words),
                "n_features": pa.array(n_features),
                "weight": pa.array(sums[words.first[1:]] - sums[words.first[:-1]]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _texts(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def bucket_counts(df: DataFrame) -> np.ndarray:
    """Features of the column ``text`` in each bucket."""
    rows = _texts(df).mapInArrow(_count_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows.collect():  # one row per bucket
        counts[row.bucket] = row.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / raw share)) of each bucket, shares smoothed by one each."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(SCALE * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(raw, target, strict=True)],
        np.int64,
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a document, from the SHA-256 of its id (null: no digits)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: Column, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row.

    Of the N rows with at least LEAST_WORDS words the ``percent`` * N / 100 with the highest scores
    get ranks from 1 on; ties go to the smaller doc_id (nulls first), then to fewer features; the
    others' rank is null. Null and empty texts have no features and weight 0; a long text's n-grams
    are coded block by block; equal texts have equal weights, and rows that share an id share the
    noise. An empty target gives all buckets the same count; empty ``docs`` give an empty table.
    Other columns are ignored.
    """
    # Two passes over the texts: their n-grams take more space than the texts do.
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    chosen = _texts(docs, doc_id.alias("doc_id"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    weighed = chosen.mapInArrow(_weigh_rows(shared), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = with_running_sums(able.withColumn("_one", F.lit(1).cast("long")), order, {"_before": "_one"}, "places")
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < LEAST_WORDS)
    return placed.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
