"""Rule counts per document, and retention by its share of content lines.

A linear-chain conditional random field, trained like the quality classifier's, labels every
line content or boilerplate by Viterbi decoding; the share of bytes on content lines decides
whether a document that passes the fixed rules is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm import crf
from tabmeld.llm.line_features import Lines
from tabmeld.llm.quality_classifier import unary
from tabmeld.llm.text import BLANKS, CONTINUATION, Words, pieces, windows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
LEAST_CONTENT = 0.5


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repeated_words(words: Words) -> np.ndarray:
    """For each text: words inside windows of 8 words that the text holds twice or more."""
    count = len(words.first) - 1
    keys, places = windows(words.hashes, words.first, WINDOW)
    if not len(keys):
        return np.zeros(count, np.int64)
    owner = np.searchsorted(words.first, places, side="right") - 1
    keys ^= owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(count, np.int64)
    found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    edges = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edges, places[found], 1)
    np.add.at(edges, places[found] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(model: crf.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            words = Words(texts)
            parsed = Lines(texts)
            content = crf.viterbi(model, unary(model, parsed), parsed.first)
            weight = parsed.size + 1.0
            share = np.add.reduceat(content * weight, parsed.first[:-1]) / np.add.reduceat(weight, parsed.first[:-1])
            columns = {
                "n_words": words.counts(),
                "word_chars": [len(t.translate(None, BLANKS + CONTINUATION)) for t in texts],
                "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
                "n_dup_lines": [duplicate_lines(t) for t in texts],
                "n_repeat_words": repeated_words(words),
            }
            arrays = [pa.array(np.asarray(values, np.int64)) for values in columns.values()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *arrays, pa.array(share)], names=["doc_id", *columns, "content_share"]
            )

    return run


def judge_documents(docs: DataFrame, model: crf.Model, doc_id: Column, least_content: float = LEAST_CONTENT) -> DataFrame:
    """doc_id, the rule counts, ``content_share``, ``base_failed`` and ``kept`` for every row.

    ``base_failed``: under 20 words, or more than 30 percent of them in repeated windows. ``kept``:
    not failed and at least ``least_content`` of the bytes on content lines. Null texts count as
    empty, and empty texts fail; repeated rows get equal results; all lines and words of a long text count;
    an empty table gives an empty table.
    """
    chosen = docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} long" for name in COUNTS) + ", content_share double"
    counted = chosen.mapInArrow(_judge(model), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("content_share") >= least_content)
    )
