"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own features and those of its
neighbours; the document's score is the mean of the lines' forward-backward marginals,
weighted by line length. The field is trained on a bounded sample of labelled documents: all
lines of a sampled document carry its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm import crf
from tabmeld.llm.line_features import WIDTH, Lines
from tabmeld.llm.text import pieces

# Bounds of the training sample: documents of each label, and neighbouring lines of a document.
SAMPLE_DOCUMENTS = 2000
SAMPLE_LINES = 48
THRESHOLD = 0.3


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True where the CRC-32 of the id, as text, is divisible by ``parts`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def _sample_features(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            parsed = Lines(texts)
            table, first = parsed.table(), parsed.first
            marks = piece.column("_mark").to_pylist()
            cells = []
            for at, mark in enumerate(marks):
                low, high = first[at], first[at + 1]
                # A window of neighbouring lines at a place that the row's hash names.
                begin = low + mark % max(1, high - low - lines + 1)
                cells.append(table[begin : min(high, begin + lines)].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column("_label"), pa.array(cells, pa.binary())], names=["label", "cells"]
            )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    documents: int = SAMPLE_DOCUMENTS,
    lines: int = SAMPLE_LINES,
) -> crf.Model:
    """Fit the field on at most ``documents`` texts per label, ``lines`` lines of each.

    ``labels`` holds doc_id and a 0/1 column; null labels are left out, and the larger of two
    labels of one id counts. The ids with the smallest hashes are taken, so reruns agree. The
    driver gets at most 2 * documents * lines rows of features.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .withColumn("_mark", F.xxhash64(F.col("_id"), F.lit("lines")).bitwiseAND(F.lit(0x7FFFFFFF)))
    )
    chosen = [known.where(F.col("_label") == value).orderBy("_mark", "_id").limit(documents) for value in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # 2 * documents rows at most
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
        # Several rows may share an id; each id counts once, with its first text.
        .groupBy("_id", "_label", "_mark")
        .agg(F.min("text").cast("binary").alias("text"))
        .select("_label", "_mark", "text")
        .mapInArrow(_sample_features(lines), "label int, cells binary")
        .orderBy("label", "cells")
        .collect()
    )
    tables = [np.frombuffer(row.cells, np.float32).reshape(-1, WIDTH) for row in rows]
    return crf.fit(tables, [np.full(len(t), row.label) for t, row in zip(tables, rows, strict=True)])


def _scores(model: crf.Model, texts: list[bytes]) -> tuple[np.ndarray, Lines]:
    parsed = Lines(texts)
    good = crf.marginals(model, unary(model, parsed), parsed.first)
    weight = parsed.size + 1.0
    return np.add.reduceat(good * weight, parsed.first[:-1]) / np.add.reduceat(weight, parsed.first[:-1]), parsed


def _score(model: crf.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            scores, parsed = _scores(model, texts)
            carried = piece.drop_columns(["text"])
            extra = [pa.array(scores), pa.array(np.diff(parsed.first))]
            yield pa.RecordBatch.from_arrays(
                [*carried.columns, *extra], names=[*carried.schema.names, "score", "n_lines"]
            )

    return run


def unary(model: crf.Model, parsed: Lines) -> np.ndarray:
    table = parsed.table().astype(np.float64)
    return model.unary(table if len(model.weights) > 1 else np.zeros((len(table), 1)))


def score_documents(docs: DataFrame, model: crf.Model, carry: dict[str, Column]) -> DataFrame:
    """Columns ``carry`` plus ``score`` (0 to 1, higher is better) and ``n_lines`` for every row.

    Null and empty texts are one empty line, scored by the model as such. Rows are independent,
    so repeated rows get equal scores; all lines of a long text count; an empty table gives an empty table.
    """
    chosen = docs.select(*[column.alias(name) for name, column in carry.items()], F.col("text").cast("binary").alias("text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text"]
    return chosen.mapInArrow(_score(model), ", ".join([*schema, "score double, n_lines long"]))


def keep_good(docs: DataFrame, model: crf.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            yield piece.filter(pa.array(_scores(model, texts)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)
