"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabmeld.llm import importance_resampling as resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = WORD.findall((text or "").translate(CAPITALS))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(gram.encode()) % 10000 for gram in grams]


def expected(docs, target):
    """(doc_id, n_features, weight, score, rank) of every document."""
    raw, wanted, parsed = Counter(), Counter(), []
    for doc_id, text in docs:
        parsed.append((doc_id, *buckets(text)))
        raw.update(parsed[-1][2])
    for text in target:
        wanted.update(buckets(text)[1])
    s_all, t_all = sum(raw.values()) + 10000, sum(wanted.values()) + 10000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in raw}
    rows = []
    for doc_id, n_words, found in parsed:
        weight = sum(gain[b] for b in found)
        named = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = 5 * len(able) // 100
    ranks = [(*r, at + 1 if at < drawn else None) for at, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < 20]
    return Counter((r[0], *r[2:]) for r in ranks)


def shown(rows):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows)


def test_op12_whole_result(run, ready, texts):
    target = [r.text for r in ready.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = run("op12_importance_resampling")
    assert shown(rows) == expected(texts.items(), target)
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in rows)))


def test_awkward_rows(ready, awkward, empty):
    target = ready.createDataFrame([("word1 word2 word3", 1), (None, 2), ("", 3)], "text string, doc_id int")
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    rows = resampling.resample(awkward, target, F.col("doc_id")).collect()
    assert shown(rows) == expected(docs, ["word1 word2 word3"])
    more = [(None if i % 7 == 0 else i // 3, f"Some {i % 5} words " * 8) for i in range(300)]
    many = ready.createDataFrame(more, "doc_id long, text string")
    assert shown(resampling.resample(many, target, F.col("doc_id")).collect()) == expected(more, ["word1 word2 word3"])
    assert resampling.resample(empty, target, F.col("doc_id")).count() == 0
    rows = resampling.resample(awkward, target.limit(0), F.col("doc_id")).collect()
    assert shown(rows) == expected(docs, [])


def test_blocks_hold_each_ngram_once(monkeypatch):
    text = " ".join(f"w{i % 11}xé{i % 3}" for i in range(500))
    for places in (1, 2, 7, 499, 1000):
        monkeypatch.setattr(resampling, "_PLACES", places)
        words = resampling.Words(pa.array([text, "", "a", "B c"]))
        found = np.concatenate([b for _, _, b in words.buckets()])
        want = [b for t in (text, "a", "B c") for b in buckets(t)[1]]
        assert Counter(found.tolist()) == Counter(want)


def test_crc_of_joined_strings():
    heads, tails = [b"", b"a", b"some words", bytes(range(256))], [b"", b" x", b"\x00" * 3000, "é文".encode()]
    for head in heads:
        got = resampling.crc_joined(
            np.full(len(tails), zlib.crc32(head), np.uint32),
            np.array([zlib.crc32(t) for t in tails], np.uint32),
            np.array([len(t) for t in tails]),
        )
        assert got.tolist() == [zlib.crc32(head + t) for t in tails]
