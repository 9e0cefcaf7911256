"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabmeld.llm import (
    crf,
    decontamination,
    license_scan,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_tree,
    warc,
)
from tabmeld.session import materialize


@pytest.fixture(scope="module")
def labels(ready):
    rows = [(5, 1, 0), (8, 0, 0), (9, None, 0), (12, 0, 1), (None, 1, 0), (5, 1, 1), (12, 0, 0)]
    return ready.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sharding(awkward, empty):
    def shard(df):
        sized = df.withColumn("size", sharding.text_size(F.col("text"))).withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        return sharding.assign_shards(sized, ["doc_id", "size"], "size", 4, "digest")

    rows = shard(awkward).collect()
    assert len(rows) == awkward.count() and shard(empty).count() == 0
    assert {r["size"] for r in rows if r.text is None} == {8}
    for number in range(4):
        slots = sorted(r.slot for r in rows if r.shard == number)
        assert slots == list(range(len(slots)))
    assert [r.key for r in rows] == ["k"] * len(rows)


def test_quality(awkward, empty, labels):
    model = quality_classifier.train(awkward, labels)
    rows = quality_classifier.score_documents(awkward, model, {"doc_id": F.col("doc_id"), "key": F.col("key")}).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score_documents(empty, model, {"doc_id": F.col("doc_id")}).count() == 0
    kept = quality_classifier.keep_good(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    blank = quality_classifier.train(empty, labels)
    assert {r.score for r in quality_classifier.score_documents(awkward, blank, {"doc_id": F.col("doc_id")}).collect()} == {0.5}
    assert quality_rules.judge_documents(empty, model, F.col("doc_id")).count() == 0
    judged = quality_rules.judge_documents(awkward, model, F.col("doc_id")).collect()
    assert all(r.base_failed and not r.kept for r in judged if r.n_words == 0)


def test_field_by_all_labellings():
    """Marginals and the best labelling against sums over all labellings."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    lengths = [1, 4, 7, 2]
    first = np.concatenate(([0], np.cumsum(lengths)))
    unary = rng.normal(size=first[-1])
    model = crf.Model(np.zeros(1), rng.normal(size=(2, 2)), np.zeros(1), np.ones(1))
    got, best = crf.marginals(model, unary, first), crf.viterbi(model, unary, first)
    for low, high in zip(first[:-1], first[1:], strict=True):
        scores = {
            path: sum(u for u, y in zip(unary[low:high], path, strict=True) if y)
            + sum(model.steps[a, b] for a, b in zip(path[:-1], path[1:], strict=True))
            for path in itertools.product((0, 1), repeat=high - low)
        }
        total = sum(np.exp(s) for s in scores.values())
        for at in range(high - low):
            want = sum(np.exp(s) for path, s in scores.items() if path[at]) / total
            assert got[low + at] == pytest.approx(want)
        assert tuple(best[low:high]) == max(scores, key=scores.get)


def test_near_dedup(awkward, empty):
    rows = near_dedup.dedup_classes(awkward, F.col("doc_id")).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == awkward.count()
    assert {by_id[i].class_id for i in (5, 6, 7)} == {5} and by_id[1].class_id == by_id[2].class_id == 1
    assert by_id[3].class_id == 3 and by_id[4].class_size == 2
    assert near_dedup.dedup_classes(empty, F.col("doc_id")).count() == 0
    kept = near_dedup.keep_one(awkward)
    found = kept.collect()
    assert kept.columns == awkward.columns and near_dedup.keep_one(empty).count() == 0
    assert Counter(r.doc_id for r in found) == Counter([1, 3, 4, 5, None, 8, 9, 10, 11, 12])


def test_license_scan(ready, awkward, empty):
    rows = license_scan.scan_licenses(awkward, F.col("doc_id")).collect()
    assert len(rows) == awkward.count() and all(r.labels == "" and r.first_word is None for r in rows)
    assert license_scan.scan_licenses(empty, F.col("doc_id")).count() == 0
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc by cc by 4.0", "GNU Lesser General Public License version 2.1",
        "GNU General Public License, version 3", "Copyright (c) 2001 Some Person. All rights reserved",
        "Copyright " + "x " * 9 + "all rights reserved", "apache license 2.0", "apache licence 2.0", "MIT License MIT license",
    ]
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs, F.col("doc_id")).collect()}
    assert [found[i].labels for i in range(len(texts))] == [
        "cc-by,cc-by-nc-4.0", "cc-by,cc-by-4.0", "gpl,lgpl", "gpl,gpl-3.0", "copyright,reserved", "reserved",
        "apache-2.0", "", "mit",
    ]
    assert found[0].score == 1.0 and len(found[8].places) == 2
    for bad in ("<<beginOptional>> a", "a <<endOptional>>", "<<var;name=x;tokens=1-2>>", "a <<other>>"):
        with pytest.raises(ValueError):
            license_scan.compile_template(bad)


def test_decontamination(ready, awkward, empty):
    items = ready.createDataFrame(
        [(1, " ".join(f"word{i}" for i in range(20, 50)), "x"), (2, None, "x"), (None, "one", "x"), (3, "", "x"), (3, "a b", "x")],
        "item_id long, text string, doc_id string",
    )
    rows = decontamination.find_leaks(awkward, items, F.col("doc_id")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(5, 1), (6, 1), (7, 1)}
    assert decontamination.find_leaks(empty, items, F.col("doc_id")).count() == 0
    assert decontamination.find_leaks(awkward, items.limit(0), F.col("doc_id")).count() == 0
    kept = decontamination.drop_leaks(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3


def test_personal_data(awkward, empty):
    rows = pii.find_personal_data(awkward, F.col("doc_id")).collect()
    assert len(rows) == awkward.count() and all(r.found == [] for r in rows if r.doc_id != 11)
    assert pii.find_personal_data(empty, F.col("doc_id")).count() == 0


def test_mixing(awkward, empty):
    mixed = mixing.mix_documents(awkward)
    assert mixed.columns == awkward.columns and mixing.mix_documents(empty).count() == 0
    first, second = Counter(mixed.collect()), Counter(mixing.mix_documents(awkward).collect())
    assert first == second
    sizes = awkward.withColumn("size", mixing.word_count(F.col("text")))
    targets = {r["_of"]: r for r in mixing.source_targets(sizes, "source", "size").collect()}
    assert None in targets and targets[None]["source_size"] == 2 and targets[None]["target"] == 6.0
    total = sum(r["source_size"] for r in targets.values())
    assert sum(r["target"] for r in targets.values()) == pytest.approx(total)


def test_levels_by_repeated_sharing(ready):
    """The water level against sharing the excess again and again."""
    import random

    rng = random.Random(2)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 5, 50, 5000]) for _ in range(9)]
        df = ready.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = {r["_of"]: r["target"] for r in mixing.source_targets(df, "source", "size").collect()}
        weights = [(5, 2, 1)[i % 3] for i in range(9)]
        full: set[int] = set()
        while True:
            rest = sum(sizes) - sum(3 * sizes[i] for i in full)
            weight = sum(w for i, w in enumerate(weights) if i not in full)
            want = [3 * s if i in full else rest * weights[i] / weight for i, s in enumerate(sizes)]
            over = {i for i in range(9) if want[i] > 3 * sizes[i] + 1e-9}
            if not over:
                break
            full |= over
        assert [got[f"s{i}"] for i in range(9)] == pytest.approx(want)


def test_suffix_tree(awkward, empty):
    never, always = F.lit(False), F.lit(True)
    rows = suffix_tree.score_documents(awkward, F.col("doc_id"), never).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_tokens == 1 and r.score < 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.n_known == r.n_tokens for r in rows)
    assert suffix_tree.score_documents(empty, F.col("doc_id"), never).count() == 0
    blind = suffix_tree.score_documents(awkward, F.col("doc_id"), always).collect()
    assert {r.train_tokens for r in blind} == {0} and {r.n_known for r in blind} == {0}


def test_table_finds_keys():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) | np.uint64(1 << 63))
    table = suffix_tree.Table(keys, np.arange(len(keys)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(np.arange(100, dtype=np.uint64)) == -1).all()
    assert (suffix_tree.Table(keys[:0], np.empty(0, np.int64)).find(keys) == -1).all()


def test_blobs_code_text_bytes_by_their_few_values():
    """Keys went as plain bytes, 16 for each with its count, and shuffles found little to compress in them."""
    rng = np.random.default_rng(3)
    letters = rng.choice(np.frombuffer(b"etaoin shr", np.uint8), (200_000, 3)).astype(np.uint64)
    suffixes = rng.integers(0, 1 << 40, 20_000, np.uint64)[rng.integers(0, 20_000, 200_000)]
    keys = np.unique(suffixes << np.uint64(24) | letters[:, 0] << np.uint64(16) | letters[:, 1] << np.uint64(8) | letters[:, 2])
    counts = rng.integers(1, 4, len(keys))
    batches = list(suffix_tree._blobs(7, keys, counts, bits=4))
    assert sum(len(cell) for batch in batches for name in ("keys", "counts") for cell in batch.column(name).to_pylist()) < 4 * len(keys)
    found, n = suffix_tree._merged(pa.Table.from_batches(batches))
    assert (found == keys).all() and (n == counts).all()


def test_blobs_go_in_small_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5_000, dtype=np.uint64))
    batches = list(suffix_tree._blobs(3, keys, np.arange(5_000) + 1, bits=8))
    assert max(batch.num_rows for batch in batches) <= 32
    found, counts = suffix_tree._merged(pa.Table.from_batches(batches))
    assert (found == keys).all() and (counts == np.arange(5_000) + 1).all()


def test_counts_are_written_in_small_files(ready, monkeypatch):
    limits = {}

    def written(df, label, rows_per_file=0):
        limits[label] = rows_per_file
        return materialize(df, label, rows_per_file)

    monkeypatch.setattr(suffix_tree, "materialize", written)
    suffix_tree.grow(ready.createDataFrame([("a text of some words",)] * 30, "text string"))
    assert 0 < limits["counts"] <= 16 * 16 * ready.sparkContext.defaultParallelism


def test_counter_merges(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_tree, "_GATHER", 50)
    monkeypatch.setattr(suffix_tree, "_MERGE", 20)
    values = np.random.default_rng(1).integers(0, 30, 1000).astype(np.uint64)
    counter = suffix_tree.Counter()
    for low in range(0, 1000, 7):
        counter.add(values[low : low + 7])
    got = Counter()
    for found, counts in counter.drain():
        got.update(dict(zip(found.tolist(), counts.tolist(), strict=True)))
    assert got == Counter(values.tolist())


def test_warc_round_trip(ready, tmp_path):
    pages = ready.createDataFrame(
        [
            (1, "http://a/1", "<html><head><title>t</title></head><body><p>Hi &amp;lt; <b>you</b></p><p>WARC/1.1</p></body></html>", "x"),
            (2, "http://a/2", None, "x"),
            (3, None, "", "x"),
            (None, "http://a/2\r\nX: y", "<script>var t='</p>';</script>plain é<br>two\n\n\nthree", "x"),
            (1, "http://a/1", "<html><head><title>t</title></head><body><p>Hi &amp;lt; <b>you</b></p><p>WARC/1.1</p></body></html>", "x"),
        ],
        "page_id long, url string, html string, block string",
    )
    records = warc.derive(warc.responses(pages, "url", "html", "page_id"))
    rows = records.collect()
    assert len(rows) == 10 and warc.derive(warc.responses(pages.limit(0), "url", "html", "page_id")).count() == 0
    texts = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert texts == {1: "Hi &lt; you\nWARC/1.1", 2: "", 3: "", None: "plain é\ntwo three"}
    warc.write_records(records, f"{tmp_path}/warc")
    back = warc.read_records(ready, f"{tmp_path}/warc").collect()
    names = ("record_type", "record_id", "refers_to", "block_digest", "block")
    pick = lambda found: Counter(tuple(r[n] for n in names) for r in found)
    assert pick(back) == pick(rows)
    sources = {r.record_id for r in warc.responses(pages, "url", "html", "page_id").collect()}
    assert {r.refers_to for r in rows} == sources


@pytest.mark.parametrize("most", [0, 3, 40, 1000])
def test_common_words_are_bounded(ready, most):
    counts = [1] * 50 + [2] * 20 + [7] * 10 + [100] * 5 + [5000]
    tokens = ready.createDataFrame(list(enumerate(counts)), "token long, count long")
    threshold = suffix_tree.common_from(tokens, most)
    assert sum(c >= threshold for c in counts) <= most
    assert threshold == {0: 5001, 3: 5000, 40: 2, 1000: 1}[most]
    assert suffix_tree.common_from(tokens.limit(0)) == 1
