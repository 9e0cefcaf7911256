"""No kind of personal data is silenced by how many there are, or by how many lack a cue."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tabmeld.llm import pii


def key(i: int) -> str:
    return hashlib.sha1(str(i).encode()).hexdigest()


def secrets(ready, rows) -> dict[int, list[tuple]]:
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(docs, docs.doc_id).collect()
    return {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "secret"] for r in found}


@pytest.mark.parametrize("n", [1, 3, 13])
def test_few_secrets_with_a_cue_are_found(ready, n):
    rows = [(i, f'some words token = "{key(i)}" more') for i in range(n)] + [(100, f"plain version-name-of-release-number-{n}")]
    assert secrets(ready, rows) == {i: [(20, 60)] for i in range(n)} | {100: []}


@pytest.mark.parametrize("uncued", [0.15, 0.4])
def test_missing_cues_do_not_silence_a_look(ready, uncued):
    bare = int(400 * uncued)
    rows = [(i, f'some words "{key(i)}" more' if i < bare else f'some words token = "{key(i)}" more') for i in range(400)]
    rows += [(i, f"some words version-name-of-release-number-{i} more") for i in range(400, 700)]
    found = secrets(ready, rows)
    assert all(len(found[i]) == 1 for i in range(bare, 400)) and not any(found[i] for i in range(400, 700))
    assert sum(len(found[i]) for i in range(bare)) >= 0.95 * bare


def test_a_card_inside_does_not_hide_a_secret(ready):
    text = 'token = "abcdef-4111111111111111-abcdef"'
    docs = ready.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_personal_data(docs, docs.doc_id).join(docs, "doc_id")
    row = found.select("found", pii.redact(F.col("text"), F.col("found")).alias("t")).first()
    assert {s.kind for s in row.found} == {"card", "secret"} and row.t == 'token = "[secret]"'
