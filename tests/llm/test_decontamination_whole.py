"""No substitution pattern that counts as a leak escapes the masks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from tabmeld.llm import decontamination


def patterns(tokens: int, changed: int):
    """Places between both ends that are substituted."""
    return combinations(range(1, tokens - 1), changed)


@pytest.mark.parametrize("tokens", range(1, decontamination.LEAST_TOKENS))
def test_short_masks_miss_nothing(tokens):
    masks = decontamination.short_masks(tokens)
    for changed in range(tokens - -(-tokens * 4 // 5) + 1):
        assert all(any(not set(mask) & set(at) for mask in masks) for at in patterns(tokens, changed))


def test_fixed_masks_miss_nothing():
    """The most places that can agree without a hit, for every length, over all patterns at once."""
    places = decontamination.SPAN - 1
    states = np.arange(1 << places)
    hit = np.zeros(2 << places, bool)
    for mask in decontamination.MASKS:
        need = sum(1 << (mask[-1] - offset) for offset in mask)
        hit |= np.arange(2 << places) & need == need
    most = np.full(1 << places, -10_000)
    most[1] = 1  # the first place agrees; what lies before it does not
    for tokens in range(2, 200):
        longer = np.full(1 << places, -10_000)
        for same in (0, 1):
            window = (states << 1) | same
            free = ~hit[window]
            np.maximum.at(longer, window[free] & ((1 << places) - 1), most[free] + same)
        most = longer
        if tokens >= decontamination.LEAST_TOKENS:
            assert 5 * most[1::2].max() < 4 * tokens


def test_all_patterns_are_found_on_both_paths(ready):
    items, docs = [], []
    for tokens in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15):
        words = [f"i{tokens}w{j}" for j in range(tokens)]
        items.append((tokens, " ".join(words)))
        for changed in range(tokens - -(-tokens * 4 // 5) + 1):
            for at in patterns(tokens, changed):
                docs.append((len(docs), tokens, "go " * 3 + " ".join("x" if j in at else w for j, w in enumerate(words)) + " end"))
    docs.append((len(docs), None, "go i9w0 x x i9w3 i9w4 i9w5 i9w6 i9w7 i9w8 end"))  # two of nine: no leak
    left = ready.createDataFrame(docs, "doc_id long, of long, text string")
    right = ready.createDataFrame(items, "item_id long, text string")
    want = {(doc_id, of) for doc_id, of, _ in docs if of}
    for index_rows in (decontamination.INDEX_ROWS, 0):
        rows = decontamination.find_leaks(left, right, left.doc_id, index_rows=index_rows).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
