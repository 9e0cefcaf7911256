"""Token counts against the tokenizer library on whole texts."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabmeld.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def definition():
    with open(FILE, encoding="utf-8") as held:
        return held.read()


def want(library, texts):
    return [len(made) for made in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_op11_counts(run, texts, library):
    rows = run("op11_token_counts")
    ids = sorted(texts)
    expected = dict(zip(ids, want(library, [texts[i] for i in ids]), strict=True))
    assert sorted(r.doc_id for r in rows) == ids
    for row in rows:
        assert (row.n_tokens, row.n_bytes) == (expected[row.doc_id], len(texts[row.doc_id].encode()))
        assert row.over_limit == (row.n_tokens > 1024)


ODD = [
    "", " ", "  \n\t x  y  z　　w", "don't I'll they'VE 'tis ''s", "a" * 5000, "1" * 700 + " " * 900 + "end",
    "<|endoftext|>", "before <|endoftext|> after<|endoftext|><|endoftext|>", "<|endof", "\U0001f600\U0001f9d1‍\U0001f680 ok",
    "中文字 हिन्दी ال", "\r\n\r\n a\x00b\x1c\x85c", "x ࢏౜ y ꟎1", "￾\U000e0001",
    " \n \n  \n", "_a_1_²½Ⅷ", "᠎ ᠎a",
]


def test_odd_texts(library, definition):
    for words in ([], [" ", "a", "<|", "endoftext", "|>", "\n"]):
        lengths = token_counts.Lengths(definition, [], b"").of_words(words)
        table = b"".join(n.to_bytes(2, "little") for n in lengths)
        known = token_counts.Lengths(definition, words, table, cached=4)
        assert [known.of_text(t) for t in ODD] == want(library, ODD)
        assert [known.of_text(t) for t in ODD] == want(library, ODD)


def test_every_character_that_libraries_may_split_differently(library):
    """All characters that are not settled go to the library; the others give its pre-tokens."""
    split = library.pre_tokenizer.pre_tokenize_str
    for low in (0x20, 0x500, 0x880, 0x1680, 0x2000, 0x2C00, 0xA640, 0xFB00, 0x10780, 0x1F600):
        for code in range(low, low + 0x90):
            text = f"a{chr(code)}1{chr(code)}{chr(code)} {chr(code)}!{chr(code)}"
            if token_counts.settled(chr(code)):
                assert token_counts._pattern.findall(text) == [text[i:j] for _, (i, j) in split(text)], hex(code)


def test_long_texts_are_cut_where_nothing_changes():
    text = "one  two \n three, four's 55 \t\t six" * 300
    for size in (1, 7, 100, 10_000):
        parts = list(token_counts.cut(text, size))
        assert "".join(parts) == text
        assert [w for part in parts for w in token_counts._pattern.findall(part)] == token_counts._pattern.findall(text)


def test_summary_holds_what_is_frequent(ready):
    """Every pre-token above the bound is in the table, however rows are dealt."""
    rows = [("often " * 40 + f"w{i}a w{i}b",) for i in range(400)] + [("now and then",)] * 30
    texts = ready.createDataFrame(rows, "text string").repartition(40)
    found = token_counts.frequent(texts, 50)
    counts = Counter(w for (t,) in rows for w in token_counts._pattern.findall(t))
    total = sum(counts.values())
    assert len(found) <= 50 and {w for w, n in counts.items() if n > total / 50} <= set(found)


def test_awkward_rows(awkward, empty, library):
    rows = token_counts.count_tokens(awkward, F.col("doc_id"), FILE).collect()
    texts = [r.text for r in awkward.select("text").collect()]
    assert Counter(r.n_tokens for r in rows) == Counter(want(library, texts))
    assert all(r.n_tokens == r.n_bytes == 0 for r in rows if r.doc_id in (1, 2))
    assert token_counts.count_tokens(empty, F.col("doc_id"), FILE).count() == 0
    limited = token_counts.count_tokens(awkward, F.col("doc_id"), FILE, limit=0, size=3).collect()
    assert Counter(r.n_tokens for r in limited) == Counter(r.n_tokens for r in rows)
    assert all(r.over_limit == (r.n_tokens > 0) for r in limited)


def test_other_vocabularies_are_refused(awkward):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(awkward, F.col("doc_id"), public_tokenizers.path("word_bpe_49k.json"))
