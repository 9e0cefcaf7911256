"""Token counts of texts under a byte-level BPE vocabulary, by a two-tier lookup of pre-tokens.

The number of tokens of a text is the sum over its pre-tokens. Tasks look the length of each one
up in a table of the corpus's frequent pre-tokens, which is broadcast; what the table lacks is
looked up in a cache of the worker process, and what that lacks is encoded by the tokenizer
library. Pre-tokens are never shuffled:

* First tier: every task keeps a summary of at most FREQUENT counters over all of its pre-tokens
  (Misra-Gries: if there are more, all lose the count of the first one too many). Summaries merge
  in a tree, sixteen at a time; the last one, of at most FREQUENT entries, holds every pre-token
  that makes up more than one in FREQUENT of the corpus. Its lengths are taken once, on the driver.
* Second tier: at most CACHED pre-tokens a worker, forgotten all at once when it is full.

Both tiers only save work: a count never depends on what they hold.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.session import materialize

# Pre-tokens in the broadcast table, and of each summary that is merged into it.
FREQUENT = 1 << 17
# Pre-tokens that a worker remembers besides, of at most so many characters.
CACHED = 1 << 20
CACHED_CHARS = 64
# Longer texts are cut where a pre-token begins for certain.
CUT_CHARS = 1 << 20
FAN_IN = 16
LIMIT = 1024

# Fixed value: how byte-level vocabularies of this kind split a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in plain]
    return {**{byte: chr(byte) for byte in plain}, **{byte: chr(256 + at) for at, byte in enumerate(rest)}}


BYTE_SIGNS = _byte_signs()

_pattern = regex.compile(PRE_TOKENS)
_border = regex.compile(r"(?<=\S) (?=\S)")


def cut(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Parts of a text that give the same pre-tokens as the whole: a single blank after a
    character that is not white space, and before one, begins a pre-token."""
    begin = 0
    while len(text) - begin > size:
        found = _border.search(text, begin + size)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


@lru_cache(1 << 16)
def settled(character: str) -> bool:
    """Whether libraries of any Unicode version since 3.2 take a character for the same kind of thing."""
    now, then = unicodedata.category(character), unicodedata.ucd_3_2_0.category(character)
    return now != "Cn" and (now[0] == then[0] or not {now[0], then[0]} & set("LNZ"))


def load(definition: str):
    """The library's tokenizer; only byte-level BPE without a normaliser can be counted by pre-tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    parts = json.loads(definition)
    split = parts.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or parts.get("normalizer") or parts["model"]["type"] != "BPE":
        raise ValueError("not a byte-level BPE vocabulary without a normaliser")
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [token["content"] for token in parts.get("added_tokens", ())]


class Lengths:
    """Lengths of pre-tokens in one worker process: broadcast table, cache, library."""

    def __init__(self, definition: str, words: list[str], lengths: bytes, cached: int = CACHED):
        self.tokenizer, self.special = load(definition)
        self.model = self.tokenizer.model
        self.table = dict(zip(words, memoryview(lengths).cast("H"), strict=True))
        self.cache: dict[str, int] = {}
        self.cached = cached

    def of_words(self, words: list[str]) -> list[int]:
        """Tokens of pre-tokens, straight from the merges: splitting and special strings don't apply."""
        return [len(self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_SIGNS))) for word in words]

    def of_text(self, text: str) -> int:
        # A special string inside a text is one token, which the library cuts out first.
        if any(mark in text for mark in self.special):
            return self._whole(text)
        return sum(map(self._of_part, cut(text)))

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def _of_part(self, part: str) -> int:
        words = _pattern.findall(part)
        lengths = list(map(self.table.get, words))
        total = sum(filter(None, lengths))
        misses = [word for word, length in zip(words, lengths, strict=True) if length is None]
        found = list(map(self.cache.get, misses))
        total += sum(filter(None, found))
        new = Counter(word for word, length in zip(misses, found, strict=True) if length is None)
        if not new:
            return total
        if not all(word.isascii() or all(map(settled, word)) for word in new):
            return self._whole(part)  # the library may split such characters otherwise
        made = dict(zip(new, self.of_words(list(new)), strict=True))
        if len(self.cache) + len(made) > self.cached:
            self.cache.clear()
        self.cache.update((word, n) for word, n in made.items() if len(word) <= CACHED_CHARS)
        return total + sum(made[word] * n for word, n in new.items())


def reduced(counts: Counter, size: int) -> Counter:
    """At most ``size`` counters: all lose the count of the largest one that has to go."""
    if len(counts) <= size:
        return counts
    numbers = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(numbers, len(numbers) - size - 1)[len(numbers) - size - 1])
    return Counter({word: n - least for word, n in counts.items() if n > least})


def _summary_batch(part: int, counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
        names=["part", "words", "counts"],
    )


def _summarise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for cell in batch.column("text"):
                for part in cut(cell.as_py()):
                    counts.update(_pattern.findall(part))
                if len(counts) > 8 * size:
                    counts = reduced(counts, size)
        if counts:
            yield _summary_batch(TaskContext.get().partitionId(), reduced(counts, size))

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for words, numbers in zip(table.column("words"), table.column("counts"), strict=True):
            counts.update(dict(zip(words.as_py(), numbers.as_py(), strict=True)))
        part = table.column("part")[0].as_py() // FAN_IN
        return pa.Table.from_batches([_summary_batch(part, reduced(counts, size))])

    return run


def frequent(texts: DataFrame, size: int = FREQUENT) -> list[str]:
    """At most ``size`` pre-tokens of the column ``text``, all that make up more than one in ``size`` among them."""
    schema = "part long, words array<string>, counts array<bigint>"
    summaries = materialize(texts.mapInArrow(_summarise(size), schema), "summaries")
    most = summaries.agg(F.max("part")).first()[0]
    while most:
        merged = summaries.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_merge(size), schema)
        summaries, most = materialize(merged, "summaries"), most // FAN_IN
    rows = summaries.take(1)
    return rows[0].words if rows else []


_workers: dict[str, Lengths] = {}


def _count_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, definition, words, lengths = shared.value
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(definition, words, lengths)
        known = _workers[key]
        for batch in batches:
            counts = [known.of_text(cell.as_py()) for cell in batch.column("text")]
            columns = [batch.column(name) for name in ("doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, doc_id: Column, tokenizer: str, limit: int = LIMIT, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the place of a byte-level BPE vocabulary in the format of the tokenizers
    library, read on the driver. Counts are those of the library without begin, end or other added
    tokens; special strings inside a text count as the library takes them. Null texts count as
    empty (0 tokens); long texts are cut into parts that change no pre-token; repeated rows get
    equal counts; an empty table gives an empty table; other columns are ignored.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    text = F.coalesce("text", F.lit(""))
    chosen = docs.select(doc_id.alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    library = Lengths(definition, [], b"")
    words = [w for w in frequent(chosen.select("text"), size) if len(w) <= CACHED_CHARS and all(map(settled, w))]
    # Two bytes a length: 64 characters are 256 bytes, so as many tokens, at most.
    lengths = b"".join(n.to_bytes(2, sys.byteorder) for n in library.of_words(words))
    key = hashlib.sha256("\n".join([definition, *words]).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, definition, words, lengths))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    counted = chosen.mapInArrow(_count_rows(shared), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
