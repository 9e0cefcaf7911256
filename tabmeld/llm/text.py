"""Words of many texts at once: byte classes, word borders and 64-bit word hashes in numpy.

All functions work on lists of UTF-8 byte strings (None counts as empty). Spark deals the
rows; these helpers only look at the rows of one Arrow batch, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
ROWS_PER_BATCH = 1000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-case A-Z; every byte outside 0-9, a-z and the non-ASCII range becomes a space.
ALNUM = bytes(
    LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256)
)
IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\v\f\r"

_SEED = np.random.default_rng(20240229)
_BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def pieces(batches: Iterator, column: str = "text", limit: int = PIECE_BYTES) -> Iterator:
    """Cut record batches so that the texts of a piece hold about ``limit`` bytes (one row at least).

    Yields (piece, list of byte strings).
    """
    for batch in batches:
        cells = batch.column(column)
        cells = cells if pa.types.is_binary(cells.type) else cells.cast(pa.binary())
        texts = [value or b"" for value in cells.to_pylist()]
        first, held = 0, 0
        for at, text in enumerate(texts):
            if held and held + len(text) > limit:
                yield batch.slice(first, at - first), texts[first:at]
                first, held = at, 0
            held += len(text) + 1
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), PIECE_BYTES + 4096)
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        steps[0] = back[0] = 1
        _powers, _inverses = np.cumprod(steps), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word borders and hashes of a list of texts.

    ``starts`` and ``ends`` are byte places in ``data``; ``first`` has, for each text and one
    past the last, the index of its first word.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None, hashes: bool = True):
        joined = b"\n" + b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([1], 1 + np.cumsum(lengths)))
        inside = IS_WORD[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        if hashes:
            self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        powers, inverses = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * powers[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words inside one text, and the index of the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for step in range(size):
        rolled = rolled * np.uint64(_BASE) + hashes[step : step + n]
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:n] - np.arange(n)
    places = np.flatnonzero(left >= size)
    return mix(rolled[places]), places
