"""Numeric features of the lines of texts, with those of both neighbouring lines beside them."""

from __future__ import annotations

import numpy as np

from tabmeld.llm.text import Words, mix

NAMES = (
    "size", "symbols", "marks", "bars", "capitals", "digits", "blanks", "word_length",
    "echoes", "variety", "ends_sentence", "starts_capital", "repeated_line", "empty",
)


def _flags(members: bytes) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(members)] = 1
    return table


_SYMBOLS = _flags(b"#$%&*+/<=>@[\\]^_`{}~")
_MARKS = _flags(b"!?")
_BARS = _flags(b"|")
_CAPITALS = _flags(bytes(range(65, 91)))
_SMALL = _flags(bytes(range(97, 123)))
_DIGITS = _flags(bytes(range(48, 58)))
_BLANKS = _flags(b" \t\v\f\r")
_ENDS = _flags(b".!?:;\"')")


class Lines:
    """The \\n-split lines of a list of texts: every text has one line at least.

    ``first`` has, for each text and one past the last, the index of its first line;
    ``size`` the bytes of each line; ``own`` one row of features per line.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        data = words.data
        breaks = np.flatnonzero(data == 10)
        starts, ends = breaks[:-1] + 1, breaks[1:]
        self.first = np.searchsorted(starts, words.offsets)
        self.first[-1] = len(starts)
        self.size = (ends - starts).astype(np.int64)
        safe = np.maximum(self.size, 1).astype(np.float32)

        def share(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.float64)))
            return (sums[ends] - sums[starts]).astype(np.float32)

        capitals, small = share(_CAPITALS), share(_SMALL)
        n_words = np.diff(np.searchsorted(words.starts, np.append(starts, len(data))))
        line_of_word = np.repeat(np.arange(len(starts)), n_words)
        some = np.maximum(n_words, 1).astype(np.float32)
        same = np.zeros(len(starts), np.float32)
        distinct = np.zeros(len(starts), np.float32)
        if len(line_of_word):
            echo = (words.hashes[1:] == words.hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
            same = np.bincount(line_of_word[1:][echo], minlength=len(starts)).astype(np.float32)
            # Line number in the high bits, so one sort finds the distinct words of every line.
            tagged = (line_of_word.astype(np.uint64) << np.uint64(40)) | (words.hashes & np.uint64((1 << 40) - 1))
            tagged.sort()
            new = np.concatenate(([True], tagged[1:] != tagged[:-1]))
            distinct = np.bincount((tagged[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts)).astype(np.float32)
        spread = distinct / some
        last = data[np.maximum(ends - 1, 0)]
        nothing = n_words == 0
        self.own = np.stack(
            (
                np.log1p(self.size).astype(np.float32) / 10,
                share(_SYMBOLS) / safe * 10,
                share(_MARKS) / safe * 10,
                share(_BARS) / safe * 10,
                capitals / np.maximum(capitals + small, 1),
                share(_DIGITS) / safe,
                share(_BLANKS) / safe,
                np.minimum(self.size / some, 50) / 10,
                same / some,
                # Long lines repeat their common words anyway: compare with the root of the length.
                np.minimum(spread * np.sqrt(some) / 4, 2),
                np.where(nothing, 0, _ENDS[last]),
                np.where(nothing, 0, _CAPITALS[data[starts]]),
                self._repeated(words, n_words, line_of_word),
                nothing.astype(np.float32),
            ),
            axis=1,
        ).astype(np.float32)

    def _repeated(self, words: Words, n_words: np.ndarray, line_of_word: np.ndarray) -> np.ndarray:
        """1 for lines with words that equal another line of the same text, word for word."""
        count = len(n_words)
        if not len(line_of_word):
            return np.zeros(count, np.float32)
        firsts = np.concatenate(([0], np.cumsum(n_words)))
        place = np.arange(len(line_of_word)) - firsts[line_of_word]
        placed = mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed)))
        text_of_line = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)).astype(np.uint64)
        key = mix((sums[firsts[1:]] - sums[firsts[:-1]]) ^ mix(text_of_line))
        _, inverse, copies = np.unique(key, return_inverse=True, return_counts=True)
        return ((copies[inverse] > 1) & (n_words > 0)).astype(np.float32)

    def table(self) -> np.ndarray:
        """Own features, those of the line before and after (0 at a text's borders), and border flags."""
        count = len(self.own)
        before, after = np.zeros_like(self.own), np.zeros_like(self.own)
        before[1:], after[:-1] = self.own[:-1], self.own[1:]
        opens, closes = np.zeros(count, bool), np.zeros(count, bool)
        opens[self.first[:-1]], closes[self.first[1:] - 1] = True, True
        before[opens], after[closes] = 0, 0
        flags = np.stack((opens, closes, np.ones(count, bool)), axis=1).astype(np.float32)
        return np.concatenate((self.own, before, after, flags), axis=1)


WIDTH = 3 * len(NAMES) + 3
