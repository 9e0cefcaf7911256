"""A linear-chain conditional random field with two labels (0 and 1) over the lines of texts.

The score of a labelling is the sum of a unary term for every line with label 1 (a weighted
sum of its features) and of one transition term per pair of neighbouring lines. Inference
multiplies 2x2 matrices: a running product over all lines of many texts at once, in
logarithmically many numpy steps. The matrix at the first line of a text has equal rows, so
the product forgets the text before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per feature
    steps: np.ndarray  # 2x2 transition scores
    centre: np.ndarray
    scale: np.ndarray

    def unary(self, table: np.ndarray) -> np.ndarray:
        return ((table - self.centre) / self.scale) @ self.weights


def _limit(first: np.ndarray) -> int:
    return int(np.diff(first).max(initial=1))


def _chains(model: Model, unary: np.ndarray, first: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each line and label: log weight of all (or the best) labellings up to it, and after it."""
    n = len(unary)
    emit = np.zeros((n, 2))
    emit[:, 1] = unary
    forward = model.steps[None] + emit[:, None, :]
    forward[first[:-1]] = emit[first[:-1], None, :]
    ahead = _segments(forward, first, best)[:, 0, :]
    # Backward: the same product over the lines in reverse, without the line's own term.
    backward = np.zeros((n, 2, 2))
    backward[:-1] = (model.steps[None] + emit[1:, None, :]).transpose(0, 2, 1)
    backward[first[1:] - 1] = 0.0
    mirrored = n - first[::-1]
    behind = _segments(backward[::-1], mirrored, best)[::-1][:, 0, :]
    return ahead, behind


def _segments(matrices: np.ndarray, first: np.ndarray, best: bool) -> np.ndarray:
    """Running products that start anew at each text; only as many steps as the longest text needs."""
    out = matrices.copy()
    lengths = np.diff(first)
    place = np.arange(len(out)) - np.repeat(first[:-1], lengths)
    shift, longest = 1, _limit(first)
    while shift < longest:
        at = np.flatnonzero(place >= shift)
        paths = out[at - shift][:, :, :, None] + out[at][:, None, :, :]
        out[at] = paths.max(axis=2) if best else np.logaddexp(paths[:, :, 0, :], paths[:, :, 1, :])
        shift *= 2
    return out


def marginals(model: Model, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: probability of label 1 for every line. ``first`` as in Lines; no text is empty."""
    ahead, behind = _chains(model, unary, first, best=False)
    odds = (ahead[:, 1] + behind[:, 1]) - (ahead[:, 0] + behind[:, 0])
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60)))


def viterbi(model: Model, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label of every line in the best labelling of its text (1 where two are equally good)."""
    ahead, behind = _chains(model, unary, first, best=True)
    return (ahead[:, 1] + behind[:, 1] >= ahead[:, 0] + behind[:, 0]).astype(np.int8)


def fit(
    tables: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.08, ridge: float = 1e-3
) -> Model:
    """Maximise the mean log likelihood of labelled texts (Adam; forward-backward for all at once).

    ``tables`` has one feature table per text, ``labels`` a 0/1 array of the same length each.
    Without texts the model gives every line the probability 0.5.
    """
    if not tables:
        width = 1
        return Model(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    x = np.concatenate(tables).astype(np.float64)
    y = np.concatenate(labels).astype(np.float64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in tables])))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    constant = scale < 1e-6
    centre[constant], scale[constant] = 0.0, 1.0
    x = (x - centre) / scale
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    values = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for turn in range(1, rounds + 1):
        weights, steps = values[:-4], values[-4:].reshape(2, 2)
        model = Model(weights, steps, 0, 1)
        unary = x @ weights
        ahead, behind = _chains(model, unary, first, best=False)
        total = np.logaddexp(ahead[:, 0] + behind[:, 0], ahead[:, 1] + behind[:, 1])
        p = np.exp(ahead[:, 1] + behind[:, 1] - total)
        emit = np.zeros((len(at), 2))
        emit[:, 1] = unary[at]
        pairs = ahead[at - 1][:, :, None] + steps[None] + (emit + behind[at])[:, None, :] - total[at][:, None, None]
        grown = np.concatenate(((y - p) @ x, (seen - np.exp(pairs).sum(axis=0)).ravel())) / len(y) - ridge * values
        mean = 0.9 * mean + 0.1 * grown
        square = 0.99 * square + 0.01 * grown**2
        values = values + rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Model(values[:-4], values[-4:].reshape(2, 2), centre, scale)
