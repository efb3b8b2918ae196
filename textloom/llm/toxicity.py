"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another by logistic models over lexical units, which are words and beginnings of
words; each later model also sees the probabilities of the earlier categories. In training these are out-of-fold
predictions, so a later model meets them as they are on unseen texts. A unit has two features: whether the text holds it,
and how dense it is among the text's words.

The categories before the last are kinds of toxic texts, and are learned as well: the toxic rows' units are factorised
(principal directions, by power iteration), and a toxic row counts for a kind if it lies on the positive side of the
kind's direction. The last category is the label itself. No list of words is given.

Words are runs of letters, folded to lower case (A-Z); the models know the units that set the classes of the bounded
training sample apart best, found by exact 64-bit hashes; a unit of fewer than `min_texts` texts is not looked at. Null
and empty texts, and texts that hold no unit that the models know, have the probability 0: nothing speaks for toxicity.
Repeated rows are scored once each. Without labelled rows of both
classes the probabilities are constant: the share of toxic rows, 0 without any. Extra columns of any name are kept by
`keep` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom import runtime
from textloom.llm import _labels, _text

#: Kinds of toxic texts that are learned before the label.
KINDS = 2
LAST = "toxic"
#: A document whose last probability reaches this is toxic.
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


#: Bytes of the beginnings of words that are units.
PREFIXES = (4, 5, 6, 7, 8)
#: The share of a text's words at which a unit's density counts as 1.
DENSE = 0.02
#: Slots of the table that bounds the memory of training.
SLOTS = 1 << 22


def units(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and each length of beginning: (unit hashes, their texts, words of every text)."""
    starts, ends, first = _text.spans(_LETTER[data], off)
    own, folded, n_words = _text.owners(first), _text.LOWER[data], np.diff(first)
    yield _text.span_hashes(folded, starts, ends), own, n_words
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        yield _text.mix(_text.span_hashes(folded, starts[longer], starts[longer] + size)), own[longer], n_words


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 150) -> np.ndarray:
    """Weights (last: bias) by accelerated gradient descent on the class-weighted, L2-penalised logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    if not len(y) or y.min() == y.max():
        out = np.zeros(x.shape[1])
        share = float(y.mean()) if len(y) else 0.0
        out[-1] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return out
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = np.full(x.shape[1], strength)
    penalty[-1] = 0
    probe = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(10):  # the largest curvature, by power iteration
        probe = x.T @ (weight * (x @ probe)) / 4
        top = np.linalg.norm(probe)
        probe /= top
    rate = 1 / (1.2 * top + strength)
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        gradient = x.T @ (weight * (sigmoid(x @ ahead) - y)) + penalty * ahead
        new = ahead - rate * gradient
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / faster * (new - w), new, faster
    return w


@dataclass
class Chain:
    categories: list[str]
    words: np.ndarray  # sorted hashes of the units
    weights: list[np.ndarray]  # of each category: units' presence, units' density, earlier probabilities, bias

    def predict(self, features: np.ndarray) -> np.ndarray:
        """Probabilities (texts x categories) from the features of the texts."""
        x = features
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w[:-1] + w[-1])[:, None]])
        return x[:, features.shape[1] :]

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities (texts x categories) of a slab; a text without words, or without a unit where units are known, has 0."""
        x = self.features(data, off)
        found = self.predict(x)
        _, _, first = _text.spans(_LETTER[data], off)
        found[np.diff(first) == 0] = 0
        if len(self.words):
            found[~x.any(axis=1)] = 0
        return found

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, m = len(off) - 1, len(self.words)
        counts, n_words = np.zeros(n * m, np.float32), np.ones(n)
        for h, own, n_words in units(data, off):
            if m and len(h):
                at = np.minimum(np.searchsorted(self.words, h), m - 1)
                hit = self.words[at] == h
                counts += np.bincount(own[hit] * m + at[hit], minlength=n * m).astype(np.float32)
        counts = counts.reshape(n, m)
        dense = np.minimum(counts / np.maximum(n_words, 1)[:, None] / DENSE, 2)
        return np.hstack([counts > 0, dense]).astype(np.float32)


def separating_units(texts: list[str], y: np.ndarray, max_units: int, min_texts: int) -> np.ndarray:
    """The sorted hashes of the units with the largest Welch's t between the classes. Texts are hashed anew in three passes, so that only units are held."""

    def values() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, text in enumerate(texts):
            found = list(units(*_text.joined([text])))
            unit, count = np.unique(np.concatenate([h for h, _, _ in found]), return_counts=True)
            yield k, unit, 0.25 + np.minimum(count / max(1, int(found[0][2][0])) / DENSE, 1)

    seen = np.zeros(SLOTS, np.int32)  # texts by slot: a unit in fewer than min_texts texts is mostly left out at once
    for _, unit, _ in values():
        seen[np.unique(unit % np.uint64(SLOTS))] += 1
    held, fresh, size = np.zeros(0, np.uint64), [], 0
    for _, unit, _ in values():
        fresh.append(unit[seen[unit % np.uint64(SLOTS)] >= min_texts])
        size += len(fresh[-1])
        if size > 1 << 20:
            held, fresh, size = np.unique(np.concatenate([held, *fresh])), [], 0
    held = np.unique(np.concatenate([held, *fresh]))
    del seen
    total, square, n_texts = (np.zeros((2, len(held))) for _ in range(3))
    for k, unit, value in values():
        at = np.minimum(np.searchsorted(held, unit), max(len(held) - 1, 0))
        here = held[at] == unit if len(held) else np.zeros(len(unit), bool)
        at, value, label = at[here], value[here], int(y[k])
        total[label, at] += value
        square[label, at] += value**2
        n_texts[label, at] += 1
    n = np.array([[(y == k).sum()] for k in (0, 1)])
    mean = total / n
    spread = ((square / n - mean**2) / n).sum(0) + 1e-4
    t = np.abs(mean[1] - mean[0]) / np.sqrt(spread)
    t[n_texts.sum(0) < min_texts] = 0
    return np.sort(held[np.argsort(-t, kind="stable")[:max_units]])


def kinds_of(x: np.ndarray, n: int) -> np.ndarray:
    """(rows x n) whether each row lies on the positive side of the n principal directions of the rows; their signs make the heavier side the smaller one."""
    rest = x - x.mean(0, keepdims=True) if len(x) else x
    out = np.zeros((len(x), n), bool)
    for k in range(n):
        direction = np.ones(x.shape[1]) / np.sqrt(max(1, x.shape[1])) + np.linspace(0, 1e-3, x.shape[1])
        for _ in range(50):
            direction = rest.T @ (rest @ direction)
            length = np.linalg.norm(direction)
            if length < 1e-9:
                return out
            direction /= length
        score = rest @ direction
        if (score > 0).sum() > len(x) / 2:
            score, direction = -score, -direction
        out[:, k] = score > 0
        rest = rest - np.outer(rest @ direction, direction)
    return out


def train(rows: list[tuple[str, int]], kinds: int = KINDS, max_units: int = 400, min_texts: int = 4, strength: float = 0.001, folds: int = 5) -> Chain:
    """Fit the chain to (text, label) rows."""
    y = np.array([label for _, label in rows], float)
    chain = Chain([*(f"kind_{k + 1}" for k in range(kinds)), LAST], np.zeros(0, np.uint64), [])
    if rows and y.min() < y.max():
        chain.words = separating_units([text for text, _ in rows], y, max_units, min(min_texts, max(2, len(rows) // 8)))
    # slab by slab: hashing takes many times the bytes of its texts
    found = [chain.features(data, off) for _, data, off in _text.slabs(pa.array([text for text, _ in rows], pa.large_string()))]
    x = np.concatenate(found or [chain.features(*_text.joined([]))]).astype(np.float64)
    kind = np.zeros((len(rows), kinds))
    toxic = np.flatnonzero(y > 0)
    kind[toxic] = kinds_of(x[toxic][:, : len(chain.words)], kinds)
    fold = np.arange(len(rows)) % folds  # rows come in hash order
    for target in [*kind.T, y]:
        apart = np.zeros(len(rows))
        for k in range(folds):
            inside, outside = fold != k, fold == k
            if outside.any():
                w = logistic(x[inside], target[inside], strength)
                apart[outside] = sigmoid(x[outside] @ w[:-1] + w[-1])
        chain.weights.append(logistic(x, target, strength))
        x = np.hstack([x, apart[:, None]])
    return chain


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 2400, max_bytes: int = 16 << 20, allowed=None, id_col: str = "doc_id", text_col: str = "text", **settings) -> Chain:
    """A chain trained on at most max_rows labelled documents and about max_bytes of text."""
    return train(_labels.sample(docs, labels, label, max_rows, max_bytes, allowed, id_col, text_col), **settings)


def scored(docs: DataFrame, chain: Chain, columns: list[str], text_col: str = "text") -> DataFrame:
    """Every row: its `columns` in the struct `row`, so that their names are free, and the probability of each category, p_<category>."""
    runtime.ship(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most twice max_units weights a category
    named = docs.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in _text.slabs(batch.column(1)):
                found = shared.value.probabilities(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), *(pa.array(x.astype(np.float64)) for x in found.T)], ["row", *names])

    return named.mapInArrow(run, StructType([named.schema["row"], *StructType.fromDDL(", ".join(f"{x} double" for x in names))]))


def judge(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a probability for each category, toxic) of every row."""
    rows = scored(docs, chain, [id_col], text_col)
    probabilities = [f"p_{c}" for c in chain.categories]
    return rows.select(F.col("row").getField(id_col).alias("doc_id"), *probabilities, (F.col(probabilities[-1]) >= threshold).alias("toxic"))


def keep(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with their columns."""
    return scored(docs, chain, list(docs.columns), text_col).filter(F.col(f"p_{chain.categories[-1]}") < threshold).select("row.*")
