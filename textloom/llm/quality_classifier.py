"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Bytes are embedded, a byte that ends a repeat of four bytes within the last REACH ones apart from any other; learned filters of `blocks` times four bytes slide over the text by four bytes, so chunks overlap
and cover the document to its end; each filter keeps its largest response over all chunks (max-pooling), and a logistic
unit combines them into one probability. Training is Adam on the logistic loss over a bounded sample of labelled rows;
scoring reads every byte of every text where it is stored, without a shuffle.

Null and empty texts are scored as a chunk of padding. Repeated rows are scored once each. Without labelled rows of
both classes every score is the share of label 1 (1.0 without any label). Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import runtime
from textloom.llm import _labels

STEP = 4
REACH = 32
#: Zero blocks after each text, so that no repeat reaches into the text before.
GAP = -(-(REACH + 3) // STEP)
#: Bytes convolved at once.
WORK_BYTES = 1 << 18


def blocks_of(data: np.ndarray, off: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with zeros so that each text is whole blocks and a gap, first block of each text and their total)."""
    size = np.diff(off)
    count = np.maximum(-(-size // STEP), 1) + max(blocks - 1, GAP)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * STEP, np.uint8)
    if len(data):
        shift = first[:-1] * STEP - off[:-1]
        out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, first


def symbols(padded: np.ndarray) -> np.ndarray:
    """Bytes, raised by 256 where the last four bytes stood REACH or fewer bytes before as well."""
    if len(padded) < 4:
        return padded.astype(np.int16)
    wide = padded.astype(np.uint32)
    four = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
    again = np.zeros(len(padded), bool)
    for lag in range(1, min(REACH, len(four) - 1) + 1):
        again[3 + lag :] |= four[lag:] == four[:-lag]
    return padded + np.where(again & (padded > 0), np.int16(256), np.int16(0))


@dataclass
class Network:
    embed: np.ndarray  # 512 x depth; byte 0 is padding
    filters: np.ndarray  # blocks x (STEP * depth) x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None

    @classmethod
    def fresh(cls, depth: int, blocks: int, n_filters: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (512, depth)).astype(np.float32)
        embed[0] = 0
        filters = rng.normal(0, 1 / np.sqrt(blocks * STEP * depth), (blocks, STEP * depth, n_filters)).astype(np.float32)
        return cls(embed, filters, np.zeros(n_filters, np.float32), rng.normal(0, 0.3, n_filters).astype(np.float32), 0.0)

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Filter responses of every chunk: (number of blocks - blocks + 1) x filters."""
        n = len(self.filters)
        each = self.embed[padded].reshape(-1, self.filters.shape[1])
        m = len(each) - n + 1
        total = each[:m] @ self.filters[0]
        for j in range(1, n):
            total += each[j : j + m] @ self.filters[j]
        return total + self.bias

    def pooled(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Largest response of each filter over each text's chunks, at least 0."""
        n = len(self.filters)
        padded, first = blocks_of(data, off, n)
        padded = symbols(padded)
        best = np.zeros((len(off) - 1, len(self.bias)), np.float32)
        step = WORK_BYTES // STEP
        begin, end = first[:-1], first[1:] - n + 1  # chunks of each text
        for at in range(0, int(first[-1]) - n + 1, step):
            upto = min(int(first[-1]) - n + 1, at + step)
            got = self.responses(padded[at * STEP : (upto + n - 1) * STEP])
            low, high = int(np.searchsorted(end, at, "right")), int(np.searchsorted(begin, upto, "left"))
            a = np.maximum(begin[low:high], at) - at
            b = np.minimum(end[low:high], upto) - at
            cuts = np.stack([a, b], 1).ravel()
            if cuts[-1] == len(got):
                cuts = cuts[:-1]
            best[low:high] = np.maximum(best[low:high], np.maximum.reduceat(got, cuts)[::2])
        return best

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        z = self.pooled(data, off).astype(np.float64) @ self.out.astype(np.float64) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[str, int]], depth: int = 8, blocks: int = 3, n_filters: int = 32, epochs: int = 10, batch: int = 32, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Network:
    """Fit the network to (text, label) rows."""
    labels = np.array([y for _, y in rows], float)
    net = Network.fresh(depth, blocks, n_filters, seed)
    if not len(rows) or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(rows) else 1.0
        return net
    raw = [np.frombuffer(x.encode(), np.uint8) for x, _ in rows]
    rng = np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "out")
    first_moment = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    second_moment = {k: np.zeros_like(getattr(net, k)) for k in names} | {"out_bias": 0.0}
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    time = 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            data = np.concatenate([raw[k] for k in some])
            off = np.concatenate([[0], np.cumsum([len(raw[k]) for k in some])])
            padded, first = blocks_of(data, off, blocks)
            padded = symbols(padded)
            got = net.responses(padded)
            at = np.stack([a + got[a : b - blocks + 1].argmax(0) for a, b in zip(first[:-1], first[1:], strict=True)])
            best = np.take_along_axis(got, at, 0)
            on = best > 0
            best = best * on
            z = best @ net.out + net.out_bias
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[some]) * weight[some] / len(some)
            slope = slope.astype(np.float32)
            grad: dict = {"out": best.T @ slope + decay * net.out, "out_bias": float(slope.sum())}
            back = slope[:, None] * net.out * on
            grad["bias"] = back.sum(0)
            pieces = padded.reshape(-1, STEP)[at[:, :, None] + np.arange(blocks)]  # texts x filters x blocks x STEP
            seen = net.embed[pieces].reshape(*at.shape, blocks, -1)
            grad["filters"] = np.einsum("df,dfbk->bkf", back, seen) + decay * net.filters
            to_embed = (back[:, :, None, None] * net.filters.transpose(2, 0, 1)[None]).reshape(-1, depth)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], pieces.ravel(), to_embed)
            grad["embed"][0] = 0
            time += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**time) / (1 - 0.9**time)
            for k, g in grad.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - pace * first_moment[k] / (np.sqrt(second_moment[k]) + 1e-8))
    # the classes were weighed alike; put the sample's odds back
    net.out_bias += float(np.log(labels.mean() / (1 - labels.mean())))
    for k in names:
        setattr(net, k, getattr(net, k).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, max_bytes: int = 64 << 20, allowed=None, id_col: str = "doc_id", text_col: str = "text", **settings) -> Network:
    """A network trained on at most max_rows labelled documents and about max_bytes of text."""
    return train(_labels.sample(docs, labels, label, max_rows, max_bytes, allowed, id_col, text_col), **settings)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    runtime.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm import _text as text

        for batch in batches:
            for row, data, off in text.slabs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), pa.array(shared.value.score(data, off), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
