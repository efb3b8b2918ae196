"""Vector best-fit packing of tokenised documents into fixed-length sequences.

Every piece needs a vector of three resources (tokens, one document, attention cost = length squared), every sequence
has a capacity for each. Pieces go in order of decreasing length into the open sequence that is best under the chosen
score among those with room in all three: the smallest weighted norm of what stays free, or the largest weighted dot
product of need and room. Text is tokenised where it is read and only piece lengths are shuffled, in groups of about
`group_pieces`, so no task holds more than a bounded number of pieces.

Null and empty texts are documents of the end id alone. Null ids are kept as ids of their own rows. Repeated rows are
packed once each and dealt to different groups. Ids of any type serve; pieces of equal length go in the order of id, nulls
last. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import runtime
from textloom.llm import _text

WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_cost: int, score: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in tokens) of each piece; lengths must not rise."""
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    limits = np.array([capacity, max_documents, max_cost], float)
    scale = np.array(weights) / limits**2
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return where, offset
    least = int(lengths.min())
    room = np.zeros((3, 1024))  # of the open bins
    label = np.zeros(1024, np.int64)
    n_open = n_bins = 0
    for k, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], float)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        free = room[:, :n_open]
        fits = np.flatnonzero((free[0] >= need[0]) & (free[1] >= 1) & (free[2] >= need[2]))
        if len(fits):
            if score == "norm":
                at = fits[np.argmin(scale @ (free[:, fits] - need[:, None]) ** 2)]
            else:
                at = fits[np.argmax((scale * need) @ free[:, fits])]
        else:
            if n_open == room.shape[1]:
                room, label = np.hstack([room, np.zeros_like(room)]), np.concatenate([label, np.zeros_like(label)])
            room[:, n_open], label[n_open] = limits, n_bins
            at, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        where[k], offset[k] = label[at], capacity - room[0, at]
        room[:, at] -= need
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:  # nothing fits any more
            n_open -= 1
            room[:, at], label[at] = room[:, n_open], label[n_open]
    return where, offset


def with_ends(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document, and the documents' new first positions."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + _text.owners(first)] = ids
    return out, first + np.arange(n + 1)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (doc_id, piece, start, length, ids_crc32, at); at counts the texts of a task, which parts repeated rows."""
    runtime.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, at long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm import _text as text
        from textloom.llm import _tokens as tokens

        encoder, done = tokens.encoder(vocabulary), 0
        for batch in batches:
            for row, data, off in text.slabs(batch.column(1)):
                ids, first = with_ends(*encoder.encode(data, off), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                size = np.diff(first)
                n_pieces = -(-size // capacity)
                own = np.repeat(np.arange(len(size)), n_pieces)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[own] - start)
                begin = first[own] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(done + own, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "at"],
                )
                done += len(size)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_cost: int | None = None,
    score: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
    group_pieces: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    max_documents and max_cost default to what a full sequence of tokens never exceeds: capacity and capacity squared.
    """
    documents, cost = capacity if max_documents is None else max_documents, capacity * capacity if max_cost is None else max_cost
    found = runtime.stored(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    groups = max(1, -(-found.count() // group_pieces))
    keyed = found.withColumn("group", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, length, at), {groups})"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "at"))])
        bins, offset = best_fit(table.column("length").to_numpy(), capacity, documents, cost, score, weights)
        group = table.column("group").to_numpy()
        return table.drop_columns(["group", "at"]).append_column("sequence_id", pa.array((group << 32) | bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    runtime.ship(docs.sparkSession)
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return keyed.groupBy("group").applyInArrow(place, schema)
