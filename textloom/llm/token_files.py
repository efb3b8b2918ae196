"""Token ids on disk as Arrow files of fixed-size-list batches.

The stream of all documents' ids, in ascending doc_id order, is cut into sequences of `sequence` ids. A file holds the
sequences of one range of documents as record batches with three columns: `ids` (fixed-size list of the narrowest
unsigned type that holds the vocabulary), `valid` (mask, false only in the padding at a file's end) and `last` (mask,
true at the end id of each document). All lists have one length, so sequence k of a batch is a slice of its buffers and a memory
map gives it without a copy. A second small Arrow file beside it names the documents. A manifest (Parquet) lists the
files; files of failed task attempts are not in it.

Null and empty texts are the end id alone. Repeated rows of a doc_id are written once each, ordered by text; a null
doc_id comes first. An empty table gives an empty manifest. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import runtime
from textloom.llm.packing import with_ends

MANIFEST = "part int, path string, documents_path string, n_documents long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Collects ids and writes whole sequences, `batch` of them at once."""

    def __init__(self, sink, width: np.dtype, sequence: int, batch: int) -> None:
        self.sequence, self.batch, self.width = sequence, batch, width
        self.kinds = [pa.list_(pa.field("item", kind, False), sequence) for kind in (pa.from_numpy_dtype(width), pa.bool_(), pa.bool_())]
        self.out = pa.ipc.new_file(sink, pa.schema([pa.field(n, k, False) for n, k in zip(("ids", "valid", "last"), self.kinds, strict=True)]))
        self.ids, self.last, self.waiting, self.total = [], [], 0, 0

    def add(self, ids: np.ndarray, last: np.ndarray) -> None:
        self.ids.append(ids.astype(self.width))
        self.last.append(last)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.sequence * self.batch:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids, last = np.concatenate(self.ids), np.concatenate(self.last)
        step = self.sequence * self.batch
        upto = len(ids) if end else len(ids) // step * step
        for at in range(0, upto, step):
            some = min(step, upto - at)
            n = -(-some // self.sequence)
            columns = [np.zeros(n * self.sequence, self.width), np.zeros(n * self.sequence, bool), np.zeros(n * self.sequence, bool)]
            columns[0][:some], columns[1][:some], columns[2][:some] = ids[at : at + some], True, last[at : at + some]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(c), type=k) for c, k in zip(columns, self.kinds, strict=True)], schema=self.out_schema()))
        self.ids, self.last, self.waiting = [ids[upto:]], [last[upto:]], len(ids) - upto

    def out_schema(self) -> pa.Schema:
        return pa.schema([pa.field(n, k, False) for n, k in zip(("ids", "valid", "last"), self.kinds, strict=True)])

    def close(self) -> None:
        if self.waiting:
            self._flush(True)
        self.out.close()


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, sequence: int = 2048, batch: int = 64, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below `folder` (a URI that all executors reach) and return the manifest."""
    spark = docs.sparkSession
    runtime.ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(files or 2 * runtime.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm import _text as text
        from textloom.llm import _tokens as tokens

        encoder = tokens.encoder(vocabulary)
        width = np.dtype(np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        target, base = _filesystem(folder)
        part = TaskContext.get().partitionId()
        stem = f"{base}/tokens-{part:06d}-{uuid.uuid4().hex[:12]}"
        writer = names = None
        n_documents = 0
        for given in batches:
            if not given.num_rows:
                continue
            if writer is None:
                target.create_dir(base, recursive=True)
                sink, names_sink = target.open_output_stream(f"{stem}.arrow"), target.open_output_stream(f"{stem}.documents.arrow")
                writer = _Writer(sink, width, sequence, batch)
                names = pa.ipc.new_file(names_sink, pa.schema([("doc_id", given.schema.field(0).type)]))
            names.write_batch(pa.RecordBatch.from_arrays([given.column(0)], ["doc_id"]))
            n_documents += given.num_rows
            for _, data, off in text.slabs(given.column(1)):
                ids, first = with_ends(*encoder.encode(data, off), end_id)
                last = np.zeros(len(ids), bool)
                last[first[1:] - 1] = True
                writer.add(ids, last)
        if writer is not None:
            for one in (writer, names, sink, names_sink):
                one.close()
            prefix = folder.rstrip("/")
            name = stem.rpartition("/")[2]
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": f"{prefix}/{name}.arrow", "documents_path": f"{prefix}/{name}.documents.arrow", "n_documents": n_documents, "n_tokens": writer.total}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents_path", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def open_sequences(path: str):
    """A memory-mapped reader of one file: .get_batch(k) shares the file's pages."""
    target, at = _filesystem(path)
    source = pa.memory_map(at) if target.type_name == "local" else target.open_input_file(at)
    return pa.ipc.open_file(source)


def sequence_at(reader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, valid) of sequence k; the ids are a view of the mapped file, and the mask is expanded from a view of its bits."""
    size = reader.get_batch(0).num_rows
    got = reader.get_batch(k // size)
    length = got.schema.field("ids").type.list_size
    row = k % size
    return got.column("ids").flatten().to_numpy(zero_copy_only=True)[row * length : (row + 1) * length], got.column("valid").flatten()[row * length : (row + 1) * length].to_numpy(zero_copy_only=False)


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """A row for each document in the files: (doc_id, start, n_tokens, ids_crc32); start counts ids of all documents before it."""
    runtime.ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    placed = placed.select("path", "documents_path", "base").repartition(2 * runtime.shuffle_partitions(spark))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for one in given.to_pylist():
                target, at = _filesystem(one["documents_path"])
                with target.open_input_file(at) as source:
                    names = pa.ipc.open_file(source).read_all().column("doc_id").combine_chunks()
                reader = open_sequences(one["path"])
                done, base, carry = 0, one["base"], np.zeros(0, np.uint32)
                for k in range(reader.num_record_batches):
                    got = reader.get_batch(k)
                    valid = got.column("valid").flatten().to_numpy(zero_copy_only=False)
                    ids = got.column("ids").flatten().to_numpy()[valid].astype("<u4")
                    last = np.flatnonzero(got.column("last").flatten().to_numpy(zero_copy_only=False)[valid]) + 1 + len(carry)
                    ids = np.concatenate([carry, ids])
                    begin = np.concatenate([[0], last[:-1]]) if len(last) else last
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), last.tolist(), strict=True)]
                    if len(last):
                        yield pa.RecordBatch.from_arrays(
                            [names.slice(done, len(last)), pa.array(base + begin, pa.int64()), pa.array(last - begin, pa.int64()), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        done, base, carry = done + len(last), base + int(last[-1]), ids[last[-1] :]
                    else:
                        carry = ids

    return placed.mapInArrow(load, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
