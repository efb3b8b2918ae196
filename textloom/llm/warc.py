"""WARC archives compressed record by record with a Zstandard dictionary.

An archive file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record after it is a
frame of its own, so a reader can start at any record. The dictionary is built from the file's first records, up to
`sample_bytes` of them. Of records with equal payloads of at least `revisit_bytes` bytes, the one with the largest page
id is a response and the others revisit it; revisit records carry headers and no payload.

A null html is an empty payload. Repeated rows whose id is the largest of their payload are responses all. A null id
is smaller than any other. An empty table writes no archive. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import runtime

MAGIC = 0x184D2A5D
MANIFEST = "path string, n_records long"
WINDOW = 1 << 20
#: Revisits that may be broadcast, so that payloads stay where they are read; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def payload_groups(pages: DataFrame, id_col: str, text_col: str, revisit_bytes: int) -> DataFrame:
    """(page_id, payload_digest, response): a row for each page that repeats a payload; narrow columns only."""
    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    keys = pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("payload_digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= revisit_bytes)
    largest = keys.groupBy("payload_digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keys.join(largest, ["payload_digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("response"))).select("page_id", "payload_digest", "response").distinct()


def record(page_id: object, url: str | None, payload: bytes, digest: bytes, size: int, refers_to: object, date: str) -> bytes:
    """One WARC record; refers_to of a revisit, else None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int):
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(
    pages: DataFrame,
    folder: str,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 3,
    dictionary_bytes: int = 65_536,
    sample_bytes: int = 4 << 20,
    revisit_bytes: int = 1000,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """Write the archives below `folder` (a URI that all executors reach) and return the manifest of files."""
    spark = pages.sparkSession
    runtime.ship(spark)
    repeats = runtime.stored(payload_groups(pages, id_col, text_col, revisit_bytes), "revisits")
    if repeats.count() <= MAX_BROADCAST:
        repeats = F.broadcast(repeats)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    same = rows["page_id"].eqNullSafe(repeats["page_id"]) & (rows["payload_digest"] == repeats["payload_digest"])
    joined = rows.join(repeats, same, "left").select(rows["page_id"], rows["url"], rows["html"], repeats["response"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for given in batches:
                for k in range(given.num_rows):
                    page_id, url, html, response = (given.column(i)[k].as_py() for i in range(4))
                    payload = html.encode()
                    yield record(page_id, url, payload, hashlib.sha1(payload).digest(), len(payload), response, date)

        stream, held, size = records(), [], 0
        for one in stream:
            held.append(one)
            size += len(one)
            if size >= sample_bytes:
                break
        if not held:
            return
        dictionary = build_dictionary(held, dictionary_bytes)
        target, at = _filesystem(folder)
        target.create_dir(at, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        n = 0
        with target.open_output_stream(f"{at}/{name}", compression=None) as out:
            raw = dictionary.as_bytes()
            out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary)

            def rest() -> Iterator[bytes]:
                yield from held
                yield from stream

            for one in rest():
                out.write(compressor.compress(one))
                n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "n_records": pa.array([n], pa.int64())})

    joined.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, in order."""
    import zstandard

    target, at = _filesystem(path)
    with target.open_input_stream(at, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        raw = source.read(size)
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        with decompressor.stream_reader(source, read_across_frames=True, read_size=WINDOW) as reader:
            buffer = bytearray()

            def more() -> bool:
                got = reader.read(WINDOW)
                buffer.extend(got)
                return bool(got)

            while True:
                while (cut := buffer.find(b"\r\n\r\n")) < 0:
                    if not more():
                        if buffer:
                            raise ValueError(f"{path} ends within a record")
                        return
                lines = bytes(buffer[:cut]).decode().split("\r\n")
                headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                length = int(headers["Content-Length"])
                while len(buffer) < cut + 8 + length:
                    if not more():
                        raise ValueError(f"{path} ends within a record")
                yield headers, bytes(buffer[cut + 4 : cut + 4 + length])
                del buffer[: cut + 8 + length]


def _page(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None if urn else None


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """A row for each record: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); the payload of a revisit is null."""
    runtime.ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("path").repartition(runtime.shuffle_partitions(spark))
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path in given.column(0).to_pylist():
                rows, size = [], 0
                for headers, block in records_of(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"{path} holds a damaged payload of {headers['WARC-Record-ID']}")
                    rows.append({"page_id": _page(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "refers_to": _page(headers.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest.hex(), "payload": None if revisit else payload})
                    size += len(payload)
                    if size >= WINDOW or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = manifest.mapInArrow(load, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
