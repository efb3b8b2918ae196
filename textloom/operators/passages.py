"""Exact Jaccard join of texts by their sets of k-character shingles, from packed parts of the sets.

A column of a single shingle is held by more texts the more there are, so columns are made of several. The shingles of a
text are dealt in p parts by hash; a part with all it holds is a column. Linked texts of sizes x and y differ in
e = (x + y) (1 - t) / (1 + t) shingles at most, so in e of their parts, and of p columns share p - e. The columns of a
text are ordered by the rarity of what they hold in a sample, rarest first; any order gives the same result. A text
posts the first e + l: of these linked texts share l. They are dealt in G groups by hash, so one group holds c = ceil(l / G) of
them: pairs that no group counts so often are discarded.

p must be the same for both texts, so texts are joined by classes of sizes, about 3 shingles to a part in each. A text whose
partners reach into the next class is posted there too. Equal 32-bit hashes only add candidates; pairs that are left are
verified on the shingles themselves.

Nothing is sampled but the order, and no column is cut: the work of a frequent column grows with the square of the texts
of like size that post it.

With a number of `groups`, the columns are single shingles (`postings`, `meet`). Of n shingles a text then posts the first
n - ceil(t n) + 1, its prefix, with their places. Linked texts of sizes x and y share o = ceil(t (x + y) / (1 + t)) shingles
at least, so what precedes the last o - l of these lies in both prefixes for every l up to o - ceil(t max(x, y)) + 1, and
the first l of them have places after which o - l + 1 shingles are left on both sides; l is (c - 1) G + 1 with the largest
c that fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import runtime

SLAB_BYTES = 1 << 20
#: One in so many texts is counted for the order of the shingles; the most frequent ones that are told to all tasks (12 bytes each).
SAMPLE, MAX_FREQUENT = 8, 1_000_000
#: Prefix entries that a task packs at once; pairs that a group forms at once, but for those of one text.
FLUSH, PAIRS = 1_000_000, 1_000_000
#: Rows of two whole texts that Python gets at once, and pairs whose texts are shuffled before their files are released.
PAIR_ROWS, PART = 200, 250_000
#: The fewest groups: fewer groups discard more pairs, more hold less each.
FEWEST = 12
#: Texts that are packed at once at most, so that 16 bits number them; columns of a class that a group gets at most.
MOST_TEXTS, CLASS_GROUP = 60_000, 2_500_000
#: The ratio of the sizes of a class; its parts for each that may differ; the share of these that is posted besides, so that pairs are counted.
RATIO, PARTS, MORE = 1.5, 1.3, 6
#: Steps of the rarity of a shingle by a factor of two, and the bits of the rarity of a part.
STEPS, RARITY = 16, 20
#: For products with the threshold, so that rounding never shortens a prefix or raises a bound.
SLACK = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slabs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts; none is null."""
    column = column.cast(pa.large_string())
    n, at = len(column), 0
    if not n:
        return
    _, offsets, raw = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    while at < n:
        upto = max(at + 1, int(np.searchsorted(off, off[at] + SLAB_BYTES, "right")) - 1)
        yield at, data[off[at] : off[upto]], off[at : upto + 1] - off[at]
        at = upto


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, first of each text and their total); a text shorter than k is its own shingle."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    points += np.uint64(1)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    n = np.diff(first)
    h = np.zeros(len(points), np.uint64)
    for j in range(k):  # what reaches beyond its text is left out below
        h *= _BASE
        h[: len(points) - j] += points[j:]
    short = np.flatnonzero((n > 0) & (n < k))
    at, value = first[:-1][short], np.zeros(len(short), np.uint64)
    for j in range(k):
        value *= _BASE
        inside = n[short] > j
        value[inside] += points[at[inside] + j]
    h[at] = value
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    whole = np.arange(len(points)) + k <= np.repeat(first[1:], n)
    whole[at] = True
    h = h[whole]
    count = np.where(n < k, n > 0, n - k + 1)
    cuts = np.concatenate([[0], np.cumsum(count)])
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[begin:end].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cuts[:-1][count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[cuts]


def bounds(x: np.ndarray, y: np.ndarray, threshold: float, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes x <= y: the least overlap of linked sets, and how often a group of columns counts them at least."""
    overlap = np.ceil((x + y) * (threshold / (1 + threshold)) - SLACK).astype(np.int64)
    first = np.maximum(1, overlap - np.ceil(y * threshold - SLACK).astype(np.int64) + 1)
    return overlap, -(-first // groups)


def frequent(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that a sample of the texts holds most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sets_of(data, off, k)[0] for _, data, off in slabs(batch.column(0))]
            if found:
                h, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], ["h", "c"])

    some = texts.filter(f"pmod(xxhash64(at), {SAMPLE}) = 0").select("skeleton").mapInArrow(run, "h long, c long")
    rows = some.groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").orderBy(F.desc("c"), "h").limit(MAX_FREQUENT)
    rows = rows.select("h", F.col("c").cast("int")).toArrow()
    h, count = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def postings(texts: DataFrame, threshold: float, k: int, groups: int, known) -> DataFrame:
    """(block, size, payload): packed texts, sizes, places and columns of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = known.value
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            entries = [np.concatenate(x) for x in zip(*held, strict=True)]
            block = (entries[3] % np.uint32(groups)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            keys, at = np.unique(block[order], return_index=True)
            parts = [np.split(x[order], at[1:]) for x in entries]
            packed = [pa.compress(b"".join(x.tobytes() for x in one), codec="zstd", asbytes=True) for one in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([len(x) for x in parts[0]], pa.int32()), pa.array(packed, pa.binary())], ["block", "size", "payload"])

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, off in slabs(batch.column(1)):
                h, first = sets_of(data, off, k)
                n = np.diff(first)
                own = np.repeat(np.arange(len(n)), n)
                count = np.zeros(len(h), np.int32)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    count = np.where(hashes[at] == h, counts[at], 0)
                order = np.lexsort((h, count, own))
                h, own = h[order], own[order]
                pos = np.arange(len(h)) - first[own]
                front = pos <= n[own] - np.ceil(n[own] * threshold - SLACK)
                h, own, pos = h[front], own[front], pos[front]
                held.append((ids[row + own], n[own].astype(np.int32), pos.astype(np.int32), (h >> np.uint64(32)).astype(np.uint32)))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("at", "skeleton").mapInArrow(run, "block int, size int, payload binary")


def meet(table: pa.Table, threshold: float, groups: int) -> pa.Table:
    """The (a, b) pairs of texts that this group of columns counts often enough."""
    held = []
    for size, raw in zip(table.column("size").to_pylist(), table.column("payload"), strict=True):
        raw = pa.decompress(raw.as_buffer(), decompressed_size=20 * size, codec="zstd", asbytes=True)
        held.append((np.frombuffer(raw, np.int64, size), *(np.frombuffer(raw, kind, size, at * size) for kind, at in ((np.int32, 8), (np.int32, 12), (np.uint32, 16)))))
    at, n, pos, col = (np.concatenate(x) for x in zip(*held, strict=True))
    names, text = np.unique(at, return_inverse=True)
    order = np.lexsort((text, n, col))
    text, n, pos, col = text[order], n[order].astype(np.int64), pos[order], col[order]
    sizes = np.zeros(len(names), np.int64)
    sizes[text] = n
    column = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]])) << 32
    width = np.searchsorted(column | n, column | np.floor(n / threshold + SLACK).astype(np.int64), "right") - np.arange(len(n)) - 1
    # the smaller of two texts comes first in all columns, so the pairs of a text are counted at once
    share = (np.cumsum(np.bincount(text, width, len(names))) // PAIRS).astype(np.int64)[text]
    some = np.flatnonzero(width > 0)
    some = some[np.argsort(share[some], kind="stable")]
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one in np.split(some, np.flatnonzero(np.diff(share[some])) + 1):
        w = width[one]
        x = np.repeat(one, w)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w)
        overlap, often = bounds(n[x], n[y], threshold, groups)
        ok = (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= overlap - (often - 1) * groups) & (text[x] != text[y])
        pair, count = np.unique(text[x[ok]] * len(names) + text[y[ok]], return_counts=True)
        a, b = pair // len(names), pair % len(names)
        good = count >= bounds(sizes[a], sizes[b], threshold, groups)[1]
        low.append(names[a[good]])
        high.append(names[b[good]])
    a, b = np.concatenate(low), np.concatenate(high)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes of the hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Classes:
    """Classes of sizes: the texts of one have partners in it and the next above at most."""

    def __init__(self, threshold: float):
        self.threshold, self.rest = threshold, (1 - threshold) / (1 + threshold)
        low = [1]
        while low[-1] < 1 << 32:
            low.append(math.ceil(low[-1] * max(RATIO, 1 / threshold + SLACK)))
        self.low = np.array(low, np.int64)

    def of(self, n: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(class, the texts of it, and those below with partners in it) by the texts' sizes."""
        own = np.searchsorted(self.low, n, "right") - 1
        up = np.floor(n / self.threshold + SLACK) >= self.low[own + 1]
        return [(c, np.flatnonzero((own == c) | (up & (own == c - 1)))) for c in np.union1d(own, own[up] + 1).tolist()]

    def differ(self, n: np.ndarray, c: int) -> np.ndarray:
        """In how many shingles, and so parts, a text of n and a linked one of the class differ at most."""
        partner = np.minimum(np.floor(n / self.threshold + SLACK), self.low[c + 1] - 1)
        return np.floor((n + partner) * self.rest + SLACK).astype(np.int64)

    def parts(self, c: int) -> int:
        return math.ceil(PARTS * (math.floor(2 * (self.low[c + 1] - 1) * self.rest + SLACK) + 1))

    def often(self, c: int, groups: int) -> int:
        """How often some group of the class counts a linked pair at least."""
        return 1 + int(self.differ(self.low[c : c + 1], c)[0]) // MORE // groups

    def length(self, n: np.ndarray, c: int, groups: int) -> np.ndarray:
        """The columns that texts of n shingles post, of self.parts(c) at most."""
        return self.differ(n, c) + (self.often(c, groups) - 1) * groups + 1


def sampled(texts: DataFrame, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], int]:
    """Of a sample: (sorted hashes, counts) of the shingles held most often, the columns posted by class, the number of texts."""
    classes = Classes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], {-1: batch.num_rows}
            for _, data, off in slabs(batch.column(0)):
                h, first = sets_of(data, off, k)
                n = np.diff(first)
                found.append(h)
                for c, some in classes.of(n):
                    size[c] = size.get(c, 0) + int(classes.length(n[some], c, FEWEST).sum())
            if found:
                h, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(h)), pa.array(h.view(np.int64)), pa.array(count)], ["sizes", "h", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(size)), pa.array(list(size), pa.int64()), pa.array(list(size.values()), pa.int64())], ["sizes", "h", "c"])

    some = texts.filter(f"pmod(xxhash64(at), {SAMPLE}) = 0").select("skeleton").mapInArrow(run, "sizes boolean, h long, c long")
    counts = runtime.stored(some.groupBy("sizes", "h").agg(F.sum("c").alias("c")).filter("sizes OR c > 1"), "sampled")
    size = {r["h"]: r["c"] for r in counts.filter("sizes").collect()}
    rows = counts.filter("NOT sizes").orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).select("h", F.col("c").cast("int")).toArrow()
    runtime.drop(counts)
    h, count = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(h)
    n_texts = size.pop(-1, 0)
    return h[order], count[order], size, n_texts


def columns_of(h: np.ndarray, n: np.ndarray, rarity: np.ndarray, parts: int) -> np.ndarray:
    """(texts x parts) sorted columns: rarity, rarest first, and 32 bits of what the part holds."""
    some = mixed(h)
    cell = np.repeat(np.arange(len(n)) * parts, n) + (some % np.uint64(parts)).astype(np.int64)
    held = np.zeros(len(n) * parts, np.uint64)
    np.add.at(held, cell, mixed(some))
    rare = np.bincount(cell, rarity, len(held)).astype(np.uint64)
    held = mixed(held.reshape(len(n), parts) + np.arange(1, parts + 1, dtype=np.uint64) * _BASE)
    most = np.uint64((1 << RARITY) - 1)
    found = (most - np.minimum(rare, most)).reshape(len(n), parts) << np.uint64(32) | held >> np.uint64(32)
    found.sort(axis=1)
    return found


def planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all first ones before all second ones, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def numbers(raw: np.ndarray, kind: type) -> np.ndarray:
    """What `planes` has packed."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def part_postings(texts: DataFrame, threshold: float, k: int, groups: dict[int, int], known) -> DataFrame:
    """(block, texts, size, payload): packed texts, sizes and columns of a class and group. known: hashes, their rarity, that of others."""
    classes = Classes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rare, rarest = known.value
        held: dict[int, list[tuple]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for c, found in held.items():
                ids, n, length, col = (np.concatenate(x) for x in zip(*found, strict=True))
                text = np.repeat(np.arange(len(ids)).astype(np.uint16), length)
                group = col % np.uint32(groups.get(c, FEWEST))
                order = np.lexsort((col, group))
                col, text = col[order], text[order]
                keys, at = np.unique(group[order], return_index=True)
                names, sizes, packed = ids.tobytes() + n.astype(np.int32).tobytes(), [], []
                for one, own in zip(np.split(col, at[1:]), np.split(text, at[1:]), strict=True):
                    sizes.append(len(one))
                    packed.append(pa.compress(names + planes(np.diff(one, prepend=np.uint32(0))) + planes(own), codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64) << 8 | c), pa.array([len(ids)] * len(keys), pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["block", "texts", "size", "payload"]
                )

        size = n_texts = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, off in slabs(batch.column(1)):
                h, first = sets_of(data, off, k)
                n = np.diff(first)
                rarity = np.full(len(h), rarest, np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    rarity = np.where(hashes[at] == h, rare[at], rarest)
                if n_texts + len(n) > MOST_TEXTS:
                    yield from flush()
                    held, size, n_texts = {}, 0, 0
                for c, some in classes.of(n):
                    mine = np.zeros(len(n), bool)
                    mine[some] = True
                    mine = np.repeat(mine, n)
                    length = classes.length(n[some], c, groups.get(c, FEWEST))
                    col = columns_of(h[mine], n[some], rarity[mine], classes.parts(c))
                    front = np.arange(col.shape[1]) < length[:, None]
                    held.setdefault(c, []).append((ids[row + some], n[some], length, col[front].astype(np.uint32)))
                    size += int(length.sum())
                n_texts += len(n)
                if size >= FLUSH:
                    yield from flush()
                    held, size, n_texts = {}, 0, 0
        yield from flush()

    return texts.select("at", "skeleton").mapInArrow(run, "block long, texts int, size int, payload binary")


def meet_parts(table: pa.Table, threshold: float, groups: dict[int, int]) -> pa.Table:
    """The (a, b) pairs of texts that this group of a class counts often enough."""
    classes, c = Classes(threshold), table.column("block")[0].as_py() & 255
    least = classes.often(c, groups.get(c, FEWEST))
    held = []
    for n_texts, size, raw in zip(table.column("texts").to_pylist(), table.column("size").to_pylist(), table.column("payload"), strict=True):
        raw = np.frombuffer(pa.decompress(raw.as_buffer(), decompressed_size=12 * n_texts + 6 * size, codec="zstd", asbytes=True), np.uint8)
        ids, n, col, text = np.split(raw, [8 * n_texts, 12 * n_texts, 12 * n_texts + 4 * size])
        held.append((ids.view(np.int64), n.view(np.int32).astype(np.int64), np.cumsum(numbers(col, np.uint32), dtype=np.uint32), numbers(text, np.uint16)))
    start = np.cumsum([0, *(len(x[0]) for x in held)]).tolist()
    names, sizes = (np.concatenate([x[j] for x in held]) for j in (0, 1))
    by_size = np.lexsort((names, sizes))  # texts are numbered by size: the smaller of two comes first in all columns
    place = np.empty(len(names), np.uint64)
    place[by_size] = np.arange(len(names), dtype=np.uint64)
    names, sizes = names[by_size], sizes[by_size]
    both = np.concatenate([col.astype(np.uint64) << np.uint64(32) | place[text.astype(np.int64) + at] for (_, _, col, text), at in zip(held, start, strict=False)])
    del held
    both.sort()
    text, here = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), np.arange(len(both))
    # of a column a text meets what follows, up to the size that is too large; texts that are all below the class have met in their own
    beyond = np.searchsorted(sizes, np.floor(sizes / threshold + SLACK), "right").astype(np.uint64)
    native = int(np.searchsorted(sizes, classes.low[c]))
    column = both & np.uint64(0xFFFFFFFF00000000)
    begin = np.where(text < native, np.searchsorted(both, column | np.uint64(native)), here + 1)
    width = np.maximum(0, np.searchsorted(both, column | beyond[text]) - begin)
    del column
    # the pairs of a text are counted at once
    share = (np.cumsum(np.bincount(text, width, len(names))) // PAIRS).astype(np.int64)[text]
    some = np.flatnonzero(width)
    some = some[np.argsort(share[some], kind="stable")]
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one in np.split(some, np.flatnonzero(np.diff(share[some])) + 1):
        w = width[one]
        x = np.repeat(text[one], w)
        y = text[np.repeat(begin[one] - np.cumsum(w) + w, w) + np.arange(len(x))]
        pair = np.sort(x * len(names) + y)
        pair = np.unique(pair[: max(0, len(pair) - least + 1)][pair[least - 1 :] == pair[: max(0, len(pair) - least + 1)]])
        a, b = pair // len(names), pair % len(names)
        low.append(names[a[a != b]])
        high.append(names[b[a != b]])
    a, b = np.concatenate(low), np.concatenate(high)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def candidates(texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b) of the pairs that some group of columns counts often enough; how many groups a class has follows from the sample."""
    hashes, counts, size, n_texts = sampled(texts, threshold, k)
    groups = {c: max(FEWEST, math.ceil(SAMPLE * x / CLASS_GROUP)) for c, x in size.items()}
    rarest = round(STEPS * math.log2(max(2, n_texts)))
    rare = np.maximum(0, rarest - np.rint(STEPS * np.log2(np.maximum(1, counts))).astype(np.int64))
    posted = part_postings(texts, threshold, k, groups, texts.sparkSession.sparkContext.broadcast((hashes, rare, rarest)))
    return posted.groupBy("block").applyInArrow(lambda t: meet_parts(t, threshold, groups), "a long, b long")


def exact_sets(texts: list[str], k: int) -> list[np.ndarray] | list[set[str]]:
    """The set of shingles of each text: as sorted numbers of which each stands for one shingle, or as strings where 63 bits don't hold the letters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[points] = 1
    letters = np.flatnonzero(number)
    bits = len(letters).bit_length()
    if bits * k > 63:
        return [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in texts]
    number[letters] = np.arange(1, len(letters) + 1)
    points = number[points]
    keys = np.zeros(len(points), np.int64)
    for j in range(k):
        keys[: len(points) - j] |= points[j:] << bits * j
    found, at = [], 0
    for x in texts:
        one = keys[at : at + len(x) - k + 1] if len(x) >= k else (points[at : at + len(x)] << bits * np.arange(len(x))).sum(keepdims=True)
        found.append(distinct(np.sort(one)))
        at += len(x)
    return found


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted numbers, each once."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return distinct(np.sort(np.concatenate([x, y])))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets of shingles reach the threshold."""
    left, right = texts.select(F.col("at").alias("a"), F.col("skeleton").alias("x")), texts.select(F.col("at").alias("b"), F.col("skeleton").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = np.stack([batch.column(j).to_numpy() for j in (0, 1)], 1), [batch.column(j) for j in (2, 3)]
            score = np.zeros(batch.num_rows)
            at = 0
            while at < len(score):
                found, size, upto = {}, 0, at  # the distinct texts of some rows
                while upto < len(score) and (upto == at or size < SLAB_BYTES):
                    for name, text in zip(names[upto].tolist(), texts, strict=True):
                        if name not in found:
                            found[name] = text[upto].as_py()
                            size += len(found[name])
                    upto += 1
                held = dict(zip(found, exact_sets(list(found.values()), k), strict=True))
                for row in range(at, upto):
                    x, y = (held[name] for name in names[row].tolist())
                    shared = len(x & y) if isinstance(x, set) else len(x) + len(y) - len(merged(x, y))
                    score[row] = shared / (len(x) + len(y) - shared)
                at = upto
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["a", "b", "jaccard"])
            yield kept.filter(pa.array(score >= threshold))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, jaccard double")


def near(texts: DataFrame, threshold: float, k: int, groups: int | None = None) -> DataFrame:
    """(a, b, jaccard), stored: every two of the stored texts (at, skeleton) whose sets of shingles reach the threshold, a < b by `at`.

    By columns of parts; with a number of groups, by columns of single shingles.
    """
    spark = texts.sparkSession
    runtime.ship(spark)
    if groups is None:
        met = candidates(texts, threshold, k)
    else:
        known = spark.sparkContext.broadcast(frequent(texts, k))
        met = postings(texts, threshold, k, groups, known).groupBy("block").applyInArrow(lambda t: meet(t, threshold, groups), "a long, b long")
    pairs = runtime.stored(met.distinct(), "candidates")
    runtime.release(spark)
    parts, found = max(1, math.ceil(pairs.count() / PART)), None
    with runtime.arrow_rows(spark, PAIR_ROWS):
        for part in range(parts):  # all of them: a part only bounds what is on disk at once
            some = pairs.filter(F.expr(f"pmod(xxhash64(a, b), {parts}) = {part}"))
            one = runtime.stored(verified(some, texts, threshold, k), "verified")
            found = one if found is None else found.unionByName(one)
            runtime.release(spark)
    runtime.drop(pairs)
    return found
