"""Exact n-gram Jaccard self-join and its components, as a blocked sparse matrix product.

Texts are rows and n-gram hashes columns of a sparse matrix. Rows with equal n-gram sets are one class from the start.
Each class posts the first entries of its row (the prefix), rarest columns first: a linked pair shares a column of both
prefixes. The columns are dealt in blocks, and three steps follow.

1. In every column the class with the smallest share of rare columns is the pivot, of equals the largest: among near
   copies the one with the fewest changes, whatever the column. Each class is compared with the pivots it meets most
   often. These stars tie groups of near copies together without their pairs.
2. The product: within the blocks, overlap counts are accumulated for the pairs of a column whose classes are not yet in
   one component. Pairs of unlike size are never formed. A pair is discarded if its count cannot reach the bound that
   its sizes set for the prefixes; in frequent columns, where counts are not accumulated, if what follows the column
   is too short for the overlap that the sizes need.
3. Pairs that are left are verified on their whole sets.

A pair that is skipped lies within one component, so no link between components is lost. Rarity is estimated from a
sample of texts; any order of columns gives the same result. Columns of many classes are split into chunks that meet
two by two, so none is bound to one task.

Texts without a word have an empty set and are linked with nothing; null is empty. Texts with fewer words than n have
their whole sequence as the only n-gram. Rows of one id are one node. A row with a null id is linked by its text and
gets the component of the others. An empty table gives no rows. Extra columns are kept by `keep` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import runtime
from textloom.llm import _text
from textloom.llm.components import components

#: One in so many texts is counted to find the frequent columns, and the counts from which a column is frequent.
SAMPLE, FREQUENT = 16, 5
#: The most frequent columns that are told to all tasks (16 bytes each); only speed depends on them.
MAX_FREQUENT = 1_000_000
#: Ids and classes that may be broadcast (16 bytes each), to find texts or to label rows; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Pivots that a class is compared with before the product.
PIVOTS = 3
#: Classes of a column that meet in one task.
CHUNK = 4096
FLUSH = 250_000
#: Rows that Python gets at once, texts and pairs of whole sets.
TEXT_ROWS, PAIR_ROWS = 2000, 200
#: n: size of the set; pos: place of the column in the prefix; freq: whether the column is frequent; n_freq: frequent columns of the prefix.
POSTING = np.dtype([("col", "<u8"), ("set", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("freq", "?"), ("n_freq", "<i4")])
#: Steps of the share of rare columns by which pivots are chosen.
STEPS = 16


def sets_of(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes text by text, first of each text and their total)."""
    starts, ends, first = _text.spans(~_text.SPACE[data], off)
    words = _text.span_hashes(_text.LOWER[data], starts, ends)
    at, h = _text.windows(words, first, n)
    own = _text.owners(first)[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = np.concatenate([h, np.array([_text.whole(words, first[k], first[k + 1]) for k in short.tolist()], np.uint64)])
        own = np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(off)))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set that does not depend on order; 0 for the empty set."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_text.mix(h * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)), out=total[1:])
    ids = _text.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    ids[np.diff(first) == 0] = 0
    return ids.view(np.int64)


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def rank(n, n_freq, percent: int):
    """The order of pivots: steps of the share of rare columns in the prefix, then larger sets first."""
    length = prefix_length(n, percent)
    return (STEPS * (length - n_freq) // length).astype(np.int64) << 32 | (1 << 31) - n.astype(np.int64)


def small(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows, broadcast if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_table(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in _text.slabs(batch.column(1)):
                h, first = sets_of(data, off, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), pa.array(np.diff(first), pa.int64()), pa.array(set_ids(h, first))], ["doc_id", "n_shingles", "set"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles long, set long")


def frequent_columns(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the columns that a sample of the texts holds most often; at most MAX_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, data, off in _text.slabs(batch.column(1)):
                h, first = sets_of(data, off, n)
                _, keep = np.unique(set_ids(h, first), return_index=True)
                wanted = np.zeros(len(off) - 1, bool)
                wanted[keep] = True
                found.append(h[wanted[_text.owners(first)]])
            if found:
                col, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(col.view(np.int64)), pa.array(count.astype(np.int64))], ["col", "c"])

    some = _rows(docs, id_col, text_col).filter(F.expr(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0"))
    counts = some.mapInArrow(run, "col long, c long").groupBy("col").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    rows = counts.orderBy(F.desc("c"), "col").limit(MAX_FREQUENT).toArrow()
    col, count = rows.column("col").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(col)
    return col[order], count[order]


def postings(docs: DataFrame, n: int, percent: int, blocks: int, frequent, id_col: str, text_col: str) -> DataFrame:
    """(block, payload): packed prefix entries, dealt by column; frequent columns are spread over the blocks by class."""
    least = next(k for k in range(1, 10_000) if 100 * k >= percent * (k + 1))  # smaller sets have no other partner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = frequent.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            got = np.concatenate(held)
            spread = got["col"] + np.where(got["freq"], got["set"].view(np.uint64) % np.uint64(16), np.uint64(0))
            block = (spread % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            got, block = got[order], block[order]
            keys, at = np.unique(block, return_index=True)
            raw, cuts = got.tobytes(), np.append(at, len(got)) * POSTING.itemsize
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())], ["block", "payload"])

        for batch in batches:
            for _, data, off in _text.slabs(batch.column(1)):
                h, first = sets_of(data, off, n)
                ids, count = set_ids(h, first), np.diff(first)
                wanted = np.zeros(len(ids), bool)
                for k in np.flatnonzero(count >= least).tolist():
                    one = int(ids[k])
                    if one not in seen:
                        seen.add(one)
                        wanted[k] = True
                own = _text.owners(first)
                mine = wanted[own]
                h, own = h[mine], own[mine]
                if not len(h):
                    continue
                freq = np.zeros(len(h), np.int64)
                if len(columns):
                    at = np.minimum(np.searchsorted(columns, h), len(columns) - 1)
                    freq = np.where(columns[at] == h, counts[at], 0)
                order = np.lexsort((freq, own))  # stable: hash order among equals
                h, own, freq = h[order], own[order], freq[order]
                begin = np.searchsorted(own, own)
                pos = np.arange(len(h)) - begin
                front = pos < prefix_length(count[own], percent)
                out = np.zeros(int(front.sum()), POSTING)
                often = np.bincount(own[front], freq[front] > 0, minlength=len(ids))
                out["col"], out["set"], out["n"], out["pos"], out["freq"], out["n_freq"] = h[front], ids[own[front]], count[own[front]], pos[front], freq[front] > 0, often[own[front]]
                held.append(out)
                size += len(out)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _rows(docs, id_col, text_col).mapInArrow(run, "block int, payload binary")


def meet_pivots(table: pa.Table, percent: int) -> pa.Table:
    """The entries of a block's columns that hold two classes or more, with each column's pivot."""
    got = np.concatenate([np.frombuffer(x.as_py(), POSTING) for x in table.column("payload")])
    order = np.lexsort((_text.mix(got["set"].view(np.uint64)), rank(got["n"], got["n_freq"], percent), got["col"]))
    got = got[order]
    new = np.ones(len(got), bool)  # copies of a class stand together
    new[1:] = (got["col"][1:] != got["col"][:-1]) | (got["set"][1:] != got["set"][:-1])
    got = got[new]
    head = np.ones(len(got), bool)
    head[1:] = got["col"][1:] != got["col"][:-1]
    start = np.flatnonzero(head)
    column = np.cumsum(head) - 1
    # without a partner of like size an entry forms no pair; in a column of one block the next in size decides
    by_size = np.lexsort((got["n"], column))
    near = np.zeros(len(got), bool)
    a, b = by_size[:-1], by_size[1:]
    like = (column[a] == column[b]) & (100 * got["n"][a].astype(np.int64) >= percent * got["n"][b].astype(np.int64))
    near[a[like]] = near[b[like]] = True
    # a frequent column is spread over blocks: its entries are kept even where one class stands alone
    kept = near | got["freq"]
    pivot = got[start[column]][kept]
    got = got[kept]
    return pa.table({
        "col": pa.array(got["col"].view(np.int64)), "set": pa.array(got["set"]), "n": pa.array(got["n"]), "pos": pa.array(got["pos"]), "freq": pa.array(got["freq"]),
        "n_freq": pa.array(got["n_freq"]), "pivot": pa.array(pivot["set"]), "pivot_n": pa.array(pivot["n"]), "pivot_rank": pa.array(rank(pivot["n"], pivot["n_freq"], percent)),
    })


def multiply(table: pa.Table, percent: int) -> pa.Table:
    """Overlap counts of a block's pairs of classes from different components."""
    col, part = table.column("col").to_numpy(), table.column("part").to_numpy()
    order = np.lexsort((part, col))
    take = lambda name: table.column(name).to_numpy(zero_copy_only=False)[order]
    col, part, ids, root, n, pos, freq, side, crossed, rare = (take(x) for x in ("col", "part", "set", "root", "n", "pos", "freq", "side", "crossed", "n_freq"))
    head = np.ones(len(col), bool)
    head[1:] = (col[1:] != col[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(head)
    end = np.repeat(np.append(start[1:], len(col)), np.diff(np.append(start, len(col))))
    kinds = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4"), ("fa", "<i4"), ("fb", "<i4"), ("c", "<i8"), ("sure", "?")])
    held, size = [], 0

    def reduced() -> np.ndarray:
        got = np.concatenate(held)
        got = got[np.lexsort((got["b"], got["a"]))]
        first = np.ones(len(got), bool)
        first[1:] = (got["a"][1:] != got["a"][:-1]) | (got["b"][1:] != got["b"][:-1])
        at = np.flatnonzero(first)
        out = got[at]
        out["c"], out["sure"] = np.add.reduceat(got["c"], at), np.logical_or.reduceat(got["sure"], at)
        return out

    here = np.arange(len(col))
    step = 1
    while len(here):
        here = here[here + step < end[here]]
        if not len(here):
            break
        for some in np.array_split(here, max(1, len(here) >> 20)):
            x, y = some, some + step
            ok = (root[x] != root[y]) & (ids[x] != ids[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (~crossed[x] | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            rest = 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
            reach = rest >= needed(n[x].astype(np.int64), n[y].astype(np.int64), percent)
            ok = reach | ~freq[x]
            x, y, reach = x[ok], y[ok], reach[ok]
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            out = np.zeros(len(x), kinds)
            out["a"], out["b"], out["na"], out["nb"], out["fa"], out["fb"] = ids[x], ids[y], n[x], n[y], rare[x], rare[y]
            out["c"], out["sure"] = ~freq[x], freq[x]
            held.append(out)
            size += len(out)
            if size > 8 * FLUSH:
                held = [reduced()]
                size = len(held[0])
        step += 1
    got = reduced() if size else np.zeros(0, kinds)
    return pa.table({k: pa.array(np.ascontiguousarray(got[k])) for k in kinds.names})


def prefix_bound(a, b, percent: int):
    """The least overlap of the prefixes of linked sets: what all but the prefix of the larger set cannot hold."""
    return F.ceil(percent * (a + b) / (100 + percent)) - (F.ceil(percent * F.greatest(a, b) / 100) - 1)


def candidates(columns: DataFrame, roots: DataFrame, percent: int, blocks: int) -> DataFrame:
    """(a, b) of the pairs of different components that the bounds do not discard."""
    labelled = columns.join(small(roots).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    entries = runtime.stored(labelled.select("col", "set", "root", "n", "pos", "freq", "n_freq"), "entries")
    mixed = entries.groupBy("col").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("col", F.expr(f"cast(ceil(size / {CHUNK}) as int) AS chunks"))
    rows = entries.join(mixed, "col").withColumn("side", F.expr("cast(pmod(xxhash64(set), chunks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("part", F.least("side", "other") * F.col("chunks") + F.greatest("side", "other")).withColumn("crossed", F.col("side") != F.col("other"))
    # a chunk meets itself in the parts where side = other, and another chunk only across
    rows = rows.select("col", "part", "set", "root", "n", "pos", "freq", "side", F.expr("part % chunks <> cast(part / chunks as int) AS crossed"), "n_freq", F.expr(f"pmod(xxhash64(col, part), {blocks}) AS block"))
    schema = "a long, b long, na int, nb int, fa int, fb int, c long, sure boolean"
    counted = rows.groupBy("block").applyInArrow(lambda t: multiply(t, percent), schema)
    pairs = counted.groupBy("a", "b", "na", "nb", "fa", "fb").agg(F.sum("c").alias("c"), F.max("sure").alias("sure"))
    bound = prefix_bound(F.col("na"), F.col("nb"), percent)
    return pairs.filter(F.col("sure") | (F.col("c") + F.least("fa", "fb") >= bound)).select("a", "b")


def whole_sets(docs: DataFrame, table: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(set, grams): the packed sets of the wanted classes, from one row of each."""
    holders = wanted.join(table, "set").groupBy("set").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    holders = runtime.stored(holders, "holders")
    few = holders.count() <= MAX_BROADCAST
    holders = holders.withColumnRenamed("doc_id", "holder")  # null where only rows without an id hold a class
    rows = _rows(docs, id_col, text_col).join(F.broadcast(holders) if few else holders, F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in _text.slabs(batch.column(1)):
                h, first = sets_of(data, off, n)
                raw, cuts = h.tobytes(), (8 * first).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, first)), pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["set", "grams"])

    found = rows.mapInArrow(run, "set long, grams binary").join(small(wanted), "set", "left_semi")
    if not holders.filter("holder IS NULL").isEmpty():  # many rows without an id may hold one class
        found = found.dropDuplicates(["set"])
    return runtime.stored(found, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar enough."""
    left, right = sets.select(F.col("set").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("set").alias("b"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                kept[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    return both.mapInArrow(run, "a long, b long").distinct()


def star_pairs(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the PIVOTS pivots that it meets most often."""
    # frequent columns were spread over the blocks: the best of their pivots serves all; at most MAX_FREQUENT rows
    first = F.struct("pivot_rank", F.xxhash64("pivot").alias("mixed"), F.col("pivot").alias("top"), F.col("pivot_n").alias("top_n"))
    best = columns.filter("freq").groupBy("col").agg(F.min(first).alias("best")).select("col", "best.top", "best.top_n")
    spread = columns.filter("freq").select("col", "set", "n").join(F.broadcast(best), "col").select("set", "n", F.col("top").alias("pivot"), F.col("top_n").alias("pivot_n"))
    met = columns.filter("NOT freq").select(spread.columns).unionByName(spread).filter("set <> pivot")
    like = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    stars = met.filter(like).groupBy("set", "pivot", "n", "pivot_n").agg(F.count(F.lit(1)).alias("c"))
    # pairs that share little are left to the product
    stars = stars.filter(4 * F.col("c") >= prefix_bound(F.col("n"), F.col("pivot_n"), percent))
    order = Window.partitionBy("set").orderBy(F.desc("c"), "pivot")
    stars = stars.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PIVOTS)
    return stars.select(F.least("set", "pivot").alias("a"), F.greatest("set", "pivot").alias("b"))


def checked(docs: DataFrame, table: DataFrame, pairs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets are similar enough, stored."""
    wanted = runtime.stored(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "wanted")
    sets = whole_sets(docs, table, wanted, n, id_col, text_col)
    with runtime.arrow_rows(docs.sparkSession, PAIR_ROWS):
        found = runtime.stored(verified(pairs, sets, percent), "verified")
    runtime.drop(sets)
    runtime.release(docs.sparkSession)
    return found


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, set, component_id) of every row."""
    runtime.ship(docs.sparkSession)
    with runtime.arrow_rows(docs.sparkSession, TEXT_ROWS):
        return _join(docs, n, percent, id_col, text_col, blocks)


def _join(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, blocks: int | None) -> DataFrame:
    spark = docs.sparkSession
    blocks = blocks or runtime.shuffle_partitions(spark)
    table = runtime.stored(set_table(docs, n, id_col, text_col), "set-table")
    frequent = spark.sparkContext.broadcast(frequent_columns(docs, n, id_col, text_col))

    schema = "col long, set long, n int, pos int, freq boolean, n_freq int, pivot long, pivot_n int, pivot_rank long"
    columns = runtime.stored(postings(docs, n, percent, blocks, frequent, id_col, text_col).groupBy("block").applyInArrow(lambda t: meet_pivots(t, percent), schema), "columns")
    stars = star_pairs(columns, percent)
    stars = runtime.stored(stars.distinct(), "stars")
    runtime.release(spark)
    links = checked(docs, table, stars, n, percent, id_col, text_col)

    # rows of one id are one node
    shared = table.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("doc_id IS NOT NULL AND low <> high")
    same = table.filter("n_shingles > 0").join(shared, "doc_id").select(F.col("low").alias("a"), F.col("set").alias("b")).filter("a <> b").distinct()
    links = runtime.stored(links.unionByName(same), "first-links")

    rest = candidates(columns, components(links), percent, blocks).join(stars, ["a", "b"], "left_anti")
    rest = runtime.stored(rest, "candidates")
    runtime.drop(columns)
    runtime.release(spark)
    links = links.unionByName(checked(docs, table, rest, n, percent, id_col, text_col))
    roots = components(links)

    # a class of one row that is linked with nothing keeps its own id, so only the others are joined back to the rows
    classes = table.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("c"))
    known = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").filter("c > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "set"))
    known = runtime.stored(known.select("set", "root", "low"), "classes")
    low = known.groupBy("root").agg(F.min("low").alias("component"))
    found = runtime.stored(known.join(low, "root").select("set", "component"), "class-components")
    rows = table.join(small(found), "set", "left")
    return rows.select("doc_id", "n_shingles", "set", F.coalesce("component", "doc_id").alias("component_id"))


def keep(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns; all without a set and all with a null id.

    Of the rows that repeat an id the one with the least hash stays. Texts are not shuffled while the ids that go or repeat
    are at most MAX_BROADCAST.
    """
    found = runtime.stored(join(docs, n, percent, id_col, text_col).select(F.col("doc_id").alias(id_col), "component_id"), "components")
    known = found.filter(F.col(id_col).isNotNull())
    gone = known.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    again = known.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(id_col).join(gone, id_col, "left_anti")
    gone, again = runtime.stored(gone, "gone"), runtime.stored(again, "again")
    n_gone, n_again = gone.count(), again.count()
    kept = docs.join(F.broadcast(gone) if n_gone <= MAX_BROADCAST else gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if not n_again:
        return kept
    side = F.broadcast(again) if n_again <= MAX_BROADCAST else again
    rows = kept.join(side, id_col, "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    order = F.xxhash64(*(F.col("row").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    first = rows.groupBy(F.col("row").getField(id_col).alias("key")).agg(F.min_by("row", order).alias("row")).select("row.*")
    return kept.join(side, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(first)
