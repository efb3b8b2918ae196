"""Benchmark decontamination by template windows.

A text becomes template tokens: numbers, units and names are replaced by typed placeholders (`slots`), other words are
lower-cased and stripped of punctuation at their ends. Windows of `width` template tokens are hashed and joined with
the windows of the benchmark items. Hits of one item on one diagonal (document position minus item position) form a
run; along a run the slots must be consistent: each value of the item stands for one value of the document wherever it
returns. Where they are not, only windows count whose values are the item's own, as where a plain word was changed. A
document that covers at least `coverage` of an item's template tokens so is contaminated, also where numbers, names or
units were exchanged. Texts are met in two readings: words that open a sentence are plain words in the first, and
names in the second unless they are common openers, so a sentence may begin with an exchanged name.

The join's build side is the benchmark in shards of at most `shard_windows` windows, so what a task holds is bounded
whatever the benchmark's size. Where there are several, a Bloom filter of all windows first finds the documents that hold
one, and the shards meet only these. Equal texts of items are met once. Items shorter than
`width` tokens are compared by one window of their own length; of fewer than `literal_below` tokens, a template says too
little, so they must occur word for word, values included.

Null and empty texts are clean, also those with a null id. Null items and items without a token are ignored. Repeated
rows are judged once each, whatever the number of shards. Of items that a text covers alike, the greatest id is named.
Empty tables give no rows or clean rows. Extra columns of any name are kept by `keep` and ignored elsewhere.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom import runtime
from textloom.llm import _text as text

NUMBER, UNIT, NAME, WORD = 1, 2, 3, 0
# Words that are units where they follow a number.
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons ounce
    ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days
    week weeks month months year years s min h hz khz mhz ghz w kw mw v a k c f celsius fahrenheit degree degrees
    percent dollar dollars cent cents euro euros usd eur gbp pa kpa bar n j kj cal kcal b kb mb gb tb""".split()
)
#: Words that are no names where they open a sentence.
OPENERS = frozenset(
    """a an the this that these those there here in on at by for from to of with as if when while where after before
    during since until once then thus so and but or nor not no yes because although though however he she it they we
    you his her its their our your my one two three some many all each every both any most few several another other
    what which who whom whose why how is are was were do does did can could will would should may must let has have
    had find given suppose calculate compute determine if now next first second last finally""".split()
)
ORDINALS = frozenset("st nd rd th".split())
_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'`.,;:!?()[]{}<>*_#|&~-")] = True
_DIGIT, _LOWERCASE, _UPPERCASE = (np.zeros(256, bool) for _ in range(3))
_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789.,")] = True
_DIGIT[48:58] = _LOWERCASE[97:123] = _UPPERCASE[65:91] = True
#: Stand-ins for the hashes of slots.
_SLOT = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x9FB21C651E98DF25], np.uint64)


def template(data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Template tokens of a slab: ((token hashes, kinds) of each reading, value hashes, first token of each text and their total).

    Tokens are runs of other than ASCII white space without ASCII punctuation at their ends; letters right after a
    number (5kg) are a token of their own. One with a digit and no letter, or an ordinal (12th), is a number; a unit word
    right after a number is a unit; a capitalised word with a small letter, not first in its sentence, is a name, and in
    the second reading also where it is first and no common opener. A sentence ends with . ! ? or a line's end. Latin-1
    capitals are folded like ASCII ones.
    """
    n = len(data)
    starts, ends, first = text.spans(~text.SPACE[data], off)
    if not len(starts):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int8))] * 2, np.zeros(0, np.uint64), first
    accent = np.zeros(n, bool)  # second bytes of U+00C0 to U+00FF but the two signs
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    big = accent & (data < 0xA0)
    upper, lower = _UPPERCASE[data] | big, _LOWERCASE[data] | (accent & ~big)
    folded = text.LOWER[data]
    folded[big] += 0x20

    here = np.arange(n)
    inner = ~_EDGE[data]
    following = np.minimum.accumulate(np.where(inner, here, n)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(inner, here, -1))
    begin, end = following[starts], preceding[ends - 1] + 1
    kept = begin < ends

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[np.maximum(end, begin)] - total[begin]

    begin = np.minimum(begin, n)
    letter = _UPPERCASE[data] | _LOWERCASE[data]
    glued = np.flatnonzero(kept & _DIGIT[data[np.minimum(begin, n - 1)]] & letter[end - 1])
    ordinal = np.zeros(len(starts), bool)
    if len(glued):  # digits with separators, then letters only
        cut = np.minimum.accumulate(np.where(letter, here, n)[::-1])[::-1][begin[glued]]
        digits, letters = (np.concatenate([[0], np.cumsum(m, dtype=np.int32)]) for m in (_NUMERIC[data], letter))
        ok = (digits[cut] - digits[begin[glued]] == cut - begin[glued]) & (letters[end[glued]] - letters[cut] == end[glued] - cut)
        glued, cut = glued[ok], cut[ok]
        nth = np.isin(text.span_hashes(folded, cut, end[glued]), _hashes(ORDINALS))
        ordinal[glued[nth]] = True
        glued, cut = glued[~nth], cut[~nth]
        times = np.ones(len(starts), np.int64)
        times[glued] = 2
        first = np.concatenate([[0], np.cumsum(times)])[first]
        left = np.cumsum(times)[glued] - 2
        starts, ends, begin, end, kept, ordinal = (np.repeat(x, times) for x in (starts, ends, begin, end, kept, ordinal))
        ends[left] = end[left] = starts[left + 1] = begin[left + 1] = cut
    else:
        left = glued
    number = kept & (ordinal | (count(_DIGIT[data]) > 0) & (count(upper | lower | (data >= 0x80)) == 0))
    value = text.span_hashes(folded, begin, np.maximum(end, begin))
    tail = data[ends - 1]
    closes = (tail == 0x2E) | (tail == 0x21) | (tail == 0x3F)
    inside = ends < n
    closes[inside] |= data[ends[inside]] == 0x0A
    closes[left] = False
    opens = np.ones(len(starts), bool)
    opens[1:] = closes[:-1]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    at = np.minimum(begin, n - 1)
    capital = _UPPERCASE[data[at]]
    two = at < n - 1
    capital[two] |= big[at[two] + 1] & (data[at[two]] == 0xC3)
    proper = kept & capital & (count(lower) > 0)
    names = proper & ~opens, proper & ~(opens & np.isin(value, _hashes(OPENERS)))
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1]
    unit[first[:-1][first[:-1] < len(starts)]] = False
    unit &= kept & np.isin(value, _hashes(UNITS))
    kinds = [np.select([number, unit, name], [NUMBER, UNIT, NAME], WORD).astype(np.int8)[kept] for name in names]
    value = value[kept]
    index = np.concatenate([[0], np.cumsum(kept)])
    return [(np.where(kind > 0, _SLOT[kind], value), kind) for kind in kinds], value, index[first]


_known_hashes: dict[frozenset[str], np.ndarray] = {}


def _hashes(words: frozenset[str]) -> np.ndarray:
    if words not in _known_hashes:
        data, off = text.joined(sorted(words))
        _known_hashes[words] = text.span_hashes(data, off[:-1], off[1:])
    return _known_hashes[words]


def read_item(item: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    readings, value, _ = template(*text.joined([item]))
    return readings, value


def consistent(kinds: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether each slot value of the item stands for one value of the document."""
    seen: dict[tuple[int, int], int] = {}
    slots = np.flatnonzero(kinds)
    return all(seen.setdefault((k, b), a) == a for k, a, b in zip(kinds[slots].tolist(), ours[slots].tolist(), theirs[slots].tolist(), strict=True))


class Matcher:
    """One shard of the benchmark, (item ids, (tokens, kinds) of each reading, values) each, ready to meet slabs of texts."""

    def __init__(self, items: list, width: int, coverage: float, literal_below: int) -> None:
        self.items, self.coverage, self.by_width = items, coverage, {}
        self.width = [min(width, len(x[2])) for x in items]
        self.literal = [len(x[2]) < literal_below for x in items]
        for reading, literal in ((0, False), (1, False), (2, True)):
            for own in sorted({w for w, x in zip(self.width, self.literal, strict=True) if x == literal}):
                keys, item, at = [], [], []
                for k, (_, readings, values) in enumerate(items):
                    if self.width[k] == own and self.literal[k] == literal:
                        where, found = text.windows(values if literal else readings[reading][0], np.array([0, len(values)]), own)
                        keys.append(found)
                        item.append(np.full(len(found), k))
                        at.append(where)
                key, item, at = np.concatenate(keys), np.concatenate(item), np.concatenate(at)
                order = np.argsort(key, kind="stable")
                self.by_width[reading, own] = key[order], item[order], at[order]

    def match(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[object, float, bool]]]:
        """text -> [(item, share of its tokens covered, whether slots differ)] for the contaminated texts of a slab."""
        readings, value, first = template(data, off)
        own = text.owners(first)
        hits: dict[tuple[int, int, int, int], list[int]] = {}
        for (reading, width), (key, item, at) in self.by_width.items():
            where, found = text.windows(value if reading == 2 else readings[reading][0], first, width)
            low = np.searchsorted(key, found, "left")
            hit = np.flatnonzero(key[np.minimum(low, len(key) - 1)] == found)
            high = np.searchsorted(key, found[hit], "right")
            for p, a, b in zip(where[hit].tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for q in range(a, b):
                    hits.setdefault((int(own[p]), int(item[q]), p - int(at[q]), reading), []).append(int(at[q]))
        covered: dict[tuple[int, int], set[int]] = {}
        changed: dict[tuple[int, int], bool] = {}
        for (doc, k, shift, reading), begins in hits.items():
            _, both, theirs = self.items[k]
            kinds = both[reading % 2][1]
            spread = np.add.outer(np.array(begins), np.arange(self.width[k]))
            places = np.unique(spread)
            if reading < 2 and not consistent(kinds[places], value[places + shift], theirs[places]):
                places = np.unique(spread[(value[spread + shift] == theirs[spread]).all(axis=1)])
            if len(places):
                ours = value[places + shift]
                covered.setdefault((doc, k), set()).update(places.tolist())
                differs = bool(((ours != theirs[places]) & (kinds[places] > 0)).any())
                changed[doc, k] = changed.get((doc, k), False) or differs
        out: dict[int, list[tuple[object, float, bool]]] = {}
        for (doc, k), places in covered.items():
            share = len(places) / len(self.items[k][2])
            if share >= self.coverage:
                out.setdefault(doc, []).extend((one, share, changed[doc, k]) for one in self.items[k][0])
        return out


class Sieve:
    """A Bloom filter of the windows of all items: BITS bits, of which each window sets two. It only saves work."""

    BITS = 1 << 27

    def __init__(self) -> None:
        self.bits = np.zeros(self.BITS >> 3, np.uint8)
        self.kinds: set[tuple[int, int]] = set()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys % np.uint64(self.BITS), (keys >> np.uint64(32)) % np.uint64(self.BITS)

    def add(self, matcher: Matcher) -> None:
        for kind, (keys, _, _) in matcher.by_width.items():
            self.kinds.add(kind)
            for at in self._places(keys):
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def held(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text of a slab may hold a window of an item."""
        readings, value, first = template(data, off)
        own, out = text.owners(first), np.zeros(len(off) - 1, bool)
        for reading, width in self.kinds:
            where, keys = text.windows(value if reading == 2 else readings[reading][0], first, width)
            hit = np.ones(len(keys), bool)
            for at in self._places(keys):
                hit &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            out[own[where[hit]]] = True
        return out


def sieved(docs: DataFrame, met: Iterator[list], columns: list[str], width: int, coverage: float, literal_below: int, text_col: str = "text") -> DataFrame:
    """A row for each document: its `columns` in the struct `row`, and whether it may hold a window of the items of any shard."""
    runtime.ship(docs.sparkSession)
    sieve = Sieve()
    for items in met:
        sieve.add(Matcher(items, width, coverage, literal_below))
    shared = docs.sparkSession.sparkContext.broadcast(sieve)  # BITS bits
    named = docs.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in text.slabs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(off) - 1), pa.array(shared.value.held(data, off))], ["row", "held"])

    return named.mapInArrow(run, StructType([named.schema["row"], *StructType.fromDDL("held boolean")]))


def shards(benchmark: DataFrame, shard_windows: int, item_col: str, text_col: str) -> Iterator[list]:
    """The items in shards of bounded size, streamed to the driver one partition at a time; equal texts are one item with many ids."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    held, size = [], 0
    for row in items.groupBy("t").agg(F.collect_set("i").alias("i")).toLocalIterator():
        one = read_item(row["t"])
        if len(one[1]):
            held.append((sorted(row["i"]) or [None], *one))
            size += len(one[1]) + len(row["i"])
        if size >= shard_windows:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: list, columns: list[str], width: int, coverage: float, literal_below: int, text_col: str = "text") -> DataFrame:
    """A row for each document: its `columns` in the struct `row`, and of the items of one shard the best covered, its coverage, whether slots differ, and their number."""
    runtime.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most shard_windows tokens
    named = docs.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, width, coverage, literal_below)
        for batch in batches:
            for row, data, off in text.slabs(batch.column(1)):
                found, n = matcher.match(data, off), len(off) - 1
                best = [max(found[k], key=lambda x: (x[1], str(x[0]))) if k in found else (None, 0.0, None) for k in range(n)]
                extra = [pa.array([x[i] for x in best], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *extra, pa.array([len(found.get(k, ())) for k in range(n)], pa.int32())], ["row", "item", "coverage", "changed", "items"])

    return named.mapInArrow(run, StructType([named.schema["row"], *StructType.fromDDL("item string, coverage double, changed boolean, items int")]))


def find(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, literal_below: int = 5, shard_windows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: (doc_id, contaminated, item_id, coverage, reparameterised, n_items); item_id is that of the best covered item."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = benchmark.schema[item_col].dataType
    held = list(itertools.islice(shards(benchmark, shard_windows, item_col, item_text_col), 2))
    if not held:
        return named.select("doc_id", F.lit(False).alias("contaminated"), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(None).cast("boolean").alias("reparameterised"), F.lit(0).alias("n_items"))
    if len(held) == 1:
        rows = matches(named, held[0], ["doc_id"], width, coverage, literal_below).select("row.doc_id", "item", "coverage", "changed", "items")
    else:  # a written key of each row, the same for all shards
        named = runtime.stored(named.withColumn("at", F.monotonically_increasing_id()), "decontaminate")
        some = sieved(named, shards(benchmark, shard_windows, item_col, item_text_col), ["at", "text"], width, coverage, literal_below)
        some = runtime.stored(some.filter("held").select("row.*"), "suspects")
        parts = [matches(some, items, ["at"], width, coverage, literal_below).filter("items > 0") for items in shards(benchmark, shard_windows, item_col, item_text_col)]
        found = parts[0]
        for other in parts[1:]:
            found = found.unionByName(other)
        best = F.struct("coverage", "item", "changed")
        found = found.groupBy("row.at").agg(F.max(best).alias("best"), F.sum("items").cast("int").alias("items")).select("at", "best.*", "items")
        rows = named.select("doc_id", "at").join(found, "at", "left").withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "items": F.coalesce("items", F.lit(0))})
    return rows.select("doc_id", (F.col("items") > 0).alias("contaminated"), F.col("item").cast(kind).alias("item_id"), "coverage", F.col("changed").alias("reparameterised"), F.col("items").alias("n_items"))


def keep(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, literal_below: int = 5, shard_windows: int = 1_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with their columns; of several shards each filters what the one before kept."""
    columns, met = list(docs.columns), lambda: shards(benchmark, shard_windows, item_col, item_text_col)
    clean = None
    if len(list(itertools.islice(met(), 2))) == 2:
        marked = sieved(docs, met(), columns, width, coverage, literal_below, text_col)
        clean = marked.filter("NOT held").select("row.*")
        docs = runtime.stored(marked.filter("held").select("row.*"), "suspects")
    for items in met():
        docs = matches(docs, items, columns, width, coverage, literal_below, text_col).filter("items = 0").select("row.*")
    return docs if clean is None else clean.unionByName(docs)
