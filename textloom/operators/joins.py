"""Joins of versioned corpora: diffs, alignment, ranges, context windows, families and link suggestions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from textloom import runtime
from textloom.functions import normalize, text as scalar
from textloom.operators import passages, signatures


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, old, new) by a full outer join: added, removed, changed or unchanged."""
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"), "old", "new")


def changed_ranges(old: Column, new: Column) -> Column:
    """array<struct<start, end>>: the character ranges of the new text that differ from the old one; empty ranges where text is gone."""
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if y is None:
                return []
            if x is None:
                return [{"start": 0, "end": len(y)}]
            return [{"start": j, "end": k} for tag, _, _, j, k in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if tag != "equal"]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(old, new)


def difference_class(old: Column, new: Column) -> Column:
    """same, edition_difference where one side lacks the text, normalization_only where white space alone differs, else unknown_difference."""
    one_sided = old.isNull() != new.isNull()
    return F.when(old.eqNullSafe(new), "same").when(one_sided, "edition_difference").when(scalar.whitespace_equal(old, new), "normalization_only").otherwise("unknown_difference")


def diff_ranges(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, classification, ranges) of what is not the same; ranges are counted in the new text. Only changed texts reach Python."""
    rows = diff(old, new, keys, value).filter("change <> 'unchanged'")
    both = F.col("change") == "changed"
    found = changed_ranges(F.when(both, F.col("old")), F.when(both, F.col("new")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("new").alias("end")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    ranges = F.when(F.col("change") == "added", whole).when(both, found).otherwise(nothing)
    return rows.select(*keys, "change", difference_class(F.col("old"), F.col("new")).alias("classification"), ranges.alias("ranges"))


def compare_corpora(reference: DataFrame, candidate: DataFrame, keys: list[str], value: str, same_scheme: bool) -> DataFrame:
    """(rule, severity, location, message): QV-015, a corpus against a reference; corpora of different numbering are not compared and say so."""
    if not same_scheme:
        return reference.sparkSession.createDataFrame([("QV-015", "info", "edition", "numbering differs: not compared")], "rule string, severity string, location string, message string")
    place = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    rows = diff(reference, candidate, keys, value).filter("change <> 'unchanged'")
    kind = difference_class(F.col("old"), F.col("new"))
    severity = F.when(kind == "normalization_only", "info").when(kind == "unknown_difference", "warning").otherwise("error")
    return rows.select(F.lit("QV-015").alias("rule"), severity.alias("severity"), place.alias("location"), F.concat_ws(" ", "change", kind).alias("message"))


def compare_fields(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, verdict, n): identical, compatible (equal but for marks and case), conflicting or only in one."""
    a = left.select(*keys, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a"))
    b = right.select(*keys, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b"))
    joined = a.join(b, keys, "full")

    def verdict(f: str) -> Column:
        x, y = F.col(f"a_{f}"), F.col(f"b_{f}")
        bare = lambda v: F.regexp_replace(F.lower(v), r"[\x{064B}-\x{0652}\x{0670}]", "")
        both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
        return F.when(~both, "only_in_one").when(x.eqNullSafe(y), "identical").when(bare(x).eqNullSafe(bare(y)), "compatible").otherwise("conflicting")

    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), verdict(f).alias("verdict")) for f in fields)))
    return joined.select(pairs.alias("p")).groupBy("p.field", "p.verdict").agg(F.count(F.lit(1)).alias("n"))


def align(source: DataFrame, canonical: DataFrame, keys: list[str], surface: str) -> DataFrame:
    """(keys, surface, status): matched on position and surface, mapped on position alone, else unmatched."""
    return align_places(source, canonical, keys, surface).drop("canonical")


def align_places(source: DataFrame, canonical: DataFrame, keys: list[str], surface: str) -> DataFrame:
    """(keys, surface, canonical, status) of each place of the source."""
    other = canonical.select(*keys, F.col(surface).alias("canonical"))
    joined = source.select(*keys, surface).join(other, keys, "left")
    status = F.when(F.col("canonical").isNull(), "unmatched").when(F.col(surface) == F.col("canonical"), "matched").otherwise("mapped")
    return joined.select(*keys, surface, "canonical", status.alias("status"))


def align_map(source: DataFrame, canonical: DataFrame, keys: list[str], surface: str) -> DataFrame:
    """(keys, source_surface, canonical_surface, map_hash) of the aligned places whose surfaces differ; map_hash is FNV-1a of both."""
    rows = align_places(source, canonical, keys, surface).filter("status = 'mapped'")
    return rows.select(*keys, F.col(surface).alias("source_surface"), F.col("canonical").alias("canonical_surface"), scalar.fnv1a(F.concat_ws("\x1f", surface, "canonical")).alias("map_hash"))


def unmatched(source: DataFrame, canonical: DataFrame, keys: list[str], surface: str, group: str) -> DataFrame:
    """(group, n): places of the source that the canonical table lacks."""
    return align_places(source, canonical, keys, surface).filter("status = 'unmatched'").groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def lookup(facts: DataFrame, dimensions: dict[str, DataFrame], value: tuple[str, str] | None = None) -> DataFrame:
    """Facts with the columns of their dimensions by key, kept where a key has none; with `value` (dimension column, value) only facts that have it.

    Each dimension is joined on its key, its first column; small ones are broadcast by their size.
    """
    out = facts
    for key, table in dimensions.items():
        own = table.columns[0]
        out = out.join(table.withColumnRenamed(own, key), key, "left")
    return out if value is None else out.filter(F.col(value[0]) == value[1])


def aligned_views(units: DataFrame, views: dict[str, DataFrame], keys: list[str], text: str) -> DataFrame:
    """The units with one text column for each view (a translation, a gloss), null where a view lacks the unit."""
    out = units
    for name, table in views.items():
        out = out.join(table.select(*keys, F.col(text).alias(name)), keys, "left")
    return out


def misaligned(view: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a view that no unit has; null keys are equal."""
    known = units.select(*(F.col(c).alias(f"unit_{k}") for k, c in enumerate(keys)))
    return view.join(known, reduce(and_, (F.col(c).eqNullSafe(F.col(f"unit_{k}")) for k, c in enumerate(keys))), "left_anti")


def backfill(rows: DataFrame, builds: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the columns of their build; rows whose build is gone stay and get the defaults."""
    found = rows.join(builds.select(key, *defaults), key, "left")
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def in_ranges(points: DataFrame, ranges: DataFrame, group: str, point: str) -> DataFrame:
    """Points with the disjoint (first, last) range of their group that holds them; an as-of sweep rather than a theta join."""
    starts = ranges.select(group, F.col("first").alias(point), F.struct("first", "last", *[c for c in ranges.columns if c not in (group, "first", "last")]).alias("range"), F.lit(0).alias("kind"))
    extra = [c for c in points.columns if c not in (group, point)]
    asked = points.select(group, point, F.lit(None).cast(starts.schema["range"].dataType).alias("range"), F.lit(1).alias("kind"), *extra)
    merged = asked.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(point, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("range", F.last("range", ignorenulls=True).over(w)).filter("kind = 1").drop("kind")
    return found.filter(F.col("range.last") >= F.col(point)).select(group, point, *extra, "range.*")


def context(rows: DataFrame, focus: DataFrame, group: str, order: str, before: int, after: int) -> DataFrame:
    """(group, focus, order): the rows around each focus, within its group. Focus rows are exploded to the keys they need."""
    wanted = focus.select(group, F.col(order).alias("focus"), F.explode(F.sequence(F.col(order) - before, F.col(order) + after)).alias(order))
    return wanted.join(rows.select(group, order), [group, order])


def family_members(rows: DataFrame, key: str, item: str, kind: str) -> DataFrame:
    """(key, kind, item, representative): each item with the least item of its key and kind. Null keys, kinds and items are ignored.

    With family_classes it gives every pair of items that share a key and differ in kind: the members of linked classes.
    """
    held = rows.select(key, kind, item).dropna().distinct()
    least = held.groupBy(key, kind).agg(F.min(item).alias("representative"))
    return held.join(least, [key, kind]).select(key, kind, item, "representative")


def family_classes(rows: DataFrame, key: str, item: str, kind: str) -> DataFrame:
    """(key, low_kind, low, high_kind, high): the representatives of every two kinds that share a key; low_kind is the lesser kind."""
    least = rows.select(key, kind, item).dropna().groupBy(key, kind).agg(F.min(item).alias(item))
    a = least.select(key, F.col(kind).alias("low_kind"), F.col(item).alias("low"))
    b = least.select(key, F.col(kind).alias("high_kind"), F.col(item).alias("high"))
    return a.join(b, key).filter("low_kind < high_kind").select(key, "low_kind", "low", "high_kind", "high")


def multiset_dice(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, form: Column, threshold: float = 0.0) -> DataFrame:
    """(doc_id, item_id, shared, score): Dice overlap of token multisets, of pairs that share a token and reach the threshold.

    The items are the stated query set; their token counts go to every task in parts of at most ITEM_TOKENS tokens, and
    each part meets the texts where they are read, so nothing is shuffled and a token that all texts hold costs no rows.
    """
    runtime.ship(docs.sparkSession)
    asked = docs.select(F.col(doc_id).alias("d"), scalar.tokens(F.coalesce(form, F.lit(""))).alias("w"))
    kind = items.schema[item_id].dataType
    schema = StructType([asked.schema["d"], items.schema[item_id], *StructType.fromDDL("shared long, score double")])
    out = None
    for part in _item_parts(items.select(item_id, scalar.tokens(F.coalesce(form, F.lit(""))).alias("w"))):
        found = asked.mapInArrow(_dice(docs.sparkSession.sparkContext.broadcast(part), threshold, to_arrow_type(kind)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("d").alias(doc_id), F.col(item_id).cast(kind), "shared", "score")


#: Tokens of items that a task holds at once.
ITEM_TOKENS = 2_000_000


def _item_parts(items: DataFrame) -> Iterator[tuple]:
    """(ids, sizes, vocabulary, first posting of each token, items of the postings, their counts) of runs of items."""
    ids, words, size = [], [], 0
    for key, w in items.toLocalIterator():
        ids.append(key)
        words.append(w)
        size += len(w)
        if size >= ITEM_TOKENS:
            yield _postings(ids, words)
            ids, words, size = [], [], 0
    if ids:
        yield _postings(ids, words)


def _postings(ids: list, words: list[list[str]]) -> tuple:
    lengths = np.array([len(w) for w in words], np.int64)
    flat = pa.array([t for w in words for t in w], pa.string()).dictionary_encode()
    token, own = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(ids)), lengths)
    pair, count = np.unique(token * len(ids) + own, return_counts=True)
    token, item = pair // len(ids), pair % len(ids)
    first = np.searchsorted(token, np.arange(len(flat.dictionary) + 1))
    return ids, lengths, flat.dictionary, first, item, count


def _dice(shared, threshold: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, vocabulary, first, item, count = shared.value
        named = pa.array(ids, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = some.column(1)
                n = np.diff(lists.offsets.to_numpy())
                known = pc.index_in(lists.flatten(), value_set=vocabulary)
                own = np.repeat(np.arange(len(n)), n)
                held = known.is_valid().to_numpy(zero_copy_only=False)
                token = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[held]
                pair, c = np.unique(own[held] * len(vocabulary) + token, return_counts=True)
                doc, token = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
                times = first[token + 1] - first[token]
                start = np.cumsum(times) - times
                place = np.arange(int(times.sum())) - np.repeat(start, times) + np.repeat(first[token], times)
                overlap = np.bincount(np.repeat(doc, times) * len(ids) + item[place], np.minimum(np.repeat(c, times), count[place]), len(n) * len(ids)).astype(np.int64)
                hit = np.flatnonzero(overlap)
                d, i, o = hit // len(ids), hit % len(ids), overlap[hit]
                score = 2 * o / (n[d] + lengths[i])
                good = score >= threshold
                columns = [some.column(0).take(pa.array(d[good])), named.take(pa.array(i[good])), pa.array(o[good]), pa.array(score[good])]
                yield pa.RecordBatch.from_arrays(columns, ["d", "i", "shared", "score"])

    return run


def passage_classes(rows: DataFrame, key: str, text: str, profile: str = "L6.skeleton") -> DataFrame:
    """(key, skeleton, representative): each passage with the least key of those with its skeleton; blank skeletons are left out."""
    forms = rows.select(key, normalize.profile(profile, F.col(text)).alias("skeleton")).filter("skeleton <> ''")
    least = forms.groupBy("skeleton").agg(F.min(key).alias("representative"))
    return forms.join(least, "skeleton").select(key, "skeleton", "representative")


def near_passages(rows: DataFrame, key: str, text: str, threshold: float, k: int = 5, slots: int = 32, profile: str = "L6.skeleton") -> DataFrame:
    """(low, high, jaccard): pairs of representatives of passage classes whose sets of k-character shingles reach the threshold,
    and of whose 64 min-hash slots `slots` are equal. passage_classes gives the members.

    Passages are told apart by SHA-256 of their skeletons. Pairs are found by packed prefixes (passages.near); only
    passages of such pairs are hashed for the slots.
    """
    form = rows.select(F.monotonically_increasing_id().alias("at"), F.col(key).alias("id"), normalize.profile(profile, F.col(text)).alias("skeleton")).filter("skeleton <> ''")
    forms = runtime.stored(form.withColumn("digest", F.unhex(F.sha2("skeleton", 256))), "forms")
    reps = forms.filter("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "at")).alias("r")).groupBy("r.id").agg(F.min("r.at").alias("at"))
    reps = runtime.stored(reps.select("id", "at"), "representatives")
    texts = runtime.stored(forms.select("at", "skeleton").join(reps, "at", "left_semi"), "passages")
    runtime.drop(forms)
    runtime.release(rows.sparkSession)
    found = passages.near(texts, threshold, k)
    if slots > 0:
        members = found.select(F.col("a").alias("at")).union(found.select("b")).distinct()
        signed = runtime.stored(signatures.least_hashes(texts.join(members, "at", "left_semi"), "at", "skeleton", k), "signatures")
        equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        found = found.join(signed.select(F.col("at").alias("a"), F.col("least").alias("sa")), "a").join(signed.select(F.col("at").alias("b"), F.col("least").alias("sb")), "b").filter(equal >= slots)
    named = found.join(reps.select(F.col("at").alias("a"), F.col("id").alias("x")), "a").join(reps.select(F.col("at").alias("b"), F.col("id").alias("y")), "b")
    return named.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), "jaccard")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose key has no parent."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def symmetric(pairs: DataFrame, low: str, high: str, node: object) -> DataFrame:
    """Pairs with the node on either side, the other side as `other`."""
    return pairs.filter(F.col(low) == node).select(F.col(high).alias("other")).union(pairs.filter((F.col(high) == node) & (F.col(low) != node)).select(F.col(low).alias("other")))
