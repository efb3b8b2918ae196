"""Forms, projections and domain searches of a versioned corpus."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textloom.functions import normalize, text as scalar

FORMS = {"simple": "L2.marks", "bare": "L3.diacritics", "hamza_folded": "L4.hamza", "folded": "L5.codepoints", "affix_stripped": "L7.affix"}
SOURCE_STATES = {"active": ("deactivated", "tombstoned"), "deactivated": ("active", "tombstoned"), "tombstoned": ()}


def with_forms(rows: DataFrame, text: str, names: tuple[str, ...] = tuple(FORMS)) -> DataFrame:
    """The rows with one column for each derived form."""
    return rows.withColumns({name: normalize.profile(FORMS[name], F.col(text)) for name in names})


def search_forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, form): the exact (L2) and the normalised (L5) search form of each text."""
    forms = F.array(*(F.struct(F.lit(kind).alias("kind"), normalize.profile(p, F.col(text)).alias("form")) for kind, p in (("exact", "L2.marks"), ("normalised", "L5.codepoints"))))
    return rows.select(key, F.explode(forms).alias("f")).select(key, "f.*")


def coverage(rows: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """(state, n): keys that have forms, lack them, or have forms alone."""
    a, b = rows.select(key, F.lit(1).alias("a")), forms.select(key, F.lit(1).alias("b")).distinct()
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").otherwise("covered")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def domain_search(texts: DataFrame, parents: DataFrame, parent_key: str, query: tuple[str, ...], key: str, text: str, limit: int = 20) -> DataFrame:
    """Phrase search over a domain's texts with the columns of their parents; filters come before the limit."""
    words = F.concat(F.lit(" "), F.array_join(scalar.tokens(F.lower(text)), " "), F.lit(" "))
    hits = texts.filter(F.contains(words, F.lit(f" {' '.join(query)} ")))
    return hits.join(parents, parent_key).select(key, *[c for c in parents.columns], scalar.snippet(F.col(text)).alias("snippet")).orderBy(key).limit(min(max(limit, 1), 1000))


def text_hash(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, hash): SHA-256 over the texts in order, each after its length in bytes as eight little-endian bytes.

    A hash over a sequence needs the sequence in one place: a group is an edition or a chapter, which fits a task.
    """
    size = lambda x: F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0")
    little = lambda x: F.concat(*(F.substring(size(x), 15 - 2 * k, 2) for k in range(8)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: F.concat(little(x["t"]), F.hex(F.encode(x["t"], "UTF-8"))))
    return rows.groupBy(group).agg(F.sha2(F.unhex(F.array_join(parts, "")), 256).alias("hash"))


def token_order_hash(tokens: DataFrame, group: str, order: list[str], surface: str) -> DataFrame:
    """(group, hash): SHA-256 over the surfaces of all tokens of a group in order, length-prefixed as in text_hash."""
    return text_hash(tokens.select(group, F.struct(*order).alias("place"), surface), group, "place", surface)


def structure_hash(rows: DataFrame, group: str, order: str, parts: list[str]) -> DataFrame:
    """(group, hash): SHA-256 of the canonical string of a group's structure, `order:part:...` joined by bars."""
    one = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (order, *parts)))
    listed = F.array_sort(F.collect_list(F.struct(order, one.alias("s"))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["s"]), "|"), 256).alias("hash"))


def unified_tags(analyses: DataFrame, tagset: DataFrame, native: str, default: str = "Unmapped") -> DataFrame:
    """The analyses with `unified`, by the (native, unified) tagset; unknown tags are Unmapped."""
    known = tagset.select(F.col("native").alias(native), F.col("unified"))
    return analyses.join(known, native, "left").withColumn("unified", F.coalesce("unified", F.lit(default)))


def global_index(rows: DataFrame, order: list[str], name: str = "global_index") -> DataFrame:
    """The rows with their place from 1 in a total order: ranks within ranges of the order, after the counts of the ranges before."""
    spark = rows.sparkSession
    from textloom import runtime
    from pyspark.sql.window import Window

    dealt = runtime.stored(rows.repartitionByRange(runtime.shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    # one row for each range
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn(name, own.cast("long")).join(F.broadcast(before), "part").withColumn(name, F.col(name) + F.col("base")).drop("part", "base")


def local_hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic unit vector: blocks of eight values from SHA-256 of the text and the block's number."""

    def run(texts: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            values = []
            for block in range(-(-dimensions // 8)):
                values += [b / 127.5 - 1 for b in hashlib.sha256(x.encode() + struct.pack("<Q", block)).digest()[:8]]
            values = values[:dimensions]
            norm = sum(v * v for v in values) ** 0.5
            return [v / norm if norm else 0.0 for v in values]

        return texts.map(one)

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def structural_projection(rows: DataFrame, edition: str, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an edition: it contains groups, groups contain units; kinds and stable ids."""
    g = F.concat(F.lit(f"{edition}:"), F.col(group).cast("string"))
    u = F.concat(g, F.lit(":"), F.col(order).cast("string"))
    groups = rows.select(g.alias("node")).distinct()
    units = rows.select(u.alias("node"), g.alias("parent")).distinct()
    root = rows.sparkSession.createDataFrame([(edition, "edition")], "node string, kind string")
    nodes = root.unionByName(groups.withColumn("kind", F.lit("group"))).unionByName(units.select("node", F.lit("unit").alias("kind")))
    edges = groups.select(F.lit(edition).alias("src"), F.lit("CONTAINS").alias("edge"), F.col("node").alias("dst"))
    return nodes, edges.unionByName(units.select(F.col("parent").alias("src"), F.lit("CONTAINS").alias("edge"), F.col("node").alias("dst")))


def value_projection(analyses: DataFrame, token: str, value: str, edge: str, chain: str, order: list[str]) -> DataFrame:
    """(src, edge, dst): each token to its value, and each token to the next that shares it, in canonical order."""
    from pyspark.sql.window import Window

    has = analyses.select(F.col(token).alias("src"), F.lit(edge).alias("edge"), F.col(value).alias("dst")).distinct()
    w = Window.partitionBy(value).orderBy(*order)
    after = analyses.withColumn("dst", F.lead(token).over(w)).filter("dst IS NOT NULL").select(F.col(token).alias("src"), F.lit(chain).alias("edge"), "dst")
    return has.unionByName(after)


def set_status(sources: DataFrame, key: str, wanted: str, status: str) -> DataFrame:
    """The source table with a new status; the same one again is no change, and a tombstone stays."""
    if status not in SOURCE_STATES:
        raise ValueError(f"status is one of {sorted(SOURCE_STATES)}")
    allowed = [s for s, after in SOURCE_STATES.items() if status in after]
    return sources.withColumn("status", F.when((F.col(key) == wanted) & F.col("status").isin(allowed), status).otherwise(F.col("status")))


def refused_records(records: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """(collection, source_number, code): hadith records that are refused, with the first of six reasons.

    records: (collection, source_number, matn_text, gradings array<struct<scholar_name, grading_value, source_citation>>,
    refused), as readers.hadith_json gives them. Without a list of collections any that is not blank will do.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lacking = lambda name: F.exists(F.coalesce("gradings", F.expr("array()")), lambda g: F.trim(F.coalesce(g[name], F.lit(""))) == "")
    unknown = empty("collection") if collections is None else ~F.coalesce(F.col("collection").isin(collections), F.lit(False))
    checks = [
        ("missing_number", empty("source_number")),
        ("missing_text", empty("matn_text")),
        ("merged_grading", F.coalesce(F.col("refused"), F.lit(False))),
        ("grading_without_scholar", lacking("scholar_name")),
        ("grading_without_source", lacking("source_citation")),
        ("unknown_collection", unknown),
    ]
    code = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        code = F.when(bad, name).otherwise(code)
    return records.select("collection", "source_number", code.alias("code")).filter("code IS NOT NULL")


def bury(sources: DataFrame, documents: DataFrame, parts: dict[str, DataFrame], key: str, wanted: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(sources with the wanted one tombstoned, the parts without rows of its documents): embeddings and forms go with their source."""
    gone = documents.filter(F.col(key) == wanted)
    return set_status(sources, key, wanted, "tombstoned"), {name: rows.join(gone.select("doc_id"), "doc_id", "left_anti") for name, rows in parts.items()}


def rebuild_forms(table, rows: DataFrame, key: str, text: str, names: tuple[str, ...] = tuple(FORMS)) -> int:
    """Publish the derived forms of a corpus as a generation of a store.VersionedTable, unless the texts change meanwhile."""
    before = _digest(rows, key, text)
    staged = with_forms(rows.select(key, text), text, names).drop(text)

    def unchanged(_: DataFrame) -> DataFrame:
        same = before == _digest(rows, key, text)
        return rows.sparkSession.createDataFrame([] if same else [("MV-018", "fatal", "forms", "the texts changed during the build")], "rule string, severity string, location string, message string")

    return table.publish(staged, unchanged)


def _digest(rows: DataFrame, key: str, text: str) -> tuple:
    row = rows.select(F.xxhash64(key, text).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return row["n"], row["s"]


#: What a retrieval configuration may name.
PROVIDERS, ROUTERS = ("local-hash",), ("default", "hybrid", "lexical", "vector")


def check_config(provider: str, dimensions: int, router: str, root: str) -> None:
    """An error for a configuration that cannot be used."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    if router not in ROUTERS:
        raise ValueError(f"unknown router {router}")
    if not 1 <= dimensions <= 4096:
        raise ValueError("dimensions lie between 1 and 4096")
    if ".." in root.split("/"):
        raise ValueError("a root must not leave its folder")
