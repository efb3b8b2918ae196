"""Consistency checks of a published corpus: each gives one row (check, status, detail); status is ok, warning or failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import normalize, text as scalar
from textloom.operators import graph

SCHEMA = "check string, status string, detail string"


def verdict(rows: DataFrame, check: str, bad: Column, detail: Column | str = "", worst: str = "failed") -> DataFrame:
    """One row from how many rows are bad."""
    counted = rows.agg(F.count_if(bad).alias("n"), F.count(F.lit(1)).alias("all"))
    say = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(f" {detail}" if isinstance(detail, str) and detail else ""))
    return counted.select(F.lit(check).alias("check"), F.when(F.col("n") == 0, "ok").otherwise(worst).alias("status"), say.alias("detail"))


def edition(units: DataFrame, group: str, order: str, text: str, declared: DataFrame) -> DataFrame:
    """surah_count, ayah_count, ayah_identifiers, unicode_form of a corpus of (group, order, text) against declared (group, n)."""
    counts = units.groupBy(group).agg(F.count(F.lit(1)).alias("have"), F.countDistinct(order).alias("d"), F.min(order).alias("low"), F.max(order).alias("high"))
    both = declared.select(group, F.col("n").alias("want")).join(counts, group, "full")
    dense = (F.col("d") == F.col("have")) & (F.col("high") - F.col("low") + 1 == F.col("have"))
    parts = [
        verdict(both, "surah_count", F.col("want").isNull() | F.col("have").isNull()),
        verdict(both, "ayah_count", ~F.col("want").eqNullSafe(F.col("have"))),
        verdict(counts, "ayah_identifiers", ~dense),
        verdict(units, "unicode_form", ~F.contains(F.concat(F.lit(","), scalar.unicode_forms(F.coalesce(F.col(text), F.lit(""))), F.lit(",")), F.lit(",NFC,"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def normalisation(rows: DataFrame, text: str) -> DataFrame:
    """profiles_loaded, and whether a second pass of each profile changes a text."""
    spark = rows.sparkSession
    known = spark.createDataFrame([("profiles_loaded", "ok" if normalize.REGISTRY.names() else "failed", ",".join(normalize.REGISTRY.names()))], SCHEMA)
    parts = [verdict(rows.select(normalize.profile(name, F.col(text)).alias("once")), f"idempotent {name}", normalize.profile(name, F.col("once")) != F.col("once")) for name in ("L1.ws", "L5.codepoints", "L6.skeleton")]
    return reduce(DataFrame.unionByName, [known, *parts])


def forms(units: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """forms.coverage and forms.orphans by key."""
    a, b = units.select(key, F.lit(1).alias("a")), stored.select(key, F.lit(1).alias("b")).distinct()
    both = a.join(b, key, "full")
    return verdict(both, "forms.coverage", F.col("b").isNull()).unionByName(verdict(both, "forms.orphans", F.col("a").isNull()))


def indexes(generations, problems: DataFrame) -> DataFrame:
    """index.pointer, index.orphans (builds that the pointer never named) and index.drift."""
    spark: SparkSession = generations.spark
    log, builds = generations.pointer.log(), generations.builds()
    current, known = (log[-1][1] if log else None), {g for _, g, _ in log}
    orphans = [g for g in builds if g not in known]
    rows = [("index.pointer", "ok" if current in builds else "failed", str(current)), ("index.orphans", "warning" if orphans else "ok", ",".join(map(str, orphans)))]
    return spark.createDataFrame(rows, SCHEMA).unionByName(verdict(problems, "index.drift", F.lit(True)))


def alignment(view: DataFrame, units: DataFrame, keys: list[str], attribution: str) -> DataFrame:
    """translations_aligned and translation_attribution."""
    lost = view.join(units.select(*keys).withColumn("here", F.lit(1)), keys, "left")
    blank = F.trim(F.coalesce(F.col(attribution), F.lit(""))) == ""
    return verdict(lost, "translations_aligned", F.col("here").isNull()).unionByName(verdict(view, "translation_attribution", blank, worst="warning"))


def graphs(nodes: DataFrame, edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """graph.dangling_edges, graph.vocabulary and graph.tombstones (nodes that should be gone)."""
    lost = graph.dangling(edges, nodes)
    buried = nodes.join(tombstones.select("node").withColumn("gone", F.lit(True)), "node", "left")
    parts = [verdict(lost, "graph.dangling_edges", F.lit(True)), verdict(edges, "graph.vocabulary", ~F.col("edge").isin(*graph.VOCABULARY)), verdict(buried, "graph.tombstones", F.coalesce(F.col("gone"), F.lit(False)))]
    return reduce(DataFrame.unionByName, parts)


def morphology(analyses: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """morphology.coverage (share of tokens with an analysis, as a count), morphology.alignment and unverified_layer_d."""
    have = analyses.select(*key).distinct().withColumn("a", F.lit(1))
    both = tokens.select(*key).withColumn("t", F.lit(1)).join(have, key, "full")
    suggested = (F.col("provenance_layer") == "D") & (F.coalesce("status", F.lit("")) != "human_verified")
    parts = [verdict(both, "morphology.coverage", F.col("a").isNull(), worst="warning"), verdict(both, "morphology.alignment", F.col("t").isNull()), verdict(analyses, "unverified_layer_d", suggested, worst="warning")]
    return reduce(DataFrame.unionByName, parts)
