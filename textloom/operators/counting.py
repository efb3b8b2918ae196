"""Counting over token streams: frequency, distribution, hapax, co-occurrence, collocation, analysis modes, run lengths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as scalar

COUNTABLE_PROFILES = ("L2.marks", "L3.diacritics", "L4.hamza", "L5.codepoints", "L7.affix")
MODES = ("all_analyses", "one_vote_per_token", "single_source")


def token_stream(docs: DataFrame, keep: list[str], form: Column) -> DataFrame:
    """`keep` and (pos, token) of every token of a text form."""
    return docs.select(*keep, F.posexplode(scalar.tokens(form)).alias("pos", "token"))


def term_counts(docs: DataFrame, keep: list[str], form: Column, target: str) -> DataFrame:
    """`keep` and n, how often the target is a token; counted within the text, without exploding it."""
    if not target.strip():
        raise ValueError("the target is empty")
    return docs.select(*keep, F.size(F.filter(scalar.tokens(form), lambda x: x == target)).cast("long").alias("n"))


def frequency(docs: DataFrame, by: str, form: Column, target: str) -> DataFrame:
    """(by, n) for the values with a hit."""
    return term_counts(docs, [by], form, target).filter("n > 0").groupBy(by).agg(F.sum("n").alias("n"))


def report(docs: DataFrame, by: str, form: Column, target: str, rules: list[str]) -> DataFrame:
    """One row: (target, n, n_groups, checksum) with a checksum over target, rules and counts."""
    total = frequency(docs, by, form, target).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_groups"))
    parts = F.concat_ws("|", F.lit(target), F.lit(json.dumps(rules)), F.col("n").cast("string"), F.col("n_groups").cast("string"))
    return total.select(F.lit(target).alias("target"), "n", "n_groups", F.sha2(parts, 256).alias("checksum"))


def forms(stream: DataFrame) -> DataFrame:
    """(token, n) of every distinct token."""
    return stream.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hapax(stream: DataFrame) -> DataFrame:
    return forms(stream).filter("n = 1").select("token")


def first_last(docs: DataFrame, order: str, form: Column, target: str) -> DataFrame:
    """One row: first and last row with the target, hits, and the rows from the first to the last."""
    hits = term_counts(docs, [order], form, target).filter("n > 0").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("n").alias("n"))
    # the bounds are one row
    span = docs.select(order).join(F.broadcast(hits.select("first", "last")), F.col(order).between(F.col("first"), F.col("last"))).agg(F.countDistinct(order).alias("span_rows"))
    return hits.join(F.broadcast(span))


def missing(docs: DataFrame, form: Column, target: str) -> bool:
    """Whether no text has the target."""
    return docs.filter(F.array_contains(scalar.tokens(form), target)).isEmpty()


def cooccurrence(docs: DataFrame, form: Column, target: str, radius: int) -> DataFrame:
    """(token, n) of the other tokens within radius of each occurrence of the target in the same text, by array slices."""
    if radius < 1:
        raise ValueError("radius is at least 1")
    held = docs.select(scalar.tokens(form).alias("w")).filter(F.array_contains("w", target))
    at = F.filter(F.transform("w", lambda x, i: F.when(x == target, i)), lambda i: i.isNotNull())
    rows = held.select("w", F.explode(at).alias("at"))
    low = F.greatest(F.col("at") - radius, F.lit(0))
    rows = rows.select(F.explode(F.slice("w", low + 1, F.col("at") + radius + 1 - low)).alias("token")).filter(F.col("token") != target)
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def collocation(docs: DataFrame, form: Column, target: str, radius: int, min_count: int = 3) -> DataFrame:
    """(token, n, total, expected, pmi, t_score, llr): association of neighbours of the target with it."""
    counts = forms(token_stream(docs, [], form))
    total = counts.agg(F.sum("n").alias("total")).first()["total"] or 0
    return associated(cooccurrence(docs, form, target, radius), counts, F.lit(total), min_count)


def associated(neighbours: DataFrame, counts: DataFrame, total: Column, min_count: int = 3) -> DataFrame:
    """(token, n, total, expected, pmi, t_score, llr) of (token, n) neighbours, given the counts of all tokens and their total."""
    mass = neighbours.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mass"))
    # the mass is one row
    rows = neighbours.filter(F.col("n") >= min_count).join(counts.withColumnRenamed("n", "count"), "token").join(F.broadcast(mass)).withColumn("total", total)
    o, e = F.col("n").cast("double"), F.col("mass") / F.col("total") * F.col("count")
    rows = rows.withColumn("expected", e)
    o12, o21 = F.col("mass") - F.col("n"), F.col("count") - F.col("n")
    o22 = F.col("total") - F.col("mass") - F.col("count") + F.col("n")
    e12, e21 = F.col("mass") - F.col("expected"), F.col("count") - F.col("expected")
    e22 = F.col("total") - F.col("mass") - F.col("count") + F.col("expected")
    llr = 2 * (scalar.log_term(o, F.col("expected")) + scalar.log_term(o12, e12) + scalar.log_term(o21, e21) + scalar.log_term(o22, e22))
    return rows.select("token", "n", F.col("count").alias("total"), "expected", F.log2(o / F.col("expected")).alias("pmi"), ((o - F.col("expected")) / F.sqrt(o)).alias("t_score"), F.greatest(llr, F.lit(0.0)).alias("llr"))


def votes(analyses: DataFrame, token_key: list[str], value: str, mode: str) -> DataFrame:
    """(value, n): analyses of a token counted all, once for each token, or only where a token has exactly one."""
    if mode == "all_analyses":
        return analyses.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    if mode == "one_vote_per_token":
        return analyses.select(value, *token_key).distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    if mode == "single_source":
        single = analyses.groupBy(*token_key).agg(F.count(F.lit(1)).alias("c"), F.min(value).alias(value)).filter("c = 1")
        return single.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    raise ValueError(f"mode is one of {MODES}")


def run_lengths(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, value, first, last, n): maximal runs of an equal value in order."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    marked = rows.select(group, order, value, changed.cast("int").alias("changed"))
    numbered = marked.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(group, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def unusual_usage(target: str) -> tuple[str, str]:
    """(status, reason): there is no such analysis, and no number is made up for it."""
    return "unavailable", f"no analysis of unusual usage of {target!r} is defined"


def single_source(analyses: DataFrame, token_key: list[str], value: str) -> tuple[DataFrame, int]:
    """(votes of tokens with exactly one analysis, how many tokens have more and are left out)."""
    several = analyses.groupBy(*token_key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return votes(analyses, token_key, value, "single_source"), several.count()


def first_per_unit(tokens: DataFrame, unit: list[str], position: str, cap: int = 25) -> DataFrame:
    """The first token of each unit, in the order of units, at most cap: how a family is listed."""
    first = tokens.groupBy(*unit).agg(F.min(position).alias(position))
    return first.orderBy(*unit).limit(cap)
