"""Search over a table of texts: scans, postings, boolean and phrase queries, bounded regex expansion, BM25, skeletons.

Tables are (id, text) DataFrames under any column names. Queries are normalised by the profile of the texts, verified
on the normalised text, and put in canonical order; counts are those of verified rows and paging follows them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import normalize, spans, text as scalar

MAX_LIMIT, MAX_PATTERN_BYTES, MAX_EXPANSION = 1000, 512, 128
MATCH_MODES = ("whole_token", "substring", "prefix")


def _is(value: str):
    return lambda x: x == value


def metadata_filter(filters: dict[str, object]) -> Column:
    """AND of column filters: a list is membership (empty: nothing), a (low, high) tuple an inclusive range with None open, else equality."""
    out = F.lit(True)
    for name, wanted in filters.items():
        column = F.col(name)
        if isinstance(wanted, list):
            out = out & (column.isin(wanted) if wanted else F.lit(False))
        elif isinstance(wanted, tuple):
            low, high = wanted
            out = out & (F.lit(True) if low is None else column >= low) & (F.lit(True) if high is None else column <= high) & column.isNotNull()
        else:
            out = out & (column == wanted)
    return out


def parse_range(value: str) -> tuple[int | None, int | None]:
    """'3-7', '3-', '-7' or '3' as a range."""
    match = re.fullmatch(r"(\d*)(-?)(\d*)", value.strip())
    if not match or not (match[1] or match[3]):
        raise ValueError(f"not a range: {value!r}")
    low = int(match[1]) if match[1] else None
    high = int(match[3]) if match[3] else (None if match[2] else low)
    if low is not None and high is not None and low > high:
        raise ValueError(f"not a range: {value!r}")
    return low, high


def match(text: Column, term: str, mode: str) -> Column:
    """Whether a normalised text matches a normalised term; a blank term matches nothing."""
    if mode not in MATCH_MODES:
        raise ValueError(f"mode is one of {MATCH_MODES}")
    if not term.strip():
        return F.lit(False)
    if mode == "whole_token":
        return F.array_contains(scalar.tokens(text), term)
    return F.contains(text, F.lit(term)) if mode == "substring" else F.startswith(text, F.lit(term))


def scan(docs: DataFrame, term: str, mode: str = "whole_token", profile: str | Sequence[str] = "L1.ws", text_col: str = "text") -> DataFrame:
    """The rows whose normalised text matches, with `start`, the character offset of the first match in it. A profile is registered or a list of rules."""
    rules = normalize.rules_of(profile)
    return located(docs.withColumn("form", normalize.pipeline(rules, F.col(text_col))), normalise_query(docs.sparkSession, term, profile), mode)


def located(rows: DataFrame, term: str, mode: str) -> DataFrame:
    """The rows whose `form` matches a normalised term, with `start`."""
    rows = rows.filter(match(F.col("form"), term, mode))
    if mode == "whole_token":
        start = F.instr(F.concat(F.lit(" "), F.array_join(scalar.tokens(F.col("form")), " "), F.lit(" ")), f" {term} ") - 1
    else:
        start = F.instr("form", term) - 1
    return rows.withColumn("start", start)


def normalise_query(spark: SparkSession, term: str, profile: str | Sequence[str]) -> str:
    """A query term under a profile or a list of rules; on the driver, as it is one string."""
    return spans.forward(tuple(normalize.rules_of(profile)), term)[0]


@dataclass(frozen=True)
class Found:
    """Hits of a scan, the profile they were found under, and warnings for whoever asked."""

    rows: DataFrame
    total: int
    profile: str
    warnings: tuple[str, ...] = ()


def search_exact(docs: DataFrame, term: str, profile: str = "L1.ws", mode: str = "whole_token", text_col: str = "text") -> Found:
    """Exact search under L0 or L1. Without a hit, a term with Persian letters gets the hint to search a folded profile."""
    if profile not in ("L0.exact", "L1.ws"):
        raise ValueError("exact search takes the profile L0.exact or L1.ws")
    rows = scan(docs, term, mode, profile, text_col)
    total = rows.count()
    hint = ("no exact hit; the term has Persian letters, which L5.codepoints folds",) if not total and persian_letters(term) else ()
    return Found(rows, total, profile, hint)


def search_normalised(docs: DataFrame, term: str, profile: str | Sequence[str], mode: str = "whole_token", text_col: str = "text") -> Found:
    """Search under a registered profile or ad-hoc rules; experimental profiles say so."""
    label = profile if isinstance(profile, str) else normalize.adhoc_label(list(profile))
    rows = scan(docs, term, mode, profile, text_col)
    return Found(rows, rows.count(), label, ("the profile is experimental",) if label in ("L7.affix", "L8.fuzzy") else ())


def persian_letters(term: str) -> bool:
    """Whether folding Persian letters changes a term."""
    return spans.forward(("N10",), term)[0] != term


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """(id, pos, token) of every token; positions from 0."""
    text = F.lower(text_col) if lower else F.col(text_col)
    return docs.select(id_col, F.posexplode(scalar.tokens(text)).alias("pos", "token"))


@dataclass(frozen=True)
class Term:
    token: str


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class Bool:
    must: tuple = field(default=())
    should: tuple = field(default=())
    must_not: tuple = field(default=())


@dataclass(frozen=True)
class All:
    """Every document."""


@dataclass(frozen=True)
class Range:
    """Documents whose metadata column lies between two ends, open where None. Only a whole query, never part of one."""

    column: str
    low: int | None = None
    high: int | None = None

    def condition(self) -> Column:
        return metadata_filter({self.column: (self.low, self.high)})


def satisfiable(query) -> bool:
    if isinstance(query, All):
        return True
    if isinstance(query, Range):
        raise ValueError("a range is a query of its own and no part of a boolean one")
    if isinstance(query, Term):
        return bool(query.token.strip())
    if isinstance(query, Phrase):
        return bool(query.tokens) and all(x.strip() for x in query.tokens)
    if not query.must and not query.should:
        raise ValueError("must_not alone is no query")
    return all(map(satisfiable, query.must)) and (bool(query.must) or any(map(satisfiable, query.should)))


def predicate(query, words: Column) -> Column:
    """A query as a condition on a token array; a range, as a whole query, on its column."""
    if isinstance(query, Range):
        return query.condition()
    if not satisfiable(query):
        return F.lit(False)
    if isinstance(query, All):
        return F.lit(True)
    if isinstance(query, Term):
        return F.array_contains(words, query.token)
    if isinstance(query, Phrase):
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(joined, F.lit(f" {' '.join(query.tokens)} "))
    out = F.lit(True)
    for one in query.must:
        out = out & predicate(one, words)
    live = [x for x in query.should if satisfiable(x)]
    if live and not query.must:
        some = predicate(live[0], words)
        for one in live[1:]:
            some = some | predicate(one, words)
        out = out & some
    for one in query.must_not:
        if satisfiable(one):
            out = out & ~predicate(one, words)
    return out


def near(docs: DataFrame, terms: Sequence[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start) of ordered near matches: each next term is the nearest one after the last, at most slop tokens between.

    The choice is greedy: no other occurrence of an earlier term is tried for the same start.
    """
    words = scalar.tokens(F.lower(text_col))
    hits = docs.select(id_col, words.alias("w")).filter(F.arrays_overlap("w", F.array(F.lit(terms[0])))).select(id_col, "w", F.posexplode("w").alias("start", "token")).filter(F.col("token") == terms[0])
    at = F.col("start")
    for one in terms[1:]:
        ahead = F.slice(F.col("w"), at + 2, slop + 1)
        step = F.array_position(ahead, one)
        at = F.when(step > 0, at + step.cast("int"))
    return hits.withColumn("end", at).filter("end IS NOT NULL").select(id_col, "start")


def unordered_near(docs: DataFrame, terms: Sequence[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start) of windows of len(terms) + slop tokens, beginning at a term, that hold all terms with their multiplicity."""
    words = scalar.tokens(F.lower(text_col))
    rows = docs.select(id_col, words.alias("w")).filter(F.size(F.array_intersect("w", F.array(*map(F.lit, sorted(set(terms)))))) == len(set(terms)))
    # a text's words are read in its own row: exploded rows that carry them take their square
    places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(list(set(terms))), i)), lambda i: i.isNotNull())

    def held(i: Column) -> Column:
        window = F.slice(F.col("w"), i + 1, len(terms) + slop)
        return reduce(and_, (F.size(F.filter(window, _is(one))) >= list(terms).count(one) for one in sorted(set(terms))))

    return rows.select(id_col, F.explode(F.filter(places, held)).alias("start"))


def validate_pattern(pattern: str) -> re.Pattern[str]:
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError(f"patterns have at most {MAX_PATTERN_BYTES} bytes")
    if pattern.startswith((".*", ".+")):
        raise ValueError("a pattern must not begin with .* or .+")
    return re.compile(pattern)


def expand_regex(posted: DataFrame, pattern: str) -> DataFrame:
    """The terms of the vocabulary that a pattern matches; an error beyond MAX_EXPANSION of them."""
    validate_pattern(pattern)
    terms = posted.select("token").distinct().filter(F.col("token").rlike(pattern))
    if terms.limit(MAX_EXPANSION + 1).count() > MAX_EXPANSION:
        raise ValueError(f"the pattern expands to more than {MAX_EXPANSION} terms")
    return terms


def regex_search(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_hits): documents with a token that the pattern matches."""
    posted = postings(docs, id_col, text_col)
    terms = F.broadcast(expand_regex(posted, pattern))  # at most MAX_EXPANSION rows
    return posted.join(terms, "token", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("n_hits"))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): higher is better. Term counts come from the token arrays, so texts are not exploded or shuffled."""
    words = scalar.tokens(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    terms = list(dict.fromkeys(terms))
    tf = [F.size(F.filter("w", _is(t))).alias(f"tf_{k}") for k, t in enumerate(terms)]
    counted = docs.select(id_col, words.alias("w")).select(id_col, F.size("w").alias("dl"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf_{k}") > 0).cast("long")).alias(f"df_{k}") for k in range(len(terms))))
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
        score = score + idf * F.col(f"tf_{k}") * (k1 + 1) / (F.col(f"tf_{k}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = F.lit(False)
    for k in range(len(terms)):
        hit = hit | (F.col(f"tf_{k}") > 0)
    # the statistics are one row
    return counted.filter(hit).join(F.broadcast(stats)).select(id_col, score.alias("score"))


def page(rows: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), MAX_LIMIT))


def skeletons(turns: DataFrame, group_col: str, order_col: str, text_col: str, profile: str = "L6.skeleton") -> DataFrame:
    """(group, first, last, skeleton): one for each row and one for every three rows in sequence, joined before normalising."""
    order = Window.partitionBy(group_col).orderBy(order_col)
    rows = turns.select(group_col, order_col, text_col, F.lead(text_col, 1).over(order).alias("t1"), F.lead(text_col, 2).over(order).alias("t2"), F.lead(order_col, 2).over(order).alias("o2"))
    single = rows.select(group_col, F.col(order_col).alias("first"), F.col(order_col).alias("last"), F.col(text_col).alias("raw"))
    triple = rows.filter("o2 IS NOT NULL").select(group_col, F.col(order_col).alias("first"), F.col("o2").alias("last"), F.concat_ws(" ", text_col, "t1", "t2").alias("raw"))
    return single.unionByName(triple).select(group_col, "first", "last", normalize.profile(profile, F.col("raw")).alias("skeleton"))


def concatenated(skeleton_rows: DataFrame, query: str, group_col: str, profile: str = "L6.skeleton") -> DataFrame:
    """Spaceless search: rows whose skeleton holds the query's; a row's own hit hides those of windows over it."""
    wanted = normalise_query(skeleton_rows.sparkSession, query, profile)
    hits = skeleton_rows.filter(F.contains("skeleton", F.lit(wanted)) if wanted else F.lit(False)).withColumn("start", F.instr("skeleton", wanted) - 1).withColumn("spans", F.col("first") != F.col("last"))
    own = hits.filter("NOT spans").select(group_col, F.col("first").alias("hit"))
    covered = hits.filter("spans").join(own, (hits[group_col] == own[group_col]) & own["hit"].between(F.col("first"), F.col("last")), "left_anti")
    return hits.filter("NOT spans").unionByName(covered.select(hits.columns)).select(group_col, "first", "last", "start", "spans")


def segments(hits: DataFrame, key: list[str], query: str, text_col: str = "text", profile: str = "L6.skeleton") -> DataFrame:
    """(key, token, query_part): the tokens that a match covers and the part of the query that each of them holds.

    hits: (key, start, text) of rows whose skeleton holds the normalised query at `start`.
    """
    size = len(query)
    rows = hits.select(*key, "start", F.posexplode(scalar.tokens(F.col(text_col))).alias("token", "word"))
    rows = rows.select(*key, "start", "token", F.length(normalize.profile(profile, F.col("word"))).alias("size"))
    before = Window.partitionBy(*key).orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    low, high = F.greatest(F.col("at") - F.col("start"), F.lit(0)), F.least(F.col("at") + F.col("size") - F.col("start"), F.lit(size))
    part = F.substr(F.lit(query), (low + 1).cast("int"), (high - low).cast("int"))
    return rows.filter(high > low).select(*key, "token", part.alias("query_part"))


class RateLimiter:
    """At most `limit` calls of a principal in any `seconds`; the caller gives the time, so it can be tested and replayed."""

    def __init__(self, limit: int = 10, seconds: float = 60.0) -> None:
        self.limit, self.seconds, self._calls = limit, seconds, {}

    def allow(self, principal: str, now: float) -> bool:
        recent = [t for t in self._calls.get(principal, ()) if now - t < self.seconds]
        self._calls[principal] = recent
        if len(recent) >= self.limit:
            return False
        recent.append(now)
        return True


def guarded_regex(index, pattern: str, principal: str, limiter: RateLimiter, now: float, allowed: Sequence[str] | None = None, most: int | None = MAX_EXPANSION) -> DataFrame:
    """A regex search over an index under a principal's rate limit and, where given, an allow-list of principals; `most` terms, or all for None."""
    if allowed is not None and principal not in allowed:
        raise PermissionError(f"{principal} may not search by pattern")
    if not limiter.allow(principal, now):
        raise RuntimeError(f"more than {limiter.limit} searches in {limiter.seconds:g} seconds")
    return index.regex(pattern, most)
