"""A stored search index: forms, postings, vocabulary and statistics of a table, or the skeletons and trigrams of one.

An index is built as a generation below a folder, verified against its source by a sample, and published by a pointer;
readers see one generation. Postings are not shuffled: each task writes those of its texts, sorted by token, so a token
that every text holds is spread over as many files as texts are read in, and they are written below hash buckets of the
token, so a query reads the buckets of its tokens only and, within them, the row groups that hold them.

Texts are null-safe: a null text has no token. Documents that repeat an id are one document to set queries and so many
to counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import runtime
from textloom.functions import normalize, text as scalar
from textloom.operators import search
from textloom.operators.search import MAX_EXPANSION
from textloom.sources.store import Pointer

BUCKETS = 32
#: Ids that may be broadcast to fetch texts; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: All rows are verified below ALL of them, else one in EVERY.
ALL, EVERY = 2000, 16


def bucket(token: Column) -> Column:
    return (F.crc32(token) % BUCKETS).cast("int")


def buckets_of(tokens: Sequence[str]) -> list[int]:
    """The same on the driver, for the tokens of a query."""
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in tokens})


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids, broadcast where they are counted to be few."""
    ids = ids.select(key).distinct()
    few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


class Generations:
    """Builds of an index below one folder, each verified before the pointer moves to it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Pointer(spark, f"{folder.rstrip('/')}/pointer")
        self._open: dict[str, DataFrame] = {}

    def path(self, part: str, generation: int | None = None) -> str:
        generation = self.pointer.current() if generation is None else generation
        if generation is None:
            raise ValueError("nothing is published")
        return f"{self.folder}/generation={generation}/{part}"

    def read(self, part: str, generation: int | None = None) -> DataFrame:
        """A part of a generation, which never changes: its files are listed once."""
        path = self.path(part, generation)
        if path not in self._open:
            self._open[path] = self.spark.read.parquet(path)
        return self._open[path]

    def builds(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def next_generation(self) -> int:
        return max([0, *self.builds(), *(g for _, g, _ in self.pointer.log())]) + 1

    def rollback(self) -> int:
        """Point to the generation before the current one, once."""
        return self.pointer.rollback()

    def collect_garbage(self, keep: int = 2) -> list[int]:
        """Remove all builds but the newest `keep`, the current one and the one a rollback would reach; the removed ones."""
        log = self.pointer.log()
        held = {log[-1][1], log[-1][2]} if log else set()
        builds = self.builds()
        gone = [g for g in builds[: max(0, len(builds) - keep)] if g not in held]
        jvm = self.spark.sparkContext._jvm
        for g in gone:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation={g}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return gone


@dataclass
class TextIndex:
    """(id, meta, form, words) of every document, (token, id, pos, size, meta) of every token, (token, n, df), and totals."""

    generations: Generations
    key: str
    meta: tuple[str, ...]
    text: str

    @classmethod
    def at(cls, spark: SparkSession, folder: str, key: str = "doc_id", meta: Sequence[str] = (), text: str = "text") -> TextIndex:
        return cls(Generations(spark, folder), key, tuple(meta), text)

    def build(self, docs: DataFrame, publish: bool = True) -> int:
        """Stage a generation, verify it and point to it; a generation that fails is left unpublished."""
        g = self.generations
        generation = g.next_generation()
        words = scalar.tokens(F.lower(F.coalesce(F.col(self.text).cast("string"), F.lit(""))))
        forms = docs.select(self.key, *self.meta, normalize.profile("L1.ws", F.col(self.text).cast("string")).alias("form"), F.array_join(words, " ").alias("words"), F.size(words).alias("size"))
        forms.write.parquet(g.path("forms", generation))
        stored = g.read("forms", generation)
        posted = stored.filter("size > 0").select(self.key, *self.meta, "size", F.posexplode(F.split("words", " ")).alias("pos", "token")).withColumn("bucket", bucket(F.col("token")))
        # a row for each token takes many times its text, so the rows stay where they are read
        posted.sortWithinPartitions("bucket", "token", self.key, "pos").write.partitionBy("bucket").parquet(g.path("postings", generation))
        per_doc = g.read("postings", generation).groupBy("token", self.key).agg(F.count(F.lit(1)).alias("n"))
        vocabulary = per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
        vocabulary.write.parquet(g.path("vocabulary", generation))
        stored.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).coalesce(1).write.parquet(g.path("totals", generation))
        if publish:
            problems = self.verify(docs, generation).collect()
            if problems:
                raise ValueError(f"generation {generation} is not published: {problems[0].asDict()}")
            g.pointer.point(generation)
        return generation

    def verify(self, docs: DataFrame, generation: int | None = None) -> DataFrame:
        """(problem, id, token): documents that the totals do not count, and tokens of the sample that postings lack or have too many of."""
        g = self.generations
        totals, n = g.read("totals", generation).first(), docs.count()
        chosen = F.lit(True) if n < ALL else F.pmod(F.xxhash64(self.key), F.lit(EVERY)) == 0
        words = scalar.tokens(F.lower(F.coalesce(F.col(self.text).cast("string"), F.lit(""))))
        want = docs.filter(chosen).select(self.key, F.explode(words).alias("token")).groupBy(self.key, "token").agg(F.count(F.lit(1)).alias("want"))
        have = g.read("postings", generation).filter(chosen).groupBy(self.key, "token").agg(F.count(F.lit(1)).alias("have"))
        both = want.withColumnRenamed(self.key, "a").withColumnRenamed("token", "t").join(have, F.col("a").eqNullSafe(F.col(self.key)) & (F.col("t") == F.col("token")), "full")
        wrong = both.filter(~F.col("want").eqNullSafe(F.col("have")))
        wrong = wrong.select(F.when(F.col("have").isNull(), "lost").when(F.col("want").isNull(), "unknown").otherwise("count").alias("problem"), F.coalesce(F.col("a"), F.col(self.key)).cast("string").alias("id"), F.coalesce("t", "token").alias("token"))
        if totals["docs"] == n:
            return wrong
        return wrong.unionByName(g.spark.createDataFrame([("documents", None, f"{totals['docs']} of {n}")], "problem string, id string, token string"))

    # ---- reading

    def forms(self) -> DataFrame:
        return self.generations.read("forms")

    def vocabulary(self) -> DataFrame:
        return self.generations.read("vocabulary")

    def posted(self, tokens: Sequence[str]) -> DataFrame:
        """The postings of the given tokens, from their buckets only."""
        tokens = list(dict.fromkeys(tokens))
        return self.generations.read("postings").filter(F.col("bucket").isin(buckets_of(tokens)) & F.col("token").isin(tokens))

    def term(self, token: str) -> DataFrame:
        """Ids of the documents with the token; a blank token has none."""
        return self.posted([token]).select(self.key).distinct()

    def phrase(self, tokens: Sequence[str]) -> DataFrame:
        """Ids of the documents with the tokens one after another."""
        return self.phrase_starts(tokens).select(self.key).distinct()

    def phrase_starts(self, tokens: Sequence[str]) -> DataFrame:
        """(id, start) of every place where the tokens follow one another: places that all tokens agree on."""
        places = None
        for token in dict.fromkeys(tokens):
            at = [k for k, t in enumerate(tokens) if t == token]
            one = self.posted([token]).select(self.key, F.explode(F.array(*(F.col("pos") - k for k in at))).alias("start"), F.lit(len(at)).alias("c"))
            places = one if places is None else places.unionByName(one)
        if places is None:
            raise ValueError("a phrase has a token")
        found = places.groupBy(self.key, "start").agg(F.count(F.lit(1)).alias("c"))
        return found.filter(F.col("c") >= len(tokens)).select(self.key, "start")

    def ids(self, query) -> DataFrame:
        """Ids of the documents that a query of search.Term, Phrase, Bool or All matches."""
        spark = self.generations.spark
        if isinstance(query, search.Range):
            return self.forms().filter(query.condition()).select(self.key).distinct()
        if isinstance(query, search.All):
            return self.forms().select(self.key).distinct()
        if not search.satisfiable(query):
            return spark.createDataFrame([], self.forms().select(self.key).schema)
        if isinstance(query, search.Term):
            return self.term(query.token)
        if isinstance(query, search.Phrase):
            return self.phrase(query.tokens)
        out = None
        for one in query.must:
            found = self.ids(one)
            out = found if out is None else out.join(found, self.key, "left_semi")
        if out is None:
            live = [self.ids(x) for x in query.should if search.satisfiable(x)]
            out = live[0]
            for one in live[1:]:
                out = out.unionByName(one)
            out = out.distinct()
        for one in query.must_not:
            if search.satisfiable(one):
                out = out.join(self.ids(one), self.key, "left_anti")
        return out

    def count(self, query) -> int:
        """How many documents match, apart from any page of them."""
        return self.ids(query).count()

    def search(self, query, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int, bool]:
        """(page in the order of ids, all matches, whether matches follow the page)."""
        hits = self.ids(query)
        total = hits.count()
        limit, offset = min(max(limit, 1), search.MAX_LIMIT), max(0, offset)
        return search.page(hits, [F.col(self.key)], limit, offset), total, offset + limit < total

    def near(self, terms: Sequence[str], slop: int, ordered: bool = True) -> DataFrame:
        """(id, start) as search.near or search.unordered_near find them, by the places of the terms alone."""
        if ordered:
            return self._near_places(terms, slop)
        places = self.posted(terms).filter(F.col(self.key).isNotNull()).select(self.key, "token", "pos").distinct()
        ahead = Window.partitionBy(self.key).orderBy("pos").rangeBetween(0, len(terms) + slop - 1)
        wanted = sorted(set(terms))
        found = places.withColumns({f"c_{k}": F.count(F.when(F.col("token") == one, 1)).over(ahead) for k, one in enumerate(wanted)})
        for k, one in enumerate(wanted):
            found = found.filter(F.col(f"c_{k}") >= list(terms).count(one))
        return found.select(self.key, F.col("pos").alias("start")).distinct()

    def _near_places(self, terms: Sequence[str], slop: int) -> DataFrame:
        """Ordered near matches: from each place of the first term, each next term at its nearest place after the last, found in one pass back over the places of a document."""
        places = self.posted(terms).select(self.key, "token", "pos")
        rows = places.filter(F.col("token") == terms[0]).select(self.key, F.col("pos").alias("start"), F.col("pos").alias("at"))
        nothing = F.lit(None).cast("int")
        back = Window.partitionBy(self.key).orderBy(F.desc("at"), F.desc(F.col("start").isNotNull())).rowsBetween(Window.unboundedPreceding, -1)
        for term in terms[1:]:
            ahead = places.filter(F.col("token") == term).select(self.key, nothing.alias("start"), F.col("pos").alias("at"), F.col("pos").alias("next"))
            met = rows.select(self.key, "start", "at", nothing.alias("next")).unionByName(ahead).withColumn("next", F.last("next", ignorenulls=True).over(back))
            rows = met.filter("start IS NOT NULL").filter(F.col("next") - F.col("at") <= slop + 1).select(self.key, "start", F.col("next").alias("at"))
        return rows.select(self.key, "start")

    def expand(self, pattern: str, most: int = MAX_EXPANSION) -> list[str]:
        """The tokens that a pattern matches; an error beyond `most`."""
        search.validate_pattern(pattern)
        found = self.vocabulary().filter(F.col("token").rlike(pattern)).select("token").orderBy("token").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"the pattern expands to more than {most} terms")
        return [r["token"] for r in found]

    def regex(self, pattern: str, most: int | None = MAX_EXPANSION) -> DataFrame:
        """(id, n_hits) of the documents with tokens that a pattern matches; an error beyond `most` tokens, None for any number."""
        if most is None:  # the vocabulary tells the buckets, and the pattern is met where the postings are read
            search.validate_pattern(pattern)
            matched = F.col("token").rlike(pattern)
            buckets = [r["b"] for r in self.vocabulary().filter(matched).select(bucket(F.col("token")).alias("b")).distinct().collect()]  # at most BUCKETS
            found = self.generations.read("postings").filter(F.col("bucket").isin(buckets) & matched)
        else:
            found = self.posted(self.expand(pattern, most))
        return found.groupBy(self.key).agg(F.count(F.lit(1)).alias("n_hits"))

    def bm25(self, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score), higher is better; totals and document frequencies are stored."""
        terms = list(dict.fromkeys(terms))
        totals = self.generations.read("totals").first()
        mean = totals["tokens"] / totals["docs"] if totals["docs"] else 0.0
        tf = self.posted(terms).groupBy(self.key, "size", "token").agg(F.count(F.lit(1)).alias("tf"))
        known = F.broadcast(self.vocabulary().filter(F.col("token").isin(terms)).select("token", "df"))  # a row for each term
        idf = F.log(1 + (totals["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
        return tf.join(known, "token").groupBy(self.key).agg(F.sum(part).alias("score"))

    def phrase_ranked(self, text: str, active: DataFrame | None = None, limit: int | None = 20, fallback: bool = True) -> DataFrame:
        """(id, score) of the documents that hold a whole query as one phrase, best first; of the active ids only, where given. A limit of None is a page of all, in any order.

        A query of no token finds nothing. Where no document holds the phrase, those with all of its tokens are found instead, unranked, unless `fallback` is off.
        """
        tokens = [x for x in re.split(r"[\t-\r ]+", text.lower()) if x]
        if not tokens:
            return self.bm25([" "])
        hits = self.phrase(tokens)
        if fallback and hits.isEmpty():
            hits = self.ids(search.Bool(must=tuple(map(search.Term, dict.fromkeys(tokens))))).select(self.key, F.lit(0.0).alias("score"))
        else:
            hits = self.bm25(tokens).join(hits, self.key, "left_semi")
        if active is not None:
            hits = hits.join(active.select(self.key), self.key, "left_semi")
        if limit is None:
            return hits
        return hits.orderBy(F.desc("score"), self.key).limit(min(max(limit, 1), search.MAX_LIMIT))

    def scan(self, term: str, mode: str = "substring") -> DataFrame:
        """The rows of forms that match, with `start`, the first place in the form."""
        return search.located(self.forms(), search.normalise_query(self.generations.spark, term, "L1.ws"), mode)

    def frequency(self, token: str, by: str) -> DataFrame:
        """(by, n): how often the token occurs; `by` is one of the meta columns."""
        return self.posted([token]).groupBy(by).agg(F.count(F.lit(1)).alias("n"))

    def term_counts(self, token: str) -> DataFrame:
        """(id, n) of the documents with the token."""
        return self.posted([token]).groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))

    def hapax(self) -> DataFrame:
        """Tokens that occur once."""
        return self.vocabulary().filter("n = 1").select("token")

    def cooccurrence(self, token: str, radius: int) -> DataFrame:
        """(token, n) of the other tokens within radius of each occurrence in the same text."""
        from textloom.operators import counting

        return counting.cooccurrence(semi(self.forms().select(self.key, "words"), self.term(token), self.key), F.col("words"), token, radius)

    def collocation(self, token: str, radius: int, min_count: int = 3) -> DataFrame:
        """Association of neighbours with the token, as counting.collocation, with stored counts."""
        from textloom.operators import counting

        total = self.generations.read("totals").first()["tokens"]
        return counting.associated(self.cooccurrence(token, radius), self.vocabulary().select("token", "n"), F.lit(total), min_count)


@dataclass
class SkeletonIndex:
    """(group, first, last, skeleton) of single rows and of three in a row, and the rows that hold each trigram."""

    generations: Generations
    group: str
    order: str
    text: str

    @classmethod
    def at(cls, spark: SparkSession, folder: str, group: str, order: str, text: str = "text") -> SkeletonIndex:
        return cls(Generations(spark, folder), group, order, text)

    def build(self, rows: DataFrame, publish: bool = True) -> int:
        g = self.generations
        generation = g.next_generation()
        search.skeletons(rows, self.group, self.order, self.text).write.parquet(g.path("skeletons", generation))
        n = runtime.shuffle_partitions(g.spark)
        grams = self.grams(g.read("skeletons", generation)).withColumn("bucket", bucket(F.col("gram")))
        dealt = grams.repartitionByRange(n, "bucket", "gram", self.group, "first").sortWithinPartitions("bucket", "gram", self.group, "first", "last")
        dealt.write.partitionBy("bucket").parquet(g.path("trigrams", generation))
        if publish:
            if not self.verify(generation).isEmpty():
                raise ValueError(f"generation {generation} is not published: its trigrams lose rows")
            g.pointer.point(generation)
        return generation

    def grams(self, skeletons: DataFrame) -> DataFrame:
        return skeletons.select(self.group, "first", "last", F.explode(scalar.trigrams(F.col("skeleton"))).alias("gram"))

    def verify(self, generation: int | None = None) -> DataFrame:
        """(group, first, last, gram) that the trigrams lose: all rows if they are few, else a sample."""
        g = self.generations
        skeletons = g.read("skeletons", generation)
        chosen = F.lit(True) if skeletons.count() < ALL else F.pmod(F.xxhash64(self.group, "first", "last"), F.lit(EVERY)) == 0
        key = [self.group, "first", "last", "gram"]
        return self.grams(skeletons.filter(chosen)).join(g.read("trigrams", generation).select(*key), key, "left_anti")

    def skeletons(self) -> DataFrame:
        return self.generations.read("skeletons")

    def recall(self, skeleton: str) -> DataFrame:
        """(group, first, last) of the rows that hold every trigram of a skeleton: all rows for one below three characters."""
        wanted = sorted({skeleton[k : k + 3] for k in range(len(skeleton) - 2)})
        key = [self.group, "first", "last"]
        if not wanted:
            return self.skeletons().select(*key)
        held = self.generations.read("trigrams").filter(F.col("bucket").isin(buckets_of(wanted)) & F.col("gram").isin(wanted))
        return held.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(wanted)).select(*key)

    def search(self, query: str) -> DataFrame:
        """Spaceless search: trigram recall, then the exact place in the skeleton; a row's own hit hides windows over it."""
        spark = self.generations.spark
        wanted = search.normalise_query(spark, query, "L6.skeleton")
        rows = self.skeletons()
        found = self.recall(wanted) if len(wanted) >= 3 else None
        if found is not None:
            few = found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
            rows = rows.join(F.broadcast(found) if few else found, [self.group, "first", "last"], "left_semi")
        return search.concatenated(rows, query, self.group)
