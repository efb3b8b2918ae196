"""Searches and counts over the stored indexes, and the life of an index, with their SQL over the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import runtime
from textloom.functions import normalize, text as scalar
from textloom.operators import index, joins, search
from textloom.plans.register import W as _W, query, words

_L1 = normalize.sql(normalize.PROFILES["L1.ws"], "text")


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS token FROM {_W}) GROUP BY token")
def index_vocabulary(spark, t):
    return t.text().vocabulary()


@query(f"SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS places, sha256(string_agg(token, ' ' ORDER BY pos)) AS tokens FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM {_W}) GROUP BY doc_id")
def index_postings(spark, t):
    rows = t.text().generations.read("postings")
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("places"), F.sha2(tokens, 256).alias("tokens"))


@query(f"SELECT doc_id, lang, source, sha256({_L1}) AS form, sha256(array_to_string(w, ' ')) AS words, len(w)::INT AS size FROM documents JOIN {_W.replace('lang, source, ', '')} USING (doc_id)")
def index_forms(spark, t):
    return t.text().forms().withColumns({"form": F.sha2("form", 256), "words": F.sha2("words", 256)})


@query("SELECT 0::BIGINT AS problems, count(*) AS docs FROM documents")
def index_verify(spark, t):
    found = t.text().verify(t("documents"))
    return found.agg(F.count(F.lit(1)).alias("problems")).join(F.broadcast(t.text().generations.read("totals").select("docs")))


@query(f"""WITH p AS (SELECT doc_id, unnest(w) AS token FROM {_W}), c AS (SELECT doc_id, token, count(*) AS n FROM p GROUP BY ALL)
SELECT CASE WHEN doc_id % 50 = 0 THEN 'lost' ELSE 'count' END AS problem, doc_id::VARCHAR AS id, token FROM c WHERE doc_id % 50 = 0 OR doc_id % 50 = 1 UNION ALL SELECT 'documents', NULL, (SELECT count(*) FROM documents WHERE doc_id % 50 <> 0) || ' of ' || (SELECT count(*) FROM documents)""")
def index_drift(spark, t):
    """An index of a table that has since got rows and longer texts: what verification says of it."""
    docs = t("documents")
    stale = docs.filter("doc_id % 50 <> 0").withColumn("text", F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")))
    one = index.TextIndex.at(spark, runtime.fresh_dir(spark, "index-drift"), "doc_id")
    generation = one.build(stale, publish=False)
    every, index.ALL = index.ALL, 1 << 62
    try:
        return runtime.stored(one.verify(docs, generation), "drift")
    finally:
        index.ALL = every


@query("SELECT unnest(['built', 'flipped', 'rolled back', 'collected']) AS step, unnest([1, 3, 2, 3])::BIGINT AS generation, unnest(['1', '1,2,3', '1,2,3', '2,3']) AS builds")
def index_lifecycle(spark, t):
    """Three builds, a rollback, a new flip and a collection that keeps the two newest."""
    docs = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    one = index.TextIndex.at(spark, runtime.fresh_dir(spark, "index-life"), "doc_id")
    g, rows = one.generations, []
    say = lambda step: rows.append((step, g.pointer.current(), ",".join(map(str, g.builds()))))
    one.build(docs)
    say("built")
    one.build(docs)
    one.build(docs)
    say("flipped")
    g.rollback()
    say("rolled back")
    g.pointer.point(3)
    g.collect_garbage(2)
    say("collected")
    return spark.createDataFrame(rows, "step string, generation long, builds string")


@query(f"SELECT doc_id FROM {_W} WHERE list_contains(w, 'heed')")
def fts_term(spark, t):
    return t.text().ids(search.Term("heed"))


@query(f"SELECT doc_id FROM {_W} WHERE list_contains(w, 'the') AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'heed')")
def fts_boolean(spark, t):
    return t.text().ids(search.Bool(must=(search.Term("the"), search.Phrase(("of", "the"))), should=(search.Term("that"),), must_not=(search.Term("heed"),)))


@query(f"SELECT doc_id FROM {_W} WHERE list_contains(w, 'heed') OR contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def fts_should(spark, t):
    return t.text().ids(search.Bool(should=(search.Term("heed"), search.Phrase(("of", "the")), search.Term(" "))))


@query("SELECT doc_id FROM documents")
def fts_all(spark, t):
    return t.text().ids(search.All())


@query(f"SELECT doc_id FROM {_W} WHERE len(w) BETWEEN 100 AND 200")
def fts_range(spark, t):
    return t.text().ids(search.Range("size", 100, 200))


@query(f"SELECT doc_id FROM {_W} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' that the ')")
def fts_phrase(spark, t):
    return t.text().ids(search.Phrase(("that", "the")))


@query(f"""WITH p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM {_W})
SELECT DISTINCT a.doc_id, a.pos AS start FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.token = 'the' AND b.token = 'of' AND b.pos - a.pos BETWEEN 1 AND 3""")
def fts_near(spark, t):
    return t.text().near(["the", "of"], 2).select("doc_id", F.col("start").cast("long").alias("start"))


@query(f"""WITH p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM {_W}), q AS (SELECT * FROM p WHERE token IN ('the', 'of'))
SELECT DISTINCT s.doc_id, s.pos AS start FROM q s WHERE (SELECT count(*) FROM q x WHERE x.doc_id = s.doc_id AND x.token = 'the' AND x.pos BETWEEN s.pos AND s.pos + 4) >= 2
AND (SELECT count(*) FROM q x WHERE x.doc_id = s.doc_id AND x.token = 'of' AND x.pos BETWEEN s.pos AND s.pos + 4) >= 1""")
def fts_near_unordered(spark, t):
    return t.text().near(["the", "of", "the"], 2, ordered=False).select("doc_id", F.col("start").cast("long").alias("start"))


@query(f"SELECT doc_id, count(*) AS n_hits FROM (SELECT doc_id, unnest(w) AS token FROM {_W}) WHERE regexp_matches(token, '^thinth') GROUP BY doc_id")
def fts_regex_expand(spark, t):
    return search.guarded_regex(t.text(), "^thinth", "reader", search.RateLimiter(), 0.0, most=None)


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS tf{k}" for k, x in enumerate(terms))
    df = ", ".join(f"sum((tf{k} > 0)::INT) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    any_hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"WITH c AS (SELECT doc_id, len(w) AS dl, {tf} FROM {_W}), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c) SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE {any_hit}"


@query(_bm25_sql(["heed", "thinth"]))
def fts_bm25(spark, t):
    return t.text().bm25(["heed", "thinth"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM {_W} WHERE list_contains(w, 'the') ORDER BY doc_id LIMIT 50 OFFSET 10")
def fts_page(spark, t):
    return t.text().search(search.Term("the"), 50, 10)[0]


@query(f"SELECT count(*) AS total, count(*) > 60 AS truncated FROM {_W} WHERE list_contains(w, 'the')")
def fts_count(spark, t):
    one = t.text()
    _, total, truncated = one.search(search.Term("the"), 50, 10)
    return spark.createDataFrame([(one.count(search.Term("the")), truncated)], "total long, truncated boolean") if total else None


@query(f"SELECT doc_id, instr(form, 'ation') - 1 AS start FROM (SELECT doc_id, {_L1} AS form FROM documents) WHERE contains(form, 'ation')")
def scan_substring(spark, t):
    return t.text().scan("ation").select("doc_id", F.col("start").cast("long").alias("start"))


@query("SELECT 'L1.ws' AS profile, 0::BIGINT AS total, 1 AS warnings UNION ALL SELECT 'adhoc:' || left(sha256('N01,N12'), 12), count(*), 0 FROM documents WHERE contains(" + normalize.sql(("N01", "N12"), "text") + ", 'tion the')")
def search_warnings(spark, t):
    """An exact search for a word with Persian letters, and one under ad-hoc rules."""
    docs = t("documents")
    found = (search.search_exact(docs, "کتاب"), search.search_normalised(docs, "tion, the", ["N01", "N12"], "substring"))
    return spark.createDataFrame([(x.profile, x.total, len(x.warnings)) for x in found], "profile string, total long, warnings int")


@query(f"SELECT source, count(*) AS n FROM (SELECT source, unnest(w) AS token FROM {_W}) WHERE token = 'the' GROUP BY source")
def count_frequency(spark, t):
    return t.text().frequency("the", "source")


_CO = """WITH p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM {w}),
c AS (SELECT b.token, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.token = 'heed' AND b.token <> 'heed' AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 GROUP BY b.token)""".format(w=_W)


@query(_CO + " SELECT token, n FROM c")
def cooccurrence(spark, t):
    return t.text().cooccurrence("heed", 5)


def _log_term(o: str, e: str) -> str:
    return f"CASE WHEN {o} > 0 AND {e} > 0 THEN ({o}) * ln(({o}) / ({e})) ELSE 0 END"


@query(_CO + f""", f AS (SELECT token, count(*) AS cnt FROM p GROUP BY token), m AS (SELECT sum(n) AS mass FROM c), tt AS (SELECT sum(cnt) AS total FROM f),
x AS (SELECT token, n::DOUBLE AS n, cnt::DOUBLE AS cnt, mass::DOUBLE AS mass, total::DOUBLE AS total, mass::DOUBLE / total::DOUBLE * cnt AS e FROM c JOIN f USING (token), m, tt WHERE n >= 3)
SELECT token, n::BIGINT AS n, round(e, 6) AS expected, round(log2(n / e), 6) AS pmi, round((n - e) / sqrt(n), 6) AS t_score,
round(greatest(2 * ({_log_term('n', 'e')} + {_log_term('(mass - n)', '(mass - e)')} + {_log_term('(cnt - n)', '(cnt - e)')} + {_log_term('(total - mass - cnt + n)', '(total - mass - cnt + e)')}), 0), 4) AS llr FROM x""")
def collocation(spark, t):
    rows = t.text().collocation("heed", 5)
    return rows.select("token", "n", F.round("expected", 6).alias("expected"), F.round("pmi", 6).alias("pmi"), F.round("t_score", 6).alias("t_score"), F.round("llr", 4).alias("llr"))


# ---- skeletons and trigrams ----------------------------------------------------------------------------------------

_SKELETON = normalize.sql(normalize.PROFILES["L6.skeleton"], "raw")
_SKELETONS_SQL = f"""WITH r AS (SELECT conv_id, turn, text, lead(text) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(turn, 2) OVER w AS o2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn AS first, turn AS last, text AS raw FROM r UNION ALL SELECT conv_id, turn, o2, concat_ws(' ', text, t1, t2) FROM r WHERE o2 IS NOT NULL),
s AS (SELECT conv_id, first, last, {_SKELETON} AS skeleton FROM k)"""


@query(_SKELETONS_SQL + " SELECT conv_id, first, last, sha256(skeleton) AS skeleton FROM s")
def skeleton_windows(spark, t):
    return t.skeletons().skeletons().withColumn("skeleton", F.sha2("skeleton", 256))


@query(_SKELETONS_SQL + """, h AS (SELECT conv_id, first, last, instr(skeleton, 'ofthe') - 1 AS start, first <> last AS spans FROM s WHERE contains(skeleton, 'ofthe'))
SELECT * FROM h WHERE NOT spans OR NOT EXISTS (SELECT 1 FROM h o WHERE NOT o.spans AND o.conv_id = h.conv_id AND o.first BETWEEN h.first AND h.last)""")
def concat_search(spark, t):
    return t.skeletons().search("of the").withColumn("start", F.col("start").cast("long"))


_WORD_SKELETON = normalize.sql(normalize.PROFILES["L6.skeleton"], "word")


@query(_SKELETONS_SQL + f""", h AS (SELECT conv_id, first AS turn, instr(skeleton, 'ofthe') AS start FROM s WHERE first = last AND contains(skeleton, 'ofthe')),
w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) - 1 AS token, unnest(ws) AS word FROM (SELECT conv_id, turn, {words('text')} AS ws FROM conversations)),
f AS (SELECT *, {_WORD_SKELETON} AS form FROM w),
o AS (SELECT *, coalesce(sum(length(form)) OVER (PARTITION BY conv_id, turn ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f)
SELECT conv_id, turn, token::INT AS token, substr('ofthe', (greatest(place, start - 1) - (start - 1) + 1)::BIGINT, (least(place + length(form), start + 4) - greatest(place, start - 1))::BIGINT) AS query_part FROM o JOIN h USING (conv_id, turn) WHERE place < start - 1 + 5 AND place + length(form) > start - 1""")
def concat_segments(spark, t):
    """The tokens that a spaceless match covers, with the part of the query each of them holds."""
    hits = t.skeletons().search("of the").filter("NOT spans").select("conv_id", F.col("first").alias("turn"), "start")
    return search.segments(hits.join(t("conversations"), ["conv_id", "turn"]), ["conv_id", "turn"], "ofthe")


@query(_SKELETONS_SQL + " SELECT conv_id, first, last FROM s WHERE contains(skeleton, 'the') AND contains(skeleton, 'hea') AND contains(skeleton, 'eat')")
def trigram_recall(spark, t):
    return t.skeletons().recall("theat")


@query(_SKELETONS_SQL + ", g AS (SELECT DISTINCT conv_id, first, last, unnest(list_transform(range(1, length(skeleton) - 1), lambda i: substr(skeleton, i, 3))) AS gram FROM s) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def trigram_postings(spark, t):
    return t.skeletons().generations.read("trigrams").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS lost")
def trigram_verify(spark, t):
    return t.skeletons().verify().agg(F.count(F.lit(1)).alias("lost"))


# ---- character grams and near duplicates ---------------------------------------------------------------------------


@query("""SELECT doc_id, len(g)::BIGINT AS n, sha256(array_to_string(g, '|')) AS grams FROM (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS g FROM documents)""")
def tok_trigrams(spark, t):
    g = scalar.trigrams(F.col("text"))
    return t("documents").select("doc_id", F.size(g).cast("long").alias("n"), F.sha2(F.array_join(g, "|"), 256).alias("grams"))


@query("""SELECT doc_id, len(g)::BIGINT AS n, sha256(array_to_string(g, '|')) AS grams FROM (SELECT doc_id, list_sort(list_distinct(CASE WHEN length(text) < 5 THEN [text] ELSE list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)) END)) AS g FROM documents)""")
def tok_shingles(spark, t):
    g = scalar.shingles(F.col("text"), 5)
    return t("documents").select("doc_id", F.size(g).cast("long").alias("n"), F.sha2(F.array_join(g, "|"), 256).alias("grams"))


@query("""SELECT item_id, slot, list_min(list_transform(g, lambda s: substr(sha256(slot || ':' || s), 1, 16))) AS minimum FROM
(SELECT item_id, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS g FROM benchmark), (SELECT unnest(range(64))::INT AS slot)""")
def minhash_signature(spark, t):
    g = scalar.shingles(F.col("text"), 5)
    slots = F.array(*(F.struct(F.lit(k).alias("slot"), scalar.minhash_slot(F.col("g"), k).alias("minimum")) for k in range(64)))
    return t("benchmark").select("item_id", g.alias("g")).select("item_id", F.explode(slots).alias("s")).select("item_id", "s.*")


_PASSAGES = f"""k AS (SELECT doc_id, {normalize.sql(normalize.PROFILES['L6.skeleton'], 'text')} AS s FROM documents),
c AS (SELECT s, min(doc_id) AS id FROM k WHERE s <> '' GROUP BY s),
g AS (SELECT id, list_sort(list_distinct(CASE WHEN length(s) < 5 THEN [s] ELSE list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)) END)) AS g FROM c),
u AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM g),
r AS (SELECT gram FROM u GROUP BY gram HAVING count(*) <= 12),
b AS (SELECT DISTINCT x.id AS low, y.id AS high FROM u x JOIN r USING (gram) JOIN u y USING (gram) WHERE x.id < y.id)"""


@query(f"""WITH {_PASSAGES}, j AS (SELECT b.low, b.high, count(*) AS o FROM b JOIN u x ON x.id = b.low JOIN u y ON y.id = b.high AND y.gram = x.gram GROUP BY ALL), n AS (SELECT id, max(n) AS n FROM u GROUP BY id)
SELECT low, high, round(o / (a.n + z.n - o), 9) AS jaccard FROM j JOIN n a ON a.id = low JOIN n z ON z.id = high WHERE o >= 0.8 * (a.n + z.n - o)""")
def near_passages(spark, t):
    rows = joins.near_passages(t("documents"), "doc_id", "text", 0.8)
    return rows.select("low", "high", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH {_PASSAGES} SELECT doc_id, id AS representative FROM k JOIN c USING (s)")
def near_passage_members(spark, t):
    return joins.passage_classes(t("documents"), "doc_id", "text").select("doc_id", "representative")
