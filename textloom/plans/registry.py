"""Queries of the core operators over the harness tables, each with its DuckDB SQL where SQL can say it.

Every query reads its whole tables; searches read stored indexes over whole tables, which the first of them builds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import normalize, text as scalar
from textloom.operators import corpus, counting, graph, joins, ledger, quality, retrieval, search, signatures
from textloom.plans.register import ORACLES, QUERIES, W as _W, Source as Tables, query, words


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from textloom.plans import corpus_queries, edition_queries, graph_queries, index_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked term search over documents, with their labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    hits = search.bm25(docs, ["the", "that"])
    return hits.join(labels, "doc_id", "left").orderBy(F.desc("score"), "doc_id").limit(20)


# ---- normalisation -------------------------------------------------------------------------------------------------

_LATIN = ("N01", "N11", "N16", "N12", "N13")


@query(f"SELECT doc_id, sha256({normalize.sql(('N01', 'N11', 'N16'), 'text')}) AS form FROM documents")
def norm_ws(spark, t):
    return t("documents").select("doc_id", F.sha2(normalize.profile("L1.ws", F.col("text")), 256).alias("form"))


@query(f"SELECT doc_id, sha256({normalize.sql(('N12',), 'text')}) AS form FROM documents")
def norm_punct(spark, t):
    return t("documents").select("doc_id", F.sha2(normalize.rule("N12", F.col("text")), 256).alias("form"))


@query(f"SELECT doc_id, sha256({normalize.sql(normalize.PROFILES['L5.codepoints'], 'text')}) AS form FROM documents")
def norm_folded(spark, t):
    return t("documents").select("doc_id", F.sha2(normalize.profile("L5.codepoints", F.col("text")), 256).alias("form"))


@query(f"SELECT doc_id, sha256({normalize.sql(normalize.PROFILES['L6.skeleton'], 'text')}) AS form FROM documents")
def norm_skeleton(spark, t):
    return t("documents").select("doc_id", F.sha2(normalize.profile("L6.skeleton", F.col("text")), 256).alias("form"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, ''), lambda c, i: NOT (i > 2 AND c = substr(text, i - 1, 1) AND c = substr(text, i - 2, 1))), '')) AS form FROM documents")
def norm_dedupe(spark, t):
    return t("documents").select("doc_id", F.sha2(normalize.rule("N22", F.col("text")), 256).alias("form"))


_ARABIC = [
    (1, "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ"), (2, "أَإِآؤئء مَلَكُوت"), (3, "كتـــاب  ۖ قُلۡ"), (4, "ﻻ ﻷ ﻹ ﻵ"), (5, "۱۲۳ ٤٥٦ گی ۀہ"), (6, "﻿‏مدرسة على"), (7, ""), (8, "éà  x"),
]
_ROWS_SQL = "(SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}, '{v}')" for k, v in _ARABIC) + ") AS a(id, text))"


def _all_profiles_sql() -> str:
    parts = [f"SELECT id, '{name}' AS profile, sha256({normalize.sql(rules, 'text')}) AS form FROM {_ROWS_SQL}" for name, rules in normalize.PROFILES.items() if name != "L7.affix"]
    return " UNION ALL ".join(parts)


@query(_all_profiles_sql())
def norm_profiles(spark, t):
    """All documents, and some words of the script that the rules are made for."""
    rows = t("documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-k, v) for k, v in _ARABIC], "id long, text string"))
    forms = F.array(*(F.struct(F.lit(n).alias("profile"), F.sha2(normalize.profile(n, F.col("text")), 256).alias("form")) for n in normalize.PROFILES if n != "L7.affix"))
    return rows.select("id", F.explode(forms).alias("f")).select("id", "f.*")


def _explain_sql() -> str:
    parts = [f"SELECT doc_id, {k} AS step, '{normalize.NAMES[r]}' AS rule, sha256({normalize.sql(_LATIN[: k + 1], 'text')}) AS form FROM documents" for k, r in enumerate(_LATIN)]
    return " UNION ALL ".join(parts)


@query(_explain_sql())
def norm_explain(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(normalize.explain(_LATIN, F.col("text"))).alias("step", "s"))
    return rows.select("doc_id", "step", F.col("s.rule").alias("rule"), F.sha2("s.text", 256).alias("form"))


# ---- tokens, hashes and other scalars ------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens FROM (SELECT doc_id, {words('text')} AS w FROM documents)")
def tok_split(spark, t):
    w = scalar.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.sha2(F.array_join(w, " "), 256).alias("tokens"))


@query("SELECT doc_id, true AS same FROM documents")
def tok_reconstruct(spark, t):
    text = F.col("text")
    return t("documents").select("doc_id", (scalar.reconstruct(scalar.tokens(text), scalar.separators(text)) == text).alias("same"))


@query(None)
def minhash64_documents(spark, t):
    return signatures.minhash(t("documents"), "doc_id", "text", 5, 64)


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, octet_length(encode(text))::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars FROM documents")
def hash_text(spark, t):
    return t("documents").select("doc_id", scalar.tagged_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


@query(r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?i)\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)(javascript|data):', '', 'g')) AS clean FROM pages""")
def sanitize_html(spark, t):
    return t("pages").select("page_id", F.sha2(scalar.sanitize_html(F.col("html")), 256).alias("clean"))


@query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)\b({scalar.SECRET_KEYS})(\s*[:=]\s*)[^\s,;&]+', '\1\2[REDACTED]', 'g'), '([a-z][a-z0-9+.-]*://)[^/@\s]+@', '\1[REDACTED]@', 'g')) AS clean FROM documents""")
def redact_text(spark, t):
    return t("documents").select("doc_id", F.sha2(scalar.redact(F.col("text")), 256).alias("clean"))


_SNIPPET = "CASE WHEN octet_length(encode(text)) > 100 THEN substr(text, 1, list_max(list_filter(range(0, 101), lambda k: octet_length(encode(substr(text, 1, k))) <= 100))) || '...' ELSE text END"


@query(f"SELECT doc_id, {_SNIPPET} AS snippet FROM documents")
def snippets(spark, t):
    return t("documents").select("doc_id", scalar.snippet(F.col("text")).alias("snippet"))


@query("SELECT CASE WHEN value > 0.9 THEN 'high' WHEN value >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY 1")
def confidence_bands(spark, t):
    return t("events").groupBy(scalar.confidence_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_features(spark, t):
    return t("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text = nfc_normalize(text) AS nfc FROM documents")
def unicode_forms(spark, t):
    return t("documents").select("doc_id", F.contains(F.concat(F.lit(","), scalar.unicode_forms(F.col("text")), F.lit(",")), F.lit(",NFC,")).alias("nfc"))


@query(r"SELECT doc_id, CASE WHEN n < length(text) THEN n END AS at FROM (SELECT doc_id, text, length(regexp_extract(text, '^[A-Za-z .,\n]*')) AS n FROM documents)")
def first_unexpected(spark, t):
    return t("documents").select("doc_id", scalar.first_unexpected(F.col("text"), r"A-Za-z .,\n").cast("long").alias("at"))


@query("SELECT item_id, 'v1:3:' || sha256(text) AS key FROM benchmark")
def cache_keys(spark, t):
    return t("benchmark").select("item_id", scalar.cache_key(F.lit(3), F.col("text")).alias("key"))


# ---- filters, scans and full-text search ---------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 900 AND source = 'src1'")
def scan_filter_metadata(spark, t):
    wanted = search.metadata_filter({"lang": ["en", "fr"], "n_chars": search.parse_range("200-900"), "source": "src1"})
    return t("documents").filter(wanted).select("doc_id", "lang", "source")


@query("SELECT doc_id, instr(' ' || array_to_string(w, ' ') || ' ', ' the ') - 1 AS start FROM (SELECT doc_id, " + words(normalize.sql(("N01", "N11", "N16"), "text")) + " AS w FROM documents) WHERE list_contains(w, 'the')")
def scan_whole_token(spark, t):
    return search.scan(t("documents"), "the", "whole_token").select("doc_id", F.col("start").cast("long").alias("start"))


@query(f"SELECT doc_id FROM documents WHERE starts_with({normalize.sql(('N01', 'N11', 'N16'), 'text')}, 'The ')")
def scan_prefix(spark, t):
    return t("documents").filter(search.match(normalize.profile("L1.ws", F.col("text")), "The ", "prefix")).select("doc_id")


# ---- counting ------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'the' AS target, sum(n)::BIGINT AS n, count(*) AS n_groups, sha256('the|["L0.exact", "lower"]|' || sum(n)::BIGINT || '|' || count(*)) AS checksum FROM
(SELECT source, sum(n) AS n FROM (SELECT source, len(list_filter(w, lambda x: x = 'the')) AS n FROM {_W}) WHERE n > 0 GROUP BY source)""")
def count_report(spark, t):
    return counting.report(t("documents"), "source", F.lower("text"), "the", ["L0.exact", "lower"])


@query(f"SELECT lang, source, sum(n)::BIGINT AS n FROM (SELECT lang, source, len(list_filter(w, lambda x: x = 'the')) AS n FROM {_W}) GROUP BY ROLLUP (lang, source)")
def count_distribution(spark, t):
    return counting.term_counts(t("documents"), ["lang", "source"], F.lower("text"), "the").rollup("lang", "source").agg(F.sum("n").alias("n"))


@query(f"SELECT token FROM (SELECT unnest(w) AS token FROM {_W}) GROUP BY token HAVING count(*) = 1")
def count_hapax(spark, t):
    return t.text().hapax()


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM {_W}) GROUP BY token ORDER BY n DESC, token LIMIT 100")
def count_forms_top(spark, t):
    return t.text().vocabulary().select("token", "n").orderBy(F.desc("n"), "token").limit(100)


@query(f"""WITH h AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'heed')) AS n FROM {_W}), b AS (SELECT min(doc_id) AS first, max(doc_id) AS last, sum(n)::BIGINT AS n FROM h WHERE n > 0)
SELECT first, last, n, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id BETWEEN first AND last) AS span_rows FROM b""")
def count_first_last(spark, t):
    return counting.first_last(t("documents"), "doc_id", F.lower("text"), "heed")


@query("SELECT 'all_analyses' AS mode, event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'one_vote_per_token', event_type, count(*) FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type UNION ALL SELECT 'single_source', event_type, count(*) FROM (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY user_id HAVING count(*) = 1) GROUP BY event_type")
def count_modes(spark, t):
    parts = [counting.votes(t("events"), ["user_id"], "event_type", m).select(F.lit(m).alias("mode"), "event_type", "n") for m in counting.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RUNS = """WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m),
d AS (SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM n GROUP BY conv_id, run, role)"""


@query(_RUNS + " SELECT * FROM d")
def rle_divisions(spark, t):
    return counting.run_lengths(t("conversations"), "conv_id", "turn", "role")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, lang, lower(source) AS v FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END AS v FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -1, 'new')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.v = n.v THEN 'unchanged' ELSE 'changed' END AS change, o.v AS old, n.v AS new FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def diff_full_outer(spark, t):
    docs = t("documents")
    old = docs.select("doc_id", F.lower("source").alias("v"))
    new = docs.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper("source")).otherwise(F.col("source")).alias("v"))
    new = new.unionByName(spark.createDataFrame([(-1, "new")], "doc_id long, v string"))
    return joins.diff(old, new, ["doc_id"], "v")


@query("""WITH b AS (SELECT doc_id, upper(lang) AS lang, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE source END AS source FROM documents WHERE doc_id % 11 <> 0), j AS (SELECT a.doc_id, a.lang AS al, b.lang AS bl, a.source AS s1, b.source AS s2, b.doc_id AS bid FROM documents a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT field, verdict, count(*) AS n FROM (SELECT 'lang' AS field, CASE WHEN bid IS NULL THEN 'only_in_one' WHEN al = bl THEN 'identical' WHEN lower(al) = lower(bl) THEN 'compatible' ELSE 'conflicting' END AS verdict FROM j
UNION ALL SELECT 'source', CASE WHEN bid IS NULL THEN 'only_in_one' WHEN s1 = s2 THEN 'identical' WHEN lower(s1) = lower(s2) THEN 'compatible' ELSE 'conflicting' END FROM j) GROUP BY ALL""")
def dataset_diff(spark, t):
    a = t("documents").select("doc_id", "lang", "source")
    b = a.filter("doc_id % 11 <> 0").select("doc_id", F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("source")).alias("source"))
    return joins.compare_fields(a, b, ["doc_id"], ["lang", "source"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber + (l_orderkey % 2) AS l_linenumber, l_returnflag AS v FROM lineitem) SELECT l.l_orderkey, l.l_linenumber, l_returnflag, CASE WHEN c.v IS NULL THEN 'unmatched' WHEN c.v = l.l_returnflag THEN 'matched' ELSE 'mapped' END AS status
FROM lineitem l LEFT JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_linenumber = c.l_linenumber""")
def align_tokens(spark, t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    moved = lines.withColumn("l_linenumber", (F.col("l_linenumber") + F.col("l_orderkey") % 2).cast(lines.schema["l_linenumber"].dataType))
    return joins.align(lines, moved, ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(_RUNS + " SELECT c.conv_id, c.turn, d.first, d.last, d.role, d.n FROM conversations c JOIN d ON c.conv_id = d.conv_id AND c.turn BETWEEN d.first AND d.last")
def range_join_divisions(spark, t):
    turns = t("conversations")
    return joins.in_ranges(turns.select("conv_id", "turn"), counting.run_lengths(turns, "conv_id", "turn", "role"), "conv_id", "turn").select("conv_id", "turn", "first", "last", "role", "n")


@query("SELECT f.conv_id, f.turn AS focus, c.turn FROM conversations f JOIN conversations c ON f.conv_id = c.conv_id AND f.role = 'user' AND c.turn BETWEEN f.turn - 2 AND f.turn + 1")
def context_window(spark, t):
    turns = t("conversations")
    return joins.context(turns, turns.filter("role = 'user'"), "conv_id", "turn", 2, 1)


@query("SELECT p_brand, p_type, p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS representative FROM part")
def family_members(spark, t):
    return joins.family_members(t("part"), "p_brand", "p_partkey", "p_type")


@query("""SELECT a.p_brand, a.p_type AS low_kind, min(a.p_partkey) AS low, b.p_type AS high_kind, min(b.p_partkey) AS high FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type < b.p_type GROUP BY ALL""")
def family_classes(spark, t):
    return joins.family_classes(t("part"), "p_brand", "p_partkey", "p_type")


@query(f"""WITH i AS (SELECT item_id, {words('lower(text)')} AS w FROM benchmark), a AS (SELECT doc_id, len(w) AS nd, w FROM {_W}),
ci AS (SELECT item_id, token, count(*) AS c FROM (SELECT item_id, unnest(w) AS token FROM i) GROUP BY ALL), cd AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(w) AS token FROM a) GROUP BY ALL),
s AS (SELECT doc_id, item_id, sum(least(ci.c, cd.c))::BIGINT AS shared FROM cd JOIN ci USING (token) GROUP BY ALL)
SELECT doc_id, item_id, shared, round(2 * shared / (nd + len(i.w)), 6) AS score FROM s JOIN a USING (doc_id) JOIN i USING (item_id) WHERE 2 * shared / (nd + len(i.w)) >= 0.4""")
def link_suggest_dice(spark, t):
    rows = joins.multiset_dice(t("documents"), t("benchmark"), "doc_id", "item_id", F.lower("text"), 0.4)
    return rows.withColumn("score", F.round("score", 6))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_customers(spark, t):
    return joins.orphans(t("customer"), t("orders"), "c_custkey", "o_custkey").select("c_custkey")


# ---- graph over the TPC-H keys -------------------------------------------------------------------------------------


def _edges(t: Tables) -> DataFrame:
    node = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    link = lambda rows, a, b, kind: rows.select(a.alias("src"), F.lit(kind).alias("edge"), b.alias("dst"))
    return (
        link(t("nation"), node("r", "n_regionkey"), node("n", "n_nationkey"), "CONTAINS")
        .unionByName(link(t("customer"), node("n", "c_nationkey"), node("c", "c_custkey"), "CONTAINS"))
        .unionByName(link(t("supplier"), node("n", "s_nationkey"), node("s", "s_suppkey"), "CONTAINS"))
        .unionByName(link(t("orders"), node("c", "o_custkey"), node("o", "o_orderkey"), "PLACED"))
    )


_EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'CONTAINS' AS edge, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'CONTAINS', 'c' || c_custkey FROM customer
UNION ALL SELECT 'n' || s_nationkey, 'CONTAINS', 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'PLACED', 'o' || o_orderkey FROM orders)"""


@query(f"WITH {_EDGES} SELECT src, edge, dst FROM e")
def graph_build(spark, t):
    return _edges(t)


@query(f"WITH {_EDGES} SELECT edge, other FROM (SELECT edge, dst AS other FROM e WHERE src = 'n3' UNION SELECT edge, src FROM e WHERE dst = 'n3') ORDER BY 1, 2 LIMIT 128")
def graph_neighbours(spark, t):
    return graph.neighbours(_edges(t), "n3")


@query(f"WITH {_EDGES} SELECT DISTINCT node, hops FROM (SELECT 'r1' AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM e WHERE src = 'r1' UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'r1' UNION ALL SELECT c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 'r1')")
def graph_reachable(spark, t):
    return graph.distances(_edges(t), spark.createDataFrame([("r1",)], "node string"), 3, "out")


@query(f"WITH {_EDGES} SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM e a JOIN e b ON a.dst = b.src AND b.edge = 'CONTAINS' JOIN e c ON b.dst = c.src AND c.edge = 'PLACED' WHERE a.src = 'r2' AND a.edge = 'CONTAINS'")
def graph_pattern(spark, t):
    seeds = spark.createDataFrame([("r2",)], "node string")
    return graph.pattern(_edges(t), seeds, [("CONTAINS", "out"), ("CONTAINS", "out"), ("PLACED", "out")])


@query("SELECT 2::INT AS hops, 'n1>r' || a.n_regionkey || '>n2' AS path FROM nation a JOIN nation b ON a.n_nationkey = 1 AND b.n_nationkey = 2 AND a.n_regionkey = b.n_regionkey")
def graph_paths(spark, t):
    edges = _edges(t).filter("edge = 'CONTAINS' AND substring(dst, 1, 1) IN ('n', 's')")
    return graph.paths(edges, "n1", "n2", graph.Budget(hops=6)).select("hops", F.array_join("path", ">").alias("path"))


@query(f"WITH {_EDGES} SELECT src, edge, dst FROM e WHERE (src = 'r1' OR src IN (SELECT dst FROM e WHERE src = 'r1')) AND dst IN (SELECT dst FROM e WHERE src = 'r1' UNION SELECT b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'r1')")
def graph_subgraph(spark, t):
    edges = _edges(t)
    return graph.subgraph(edges, graph.distances(edges, spark.createDataFrame([("r1",)], "node string"), 2, "out"))


@query("SELECT 'c' || o_custkey AS src, 'PLACED' AS edge, 'o' || o_orderkey AS dst, 'src' AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def graph_dangling(spark, t):
    nodes = t("customer").filter("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    nodes = nodes.unionByName(t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")))
    return graph.dangling(_edges(t).filter("edge = 'PLACED'"), nodes)


@query("SELECT conv_id || ':' || turn AS src, 'NEXT' AS edge, conv_id || ':' || nxt AS dst FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def next_edges(spark, t):
    turns = t("conversations").withColumn("node", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return graph.sequence_edges(turns, ["conv_id"], "turn", "node")


# ---- retrieval -----------------------------------------------------------------------------------------------------

_QUERY = [((k * 37) % 64 - 32) / 32 for k in range(64)]
_QUERY_SQL = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
_COSINE = f"(SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {_QUERY_SQL}) AS score FROM embeddings)"


@query(f"SELECT vec_id, round(score, 6) AS score FROM {_COSINE} ORDER BY score DESC, vec_id LIMIT 25")
def vec_topk(spark, t):
    return retrieval.vector_topk(t("embeddings"), _QUERY, 25).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM {_COSINE} QUALIFY rank <= 100),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS n FROM {_W}) WHERE n > 0 QUALIFY rank <= 100)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM l) GROUP BY id""")
def rrf_hybrid(spark, t):
    near = retrieval.vector_topk(t("embeddings"), _QUERY, 100).withColumnRenamed("vec_id", "id")
    lexical = t.text().term_counts("the").withColumnRenamed("doc_id", "id")
    fused = retrieval.rrf([retrieval.ranked(near, "id", "score", 100), retrieval.ranked(lexical, "id", "n", 100)], "id")
    return fused.select("id", F.round("score", 9).alias("score"))


@query("SELECT 'documents' AS domain, doc_id::VARCHAR AS source, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'heed') UNION ALL SELECT 'conversations', conv_id || ':' || turn, 1.0 FROM conversations WHERE contains(text, 'heed') UNION ALL SELECT 'benchmark', item_id::VARCHAR, 2.0 FROM benchmark WHERE contains(text, 'heed')")
def federation_merge(spark, t):
    hit = F.contains("text", F.lit("heed"))
    return retrieval.federate({
        "documents": lambda: t("documents").filter(hit).select(F.col("doc_id").alias("source"), F.lit(1.0).alias("score")),
        "conversations": lambda: t("conversations").filter(hit).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source"), F.lit(1.0).alias("score")),
        "benchmark": lambda: t("benchmark").filter(hit).select(F.col("item_id").alias("source"), F.lit(2.0).alias("score")),
    })


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'whitespace' WHEN 2 THEN 'mismatch' ELSE 'not_found' END AS verdict, CASE WHEN item_id % 4 = 2 THEN 3 END::BIGINT AS first_difference FROM benchmark""")
def citations_verify(spark, t):
    items = t("benchmark")
    quoted = F.when(F.col("item_id") % 4 == 1, F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "))).when(F.col("item_id") % 4 == 2, F.concat(F.substring("text", 1, 3), F.lit("#"), F.expr("substring(text, 5)"))).otherwise(F.col("text"))
    return retrieval.verify_citations(items.select("item_id", quoted.alias("quoted")), items.filter("item_id % 4 <> 3"), "item_id", "quoted", "text")


# ---- quality and ledgers -------------------------------------------------------------------------------------------


@query("SELECT 'QV-018' AS rule, 'error' AS severity, conv_id || ':' || turn AS location, 'size falls' AS message FROM (SELECT *, length(text) AS size, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE size < b")
def monotone_checks(spark, t):
    return quality.validate_monotone(t("conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size")


@query("SELECT doc_id, string_agg(k || '=' || v, ';' ORDER BY k || '=' || v) AS views FROM (SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) GROUP BY doc_id")
def disagreement_view(spark, t):
    rows = t("labels").select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("quality", "toxic")))).alias("x")).select("doc_id", "x.*")
    return quality.disagreement(rows, "doc_id", "k", "v")


@query("SELECT lang, round(avg(quality::DOUBLE), 9) AS rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def evaluation_rates(spark, t):
    rows = quality.rates(t("labels").join(t("documents").select("doc_id", "lang"), "doc_id"), "lang", "quality")
    return rows.select("lang", F.round("rate", 9).alias("rate"), "n")


@query("SELECT event_id FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS b FROM events WHERE event_id % 97 <> 5) WHERE event_id <> b + 1")
def audit_gap_check(spark, t):
    return ledger.sequence_gaps(t("events").filter("event_id % 97 <> 5"), "event_id")


@query("SELECT event_id, sha256(event_id || '|' || event_type || '|' || user_id) AS entry_hash FROM events")
def audit_entry_hashes(spark, t):
    return ledger.chain_hashes(t("events"), "event_id", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))


@query("SELECT event_id AS id, user_id AS priority FROM events WHERE event_type IN (SELECT min(event_type) FROM events) ORDER BY user_id DESC, ts, event_id LIMIT 20")
def job_claim(spark, t):
    events = t("events")
    first = events.agg(F.min("event_type").alias("first"))
    jobs = events.join(F.broadcast(first)).select(F.col("event_id").alias("id"), F.col("user_id").alias("priority"), F.when(F.col("event_type") == F.col("first"), "queued").otherwise("done").alias("state"), F.col("ts").alias("available_at"))
    return ledger.claim(jobs, F.lit("9999-01-01").cast("timestamp"), 20).select("id", "priority")


@query("SELECT event_type, event_id, running FROM (SELECT *, sum(length(props)) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events) WHERE running > 5000")
def cache_lru_evict(spark, t):
    rows = t("events").withColumn("bytes", F.length("props"))
    return ledger.evict(rows, 5000, ["event_type"], "ts", "bytes", "event_id").select("event_type", "event_id", "running")


@query("SELECT event_id, user_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2")
def rate_limit_sliding(spark, t):
    return ledger.rate_limited(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 2, 86400, "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, t):
    return ledger.latest(t("events"), "user_id", ["event_id"], ["event_type"])


@query("SELECT user_id, event_id, b AS before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE NOT coalesce((b IS NULL AND event_type = 'view') OR (b = 'view' AND event_type IN ('click', 'view')) OR (b = 'click' AND event_type = 'purchase'), false)")
def illegal_transitions(spark, t):
    allowed = [(None, "view"), ("view", "click"), ("view", "view"), ("click", "purchase")]
    return ledger.transitions(t("events"), "user_id", ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id", "before")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events) WHERE age > 100")
def generations_gc(spark, t):
    return ledger.keep_generations(t("events").select("event_type", "event_id"), "event_type", "event_id", 100)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, t):
    return t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def window_sessions(spark, t):
    return t("events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, t):
    rows = counting.top_per_group(t("orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


# ---- corpus forms, projections and domains -------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({normalize.sql(normalize.PROFILES['L2.marks'], 'text')}) AS simple, sha256({normalize.sql(normalize.PROFILES['L4.hamza'], 'text')}) AS hamza_folded FROM documents")
def forms_build(spark, t):
    names = ("simple", "hamza_folded")
    return corpus.with_forms(t("documents"), "text", names).select("doc_id", *(F.sha2(n, 256).alias(n) for n in names))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'orphan' ELSE 'covered' END AS state FROM documents a FULL JOIN (SELECT doc_id + 5 AS doc_id FROM documents) b ON a.doc_id = b.doc_id) GROUP BY state")
def forms_coverage(spark, t):
    docs = t("documents")
    return corpus.coverage(docs, docs.select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


@query(f"SELECT doc_id, l.quality, l.toxic, {_SNIPPET} AS snippet FROM documents JOIN (SELECT doc_id AS d, quality, toxic FROM labels) l ON doc_id = l.d JOIN {_W.replace('SELECT doc_id, lang, source,', 'SELECT doc_id AS wd,')} ON wd = doc_id WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') ORDER BY doc_id LIMIT 1000")
def domain_search(spark, t):
    rows = corpus.domain_search(t("documents"), t("labels"), "doc_id", ("of", "the"), "doc_id", "text", 1000)
    return rows.toDF("doc_id", "again", "quality", "toxic", "snippet").drop("again")


_LITTLE = " || ".join(f"substr(lpad(to_hex(octet_length(encode(text))), 16, '0'), {15 - 2 * k}, 2)" for k in range(8))


@query(f"SELECT conv_id, sha256(unhex(string_agg({_LITTLE} || hex(encode(text)), '' ORDER BY turn, text))) AS hash FROM conversations GROUP BY conv_id")
def hash_stream(spark, t):
    return corpus.text_hash(t("conversations"), "conv_id", "turn", "text")


_BLOCKS = " || ".join(f"substr(sha256(encode(text) || '\\x{b:02X}\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB), 1, 16)" for b in range(8))


@query(f"""WITH h AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ('0x' || substr(hex, (2 * i + 1)::BIGINT, 2))::INT / 127.5 - 1) AS v FROM (SELECT doc_id, {_BLOCKS} AS hex FROM documents)),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM h) SELECT doc_id, unnest(range(0, 64))::INT AS i, round((unnest(v) / norm)::FLOAT::DOUBLE, 4) AS value FROM n""")
def embed_local_hash(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(corpus.local_hash_embedding(F.col("text"))).alias("i", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("""SELECT 'edition' AS kind, NULL AS src, 'e' AS node UNION ALL SELECT DISTINCT 'group', NULL, 'e:' || conv_id FROM conversations UNION ALL SELECT DISTINCT 'unit', NULL, 'e:' || conv_id || ':' || turn FROM conversations
UNION ALL SELECT DISTINCT 'CONTAINS', 'e', 'e:' || conv_id FROM conversations UNION ALL SELECT DISTINCT 'CONTAINS', 'e:' || conv_id, 'e:' || conv_id || ':' || turn FROM conversations""")
def graph_projection(spark, t):
    nodes, edges = corpus.structural_projection(t("conversations"), "e", "conv_id", "turn")
    return nodes.select("kind", F.lit(None).cast("string").alias("src"), "node").unionByName(edges.select(F.col("edge").alias("kind"), "src", F.col("dst").alias("node")))


@query("SELECT DISTINCT p_partkey::VARCHAR AS src, 'HAS' AS edge, p_brand AS dst FROM part UNION ALL SELECT p_partkey::VARCHAR, 'SAME', nxt FROM (SELECT p_partkey, lead(p_partkey::VARCHAR) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL")
def graph_value_chain(spark, t):
    parts = t("part").select(F.col("p_partkey").cast("string").alias("token"), "p_brand", "p_partkey")
    return corpus.value_projection(parts, "token", "p_brand", "HAS", "SAME", ["p_partkey"])


@query("SELECT source, CASE WHEN source = 'src3' THEN 'tombstoned' WHEN source = 'src4' THEN 'deactivated' ELSE 'active' END AS status, count(*) AS n FROM documents GROUP BY source")
def source_lifecycle(spark, t):
    sources = t("documents").select("source").distinct().withColumn("status", F.lit("active"))
    for name, status in (("src3", "tombstoned"), ("src3", "active"), ("src4", "deactivated"), ("src4", "deactivated")):
        sources = corpus.set_status(sources, "source", name, status)
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(sources, "source").select("source", "status", "n")


@query("SELECT user_id, count(*) AS n, min(ts) AS oldest FROM events GROUP BY user_id HAVING count(*) > 1")
def multiple_active(spark, t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest")).filter("n > 1")


@query("SELECT event_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) ORDER BY ts, event_id LIMIT 50")
def outbox_pending(spark, t):
    events = t("events")
    last = events.agg(F.max("event_type").alias("last"))
    outbox = events.join(F.broadcast(last)).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == F.col("last"), "pending").otherwise("dispatched").alias("state"))
    return ledger.pending(outbox, 50).select(F.col("id").alias("event_id"))


@query("SELECT a.doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id AND l.quality = 0)")
def tombstone_filter(spark, t):
    return ledger.not_buried(t("documents").select("doc_id"), t("labels").filter("quality = 0"), "doc_id")
