"""Bounded traversals, projections, reviews, traces and lineage over the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import runtime
from textloom.operators import graph, review
from textloom.plans.register import query
from textloom.plans.registry import _EDGES, _edges
from textloom.sources import store


@query(f"""WITH {_EDGES}, b AS (SELECT src, edge, dst FROM (SELECT *, row_number() OVER (ORDER BY edge, dst) AS k FROM e WHERE src = 'r1') WHERE k <= 3),
c AS (SELECT src, edge, dst FROM (SELECT e.*, row_number() OVER (PARTITION BY e.src ORDER BY e.edge, e.dst) AS k FROM e JOIN b ON e.src = b.dst) WHERE k <= 3)
SELECT 'r1' AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM b UNION ALL SELECT DISTINCT dst, 2 FROM c""")
def graph_bounded(spark, t):
    """Two levels of at most three steps from each node."""
    return graph.bounded(_edges(t), "r1", 2, graph.Budget(fanout=3), "out").nodes


@query(f"WITH {_EDGES}, n AS (SELECT dst, row_number() OVER (ORDER BY dst) AS k FROM (SELECT DISTINCT dst FROM e WHERE src = 'r1')) SELECT 'nodes exceed 4' AS reason, 4::BIGINT AS n, (SELECT string_agg(dst, ',' ORDER BY dst) FROM n WHERE k <= 3) || ',r1' AS nodes")
def graph_truncation(spark, t):
    found = graph.bounded(_edges(t), "r1", 3, graph.Budget(nodes=4), "out")
    row = found.nodes.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"))
    return row.select(F.lit(found.reason).alias("reason"), "n", "nodes")


@query(f"WITH {_EDGES} SELECT src, edge, dst FROM e WHERE src = 'r1' OR (src IN (SELECT dst FROM e WHERE src = 'r1') AND dst IN (SELECT dst FROM e WHERE src = 'r1'))")
def graph_bounded_edges(spark, t):
    return graph.bounded(_edges(t), "r1", 1, graph.Budget(), "out").edges


@query("SELECT 'c' || o_custkey AS src, 'NEXT' AS edge, 'o' || o_orderkey AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'structural' WHEN o_orderkey % 3 = 1 THEN 'assertion' ELSE 'missing' END AS provenance, CASE WHEN o_orderkey % 3 = 1 THEN 'me' END AS reviewer FROM orders")
def graph_explain(spark, t):
    rows = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.lit("NEXT").alias("edge"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("assertion_id"))
    assertions = t("orders").filter("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("id"), F.lit("me").alias("reviewer"), F.lit(0.9).alias("confidence"))
    return graph.explain(rows, assertions).select("src", "edge", "dst", "provenance", "reviewer")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_orderkey % 10 = 1)")
def graph_visibility(spark, t):
    """Structural edges, accepted ones in a scope; rejected and unknown ones are hidden."""
    k = F.col("o_orderkey")
    edges = t("orders").select(k.cast("string").alias("src"), F.lit("NEXT").alias("edge"), k.cast("string").alias("dst"), F.when(k % 4 != 0, F.concat(F.lit("a"), (k % 20).cast("string"))).alias("assertion_id"), k)
    assertions = spark.createDataFrame([(f"a{i}", "accepted" if i % 4 == 1 else "rejected") for i in range(20) if i % 4 != 3], "id string, decision string")
    return graph.visible(edges, assertions, ["a1", "a11"]).select("o_orderkey")


@query("SELECT CASE WHEN o_custkey % 10 = 0 THEN 'quarantined' ELSE 'kept' END AS part, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY part")
def graph_quarantine(spark, t):
    edges = _edges(t).filter("edge = 'PLACED'")
    nodes = t("customer").filter("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).unionByName(t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")))
    kept, gone = graph.quarantine(edges, nodes)
    n = F.count(F.lit(1)).alias("n")
    return kept.agg(n).select(F.lit("kept").alias("part"), "n").unionByName(gone.agg(n).select(F.lit("quarantined").alias("part"), "n"))


@query("SELECT unnest([1, 2, 3, 4])::INT AS step, unnest([1, 1, 2, 1])::BIGINT AS generation, unnest([true, false, true, false]) AS fresh, unnest([(SELECT count(*) FROM nation), (SELECT count(*) FROM nation), (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM nation)])::BIGINT AS edges")
def graph_publish(spark, t):
    """A build, the same again, a larger one, and the way back."""
    table = store.VersionedTable(spark, runtime.fresh_dir(spark, "projection"))
    edges = _edges(t).filter("edge = 'CONTAINS' AND substring(dst, 1, 1) IN ('n', 's')")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    small, rows = edges.filter("substring(dst, 1, 1) = 'n'"), []
    for k, some in enumerate((small, small, edges)):
        generation, fresh = graph.publish(table, ends, some)
        rows.append((k + 1, generation, fresh, table.read().count()))
    rows.append((4, table.rollback(), False, table.read().count()))
    return spark.createDataFrame(rows, "step int, generation long, fresh boolean, edges long")


@query("SELECT conv_id || ':' || turn AS node, CASE WHEN role = 'user' THEN 'group' ELSE 'unit' END AS kind FROM conversations WHERE conv_id = 3 AND turn = 0")
def graph_resolve(spark, t):
    nodes = t("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"), F.when(F.col("role") == "user", "group").otherwise("unit").alias("kind"))
    return graph.resolve(nodes, "3:0")


@query("SELECT 'ayah' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'concept', 2 UNION ALL SELECT 'entity', 3 UNION ALL SELECT 'TRANSLATES', 2 * count(*) FROM documents UNION ALL SELECT 'MENTIONS_CONCEPT', 1 + count(*) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'skipped', 2")
def graph_annotated(spark, t):
    units = t("documents").select(F.concat(F.lit("ayah:"), F.col("doc_id").cast("string")).alias("id"))
    seeds = spark.createDataFrame([("concept:a", "theme", "A"), ("concept:b", "theme", "B"), ("entity:c", "person", "C")], "id string, kind string, label string")
    links = spark.createDataFrame([("ayah:0", "MENTIONS_CONCEPT", "concept:b"), ("ayah:0", "LIKES", "concept:b"), ("ayah:-5", "MENTIONS", "entity:c")], "src string, edge string, dst string")
    translations = spark.createDataFrame([("translation-edition:x",), ("translation-edition:y",)], "id string")
    reviewed = t("labels").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("ayah:"), F.col("doc_id").cast("string")).alias("src"), F.lit("MENTIONS_CONCEPT").alias("edge"), F.lit("concept:a").alias("dst"), F.when(F.col("toxic") == 1, "accepted").otherwise("pending").alias("decision"))
    nodes, edges, skipped = review.annotated(seeds, links, units, translations, reviewed)
    n = F.count(F.lit(1)).alias("n")
    kinds = nodes.groupBy("kind").agg(n)
    return kinds.unionByName(edges.groupBy(F.col("edge").alias("kind")).agg(n)).unionByName(skipped.agg(n).select(F.lit("skipped").alias("kind"), "n"))


def _decisions(t):
    """Three decisions for each label: accept, dispute, then accept again or reject; every eleventh lacks a reviewer."""
    rows = t("labels").select(F.col("doc_id").alias("id"), "toxic")
    acts = F.array(*(F.struct(F.lit(k).alias("k"), a.alias("action")) for k, a in ((1, F.lit("accept")), (2, F.lit("accept")), (3, F.when(F.col("toxic") == 1, "reject").otherwise("dispute")))))
    out = rows.select("id", F.explode(acts).alias("x")).select("id", "x.k", "x.action")
    return out.withColumn("reviewer", F.when(F.col("id") % 11 != 0, F.lit("me"))).withColumn("decided_at", F.col("k").cast("long"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'disputed' END AS decision, CASE WHEN doc_id % 11 <> 0 THEN 3 END::BIGINT AS decided_at FROM labels")
def review_states(spark, t):
    return review.states(t("labels").select(F.col("doc_id").alias("id")), _decisions(t), ["k"]).select("id", "decision", "decided_at")


@query("SELECT doc_id AS id, 'accept' AS action, CASE WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'accepted' END AS state FROM labels UNION ALL SELECT doc_id, 'accept', 'pending' FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'dispute' END, 'pending' FROM labels WHERE doc_id % 11 = 0")
def review_refused(spark, t):
    return review.refused(_decisions(t), ["k"])


@query("SELECT doc_id AS id FROM labels WHERE doc_id % 11 = 0 ORDER BY doc_id % 7, doc_id LIMIT 20")
def review_queue(spark, t):
    rows = t("labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("created_at"))
    return review.queue(review.states(rows, _decisions(t), ["k"]), 20).select("id")


@query("SELECT * FROM (VALUES (4, 1), (9, 2), (2, 3), (7, NULL)) AS v(id, decided_at)")
def review_history(spark, t):
    rows = [(2, 9, 3), (4, None, 1), (9, 4, 2), (7, 2, None), (5, None, 1), (6, 5, 2)]
    return review.history(spark.createDataFrame(rows, "id int, supersedes_id int, decided_at int"), 9).select("id", "decided_at")


@query("SELECT DISTINCT sha256(lang || chr(31) || source) AS id FROM documents WHERE lang <> 'en'")
def review_enqueue(spark, t):
    pairs = t("documents").select("lang", "source")
    known = review.propose(spark.createDataFrame([], "id string"), pairs.filter("lang = 'en'"), ["lang", "source"])
    return review.propose(known, pairs, ["lang", "source"]).select("id")


@query("SELECT doc_id AS source, CASE WHEN n_chars / 2000.0 > 0.9 THEN 'high' WHEN n_chars / 2000.0 >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 ORDER BY n_chars DESC, doc_id LIMIT 100")
def verse_links(spark, t):
    links = t("documents").select(F.col("doc_id").alias("source"), F.col("lang").alias("target"), (F.col("n_chars") / 2000.0).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("suggested").alias("label"))
    return review.verse_links(links, "en").select("source", "band")


@query("SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'confirmed' END AS label FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'suggested' FROM labels WHERE doc_id % 2 = 1")
def link_decisions(spark, t):
    links = t("labels").select(F.col("doc_id").alias("id"), F.lit("suggested").alias("label"))
    events = t("labels").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("confirmed").alias("label")), F.struct(F.lit(2).alias("at"), F.when(F.col("toxic") == 1, "rejected").otherwise("confirmed").alias("label")))).alias("x")).select("id", "x.*")
    return review.decide_links(links, events)


@query("SELECT * FROM (VALUES ('a>b>d', 0), ('a>c>d', 0), ('', 1)) AS v(path, skipped)")
def isnad_trace(spark, t):
    edges = spark.createDataFrame([("a", "TRANSMITS", "b"), ("b", "TRANSMITS", "d"), ("a", "TRANSMITS", "c"), ("c", "TRANSMITS", "d"), ("a", "TRANSMITS", "x")], "src string, edge string, dst string")
    found, lost = review.trace(edges, spark.createDataFrame([(x,) for x in "abcd"], "id string"), "a", "d", graph.Budget(hops=2))
    return found.select(F.array_join("path", ">").alias("path"), F.lit(0).alias("skipped")).unionByName(lost.select(F.lit("").alias("path"), F.lit(1).alias("skipped")))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 20 THEN 20 + n_nationkey % 5 ELSE n_nationkey END AS current FROM nation")
def narrator_identities(spark, t):
    narrators = t("nation").select(F.col("n_nationkey").cast("long").alias("id"))
    events = narrators.filter("id < 20").withColumn("superseded_by", F.col("id") + 5)
    return review.identities(narrators, events)


@query("WITH RECURSIVE l(n, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT l.n + 5, depth + 1 FROM l WHERE l.n + 5 < 25) SELECT n::VARCHAR AS source, depth FROM l WHERE depth > 0")
def lineage_recursive(spark, t):
    parents = t("nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("child"), (F.col("n_nationkey") + 5).cast("string").alias("parent"))
    return review.lineage(parents, "0").select("source", "depth")
