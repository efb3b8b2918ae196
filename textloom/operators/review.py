"""Review of assertions, annotated projections, verse links, narrators and source lineage, as event tables and joins.

An assertion is never changed in place: decisions are events, and the state of an assertion is that of its last legal
event. A correction is a new assertion that supersedes another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import runtime
from textloom.functions import text as scalar
from textloom.operators import graph, ledger

#: Which decision may follow which; the first state is pending.
DECISIONS = {
    "accept": (("pending", "disputed"), "accepted"),
    "reject": (("pending", "disputed", "accepted"), "rejected"),
    "dispute": (("pending", "accepted"), "disputed"),
    "supersede": (("pending", "accepted", "disputed"), "superseded"),
}
EFFECTIVE = "accepted"


def states(assertions: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """(assertion columns, decision, reviewer, decided_at): the state that the legal decisions lead to.

    decisions: (id, action, reviewer, decided_at) and the order's columns. A decision that its state does not allow, or
    without a reviewer, changes nothing; `refused` lists them. The decisions of one assertion are few and are folded.
    """
    folded = _folded(decisions, order)
    out = assertions.join(folded.select("id", "decision", "reviewer", "decided_at"), "id", "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("pending")))


def refused(decisions: DataFrame, order: list[str]) -> DataFrame:
    """(id, action, state): decisions that the state before them did not allow."""
    return _folded(decisions, order).select("id", F.explode("refused").alias("r")).select("id", "r.*")


def _folded(decisions: DataFrame, order: list[str]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col("action").alias("act"), F.col("reviewer").alias("who"), F.col("decided_at").alias("at"))))
    kind = "array<struct<action:string,state:string>>"
    start = F.struct(F.lit("pending").alias("state"), F.lit(None).cast("string").alias("who"), F.lit(None).cast(decisions.schema["decided_at"].dataType).alias("at"), F.array().cast(kind).alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        following = F.lit(None).cast("string")
        for action, (before, after) in DECISIONS.items():
            following = F.when((x["act"] == action) & acc["state"].isin(*before), F.lit(after)).otherwise(following)
        legal = following.isNotNull() & (F.trim(F.coalesce(x["who"], F.lit(""))) != "")
        note = F.array(F.struct(x["act"].alias("action"), acc["state"].alias("state")))
        return F.struct(
            F.when(legal, following).otherwise(acc["state"]).alias("state"), F.when(legal, x["who"]).otherwise(acc["who"]).alias("who"), F.when(legal, x["at"]).otherwise(acc["at"]).alias("at"),
            F.when(legal, acc["refused"]).otherwise(F.concat(acc["refused"], note)).cast(kind).alias("refused"),
        )

    rows = decisions.groupBy("id").agg(F.aggregate(listed, start, step).alias("s"))
    return rows.select("id", F.col("s.state").alias("decision"), F.col("s.who").alias("reviewer"), F.col("s.at").alias("decided_at"), "s.refused")


def queue(reviewed: DataFrame, limit: int = 100) -> DataFrame:
    """Assertions that wait for a decision, oldest first."""
    return reviewed.filter("decision = 'pending'").orderBy("created_at", "id").limit(limit)


def history(reviewed: DataFrame, wanted: object) -> DataFrame:
    """The chain of assertions that supersede one another and hold the wanted one, by decision time then id (undecided last)."""
    links = reviewed.filter("supersedes_id IS NOT NULL").select(F.col("id").alias("src"), F.lit("SUPERSEDES").alias("edge"), F.col("supersedes_id").alias("dst"))
    seed = reviewed.filter(F.col("id") == wanted).select(F.col("id").alias("node"))
    chain = graph.distances(links, seed, 64).select(F.col("node").alias("id"))
    return reviewed.join(chain, "id", "left_semi").orderBy(F.asc_nulls_last("decided_at"), "id")


def propose(assertions: DataFrame, batch: DataFrame, fields: list[str]) -> DataFrame:
    """The batch with content-addressed ids, without what is known: proposing the same again is no change."""
    named = batch.withColumn("id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256))
    return named.dropDuplicates(["id"]).join(assertions.select("id"), "id", "left_anti")


def annotated(seed_nodes: DataFrame, seed_links: DataFrame, units: DataFrame, translations: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, skipped) of an annotated projection.

    seed_nodes (id, kind, label), seed_links (src, edge, dst), units (id) and translations (id) give nodes; links and
    what each unit is translated by are edges. Of the reviewed assertions (id, src, edge, dst, decision) only effective
    ones become edges. Edges off the vocabulary or with an unknown end are skipped and reported.
    """
    nodes = units.select("id", F.lit("ayah").alias("kind")).unionByName(seed_nodes.select("id", F.when(F.col("kind") == "theme", "concept").otherwise("entity").alias("kind"))).unionByName(translations.select("id", F.lit("entity").alias("kind"))).dropDuplicates(["id"])
    own = seed_links.select("src", "edge", "dst", F.lit("seed").alias("assertion_id"))
    # every unit with every translation: the translations are a short list
    covered = units.select(F.col("id").alias("src")).join(F.broadcast(translations.select(F.col("id").alias("dst"))), how="cross").select("src", F.lit("TRANSLATES").alias("edge"), "dst", F.lit("seed").alias("assertion_id"))
    asserted = reviewed.filter(F.col("decision") == EFFECTIVE).select("src", "edge", "dst", F.col("id").alias("assertion_id"))
    edges = own.unionByName(covered).unionByName(asserted).dropDuplicates(["src", "edge", "dst"])
    known = edges.filter(F.col("edge").isin(*graph.VOCABULARY))
    ends = nodes.select("id")
    inside = known.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
    return nodes, inside, edges.join(inside.select("src", "edge", "dst"), ["src", "edge", "dst"], "left_anti").select(edges.columns)


# ---- verse links ---------------------------------------------------------------------------------------------------


def verse_links(links: DataFrame, target: str, unconfirmed: bool = False, limit: int = 100) -> DataFrame:
    """Links to a verse by confidence, with their band; confirmed ones only unless asked."""
    rows = links.filter(F.col("target") == target)
    rows = rows if unconfirmed else rows.filter("label = 'confirmed'")
    return rows.withColumn("band", scalar.confidence_band(F.col("confidence"))).orderBy(F.desc("confidence"), "source").limit(limit)


def decide_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """The links with the label of their last decision (confirmed or rejected); a decided link takes no other suggestion."""
    last = ledger.latest(decisions, "id", ["at"], ["label"])
    return links.join(last.withColumnRenamed("label", "decided"), "id", "left").withColumn("label", F.coalesce("decided", "label")).drop("decided")


# ---- narrators and lineage -----------------------------------------------------------------------------------------


def trace(edges: DataFrame, narrators: DataFrame, source: str, target: str, budget: graph.Budget = graph.Budget()) -> tuple[DataFrame, DataFrame]:
    """(paths between narrators, edges that were skipped because an end is not loaded)."""
    lost = graph.dangling(edges, narrators.select(F.col("id").alias("node")))
    loaded = edges.join(lost.select("src", "edge", "dst"), ["src", "edge", "dst"], "left_anti")
    return graph.paths(loaded, source, target, budget), lost


def identities(narrators: DataFrame, events: DataFrame) -> DataFrame:
    """Narrators with the identity that stands for them now: events (id, superseded_by) are followed to their end."""
    links = events.select(F.col("id").alias("node"), F.col("superseded_by").alias("next"))
    now = runtime.stored(narrators.select("id", F.col("id").alias("current")), "identities")
    while True:
        moved = now.join(links.withColumnRenamed("node", "current"), "current", "left").select("id", F.coalesce("next", "current").alias("current"), F.col("next").isNotNull().alias("moved"))
        moved = runtime.stored(moved, "identities")
        if moved.filter("moved AND id = current").limit(1).count():
            raise ValueError("identities supersede one another in a circle")
        now = moved.select("id", "current")
        if moved.filter("moved").isEmpty():
            return now


def lineage(parents: DataFrame, wanted: str, max_depth: int = 64) -> DataFrame:
    """(source, depth, path) of all ancestors of a source; (child, parent) rows that lead back to a source on their own path are an error."""
    front = parents.filter(F.col("child") == wanted).select(F.col("parent").alias("source"), F.array(F.lit(wanted), "parent").alias("path"))
    out, depth = None, 1
    while True:
        front = runtime.stored(front.withColumn("depth", F.lit(depth)), "lineage")
        if front.filter(F.size(F.array_distinct("path")) < F.size("path")).limit(1).count():
            raise ValueError("the lineage has a cycle")
        out = front if out is None else out.unionByName(front)
        if depth == max_depth or front.isEmpty():
            return out.select("source", "depth", "path")
        front = front.join(parents, front["source"] == parents["child"]).select(F.col("parent").alias("source"), F.concat("path", F.array("parent")).alias("path"))
        depth += 1
