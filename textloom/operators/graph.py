"""A directed, labelled graph as node and edge tables, with bounded traversals.

Edges are (src, edge, dst). Traversals go by levels of frontier joins with anti-joined visits; hops are capped, and a
result that a budget cut says so. Edges are followed both ways unless a direction is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import runtime

DIRECTIONS = ("out", "in", "any")
# The names that edges may have, and the ranges and defaults of a budget.
VOCABULARY = (
    "CONTAINS", "NEXT", "MENTIONS_CONCEPT", "REFERS_TO", "MENTIONS", "CITES", "CONTRASTS_WITH", "PARALLELS", "EXPLAINS", "TRANSLATES", "RELATED_TO", "SUPPORTED_BY", "DISPUTED_BY",
    "HAS_LEMMA", "HAS_ROOT", "HAS_STEM", "DERIVED_FROM", "SAME_ROOT_AS", "SAME_LEMMA_AS", "TRANSMITS", "NARRATES",
)
RANGES = {"hops": (1, 32), "nodes": (1, 100_000), "paths": (1, 1000), "edges": (1, 200_000), "fanout": (1, 10_000)}


@dataclass(frozen=True)
class Budget:
    hops: int = 6
    nodes: int = 500
    paths: int = 10
    edges: int = 2000
    fanout: int = 128

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} lies between {low} and {high}")


@dataclass(frozen=True)
class Traversal:
    """What a bounded query found, and why it is not everything, if so."""

    nodes: DataFrame
    edges: DataFrame
    reason: str | None = None

    @property
    def truncated(self) -> bool:
        return self.reason is not None


def resolve(nodes: DataFrame, node: str) -> DataFrame:
    """The row of one node; an error for an unknown one."""
    found = nodes.filter(F.col("node") == node)
    if found.isEmpty():
        raise KeyError(f"unknown node {node}")
    return found


def steps(edges: DataFrame, direction: str = "any", kinds: list[str] | None = None) -> DataFrame:
    """(node, edge, other): the edges as steps."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if kinds is not None:
        edges = edges.filter(F.col("edge").isin(kinds))
    out = edges.select(F.col("src").alias("node"), "edge", F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("node"), "edge", F.col("src").alias("other"))
    return {"out": out, "in": back, "any": out.union(back)}[direction]


def neighbours(edges: DataFrame, node: str, direction: str = "any", kinds: list[str] | None = None, fanout: int = 128) -> DataFrame:
    """(edge, other) of one node in the order of edge and neighbour, at most fanout."""
    return steps(edges, direction, kinds).filter(F.col("node") == node).select("edge", "other").distinct().orderBy("edge", "other").limit(fanout)


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int, direction: str = "any", kinds: list[str] | None = None) -> DataFrame:
    """(node, hops) of everything within max_hops of the seeds (a table with a column node)."""
    moves = steps(edges, direction, kinds).select("node", "other")
    seen = runtime.stored(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "visited")
    front = seen
    for hop in range(1, max_hops + 1):
        found = front.select("node").join(moves, "node").select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = runtime.stored(found.withColumn("hops", F.lit(hop)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bounded(edges: DataFrame, node: str, hops: int, budget: Budget = Budget(), direction: str = "any", kinds: list[str] | None = None) -> Traversal:
    """Nodes (node, hops) within `hops` of one and the edges between them, under a budget that caps each expansion.

    Each node is expanded by its first `fanout` steps in the order of edge and neighbour; levels go on until the nodes or
    the edge relaxations are used up, nodes that are over being cut in the order of their ids. The reason tells what was cut.
    """
    spark, moves = edges.sparkSession, steps(edges, direction, kinds)
    seen = runtime.stored(spark.createDataFrame([(node, 0)], "node string, hops int"), "bounded")
    front, reason, n_nodes, n_edges = seen, None, 1, 0
    order = Window.partitionBy("node").orderBy("edge", "other")
    for hop in range(1, min(hops, budget.hops) + 1):
        around = moves.join(F.broadcast(front.select("node")), "node").distinct()  # a level has at most budget.nodes rows
        ranked = runtime.stored(around.withColumn("k", F.row_number().over(order)), "expanded")
        if ranked.filter(F.col("k") > budget.fanout).limit(1).count():
            reason = reason or f"fanout exceeds {budget.fanout}"
        taken = ranked.filter(F.col("k") <= budget.fanout)
        n = taken.count()
        if n_edges + n > budget.edges:
            reason = reason or f"edges exceed {budget.edges}"
            taken = taken.orderBy("node", "edge", "other").limit(budget.edges - n_edges)
        n_edges = min(budget.edges, n_edges + n)
        fresh = taken.select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = runtime.stored(fresh.orderBy("node").limit(budget.nodes - n_nodes + 1).withColumn("hops", F.lit(hop)), "level")
        n = fresh.count()
        if n > budget.nodes - n_nodes:
            reason = reason or f"nodes exceed {budget.nodes}"
            fresh, n = fresh.orderBy("node").limit(budget.nodes - n_nodes), budget.nodes - n_nodes
        n_nodes += n
        seen, front = seen.unionByName(fresh), fresh
        if not n or n_edges >= budget.edges or n_nodes >= budget.nodes:
            break
    if reason is None and hops > budget.hops:
        reason = f"hops exceed {budget.hops}"
    seen = runtime.stored(seen, "bounded")
    return Traversal(seen, subgraph(edges if kinds is None else edges.filter(F.col("edge").isin(kinds)), seen), reason)


def explain(edges: DataFrame, assertions: DataFrame, builds: DataFrame | None = None) -> DataFrame:
    """(src, edge, dst, provenance, assertion_id, reviewer, confidence): where each edge comes from; an assertion that is not known is said to be missing."""
    known = assertions.select(F.col("id").alias("assertion_id"), "reviewer", "confidence", F.lit(True).alias("known"))
    rows = edges.join(known, "assertion_id", "left")
    provenance = F.when(F.col("assertion_id").isNull(), "structural").when(F.col("known"), "assertion").otherwise("missing")
    return rows.select("src", "edge", "dst", provenance.alias("provenance"), "assertion_id", "reviewer", "confidence")


def explain_path(path: list[str], edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """(step, src, edge, dst, provenance, ...) of the edges between neighbours of a path, either way."""
    pairs = edges.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "step int, a string, b string")
    rows = explain(edges, assertions)
    both = (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")) | (F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))
    ends = rows.filter(F.col("src").isin(path) & F.col("dst").isin(path))
    return ends.join(F.broadcast(pairs), both).drop("a", "b").orderBy("step", "edge")


def quarantine(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends are known, the others): a repair that loses nothing."""
    lost = dangling(edges, nodes).select("src", "edge", "dst").distinct()
    return edges.join(lost, ["src", "edge", "dst"], "left_anti"), edges.join(lost, ["src", "edge", "dst"], "left_semi")


def verify_build(nodes: DataFrame, edges: DataFrame, staged_nodes: int, staged_edges: int) -> list[str]:
    """What is wrong with a built projection: counts that are not the staged ones, edges without an end, names off the vocabulary."""
    problems = []
    if (n := nodes.count()) != staged_nodes:
        problems.append(f"{n} nodes of {staged_nodes}")
    if (n := edges.count()) != staged_edges:
        problems.append(f"{n} edges of {staged_edges}")
    if not dangling(edges, nodes).isEmpty():
        problems.append("dangling edges")
    if not edges.filter(~F.col("edge").isin(*VOCABULARY)).isEmpty():
        problems.append("edges off the vocabulary")
    return problems


def fingerprint(edges: DataFrame) -> str:
    """A hash of a set of edges that does not depend on their order, by which an unchanged projection is skipped."""
    row = edges.select(F.xxhash64("src", "edge", "dst").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['s']}"


def publish(table, nodes: DataFrame, edges: DataFrame) -> tuple[int, bool]:
    """(generation, whether it is new) of a projection in a store.VersionedTable of edges: reserve, stage, verify, flip; the same edges again are skipped."""
    staged = runtime.stored(edges.select("src", "edge", "dst").distinct(), "projection")
    current = table.current()
    if current is not None and fingerprint(table.read()) == fingerprint(staged):
        return current, False
    if problems := verify_build(nodes, staged, nodes.count(), staged.count()):
        raise ValueError(f"the projection is not published: {', '.join(problems)}")
    return table.publish(staged), True


def min_hops(edges: DataFrame, source: DataFrame, target: str, max_hops: int, direction: str = "any") -> int | None:
    row = distances(edges, source, max_hops, direction).filter(F.col("node") == target).first()
    return None if row is None else row["hops"]


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the given nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "edge", "dst")


def paths(edges: DataFrame, source: str, target: str, budget: Budget = Budget(), direction: str = "any") -> DataFrame:
    """(hops, path): simple paths in order of length and nodes, at most budget.paths. Only nodes that can still reach the target in time are extended."""
    spark = edges.sparkSession
    order = Window.partitionBy("node").orderBy("other")
    moves = steps(edges, direction).select("node", "other").distinct()
    back = {"out": "in", "in": "out", "any": "any"}[direction]
    left = distances(edges, spark.createDataFrame([(target,)], "node string"), budget.hops, back).withColumnRenamed("node", "other").withColumnRenamed("hops", "left")
    useful = runtime.stored(moves.join(left, "other").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= budget.fanout), "useful")
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    found = None
    for hop in range(1, budget.hops + 1):
        front = front.join(useful.filter(F.col("left") <= budget.hops - hop), "node").filter(~F.array_contains("path", F.col("other")))
        front = runtime.stored(front.select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")), "paths")
        done = front.filter(F.col("node") == target).select(F.lit(hop).alias("hops"), "path")
        found = done if found is None else found.unionByName(done)
        if found.limit(budget.paths).count() == budget.paths:  # longer ones come after
            break
        front = front.filter(F.col("node") != target).orderBy("path").limit(budget.edges)
    return found.orderBy("hops", "path").limit(budget.paths)


def pattern(edges: DataFrame, seeds: DataFrame, chain: list[tuple[str, str]], allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(n0, n1, ...): walks from the seeds along (edge kind, direction) steps, one to eight of them, of the allowed kinds where given."""
    if isinstance(chain, str):
        raise ValueError("a pattern is a list of steps, not a text")
    if not 1 <= len(chain) <= 8:
        raise ValueError("a pattern has 1 to 8 steps")
    rows = seeds.select(F.col("node").alias("n0"))
    for k, (kind, direction) in enumerate(chain):
        if direction not in ("out", "in"):
            raise ValueError("a step goes out or in")
        if allowed is not None and kind not in allowed:
            raise ValueError(f"unknown edge {kind}")
        move = steps(edges, direction, [kind]).select(F.col("node").alias(f"n{k}"), F.col("other").alias(f"n{k + 1}"))
        rows = rows.join(move, f"n{k}")
    return rows.select(*(f"n{k}" for k in range(len(chain) + 1)))


def sequence_edges(rows: DataFrame, group: list[str], order: str, node: str, edge: str = "NEXT") -> DataFrame:
    """(src, edge, dst) from each row to the next of its group."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("dst", F.lead(node).over(w)).filter("dst IS NOT NULL").select(F.col(node).alias("src"), F.lit(edge).alias("edge"), "dst")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select(F.col("node"))
    lost_src = edges.join(known.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "edge", "dst", F.lit("src").alias("missing"))
    lost_dst = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "edge", "dst", F.lit("dst").alias("missing"))
    return lost_src.unionByName(lost_dst)


def visible(edges: DataFrame, assertions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Structural edges, and asserted ones whose assertion is accepted and, under a scope, listed. An assertion that is not known hides its edge under a scope."""
    known = assertions.select(F.col("id").alias("assertion_id"), "decision")
    joined = edges.join(known, "assertion_id", "left")
    inside = F.col("decision") == "accepted"
    inside = F.col("decision").isNull() | inside if scope is None else inside & F.col("assertion_id").isin(scope)
    return joined.filter(F.col("assertion_id").isNull() | F.coalesce(inside, F.lit(False))).select(edges.columns)


def export_json(nodes: DataFrame, edges: DataFrame, notice: str | None = None) -> DataFrame:
    """Lines of JSON: a header with counts and, where a traversal was cut, its notice, then nodes and edges, one each; a sink writes them as text."""
    header = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))
    head = header.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("graph-json-v1").alias("format"), "nodes", "edges", F.lit(notice is not None).alias("truncated"), F.lit(notice).alias("notice"))).alias("line"))
    return head.unionByName(nodes.select(F.lit(1).alias("part"), F.to_json(F.struct(*nodes.columns)).alias("line"))).unionByName(edges.select(F.lit(2).alias("part"), F.to_json(F.struct(*edges.columns)).alias("line")))
