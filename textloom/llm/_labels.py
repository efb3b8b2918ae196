"""Bounded, deterministic samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most max_rows labelled documents, half of them of either class at most, and about max_bytes.

    Documents are taken in the order of a hash of their id and text, and of a repeated id the text of the least hash, so
    the sample does not depend on the partitioning.
    """
    known = labels.select(F.col(id_col).alias("s_id"), F.col(label).cast("int").alias("s_label")).filter("s_id IS NOT NULL AND s_label IN (0, 1)")
    known = known.groupBy("s_id").agg(F.max("s_label").alias("s_label"))
    if allowed is not None:
        known = known.filter(allowed)
    order = F.xxhash64(F.col("s_id").cast("string"))
    halves = [known.filter(F.col("s_label") == k).orderBy(order, "s_id").limit(max_rows // 2) for k in (0, 1)]
    # at most max_rows ids, so the side is bounded
    chosen = F.broadcast(halves[0].unionByName(halves[1]))
    rows = docs.select(F.col(id_col).alias("s_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("s_text")).join(chosen, "s_id")
    first = F.min(F.struct(F.xxhash64("s_id", "s_text").alias("s_rank"), "s_text"))
    rows = rows.groupBy("s_id", "s_label").agg(first.alias("s")).select("s_id", "s_label", "s.*").orderBy("s_rank", "s_id")
    found, size = [], 0
    for row in rows.toLocalIterator():
        found.append((row["s_text"], row["s_label"]))
        size += len(row["s_text"])
        if size >= max_bytes:
            break
    return found
