"""Connected components of a table of links, by minimum labels and pointer jumping.

Every round gives a node the smallest label among itself and its neighbours, then follows labels once; rounds are
written to the shared folder, so lost executors cost one round at most. Labels only fall, so the rounds end; following
labels makes them few for long chains as well. Links may repeat and point either way; those with a null end are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import runtime


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b) links; root is the smallest node of the component."""
    edges = runtime.stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct().toDF("node", "other"), "links")
    labels = runtime.stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("other"), F.col("root").alias("near")), "other")
        lower = seen.groupBy("node").agg(F.min("near").alias("near"))
        met = labels.join(lower, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("next"))
        new = met.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("next", "mid")).alias("root"))
        new = runtime.stored(new, "labels")
        runtime.drop(labels)
        labels = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return labels
