"""Vector and hybrid retrieval, federation over domains, and citation checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from textloom.functions import text as scalar

RRF_K = 60


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k nearest by cosine, score descending then id. Each batch of vectors is one product with the query
    and keeps its own k best, so few rows are sorted. Vectors of other lengths meet the query over the shorter one."""
    wanted = np.asarray(query, np.float64)
    rows = vectors.select(id_col, F.coalesce(F.col(vec_col), F.array().cast(vectors.schema[vec_col].dataType)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat, first = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
            score = np.zeros(len(size))
            for n in np.unique(size[size > 0]).tolist():
                at, m = np.flatnonzero(size == n), min(n, len(wanted))
                some, part = flat[first[at][:, None] + np.arange(m)], wanted[:m]
                norm = np.linalg.norm(some, axis=1) * np.linalg.norm(part)
                score[at] = np.divide(some @ part, norm, out=np.zeros(len(at)), where=norm > 0)
            if len(score) > k:  # all that tie with the k-th stay
                kept = pa.array(np.flatnonzero(score >= np.partition(score, -k)[-k]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), pa.array(score).take(kept)], [id_col, "score"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [id_col, "score"])

    schema = StructType([rows.schema[id_col], *StructType.fromDDL("score double")])
    return rows.mapInArrow(run, schema).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, id_col: str, score: str, limit: int = 1000) -> DataFrame:
    """(id, rank) of the best hits, from 1; at most `limit`, so the ranking's single partition is bounded."""
    top = hits.orderBy(F.desc(score), id_col).limit(limit)
    return top.select(id_col, F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias("rank"))


def rrf(rankings: Sequence[DataFrame], id_col: str, k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal-rank fusion, the sum of 1 / (k + rank)."""
    merged = rankings[0].select(id_col, "rank")
    for one in rankings[1:]:
        merged = merged.unionByName(one.select(id_col, "rank"))
    return merged.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def rerank(rows: DataFrame, score: str, id_col: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(score), id_col).limit(limit)


def active(docs: DataFrame, sources: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Documents of active sources."""
    return docs.join(sources.filter(F.col(status) == "active").select(key).distinct(), key, "left_semi")


def federate(searchers: dict[str, Callable[[], DataFrame]], domains: Sequence[str] | None = None) -> DataFrame:
    """(domain, source, score) of the chosen domains, score descending, then domain and source; errors are not swallowed."""
    chosen = list(searchers) if domains is None else list(domains)
    if unknown := [d for d in chosen if d not in searchers]:
        raise KeyError(f"unknown domains {unknown}")
    if not chosen:
        raise ValueError("no domain is chosen")
    parts = [searchers[d]().select(F.lit(d).alias("domain"), F.col("source").cast("string").alias("source"), F.col("score").cast("double").alias("score")) for d in chosen]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out.orderBy(F.desc("score"), "domain", "source")


def verify_citations(citations: DataFrame, texts: DataFrame, key: str, quoted: str, text_col: str) -> DataFrame:
    """(key, verdict, first_difference): exact, whitespace, mismatch or not_found for each quotation."""
    joined = citations.join(texts.select(key, F.col(text_col).alias("actual"), F.lit(True).alias("found")), key, "left")
    a, b = F.col(quoted), F.col("actual")
    verdict = F.when(F.col("found").isNull(), "not_found").when(a == b, "exact").when(scalar.whitespace_equal(a, b), "whitespace").otherwise("mismatch")
    size = F.least(F.length(a), F.length(b))
    common = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(a, i, 1) == F.substring(b, i, 1)), False)
    where = F.when(verdict == "mismatch", F.when(common > 0, common - 1).otherwise(size.cast("long")))
    return joined.select(key, verdict.alias("verdict"), where.alias("first_difference"))


def metadata_equals(column: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (column[k] == v)
    return out
