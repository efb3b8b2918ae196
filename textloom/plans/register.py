"""The register of queries: `@query(sql)` puts a function (spark, tables) under its own name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom import runtime
from textloom.operators import index

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"list_filter(regexp_split_to_array({}, '[\x{{09}}-\x{{0D}}\x{{20}}]+'), lambda x: x <> '')"


def words(text: str) -> str:
    return WORDS.format(text)


#: Documents with their lower-cased words, as SQL.
W = f"(SELECT doc_id, lang, source, {words('lower(text)')} AS w FROM documents)"


class Source:
    """The tables of one directory: called with a name it reads a table; `text` and `skeletons` are its stored indexes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def text(self) -> index.TextIndex:
        """The index over documents; the first query of an application builds it, later ones read it."""
        return _built(self, "text", lambda folder: index.TextIndex.at(self.spark, folder, "doc_id", ("lang", "source")), "documents")

    def skeletons(self) -> index.SkeletonIndex:
        return _built(self, "skeletons", lambda folder: index.SkeletonIndex.at(self.spark, folder, "conv_id", "turn"), "conversations")


_BUILT: dict[tuple[str, str, str], object] = {}


def _built(source: Source, kind: str, open_at, table: str):
    key = (source.spark.sparkContext.applicationId, source.sf_dir, kind)
    if key not in _BUILT:
        found = open_at(runtime.fresh_dir(source.spark, f"index-{kind}"))
        found.build(source(table))
        _BUILT[key] = found
    return _BUILT[key]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, Source], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, Source(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
