"""The opN queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import runtime

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM g
"""

TOKENIZER = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labelled rows with this remainder are never trained on by op1.
FOLDS = 5


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality_classifier

    docs = table(spark, sf_dir, "documents")
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), allowed=F.crc32(F.col("s_id").cast("string")) % FOLDS != 0)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out")
    rows = quality_classifier.score(docs, net)
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import token_files

    folder = runtime.fresh_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary())
    return token_files.read(spark, folder)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import url_filters

    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, url_filters.RULES))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality_rules

    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.selectExpr("doc_id", *(f"q_{c} AS {c}" for c in counts), "base_failed", "kept", "host_rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import warc

    folder = runtime.fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_ngram_join": op2_ngram_join,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_url_filters": op4_url_filters,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontaminate": op7_decontaminate,
        "op8_token_files": op8_token_files,
        "op9_toxicity": op9_toxicity,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    from textloom.llm import licenses, quality_rules, url_filters

    return {
        "op4_url_filters": url_filters.ORACLE_SQL,
        "op5_license_scan": licenses.oracle_sql(),
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op10_warc": WARC_SQL,
    }
