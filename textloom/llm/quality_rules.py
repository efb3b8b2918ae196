"""Document rules and host-level rules.

`base` counts the words, symbols, repeated lines and repeated word windows of whole texts. A document's own rules
(LIMITS) come from these counts. `hosts` aggregates the failures by host, fits a beta prior to the hosts' rates by the
method of moments and shrinks each rate towards it; a host whose shrunk rate reaches `reject_rate` is rejected. `judge`
joins the verdicts back: a document that fails a rule goes; on a rejected host it also goes if it fails a rule at
`strict` times its limit. Clean documents of a rejected host therefore stay.

Null and empty texts have no words and fail the base rule. A null host is a host of its own. Repeated rows count and
are returned once each. An empty table gives no rows. Extra columns of any name are kept by `keep` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom import runtime

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
NO_HOST = "\x00"
#: Rows of host verdicts that may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def count_texts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text of a slab."""
    from textloom.llm import _text as text

    n = len(off) - 1
    filled = ~text.SPACE[data]
    starts, ends, first = text.spans(filled, off)

    def sums(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    chars = sums(filled & ((data & 0xC0) != 0x80))
    symbols = sums(symbol[data])

    line_start, line_end, line_first = text.spans(data != 0x0A, off)
    own = text.owners(line_first)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    key = text.mix(text.span_hashes(data, line_start, line_end) + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[worded]
    lines = np.bincount(own[worded], minlength=n)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup_lines = np.bincount(own[worded][again], minlength=n)

    at, h = text.windows(text.span_hashes(data, starts, ends), first, 5)
    word_own = text.owners(first)
    key = text.mix(h + word_own[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(starts) + 6, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    covered = np.cumsum(edge)[: len(starts)] > 0
    repeated = np.bincount(word_own[covered], minlength=n)
    return [np.diff(first), chars, symbols, dup_lines, repeated, lines]


def base(docs: DataFrame, columns: list[str], text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every row: its `columns` in the struct `row`, so that their names are free, its host and COUNTS as q_*."""
    runtime.ship(docs.sparkSession)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST))
    named = docs.select(F.struct(*columns).alias("row") if columns else F.struct(F.lit(0).alias("none")).alias("row"), host.alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*named.schema.fields[:2], *StructType.fromDDL(", ".join(f"q_{c} long" for c in COUNTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm import _text as text

        for batch in batches:
            for row, data, off in text.slabs(batch.column(2)):
                found = [pa.array(x, pa.int64()) for x in count_texts(data, off)]
                kept = [batch.column(k).slice(row, len(off) - 1) for k in range(2)]
                yield pa.RecordBatch.from_arrays(kept + found, ["row", "host", *(f"q_{x}" for x in COUNTS)])

    return named.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))


def fails(strict: int = 1) -> Column:
    """The document's own rules; limits are divided by `strict`. Integers only, so every engine agrees."""
    words = F.col("q_n_words")
    symbols = 100 * strict * F.col("q_n_symbols") > 10 * words
    lines = 100 * strict * F.col("q_n_dup_lines") > 30 * F.col("q_n_lines")
    length = (F.col("q_word_chars") < 2 * words) | (F.col("q_word_chars") > 15 * words)
    return base_failed() | symbols | (lines & (F.col("q_n_lines") >= 5)) | length


def hosts(counts: DataFrame, reject_rate: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, rejected): rate is the posterior mean under the fitted beta prior."""
    by = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(fails().cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    prior = by.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"))
    mean, spread = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    strength = F.when(F.col("var") > 0, F.least(F.greatest(spread / F.col("var") - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    prior = prior.select(mean.alias("prior_mean"), strength.alias("prior_n"))
    # the prior is one row
    shrunk = by.join(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("prior_mean") * F.col("prior_n")) / (F.col("n") + F.col("prior_n")))
    return shrunk.select("host", "n", "failed", "rate", (F.col("rate") >= reject_rate).alias("rejected"))


def judged(counts: DataFrame, verdicts: DataFrame, strict: int = 2) -> DataFrame:
    """The counted rows with base_failed, host_rate, host_rejected and kept."""
    few = verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    side = verdicts.select("host", F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"))
    joined = counts.join(F.broadcast(side) if few else side, "host", "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(fails() | (F.col("host_rejected") & fails(strict))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document with its counts and verdict: doc_id, host, q_* for COUNTS, base_failed, host_rate, host_rejected, kept."""
    counts = runtime.stored(base(docs, [id_col], text_col, host_col), "rule-counts")
    rows = judged(counts, runtime.stored(hosts(counts), "host-verdicts"))
    return rows.select(F.col("row").getField(id_col).alias("doc_id"), *(c for c in rows.columns if c != "row"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that stay, with their columns. Texts are read twice rather than shuffled."""
    verdicts = runtime.stored(hosts(base(docs, [], text_col, host_col)), "host-verdicts")
    return judged(base(docs, list(docs.columns), text_col, host_col), verdicts).filter("kept").select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS win FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, coalesce(source, chr(0)) AS host, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        word_chars < 2 * n_words OR word_chars > 15 * n_words AS odd FROM c),
v AS (SELECT *, base_failed OR odd OR 100 * n_symbols > 10 * n_words OR (n_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines) AS fails,
        base_failed OR odd OR 200 * n_symbols > 10 * n_words OR (n_lines >= 5 AND 200 * n_dup_lines > 30 * n_lines) AS fails_strict FROM f),
h AS (SELECT host, count(*) AS n, sum(fails::INT) AS failed FROM v GROUP BY host),
m AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS var FROM h),
prior AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1.0), 1000.0) ELSE 1000.0 END AS k FROM m),
verdict AS (SELECT host, (failed + mean * k) / (n + k) >= 0.5 AS rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (fails OR (rejected AND fails_strict)) AS kept, rejected AS host_rejected
FROM v JOIN verdict USING (host)
"""
