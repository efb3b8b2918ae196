"""Audit chains, queues, caches and limits over an ordered event table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLAIMABLE = ("queued", "interrupted", "checkpointed")


def sequence_gaps(log: DataFrame, sequence: str) -> DataFrame:
    """(sequence, previous) where the log does not go on by one. Neighbours are found by a join on sequence - 1, so no global window is needed."""
    present = log.select(F.col(sequence).alias("previous"))
    first = log.agg(F.min(sequence).alias("first"))
    heads = log.select(sequence).withColumn("before", F.col(sequence) - 1).join(present, F.col("before") == F.col("previous"), "left_anti")
    return heads.join(F.broadcast(first)).filter(F.col(sequence) > F.col("first")).select(sequence)


def chain_hashes(log: DataFrame, sequence: str, payload: Column) -> DataFrame:
    """(sequence, entry_hash): what each entry of a hash chain hashes besides its predecessor's hash."""
    return log.select(sequence, F.sha2(F.concat_ws("|", F.col(sequence).cast("string"), payload), 256).alias("entry_hash"))


def append(last: tuple[int, str] | None, entries: list[tuple[str, str]]) -> list[tuple[int, str, str, str]]:
    """(sequence, payload, previous_hash, chain_hash) of new entries (kind, payload) after the last one: each hash covers its predecessor's.

    A chain is extended by its one writer, entry after entry, so this runs where the entries are.
    """
    sequence, previous = last or (0, "0" * 64)
    out = []
    for kind, payload in entries:
        sequence += 1
        own = hashlib.sha256(f"{previous}|{sequence}|{kind}|{payload}".encode()).hexdigest()
        out.append((sequence, f"{kind}|{payload}", previous, own))
        previous = own
    return out


def verify_chain(log: DataFrame, sequence: str = "sequence", payload: str = "payload", previous: str = "previous_hash", own: str = "chain_hash") -> DataFrame:
    """(sequence, problem) of a hash-chained log: a gap, a link to another predecessor, or an entry whose hash is not its own."""
    gaps = sequence_gaps(log, sequence).select(sequence, F.lit("gap").alias("problem"))
    links = verify_links(log, sequence, previous, own).select(sequence, F.lit("link").alias("problem"))
    hashes = log.filter(F.sha2(F.concat_ws("|", previous, F.col(sequence).cast("string"), payload), 256) != F.col(own)).select(sequence, F.lit("hash").alias("problem"))
    return gaps.unionByName(links).unionByName(hashes)


def settle(jobs: DataFrame, results: DataFrame, now: Column, base: float, cap: float, max_attempts: int) -> DataFrame:
    """The jobs after a round of work: results (id, ok, error, fraction) finish a job, put it off by a jittered backoff, or, at the last attempt, into the dead letters."""
    from textloom.functions import text as scalar

    joined = jobs.join(results, "id", "left")
    attempts = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), "done").when(attempts >= max_attempts, "dead_letter").otherwise("queued")
    wait = scalar.backoff(F.lit(base), (attempts - 1).cast("double"), cap, 0.1, F.coalesce("fraction", F.lit(0.5)))
    later = F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long"))
    available = F.when(state.eqNullSafe("queued") & F.col("ok").isNotNull(), later).otherwise(F.col("available_at"))
    kept = [c for c in jobs.columns if c not in ("attempts", "state", "available_at")]
    return joined.select(*kept, attempts.alias("attempts"), state.alias("state"), available.alias("available_at"))


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs with those whose lease ran out claimable again."""
    gone = (F.col("state") == "running") & (F.col("lease_until") < now)
    return jobs.withColumn("state", F.when(gone, "interrupted").otherwise(F.col("state"))).withColumn("lease_until", F.when(~gone, F.col("lease_until")))


def verify_links(chain: DataFrame, sequence: str, previous_hash: str, own_hash: str) -> DataFrame:
    """Entries whose stored predecessor hash is not that of the entry before."""
    before = chain.select((F.col(sequence) + 1).alias(sequence), F.col(own_hash).alias("expected"))
    return chain.join(before, sequence).filter(~F.col(previous_hash).eqNullSafe(F.col("expected"))).select(sequence)


def claim(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The next jobs: claimable, available, by priority descending, then availability and id."""
    return jobs.filter(F.col("state").isin(*CLAIMABLE) & (F.col("available_at") <= now)).orderBy(F.desc("priority"), "available_at", "id").limit(limit)


def expired(leases: DataFrame, now: Column) -> DataFrame:
    return leases.filter((F.col("state") == "running") & (F.col("lease_until") < now))


def evict(cache: DataFrame, cap: int, group: list[str], recency: str, size: str, key: str) -> DataFrame:
    """Entries of each group beyond the running total of `cap` bytes, most recently hit first."""
    w = Window.partitionBy(*group).orderBy(F.desc(recency), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cache.withColumn("running", F.sum(size).over(w)).filter(F.col("running") > cap)


def rate_limited(calls: DataFrame, principal: str, at: str, limit: int, seconds: int, key: str) -> DataFrame:
    """Calls with more than `limit` calls of the principal in the `seconds` that end with them."""
    micros = F.unix_micros(F.col(at))
    w = Window.partitionBy(principal).orderBy("micros").rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return calls.withColumn("micros", micros).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") > limit).select(key, principal, "n")


def latest(events: DataFrame, entity: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last state of each entity of an event log."""
    return events.groupBy(entity).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(entity, "s.*")


def transitions(events: DataFrame, entity: str, order: list[str], state: str, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Events whose change of state is not allowed; None stands for the start."""
    w = Window.partitionBy(entity).orderBy(*order)
    before = F.lag(state).over(w)
    legal = F.lit(False)
    for a, b in allowed:
        legal = legal | ((before.isNull() if a is None else before == a) & (F.col(state) == b))
    return events.withColumn("before", before).withColumn("legal", F.coalesce(legal, F.lit(False))).filter("NOT legal").drop("legal")


def pending(outbox: DataFrame, limit: int) -> DataFrame:
    return outbox.filter("state = 'pending'").orderBy("created_at", "id").limit(limit)


def keep_generations(builds: DataFrame, family: str, generation: str, keep: int) -> DataFrame:
    """Generations to remove: all but the newest `keep` of each family."""
    w = Window.partitionBy(family).orderBy(F.desc(generation))
    return builds.withColumn("age", F.dense_rank().over(w)).filter(F.col("age") > keep).drop("age")


def not_buried(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(key), key, "left_anti")
