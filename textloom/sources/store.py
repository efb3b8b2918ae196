"""Versioned tables: generations of Parquet that are staged, validated and published by a pointer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

class Pointer:
    """A log of published generations, one file for each turn. A turn's file is created where none is, so of two publishers one fails."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._where = jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[tuple[int, int, int | None]]:
        """(turn, generation, the generation before) in order."""
        if not self._fs.exists(self._where):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._where))
        out: list[tuple[int, int, int | None]] = []
        for name in names:
            turn, generation = (int(x) for x in name.split("."))
            out.append((turn, generation, out[-1][1] if out else None))
        return out

    def current(self) -> int | None:
        log = self.log()
        return log[-1][1] if log else None

    def point(self, generation: int, turn: int | None = None) -> None:
        """Publish a generation as the next turn, or as the turn that the caller has seen to be next."""
        seen = self.log()
        turn = len(seen) if turn is None else turn
        if turn != len(seen):
            raise RuntimeError(f"turn {turn} is taken: another publisher was first")
        jvm = self.spark.sparkContext._jvm
        self._fs.mkdirs(self._where)
        lock = jvm.org.apache.hadoop.fs.Path(f"{self.folder}.turns/{turn:08d}")
        try:
            self._fs.create(lock, False).close()
        except Exception as error:
            raise RuntimeError(f"turn {turn} is taken: another publisher was first") from error
        self._fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{turn:08d}.{generation}"), False).close()

    def rollback(self) -> int:
        """Publish the generation before the current one."""
        log = self.log()
        if not log or log[-1][2] is None:
            raise ValueError("no generation to go back to")
        self.point(log[-1][2])
        return log[-1][2]


class VersionedTable:
    """Generations below one folder; readers follow the last turn of the pointer."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointer = Pointer(spark, f"{self.folder}/pointer")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def current(self) -> int | None:
        return self.pointer.current()

    def stage(self, rows: DataFrame, generation: int) -> str:
        path = f"{self.folder}/generation={generation}"
        rows.write.mode("errorifexists").parquet(path)
        return path

    def publish(self, rows: DataFrame, validate: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Stage the next generation and point to it; findings of severity error or fatal stop it before readers see it.

        Of two publishers that stage at once, the one that points first wins and the other fails with its stage unseen.
        """
        log = self.pointer.log()
        generation = max((g for _, g, _ in log), default=0) + 1
        while self._exists(f"{self.folder}/generation={generation}"):
            generation += 1
        staged = self.spark.read.parquet(self.stage(rows, generation))
        if validate is not None:
            worst = validate(staged).filter(F.col("severity").isin("error", "fatal")).limit(1).collect()
            if worst:
                raise ValueError(f"generation {generation} is not published: {worst[0].asDict()}")
        self.pointer.point(generation, len(log))
        return generation

    def rollback(self) -> int:
        return self.pointer.rollback()

    def read(self, generation: int | None = None) -> DataFrame:
        generation = self.current() if generation is None else generation
        if generation is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.folder}/generation={generation}")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of base with those of changes in their place, the newest of each key."""
    merged = base.withColumn("_turn", F.lit(0)).unionByName(changes.withColumn("_turn", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_turn"), F.desc(order))
    return merged.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_turn", "_rank")


def import_documents(existing: DataFrame, batch: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The rows of a batch that are new: not blank, one for each path, path not known."""
    fresh = batch.filter(F.trim(F.coalesce(text_col, F.lit(""))) != "").dropDuplicates([path_col])
    return fresh.join(existing.select(path_col), path_col, "left_anti")


def import_counted(existing: DataFrame, batch: DataFrame, path_col: str = "path", text_col: str = "text", dimensions: int = 64) -> tuple[DataFrame, int, int]:
    """(new rows with their embedding, imported, skipped)."""
    from textloom import runtime
    from textloom.operators import corpus

    fresh = import_documents(existing, batch, path_col, text_col).withColumn("embedding", corpus.local_hash_embedding(F.col(text_col), dimensions))
    fresh = runtime.stored(fresh, "imported")
    imported = fresh.count()
    return fresh, imported, batch.count() - imported


class ImportRun:
    """An import in named stages, each written below a folder and never made twice: a run that was stopped goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> None:
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, k: int) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{k:02d}-{self.stages[k][0]}/_SUCCESS"))

    def checkpoints(self) -> list[str]:
        """The stages that are complete."""
        return [name for k, (name, _) in enumerate(self.stages) if self._done(k)]

    def cancel(self) -> None:
        """Stop before the next stage; what is complete stays."""
        self._fs.mkdirs(self._path(self.folder))
        self._fs.create(self._path(f"{self.folder}/cancelled"), True).close()

    def run(self) -> DataFrame | None:
        """The rows of the last complete stage."""
        rows = None
        for k, (name, stage) in enumerate(self.stages):
            path = f"{self.folder}/{k:02d}-{name}"
            if not self._done(k):
                if self._fs.exists(self._path(f"{self.folder}/cancelled")):
                    return rows
                stage(rows).write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path)
        return rows


class Backend:
    """A retrieval store: documents are ingested, committed as one index generation, and searched by rank."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text") -> None:
        from textloom.operators.index import TextIndex

        self.spark, self.folder, self.key, self.text = spark, folder.rstrip("/"), key, text
        self.index = TextIndex.at(spark, f"{self.folder}/index", key, (), text)
        self.table = VersionedTable(spark, f"{self.folder}/documents")
        self._waiting: list[DataFrame] = []

    def ingest(self, docs: DataFrame) -> None:
        self._waiting.append(docs.select(self.key, self.text))

    def commit(self) -> int:
        """All documents so far, the newest text of a key, as the next generation of table and index."""
        rows = self.table.read() if self.table.current() is not None else None
        for one in self._waiting:
            kept = one if rows is None else rows.join(one, self.key, "left_anti").unionByName(one)
            rows = kept
        self._waiting = []
        generation = self.table.publish(rows)
        self.index.build(self.table.read())
        return generation

    def search(self, terms: list[str], limit: int = 10) -> DataFrame:
        return self.index.bm25(terms).orderBy(F.desc("score"), self.key).limit(limit)
