import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, store
from textloom.streaming import events as streams


def test_references():
    for text, want in {"2:255-257": "2:255-2:257", "2:255:3": "2:255:token:3", "quran:2:1": "2:1", "ed-1:2:1": "ed-1:2:1", "juz:3": "juz:3"}.items():
        assert readers.parse_reference(text).canonical() == want
        assert readers.parse_reference(want).canonical() == want
    for bad in ("", "0:1", "2:5-3", "x", "juz:0", "1:2:0", "9" * 300):
        with pytest.raises(ValueError):
            readers.parse_reference(bad)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1|1|x|y\n\n1|2|z\n")
    assert [tuple(r) for r in readers.read(spark, "numbered-lines", str(tmp_path / "a.txt")).orderBy("ayah").collect()] == [(1, 1, "x|y"), (1, 2, "z")]
    (tmp_path / "h.json").write_text(json.dumps({"collection": "c", "matn_text": "m"}) + "\n" + json.dumps({"collection": "d", "meta": {"Consensus": 1}}) + "\n")
    assert [(r["collection"], r["refused"]) for r in readers.hadith_json(spark, str(tmp_path / "h.json")).orderBy("collection").collect()] == [("c", False), ("d", True)]
    (tmp_path / "e.jsonl").write_text('{"version": "1"}\n{"tool": "t", "input": "i"}\n')
    assert readers.jsonl_with_header(spark, str(tmp_path / "e.jsonl"), "tool string, input string", "1").count() == 1
    with pytest.raises(ValueError):
        readers.jsonl_with_header(spark, str(tmp_path / "e.jsonl"), "tool string", "2")
    with pytest.raises(ValueError):
        readers.read(spark, "none", "x")


def test_files_that_break_their_format(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\n\ntwo\n")
    assert [tuple(r) for r in readers.plain_lines(spark, str(tmp_path / "p.txt")).orderBy("line").collect()] == [(0, "one"), (2, "two")]
    (tmp_path / "e.json").write_text(json.dumps({"format": "other", "format_version": 1}))
    with pytest.raises(ValueError):
        readers.edition_json(spark, str(tmp_path / "e.json"))
    for name, text in {"a": '1|1|x\n{\n"name": "b"}', "c": "1|1|x", "d": '1|2|x\n1|1|y\n{\n"name": "d"}', "f": '115|1|x\n{\n"name": "f"}'}.items():
        (tmp_path / f"{name}.txt").write_text(text)
        with pytest.raises(ValueError):
            readers.chapter_verse(spark, str(tmp_path / f"{name}.txt"))
    (tmp_path / "g.json").write_text(json.dumps({"nolanguage": {"name": "x", "direction": "rtl"}}))
    with pytest.raises(ValueError):
        readers.catalog_json(spark, str(tmp_path / "g.json"))
    units = spark.createDataFrame([(1, 1)], "s int, a int")
    for passages, translator in ((units, " "), (spark.createDataFrame([(1, 2)], "s int, a int"), "me")):
        with pytest.raises(ValueError):
            readers.aligned(passages, units, ["s", "a"], translator)
    assert readers.manifest_hash({"b": 1, "a": [2], "signature": "s"}) == readers.manifest_hash({"a": [2], "b": 1})


def test_of_two_publishers_one_wins(spark, tmp_path):
    a, b = (store.Pointer(spark, str(tmp_path / "p")) for _ in range(2))
    seen = len(a.log()), len(b.log())
    a.point(7, seen[0])
    with pytest.raises(RuntimeError):
        b.point(8, seen[1])
    assert b.current() == 7
    b.point(9)
    assert a.log() == [(0, 7, None), (1, 9, 7)] and a.rollback() == 7


def test_generations(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    first = table.publish(spark.range(3).toDF("x"))
    second = table.publish(spark.range(5).toDF("x"))
    assert (first, second, table.read().count(), table.read(1).count()) == (1, 2, 5, 3)
    assert table.rollback() == 1 and table.read().count() == 3
    bad = lambda rows: rows.select(F.lit("R").alias("rule"), F.lit("error").alias("severity"))
    with pytest.raises(ValueError):
        table.publish(spark.range(1).toDF("x"), bad)
    assert table.current() == 1


def test_upsert_and_import(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in store.upsert(base, new, ["k"], "t").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    known = spark.createDataFrame([("p",)], "path string")
    batch = spark.createDataFrame([("p", "x"), ("q", " "), ("r", "y"), ("r", "y")], "path string, text string")
    assert [r["path"] for r in store.import_documents(known, batch).collect()] == ["r"]


@pytest.fixture(scope="module")
def event_folder(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "e")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(folder)
    return folder


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_streams_equal_batches(spark, event_folder, name):
    args = {"tumbling": ("1 day",), "sliding": ("1 day", "12 hours"), "sessions": ("6 hours",)}[name]
    schema = spark.read.parquet(event_folder).schema
    stream = getattr(streams, name)(streams.source(spark, event_folder, schema), *args)
    q = stream.writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table(f"out_{name}").collect()), key=str)
    want = sorted(map(tuple, getattr(streams, name)(spark.read.parquet(event_folder), *args).collect()), key=str)
    assert got == want and got


def test_relay_delivers_each_event_once(spark, event_folder, tmp_path):
    schema = spark.read.parquet(event_folder).schema
    out = str(tmp_path / "out")
    for _ in range(2):
        streams.relay(streams.source(spark, event_folder, schema), lambda rows: rows.select("event_id").write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == got.distinct().count() == spark.read.parquet(event_folder).count()


def test_leases_and_late_duplicates(spark, event_folder):
    schema = spark.read.parquet(event_folder).schema
    events = lambda: streams.source(spark, event_folder, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    q = streams.leases(events(), 3600).writeStream.format("memory").queryName("out_leases").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("out_leases").filter("n <= 0").count() == 0
    twice = events().unionByName(events())
    q = streams.deduplicated(twice, ["event_id"], "400 days").writeStream.format("memory").queryName("out_once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("out_once")
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(event_folder).count()
