"""Readers of corpus files with fixed schemas, and a parser of references."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The schemas of the file formats.
EDITION = """format string, format_version int,
edition struct<slug: string, name: string, script: string, language: string, verse_numbering_scheme: string, unicode_normalization: string, basmala_policy: string, version: string, synthetic: boolean>,
expected struct<surah_count: int, ayah_count: int>,
surahs array<struct<number: int, name_arabic: string, ayah_count: int, revelation_place: string, revelation_order: int, basmala: string>>,
ayahs array<struct<surah: int, ayah: int, text: string, juz: int, hizb: int, rub: int, manzil: int, ruku: int, page: int, sajdah: string>>"""
AYAH_CSV = "surah int, ayah int, text string, juz int, hizb int, rub int, manzil int, ruku int, page int, sajdah string"
ANALYSIS_CSV = """chapter int, verse int, word_n int, ana_n int, token string, lemma_cite string, root_cite string, stem_cite string, msd string,
upos string, prov string, method string, method_v string, score double, state string, reviewer string, segmented boolean, morphs string, synthetic_test_only boolean"""
ANALYSIS_JSON = """sura_no int, aya_no int, tok_idx int, analysis_no int, surface_form string, lemma_str string, root_str string, stem_str string,
tag_native string, tag_unified string, layer string, algo string, algo_ver string, conf double, state string, reviewer string, segmented boolean, synthetic_test_only boolean"""
HADITH = """collection string, source_number string, matn_text string, isnad_text string, narrator_names array<string>,
gradings array<struct<scholar_name: string, grading_value: string, source_citation: string>>"""
FORBIDDEN_KEYS = ("consensus", "majority")
CATALOG = "map<string, struct<name: string, author: string, direction: string, source: string, comments: string, link: string, linkmin: string>>"
TRAILER = "name string, author string, language string, direction string, source string, comments string, link string, linkmin string"
INTERMEDIATE = """dataset struct<slug: string, version: string>, edition_id string, synthetic_test_only boolean,
analyses array<struct<surah: int, ayah: int, token_position: int, analysis_index: int, surface: string, lemma: string, root: string, stem: string, pos_unified: string, pos_native: string, features_json: string,
segments array<struct<kind: string, surface: string>>, provenance_layer: string, algorithm: string, algorithm_version: string, confidence: double, reviewer: string, status: string>>""".replace("segments array", "segments: array")
TRANSMISSIONS = (("uthmanihaf", "hafs"), ("warsh", "warsh"), ("qaloon", "qalun"), ("soosi", "al_susi"), ("doori", "al_duri"), ("bazzi", "al_bazzi"), ("qumbul", "qunbul"), ("shouba", "shubah"))
COMMENTARIES = ("ara-sirajtafseer", "ara-sirajtafseernod", "ara-jalaladdinalmah")
TRANSLITERATION = ("_la", "_lad", "phonetic", "-la", "-lad")
SEED_SECTIONS = (("concepts", "theme"), ("persons", "person"), ("places", "place"))


def refuse(rows: DataFrame, condition, message: str) -> DataFrame:
    """The rows, if none is like the condition; else an error that names one."""
    bad = rows.filter(condition).limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {str(bad[0].asDict())[:200]}")
    return rows


def edition_json(spark: SparkSession, path: str, formats: str = r"edition", versions: tuple[int, ...] = (1,)) -> DataFrame:
    """One row for each edition manifest; malformed input, a format that does not match and an unknown version fail."""
    rows = spark.read.schema(EDITION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    known = F.coalesce(F.col("format").rlike(formats) & F.col("format_version").isin(*versions), F.lit(False))
    refuse(rows.select("format", "format_version"), ~known, "unknown format")
    return rows


def ayahs_of(editions: DataFrame) -> DataFrame:
    return editions.select(F.col("edition.slug").alias("edition"), F.explode("ayahs").alias("a")).select("edition", "a.*")


def ayah_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AYAH_CSV).option("header", True).option("mode", "FAILFAST").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """surah|ayah|text lines; comment and blank lines are left out."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    part = F.split("value", r"\|", 3)
    return lines.select(part[0].cast("int").alias("surah"), part[1].cast("int").alias("ayah"), part[2].alias("text")).filter("text IS NOT NULL")


def chapter_verse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verses (slug, line, surah, ayah, text), annotations (slug, line, text), trailers) of surah|ayah|text files.

    A file ends in a JSON trailer that begins with a line of one brace and names the file. Other lines are annotations.
    Verses that do not rise, lie outside surahs 1 to 114 or lack text are an error. An edition's file is read whole.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("slug"))
    parts = F.split("value", r"\n(?=\{\n)", 2)
    files = files.select("slug", parts[0].alias("content"), F.get(parts, F.lit(1)).alias("trailer"))
    trailers = files.select("slug", F.from_json("trailer", TRAILER).alias("t")).select("slug", "t.*")
    refuse(trailers.select("slug", "name"), ~F.col("name").eqNullSafe(F.col("slug")), "no trailer that names the file")
    lines = files.select("slug", F.posexplode(F.split("content", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)
    part = F.split("value", r"\|", 3)
    verse = lines.filter(F.size(part) == 3).select("slug", "line", F.expr("try_cast(split_part(value, '|', 1) AS int)").alias("surah"), F.expr("try_cast(split_part(value, '|', 2) AS int)").alias("ayah"), part[2].alias("text"))
    refuse(verse, ~F.coalesce(F.col("surah").between(1, 114) & (F.col("ayah") >= 1) & (F.trim("text") != ""), F.lit(False)), "no verse")
    w = Window.partitionBy("slug").orderBy("line")
    before = F.lag(F.struct("surah", "ayah")).over(w)
    refuse(verse.withColumn("before", before), F.struct(F.col("surah"), F.col("ayah")) <= F.col("before"), "verses do not rise")
    return verse, lines.filter(F.size(part) != 3).select("slug", "line", F.col("value").alias("text")), trailers


def catalog_json(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    """A row for each entry of an edition catalog: its slug, language, content kind, transmission and quality flags, all read from names."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CATALOG, {"mode": "FAILFAST"})).alias("key", "e")).select("key", "e.*")
    refuse(rows, F.trim(F.coalesce("name", F.lit(""))) == "", "an entry without a name")
    refuse(rows, ~F.col("key").rlike("^[a-z]{2,3}_"), "a key without a language")
    refuse(rows, ~F.coalesce(F.col("direction").isin("rtl", "ltr"), F.lit(False)), "an unknown direction")
    slug, key = F.trim("name"), F.lower("key")
    held = lambda parts: F.concat_ws(" ", key, F.lower(slug)).rlike("|".join(map(re.escape, parts)))
    kind = F.when(slug.isin(*COMMENTARIES), "tafsir").when(held(TRANSLITERATION), "transliteration").when(F.startswith("key", F.lit("ara_")), "quran_text").otherwise("translation")
    transmission = F.lit("unknown")
    fragment = F.lit(None).cast("string")
    for part, name in reversed(TRANSMISSIONS):
        transmission = F.when(F.contains(F.lower(slug), F.lit(part)), name).otherwise(transmission)
        fragment = F.when(F.contains(F.lower(slug), F.lit(part)), F.lit(part)).otherwise(fragment)
    flags = F.array_compact(F.array(
        F.lit("license_unknown"), F.lit("provenance_unknown"), F.lit("checksum_unverified"), F.when(F.contains(F.lower(F.coalesce("comments", F.lit(""))), F.lit("ocr")), "ocr"),
        F.when(held(("nonun", "nastaleeqn")), "non_unicode"),
    ))
    blank_to_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        "key", slug.alias("slug"), F.split_part("key", F.lit("_"), F.lit(1)).alias("language"), "direction", kind.alias("content_kind"), transmission.alias("transmission"),
        F.concat(F.lit("inferred-from-name:"), fragment).alias("evidence"), flags.alias("quality"), blank_to_null("author").alias("attribution"), F.coalesce(blank_to_null("link"), blank_to_null("linkmin")).alias("url"), F.lit(revision).alias("revision"),
    )


def intermediate_json(spark: SparkSession, path: str) -> DataFrame:
    """The analyses of intermediate morphology documents, with their dataset and edition."""
    rows = spark.read.schema(INTERMEDIATE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("dataset.slug").alias("dataset"), F.col("dataset.version").alias("dataset_version"), "edition_id", F.explode("analyses").alias("a")).select("dataset", "dataset_version", "edition_id", "a.*")


def concept_seed(spark: SparkSession, path: str, vocabulary: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, kind, label, reviewed_by), links (src, edge, dst)) of a concept seed; unknown edges, ends and versions fail."""
    item = "array<struct<id: string, label: string, attribution: struct<reviewed_by: string>>>"
    schema = f"format string, version string, concepts {item}, persons {item}, places {item}, links array<struct<src: string, edge: string, dst: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    refuse(rows.select("format", "version"), ~F.coalesce(F.contains("format", F.lit("concept-seed")) & (F.col("version") == "v1"), F.lit(False)), "unknown seed")
    nodes = None
    for section, kind in SEED_SECTIONS:
        refuse(rows.select(section), F.col(section).isNull(), f"{section} must be a list")
        some = rows.select(F.explode(section).alias("n")).select(F.coalesce("n.id", F.lit("")).alias("id"), F.lit(kind).alias("kind"), F.coalesce("n.label", F.lit("")).alias("label"), F.coalesce("n.attribution.reviewed_by", F.lit("")).alias("reviewed_by"))
        nodes = some if nodes is None else nodes.unionByName(some)
    refuse(nodes, F.trim("id") == "", "a node without an id")
    links = rows.select(F.explode("links").alias("l")).select("l.*")
    refuse(links, ~F.coalesce(F.col("edge").isin(*vocabulary), F.lit(False)), "unknown edge")
    refuse(links, F.trim(F.coalesce("src", F.lit(""))) == "", "a link without a source")
    known = nodes.select("id")
    refuse(links.join(known, links["dst"] == known["id"], "left_anti"), F.lit(True), "a link to an unknown node")
    own = links.filter(F.col("src").rlike("^(concept|entity):"))
    refuse(own.join(known, own["src"] == known["id"], "left_anti"), F.lit(True), "a link from an unknown node")
    return nodes, links


def aligned(passages: DataFrame, units: DataFrame, keys: list[str], translator: str) -> DataFrame:
    """Translations or glosses whose every row has its unit in the edition; a blank translator and rows without a unit fail."""
    if not translator.strip():
        raise ValueError("a translation names its translator")
    refuse(passages.join(units.select(*keys), keys, "left_anti"), F.lit(True), "the edition has no such unit")
    return passages.withColumn("translator", F.lit(translator))


def manifest_hash(manifest: dict) -> str:
    """SHA-256 of a manifest as canonical JSON: sorted keys, no white space, without its signature."""
    kept = {k: v for k, v in manifest.items() if k != "signature"}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def listing(rows: DataFrame, keys: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A table in the order of its keys, or a page of it."""
    out = rows.orderBy(*keys)
    return out if limit is None else out.offset(offset).limit(limit)


def lookup(rows: DataFrame, **key: object) -> DataFrame:
    """The rows of a key; the conditions reach the scan."""
    for name, value in key.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def between(rows: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """The rows of a range of a global index, in its order."""
    return rows.filter(F.col(column).between(low, high)).orderBy(column)


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one file that is read whole, so line numbers are the file's own."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.posexplode(F.split("value", "\n")).alias("line", "text")).filter("text <> ''")


def analyses_csv(spark: SparkSession, path: str) -> DataFrame:
    """Morphology rows with `segments`, from kind:surface pairs joined by bars."""
    rows = spark.read.schema(ANALYSIS_CSV).option("header", True).option("comment", "#").csv(path)
    pairs = F.transform(F.split("morphs", r"\|"), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(x, F.lit(":"), F.lit(2)).alias("surface")))
    return rows.withColumn("segments", F.when(F.length("morphs") > 0, pairs))


def analyses_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYSIS_JSON).option("multiLine", True).json(path)


def hadith_json(spark: SparkSession, path: str) -> DataFrame:
    """Records with `refused`, whether a forbidden key occurs anywhere in the raw record."""
    raw = spark.read.text(path).filter("trim(value) <> ''")
    # a key, at any depth: a string that a colon follows
    bad = F.lower("value").rlike(r'"(?:[^"\\]|\\.)*(?:' + "|".join(FORBIDDEN_KEYS) + r')(?:[^"\\]|\\.)*"\s*:')
    return raw.select(F.from_json("value", HADITH).alias("r"), bad.alias("refused")).select("r.*", "refused")


def jsonl_with_header(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """Rows after a header row whose `version` must be the wanted one."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    header = lines.filter(F.get_json_object("value", "$.version").isNotNull())
    found = [r[0] for r in header.select(F.get_json_object("value", "$.version")).distinct().limit(2).collect()]
    if found != [version]:
        raise ValueError(f"the file has version {found}, not {version}")
    return lines.filter(F.get_json_object("value", "$.version").isNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edition-json": edition_json, "ayah-csv": ayah_csv, "numbered-lines": numbered_lines, "plain-lines": plain_lines,
    "analyses-csv": analyses_csv, "analyses-json": analyses_json, "hadith-json": hadith_json, "catalog-json": catalog_json, "intermediate-json": intermediate_json,
}


def read(spark: SparkSession, adapter: str, path: str) -> DataFrame:
    if adapter not in READERS:
        raise ValueError(f"unknown adapter {adapter}; known: {sorted(READERS)}")
    return READERS[adapter](spark, path)


@dataclass(frozen=True)
class Reference:
    """One place, range, token or division of an edition."""

    edition: str | None
    start: tuple[int, int] | None = None
    end: tuple[int, int] | None = None
    token: int | None = None
    division: tuple[str, int] | None = None

    def canonical(self) -> str:
        head = f"{self.edition}:" if self.edition else ""
        if self.division:
            return f"{head}{self.division[0]}:{self.division[1]}"
        text = f"{head}{self.start[0]}:{self.start[1]}"
        if self.token is not None:
            return f"{text}:token:{self.token}"
        return text if self.end == self.start else f"{text}-{self.end[0]}:{self.end[1]}"

    def condition(self, surah: str = "surah", ayah: str = "ayah"):
        place = F.struct(F.col(surah).cast("int").alias("s"), F.col(ayah).cast("int").alias("a"))
        at = lambda p: F.struct(F.lit(p[0]).alias("s"), F.lit(p[1]).alias("a"))
        if self.division:
            return F.col(self.division[0]) == self.division[1]
        return place == at(self.start) if self.start == self.end else place.between(at(self.start), at(self.end))


_DIVISIONS = ("juz", "hizb", "rub", "manzil", "ruku", "page")
_PLACE = re.compile(r"(\d{1,3}):(\d{1,3})(?:-(?:(\d{1,3}):)?(\d{1,3}))?(?::(?:token:)?(\d{1,4}))?")


def parse_reference(text: str) -> Reference:
    """[quran:][edition:]surah:ayah[-[surah:]ayah | :[token:]position], or a division and its number."""
    if not text or len(text.encode()) > 256:
        raise ValueError("a reference has 1 to 256 bytes")
    rest = text.strip().removeprefix("quran:")
    edition = None
    if (m := re.match(r"([a-z][a-z0-9._-]*):", rest)) and m[1] not in _DIVISIONS:
        edition, rest = m[1], rest[m.end() :]
    if (m := re.fullmatch(rf"({'|'.join(_DIVISIONS)}):(\d+)", rest)) and int(m[2]) >= 1:
        return Reference(edition, division=(m[1], int(m[2])))
    m = _PLACE.fullmatch(rest)
    if not m or (m[4] and m[5]):
        raise ValueError(f"not a reference: {text!r}")
    start = (int(m[1]), int(m[2]))
    end = (int(m[3] or m[1]), int(m[4])) if m[4] else start
    if min(*start, *end) < 1 or end < start or (m[5] and int(m[5]) < 1):
        raise ValueError(f"not a reference: {text!r}")
    return Reference(edition, start, end, int(m[5]) if m[5] else None)
