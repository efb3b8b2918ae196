"""Validation rules: each yields findings (rule, severity, location, message).

Rules that compare a row with the one before it in the order of a file find that row without a global sort: rows are
dealt in blocks of their line number, and each block gets the last value of the blocks before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as scalar

SCHEMA = "rule string, severity string, location string, message string"


def finding(rows: DataFrame, rule: str, severity: str, location: Column, message: Column | str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), location.cast("string").alias("location"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


#: Lines of a block in which neighbours are found by a window.
BLOCK = 1 << 16


def with_previous(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """The rows with `before`, the struct of `values` of the nearest row before them in the order; rows with a null value are left out."""
    rows = rows.dropna(subset=values).withColumn("block", F.floor(F.col(order) / BLOCK)).withColumn("own", F.struct(*values))
    ends = rows.groupBy("block").agg(F.max_by("own", order).alias("end"))
    # one row for each block of BLOCK lines
    carried = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("carry"))
    inside = F.lag("own").over(Window.partitionBy("block").orderBy(order))
    return rows.withColumn("near", inside).join(carried, "block").withColumn("before", F.coalesce("near", "carry")).drop("block", "own", "near", "carry")


def blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def validate_edition(edition: DataFrame, surahs: DataFrame, ayahs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The rules QV-001 to QV-027 of an edition before its import.

    edition: one row (language, surah_count, ayah_count, unicode_normalization, basmala_policy). surahs: (number,
    ayah_count, revelation_place, basmala). ayahs: (line, surah, ayah, text, juz, hizb, rub, manzil, page, sajdah), line
    being the order of the file from 0. tokens, where the file has them: (surah, ayah, place, position, surface,
    byte_start, byte_end, char_start, char_end), place being their order. QV-013, QV-014 and QV-015 have functions of
    their own; QV-024 to QV-026 and QV-028 hold by construction.
    """
    head = F.broadcast(edition.limit(1))  # one row
    at_ayah = F.format_string("surah %d ayah %d", F.col("surah").cast("long"), F.col("ayah").cast("long"))
    at_surah = lambda c: F.format_string("surah %d", F.col(c).cast("long"))
    whole = F.lit("edition")
    text = lambda c: F.col(c).cast("string")
    n_surahs = surahs.agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.countDistinct("number").alias("d"))
    n_ayahs = ayahs.agg(F.count(F.lit(1)).alias("n"))
    counts = ayahs.groupBy("surah").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ayah").alias("d"), F.min("ayah").alias("low"), F.max("ayah").alias("high"))
    both = surahs.select(F.col("number").alias("surah"), F.col("ayah_count").alias("declared")).join(counts, "surah", "full")
    numbered = (F.col("n") == F.col("declared")) & (F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    filled = ayahs.filter(~blank("text"))
    form = F.concat(F.lit(","), scalar.unicode_forms(F.col("text")), F.lit(","))
    reason, odd = scalar.forbidden_reason(F.col("text")), scalar.first_unexpected(F.col("text"))
    parts = [
        finding(edition.filter("language <> 'ar'"), "QV-027", "error", whole, F.concat(F.lit("the language is "), text("language"))),
        finding(n_surahs.join(head).filter("n <> surah_count"), "QV-001", "fatal", whole, F.concat_ws(" ", F.lit("surahs:"), text("n"), F.lit("of"), text("surah_count"))),
        finding(n_surahs.filter("n > 0 AND NOT (low = 1 AND high = n AND d = n)"), "QV-002", "fatal", whole, "surah numbers are not 1 to their count"),
        finding(both.filter("NOT coalesce(n, 0) <=> declared"), "QV-003", "fatal", at_surah("surah"), F.concat_ws(" ", F.lit("declared"), F.coalesce(text("declared"), F.lit("none")), F.lit("found"), F.coalesce(text("n"), F.lit("0")))),
        finding(n_ayahs.join(head).filter("n <> ayah_count"), "QV-004", "fatal", whole, F.concat_ws(" ", F.lit("ayahs:"), text("n"), F.lit("of"), text("ayah_count"))),
        finding(both.filter("n IS NOT NULL").filter(~F.coalesce(numbered, F.lit(False))), "QV-005", "fatal", at_surah("surah"), "ayah numbers are not 1 to the declared count"),
        finding(ayahs.filter(blank("text")), "QV-006", "fatal", at_ayah, "blank text"),
        finding(filled.withColumn("form", form).join(head).filter(~F.contains("form", F.concat(F.lit(","), "unicode_normalization", F.lit(",")))), "QV-007", "fatal", at_ayah, F.concat(F.lit("text is not in the form "), text("unicode_normalization"))),
        finding(filled.withColumn("reason", reason).filter("reason IS NOT NULL"), "QV-008", "fatal", at_ayah, F.col("reason")),
        finding(filled.withColumn("odd", odd).filter("odd IS NOT NULL"), "QV-009", "error", at_ayah, F.concat(F.lit("unexpected character at "), text("odd"))),
        finding(filled.filter(scalar.reconstruct(scalar.tokens(F.col("text")), scalar.separators(F.col("text"))) != F.col("text")), "QV-011", "fatal", at_ayah, "tokens do not reconstruct the text"),
        _juz(ayahs),
        *(finding(_falls(ayahs, within, c), "QV-017", "warning", whole, F.concat_ws(" ", F.lit(f"{c} decreases within"), *(F.concat_ws(" ", F.lit(w), text(w)) for w in within))) for c, within in (("hizb", ["juz"]), ("manzil", ["juz"]), ("rub", ["juz", "hizb"]))),
        finding(with_previous(ayahs, "line", ["page"]).filter("page < before.page").limit(1), "QV-018", "error", whole, "page numbers decrease"),
        finding(ayahs.agg(F.count("sajdah").alias("n")).filter("n > 0"), "QV-019", "info", whole, F.concat(text("n"), F.lit(" sajdah markers"))),
        finding(surahs.join(head).filter("basmala_policy <> 'per_surah' AND NOT basmala <=> basmala_policy"), "QV-020", "error", at_surah("number"), "basmala policy disagrees with the edition's"),
        finding(surahs.filter("revelation_place IS NULL"), "QV-021", "warning", at_surah("number"), "revelation place is missing"),
        finding(_repeats(ayahs), "QV-022", "info", at_surah("surah"), F.concat_ws(" ", F.lit("ayah"), text("ayah"), F.lit("repeats the text of ayah"), text("earlier"))),
        _file_order(ayahs),
    ]
    if tokens is not None:
        parts += _supplied_tokens(ayahs, tokens)
    return reduce(DataFrame.unionByName, parts)


def _falls(ayahs: DataFrame, within: list[str], column: str) -> DataFrame:
    """The parents in which a column falls along the file."""
    w = Window.partitionBy(*within).orderBy("line")
    rows = ayahs.dropna(subset=[*within, column])
    return rows.withColumn("before", F.lag(column).over(w)).filter(F.col(column) < F.col("before")).select(*within).distinct()


def _juz(ayahs: DataFrame) -> DataFrame:
    """QV-016: the first break of the juz, which begin at 1 and go on by 0 or 1."""
    rows = with_previous(ayahs.select("line", "juz"), "line", ["juz"])
    bad = F.when(F.col("before").isNull(), F.col("juz") != 1).otherwise(~(F.col("juz") - F.col("before.juz")).isin(0, 1))
    first = rows.filter(bad).agg(F.min_by(F.struct("juz", "before"), "line").alias("b")).filter("b IS NOT NULL")
    message = F.when(F.col("b.before").isNull(), F.concat(F.lit("juz begin at "), F.col("b.juz").cast("string"))).otherwise(F.concat_ws(" ", F.lit("juz jump from"), F.col("b.before.juz").cast("string"), F.lit("to"), F.col("b.juz").cast("string")))
    return finding(first, "QV-016", "error", F.lit("edition"), message)


def _repeats(ayahs: DataFrame) -> DataFrame:
    """Ayahs whose text an earlier one of the surah has, with the nearest such as `earlier`. Texts meet by hash and length."""
    key = [F.col("surah"), F.xxhash64("text"), F.length("text"), F.col("text")]
    w = Window.partitionBy(*key).orderBy("line")
    return ayahs.withColumn("earlier", F.lag("ayah").over(w)).filter("earlier IS NOT NULL")


def _file_order(ayahs: DataFrame) -> DataFrame:
    """QV-023: the first row that does not come after the one before it by (surah, ayah)."""
    rows = with_previous(ayahs.select("line", "surah", "ayah"), "line", ["surah", "ayah"])
    bad = rows.filter(F.struct(F.col("surah"), F.col("ayah")) <= F.col("before")).agg(F.min_by(F.struct("surah", "ayah"), "line").alias("b")).filter("b IS NOT NULL")
    return finding(bad.select("b.*"), "QV-023", "fatal", F.format_string("surah %d ayah %d", F.col("surah").cast("long"), F.col("ayah").cast("long")), "rows are not in strictly increasing order")


def _supplied_tokens(ayahs: DataFrame, tokens: DataFrame) -> list[DataFrame]:
    """QV-010 to QV-012 of tokens that a file supplies."""
    listed = F.array_sort(F.collect_list(F.struct("place", "position", "surface", "byte_start", "byte_end", "char_start", "char_end")))
    rows = ayahs.select("surah", "ayah", "text").join(tokens.groupBy("surah", "ayah").agg(listed.alias("t")), ["surah", "ayah"])
    at = F.format_string("surah %d ayah %d", F.col("surah").cast("long"), F.col("ayah").cast("long"))
    ordered = F.forall(F.transform("t", lambda x, i: x["position"] == i + 1), lambda x: x)
    joined = scalar.reconstruct(F.transform("t", lambda x: x["surface"]), scalar.separators(F.col("text")))
    raw = F.encode("text", "UTF-8")
    one = rows.select("surah", "ayah", "text", F.explode("t").alias("x"))
    slice_of = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("x.byte_start") + 1, F.col("x.byte_end") - F.col("x.byte_start")), "UTF-8")
    wrong = (F.col("x.byte_end") > F.octet_length(raw)) | (slice_of != F.col("x.surface")) | (F.col("x.char_end") <= F.col("x.char_start")) | (F.col("x.char_end") > F.size(scalar.graphemes(F.col("text"))))
    return [
        finding(rows.filter(~ordered), "QV-010", "fatal", at, "token positions are not 1 to their count in order"),
        finding(rows.filter(joined != F.col("text")), "QV-011", "fatal", at, "supplied tokens do not reconstruct the text"),
        finding(one.filter(wrong), "QV-012", "fatal", F.concat_ws(" ", at, F.lit("token"), F.col("x.position").cast("string")), "offsets do not slice to the surface"),
    ]


def validate_file_hash(spark, path: str, declared: str) -> DataFrame:
    """QV-013: whether the bytes of a file have the declared SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    return finding(files.filter(F.sha2("content", 256) != declared.lower()), "QV-013", "fatal", F.col("path"), "the file's hash is not the declared one")


def validate_hashes(stored: DataFrame, recomputed: DataFrame, key: str, rule: str = "QV-014") -> DataFrame:
    """QV-014 and QV-024: hashes (key, hash) that are not those recomputed from the staged rows, either way."""
    a, b = stored.select(key, F.col("hash").alias("had")), recomputed.select(key, F.col("hash").alias("got"))
    return finding(a.join(b, key, "full").filter("NOT had <=> got"), rule, "fatal", F.col(key), "the hash is not reproduced")


def summary(findings: DataFrame) -> DataFrame:
    """(severity, n) of a report; fatal and error findings stop an import."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def validate_monotone(rows: DataFrame, group: str, order: str, value: str, rule: str = "QV-018") -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    falls = rows.withColumn("before", F.lag(value).over(w)).filter(F.col(value) < F.col("before"))
    return finding(falls, rule, "error", F.concat_ws(":", F.col(group).cast("string"), F.col(order).cast("string")), f"{value} falls")


#: What a status, a layer and a segment's kind may be.
STATUSES = ("imported", "human_verified")
LAYERS = ("B", "D")
SEGMENT_KINDS = ("prefix", "stem", "suffix")
FATAL, WARNINGS = ("MV-001", "MV-003", "MV-010", "MV-011"), ("MV-007", "MV-018")


def validate_analyses(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The rules MV-001 to MV-018 over analyses; MV-018 only says that validate_hashes is due over what was built.

    rows: (dataset, dataset_version, surah, ayah, token_position, analysis_index, surface, lemma, root, pos_native,
    pos_unified, provenance_layer, algorithm, algorithm_version, confidence, reviewer, status, segmented,
    segments array<struct<kind, surface>>, features json); columns that a dataset lacks break no rule. tokens:
    (surah, ayah, n) bounds positions.
    """
    wanted = {"dataset": "string", "dataset_version": "string", "segmented": "boolean", "segments": "array<struct<kind:string,surface:string>>", "features": "string"}
    have = set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in have})
    place = F.concat_ws(":", *(F.col(c).cast("string") for c in ("surah", "ayah", "token_position", "analysis_index")))
    if tokens is not None:
        rows = rows.join(tokens.select("surah", "ayah", F.col("n").alias("n_tokens")), ["surah", "ayah"], "left")
    else:
        rows = rows.withColumn("n_tokens", F.lit(None).cast("int"))
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    parsed = F.try_parse_json("features")
    checks = [
        ("MV-001", (blank("dataset") | blank("dataset_version")) if "dataset" in have else F.lit(False), "dataset or version is blank"),
        ("MV-002", blank("surface"), "surface is blank"),
        ("MV-003", ~(F.col("surah").between(1, 114) & (F.col("ayah") >= 1)), "place is out of range"),
        ("MV-004", (F.col("token_position") < 1) | (F.col("token_position") > F.col("n_tokens")), "position is outside the ayah"),
        ("MV-006", absent("lemma") != absent("root"), "lemma and root go together"),
        ("MV-007", ~absent("pos_native") & absent("pos_unified"), "native tag without unified tag"),
        ("MV-008", F.col("segmented") & (F.size(F.coalesce("segments", F.array().cast(wanted["segments"]))) == 0), "segmented without segments"),
        ("MV-009", ~F.col("confidence").between(0, 1), "confidence is outside 0 to 1"),
        ("MV-010", (F.col("provenance_layer") == "D") & (absent("algorithm") | absent("algorithm_version") | F.col("confidence").isNull()), "layer D needs algorithm, version and confidence"),
        ("MV-011", (F.col("status") == "human_verified") & blank("reviewer"), "verified without a reviewer"),
        ("MV-012", ~absent("root") & blank("root"), "root is blank"),
        ("MV-013", ~absent("pos_unified") & absent("pos_native"), "unified tag without native tag"),
        ("MV-014", ~F.coalesce("provenance_layer", F.lit("")).isin(*LAYERS), "unknown layer"),
        ("MV-015", ~F.coalesce("status", F.lit("")).isin(*STATUSES), "unknown status"),
        ("MV-016", F.lit("features" in have) & ~F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)), "features are no JSON object"),
        ("MV-017", F.exists(F.coalesce("segments", F.array().cast(wanted["segments"])), lambda x: ~F.coalesce(x["kind"], F.lit("")).isin(*SEGMENT_KINDS) | (F.coalesce(x["surface"], F.lit("")) == "")), "a segment has no kind or surface"),
    ]
    failed = F.filter(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, c, m in checks)), lambda x: x.isNotNull())
    one = rows.select(place.alias("place"), F.explode(failed).alias("f")).select(F.col("f.rule").alias("rule"), F.when(F.col("f.rule").isin(*FATAL), "fatal").when(F.col("f.rule").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), F.col("place").alias("location"), F.col("f.message").alias("message"))
    key = ["surah", "ayah", "token_position", "analysis_index"]
    twice = finding(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "MV-005", "error", place, "analysis repeats")
    later = finding(rows.agg(F.count(F.lit(1)).alias("n")), "MV-018", "warning", F.lit(""), F.concat(F.col("n").cast("string"), F.lit(" analyses are to be compared with the canonical text when they are built")))
    return one.unionByName(twice).unionByName(later)


def policy(analyses: DataFrame, allowed: list[str], suppressed: bool = False, dataset: str = "dataset") -> tuple[DataFrame, int]:
    """(analyses of the allowed datasets, how many others there are); with `suppressed` the others follow, marked."""
    inside = F.col(dataset).isin(allowed) if allowed else F.lit(False)
    shown = analyses.filter(inside).withColumn("suppressed", F.lit(False))
    hidden = analyses.filter(~F.coalesce(inside, F.lit(False)))
    return (shown.unionByName(hidden.withColumn("suppressed", F.lit(True))) if suppressed else shown), hidden.count()


def licensed(datasets: DataFrame, allowed: list[str], license_col: str = "license", review_col: str = "review") -> DataFrame:
    """(dataset columns, verdict): active, needs_review, or refused for a licence that is blank or not allowed."""
    known = ~blank(license_col) & F.col(license_col).isin(allowed)
    verdict = F.when(~F.coalesce(known, F.lit(False)), "refused").when(F.col(review_col) == "approved", "active").otherwise("needs_review")
    return datasets.withColumn("verdict", verdict)


def suggestions(rows: DataFrame, floor: float | None = None, confidence: str = "confidence", status: str = "status") -> DataFrame:
    """Promoted rows; with a floor (0.5 at least) also suggestions of at least that confidence."""
    promoted = F.col(status) == "promoted"
    if floor is None:
        return rows.filter(promoted)
    if floor < 0.5:
        raise ValueError("suggestions below a confidence of 0.5 are never shown")
    return rows.filter(promoted | ((F.col(status) == "suggested") & (F.col(confidence) >= floor)))


def labelled_disagreement(gradings: DataFrame, subject: str, scholar: str, value: str, layer: str, confidence: str) -> DataFrame:
    """(subject, scholar, value, label): every view of a subject; uncertain where it is of layer D or has a confidence, else confirmed."""
    label = F.when((F.col(layer) == "D") | F.col(confidence).isNotNull(), "uncertain").otherwise("confirmed")
    return gradings.select(subject, scholar, value, F.coalesce(label, F.lit("confirmed")).alias("label"))


def compare_metric(results: DataFrame, metric: str, expected: str, tolerance: float) -> DataFrame:
    """The results with `passed`: within the tolerance of what is expected; an unavailable metric never passes."""
    return results.withColumn("passed", F.coalesce(F.abs(F.col(metric) - F.col(expected)) <= tolerance, F.lit(False)))


def disagreement(gradings: DataFrame, subject: str, scholar: str, value: str) -> DataFrame:
    """(subject, views): the views of a subject, never merged, in the order of the scholars."""
    return gradings.groupBy(subject).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(scholar).cast("string"), F.col(value).cast("string")))), ";").alias("views"))


def rates(results: DataFrame, group: str, passed: str) -> DataFrame:
    return results.groupBy(group).agg(F.avg(F.col(passed).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
