import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import normalize, spans, text as scalar

CASES = ["بِسْمِ ٱللَّهِ", "كتـــاب ۖ  x", "ﻻ ﻷ", "۱۲۳ ٤٥٦", "", "  a\t\tb ", "والكتاب", "أَإِآؤئء", "éà", "ab.c,d!"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate(CASES)] + [(99, None)], "id int, text string")


@pytest.mark.parametrize("rule", sorted(normalize.NAMES))
def test_rules_are_idempotent_and_keep_null(rows, rule):
    once = normalize.rule(rule, F.col("text"))
    got = rows.select("id", once.alias("a"), normalize.rule(rule, once).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert [r["a"] for r in got if r["id"] == 99] == [None]


@pytest.mark.parametrize("name", [n for n in normalize.PROFILES if n not in ("L7.affix",)])
def test_span_maps_agree_with_columns(rows, name):
    mapped = rows.select("id", "text", normalize.profile(name, F.col("text")).alias("plain"), spans.span_map(normalize.PROFILES[name], F.col("text")).alias("m")).collect()
    for r in mapped:
        if r["text"] is None:
            continue
        assert r["m"]["text"] == r["plain"]
        assert len(r["m"]["forward"]) == len(r["plain"])
        assert all(0 <= k < len(r["text"]) for k in r["m"]["forward"])


def test_nfc(rows):
    got = {r["id"]: r["x"] for r in rows.select("id", normalize.rule("N16", F.col("text")).alias("x")).collect()}
    assert got[8] == unicodedata.normalize("NFC", CASES[8])


def test_registry_is_append_only():
    registry = normalize.ProfileRegistry(normalize.PROFILES)
    registry.register("mine", ("N01", "N12"))
    registry.register("mine", ("N01", "N12"))
    with pytest.raises(ValueError):
        registry.register("mine", ("N12",))
    with pytest.raises(KeyError):
        registry.get("none")
    assert normalize.adhoc_label(["N01", "N12"]).startswith("adhoc:")


def test_tokens_reconstruct(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n") for _ in range(rng.randrange(12))) for _ in range(60)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    t = F.col("t")
    got = rows.select("t", scalar.reconstruct(scalar.tokens(t), scalar.separators(t)).alias("r"), scalar.tokens(t).alias("w")).collect()
    assert all(r["t"] == r["r"] and r["w"] == r["t"].split() for r in got)


def test_similarity_and_bands(spark):
    row = spark.range(1).select(
        scalar.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        scalar.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("one"),
        scalar.confidence_band(F.lit(0.9)).alias("band"),
        scalar.redact(F.lit("password=abc x https://u:p@h/")).alias("redacted"),
        scalar.sanitize_html(F.lit('<a onclick="x()" href="javascript:y">z</a><script>1</script>')).alias("html"),
        scalar.snippet(F.lit("é" * 101)).alias("snippet"),
    ).first()
    assert row["zero"] == 0 and abs(row["one"] - 1) < 1e-12 and row["band"] == "medium"
    assert row["redacted"] == "password=[REDACTED] x https://[REDACTED]@h/"
    assert row["html"] == '<a href="y">z</a>' and row["snippet"] == "é" * 50 + "..."


def test_highlight(spark):
    ranges = lambda *r: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in r))
    row = spark.range(1).select(spans.highlight(F.lit("abcdef"), ranges((1, 2), (3, 5))).alias("a"), spans.highlight(F.lit("abcdef"), ranges((3, 5), (4, 6))).alias("b")).first()
    assert row["a"] == "a<mark>b</mark>c<mark>de</mark>f" and row["b"] is None


def test_forms_and_fnv(spark):
    rows = spark.createDataFrame([("e\u0301",), ("abc",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(scalar.unicode_forms(F.col("t")), scalar.fnv1a(F.col("t"))).collect()]
    assert got[0][0] == "NFD,NFKD" and got[1] == ("NFC,NFD,NFKC,NFKD", "e71fa2190541574b") and got[2] == (None, None)


def test_chains_equal_their_rules(spark):
    texts = ["", "plain  ascii\ttext ", "\u00a0caf\u00e9\u0085 x", "e\u0301 \u200f\u06d6a", "\u0622\u0640\u064b\u0671 \u06a9\u06cc \u06f3", "\ufef7 a,b.c", None, "aaa\u0301\u0301"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    for name, rules in normalize.PROFILES.items():
        step = F.col("t")
        for one in rules:
            step = normalize.rule(one, step)
        got = rows.select("k", normalize.profile(name, F.col("t")).alias("a"), step.alias("b")).filter("NOT a <=> b").collect()
        assert not got, (name, got)
        assert all(spans.forward(rules, x)[0] == r["a"] for x, r in zip(texts, rows.orderBy("k").select(normalize.profile(name, F.col("t")).alias("a")).collect(), strict=True) if x is not None and name != "L7.affix")


def test_span_maps_compose(spark):
    row = spark.createDataFrame([("a b\u0640c",)], "t string").select(spans.span_map(("N02",), F.col("t")).alias("first"))
    row = row.select("first", spans.span_map(("N17",), F.col("first.text")).alias("second")).select(spans.compose(F.col("first"), F.col("second")).alias("c"), spans.span_segments(F.col("second")).alias("s")).first()
    assert row["c"]["text"] == "abc" and row["c"]["forward"] == [0, 2, 4] and [tuple(x) for x in row["s"]] == [(0, 1, 0), (1, 3, 2)]


def test_graphemes(spark):
    row = spark.createDataFrame([("e\u0301x\U0001f1e9\U0001f1ea",)], "t string").select(F.size(scalar.graphemes(F.col("t"))).alias("n"), scalar.grapheme_to_char(F.col("t"), F.lit(2)).alias("at")).first()
    assert (row["n"], row["at"]) == (3, 3)
