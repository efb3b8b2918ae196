"""Each operator on odd rows and empty tables, and against a brute-force version."""

import collections
import hashlib
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import runtime
from textloom.llm import decontaminate, licenses, ngram_join, packing, quality_classifier, quality_rules, registry, token_files, toxicity, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    from textloom.llm import _tokens

    return _tokens.encoder(registry.vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- 1
def test_classifier_learns_and_scores_odd_rows(spark, odd, none):
    good = [(f"The {w} goes to the {v}, and it is well." * 3, 1) for w in ("cat", "dog", "man", "sun", "sea") for v in ("hill", "shop", "yard", "lake")]
    bad = [(f"{w}### {v}&&& {w}$$$ " * 4, 0) for w in ("cat", "dog", "man", "sun", "sea") for v in ("hill", "shop", "yard", "lake")]
    net = quality_classifier.train(good + bad, epochs=8)
    scores = [net.score(*_slab(t))[0] for t, _ in good + bad]
    assert min(scores[:20]) > 0.6 > 0.4 > max(scores[20:])
    got = quality_classifier.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(none, net).count() == 0


def _slab(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_classifier_sees_every_byte_and_any_split():
    net = quality_classifier.train([("aaaa bbbb", 1), ("#### $$$$", 0)] * 10, epochs=2)
    texts = ["x" * 300_000 + "####", "", "abc", "y" * 7]
    alone = [net.pooled(*_slab(t))[0] for t in texts]
    raw = b"".join(t.encode() for t in texts)
    together = net.pooled(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(alone, together, atol=1e-5)
    assert not np.allclose(alone[0], net.pooled(*_slab("x" * 300_000))[0])


def direct_score(net, text):
    """The network by its definition, chunk by chunk."""
    raw = (text or "").encode()
    blocks, width = len(net.filters), net.embed.shape[1]
    n_blocks = max(1, -(-len(raw) // quality_classifier.STEP))
    padded = raw + bytes((n_blocks + max(blocks - 1, quality_classifier.GAP)) * quality_classifier.STEP - len(raw))
    marks = []
    for k, byte in enumerate(padded):
        four = padded[k - 3 : k + 1] if k >= 3 else None
        again = byte > 0 and four is not None and any(padded[k - 3 - lag : k + 1 - lag] == four for lag in range(1, quality_classifier.REACH + 1) if k - 3 - lag >= 0)
        marks.append(byte + 256 * again)
    best = np.zeros(len(net.bias))
    for b in range(len(padded) // quality_classifier.STEP - blocks + 1):
        got = net.bias.astype(float)
        for j in range(blocks):
            for s in range(quality_classifier.STEP):
                got = got + net.embed[marks[(b + j) * quality_classifier.STEP + s]].astype(float) @ net.filters[j][s * width : (s + 1) * width].astype(float)
        best = np.maximum(best, got)
    return 1 / (1 + np.exp(-(best @ net.out.astype(float) + net.out_bias)))


def test_classifier_against_direct_convolution(spark, odd):
    net = quality_classifier.train([("aaaa bbbb cc dd", 1), ("#### $$$$ x#x#x#x#", 0), ("some words of text", 1), ("1234 1234 1234", 0)] * 10, epochs=3)
    texts = ["", "a", "#### a #### b ####", "words " * 20, "Ünï日本 " * 5, "one two three four " * 4, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, net).collect()}
    assert all(abs(got[k] - direct_score(net, x)) < 1e-4 for k, x in enumerate(texts))


def ranks(scores):
    order = np.argsort(scores)
    out = np.empty(len(scores))
    out[order] = np.arange(len(scores))
    return out


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in registry.table(spark, sf, "labels").collect()}
    rows = [r for r in registry.op1_quality_classifier(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) and labels[r["doc_id"]]["quality"] is not None]
    y, place = np.array([labels[r["doc_id"]]["quality"] for r in rows]), ranks(np.array([r["score"] for r in rows]))
    ones = y == 1
    assert (place[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum()) > 0.9  # the area under the curve


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in registry.table(spark, sf, "labels").collect()}
    docs = registry.table(spark, sf, "documents")
    held = lambda x: F.crc32(F.col(x).cast("string")) % 5 == 0
    chain = toxicity.fit(docs, registry.table(spark, sf, "labels"), allowed=~held("s_id"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.judge(docs.filter(held("doc_id")), chain).collect()}
    toxic = [got[k] for k in got if k in labels and labels[k]["toxic"] == 1]
    clean = [got[k] for k in got if k in labels and labels[k]["toxic"] == 0]
    assert len(toxic) >= 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_samples_do_not_depend_on_the_partitioning(spark):
    from textloom.llm import _labels

    docs = spark.createDataFrame([(k % 20, f"text {k}") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    one, two = (_labels.sample(x, labels, "quality", 10, 1 << 20) for x in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert one == two and len(one) == 10


def test_classifier_without_two_classes(spark, none):
    assert quality_classifier.train([]).score(*_slab("x"))[0] == 1.0
    assert quality_classifier.train([("a", 0)]).score(*_slab("x"))[0] == 0.0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.fit(none, labels).constant == 1.0


def test_labels_of_the_held_out_fold_are_not_read(spark, sf):
    from textloom.llm import _labels

    docs, labels = registry.table(spark, sf, "documents"), registry.table(spark, sf, "labels")
    allowed = F.crc32(F.col("s_id").cast("string")) % 5 != 0
    texts = {t for t, _ in _labels.sample(docs, labels, "quality", 10_000, 1 << 30, allowed)}
    held = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    kept = {r["doc_id"] for r in labels.collect()} - held
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts <= {by[k] for k in kept if k in by}
    assert len(_labels.sample(docs, labels, "quality", 10, 1 << 30)) <= 10


# ---- 2
def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=80):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            linked = sets[i] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o) and sets[j]
            if linked or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    low = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(k)] = min(low.get(find(k), doc_id), doc_id)
    return collections.Counter((doc_id, len(sets[k]), low.get(find(k)) if sets[k] else doc_id) for k, (doc_id, _) in enumerate(rows))


def found_components(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_ngram_join_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found_components(ngram_join.join(odd)) == brute_components(rows)
    assert ngram_join.join(none).count() == 0


def test_ngram_join_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [[f"b{g}w{k}" for k in range(60)] for g in range(3)]
    rows = []
    for k in range(150):
        w = list(base[k % 3])
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            w[at] = f"e{rng.integers(1000)}"
        w = w[: 60 - int(rng.integers(0, 8))] + ["shared", "passage", "of", "many", "words", "here"] * int(rng.integers(0, 2))
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "CHUNK", 16)  # columns of many classes meet in chunks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_components(ngram_join.join(docs)) == brute_components(rows)


def test_one_of_each_component_stays(odd, none):
    kept = ngram_join.keep(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13] and ids.count(None) == 1
    assert ngram_join.keep(none).count() == 0


def test_near_copies_without_an_id_link_documents(spark):
    w = [f"w{k}" for k in range(200)]
    bridge, left, right = w, [*w[:184], *(f"l{k}" for k in range(16))], [*(f"r{k}" for k in range(16)), *w[16:]]
    rows = [(1, " ".join(left)), (2, " ".join(right)), (None, " ".join(bridge)), (None, " ".join(bridge)), (None, "some other text that has no near copy")]
    got = found_components(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_components(rows) and got[(2, 196, 1)] == 1


def test_many_near_copies_stay_linear(spark):
    rng = np.random.default_rng(9)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(300):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            w[at] = f"e{rng.integers(100_000)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_components(ngram_join.join(docs)) == brute_components(rows)


def test_repeated_ids_keep_one_row(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words than those of one", "z"), (None, "a", "n"), (None, "a", "n")]
    kept = [sorted(map(str, (tuple(r) for r in ngram_join.keep(spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(n)).collect()))) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 4


# ---- 3
def test_empty_documents_fill_sequences(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    assert packing.pack(docs, registry.vocabulary()).select("sequence_id").distinct().count() == 2


def test_string_ids_with_nulls(spark):
    rows = [("a", "some text of a few words here", "s"), ("b", None, None), (None, "a text without an id", "s"), (None, None, "s"), ("a", "some text of a few words here", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    benchmark = spark.createDataFrame([("q", "some other item of words")], "item_id string, text string")
    assert packing.pack(docs, registry.vocabulary(), capacity=4).agg(F.countDistinct("sequence_id").alias("n")).first()["n"] > 1
    assert ngram_join.join(docs).count() == quality_rules.judge(docs).count() == decontaminate.find(docs, benchmark).count() == licenses.scan(docs).count() == 5
    assert toxicity.judge(docs, toxicity.train([])).count() == quality_classifier.score(docs, quality_classifier.train([])).count() == 5
    assert packing.pack(docs, registry.vocabulary()).count() == 5 and ngram_join.keep(docs).count() == 4
    folder = runtime.fresh_dir(spark, "tokens")
    token_files.write(docs, folder, registry.vocabulary())
    assert token_files.read(spark, folder, "string").count() == 5


def test_columns_of_any_name_are_kept(spark, odd):
    benchmark = registry.table(spark, "/root/testdata/sf0.001", "benchmark")
    for kept in (quality_rules.keep(odd), toxicity.keep(odd, toxicity.train([])), decontaminate.keep(odd, benchmark), ngram_join.keep(odd)):
        assert kept.schema == odd.schema
        rest = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source")]
        assert kept.select(*(f"`{c}`" for c in rest)).distinct().collect() == odd.select(*(f"`{c}`" for c in rest)).distinct().collect()


def test_packing(odd, none):
    got = packing.pack(odd, registry.vocabulary(), capacity=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for r in odd.filter("doc_id > 1").collect():
        ids = ids_of(r["text"]) + [0]
        want = [(k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for k in range(0, len(ids), 64)]
        assert sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by[r["doc_id"]]) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, registry.vocabulary()).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    bins, offset = packing.best_fit(lengths, 100, 4, 9900, score)
    for b in np.unique(bins):
        inside = lengths[bins == b]
        assert inside.sum() <= 100 and len(inside) <= 4 and (inside**2).sum() <= 9900
    loose, _ = packing.best_fit(lengths, 100, 1000, 10**9, score)
    assert loose.max() + 1 <= 1.2 * np.ceil(lengths.sum() / 100)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 4, 10**9)


# ---- 4
def brute_rule(url, rules):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_filters(spark):
    rules = [*url_filters.RULES, ("block", "a.example.com", "/"), ("allow", "a.example.com", "/en/"), ("block", "a.example.com", "/en/7/x")]
    urls = ["http://a.example.com/en/7/x", "http://A.EXAMPLE.com/en/75", "http://b.a.example.com/q?x=/en/", "https://x.net/de/8", "https://example.net/de/80#f", "https://notexample.net/de/80", "ftp://org/es/", None, "", "no scheme", "http://", "http://com", "http://com/en/", "http://x.com:80/en/", "http://example.com?/en/", "http://a.b/c://d", "http://com/en/\ny"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    pages = spark.createDataFrame([(k, u, "h", "p", 1) for k, u in rows], "page_id long, url string, host string, path string, copies int")
    got = sorted((tuple(r) for r in url_filters.judge(pages, url_filters.rules_frame(spark, rules)).collect()), key=str)
    assert got == sorted(((k, *brute_rule(u, rules)) for k, u in rows), key=str)
    assert url_filters.judge(pages.limit(0), url_filters.rules_frame(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, url_filters.rules_frame(spark, [])).collect()} == {"allow"}


# ---- 5
def test_licences(spark, odd, none):
    mit = licenses.KNOWN[0][1]
    texts = [(1, "Copyright (c) 2020 Some One\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace(",", "")), (3, mit + " more"), (4, "x\nreleased under the MIT licence.\ny\nLicensed under CC BY-NC 4.0\n")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in texts], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "CC-BY-NC-4.0,MIT")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def rewrapped(text, width):
    """Each paragraph on lines of at most that width."""
    return "\n\n".join(textwrap.fill(" ".join(x.split()), width) for x in re.split(r"\n\s*\n", text))


def test_licences_in_any_wrapping(spark):
    heads = {"MIT": "MIT License\n\nCopyright (c) 2020-2024 Some One", "ISC": "ISC License\n\nCopyright 2019, Some One <a@b.org>", "Zlib": "zlib License\n\n(C) 2019 Some One", "0BSD": "Copyright Some One", "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) Some Inc.\nAll rights reserved.", "BSD-3-Clause": "Copyright \u00a9 2021 A\nCopyright (c) 2022 B"}
    whole = [(k, x) for k, x in licenses.known_texts() if len(x) > 300]
    assert sorted(k for k, _ in whole) == ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
    texts = [(k, head + y) for k, x in whole for head in ("", heads.get(k, "") + "\n\n") for y in (x, " ".join(x.split()), *(rewrapped(x, w) for w in (60, 66, 72, 78, 80, 95, 120)))]
    apache = next(x for k, x in whole if k == "Apache-2.0")
    gpl = next(x for k, x in whole if k == "GPL-3.0")
    texts += [("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2024 Some One")), ("GPL-3.0", gpl[: gpl.index("How to Apply")])]
    mit = next(x for k, x in whole if k == "MIT")
    texts += [(None, mit.replace("COPYRIGHT HOLDERS", "OWNERS")), (None, mit.replace("\nCOPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR", "")), (None, mit + "\n\ncopyright law applies")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).collect()}
    assert [(k, i, texts[i][1][:60]) for i, (k, _) in enumerate(texts) if got[i] != k] == []


# ---- 6
def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_rule_counts(spark, odd, none):
    texts = ["a b c d e a b c d e", "x\nx\n\n x\nx ", "é# é#\n|", "a a a a a a a", "l1\nl1\r\nl1", *(r["text"] for r in odd.collect())]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["row"]["doc_id"]: tuple(r[f"q_{c}"] for c in quality_rules.COUNTS) for r in quality_rules.base(docs, ["doc_id"]).collect()}
    assert got == {k: brute_counts(t) for k, t in enumerate(texts)}
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_hosts_are_shrunk_and_clean_documents_stay(spark):
    clean = " ".join(f"word{k}" for k in range(30))
    junk, light = "### " * 30, clean + " # # "
    rows = [(k, junk, "bad") for k in range(50)] + [(50, clean, "bad"), (51, light, "bad"), (52, light, "good"), (53, junk, "tiny")] + [(100 + k, clean, f"h{k % 10}") for k in range(100)] + [(300, clean, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["host_rejected"] and not got[0]["kept"] and got[50]["kept"] and not got[51]["kept"] and got[52]["kept"] and got[300]["kept"]
    assert got[53]["host_rate"] < got[0]["host_rate"]


# ---- 7
def test_templates_and_slots(spark):
    item = "In the shop Alice buys 3 kg of apples for Bob and then Alice sells 3 kg again to them all"
    benchmark = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    same = "Before it. " + item + ". After it"
    other = item.replace("Alice", "Dora").replace("Bob", "Ed").replace("3", "75")
    broken = other.replace("then Dora", "then Zoe").replace("sells 75", "sells 8")
    rows = [(1, same), (2, "x " + other.replace("In", "in")), (3, broken), (4, None), (5, ""), (6, "plain words that match nothing at all here today")]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, item_id string")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["reparameterised"]) for r in decontaminate.find(docs, benchmark).collect()}
    assert got[1] == (True, 1, False) and got[2] == (True, 1, True) and all(not got[k][0] for k in (3, 4, 5, 6))
    assert [r["doc_id"] for r in decontaminate.keep(docs, benchmark).orderBy("doc_id").collect()] == [3, 4, 5, 6]
    assert decontaminate.find(docs, benchmark.limit(0)).filter("contaminated").count() == 0 and decontaminate.find(docs.limit(0), benchmark).count() == 0


def test_one_conflicting_slot_leaves_literal_windows(spark):
    item = "On the market Alice buys 3 kg of red apples for the old baker and after the rain has stopped she sells 3 kg to him"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("sells 3", "sells 8")), (2, item.replace("buys 3", "buys 8")), (3, item.replace("sells 3 kg to", "sells 3 kg near"))]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got[1] == got[2] == got[3] == (True, False)


def test_names_that_open_sentences_and_glued_units(spark):
    items = [(1, "Tom has 5 apples. Tom buys 7 more. Tom gives 4 away. Tom eats 2. How many are left?"), (2, "Yesterday Mr. Smith ran 5kg of flour to town and Mr. Smith came 12th of the men"), (3, "A shop sells pens at 4 cents each and a child buys 10 of them with 50 cents left over")]
    renamed = [items[0][1].replace("Tom", "Ann").replace("5", "6").replace("7", "9").replace("4", "3").replace("2", "1"), items[1][1].replace("Smith", "Jones").replace("5kg", "8 tons").replace("12th", "1st"), items[1][1].replace("5kg", "5 kg")]
    rows = [*enumerate(renamed), (3, items[0][1]), (4, "so " + items[1][1].lower()), (5, renamed[0].replace("Ann buys", "Bob buys")), (6, items[0][1].replace("has", "had").replace("buys", "sold").replace("gives", "gave"))]
    got = {r["doc_id"]: (r["item_id"], r["reparameterised"]) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[0] == (1, True) and got[1] == (2, True) and got[2] == (2, False) and got[3] == (1, False) and got[5] == got[6] == (None, None)


def test_short_items_must_occur_word_for_word(spark):
    items = [(1, "Quokka"), (2, "seven zebras"), (3, "What is two plus?"), (4, "5 kg"), (5, "?!")]
    rows = [(1, "I saw a quokka today"), (2, "there were Seven zebras."), (3, "so what is two plus three"), (4, "it weighs 5 kg now"), (5, "it weighs 6 kg now"), (6, "what is three plus two ?!")]
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None}


def template_of(text, second):
    """(template, value) of each token by the module's rules, for texts without glued units, ordinals and accents."""
    out, opens, before = [], True, None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        raw, word = m[0], m[0].strip("\"'`.,;:!?()[]{}<>*_#|&~-")
        if word:
            low = word.lower()
            number = bool(re.search("[0-9]", word)) and not re.search("[A-Za-z]", word)
            name = bool(re.match("[A-Z]", word) and re.search("[a-z]", word)) and (not opens or second and low not in decontaminate.OPENERS)
            kind = "N" if number else "U" if before and low in decontaminate.UNITS else "P" if name else None
            out.append((kind, low))
        before = bool(word) and bool(re.search("[0-9]", word)) and not re.search("[A-Za-z]", word)
        opens = raw[-1] in ".!?" or text[m.end() : m.end() + 1] == "\n"
    return out


def brute_contaminated(doc, item, width=8, coverage=0.5):
    covered = set()
    total = len(template_of(item, False))
    for second in (False, True):
        a, b = template_of(doc, second), template_of(item, second)
        shape = lambda x: [v if total < 5 else k or v for k, v in x]
        w = min(width, total)
        for shift in range(-len(b), len(a) + 1):
            begins = [q for q in range(total - w + 1) if 0 <= q + shift <= len(a) - w and shape(a[q + shift : q + shift + w]) == shape(b[q : q + w])]
            places = {q + j for q in begins for j in range(w)}
            seen = {}
            same = all(seen.setdefault(b[p], a[p + shift][1]) == a[p + shift][1] for p in sorted(places) if b[p][0])
            if total >= 5 and not same:
                places = {q + j for q in begins if all(a[q + shift + i][1] == b[q + i][1] for i in range(w)) for j in range(w)}
            covered |= places
    return total > 0 and len(covered) >= coverage * total


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words, names = "the man buys red apples and sells pens to his old friend at noon while it rains over town".split(), ["Alice", "Bob", "Cleo", "Dan"]

    def sentence():
        pool = [*words, *names, "3", "17", "kg", "km", "2.5"]
        return " ".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(3, 16))) + "."

    items = [(k, " ".join(sentence() for _ in range(rng.integers(1, 4)))) for k in range(25)]
    rows = []
    for k in range(150):
        text = [sentence() for _ in range(3)]
        for _ in range(rng.integers(0, 3)):
            item = items[rng.integers(len(items))][1].split()
            a, b = sorted(rng.integers(0, len(item) + 1, 2))
            item = item[a:b] if rng.random() < 0.5 else item
            if rng.random() < 0.5:
                item = [{"Alice": "Zoe", "Bob": "Yann", "3": "4", "17": "18"}.get(x, x) for x in item]
            text.insert(1, " ".join(item))
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k: sum(brute_contaminated(t, item) for _, item in items) for k, t in rows}
    assert {k: n for k, (_, n) in got.items()} == want and all(hit == (n > 0) for hit, n in got.values()) and 20 < sum(n > 0 for n in want.values()) < 150


def test_shards_give_the_same_result(spark, sf):
    docs, benchmark = registry.table(spark, sf, "documents"), registry.table(spark, sf, "benchmark")
    one = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in decontaminate.find(docs, benchmark).collect()}
    many = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in decontaminate.find(docs, benchmark, shard_windows=500).collect()}
    assert one == many and len(one) == docs.count()
    items = [" ".join(r["text"].split()) for r in benchmark.collect()]
    holding = {r["doc_id"] for r in docs.collect() if any(x in " ".join(r["text"].split()) for x in items)}
    assert holding <= {k for k, (hit, _) in one.items() if hit}
    assert decontaminate.keep(docs, benchmark, shard_windows=500).count() == sum(not hit for hit, _ in one.values())


def test_shards_keep_every_row(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(3)]
    rows = [(1, items[0][1]), (1, items[1][1]), (1, items[0][1]), (2, "other words"), (None, items[2][1]), (None, None), (None, "more")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((tuple(r) for r in decontaminate.find(docs, benchmark, shard_windows=size).collect()), key=str) for size in (1_000_000, 10))
    assert one == many and len(one) == len(rows) and sum(r[1] for r in one) == 4


# ---- 8
def test_token_files(spark, odd, none):
    folder = runtime.fresh_dir(spark, "tokens")
    manifest = token_files.write(odd.filter("doc_id > 1"), folder, registry.vocabulary(), sequence=128, batch=4, files=3)
    rows = sorted((r["doc_id"], r["text"]) for r in odd.filter("doc_id > 1").collect())
    want, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(text) + [1]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_files.read(spark, folder).collect())) == want
    stream = [x for _, text in rows for x in ids_of(text) + [1]]
    got = []
    for r in manifest.orderBy("part").collect():
        reader = token_files.open_sequences(r["path"])
        n = -(-r["n_tokens"] // 128)
        for k in range(n):
            ids, valid = token_files.sequence_at(reader, k)
            assert len(ids) == len(valid) == 128
            got += ids[valid].tolist()
    assert got == stream
    folder = runtime.fresh_dir(spark, "tokens")
    token_files.write(none, folder, registry.vocabulary())
    assert token_files.read(spark, folder).count() == 0


# ---- 9
def test_chain(spark, odd, none):
    clean = [(f"the {a} {b} was such a {w} here and went {k}", 0) for k in range(5) for a in ("red", "old") for b in ("cat", "dog") for w in ("friend", "helper")]
    toxic = [(f"the {a} {b} was such a {w} here and went {k}", 1) for k in range(5) for a in ("red", "old") for b in ("cat", "dog") for w in ("moron", "worthless")]
    rows = [x for pair in zip(clean, toxic, strict=True) for x in pair]
    chain = toxicity.train(rows)
    assert chain.categories == ["kind_1", "kind_2", "toxic"]
    assert [len(w) for w in chain.weights] == [2 * len(chain.words) + k + 1 for k in range(3)]
    docs = spark.createDataFrame([(1, "the old man was such a moron here", 9), (2, "the old man was such a friend here", 9), (3, None, 9), (4, "the old cat was worthless", 9)], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, chain).collect()}
    assert got[1]["toxic"] and got[4]["toxic"] and not got[2]["toxic"] and not got[3]["toxic"] and (got[1]["p_kind_1"] > 0.5) != (got[4]["p_kind_1"] > 0.5)
    assert [r["doc_id"] for r in toxicity.keep(docs, chain).orderBy("doc_id").collect()] == [2, 3]
    assert toxicity.judge(odd, chain).count() == odd.count() and toxicity.judge(none, chain).count() == 0
    assert not toxicity.judge(odd, toxicity.train([])).filter("toxic").count()


def test_chain_against_direct_features(spark):
    from textloom.llm import _text

    rows = [(f"some {a} words of {b} kind {k}", int(a in ("nasty", "vile"))) for k in range(8) for a in ("nasty", "vile", "decent", "lovely") for b in ("every", "another")]
    chain = toxicity.train(rows)
    texts = ["nasty nasty things", "", "decent VILE-vile anotherness", "Ünï nastyness 12", None, "lovely", "zzz qqq unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [r[f"p_{c}"] for c in chain.categories] for r in toxicity.judge(docs, chain).collect()}
    name = lambda x: int(_text.span_hashes(*(lambda d: (d[0], d[1][:-1], d[1][1:]))(_text.joined([x])))[0])
    short = lambda x: int(_text.mix(np.array([name(x)], np.uint64))[0])
    for k, text in enumerate(texts):
        words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")]
        units = collections.Counter(name(w) for w in words)
        for size in toxicity.PREFIXES:
            units.update(short(w[:size]) for w in words if w.isascii() and len(w) > size)
        x = [float(units[int(u)] > 0) for u in chain.words] + [min(units[int(u)] / max(1, len(words)) / toxicity.DENSE, 2) for u in chain.words]
        known = any(x)
        for w, p in zip(chain.weights, got[k], strict=True):
            x.append(1 / (1 + np.exp(-(np.dot(x, w[:-1]) + w[-1]))) if known else 0)
            if known:
                assert abs(x[-1] - p) < 1e-4
            else:
                assert p == 0


# ---- 10
def test_archives(spark):
    long, short = "<p>é</p>" * 200, "<p>short</p>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, short), (4, "http://a/ 4", short), (5, "u", None), (6, "u", ""), (9, "u", long), (9, "u", long), (None, "u", long), (7, "u", "z\r\n\r\nWARC/1.1" * 100)]
    pages = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, response string")
    folder = runtime.fresh_dir(spark, "warc")
    manifest = warc.write(pages.repartition(2), folder)
    got = warc.read(spark, folder).collect()
    body = lambda x: (x or "").encode()
    want = collections.Counter()
    for page_id, _, html in rows:
        revisit = html == long and page_id != 9
        want[page_id, len(body(html)), hashlib.sha1(body(html)).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["payload"] is None or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got)
    for r in manifest.collect():
        raw = open(r["path"].removeprefix("file://"), "rb").read(4)
        assert int.from_bytes(raw, "little") == warc.MAGIC
    folder = runtime.fresh_dir(spark, "warc")
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


def test_trained_dictionary_helps():
    import zstandard

    samples = [f"<html><head><title>page {k}</title></head><body class='main'>{k * 7919}</body></html>".encode() * 3 for k in range(400)]
    dictionary = warc.build_dictionary(samples, 4096)
    with_it, without = zstandard.ZstdCompressor(dict_data=dictionary), zstandard.ZstdCompressor()
    assert sum(len(with_it.compress(x)) for x in samples) < sum(len(without.compress(x)) for x in samples)
    assert warc.build_dictionary([b"x"], 4096).as_bytes()


# ---- registry
def test_queries_have_the_contracts_columns(spark, sf):
    wanted = {
        "op1_quality_classifier": ["doc_id", "held_out", "score", "predicted"], "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
        "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4_url_filters": ["page_id", "host", "path", "rule", "verdict"],
        "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    }
    for name, columns in wanted.items():
        assert registry.queries()[name](spark, sf).columns[: len(columns)] == columns


def test_pipeline_against_its_operators(spark, sf):
    import corpus_pipeline

    docs = registry.table(spark, sf, "documents")
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        kept = runtime.stored(stage(spark, kept, sf), "test-stage")
        assert kept.columns == docs.columns, name
        after = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        assert all(before[k] == after[k] for k in after) and after
        if name == "n-gram Jaccard join":
            rows = sorted(before.items())
            assert set(after) == {c for _, _, c in brute_components(rows)}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_stages_begin_with_a_collection_of_the_executors(spark, sf):
    """The executors of this session are its driver's JVM, so that its full collections are counted."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = registry.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs.limit(0), sf)
        assert full() > before, name


def test_pipeline_on_odd_rows(spark, odd, none, sf):
    import corpus_pipeline

    for docs in (odd, none):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = runtime.stored(stage(spark, kept, sf), "odd-stage")
            assert kept.schema == docs.schema, name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        packed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()}
        assert packed == set(ids) and all(ids.count(x) == 1 for x in ids if x is not None)
        if docs is odd:
            assert None in ids and 1 in ids and 7 in ids and not {4, 5, 6, 8, 9, 10} & set(ids)


def test_sql_agrees(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect()), name
    assert isinstance(pa.__version__, str)
