import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as scalar
from textloom.operators import counting, graph, index, joins, ledger, quality, retrieval, review, search


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "a b c a"), (1, "b a"), (2, ""), (3, None), (4, "the cat the mat"), (5, "mat the x cat the")], "doc_id long, text string")


def test_boolean_queries(docs):
    from textloom.functions import text as scalar

    words = scalar.tokens(F.lower("text"))
    find = lambda q: [r[0] for r in docs.filter(search.predicate(q, words)).select("doc_id").orderBy("doc_id").collect()]
    assert find(search.Term("a")) == [0, 1]
    assert find(search.Term(" ")) == []
    assert find(search.Phrase(("the", "mat"))) == [4]
    assert find(search.Bool(must=(search.Term("the"),), must_not=(search.Term("x"),))) == [4]
    assert find(search.Bool(must=(search.Term("the"), search.Term("")))) == []
    assert find(search.Bool(should=(search.Term("c"), search.Term("x")))) == [0, 5]
    with pytest.raises(ValueError):
        search.satisfiable(search.Bool(must_not=(search.Term("a"),)))


def test_near_is_greedy(spark):
    one = spark.createDataFrame([(0, "a b b x c"), (1, "a b x c")], "doc_id long, text string")
    assert rows_of(search.near(one, ["a", "b", "c"], 1)) == [(1, 0)]
    assert rows_of(search.unordered_near(one, ["b", "a"], 0)) == [(0, 0), (1, 0)]


def test_patterns_are_bounded(docs):
    for bad in (".*a", ".+a", "x" * 513):
        with pytest.raises(ValueError):
            search.validate_pattern(bad)
    assert rows_of(search.regex_search(docs, "^c")) == [(0, 1), (4, 1), (5, 1)]


def test_bm25_prefers_rarer_terms(docs):
    got = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["cat", "x"]).collect()}
    assert set(got) == {4, 5} and got[5] > got[4]


def test_ranges():
    assert search.parse_range("3-7") == (3, 7) and search.parse_range("3-") == (3, None) and search.parse_range("-7") == (None, 7) and search.parse_range("3") == (3, 3)
    for bad in ("", "-", "7-3", "x"):
        with pytest.raises(ValueError):
            search.parse_range(bad)


def test_cooccurrence_against_loops(spark):
    rng = random.Random(1)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(20)]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    want: dict[str, int] = {}
    for w in texts:
        for i, j in itertools.product(range(len(w)), repeat=2):
            if w[i] == "a" and w[j] != "a" and abs(i - j) <= 2:
                want[w[j]] = want.get(w[j], 0) + 1
    assert dict(map(tuple, counting.cooccurrence(docs, F.col("text"), "a", 2).collect())) == want


def test_modes_and_runs(spark):
    a = spark.createDataFrame([(1, "r"), (1, "s"), (2, "r"), (3, "r"), (3, "r")], "token int, root string")
    assert rows_of(counting.votes(a, ["token"], "root", "all_analyses")) == [("r", 4), ("s", 1)]
    assert rows_of(counting.votes(a, ["token"], "root", "one_vote_per_token")) == [("r", 3), ("s", 1)]
    assert rows_of(counting.votes(a, ["token"], "root", "single_source")) == [("r", 1)]
    runs = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabba")], "g int, o int, v string")
    assert rows_of(counting.run_lengths(runs, "g", "o", "v")) == [(0, "a", 0, 1, 2), (0, "a", 4, 4, 1), (0, "b", 2, 3, 2)]


def test_graph_against_brute_force(spark):
    rng = random.Random(5)
    pairs = {(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(18)}
    pairs = {(a, b) for a, b in pairs if a != b}
    edges = spark.createDataFrame([(a, "E", b) for a, b in sorted(pairs)], "src string, edge string, dst string")
    near: dict[str, set] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front = {"v0": 0}, {"v0"}
    for hop in range(1, 4):
        front = {y for x in front for y in near.get(x, ())} - set(seen)
        seen |= {x: hop for x in front}
    got = graph.distances(edges, spark.createDataFrame([("v0",)], "node string"), 3)
    assert dict(map(tuple, got.collect())) == seen
    found = []

    def walk(path):
        if path[-1] == "v1" and len(path) > 1:
            found.append(tuple(path))
            return
        if len(path) <= 4:
            for y in near.get(path[-1], ()):
                if y not in path:
                    walk([*path, y])

    walk(["v0"])
    paths = graph.paths(edges, "v0", "v1", graph.Budget(hops=4, paths=1000))
    assert sorted(tuple(r["path"]) for r in paths.collect()) == sorted(found)


def test_graph_visibility(spark):
    edges = spark.createDataFrame([("a", "E", "b", None), ("b", "E", "c", "x"), ("c", "E", "d", "y"), ("d", "E", "e", "z")], "src string, edge string, dst string, assertion_id string")
    assertions = spark.createDataFrame([("x", "accepted"), ("y", "rejected")], "id string, decision string")
    assert sorted(r["dst"] for r in graph.visible(edges, assertions).collect()) == ["b", "c", "e"]
    assert sorted(r["dst"] for r in graph.visible(edges, assertions, ["x", "z"]).collect()) == ["b", "c"]
    assert sorted(r["dst"] for r in graph.visible(edges, assertions, []).collect()) == ["b"]


def test_budgets_bind_and_say_so(spark):
    edges = spark.createDataFrame([("a", "E", f"b{k:02d}") for k in range(20)] + [(f"b{k:02d}", "E", f"c{k:02d}") for k in range(20)], "src string, edge string, dst string")
    assert graph.bounded(edges, "a", 2, graph.Budget(nodes=100), "out").reason is None
    cut = graph.bounded(edges, "a", 2, graph.Budget(edges=5), "out")
    assert cut.truncated and "edges" in cut.reason and cut.nodes.count() == 6 and cut.edges.count() == 5
    assert "hops" in graph.bounded(edges, "a", 3, graph.Budget(hops=1), "out").reason
    for bad in ({"hops": 0}, {"hops": 33}, {"paths": 1001}, {"fanout": 10_001}):
        with pytest.raises(ValueError):
            graph.Budget(**bad)
    with pytest.raises(KeyError):
        graph.resolve(edges.select(F.col("src").alias("node")), "zz")
    with pytest.raises(ValueError):
        graph.pattern(edges, edges.select(F.col("src").alias("node")), [("E", "out")], graph.VOCABULARY)
    with pytest.raises(ValueError):
        graph.pattern(edges, edges, "MATCH (a)")


def test_paths_are_explained(spark):
    edges = spark.createDataFrame([("a", "NEXT", "b", None), ("c", "CITES", "b", "x"), ("c", "CITES", "d", "y")], "src string, edge string, dst string, assertion_id string")
    assertions = spark.createDataFrame([("x", "me", 0.5)], "id string, reviewer string, confidence double")
    got = [(r["step"], r["edge"], r["provenance"]) for r in graph.explain_path(["a", "b", "c", "d"], edges, assertions).collect()]
    assert got == [(0, "NEXT", "structural"), (1, "CITES", "assertion"), (2, "CITES", "missing")]


def test_identities_and_lineage_find_circles(spark):
    narrators = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    with pytest.raises(ValueError):
        review.identities(narrators, spark.createDataFrame([(1, 2), (2, 1)], "id int, superseded_by int"))
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "child string, parent string")
    assert sorted((r["source"], r["depth"]) for r in review.lineage(diamond, "a").collect()) == [("b", 1), ("c", 1), ("d", 2), ("d", 2)]
    with pytest.raises(ValueError):
        review.lineage(diamond.union(spark.createDataFrame([("d", "a")], "child string, parent string")), "a")


def test_index_queries_equal_scans(spark, tmp_path):
    texts = ["The cat of the house", "", None, "of the of the of", "cat  house", "THE the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = index.TextIndex.at(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        one.forms()
    one.build(docs)
    words = scalar.tokens(F.lower(F.coalesce("text", F.lit(""))))
    some = (
        search.Term("the"), search.Term(" "), search.Phrase(("of", "the", "of")), search.Phrase(("the", "the")), search.All(), search.Bool(must=(search.Term("the"),), must_not=(search.Term("cat"), search.Term(""))),
        search.Bool(should=(search.Term("cat"), search.Phrase(("of", "the")))), search.Bool(must=(search.All(),), should=(search.Term("cat"),)),
    )
    for query in some:
        assert rows_of(one.ids(query)) == rows_of(docs.filter(search.predicate(query, words)).select("doc_id")), query
    for terms, ordered in ((["of", "the"], True), (["the", "of"], False)):
        plain = (search.near if ordered else search.unordered_near)(docs, terms, 1)
        assert rows_of(one.near(terms, 1, ordered)) == rows_of(plain)
    scores = lambda rows: {r["doc_id"]: round(r["score"], 9) for r in rows.collect()}
    assert scores(one.bm25(["the", "cat"])) == scores(search.bm25(docs, ["the", "cat"]))
    page, total, more = one.search(search.Term("the"), 1)
    assert (page.count(), total, more) == (1, 3, True)
    for bad in (search.Bool(must_not=(search.Term("x"),)), search.Bool(must=(search.Range("size", 1),))):
        with pytest.raises(ValueError):
            one.ids(bad)
    for bad in (".*x", "x" * 600):
        with pytest.raises(ValueError):
            one.regex(bad)


def test_index_that_fails_is_not_published(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    one = index.TextIndex.at(spark, str(tmp_path / "i"))
    one.build(docs)
    monkeypatch.setattr(index.TextIndex, "verify", lambda self, docs, g=None: spark.createDataFrame([("lost", "1", "a")], "problem string, id string, token string"))
    with pytest.raises(ValueError):
        one.build(docs)
    assert one.generations.pointer.current() == 1 and one.generations.builds() == [1, 2]


def test_rate_limits():
    limiter = search.RateLimiter(2, 60)
    assert [limiter.allow("a", t) for t in (0, 1, 2, 60.5, 61.5)] == [True, True, False, True, True] and limiter.allow("b", 2)
    with pytest.raises(PermissionError):
        search.guarded_regex(None, "x", "a", limiter, 0, ["b"])


def test_near_passages_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(6)]
    texts = []
    for k in range(60):
        x = list(base[k % 6])
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(120)] = rng.choice("xyz")
        texts.append("".join(x))
    texts += ["", "ab", "a b", texts[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    skeleton = [x.replace(" ", "") for x in texts]
    grams = [{s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in skeleton]
    first = {s: skeleton.index(s) for s in skeleton if s}
    reps = sorted(first.values())
    want = sorted((a, b) for a in reps for b in reps if a < b and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b]))
    got = sorted((r["low"], r["high"]) for r in joins.near_passages(rows, "id", "text", 0.7, slots=0).collect())
    assert got == want and got
    assert {(r["id"], r["representative"]) for r in joins.passage_classes(rows, "id", "text").collect()} == {(k, first[s]) for k, s in enumerate(skeleton) if s}


def test_near_passages_shuffle_prefixes_only(spark, monkeypatch):
    """In any number of groups the pairs are those of all shingles, and the postings hold the prefixes and nothing else."""
    import random

    import numpy as np

    from textloom import runtime
    from textloom.operators import passages

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé\U0001f600") for _ in range(400)) for _ in range(4)]
    texts = [x[: rng.randint(300, 400)] + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for x in base * 15] + ["ab", "abc", "abcde", "é"]
    grams = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    rows = runtime.stored(spark.createDataFrame(list(enumerate(texts)), "at long, skeleton string"), "test-passages")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    for groups, part in ((1, 100), (4, 10**6), (60, 50), (None, 10**6)):
        monkeypatch.setattr(passages, "PART", part)
        got = {(r["a"], r["b"]): r["jaccard"] for r in passages.near(rows, 0.8, 5, groups).collect()}
        assert set(got) == want and got
        assert all(got[a, b] == len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a, b in got)
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    posted = passages.postings(rows, 0.8, 5, 4, none).agg({"size": "sum"}).first()[0]
    assert posted == sum(len(x) - -(-4 * len(x) // 5) + 1 for x in grams)
    assert passages.near(rows.limit(0), 0.8, 5).count() == 0


def test_near_passages_by_parts_of_all_sizes(spark, monkeypatch):
    """By parts the pairs are those of all shingles, across classes of sizes and in any number of groups."""
    import random

    from textloom import runtime
    from textloom.operators import passages

    rng = random.Random(12)
    texts = []
    for size in (1, 4, 5, 6, 7, 8, 10, 12, 13, 16, 20, 26, 40, 60, 88, 130, 200, 290, 500, 1200):
        base = "".join(rng.choice("abcdefgh\U0001f600") for _ in range(size))
        for k in range(12):
            x = list(base[: max(1, size - rng.randint(0, size // 4))])
            for _ in range(rng.randint(0, size // 40 + (k > 8))):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            texts.append("".join(x))
    texts = sorted(set(texts))
    grams = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    rows = runtime.stored(spark.createDataFrame(list(enumerate(texts)), "at long, skeleton string"), "test-parts")
    for threshold in (0.6, 0.8):
        want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b])}
        for fewest, most in ((1, 10**6), (12, 10**6), (12, 900)):
            monkeypatch.setattr(passages, "FEWEST", fewest)
            monkeypatch.setattr(passages, "CLASS_GROUP", most)
            got = {(r["a"], r["b"]): r["jaccard"] for r in passages.near(rows, threshold, 5).collect()}
            assert set(got) == want and got
            assert all(got[a, b] == len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a, b in got)


def test_near_passages_of_few_words_form_few_pairs():
    """Texts of the same few words share single shingles of their prefixes, but hardly a column of several."""
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.operators import passages

    def formed(columns):
        count = np.unique(np.concatenate(columns), return_counts=True)[1]
        return int((count * (count - 1) // 2).sum())

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    texts = ["".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    (_, data, off), *_ = passages.slabs(pa.array(texts))
    h, first = passages.sets_of(data, off, 5)
    n, classes = np.diff(first), passages.Classes(0.8)
    known, number, count = np.unique(h, return_inverse=True, return_counts=True)
    order = np.lexsort((h, count[number], np.repeat(np.arange(len(n)), n)))
    single = [h[order][a : a + size - -(-4 * size // 5) + 1] for a, size in zip(first[:-1].tolist(), n.tolist(), strict=True)]
    rarity, by_parts = np.rint(16 * np.log2(len(n) / count[number])).astype(np.int64), 0
    for c, some in classes.of(n):
        mine = np.repeat(np.isin(np.arange(len(n)), some), n)
        col = passages.columns_of(h[mine], n[some], rarity[mine], classes.parts(c))
        length = classes.length(n[some], c, passages.FEWEST)
        assert (length <= classes.parts(c)).all()
        by_parts += formed([col[np.arange(col.shape[1]) < length[:, None]]])
    assert 5 * by_parts < formed(single)


def test_range_join_and_context(spark):
    points = spark.createDataFrame([("g", 1), ("g", 5), ("g", 9), ("h", 1)], "g string, p int")
    ranges = spark.createDataFrame([("g", 0, 3, "x"), ("g", 5, 8, "y")], "g string, first int, last int, name string")
    assert rows_of(joins.in_ranges(points, ranges, "g", "p").select("g", "p", "name")) == [("g", 1, "x"), ("g", 5, "y")]


def test_dice_is_a_multiset_overlap(spark):
    docs = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a a a c"), (8, "z")], "item_id long, text string")
    got = joins.multiset_dice(docs, items, "doc_id", "item_id", F.col("text")).collect()
    assert [(r["item_id"], r["shared"], round(r["score"], 6)) for r in got] == [(7, 2, round(4 / 7, 6))]


def test_citations(spark):
    texts = spark.createDataFrame([(1, "ab cd"), (2, "ab cd"), (3, "ab cd"), (5, "abc")], "k int, text string")
    quotes = spark.createDataFrame([(1, "ab cd"), (2, " ab  cd"), (3, "ab xd"), (4, "q"), (5, "ab")], "k int, q string")
    got = {r["k"]: (r["verdict"], r["first_difference"]) for r in retrieval.verify_citations(quotes, texts, "k", "q", "text").collect()}
    assert got == {1: ("exact", None), 2: ("whitespace", None), 3: ("mismatch", 3), 4: ("not_found", None), 5: ("mismatch", 2)}


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    got = {r["id"]: r["score"] for r in retrieval.rrf([a, a.filter("id = 2")], "id").collect()}
    assert abs(got[1] - 1 / 61) < 1e-12 and abs(got[2] - 2 / 62) < 1e-12
    with pytest.raises(KeyError):
        retrieval.federate({}, ["none"])


def test_a_clean_edition_has_no_errors(spark):
    edition = spark.createDataFrame([("ar", 1, 2, "NFC", "per_surah")], "language string, surah_count int, ayah_count int, unicode_normalization string, basmala_policy string")
    surahs = spark.createDataFrame([(1, 2, "mecca", "none")], "number int, ayah_count int, revelation_place string, basmala string")
    schema = "line int, surah int, ayah int, text string, juz int, hizb int, rub int, manzil int, page int, sajdah string"
    clean = [(0, 1, 1, "بسم", 1, 1, 1, 1, 1, None), (1, 1, 2, "الله", 1, 1, 1, 1, 1, None)]
    assert quality.validate_edition(edition, surahs, spark.createDataFrame(clean, schema)).count() == 0
    shifted = [(*x[:2], x[2] - 1, *x[3:]) for x in clean]  # numbers that begin at 0
    assert [r["rule"] for r in quality.validate_edition(edition, surahs, spark.createDataFrame(shifted, schema)).collect()] == ["QV-005"]
    turned = [(1 - x[0], *x[1:]) for x in clean]
    assert [r["rule"] for r in quality.validate_edition(edition, surahs, spark.createDataFrame(turned, schema)).collect()] == ["QV-023"]
    assert quality.validate_edition(edition, surahs, spark.createDataFrame([], schema)).filter("rule IN ('QV-003', 'QV-004')").count() == 2


def test_previous_rows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 4)
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else k * 10) for k in range(30)], "line int, v int")
    got = {r["line"]: r["before"] and r["before"]["v"] for r in quality.with_previous(rows, "line", ["v"]).collect()}
    known = [k for k in range(30) if k % 5]
    assert got == {k: (known[i - 1] * 10 if i else None) for i, k in enumerate(known)}


def test_ledgers(spark):
    log = spark.createDataFrame([(1,), (2,), (4,), (5,)], "seq long")
    assert rows_of(ledger.sequence_gaps(log, "seq")) == [(4,)]
    jobs = spark.createDataFrame([(1, "queued", 1, 5), (2, "queued", 9, 50), (3, "done", 9, 1), (4, "interrupted", 3, 4)], "id int, state string, priority int, available_at int")
    assert [r["id"] for r in ledger.claim(jobs, F.lit(10), 2).collect()] == [4, 1]
    events = spark.createDataFrame([("a", 1, "new"), ("a", 2, "done"), ("b", 1, "done")], "e string, o int, state string")
    assert [(r["e"], r["o"]) for r in ledger.transitions(events, "e", ["o"], "state", [(None, "new"), ("new", "done")]).collect()] == [("b", 1)]


def test_families_give_every_pair(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "c"), ("l", 5, "a"), ("l", 6, "b"), ("l", 1, "c"), ("m", 7, "a"), (None, 8, "a"), (None, 9, "b"), ("k", 1, "a")]
    frame = spark.createDataFrame(rows, "key string, item int, kind string")
    classes = [tuple(r) for r in joins.family_classes(frame, "key", "item", "kind").collect()]
    members = [tuple(r) for r in joins.family_members(frame, "key", "item", "kind").collect()]
    derived = sorted((key, x, y) for key, lo, low, hi, high in classes for k1, c1, x, r1 in members if (k1, c1, r1) == (key, lo, low) for k2, c2, y, r2 in members if (k2, c2, r2) == (key, hi, high))
    assert derived == sorted({(k, x, y) for k, x, a in rows for j, y, b in rows if k is not None and k == j and a < b}) and len(derived) == 8


def test_signatures_of_documents(spark, tmp_path):
    import hashlib

    from textloom.plans import registry

    texts = ["the cat sat on the mat", "abc", "ab" * 2000, "Ünï cödé"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: rows_of(registry.queries()[name](spark, str(tmp_path))) for name in ("minhash64_documents", "tok_trigrams", "tok_shingles")}
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in texts]
    grams = [sorted({x[k : k + 3] for k in range(len(x) - 2)}) for x in texts]
    least = lambda g, slot: min(hashlib.sha256(f"{slot}:{x}".encode()).hexdigest()[:16] for x in g)
    digest = lambda g: hashlib.sha256("|".join(sorted(g)).encode()).hexdigest()
    assert got["minhash64_documents"] == sorted(((d, k, least(g, k)) for d, g in enumerate(sets) for k in range(64)), key=str)
    assert got["tok_shingles"] == sorted(((d, len(g), digest(g)) for d, g in enumerate(sets)), key=str)
    assert got["tok_trigrams"] == sorted(((d, len(g), digest(g)) for d, g in enumerate(grams)), key=str)


def test_ranked_phrases_of_many_documents(spark, tmp_path):
    docs = spark.createDataFrame([(k, "of the x") for k in range(1200)], "doc_id long, text string")
    one = index.TextIndex.at(spark, str(tmp_path / "i"))
    one.build(docs)
    assert one.phrase_ranked("of the", limit=None).count() == 1200 and one.phrase_ranked("of the", limit=1000).count() == 1000
    assert one.phrase_ranked("the of", limit=None, fallback=False).isEmpty() and not one.phrase_ranked("the of").isEmpty()


def test_moved_rows_are_misaligned_among_many_conversations(spark, tmp_path):
    from textloom.plans import registry

    rows = [(k, turn) for k in range(0, 3000, 5) for turn in range(2)] + [(11, None), (10, None)]
    spark.createDataFrame(rows, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(registry.queries()["misaligned_rows"](spark, str(tmp_path)))
    assert got == sorted(((k + 1000, turn) for k, turn in rows if k % 10 == 0), key=str)


def test_patterns_of_many_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(f"thinth{k}" for k in range(300))), (2, "thinth0 x"), (3, None)], "doc_id long, text string")
    one = index.TextIndex.at(spark, str(tmp_path / "i"))
    one.build(docs)
    with pytest.raises(ValueError):
        one.regex("^thinth")
    assert rows_of(search.guarded_regex(one, "^thinth", "a", search.RateLimiter(), 0.0, most=None)) == [(1, 300), (2, 1)]
    assert rows_of(one.regex("^none", None)) == []


def test_signatures_with_a_full_table(spark, monkeypatch):
    import hashlib
    import random

    from textloom.operators import signatures

    monkeypatch.setattr(signatures, "WINDOWS", 64)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", "ab", "x" * 700]
    texts += ["".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]  # more letters than a key has numbers for
    least = lambda x, slot: min(hashlib.sha256(f"{slot}:{x[i : i + 5]}".encode()).digest()[:8] for i in range(max(1, len(x) - 4)))
    table = signatures.Hashes(5, 4, most=200)
    got = table.signatures(texts)
    assert len(table.keys) <= 200
    assert got.tolist() == [[int.from_bytes(least(x, s), "big") for s in range(4)] for x in texts]
    rows = spark.createDataFrame([(1, None), (2, "abcdefg")], "id int, text string")
    assert rows_of(signatures.minhash(rows, "id", "text", 5, 2)) == sorted([(1, 0, None), (1, 1, None), *((2, s, least("abcdefg", s).hex()) for s in (0, 1))], key=str)


def test_near_in_a_long_text(spark, tmp_path):
    """Of a text of 20,000 words whose every place is near, no row carries the words."""
    docs = spark.createDataFrame([(1, "the of " * 10_000), (2, "the of x the of"), (2, "the y"), (None, "the of the")], "doc_id long, text string")
    one = index.TextIndex.at(spark, str(tmp_path / "i"))
    one.build(docs)
    found = one.near(["the", "of", "the"], 2, ordered=False)
    assert found.filter("doc_id = 1").count() == 19_997 and rows_of(found.filter("doc_id = 2")) == [(2, 0)]
    assert "words" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert search.unordered_near(docs.filter("doc_id = 1"), ["the", "of", "the"], 2).count() == 19_997


def test_batches_of_python_are_bounded(spark):
    from textloom import runtime

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        runtime.ship(spark)
        assert spark.conf.get(name) == str(runtime.BATCH_ROWS)
        spark.conf.set(name, "200")  # a smaller bound stays
        runtime.ship(spark)
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
