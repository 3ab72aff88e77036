import itertools
import random

from pyspark.sql import functions as F

from gritsieve.operators import cache, comments, copyrights, detectors, enrich, licenses, summary
from gritsieve.sources.reference import alias_ref, license_ref


def test_similarity_is_the_same_as_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(120)] + [(200, ""), (201, None), (202, "w1 w1 w1"), (203, "w1")]
    docs = spark.createDataFrame(texts, "id long, text string")
    found = [{r.id: (r.license, round(r.score, 9)) for r in licenses.similar_matches(docs, license_ref(docs, "id"), key="id", threshold=0.6, skip_self=True, most=most).collect()} for most in (10**6, 0)]
    got = found[0]
    assert found[1] == got
    assert licenses.similar_matches(docs, license_ref(docs.limit(0), "id"), key="id").count() == licenses.similar_matches(docs.limit(0), license_ref(docs, "id"), key="id").count() == 0
    sets = {i: set((t or "").split()) for i, t in texts}
    want = {}
    for i, j in itertools.permutations(sets, 2):
        if sets[i] and sets[j]:
            s = 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j]))
            if s >= 0.6 and (s, -j) > want.get(i, (0, 0)):
                want[i] = (s, -j)
    assert got == {i: (str(-j), round(s, 9)) for i, (s, j) in want.items()}


def test_texts_among_themselves_are_the_same_as_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (1, 3, 40, 300, 700):  # families of near copies, whose members have up to 1.5 times as many words
        for _ in range(4):
            base = rng.sample(words, size)
            texts += [" ".join(rng.sample(base, max(1, size - rng.randint(0, size // 4))) + rng.sample(words, rng.randint(0, 1 + size // 5))) for _ in range(8)]
    texts += [texts[7], texts[7], texts[20], "", None, " ".join(words[:700]), "w1 w1", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: set((t or "").split()) for i, t in enumerate(texts)}
    for threshold in (0.8, 0.5):
        want = {}
        for i, j in itertools.permutations(sets, 2):
            if sets[i] and sets[j]:
                s = 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j]))
                if s >= threshold and (s, -j) > want.get(i, (0, 0)):
                    want[i] = (s, -j)
        got = licenses.similar_others(docs, "id", threshold=threshold)
        assert "SortMergeJoin [word" not in got._jdf.queryExecution().toString()  # words aren't joined, one row each
        assert {r.id: (r.license, r.score) for r in got.collect()} == {i: (str(-j), s) for i, (s, j) in want.items()}
        assert {"w1 w1": 1.0}.items() <= {texts[r.id]: r.score for r in got.collect()}.items()


def test_a_text_is_not_its_own_match_even_if_its_reference_differs(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (None, "a b c d e")], "id long, text string")
    ref = license_ref(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d g h"), (3, "a b c d")], "id long, text string"), "id")
    for most in (10**6, 0):
        got = licenses.similar_matches(docs.where("id is not null"), ref, key="id", skip_self=True, most=most).collect()
        assert {r.id: r.license for r in got} == {1: "3", 2: "1"}


def test_aliases_look_at_the_first_occurrence_only(spark):
    ref = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", []), ("X", 2, "The X", ["the ex", "!bang"])], "key string, ord long, name string, aliases array<string>"))
    assert {tuple(r) for r in ref.select("key", "alias").collect()} == {("MIT", "MIT License"), ("X", "the ex"), ("X", "!bang"), ("X", "X"), ("X", "The X")}
    texts = {1: "xMIT License, MIT License", 2: "(MIT License)", 3: "MIT License", 4: "the ex and The X", 5: None, 6: "", 7: "a !bang", 8: "éMIT License"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = sorted((r.id, r.alias) for r in licenses.alias_matches(docs, ref, key="id").collect())
    assert got == [(2, "MIT License"), (3, "MIT License"), (4, "The X"), (4, "X"), (4, "the ex"), (7, "!bang")]


def test_texts_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "a, b"), (2, "--"), (3, None), (4, "uses AES, sha1")], "id long, text string")
    ref = spark.createDataFrame([("A", 1, "d79bd9c5e5cd0ca4c8ebb4b5b2c58a2f")], "key string, ord long, tok_md5 string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(licenses.exact_matches(docs, ref, key="id")).count("regexp_replace(") == 1
    assert plan(detectors.crypto_found(docs, key="id")).count("rijndael") == 2  # one pattern of all, and its own
    assert {(r.id, r.algorithm) for r in detectors.crypto_found(docs, key="id").collect()} == {(4, "AES"), (4, "SHA-1")}


def test_few_aliases_are_found_as_many_are(spark, monkeypatch):
    ref = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", []), ("X", 2, "The X", ["the ex", "!bang"]), ("Y", 3, "The X", [])], "key string, ord long, name string, aliases array<string>"))
    docs = spark.createDataFrame(list(enumerate(["xMIT License, MIT License", "(MIT License)", "the ex and The X", None, "", "a !bang", "éMIT License", "X"])), "id long, text string")
    found = []
    for most in (64, 0):
        monkeypatch.setattr(licenses, "ALIASES", most)
        found.append(sorted(tuple(r) for r in licenses.alias_matches(docs, ref, key="id").collect()))
    assert found[0] == found[1] and (2, "Y", "The X", 3) in found[0]


def test_a_spoiled_tag_still_hides_aliases(spark):
    ref = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", [])], "key string, ord long, name string, aliases array<string>"))
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: A B\nMIT License"), (2, "MIT License"), (3, "none"), (4, "SPDX-License-Identifier:\nMIT License")], "id long, text string")
    got = {r.id: (r.spdx, r.licenses) for r in licenses.analysed(docs, ref, key="id").collect()}
    assert got == {1: (" A B", []), 2: (None, ["MIT"]), 4: (None, ["MIT"])}
    found = spark.createDataFrame([(1, "MIT AND ISC", [], []), (2, "", ["raw"], ["clue"])], "id long, expression string, raw array<string>, clues array<string>")
    got = {r.id: (r.licenses, r.clues) for r in licenses.analysed(docs, ref, found, key="id").collect()}
    assert got[1] == (["MIT", "ISC"], None) and got[2] == (["raw"], ["clue"])


def test_runs(spark):
    rows = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 2, "b"), ("f", 4, 4, "c"), ("g", 3, 3, "a"), ("g", 3, 3, "b")], "relpath string, start_line int, end_line int, text string")
    got = sorted(tuple(r) for r in comments.merge_runs(rows).collect())
    assert got == [("f", 1, 2, "a\nb", 1), ("f", 4, 4, "c", 2), ("g", 3, 3, "a", 1), ("g", 3, 3, "b", 2)]


def test_copyright_modes(spark):
    text = "SPDX-FileCopyrightText: 2020 Ann\nCopyright (c) 2019-2021 Bob Ltd. All rights reserved.\n(c) Cy\nwritten by Dee\n"
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    for mode, last in (("reference", [[], ["Bob Ltd", "Cy"]]), ("nearest", [["Bob Ltd"], ["Cy"]])):
        got = row.select(copyrights.statements(F.col("t"), mode).alias("x"), copyrights.authors(F.col("t")).alias("a")).collect()
        assert [c.holders for c in got[0].x] == [["Ann"], *last] and got[0].a == ["Dee"]
        assert got[1].x == [] and got[2].x is None


def test_fingerprints_are_the_rightmost_minima(spark):
    import hashlib

    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("abc") for _ in range(n)) for i, n in enumerate((0, 2, 3, 5, 40))}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = sorted(tuple(r) for r in detectors.fingerprints(docs, key="id", k=3, window=4).collect())
    want = set()
    for i, t in texts.items():
        w = t.split()
        h = [hashlib.md5(" ".join(w[j : j + 3]).encode()).hexdigest()[:8] for j in range(len(w) - 2)]
        for j in range(max(1, len(h) - 3)) if h else ():
            part = h[j : j + 4]
            at = max(x for x in range(len(part)) if part[x] == min(part))
            want.add((i, j + at, part[at]))
    assert got == sorted(want)


def test_batches_of_requests(spark):
    rows = spark.range(2500).select(F.md5(F.col("id").cast("string")).alias("file_hash"))
    got = sorted(enrich.request_batches(rows, size=99).collect())
    assert [len(r.hashes) for r in got] == [99] * 25 + [25] and [r.batch for r in got] == list(range(26))
    assert [h for r in got for h in r.hashes] == sorted(h for r in got for h in r.hashes)
    assert enrich.request_batches(rows.limit(900)).count() == 1 and enrich.request_batches(rows.limit(0)).count() == 0


def test_incompatible_pairs_and_their_direction(spark):
    named = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "license string, ord int")
    matrix = spark.createDataFrame([("B", "A", "Yes"), ("A", "B", "No"), ("C", "A", "No"), ("A", "C", "No"), ("C", "B", "Yes")], "left string, right string, verdict string")
    assert sorted(tuple(r) for r in enrich.incompatible_pairs(named, matrix).collect()) == [("A", "B"), ("C", "A")]


def test_cache_round_trip(spark, tmp_path):
    store = cache.ResultsCache(spark, str(tmp_path))
    files = spark.createDataFrame([("a", "/a", 1, b"x"), ("b", "/b", 1, b"y")], "relpath string, path string, size long, content binary").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    calls = []

    def analyse(rows):
        calls.append(sorted(r.relpath for r in rows.collect()))
        return rows.where("relpath = 'a'").select("relpath", F.lit("found").alias("data"))

    for want in (["a", "b"], ["b"]):  # nothing was found in b, so b is analysed again
        rows, fresh = cache.with_cache(analyse, files, store, "t")
        assert [(r.relpath, r.data) for r in rows.collect()] == [("a", "found")] and calls[-1] == want
        store.set_with_fastpath(fresh)
    moved = files.withColumn("path", F.lit("/elsewhere"))
    hits = {r.relpath: r.hit for r in store.get_with_fastpath(cache.keyed_files(moved, "t")).collect()}
    assert hits == {"a": "primary", "b": None}
    assert {r.relpath: r.hit for r in store.get_with_fastpath(cache.keyed_files(files, "t")).collect()}["a"] == "fast"
    store.evict(1)
    assert store.cache.count() == 0
    store.clear()
    assert store.cache.count() == 0


def test_eviction_keeps_the_latest(spark):
    rows = spark.createDataFrame([(f"k{i}", "x" * 10, i) for i in range(50)], "cache_key string, data string, s long").select("cache_key", "data", F.timestamp_seconds("s").alias("stored_at"))
    kept = sorted(int(r.cache_key[1:]) for r in cache.evicted(rows, 105, buckets=7).collect())
    assert kept == list(range(40, 50))


def _naive(own):
    """The fold by recursion: {directory: components} -> the directory that each ends up in."""
    nodes = {(): set()}
    for d in own:
        parts = tuple(d.split("/")) if d else ("",)
        for i in range(1, len(parts) + 1):
            nodes.setdefault(parts[:i], set())
        nodes[parts] |= own[d]

    def below(n):
        return [m for m in nodes if len(m) > len(n) and m[: len(n)] == n]

    out = {}
    for d in own:
        parts = tuple(d.split("/")) if d else ("",)
        rep = parts
        for i in range(len(parts) + 1):
            a = parts[:i]
            if below(a) and all(nodes[m] <= nodes[a] for m in below(a)):
                rep = a
                break
        out[d] = "/".join(rep)
    return out


def test_the_fold_is_the_same_as_by_recursion(spark):
    rng = random.Random(3)
    for _ in range(12):
        own = {}
        for _ in range(rng.randint(1, 9)):
            d = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
            own.setdefault(d, set()).update(rng.sample("pq", rng.choice((0, 0, 1, 1, 2))))
        facts = spark.createDataFrame([(d, "component", c, None) for d, cs in own.items() for c in cs], summary.FACTS)
        dirs = spark.createDataFrame([(d,) for d in own], "dir string")
        assert {r.dir: r.rep for r in summary.fold(facts, dirs).collect()} == _naive(own), own


def test_partial_summaries_unite_in_any_order(spark):
    a = spark.createDataFrame([("d", "license", "MIT", None), ("d", "crypto", "AES", "x")], summary.FACTS)
    b = spark.createDataFrame([("d", "crypto", "AES", "y"), ("d", "crypto", "AES", None), ("d", "copyright", "Ann", None)], summary.FACTS)
    one, two = (summary.summary(x).collect() for x in (a.union(b).union(a), b.union(a)))
    assert one == two
    row = one[0]
    assert row.licenses == ["MIT"] and row.crypto_algorithms == {"AES": ["x", "y"]} and row.copyrights["Ann"].clauses == [] and row.components == {}


def test_rules_few_and_many(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "xay"), ("b", "b1"), ("c", None), ("d", "")], "relpath string, text string")
    rules = spark.createDataFrame([("r1", "a", {"k": "v"}), ("r2", "[ab]", None), ("r3", "[ab]", {}), ("r4", None, {})], "rule string, pattern string, meta map<string,string>")
    got = sorted((r.relpath, r.rule) for r in detectors.rule_matches(docs, rules).collect())
    monkeypatch.setattr(detectors, "RULES", 1)
    assert got == sorted((r.relpath, r.rule) for r in detectors.rule_matches(docs, rules).collect()) == [("a", "r1"), ("a", "r2"), ("a", "r3"), ("b", "r2"), ("b", "r3")]
    monkeypatch.undo()
    assert detectors.rule_matches(docs, rules.limit(0)).count() == 0


def test_the_gate_reads_a_first_chunk(spark):
    import io

    from gritsieve.operators import gates

    def accepted(raw):
        try:
            io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8", errors="strict").read(1024)
            return True
        except UnicodeDecodeError:
            return False

    e = "é".encode()
    cases = [b"", b"x", e[:1], b"x" * 1023 + e[:1], b"x" * 1024 + e[:1], b"x" * 5000 + b"\xff", b"x" * 9000 + b"\xff", b"x" * 8191 + e + b"y" * 5000, b"x" * 8191 + b"\xff" + b"y" * 5000, e * 600 + e[:1], "漢".encode() * 500 + "漢".encode()[:2], b"x" * 1022 + b"\xff"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary").select("i", gates.valid_start(F.col("content")).alias("ok"))
    assert [r.ok for r in sorted(rows.collect())] == [accepted(c) for c in cases]


def test_words_hash_alike_as_a_list_and_as_a_text(spark):
    from gritsieve.functions.text import text_token_hash, token_hash, tokens

    docs = spark.createDataFrame([("a b",), (" a, b!\n",), ("",), ("!?",), (None,), ("é_1 漢",), ("a",)], "t string")
    rows = docs.select(text_token_hash(F.col("t")).alias("x"), F.when(F.size(tokens(F.col("t"))) > 0, token_hash(tokens(F.col("t")))).alias("y")).collect()
    assert all(r.x == r.y for r in rows) and rows[0].x == rows[1].x and [r.x is None for r in rows] == [False, False, True, True, True, False, False]
