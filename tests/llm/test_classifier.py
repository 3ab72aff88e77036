import re

import numpy as np
import pyarrow as pa

from gritsieve.llm import classifier as c
from gritsieve.llm.blocks import blocks
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trees = c.train(docs, labels.where("doc_id % 2 = 0"))
    rows = {r.doc_id: r for r in c.quality_scores(docs, trees).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    right = [rows[r.doc_id].keep == bool(r.quality) for r in held]
    assert len(held) > 150 and np.mean(right) > 0.95
    assert len(QUERIES["op6_quality_classifier"](spark, SF).collect()) == docs.count()


def walk(t, x):
    out = t.base
    for root in t.roots:
        i = root
        while t.left[i] != i:
            i = t.left[i] if x[t.feature[i]] <= t.threshold[i] else t.right[i]
        out += t.value[i]
    return 1 / (1 + np.exp(-out))


def test_traversal_against_walking_each_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = c.fit(x, y, trees=30, depth=3)
    assert np.allclose(t.scores(x), [walk(t, r) for r in x]) and ((t.scores(x) > 0.5) == y).mean() > 0.97
    assert (np.abs(c.fit(x, np.ones(500)).scores(x) - 1) < 1e-3).all() and (c.fit(x[:0], y[:0]).scores(x) == 0.5).all()


def test_first_split_against_all_splits():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200).astype(float)
    t = c.fit(x, y, trees=1, depth=1, bins=1000, least=1.0)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = max((score(x[:, f] <= v) + score(x[:, f] > v), f, v) for f in range(3) for v in x[:, f] if h[x[:, f] <= v].sum() >= 1 and h[x[:, f] > v].sum() >= 1)
    assert t.feature[0] == best[1] and np.isclose(score(x[:, best[1]] <= t.threshold[0]) + score(x[:, best[1]] > t.threshold[0]), best[0])


def test_statistics_against_counting():
    texts = ["The cat. The CAT!\nthe é 12", "", None, "a" * 3000 + " b", "x x x y"]
    for first, last, data, at in blocks(pa.array(texts)):
        got = c.statistics_of(data, at)
        for t, row in zip(texts[first:last], got):
            words = (t or "").replace(".", " ").replace("!", " ").split()
            assert np.isclose(row[0], np.log1p(len((t or "").encode()))) and np.isclose(row[1], np.log1p(len(words)))
            if words:
                low = [w.lower() for w in words]
                assert np.isclose(row[13], len(set(low)) / len(low)) and np.isclose(row[14], max(map(low.count, low)) / len(low)) and np.isclose(row[2], np.mean([len(w.encode()) for w in words]))


def test_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None), (2, 1), (999, 0)], "doc_id long, quality int")
    rows = c.quality_scores(docs, c.train(docs, labels)).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.quality_score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.quality_score)
    assert by[0] == by[100] and by[102] == by[103] and len(by[110]) == 3
    assert {r.quality_score for r in c.quality_scores(docs, c.train(docs, labels.limit(0))).collect()} == {0.5}
    assert c.quality_scores(empty(spark), c.train(empty(spark), labels)).count() == 0


def statistics_by_hand(text):
    """The statistics of a text by counting in plain Python."""
    raw = (text or "").encode()
    low = bytearray(raw.lower())
    for i in range(1, len(low)):
        if low[i - 1] == 0xC3 and 0x80 <= low[i] <= 0x9E and low[i] != 0x97:
            low[i] += 0x20
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+", raw)]
    words = [bytes(low[a:b]) for a, b in spans]
    n, size = max(len(words), 1), max(len(raw), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = lambda chars: sum(c in chars for c in raw) / size
    return [
        np.log1p(len(raw)), np.log1p(len(words)), mean, max(sum(x * x for x in lengths) / n - mean**2, 0) ** 0.5,
        share(range(65, 91)), share(range(97, 123)), share(range(48, 58)), share(b"\t\v\f\r "), share(b"\n"), share(range(128, 192)), share(b".,;:?'\"()-"), share(b"!#$%&*+/<=>@[\\]^_`{}~"), share(b"|"),
        len(set(words)) / n, max(map(words.count, set(words)), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(words) / (raw.count(b"\n") + 1),
        sum(x <= 2 for x in lengths) / n, sum(x >= 14 for x in lengths) / n, sum(65 <= raw[a] <= 90 for a, _ in spans) / n,
    ]


def test_the_query_against_counting_and_walking(spark):
    """Every score of the query, from statistics counted in plain Python and trees walked node by node."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = c.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and len(trees.roots) > 10
    for i, t in texts.items():
        score = walk(trees, statistics_by_hand(t))
        assert abs(score - got[i].quality_score) < 1e-6 and (abs(score - 0.5) < 1e-6 or got[i].keep == (score >= 0.5))
    assert len({round(r.quality_score, 6) for r in got.values()}) > 50
