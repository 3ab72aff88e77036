import random

import numpy as np
import pyarrow as pa

from gritsieve.llm import toxicity as tx
from gritsieve.llm.blocks import Words, blocks
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, empty, prose, rows_of


def maximal(scores):
    """All maximal scoring segments by their definition: greatest segment first, then within what is left on each side."""
    if not len(scores):
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, i, j = best
    return maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in maximal(scores[j:])]


def test_segments_against_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.normal(-0.3, 1, rng.integers(0, 25))
        assert [(a, b) for a, b, _ in tx.segments(scores)] == maximal(scores)
        assert all(abs(s - scores[a:b].sum()) < 1e-9 for a, b, s in tx.segments(scores))


def test_lambda_and_chance_maxima():
    scores, weights = np.array([-0.5, 1.0, 2.0]), np.array([0.9, 0.07, 0.03])
    lam, k = tx.calibrate(scores, weights)
    assert abs((weights * np.exp(lam * scores)).sum() - 1) < 1e-9
    model = tx.ToxicModel((np.zeros(0, np.uint64),) * 4, (np.zeros(0),) * 4, 0.1, lam, k)
    rng, hits = np.random.default_rng(5), 0
    for _ in range(2000):
        x = rng.choice(scores, 300, p=weights)
        hits += any(model.expected(s, 300) <= 0.05 for _, _, s in tx.segments(x))
    assert hits <= 0.06 * 2000  # as many as the threshold promises, or fewer


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    vocabulary = [prose(rng, 1) for _ in range(400)]
    rude = [f"zog{prose(rng, 1, 'xyz')}" for _ in range(12)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        if i % 5 == 0:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels, rude


def test_planted_passages(spark):
    docs, labels, rude = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = tx.train(table, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    got = tx.toxic_passages(table, model).collect()
    found = {r.doc_id for r in got}
    held = [i for i in range(400, 600)]
    assert all(i in found for i in held if i % 5 == 0) and not any(i in found for i in held if i % 5)
    texts = dict(docs)
    for r in got:
        words = texts[r.doc_id].split()
        assert r.passage == " ".join(words[r.first_word : r.end_word]) and r.n_words == len(words) and any(w in r.passage.split() for w in rude) and r.e_value <= 0.005
    for r in got[:20]:
        (_, _, data, at), = blocks(pa.array([texts[r.doc_id]]))
        assert (r.first_word, r.end_word) in maximal(model.token_scores(Words(data, at)))
    repeated = spark.createDataFrame([(9000, " ".join([docs[1][1].split()[0]] * 5000))], "doc_id long, text string")
    assert tx.toxic_passages(repeated, model).count() == 0


def test_a_passage_counts_as_much_again_later_in_a_text(spark):
    passage = [f"zog{c}" for c in "abcdef"]
    (_, _, data, at), = blocks(pa.array([" ".join(passage)]))
    none = (np.zeros(0, np.uint64), np.zeros(0))
    units = [(np.sort(Words(data, at).hashes()), np.ones(6)), none, none, none]
    model = tx.ToxicModel(tuple(k for k, _ in units), tuple(s for _, s in units), 0.1, 2.5, 0.1)
    clean = prose(random.Random(3), 2400).split()
    lone = [w for k in range(6) for w in (*clean[100 * k : 100 * k + 100], passage[k])]
    texts = [(1, clean[:700] + passage + clean[700:2000] + passage + clean[2000:]), (2, lone + clean[600:900] + passage + clean[900:])]
    got = tx.toxic_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.first_word, r.end_word) for r in got) == [(1, 700, 706), (1, 2006, 2012), (2, 906, 912)]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.train(docs, labels.where("doc_id % 2 = 0"))
    found = {r.doc_id for r in tx.toxic_passages(docs, model).select("doc_id").distinct().collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    bad, good = ([r.doc_id in found for r in held if r.toxic == t] for t in (1, 0))
    assert np.mean(bad) > 0.8 and np.mean(good) < 0.01


def test_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (1, None), (2, 1), (999, 1)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    once = rows_of(tx.toxic_passages(docs, model))
    assert once == rows_of(tx.toxic_passages(docs.repartition(5), tx.train(docs.repartition(3), labels)))
    left = tx.reject_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() <= docs.count()
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        none = tx.train(docs, few)
        assert tx.toxic_passages(docs, none).count() == 0 and tx.reject_toxic(docs, few).count() == docs.count()
    assert tx.toxic_passages(empty(spark), model).count() == 0 and tx.reject_toxic(empty(spark), labels).count() == 0


def greatest_first(scores):
    """As `maximal`, with running minima in place of all pairs, for long texts."""
    found, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        sums = np.concatenate([[0], np.cumsum(scores[a:b])])
        low = np.minimum.accumulate(sums)
        gain = sums - low
        j = int(gain.argmax())
        if gain[j] <= 0:
            continue
        i = int(np.flatnonzero(sums[: j + 1] == low[j])[-1])
        found.append((a + i, a + j))
        todo += [(a, a + i), (a + j, b)]
    return sorted(found)


def test_the_query_finds_every_significant_segment_and_no_other(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.train(docs, labels)
    assert model.known
    want = set()
    for r in docs.collect():
        for _, _, data, at in blocks(pa.array([r.text], pa.string())):
            scores = model.token_scores(Words(data, at))
            for i, j in greatest_first(scores):
                score = float(scores[i:j].sum())
                if model.expected(score, len(scores)) <= 0.005:
                    want.add((r.doc_id, i, j, round(score, 6)))
    got = QUERIES["op9_toxic_passages"](spark, sf)
    assert got.columns == ["doc_id", "first_word", "end_word", "n_words", "score", "e_value", "passage"]
    assert {(r.doc_id, r.first_word, r.end_word, round(r.score, 6)) for r in got.collect()} == want and len(want) > 20


def test_greatest_first_is_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(100):
        scores = rng.normal(-0.3, 1, rng.integers(0, 30))
        assert greatest_first(scores) == maximal(scores)
