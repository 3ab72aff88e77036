import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from gritsieve.llm import near_dedup as nd
from gritsieve.llm.blocks import blocks
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty, prose, rows_of

SF = "/root/testdata/sf0.001"


def brute(rows, t=None):
    """({doc_id: lowest id of its class}, {doc_id: links}) over all pairs of signatures, of documents with a partner."""
    k = nd.COORDINATES
    t = t or nd.needed(nd.THRESHOLD, k)
    of = {}
    for i, text in rows:
        if i is None:
            continue
        for _, _, data, at in blocks(pa.array([text], pa.string())):
            has, sig = nd.signatures_of(data, at, k, nd.SHINGLE)
            if len(has):
                of.setdefault(sig[0].tobytes(), set()).add(i)
    group = {i: i for ids in of.values() for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    def tie(ids):
        for i in ids:
            x, y = sorted((top(i), top(min(ids))))
            group[y] = x

    links = dict.fromkeys(group, 0)
    for ids in of.values():
        tie(ids)
        for i in ids:
            links[i] += len(ids) - 1
    sigs = [(np.frombuffer(sig, np.uint32), ids) for sig, ids in of.items()]
    for (a, x), (b, y) in combinations(sigs, 2):
        if (a == b).sum() >= t:
            tie(x | y)
            for i in x:
                links[i] += len(y)
            for i in y:
                links[i] += len(x)
    return {i: top(i) for i in group if top(i) != i or list(map(top, group)).count(i) > 1}, {i: n for i, n in links.items() if n}


def classes(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.class_id for r in rows}, {r.doc_id: r.links for r in rows}


def test_the_query_has_the_classes_and_links_of_all_pairs(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want, links = brute(zip(docs.doc_id.tolist(), docs.text))
    got = QUERIES["op2_near_duplicates"](spark, SF)
    assert got.columns == ["doc_id", "class_id", "links"] and classes(got) == (want, links) and len(want) > 10


def test_awkward_documents(spark):
    docs = awkward(spark)
    want, links = brute((r[0], r[1]) for r in awkward_rows())
    got = classes(nd.near_classes(docs))
    assert got[1] == links and {100, 101, 106} <= set(links) and got[0] == {i: want[i] for i in links}
    left = nd.near_dedup(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    gone = {i for i, g in want.items() if i != g}
    assert not gone & set(ids) and ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {r[0] for r in awkward_rows()} - gone == set(ids)
    assert nd.near_dedup(empty(spark)).count() == 0 and nd.near_classes(empty(spark)).count() == 0


def test_one_row_of_a_doc_id_stays_whatever_its_columns_are(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 1), (2, None, 3), (2, None, 3)], "doc_id long, text string, _place long")
    docs = docs.withColumns({"m": F.struct(F.create_map(F.lit("k"), "_place").alias("inner")), "_gone": F.lit(1), "_TWICE": F.lit(2)})
    for _ in range(2):
        got = nd.near_dedup(docs.repartition(3)).collect()
        assert sorted((r.doc_id, r.text, r._place, r.m.inner) for r in got if r.doc_id == 1) == [(1, "a", 1, {"k": 1})] and len(got) == 2


def test_large_classes_and_shared_passages(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [(i, base.replace(" ", f" w{i} ", 1)) for i in range(150)] + [(1000 + i, prose(rng, 300) + " " + passage) for i in range(60)] + [(2000 + i, base) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert classes(nd.near_classes(docs)) == want and max(want[1].values()) == 169
    # parts of 10 nodes: every list of more is cut, and every two parts meet
    for block in (10, 40):
        assert classes(nd.near_classes(docs.repartition(7), block=block)) == want
        assert {r.doc_id: r.class_id for r in nd.near_groups(docs, block=block).collect()} == {i: c for i, c in want[0].items() if i != c}


def test_blocks_against_all_pairs():
    """Chance signatures of few values: pairs above and below the threshold in the same list, by all three ways of comparing."""
    rng = np.random.default_rng(3)
    for n, k, t in ((60, 8, 4), (130, 8, 5), (20, 8, 1)):
        sig = rng.integers(0, 3, (n, k)).astype(np.uint32)
        mask = rng.integers(0, 1 << k, n).astype(np.uint64)
        c = int(rng.integers(0, k))
        low = lambda i, j: any(sig[i, x] == sig[j, x] and (int(mask[i]) >> x) & (int(mask[j]) >> x) & 1 for x in range(c))  # noqa: B023, E731
        every = {(i, j) for i, j in combinations(range(n), 2) if (sig[i] == sig[j]).sum() >= t}
        first = {p for p in every if not low(*p)}
        i, j = nd._small_matches(sig, mask, np.full(n, c), np.array([0, n]), t, True)
        assert set(zip(i.tolist(), j.tolist())) == first
        whole = np.arange(n)
        assert {p for a, b in nd._block_matches(sig, mask, c, whole, whole, t) for p in zip(a.tolist(), b.tolist())} == first
        left, right = whole[: n // 3], whole[n // 3 :]
        assert {p for a, b in nd._block_matches(sig, mask, c, left, right, t) for p in zip(a.tolist(), b.tolist())} == {p for p in first if p[0] < n // 3 <= p[1]}
        for x, y, pairs in ((whole, whole, every), (left, right, {p for p in every if p[0] < n // 3 <= p[1]})):
            part = nd._block_parts(sig, x, y, t)
            label = nd._labels(n, *(np.array(z, np.int64) for z in (zip(*pairs) if pairs else ((), ()))))
            assert len({*zip(part.tolist(), label.tolist())}) == len(set(part.tolist())) == len(set(label.tolist()))


def test_recall_of_similar_texts(spark):
    """Texts of a true similarity well above the threshold are found: at least nine in ten."""
    rng = random.Random(6)
    rows, true = [], []
    for i in range(120):
        words = prose(rng, 150).split()
        other = [w if rng.random() > 0.06 else "zz" + w for w in words]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (words, other))
        if len(a & b) / len(a | b) >= 0.6:
            true.append((2 * i, 2 * i + 1))
    got = {(c, i) for i, c in classes(nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")))[0].items() if i != c}
    assert len(true) > 60 and len(got & set(true)) >= 0.9 * len(true) and all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(300)
    edges = spark.createDataFrame([(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[:200], ids[1:200])] + [(1000, 1001)], "doc_a long, doc_b long")
    got = {r.doc_id: r.group_id for r in nd.components(edges).collect()}
    assert {got[int(i)] for i in ids[:200]} == {int(ids[:200].min())} and got[1001] == 1000
