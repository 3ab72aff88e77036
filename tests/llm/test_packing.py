import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.llm import packing, tokenizers
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


def lengths_of(rows):
    """(doc_id, tokens) of (doc_id, text)."""
    return [(i, len(tokenizers.byte_bpe().encode_ordinary(t or ""))) for i, t in rows]


def check(rows, lengths, capacity):
    """Every token of every row lies in one piece, and no bin is overfull."""
    pieces, bins, places = defaultdict(list), defaultdict(int), set()
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        bins[r.bin] += r.n_tokens
        assert (r.bin, r.place) not in places
        places.add((r.bin, r.place))
    assert max(bins.values(), default=0) <= capacity
    want = defaultdict(list)
    for i, n in lengths:
        want[i] += [(p, p * capacity, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_awkward_documents(spark):
    lengths = lengths_of((r[0], r[1]) for r in awkward_rows())
    for capacity in (64, 4096):
        got = packing.packed(awkward(spark), capacity=capacity).collect()
        bins = check(got, lengths, capacity)
        assert len(bins) <= 1.1 * sum(n for _, n in lengths) / capacity + 2
    assert packing.packed(empty(spark)).collect() == [] and packing.packed_sequences(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        packing.packed(empty(spark), capacity=4097)


def test_sequences_hold_the_tokens_of_every_document(spark):
    encoder = tokenizers.byte_bpe()
    texts = {i: t for i, t, *_ in awkward_rows() if i is not None and i != 110} | {None: None}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0]), (110, "a b c"), (110, "quite another text")], "doc_id long, text string")
    rows = packing.packed_sequences(docs, capacity=256).collect()
    parts = defaultdict(list)
    for r in rows:
        assert len(r.token_ids) == sum(p.n_tokens for p in r.pieces) <= 256 and r.pieces[0].start == 0
        for p in r.pieces:
            parts[p.doc_id].append((p.piece, r.token_ids[p.start : p.start + p.n_tokens]))
    for i, t in texts.items():
        times = 2 if i == 0 else 1
        want = encoder.encode_ordinary(t or "")
        assert sorted(parts.pop(i, [])) == sorted((k, want[256 * k : 256 * k + 256]) for k in range(-(-len(want) // 256)) for _ in range(times))
    assert sorted(encoder.decode(x) for _, x in parts.pop(110)) == ["a b c", "quite another text"] and not parts


def test_length_classes(spark):
    sizes = [*range(1, 2049)]
    for capacity in (2048, 10 * 2048):
        unit = packing.unit_of(capacity)
        got = [r[0] for r in spark.createDataFrame([(n * unit - (unit - 1) * (n % 2),) for n in sizes], "n int").select(packing.length_class(F.col("n"), capacity)).collect()]
        assert all(n <= c <= max(n, 1.016 * n + 1) and c <= 2048 for n, c in zip(sizes, got)) and got[:128] == sizes[:128] and len(set(got)) < 400 and got == sorted(got)


def test_the_query_against_a_recount(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op1_packing"](spark, SF).collect()
    lengths = lengths_of(zip(docs.doc_id, docs.text))
    bins = check(got, lengths, packing.CAPACITY)
    assert len(bins) <= 1.03 * sum(n for _, n in lengths) / packing.CAPACITY + 2


def test_knapsack_against_all_configurations():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 9, 4))
        prices, cap = rng.random(len(sizes)), 12
        best = max(float((prices * np.array(c)).sum()) for c in itertools.product(*(range(cap // s + 1) for s in sizes)) if (sizes * np.array(c)).sum() <= cap)
        got = packing.best_configuration(prices, sizes, cap)
        assert (got * sizes).sum() <= cap and abs((prices * got).sum() - best) < 1e-9


def fewest_bins(items, capacity):
    """The optimum, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bins_are_near_the_optimum_and_the_bound_is_below_it():
    rng = random.Random(1)
    for _ in range(20):
        items = [rng.randint(1, 10) for _ in range(9)]
        p = packing.plan({s: items.count(s) for s in set(items)}, 10)
        least = fewest_bins(items, 10)
        assert p.bound <= least + 1e-6 and least <= p.bins <= least + 1
    counts = {s: 5000 + 37 * s for s in range(1, 65)}
    p = packing.plan(counts, 64)
    assert p.bins <= 1.02 * p.bound + 1 and p.met


def test_a_gap_that_is_missed_is_reported():
    with pytest.warns(UserWarning, match="within the gap"):
        p = packing.plan({s: 1000 + s for s in range(3, 60, 7)}, 64, rounds=1, gap=0.0)
    assert not p.met and p.bins >= p.bound
