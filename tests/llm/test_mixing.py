import hashlib
import math

import duckdb
from pyspark.sql import functions as F

from gritsieve.llm import mixing, tokenizers
from gritsieve.llm.queries import ORACLES, QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


def brute(rows, shares, budget, seed=17):
    """{(row, source, tokens): copies} by sorting each source as a whole; rows: (doc_id, text, source)."""
    items = {}
    for i, t, s in rows:
        words = len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
        noise = sum((t or "").count(c) for c in "$%&#*!|")
        u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        items.setdefault(s, []).append((-math.log(u) / (words / (words + noise) if words else 1.0), -(2**63) if i is None else i, len(tokenizers.byte_bpe().encode_ordinary(t or ""))))
    totals = {s: sum(x[2] for x in v) for s, v in items.items()}
    parts = {s: shares.get(s, 0.0) if shares is not None else 1.0 for s, n in totals.items() if n > 0}
    parts = {s: w for s, w in parts.items() if shares is None or s in shares}
    limit = sum(totals[s] for s in parts) if budget is None else budget
    out = {}
    for s, w in parts.items():
        if w <= 0:
            continue
        target = math.floor(limit * w / sum(parts.values()))
        epochs, rest = divmod(target, totals[s])
        order, upto, cut = sorted(items[s]), 0, None
        for key, i, words in order:
            upto += words
            if upto <= rest:
                cut = key, i
        for key, i, words in order:
            n = epochs + (cut is not None and (key, i) <= cut)
            if n:
                out[None if i == -(2**63) else i, s, words] = out.get((None if i == -(2**63) else i, s, words), 0) + n
    return out


def got_of(df):
    out = {}
    for r in df.collect():
        out[r.doc_id, r.source, r.tokens] = out.get((r.doc_id, r.source, r.tokens), 0) + r.copies
    return out


def test_the_query_against_sql(spark):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = sorted(con.sql(f"SELECT doc_id, source, tokens, copies FROM ({ORACLES['mixing_by_words']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["mixing_by_words"](spark, SF).collect()) == want


def test_the_query_against_sorting_each_source(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert got_of(QUERIES["op5_mixing"](spark, SF)) == brute([*zip(docs.doc_id.tolist(), docs.text, docs.source)], None, None)


def test_buckets_do_not_depend_on_the_scale_of_the_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    most = []
    for scale in (1e-300, 0.001, 1.0, 1e6):
        rows = mixing.keyed(docs, F.lit(1), mixing.sampling_key(F.col("doc_id"), F.lit(scale), 17, 0.01))
        most.append(rows.groupBy("bucket").count().agg(F.max("count")).first()[0])
    assert max(most) < 0.003 * 20_000


def test_awkward_documents(spark):
    rows = [(r[0], r[1], r[3]) for r in awkward_rows()]
    docs = awkward(spark)
    for buckets in (1, 7, 4096):
        assert got_of(mixing.sampled(docs, buckets=buckets)) == brute(rows, None, None)
    assert mixing.sampled(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_targets_budgets_and_epochs(spark):
    rows = [(r[0], r[1], r[3]) for r in awkward_rows()]
    docs = awkward(spark)
    shares = {"s0": 1.0, "s1": 5.0, "s2": 0.0, None: 2.0}
    targets = spark.createDataFrame([*shares.items(), ("gone", 3.0)], "source string, weight double")
    for budget in (None, 0, 100, 50_000, 400_000):
        want = brute(rows, shares, budget)
        assert got_of(mixing.sampled(docs, targets=targets, budget=budget)) == want
        mixed = mixing.mixed(docs, targets=targets, budget=budget)
        assert mixed.columns == docs.columns and mixed.count() == sum(want.values())


def test_heavier_documents_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2 * 3 + 1).cast("double").alias("w"))
    ids = [r.doc_id for r in mixing.sampled(docs, budget=3000, tokens=F.lit(3), weight=F.col("w")).collect()]
    assert 900 < len(ids) <= 1000 and sum(i % 2 for i in ids) > 0.7 * len(ids)
    assert mixing.sampled(docs, budget=3000, tokens=F.lit(3), weight=F.lit(None).cast("double")).count() == 1000
    assert mixing.sampled(docs, budget=3000, tokens=F.lit(3), weight=F.lit(float("nan"))).count() == 1000
