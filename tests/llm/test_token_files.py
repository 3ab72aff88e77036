import pytest

from gritsieve.llm import token_files as tf
from gritsieve.llm import tokenizers
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


def test_the_query_is_an_exact_round_trip(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op10_token_files"](spark, SF).collect()
    texts, encoder = dict(zip(docs.doc_id, docs.text)), tokenizers.byte_bpe()
    assert len(got) == len(docs)
    for r in got:
        assert encoder.decode(r.token_ids) == texts[r.doc_id] and r.n_tokens == len(r.token_ids) and r.token_ids == encoder.encode_ordinary(texts[r.doc_id])


def test_awkward_documents(spark, tmp_path):
    tf.write_tokens(tf.tokenized(awkward(spark)), str(tmp_path / "t"))
    got = tf.read_tokens(spark, str(tmp_path / "t")).collect()
    encoder = tokenizers.byte_bpe()
    decoded = sorted((repr(r.doc_id), repr(None if r.token_ids is None else encoder.decode(r.token_ids))) for r in got)
    assert decoded == sorted((repr(r[0]), repr(r[1])) for r in awkward_rows())
    assert all((r.n_tokens is None) == (r.token_ids is None) for r in got) and {r.n_tokens for r in got if r.doc_id == 103} == {0}
    tf.write_tokens(tf.tokenized(empty(spark)), str(tmp_path / "e"))
    assert tf.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_stripes_indexes_and_filters(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    rows = spark.range(0, 60_000, 2, 2).select(F.col("id").alias("doc_id"), F.lit(3).alias("n_tokens"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: (F.hash("id", i) % 50_000).cast("int")).alias("token_ids"))
    tf.write_tokens(rows, path, stripe_bytes=1 << 20, row_stride=1000)
    facts = tf.file_facts(spark, path)
    assert len(facts) == 2 and sum(f["rows"] for f in facts) == 30_000 and all(f["stride"] == 1000 and len(f["stripes"]) > 1 for f in facts)
    assert all(f["encodings"] == {"DIRECT_V2"} and {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= f["streams"] for f in facts)
    assert sorted(r.doc_id for r in tf.read_tokens(spark, path, ids=[10, 11, 59_998]).collect()) == [10, 59_998]
    assert tf.read_tokens(spark, path, between=(100, 200)).count() == 51
    plan = tf.read_tokens(spark, path, ids=[10])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,10)]" in plan or "In(doc_id" in plan
    with pytest.raises(Exception):
        tf.read_tokens(spark, str(tmp_path / "missing")).count()


def scanned(df):
    """The rows that the scan of a plan gave on, after its row groups were pruned."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped(spark, tmp_path):
    """Of 40 row groups of 1000 rows only those are read that a range reaches, or whose Bloom filter lets an id pass."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    # ids apart by 7 within files that span the same range, so that ranges alone prune nothing for single ids
    rows = spark.range(40_000).select(((F.col("id") * 7919) % 280_000 * 3).alias("doc_id"), F.lit(1).alias("n_tokens"), F.array(F.lit(1)).alias("token_ids")).repartition(2)
    tf.write_tokens(rows, path, row_stride=1000)
    every = scanned(tf.read_tokens(spark, path))
    assert every == 40_000
    low = tf.read_tokens(spark, path, between=(0, 3000))
    assert 0 < scanned(low) <= 4000
    one = rows.first().doc_id
    found = tf.read_tokens(spark, path, ids=[one])
    assert 1 <= scanned(found) <= 3000 and found.count() == rows.where(F.col("doc_id") == one).count()
    assert scanned(tf.read_tokens(spark, path, ids=[one + 1])) <= 2000


def test_token_counts(spark):
    from pyspark.sql import functions as F

    rows = awkward(spark).select(tf.token_count()("text").alias("n"), F.coalesce(F.size(tf.encoded()("text")), F.lit(0)).alias("m")).collect()
    assert all(r.n == max(r.m, 0) for r in rows) and len(rows) == len(awkward_rows())
