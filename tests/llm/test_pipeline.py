import corpus_pipeline
from gritsieve.llm import mixing, near_dedup, packing, quality_rules, toxicity
from tests.llm.cases import CLASHING, awkward, empty, rows_of
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check, lengths_of
from tests.llm.test_quality_rules import judged

SF = "/root/testdata/sf0.001"
NAMES = ["quality rules", "toxicity", "near-duplicates", "mixing", "packing"]


def test_each_stage_on_all_that_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    start, ruled, mild, lone, mixed, packs = seen
    report = quality_rules.fertility_report(start).collect()
    assert sorted(r.doc_id for r, why in zip(report, judged(report, quality_rules.LEAST)) if not why) == sorted(r.doc_id for r in ruled.select("doc_id").collect())
    model = toxicity.train(ruled, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.toxic_passages(ruled, model).collect()}
    assert rows_of(mild) == rows_of(ruled.where(~ruled.doc_id.isin(*bad)) if bad else ruled)
    groups, _ = brute((r.doc_id, r.text) for r in mild.select("doc_id", "text").collect())
    gone = {i for i, g in groups.items() if i != g}
    assert {r.doc_id for r in lone.collect()} == {r.doc_id for r in mild.collect()} - gone and gone
    times = {r.doc_id: r.copies for r in mixing.sampled(lone).collect()}
    ids = [r.doc_id for r in mixed.select("doc_id").collect()]
    assert {i: ids.count(i) for i in set(ids)} == times
    pieces, lengths = packs.collect(), lengths_of((r.doc_id, r.text) for r in mixed.collect())
    check(pieces, lengths, packing.CAPACITY)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(pieces)
    assert near_dedup.needed(near_dedup.THRESHOLD, near_dedup.COORDINATES) == 29


def test_awkward_and_empty_tables(spark, tmp_path):
    for k, docs in enumerate((awkward(spark), empty(spark))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns and (k or set(CLASHING) <= set(out.columns))
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert (docs.count() == 0) == bool(k)
