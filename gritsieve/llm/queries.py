"""One query for each operator, over the whole of its table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import classifier, license_scan, media, mixing, near_dedup, packing, quality_rules, token_files, toxicity, warc
from gritsieve.llm.shared import fresh_path, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.fertility_report(_table(spark, sf_dir, "documents"))


def op4_media_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_tracks(media.wrapped_texts(_table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(_table(spark, sf_dir, "documents"))


def mixing_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_mixing, but by words between blanks, which SQL can count as well."""
    return mixing.sampled(_table(spark, sf_dir, "documents"), tokens=word_count())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.quality_scores(docs, classifier.train(docs, _table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_pages(_table(spark, sf_dir, "pages"))
    return warc.response_pages(warc.read_warc(spark, [folder], split_bytes=4 << 20))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(_table(spark, sf_dir, "documents"))


def op9_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic_passages(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(token_files.tokenized(_table(spark, sf_dir, "documents")), path)
    return token_files.read_tokens(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_near_duplicates, op3_quality_rules, op4_media_tracks, op5_mixing, mixing_by_words, op6_quality_classifier, op7_warc, op8_license_scan, op9_toxic_passages, op10_token_files)
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> ''))"

ORACLES: dict[str, str] = {
    "mixing_by_words": f"""
        WITH d AS (
          SELECT doc_id, source, coalesce(source, chr(0) || 'none') AS s, {_WORDS}::BIGINT AS tokens,
                 length(coalesce(text, '')) - length(translate(coalesce(text, ''), '$%&#*!|', '')) AS noise
          FROM documents),
        k AS (
          SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                    / (CASE WHEN tokens > 0 THEN tokens::DOUBLE / (tokens + noise)::DOUBLE ELSE 1.0 END) AS key
          FROM d),
        t AS (SELECT s, sum(tokens)::BIGINT AS total FROM d GROUP BY s HAVING sum(tokens) > 0),
        p AS (SELECT s, total, floor((SELECT sum(total) FROM t)::DOUBLE * 1.0 / (SELECT count(*) FROM t)::DOUBLE)::BIGINT AS target FROM t),
        q AS (SELECT s, target // total AS epochs, target - (target // total) * total AS rest FROM p),
        c AS (SELECT k.*, sum(tokens) OVER (PARTITION BY s ORDER BY key, doc_id) AS upto FROM k)
        SELECT c.doc_id, c.source, c.tokens, (q.epochs + CASE WHEN c.upto <= q.rest THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM c JOIN q USING (s) WHERE q.epochs + CASE WHEN c.upto <= q.rest THEN 1 ELSE 0 END > 0
    """,
    "op7_warc": "SELECT page_id, '<urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' AS record_id, url, strlen(html)::BIGINT AS html_bytes, md5(html) AS html_md5 FROM pages",
}
