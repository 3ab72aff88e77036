"""Documents with every awkward case, for all operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "tokens", "group_id", "copies", "bin", "count", "score", "row", "keep", "word", "weight", "n", "x", "doc_a", "sig", "rank", "_m", "bucket",
            "_why", "_lang", "_size", "_own", "_rest", "_fertility", "_reasons", "_bands", "_class_lang", "_class_size", "_mix_key", "_mix_id", "_mix_epochs", "_mix_time", "_mix_source", "_mix_copies", "_mix_cut_key",
            "_cut_key", "_cut_id", "_cut_source", "_epochs", "_times", "_KEY", "_id", "_source", "_copies", "_time", "_gone", "_twice", "_place", "_row", "_parts", "class_lang", "class_size", "wide", "bands", "own", "rest", "m", "why",
            "class_id", "links", "node", "root", "rep", "hi", "lo", "toxic", "fold", "minima", "stem", "n_tokens", "token_ids", "class", "piece", "place", "offset", "kind", "error", "content", "media_id")


def prose(rng: random.Random, n: int, base: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward_rows(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    some = [prose(rng, rng.randint(5, 200)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(some)]
    rows += [(100, some[0], "en", "s0", 1), (101, some[0] + " more", None, None, None), (102, None, "de", "s1", None), (103, "", None, "s1", 0), (104, " \n\t ", "fr", None, 4)]
    rows += [(105, long, "en", "s0", len(long)), (106, long + " tail", "en", "s0", len(long)), (107, "!!! ... ---", "en", "s2", 11), (108, "one", "en", "s2", 3), (109, "\x00   é漢字 🙂", "zz", "s2", 9)]
    rows += [(None, some[1], "en", "s1", 1), (None, None, None, None, None), (110, some[2], "en", "s1", 1), (110, some[2], "en", "s1", 1), (110, some[3], "en", "s2", 1)]
    return rows


def awkward(spark, seed: int = 0, clashing: bool = True):
    """The rows as a table, with extra columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(seed), SCHEMA)
    return docs.select("*", *(F.lit(c).alias(c) for c in CLASHING)) if clashing else docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.collect())
