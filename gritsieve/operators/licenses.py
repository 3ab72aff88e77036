"""Licenses of texts: by equal words, by similar words, by name, and by tag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.spdx import expression_leaves
from gritsieve.functions.text import EDGE, bounded_at_first, joined_words, license_tag, tokens
from gritsieve.operators import similar
from gritsieve.sources.tables import kept

THRESHOLD = 0.8


def exact_matches(texts: DataFrame, ref: DataFrame, key: str = "relpath", text: str = "text", skip_self: bool = False) -> DataFrame:
    """(key, license): the reference of lowest ord with the same sequence of words.

    skip_self: a reference whose key is the text's own doesn't count.  Texts without a word match nothing.
    """
    # behind the generator, so that the words are joined once and not once more for each test of the hash
    mine = texts.select(F.col(key), F.explode(F.array(joined_words(F.col(text)))).alias("_joined")).where("_joined <> ''").select(key, F.md5("_joined").alias("tok_md5"))
    both = mine.join(ref.select(F.col("key").alias("_key"), F.col("ord").alias("_ord"), "tok_md5"), "tok_md5")
    if skip_self:
        both = both.where(F.col(key).cast("string") != F.col("_key"))
    return both.groupBy(key).agg(F.min_by("_key", "_ord").alias("license"))


ALIASES = 64
"""Up to so many aliases are collected and looked for one by one; more are joined by their pieces."""

REFERENCE_WORDS = 8_000_000
"""References of up to so many distinct words in all (64 MB) are sent to all executors; larger ones are joined."""


def similar_matches(texts: DataFrame, ref: DataFrame, key: str = "relpath", text: str = "text", threshold: float = THRESHOLD, skip_self: bool = False, most: int = REFERENCE_WORDS) -> DataFrame:
    """(key, license, score): the reference of the greatest Dice coefficient of distinct words, at least `threshold`; ties go to the lowest ord.

    A text of a words can only reach the threshold if it shares ceil(t a / (2 - t)) of them, so one of its rarest
    a - ceil(...) + 1 is among those shared.  References whose words are counted and found few are searched in one pass over the
    texts, without a shuffle; others by a join.  Both find every pair at or above the threshold, and so the same.
    """
    refs = kept(ref.where("n_tokens > 0").select(F.col("key"), F.col("ord"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("words")), "references")
    if (refs.agg(F.sum(F.size("words"))).first()[0] or 0) <= most:
        return _similar_to_few(texts, refs, key, text, threshold, skip_self)
    return _similar_by_join(texts, ref, key, text, threshold, skip_self)


def _similar_to_few(texts: DataFrame, refs: DataFrame, key: str, text: str, threshold: float, skip_self: bool) -> DataFrame:
    """`similar_matches` with references (key, ord, words), words being hashes, that each task holds as a whole."""
    table = refs.orderBy("ord", "key").toArrow()
    flat = table["words"].combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in table["words"]], np.int64)
    vocabulary, words = np.unique(flat, return_inverse=True)
    words = words.astype(np.int32)
    bearers = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[np.argsort(words, kind="stable")]
    df = np.bincount(words, minlength=len(vocabulary))
    names = table["key"].to_pylist()
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, words, bearers, df, sizes, names))
    share, kind = threshold / (2.0 - threshold), dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words, bearers, df, sizes, names = sent.value
        lists, begins = np.concatenate([[0], np.cumsum(df)]), np.concatenate([[0], np.cumsum(sizes)])
        number = {name: i for i, name in enumerate(names)}
        mark = np.zeros(len(vocabulary), bool)

        def best(h: np.ndarray, own: str | None) -> tuple[str, float] | None:
            n = len(h)
            if not n or not len(vocabulary):
                return None
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            ids = at[vocabulary[at] == h]
            room = n - int(np.ceil(n * share - 1e-9)) + 1 - (n - len(ids))
            if room <= 0:
                return None
            rare = ids[np.argsort(df[ids], kind="stable")][:room]
            among = np.unique(np.concatenate([bearers[lists[i] : lists[i + 1]] for i in rare.tolist()]))
            # of two sets, the smaller must have at least this share of the larger one's words
            among = among[(n >= sizes[among] * share - 1e-9) & (sizes[among] >= n * share - 1e-9)]
            if skip_self:
                among = among[among != number.get(own, -1)]
            if not len(among):
                return None
            mark[ids] = True
            count, ends = sizes[among], np.cumsum(sizes[among])
            places = np.arange(ends[-1]) + np.repeat(begins[among] - (ends - count), count)
            shared = np.add.reduceat(mark[words[places]], ends - count, dtype=np.int64)
            mark[ids] = False
            score = (2.0 * shared) / (n + count)
            top = int(score.argmax())  # the first of equals has the lowest ord
            return (names[among[top]], float(score[top])) if score[top] >= threshold else None

        for batch in batches:
            owns = batch.column(1).to_pylist()
            found = [(i, x) for i, h in enumerate(batch.column(2)) if h.is_valid and (x := best(h.values.to_numpy(), owns[i]))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found])), pa.array([x[0] for _, x in found]), pa.array([x[1] for _, x in found])], [key, "license", "score"])

    mine = texts.select(F.col(key), F.col(key).cast("string").alias("_own"), F.transform(F.array_distinct(tokens(F.col(text))), lambda w: F.xxhash64(w)).alias("_words"))
    return mine.mapInArrow(run, f"`{key}` {kind}, license string, score double")


def _words(text: str) -> Column:
    """The distinct words of a text, as hashes."""
    return F.transform(F.array_distinct(tokens(F.col(text))), lambda w: F.xxhash64(w))


def _similar_by_join(texts: DataFrame, ref: DataFrame, key: str, text: str, threshold: float, skip_self: bool) -> DataFrame:
    """`similar_matches` by joining the words in the prefixes that a pair above the threshold must share."""
    mine = texts.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("long").alias("ord"), F.lit(similar.TEXT).alias("role"), _words(text).alias("words"))
    theirs = ref.select("key", "ord", F.lit(similar.REF).alias("role"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("words"))
    found = similar.most_similar(mine.unionByName(theirs), threshold, skip_self)
    return found.select(F.col("key").cast(dict(texts.dtypes)[key]).alias(key), "license", "score")


def similar_others(texts: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`similar_matches` of texts with one another, a text's own key left out; keys are numbers, of which the lowest wins a tie.

    The texts are read three times and never all held or shuffled.
    """
    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(key).cast("long").alias("ord"), F.lit(similar.TEXT | similar.REF).alias("role"), _words(text).alias("words"))
    found = similar.most_similar(rows, threshold, skip_self=True)
    return found.select(F.col("key").cast(dict(texts.dtypes)[key]).alias(key), "license", "score")


def text_matches(texts: DataFrame, ref: DataFrame, key: str = "relpath", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, score): the exact match with score 1, else the most similar reference.

    All texts are compared with both, and the keys of the results are joined: a join before would shuffle the texts.
    """
    exact = kept(exact_matches(texts, ref, key, text).withColumn("score", F.lit(1.0)), "exact")
    similar_ones = similar_matches(texts, ref, key, text, threshold)
    return exact.unionByName(similar_ones.join(exact.select(key), key, "left_anti"))


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str = "relpath", text: str = "text") -> DataFrame:
    """(key, license, alias): a row for each alias (key, ord, alias) whose first occurrence in the text stands between edges.

    Case counts.  Up to ALIASES rows, which are counted first, each is looked for as it is.  Of more, an alias can only match where its first piece between edges is a piece of the text, so that
    texts are joined by pieces and searched for few phrases each.  Aliases that begin with an edge, or have no piece, are
    joined by the whole of them.
    """
    few = aliases.select("key", "ord", "alias").limit(ALIASES + 1).collect()
    if len(few) <= ALIASES:
        phrases = list(dict.fromkeys(r.alias for r in few if r.alias))
        hits = F.array(*(F.when(F.contains(F.col(text), F.lit(a)), F.when(bounded_at_first(F.col(text), F.lit(a)), F.lit(a))) for a in phrases)) if phrases else F.array().cast("array<string>")
        found = texts.select(F.col(key), F.explode_outer(F.array_compact(hits)).alias("alias")).where("alias is not null")
        return found.join(F.broadcast(aliases.select(F.col("key").alias("license"), "alias", "ord")), "alias").select(key, "license", "alias", "ord")
    named = aliases.select(F.col("key").alias("license"), F.col("ord").alias("_ord"), "alias", F.regexp_extract("alias", f"^{EDGE}*([^{EDGE[1:-1]}]*)", 1).alias("_piece"))
    wanted = named.agg(F.array_distinct(F.collect_list("_piece")).alias("_wanted"))
    # one row, of the pieces of the aliases; texts that have none of them end here
    hit = texts.select(F.col(key), F.col(text).alias("_text")).crossJoin(wanted)
    hit = hit.withColumn("_piece", F.explode(F.array_union(F.array_intersect(F.array_distinct(F.split("_text", EDGE)), "_wanted"), F.filter("_wanted", lambda w: w == ""))))
    return hit.join(named, "_piece").where(bounded_at_first(F.col("_text"), F.col("alias"))).select(key, "license", "alias", "_ord").withColumnRenamed("_ord", "ord")


def detected(matches: DataFrame, key: str = "relpath") -> DataFrame:
    """(key, expression): the distinct licenses of a text joined by AND, in their order."""
    first = matches.groupBy(key, "license").agg(F.min("ord").alias("ord"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "license"))).alias("x"))
    return listed.select(key, F.array_join(F.col("x.license"), " AND ").alias("expression"))


def analysed(texts: DataFrame, aliases: DataFrame, detections: DataFrame | None = None, key: str = "relpath", text: str = "text") -> DataFrame:
    """(key, spdx, licenses, clues): what a text says of its licenses, without the rows that say nothing.

    In this order: a detected expression; else raw detections; else the leaves of the tag, even if they are none
    since the tag couldn't be parsed; else aliases.  detections: (key, expression, raw, clues) of a detector, if any;
    keys that clash with the texts' other columns don't matter, since only the key and the text are read.
    """
    rows = texts.select(F.col(key), license_tag(F.col(text)).alias("spdx"))
    rows = rows.withColumn("spdx", F.when(F.col("spdx") != "", F.col("spdx")))
    named = alias_matches(texts, aliases, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "license"))).alias("x")).select(key, F.col("x.license").alias("_named"))
    rows = rows.join(named, key, "left")
    none = F.lit(None).cast("array<string>")
    if detections is None:
        rows = rows.withColumns({"_found": none, "_raw": none, "_clues": none})
    else:
        by = detections.select(F.col(key), F.when(F.col("expression") != "", expression_leaves(F.col("expression"))).alias("_found"), F.when(F.size("raw") > 0, F.col("raw")).alias("_raw"), F.when(F.size("clues") > 0, F.col("clues")).alias("_clues"))
        rows = rows.join(by, key, "left")
    tagged = F.when(F.col("spdx").isNotNull(), expression_leaves(F.col("spdx")))
    out = rows.select(key, "spdx", F.coalesce("_found", "_raw", tagged, "_named").alias("licenses"), F.col("_clues").alias("clues"))
    return out.where("spdx is not null or licenses is not null or clues is not null")


def license_file_matches(files: DataFrame, ref: DataFrame, accepts: Column, key: str = "relpath", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, score) of the files that a predicate accepts for comparison with whole license texts."""
    return text_matches(files.where(accepts), ref, key, text, threshold)
