"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of a token budget in proportion to its target weight.  A share of at least the tokens of
the source gives as many complete epochs, in which every document counts; what is left is filled by weighted sampling
without replacement: a document has the exponential key `-ln(u) / weight`, u being a hash of its id, and the
documents of least key are taken in order while the sum of their tokens stays within what is left.

The order is never sorted as a whole.  Keys fall into buckets, a fixed number to each doubling of a key, so that the scale of
the weights doesn't matter; sums by (source, bucket) show the one bucket of each source in which the budget ends, and only that is sorted.  The result is one cut (key, doc_id) for each source, and
documents are then chosen by comparing with the cut of their source, without moving their texts.

Defined results: a null source is a source of its own.  A weight that is null, not a number or not above 0 counts as `least_weight`.
Documents of no token cost nothing and follow the cut of their source.  Repeated rows of a doc_id tie and are taken
or left together.  A source of no token, or of target weight 0, gets nothing; a null or missing target weight counts as 0.
A null text has no token, and a very long one
with more tokens than are left is taken in whole epochs alone.  An empty table gives an empty result.  Extra columns are carried through by `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm import tokenizers
from gritsieve.llm.shared import small_batches, text_counts, unused, written
from gritsieve.llm.token_files import token_count

BUCKETS = 512
"""Buckets to each doubling of a key: with equal weights none holds more than a part in 1000 of a source."""
_NONE = "\x00none"


def noise_weight(text: str = "text") -> Column:
    """A document's quality weight: its words over its words and noise characters together."""
    counts = text_counts(text)
    return F.when(counts["words"] > 0, counts["words"].cast("double") / (counts["words"] + counts["noise"]).cast("double")).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: int, least_weight: float) -> Column:
    """`-ln(u) / weight`, u from 52 bits of the MD5 of seed and id, between 0 and 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / F.lit(4503599627370496.0)
    return -F.log(u) / F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(F.lit(least_weight))


_LEAST_ID = -(2**63)


def keyed(docs: DataFrame, tokens: Column, key: Column, buckets: int = BUCKETS) -> DataFrame:
    """(source, doc_id, tokens, key, bucket) of every document, nulls replaced: the one narrow table that all sums are taken from."""
    rows = small_batches(docs).select(F.coalesce(F.col("source"), F.lit(_NONE)).alias("source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("doc_id"), tokens.alias("tokens"), key.alias("key"))
    doublings = F.least(F.greatest(F.log2("key"), F.lit(-1100.0)), F.lit(1100.0))
    return written(rows.withColumn("bucket", F.floor(doublings * buckets).cast("int")), "keys")


def cuts(rows: DataFrame, targets: DataFrame | None, budget: int | None) -> DataFrame:
    """(source, epochs, cut_key, cut_id) from keyed rows, for each source that gets anything."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    total = sums.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0")
    if targets is None:
        shares = total.withColumn("share", F.lit(1.0))
    else:
        named = targets.select(F.coalesce(F.col("source"), F.lit(_NONE)).alias("source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("share"))
        shares = total.join(named, "source")
    shares = written(shares, "shares")
    whole = shares.agg(F.sum("total"), F.sum("share")).first()
    limit, parts = (whole[0] or 0) if budget is None else budget, whole[1] or 0.0
    plan = (
        shares.where("share > 0")
        .withColumn("target", F.floor(F.lit(float(limit)) * F.col("share") / F.lit(parts or 1.0)).cast("long"))
        .withColumn("epochs", F.floor(F.col("target") / F.col("total")).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))
        .select("source", "epochs", "rest")
    )
    before = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")))
    at = before.join(plan, "source").where("upto - tokens <= rest")
    # the boundary is the last bucket that begins within what is left
    boundary = at.groupBy("source").agg(F.max_by(F.struct("bucket", F.expr("upto - tokens as before"), "rest"), "bucket").alias("x")).select("source", "x.*")
    inside = rows.join(boundary, ["source", "bucket"]).withColumn("sum", F.col("before") + F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id")))
    chosen = inside.where("sum <= rest").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    # where no document of the boundary fits, the cut lies at the end of the bucket before it
    lower = rows.join(boundary.select("source", F.col("bucket").alias("last")), "source").where("bucket < last").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("low"))
    return plan.join(chosen, "source", "left").join(lower, "source", "left").select("source", "epochs", F.coalesce("cut.key", "low.key").alias("cut_key"), F.coalesce("cut.doc_id", "low.doc_id").alias("cut_id")).where("epochs > 0 or cut_key is not null")


def _with_copies(wide: DataFrame, names: tuple[str, str, str], copies: str, rows: DataFrame, targets: DataFrame | None, budget: int | None) -> DataFrame:
    """wide with its copies, without the rows that aren't taken; names: of its columns of source, id and key.

    The cuts are a row for each source; Catalyst broadcasts them as long as their written table is small.
    """
    source, doc_id, key = names
    from_, epochs, cut_key, cut_id = unused(wide, "from", "epochs", "cut_key", "cut_id")
    cut = written(cuts(rows, targets, budget), "cuts").toDF(from_, epochs, cut_key, cut_id)
    both = wide.join(cut, F.col(source) == F.col(from_))
    taken = (F.col(key) < F.col(cut_key)) | ((F.col(key) == F.col(cut_key)) & (F.col(doc_id) <= F.col(cut_id)))
    return both.withColumn(copies, F.col(epochs) + F.coalesce(taken, F.lit(False)).cast("long")).where(F.col(copies) > 0).drop(from_, epochs, cut_key, cut_id)


def _columns(docs: DataFrame, tokens: Column | None, weight: Column | None, seed: int, least_weight: float, folder: str) -> tuple[Column, Column]:
    return (token_count(folder)("text").cast("long") if tokens is None else tokens), sampling_key(F.col("doc_id"), noise_weight() if weight is None else weight, seed, least_weight)


def sampled(docs: DataFrame, targets: DataFrame | None = None, budget: int | None = None, tokens: Column | None = None, weight: Column | None = None, seed: int = 17, least_weight: float = 0.01, buckets: int = BUCKETS, folder: str = tokenizers.FOLDER) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken; texts are read once.

    targets: (source, weight), all sources alike if None.  budget: tokens to take; if None, the tokens of all sources
    that have a target.  tokens: of a document, those of the byte-level vocabulary
    in `folder` if None.  weight: its quality, `noise_weight` if None.
    """
    rows = keyed(docs, *_columns(docs, tokens, weight, seed, least_weight, folder), buckets)
    taken = _with_copies(rows, ("source", "doc_id", "key"), "copies", rows, targets, budget)
    return taken.select(F.expr(f"nullif(doc_id, {_LEAST_ID + 1}L - 1)").alias("doc_id"), F.nullif(F.col("source"), F.lit(_NONE)).alias("source"), "tokens", "copies")


def mixed(docs: DataFrame, targets: DataFrame | None = None, budget: int | None = None, tokens: Column | None = None, weight: Column | None = None, seed: int = 17, least_weight: float = 0.01, buckets: int = BUCKETS, folder: str = tokenizers.FOLDER) -> DataFrame:
    """The documents taken, each as many times as it is taken, with their own columns; options as in `sampled`.

    Keys are computed again where the documents are read for good: that is cheaper than a join of their texts.
    """
    words, key = _columns(docs, tokens, weight, seed, least_weight, folder)
    rows = keyed(docs, words, key, buckets)
    key_, id_, source_, copies, time = unused(docs, "key", "id", "source", "copies", "time")
    wide = docs.select("*", key.alias(key_), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias(id_), F.coalesce(F.col("source"), F.lit(_NONE)).alias(source_))
    taken = _with_copies(wide, (source_, id_, key_), copies, rows, targets, budget)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), times.alias(time)).drop(time)
