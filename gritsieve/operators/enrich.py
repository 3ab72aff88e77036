"""Joins with outside knowledge: components by fingerprint, and compatibility of licenses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.functions.text import fingerprint_files

REQUEST = 999


def with_components(prints: DataFrame, components: DataFrame, key: str = "relpath", last_only: bool = False) -> DataFrame:
    """prints (key, wfp) with `scan`: an array of the components (file_hash, purl, version) of the files they name, null without any.

    All files of a content are enriched; with last_only, only the last of them by its key.
    """
    hashed = prints.select(key, F.explode(fingerprint_files(F.col("wfp"))).alias("file_hash")).distinct()
    if last_only:
        hashed = hashed.groupBy("file_hash").agg(F.max(key).alias(key))
    found = hashed.join(components, "file_hash").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file_hash", "purl", "version"))).alias("scan"))
    return prints.join(found, key, "left")


def request_batches(hashes: DataFrame, column: str = "file_hash", size: int = REQUEST) -> DataFrame:
    """(batch, hashes): distinct hashes in their order, in lists of `size` but for the last one, for a remote lookup.

    Hashes are ranked among those of the same first three characters, and shifted by the counts of those before, which are as
    many as there are such beginnings; no window spans the table.
    """
    rows = hashes.select(F.col(column).alias("_h")).where("_h is not null").distinct().withColumn("_start", F.substring("_h", 1, 3))
    starts = rows.groupBy("_start").agg(F.count("*").alias("_n"))
    before = starts.select("_start", (F.sum("_n").over(W.orderBy("_start")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_start").orderBy("_h")) - 1).join(before, "_start")
    batch = F.floor((F.col("_rank") + F.col("_before")) / size).cast("long")
    return ranked.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list("_h")).alias("hashes"))


def incompatible_pairs(licenses: DataFrame, compat: DataFrame) -> DataFrame:
    """(license, other): pairs of distinct licenses (license, ord) that a matrix (left, right, verdict) rules out.

    A pair is looked up with the later license first; if that isn't ruled out, the other way round, and it appears in
    the direction that is.
    """
    a = licenses.select(F.col("license").alias("a"), F.col("ord").alias("oa"))
    b = licenses.select(F.col("license").alias("b"), F.col("ord").alias("ob"))
    no = compat.where("verdict = 'No'").select(F.col("left").alias("_l"), F.col("right").alias("_r")).distinct()
    pairs = a.join(b, F.col("oa") > F.col("ob"))
    first = no.withColumnsRenamed({"_l": "a", "_r": "b"}).withColumn("_first", F.lit(True))
    second = no.withColumnsRenamed({"_l": "b", "_r": "a"}).withColumn("_second", F.lit(True))
    both = pairs.join(first, ["a", "b"], "left").join(second, ["a", "b"], "left").where("_first or _second")
    return both.select(F.when(F.col("_first"), F.col("a")).otherwise(F.col("b")).alias("license"), F.when(F.col("_first"), F.col("b")).otherwise(F.col("a")).alias("other"))
