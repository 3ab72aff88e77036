"""Memoized analysis: results kept by content, and found again by path, size and time.

Two tables: `cache` (cache_key, data, stored_at) by content, and `cache_fastpath` (fastpath_key, cache_key, size, mtime) by
path.  They are Parquet folders of immutable parts; the latest row of a key counts, so storing only ever appends and
a task that is run again does no harm.  Results of nothing aren't kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.functions.text import content_key, fast_hash, options_fingerprint, stat_key
from gritsieve.sources.tables import kept

CACHE = "cache_key string, data string, stored_at timestamp"
FASTPATH = "fastpath_key string, cache_key string, size long, mtime timestamp, stored_at timestamp"
CAPACITY = 2 << 30


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that was stored last."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("stored_at", *[c for c in others if c != "stored_at"])).alias("x"))
    return best.select(key, "x.*")


def looked_up(files: DataFrame, cache: DataFrame, fastpath: DataFrame) -> DataFrame:
    """files with `data` and `hit` (`fast`, `primary` or null).

    files: (relpath, cache_key, fastpath_key, size, mtime, ...).  The fast path counts only while size and time
    are those that were stored, and while its content is still in the cache; otherwise the content's key decides.
    """
    kept = latest(cache, "cache_key").select(F.col("cache_key").alias("_key"), F.col("data").alias("_data"))
    fast = latest(fastpath, "fastpath_key").select(F.col("fastpath_key").alias("_fast"), F.col("cache_key").alias("_content"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    quick = fast.join(kept, F.col("_content") == F.col("_key")).select("_fast", "_size", "_mtime", F.col("_data").alias("_fast_data"))
    both = files.join(quick, (F.col("fastpath_key") == F.col("_fast")) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "left")
    both = both.join(kept, F.col("cache_key") == F.col("_key"), "left")
    hit = F.when(F.col("_fast_data").isNotNull(), "fast").when(F.col("_data").isNotNull(), "primary")
    return both.select(*(F.col(f"`{c}`") for c in files.columns), F.coalesce("_fast_data", "_data").alias("data"), hit.alias("hit"))


def evicted(cache: DataFrame, capacity: int = CAPACITY, buckets: int = 1000) -> DataFrame:
    """The rows kept when the cache may hold `capacity` bytes of data: those stored last.

    Sums by time bucket show the bucket in which the capacity ends; only that one is sorted.
    """
    rows = latest(cache, "cache_key").withColumn("_bytes", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"))
    span = rows.agg(F.min(F.unix_micros("stored_at")).alias("_a"), F.max(F.unix_micros("stored_at")).alias("_b"))
    rows = rows.crossJoin(span).withColumn("_bucket", F.floor((F.col("_b") - F.unix_micros("stored_at")) * buckets / (F.col("_b") - F.col("_a") + 1)).cast("int"))
    sums = rows.groupBy("_bucket").agg(F.sum("_bytes").alias("_sum"))
    before = sums.select("_bucket", (F.sum("_sum").over(W.orderBy("_bucket")) - F.col("_sum")).alias("_before"))  # at most `buckets` rows
    placed = rows.join(before, "_bucket").where(F.col("_before") < capacity)
    upto = F.col("_before") + F.sum("_bytes").over(W.partitionBy("_bucket").orderBy(F.desc("stored_at"), "cache_key"))
    return placed.withColumn("_upto", upto).where(F.col("_upto") <= capacity).select("cache_key", "data", "stored_at")


@dataclass(frozen=True)
class ResultsCache:
    """The two tables in a folder that all executors share."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    @property
    def cache(self) -> DataFrame:
        return self._read("cache", CACHE)

    @property
    def fastpath(self) -> DataFrame:
        return self._read("fastpath", FASTPATH)

    def get(self, keys: DataFrame) -> DataFrame:
        """keys (cache_key) with their data, null for a miss."""
        return keys.join(latest(self.cache, "cache_key").select("cache_key", "data"), "cache_key", "left")

    def get_with_fastpath(self, files: DataFrame, refresh: bool = True) -> DataFrame:
        """`looked_up` in this cache; with refresh, paths whose content was found by its key are stored for the fast path."""
        found = looked_up(files, self.cache, self.fastpath)
        if refresh:
            self._append(found.where("hit = 'primary' and fastpath_key is not null").select("fastpath_key", "cache_key", "size", "mtime"), "fastpath")
        return found

    def set(self, rows: DataFrame) -> None:
        """Stores (cache_key, data); rows without data aren't kept."""
        self._append(rows.where("data is not null").select("cache_key", "data"), "cache")

    def set_with_fastpath(self, rows: DataFrame) -> None:
        """Stores (cache_key, data, fastpath_key, size, mtime) in both tables."""
        self.set(rows)
        self._append(rows.where("data is not null and fastpath_key is not null").select("fastpath_key", "cache_key", "size", "mtime"), "fastpath")

    def evict(self, capacity: int = CAPACITY) -> None:
        """Rewrites the cache within a capacity.

        The new files join the old ones before these go, so that nobody finds the cache empty in between; if it breaks off, rows
        are there twice, of which one counts.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(f"{self.folder}/cache")):
            return
        files = lambda name: [s.getPath() for s in fs.listStatus(path(f"{self.folder}/{name}"))]
        old = files("cache")
        evicted(self.cache, capacity).write.mode("overwrite").parquet(f"{self.folder}/cache-next")
        for file in files("cache-next"):
            if file.getName().endswith(".parquet"):
                fs.rename(file, path(f"{self.folder}/cache/{file.getName()}"))
        for file in old:
            fs.delete(file, True)
        self._remove("cache-next")

    def clear(self) -> None:
        self._remove("cache")
        self._remove("fastpath")

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/{name}")

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed_files(files: DataFrame, category: str, version: int = 1, options: dict[str, object] | None = None) -> DataFrame:
    """files (relpath, path, size, mtime, content) with their cache keys."""
    prints = options_fingerprint(options or {})
    return files.withColumns({"cache_key": content_key(category, version, fast_hash(F.col("content")), F.col("size"), prints), "fastpath_key": stat_key(category, version, F.col("path"), prints)})


def with_cache(analyse: Callable[[DataFrame], DataFrame], files: DataFrame, cache: ResultsCache, category: str, version: int = 1, options: dict[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """((relpath, data) of all files, rows to store): an analysis that is only run where the cache has no result.

    analyse: files -> (relpath, data).  The rows to store are the misses' results; store them with set_with_fastpath after
    later steps have added to them.
    """
    found = cache.get_with_fastpath(keyed_files(files, category, version, options))
    hits = found.where("hit is not null").select("relpath", "data")
    misses = found.where("hit is null").drop("data", "hit")
    # both what is returned and what is stored read it: the analysis runs once
    fresh = kept(analyse(misses).select("relpath", "data"), "fresh")
    store = misses.select("relpath", "cache_key", "fastpath_key", "size", "mtime").join(fresh, "relpath")
    return hits.unionByName(fresh), store
