"""Merging and ranking of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_runs(rows: DataFrame, key: str = "relpath", first: str = "start_line", last: str = "end_line", text: str = "text") -> DataFrame:
    """(key, start_line, end_line, text, run): runs of rows that follow one another without a gap become one, texts joined by line ends.

    A row continues the run before it if it begins on the line after that one's last.  Rows of one line that begin
    anew stay apart.  Runs of a key are numbered from 1.
    """
    order = W.partitionBy(key).orderBy(first, last, text)
    island = F.sum(F.when(F.col(first) == F.lag(last).over(order) + 1, 0).otherwise(1)).over(order)
    parts = rows.where(F.col(first).isNotNull()).withColumn("run", island.cast("int"))
    merged = parts.groupBy(key, "run").agg(F.min(first).alias("start_line"), F.max(last).alias("end_line"), F.array_sort(F.collect_list(F.struct(F.col(first).alias("a"), F.col(last).alias("b"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("parts"))
    return merged.select(key, "start_line", "end_line", F.array_join(F.col("parts.t"), "\n").alias("text"), "run")


def heads(runs: DataFrame) -> DataFrame:
    """The first run of each key."""
    return runs.where("run = 1")
