"""Scanning files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gritsieve.operators import gates
from gritsieve.plans.analysers import Analyser
from gritsieve.plans.config import ScanConfig
from gritsieve.plans.scan import analysed

INCOMING = "relpath string, size long, content binary"


def requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Tables of files (relpath, size, content) that are dropped into a folder as Parquet."""
    return spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scan_stream(files: DataFrame, analysers: list[Analyser], out: str, checkpoint: str, config: ScanConfig = ScanConfig(), sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Findings of each micro-batch, written to `out`/batch=N, or given to `sink`.

    A batch that is run again after a failure overwrites its own folder, so every file's findings are there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found, _, failed = analysed(gates.routed(rows, config.max_file_size), analysers, config)
        if failed:  # the batch is tried again
            raise RuntimeError("; ".join(f"{category}: {message}" for _, category, message in failed))
        if sink is not None:
            sink(found, number)
        else:
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
