"""The folder that all executors share, tables written there to cut lineage, and counts that several operators need."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritsieve.llm.blocks import blocks


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset, a temporary folder is made and set, but only under a local master: on a cluster a
    machine's own folder would not outlive that machine, so there the missing setting is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gritsieve-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on passes rows to Python in batches of about BATCH_BYTES, unless it sets a size of its own.

    Texts of a task are held in the JVM, in Arrow's memory and in Python at once, so a batch of the default 64 MB
    costs several times that in each of an executor's workers.  A row larger than a batch is a batch of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING).rstrip("bB") == str(_BATCH_DEFAULT):
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/gritsieve/{name}-{uuid.uuid4().hex}"


_tables: dict[str, SparkSession] = {}
"""Paths of the tables that this process has written and not deleted yet, in their order."""


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    _tables[path] = df.sparkSession
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._gritsieve_path = path
    return table


def _delete(path: str) -> None:
    spark = _tables.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for table in tables:
        if table._gritsieve_path in _tables:
            _delete(table._gritsieve_path)


@contextmanager
def scratch():
    """Deletes the tables written within it at its end, but those given to the function that it yields."""
    before, kept = set(_tables), set()
    try:
        yield lambda table: kept.add(table._gritsieve_path)
    finally:
        for path in [p for p in _tables if p not in before and p not in kept]:
            _delete(path)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names of columns that df doesn't have, in any case of their letters, for columns of our own."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any(f"_{w}{tail}".lower() in taken for w in wanted):
        tail += "_"
    return [f"_{w}{tail}" for w in wanted]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NOISE = np.zeros(256, bool)
_NOISE[list(b"$%&#*!|")] = True


def counts_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words between ASCII white space, noise characters) of each text of a block."""
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    firsts = at[:-1][np.diff(at) > 0]
    begins[firsts] = ~blank[firsts]
    n = len(at) - 1
    words = np.diff(np.searchsorted(np.flatnonzero(begins), at))
    noise = np.diff(np.searchsorted(np.flatnonzero(_NOISE[data]), at))
    return words.reshape(n), noise.reshape(n)


@lru_cache(maxsize=1)
def _counter():
    @F.arrow_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("noise", T.LongType())]))
    def counts(text: pa.Array) -> pa.Array:
        parts = [counts_of(data, at) for _, _, data, at in blocks(text)]
        words, noise = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in (0, 1))
        return pa.StructArray.from_arrays([pa.array(words), pa.array(noise)], ["words", "noise"])

    return counts


def text_counts(text: str = "text") -> Column:
    """A struct of the words and the noise characters of a text column, counted on its bytes; null and blank texts have no word.

    Counting in numpy takes a fraction of the time of regular expressions in the JVM, even with the texts' way to Python.
    """
    return _counter()(F.col(text))


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space in a text column; null and blank texts have none."""
    return text_counts(text)["words"]
