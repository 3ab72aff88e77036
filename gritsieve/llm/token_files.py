"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Each document becomes a row of its id, its number of tokens and its token ids.  ORC stores the ids in stripes with
its run-length encoding for integers; a row index holds the least and greatest doc_id of every `row_stride` rows, and
a Bloom filter on doc_id the rest.  Rows are sorted by doc_id within a file, so ranges prune to few row groups, and
single ids to the groups whose filter lets them pass.  Readers split files at stripes.

Defined results: a null text has null token_ids and n_tokens null; an empty text has an empty list and 0.  Repeated
rows are written as often as they occur.  Rows with a null doc_id are written, but no id finds them.  Extra columns are
ignored.  An empty table makes an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm import tokenizers
from gritsieve.llm.shared import small_batches

SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"
STRIPE_BYTES, ROW_STRIDE, FALSE_POSITIVES = 64 << 20, 10_000, 0.01


def encoded(folder: str = tokenizers.FOLDER, name: str = tokenizers.BYTE_BPE, batch_tokens: int = 1 << 20):
    """A column function of a text: its token ids in a byte-level vocabulary; every text can be decoded again."""

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        encoder = tokenizers.byte_bpe(name, folder)
        ends, parts, held = np.zeros(len(text) + 1, np.int32), [], []
        for i, cell in enumerate(text):
            ids = encoder.encode_ordinary(t) if (t := cell.as_py()) else ()
            ends[i + 1] = ends[i] + len(ids)
            held.extend(ids)
            if len(held) > batch_tokens:
                parts.append(np.array(held, np.int32))
                held = []
        parts.append(np.array(held, np.int32))
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)), mask=text.is_null() if text.null_count else None)
        return listed

    return encode


def token_count(folder: str = tokenizers.FOLDER, name: str = tokenizers.BYTE_BPE):
    """A column function of a text: how many token ids `encoded` gives it; null and empty texts have none."""

    @F.arrow_udf("int")
    def count(text: pa.Array) -> pa.Array:
        encoder = tokenizers.byte_bpe(name, folder)
        return pa.array([len(encoder.encode_ordinary(t)) if (t := cell.as_py()) else 0 for cell in text], pa.int32())

    return count


def tokenized(docs: DataFrame, folder: str = tokenizers.FOLDER, name: str = tokenizers.BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), encoded(folder, name)("text").alias("token_ids"))
    return rows.select("doc_id", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "token_ids")


def write_tokens(tokens: DataFrame, path: str, stripe_bytes: int = STRIPE_BYTES, row_stride: int = ROW_STRIDE, false_positives: float = FALSE_POSITIVES) -> None:
    """Writes (doc_id, n_tokens, token_ids) as ORC; nothing is shuffled."""
    options = {
        "orc.stripe.size": stripe_bytes,
        "orc.row.index.stride": row_stride,
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": false_positives,
        "orc.compress": "ZSTD",
        "compression": "zstd",
    }
    tokens.sortWithinPartitions("doc_id").write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Iterable[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """The written rows, all of them or those of some ids; the filter reaches the row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(*ids))
    if between is not None:
        rows = rows.where(F.col("doc_id").between(*between))
    return rows


def file_facts(spark: SparkSession, path: str) -> list[dict]:
    """Of each ORC file: its rows, its stripes' rows, the row index stride, and the kinds of streams that a stripe has for doc_id."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    facts = []
    for status in root.getFileSystem(conf).listStatus(root):
        if not status.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes = reader.getStripes()
        rows = reader.rows()
        kinds = set()
        for stripe in stripes:
            footer = rows.readStripeFooter(stripe)
            kinds |= {s.getKind().toString() for s in footer.getStreamsList() if s.getColumn() == 1}
            encodings = {footer.getColumns(i).getKind().toString() for i in (1, 2, 4)}
        facts.append({"rows": reader.getNumberOfRows(), "stripes": [s.getNumberOfRows() for s in stripes], "stride": reader.getRowIndexStride(), "streams": kinds if stripes else set(), "encodings": encodings if len(stripes) else set()})
        rows.close()
        reader.close()
    return facts
