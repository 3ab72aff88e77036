"""Tokeniser fertility: rejecting texts whose tokens are unlike those of their language.

Two public vocabularies read each text.  The one of pieces gives the characters per token, the share of tokens that
are single bytes for want of a piece (bytes of white space don't count), and the entropy of the tokens in bits; the
byte-level one gives its own characters per token.  Entropy and, less so, the others depend on length, so documents
are compared within a *class*: their language and the binary order of magnitude of their tokens.

A *band* of a measure in a class reaches from its lower quartile less `low` spreads to its upper quartile and `high`
spreads; the spread is the distance of the quartiles, or a least value.  Quartiles are exact over all documents, on
measures in steps of 1/1000 (byte share: 1/10000), from counts by step, which stay small however large the table is.
A document outside a band is rejected, with the measures named in `reasons`.

*Small classes.*  A class of fewer than `least` documents takes its quartiles from the nearest sizes of its language as well,
as many as give `least`, or all of them; a language of fewer than `least` documents is judged as all languages together are,
in the same way.  So every document is judged, in a table of any size.  As longer texts have more entropy, entropy then
counts only if the distance from the most that so many tokens can have (log2 n) lies outside its band too; and the other measures get `noise / sqrt(n)`
more room, the scatter of n tokens.

Defined results: a text that is null, empty or blank has no tokens worth measuring and is rejected with the reason
`empty`.  A null or missing lang is a language of its own.  A document alone in its table is its own measure, and is kept.  Repeated
rows count as often as they occur and are all kept or all rejected.  A very long text is measured whole.  Extra columns are carried through by
`keep_by_rules`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm import tokenizers
from gritsieve.llm.shared import small_batches, unused, written


@dataclass(frozen=True)
class Band:
    """How far a measure may lie outside its quartiles, in spreads; None: any distance.  noise: see the module on small classes."""

    low: float | None
    high: float | None
    step: float
    least_spread: float
    noise: float = 0.0


BANDS: dict[str, Band] = {
    "chars_per_token": Band(4.0, 4.0, 0.001, 0.03, 9.0),
    "byte_share": Band(None, 4.0, 0.0001, 0.01, 1.0),
    "entropy": Band(2.0, None, 0.001, 0.06),
    "chars_per_byte_token": Band(4.0, 4.0, 0.001, 0.03, 9.0),
}
_DEFICIT = Band(None, 2.0, 0.001, 0.06, 2.0)
LEAST = 30
_ALL, _NO_LANG = "\x00all", "\x00none"
_FIELDS = "n_tokens int, chars_per_token double, byte_share double, entropy double, chars_per_byte_token double"


def measure(texts: list[str], folder: str = tokenizers.FOLDER, pieces: str = tokenizers.PIECE_BPE, bytes_: str = tokenizers.BYTE_BPE) -> dict[str, np.ndarray]:
    """The measures of some texts; a text without tokens has zeros."""
    model, is_byte = tokenizers.piece_bpe(pieces, folder)
    encoder = tokenizers.byte_bpe(bytes_, folder)
    ids = [np.asarray(x, np.int32) for x in model.encode(texts, num_threads=1)]
    n = np.array([len(x) for x in ids], np.int64)
    chars = np.array([len(t) for t in texts], float)
    total = np.maximum(n, 1)
    row = np.repeat(np.arange(len(texts)), n)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
    share = np.bincount(row, weights=is_byte[flat], minlength=len(texts)) / total
    _, first, count = np.unique(row * np.int64(1 << 32) + flat, return_index=True, return_counts=True)
    # entropy = log2 n - sum of c log2 c / n over the counts c of a text's tokens
    entropy = np.log2(total) - np.bincount(row[first], weights=count * np.log2(count), minlength=len(texts)) / total
    other = np.array([len(encoder.encode_ordinary(t)) for t in texts])
    return {"n_tokens": n.astype(np.int32), "chars_per_token": chars / total, "byte_share": share, "entropy": np.maximum(entropy, 0.0), "chars_per_byte_token": chars / np.maximum(other, 1)}


def measures(folder: str = tokenizers.FOLDER, batch_chars: int = 200_000):
    """A column function of a text: a struct of its measures, null for a null, empty or blank text."""

    @F.arrow_udf(_FIELDS)
    def fertility(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        blank = np.array([t is None or not t.strip() for t in texts], bool)
        parts: list[dict[str, np.ndarray]] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > batch_chars:
                parts.append(measure(held, folder))
                held, size = [], 0
        parts.append(measure(held, folder))
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        columns = [pa.array(np.concatenate([p[c] for p in parts])) for c in names]
        return pa.StructArray.from_arrays(columns, names, mask=pa.array(blank))

    return fertility


def _size(n_tokens):
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def bands_of(scored: DataFrame, rules: dict[str, Band] = BANDS, least: int = LEAST) -> DataFrame:
    """(class_lang, class_size, wide, bands: map of measure to (low, high)) from rows of (class_lang, class_size, m: struct of measures).

    wide: other sizes had to be taken in.  The language _ALL stands for all of them; languages of fewer than `least` documents
    have no bands of their own.
    """
    rules = rules | {"deficit": _DEFICIT}
    values = {name: f"m.{name}" for name in rules} | {"deficit": "(log2(greatest(m.n_tokens, 1)) - m.entropy)"}
    stacked = ", ".join(f"'{name}', cast(floor({values[name]} / {b.step!r}) as long)" for name, b in rules.items())
    counts = scored.where("m is not null").select("class_lang", "class_size", F.expr(f"stack({len(rules)}, {stacked}) as (measure, step)")).groupBy("class_lang", "class_size", "measure", "step").agg(F.count("*").alias("count"))
    counts = written(counts, "fertility-counts")
    every = counts.groupBy(F.lit(_ALL).alias("class_lang"), "class_size", "measure", "step").agg(F.sum("count").alias("count"))
    # as many rows as there are languages times orders of magnitude
    sizes = counts.where("measure = 'deficit'").groupBy("class_lang", "class_size").agg(F.sum("count").alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(W.partitionBy("class_lang"))).where(f"total >= {least}").drop("total")
    sizes = sizes.union(every.where("measure = 'deficit'").groupBy("class_lang", "class_size").agg(F.sum("count").alias("n")))
    near = sizes.select("class_lang", "class_size").join(sizes.select("class_lang", F.col("class_size").alias("from_size"), "n"), "class_lang").withColumn("far", F.abs(F.col("class_size") - F.col("from_size")))
    inside = near.withColumn("within", F.sum("n").over(W.partitionBy("class_lang", "class_size").orderBy("far").rangeBetween(W.unboundedPreceding, -1)))
    taken = inside.where(f"coalesce(within, 0) < {least}").withColumn("wide", F.max("far").over(W.partitionBy("class_lang", "class_size")) > 0).select("class_lang", "class_size", "from_size", "wide")
    pooled = counts.union(every).withColumnRenamed("class_size", "from_size").join(taken, ["class_lang", "from_size"])
    pooled = pooled.groupBy("class_lang", "class_size", "wide", "measure", "step").agg(F.sum("count").alias("count"))
    of = W.partitionBy("class_lang", "class_size", "measure")
    ranked = pooled.withColumn("upto", F.sum("count").over(of.orderBy("step"))).withColumn("n", F.sum("count").over(of))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("step")))
    found = ranked.groupBy("class_lang", "class_size", "wide", "measure").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, b in rules.items():
        spread = F.greatest((F.col("q3") - F.col("q1")) * b.step, F.lit(b.least_spread))
        if b.low is not None:
            low = F.when(F.col("measure") == name, F.col("q1") * b.step - b.low * spread).otherwise(low)
        if b.high is not None:
            high = F.when(F.col("measure") == name, (F.col("q3") + 1) * b.step + b.high * spread).otherwise(high)
    bands = F.map_from_entries(F.collect_list(F.struct("measure", F.struct(low.alias("low"), high.alias("high")))))
    return found.groupBy("class_lang", "class_size", "wide").agg(bands.alias("bands"))


def _lang(docs: DataFrame):
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return F.coalesce(lang.cast("string"), F.lit(_NO_LANG))


def _judged(scored: DataFrame, m: str, reasons: str, rules: dict[str, Band], least: int) -> DataFrame:
    """scored with a column of reasons; the bands are few (languages times orders of magnitude) and read from a written table."""
    classed = scored.select(_lang(scored).alias("class_lang"), _size(F.col(f"{m}.n_tokens")).alias("class_size"), F.col(m).alias("m"))
    bands = written(bands_of(classed, rules, least), "bands")
    lang_, size_, own_, rest_ = unused(scored, "lang", "size", "own", "rest")
    own = bands.where(F.col("class_lang") != _ALL).select(F.col("class_lang").alias(lang_), F.col("class_size").alias(size_), F.struct("wide", "bands").alias(own_))
    # one row for each order of magnitude
    rest = F.broadcast(bands.where(F.col("class_lang") == _ALL).select(F.col("class_size").alias(size_), F.struct("wide", "bands").alias(rest_)))
    size = _size(F.col(f"{m}.n_tokens"))
    both = scored.join(own, (_lang(scored) == F.col(lang_)) & (size == F.col(size_)), "left").drop(lang_, size_)
    both = both.join(rest, size == F.col(size_), "left").drop(size_)
    band = F.coalesce(F.col(own_), F.col(rest_))
    wide, room = band["wide"], 1 / F.sqrt(F.greatest(F.col(f"{m}.n_tokens"), F.lit(1)).cast("double"))

    def outside(name: str, value, noise: float):
        # a bound of null says nothing
        more = F.when(wide, F.lit(noise) * room).otherwise(F.lit(0.0))
        return F.coalesce(value < band["bands"][name]["low"] - more, F.lit(False)) | F.coalesce(value > band["bands"][name]["high"] + more, F.lit(False))

    found = {name: outside(name, F.col(f"{m}.{name}"), b.noise) for name, b in rules.items()}
    if "entropy" in found:
        deficit = F.log2(F.greatest(F.col(f"{m}.n_tokens"), F.lit(1))) - F.col(f"{m}.entropy")
        found["entropy"] &= ~wide | outside("deficit", deficit, _DEFICIT.noise)
    named = F.array_compact(F.array(*(F.when(is_out, F.lit(name)) for name, is_out in found.items())))
    return both.withColumn(reasons, F.when(F.col(m).isNull(), F.array(F.lit("empty"))).otherwise(named)).drop(own_, rest_)


def fertility_report(docs: DataFrame, folder: str = tokenizers.FOLDER, rules: dict[str, Band] = BANDS, least: int = LEAST) -> DataFrame:
    """(doc_id, lang, n_tokens, the measures, keep, reasons) of every document."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = written(small_batches(docs).select("doc_id", lang.alias("lang"), measures(folder)("text").alias("_m")), "fertility")
    judged = _judged(scored, "_m", "why", rules, least)
    return judged.select("doc_id", "lang", "_m.*", (F.size("why") == 0).alias("keep"), F.array_join("why", ",").alias("reasons"))


def keep_by_rules(docs: DataFrame, folder: str = tokenizers.FOLDER, rules: dict[str, Band] = BANDS, least: int = LEAST) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Documents are written with their measures once, so that neither a second reading by the tokenizers nor a join of
    their texts is needed when the bands are known.
    """
    m, why = unused(docs, "m", "why")
    scored = written(small_batches(docs).withColumn(m, measures(folder)("text")), "fertility")
    return _judged(scored, m, why, rules, least).where(F.size(why) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
