"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of all texts of an Arrow batch are counted with numpy on their bytes.  Training puts each statistic into
quantile bins, grows trees level by level from histograms of gradients and Hessians of the logistic loss, and keeps
the trees as flat arrays (feature, threshold, children, value), over which all rows of a batch move at once.

Defined results: null and empty texts have the statistics of an empty text, and a score like any other.  Labels with a
null doc_id or class are ignored; a document with labels that disagree counts by the highest; repeated rows of a
document are learned from once each.  With labels of only one class, or none, every score is the share of good labels
(0.5 without labels).  Equal texts have equal scores.  Extra columns are ignored by `quality_scores`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.blocks import Words, blocks
from gritsieve.llm.shared import small_batches

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digit", "space", "newline", "wide", "stop", "noise", "pipe",
    "distinct_words", "top_word", "doubled_words", "line_words", "short_words", "long_words", "upper_words",
)


def _classes() -> np.ndarray:
    table = np.zeros((256, 9), np.float32)
    table[65:91, 0] = table[97:123, 1] = table[48:58, 2] = 1
    table[[9, 11, 12, 13, 32], 3] = 1
    table[10, 4] = 1
    table[128:192, 5] = 1
    for at, chars in ((6, b".,;:?'\"()-"), (7, b"!#$%&*+/<=>@[\\]^_`{}~"), (8, b"|")):
        table[list(chars), at] = 1
    return table


_CLASS = np.argmax(np.concatenate([np.full((256, 1), 0.5, np.float32), _classes()], 1), 1).astype(np.int64)


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a block."""
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.diff(at)
    some = np.maximum(size, 1)
    text = np.repeat(np.arange(n), size)
    share = np.bincount(text * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10) if n else np.zeros((0, 10))
    words = Words(data, at)
    count = np.diff(words.of)
    any_ = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    row = words.row
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = np.bincount(row, weights=length, minlength=n) / any_
    out[:, 3] = np.sqrt(np.maximum(np.bincount(row, weights=length**2, minlength=n) / any_ - out[:, 2] ** 2, 0))
    out[:, 4:13] = share[:, 1:] / some[:, None]
    if len(words):
        h = words.hashes()
        order = np.lexsort((h, row))
        hr, rr = h[order], row[order]
        new = np.concatenate([[True], (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(hr)))
        out[:, 13] = np.bincount(rr[first], minlength=n) / any_
        top = np.zeros(n)
        np.maximum.at(top, rr[first], times)
        out[:, 14] = top / any_
        twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[:, 15] = np.bincount(row[1:][twice], minlength=n) / any_
        out[:, 17] = np.bincount(row[length <= 2], minlength=n) / any_
        out[:, 18] = np.bincount(row[length >= 14], minlength=n) / any_
        caps = (data[words.start] >= 65) & (data[words.start] <= 90)
        out[:, 19] = np.bincount(row[caps], minlength=n) / any_
    out[:, 16] = count / (share[:, 5] + 1) if n else 0
    return out


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: node i goes to left[i] if its feature is at most threshold[i], else to right[i]; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of each row, moving all rows down a tree at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees of the logistic loss; a leaf has at least `least` of Hessian weight."""
    good = float(y.mean()) if len(y) else 0.5
    if not len(y) or good in (0.0, 1.0):
        base = np.log(np.clip(good, 1e-6, 1 - 1e-6) / (1 - np.clip(good, 1e-6, 1 - 1e-6)))
        none = np.zeros(1, np.int64)
        return Trees(none, np.zeros(1), none, none, np.zeros(1), np.zeros(0, np.int64), 0, float(base))
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    base = float(np.log(good / (1 - good)))
    total = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, i), (right, i), (value, 0.0)):
            a.append(v)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        level = [root]
        where = np.zeros(len(y), np.int64)  # place in level, -1 once in a leaf
        leaf = np.full(len(y), -1)
        for step in range(depth + 1):
            live = where >= 0
            k = len(level)
            gs, hs = np.bincount(where[live], g[live], k), np.bincount(where[live], h[live], k)
            best_gain, best_f, best_b = np.full(k, 1e-6), np.full(k, -1), np.zeros(k, np.int64)
            if step < depth:
                for f in range(d):
                    width = len(cuts[f]) + 1
                    if width < 2:
                        continue
                    at = where[live] * width + binned[live, f]
                    gl = np.cumsum(np.bincount(at, g[live], k * width).reshape(k, width), 1)[:, :-1]
                    hl = np.cumsum(np.bincount(at, h[live], k * width).reshape(k, width), 1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                    gain[(hl < least) | (hr < least)] = 0
                    b = gain.argmax(1)
                    top = gain[np.arange(k), b]
                    better = top > best_gain
                    best_gain[better], best_f[better], best_b[better] = top[better], f, b[better]
            after, place = [], np.full((k, 2), -1)
            for i, at in enumerate(level):
                if best_f[i] < 0:
                    value[at] = float(-rate * gs[i] / (hs[i] + ridge))
                    continue
                feature[at], threshold[at] = int(best_f[i]), float(cuts[best_f[i]][best_b[i]])
                left[at], right[at] = node(), node()
                place[i] = len(after), len(after) + 1
                after += [left[at], right[at]]
            ends = live & (best_f[np.maximum(where, 0)] < 0)
            leaf[ends] = np.asarray(level)[where[ends]]
            go = live & ~ends
            i = where[go]
            side = (binned[go, best_f[i]] > best_b[i]).astype(int)
            where[ends] = -1
            where[go] = place[i, side]
            level = after
            if not level:
                break
        total += np.asarray(value)[leaf]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


_ROW = "doc_id long, good int, x array<double>"


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, good, x): the statistics of each text of (doc_id, text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column(1)):
                x = statistics_of(data, at)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), listed], names=["doc_id", "good", "x"])

    return small_batches(docs).select("doc_id", "text", "good").mapInArrow(run, _ROW)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> Trees:
    """Trees from labelled documents.

    sample: at most so many labelled documents are learned from, those whose hash of doc_id comes first; it bounds the
    training of the classifier only.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("good"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: small by the bound, whatever the size of the labels
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    table = statistics(known).toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y, ids = table["good"].to_numpy().astype(float), table["doc_id"].to_numpy()
    order = np.lexsort((*x.T, ids))  # the same trees in whatever order the rows came
    return fit(x[order], y[order], **how)


def quality_scores(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality_score, keep) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column(1)):
                s = trees.scores(statistics_of(data, at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "quality_score", "keep"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, quality_score double, keep boolean")
