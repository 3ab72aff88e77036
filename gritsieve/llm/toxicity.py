"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

*Token scores.*  On labelled documents, without near copies, it is counted how many documents of the toxic and of the
clean class have each word.  The score of a word is the difference of its log-odds between the classes under Dirichlet
priors in proportion to the pooled counts, in nats, drawn towards 0 by its confidence bound.  A word too rare to judge backs
off to the counts of its stems of 6, 5 and 4 bytes.  Every token then pays `drift`, so that ordinary text has a
negative expectation, as segment statistics require.

*Segments.*  All maximal scoring segments of a text are found in one pass over its tokens (Ruzzo and Tompa's
algorithm), on runs of equal sign, since a segment always begins and ends with such a run.

*Calibration.*  Under the clean token distribution the best segment of n tokens follows an extreme-value law:
a score of S or more is expected `E = K n exp(-lambda S)` times.  lambda solves `sum p(s) exp(lambda s) = 1` over
the scores of clean tokens; K is fitted to the maxima of shuffled clean text (see `calibrate`).  The scores of clean
tokens are held out: each half of the labelled documents is scored by what the other half teaches, so that words
which resemble toxic ones by chance are seen as often as they will be.  A segment with E at most `expected` is
significant, and a document with a significant segment is toxic.

Defined results: null and empty texts have no segment.  Labels with a null doc_id or class are ignored; a document
with labels that disagree counts as toxic; repeated rows of a document count once each.  Without both classes
among the labels nothing is known and no segment is found.  Equal segments in one text are separate rows, since
their places differ.  A very long text is searched whole, and a null doc_id stays null.  An empty table of documents has no passage, and one of
labels teaches nothing.  Extra columns are carried through by `reject_toxic` and ignored by `toxic_passages`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.blocks import Words, blocks
from gritsieve.llm.near_dedup import signatures_of
from gritsieve.llm.shared import discard, scratch, small_batches, written

STEMS = (0, 6, 5, 4)
"""Units of a word, from the most to the least specific: 0 is the whole word, else a number of leading bytes."""


@dataclass(frozen=True)
class ToxicModel:
    """Scores by unit hash (sorted), one pair of arrays for each of STEMS; the calibration."""

    keys: tuple[np.ndarray, ...]
    scores: tuple[np.ndarray, ...]
    drift: float
    lam: float
    k: float

    @property
    def known(self) -> bool:
        return any((s > 0).any() for s in self.scores)

    def token_scores(self, words: Words) -> np.ndarray:
        """The score of each word of a block: that of its most specific unit with enough counts.

        Scores only add up: a word says the same wherever it stands, so that no passage weakens a later one.
        """
        out = np.zeros(len(words))
        todo = np.ones(len(words), bool)
        for stem, keys, scores in zip(STEMS, self.keys, self.scores):
            if not len(keys):
                continue
            h = words.hashes(stem)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = todo & (keys[at] == h)
            out[hit] = scores[at[hit]]
            todo &= ~hit
        return out - self.drift

    def expected(self, score: float, n: int) -> float:
        """How many segments of this score or more clean text of n tokens has on average."""
        return self.k * n * math.exp(-min(700.0, self.lam * score))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, past the last, score) of all maximal scoring segments, in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    flips = np.flatnonzero(np.diff(positive)) + 1
    edges = np.concatenate([[0], flips, [len(scores)]])
    sums = np.add.reduceat(scores, edges[:-1])
    total = 0.0
    found: list[tuple[int, int, float, float]] = []  # first, end, score before, score after
    back: list[int] = []  # for each, the nearest earlier one with a lower score before it
    for i in range(len(sums)):
        if sums[i] <= 0:
            total += sums[i]
            continue
        first, before = int(edges[i]), total
        total += sums[i]
        after, end = total, int(edges[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = back[j]
            if j < 0 or found[j][3] >= after:
                found.append((first, end, before, after))
                back.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def _unit_counts(labelled: DataFrame, least: int) -> DataFrame:
    """(stem, unit, fold, toxic, clean): how many documents of either class, and of either fold, have each unit.

    A word counts towards its stems by at most `least` documents, in proportion of its classes, so that a stem is
    judged by many words and not by a frequent one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, fold = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for first, last, data, at in blocks(batch.column(0)):
                words = Words(data, at)
                if not len(words):
                    continue
                h, row = words.hashes(), words.row
                order = np.lexsort((row, h))
                hs, r = h[order], row[order]
                new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (r[1:] != r[:-1])])
                hs, mine, half = hs[new], toxic[first:last][r[new]].astype(np.int64), fold[first:last][r[new]].astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                example = order[new][starts]  # any one place of each word
                units = [pa.array(words.hashes(stem)[example].view(np.int64)) for stem in STEMS]
                sums = [pa.array(np.add.reduceat((mine == c) & (half == f), starts, dtype=np.int64)) for f in (0, 1) for c in (1, 0)]
                yield pa.RecordBatch.from_arrays([*units, *sums], [*(f"u{stem}" for stem in STEMS), "t0", "c0", "t1", "c1"])

    units = ", ".join(f"u{stem} long" for stem in STEMS)
    sums = [F.sum(c).cast("double").alias(c) for c in ("t0", "c0", "t1", "c1")]
    words = labelled.mapInArrow(run, f"{units}, t0 long, c0 long, t1 long, c1 long").groupBy(*(f"u{stem}" for stem in STEMS)).agg(*sums)
    share = F.least(F.lit(1.0), F.lit(float(least)) / F.expr("t0 + c0 + t1 + c1"))
    capped = words.select(F.explode(F.array(*(F.struct(F.lit(stem).alias("stem"), F.col(f"u{stem}").alias("unit")) for stem in STEMS[1:]))).alias("x"), *((F.col(c) * share).alias(c) for c in ("t0", "c0", "t1", "c1")))
    stems = capped.groupBy("x.stem", "x.unit").agg(*sums)
    return words.select(F.lit(0).alias("stem"), F.col("u0").alias("unit"), "t0", "c0", "t1", "c1").union(stems).where(f"t0 + c0 + t1 + c1 >= {least}")


def _without_copies(labelled: DataFrame, coordinates: int = 4) -> DataFrame:
    """(doc_id, text, toxic) with one document of those that share any of a few MinHash coordinates.

    A toxic document with many copies would make all of its words look toxic.
    """

    @F.arrow_udf("array<long>")
    def minima(text: pa.Array) -> pa.Array:
        parts = []
        for first, last, data, at in blocks(text):
            out = np.repeat(np.arange(first, last, dtype=np.int64)[:, None] + (1 << 40), coordinates, 1)
            has, sig = signatures_of(data, at, coordinates, 3)
            out[has] = sig
            parts.append(out)
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coordinates, dtype=np.int32)), pa.array(flat))

    rows = labelled.withColumn("minima", minima("text"))
    keys = written(rows.select("doc_id", *(F.col("minima")[i].alias(f"c{i}") for i in range(coordinates))), "minima")
    for i in range(coordinates):  # each round reads what the last one wrote
        last, keys = keys, written(keys.join(keys.groupBy(f"c{i}").agg(F.min("doc_id").alias("doc_id")), [f"c{i}", "doc_id"], "left_semi"), "minima")
        discard(last)
    return labelled.join(F.broadcast(keys.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text", "toxic")


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of each unit and its standard deviation, under Dirichlet priors of total weight `prior`.

    The prior of a unit is in proportion to its pooled frequency, and at least half a count.
    """
    alpha = np.maximum(0.5, prior * (toxic + clean) / (n_toxic + n_clean))
    a, b = toxic + alpha, clean + alpha
    ratio = np.log(a / (n_toxic + prior - a)) - np.log(b / (n_clean + prior - b))
    return ratio, np.sqrt(1 / a + 1 / b)


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; scores have a negative mean and a positive maximum."""
    p = weights / weights.sum()

    def f(x: float) -> float:
        return float(np.log((p * np.exp(x * scores - (m := max(0.0, x * scores.max())))).sum()) + m)

    low, high = 0.0, 1.0
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def calibrate(scores: np.ndarray, weights: np.ndarray, length: int = 2000, texts: int = 200) -> tuple[float, float]:
    """(lambda, K) of the extreme-value law of the best segment of text with these token scores.

    K is the least value that covers the maxima of `texts` random texts of `length` tokens: the mean of
    exp(lambda * maximum) over a Gumbel sample diverges, so its location is taken from the median instead, and is
    not let under the bound for isolated hits, whose count is the frequency of positive tokens.
    """
    lam = karlin_lambda(scores, weights)
    p = weights / weights.sum()
    rng = np.random.default_rng(0)
    draws = scores[rng.choice(len(scores), (texts, length), p=p)]
    sums = np.concatenate([np.zeros((texts, 1)), np.cumsum(draws, axis=1)], axis=1)
    best = (sums - np.minimum.accumulate(sums, axis=1)).max(axis=1)
    k = math.log(2) * math.exp(min(700.0, lam * float(np.median(best)))) / length
    up = scores > 0
    isolated = float((p[up] * np.exp(lam * scores[up])).max()) if up.any() else 1.0
    return lam, max(min(k, 1.0), isolated)


def train(docs: DataFrame, labels: DataFrame, sample: int = 40_000, prior: float = 2_000.0, least: int = 5, z: float = 1.5, drift: float = 0.1, weak: float = 0.7) -> ToxicModel:
    """Token scores from labelled documents.

    sample: at most about so many labelled documents are learned from, half of each class, those whose hash of doc_id comes
    first; the bound is on the training of a classifier only.  prior: weight of the Dirichlet prior in counts.  least:
    a unit with fewer counts backs off to a shorter stem.  z: standard deviations of the confidence bound.
    weak: what a word says of toxicity counts from this score on, so that the many words that lean a little that way, such
    as those of the language of some toxic documents, don't add up to a passage.
    """
    with scratch():  # the model is all that stays
        marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
        marks = marks.withColumn("order", F.xxhash64("doc_id"))
        halves = [marks.where("toxic" if c else "not toxic").orderBy("order", "doc_id").limit(sample // 2) for c in (1, 0)]
        # at most `sample` rows of two numbers: small by the bound, whatever the size of the labels
        sampled = F.broadcast(halves[0].union(halves[1]).select("doc_id", "toxic"))
        known = written(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sampled, "doc_id"), "labelled")
        lone = written(_without_copies(known).select("text", "toxic", F.expr("pmod(xxhash64(doc_id, 1), 2)").cast("int").alias("fold")), "lone")
        counts = _unit_counts(lone, least).toArrow()
        stem, unit = counts["stem"].to_numpy(), counts["unit"].to_numpy().view(np.uint64)
        t0, c0, t1, c1 = (counts[c].to_numpy() for c in ("t0", "c0", "t1", "c1"))
        model = _scored(stem, unit, t0 + t1, c0 + c1, prior, least, z, drift, weak)
        if not model.known:
            return model
        halves = [_scored(stem, unit, t1, c1, prior, least, z, drift, weak), _scored(stem, unit, t0, c0, prior, least, z, drift, weak)]
        seen = _clean_scores(lone, halves).toArrow()
        scores, weights = seen["score"].to_numpy(), seen["n"].to_numpy().astype(float)
        # a hit of the best score that has not been seen yet counts half
        top = float(max(s.max() for s in model.scores if len(s))) - drift
        scores, weights = np.append(scores, top), np.append(weights, 0.5)
        if not (scores < 0).any():
            return model
        lam, k = calibrate(scores, weights)
        return ToxicModel(model.keys, model.scores, drift, lam, k)


def _scored(stem: np.ndarray, unit: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float, least: int, z: float, drift: float, weak: float) -> ToxicModel:
    """The model of these counts, not yet calibrated."""
    n_toxic, n_clean = toxic[stem == 0].sum(), clean[stem == 0].sum()
    keys, scores = [], []
    for s in STEMS:
        mine = np.flatnonzero((stem == s) & (toxic + clean >= least)) if n_toxic and n_clean else np.zeros(0, np.int64)
        mine = mine[np.argsort(unit[mine])]
        ratio, sd = log_odds(toxic[mine], clean[mine], max(n_toxic, 1.0), max(n_clean, 1.0), prior)
        sure = np.maximum(ratio - z * sd, 0.0) + np.maximum(np.minimum(ratio + z * sd, 0.0), -1.0)
        sure[(sure > 0) & (sure < weak)] = 0.0
        if s:  # a stem says only that a word is toxic
            mine, sure = mine[sure > 0], sure[sure > 0]
        keys.append(unit[mine])
        scores.append(sure)
    return ToxicModel(tuple(keys), tuple(scores), drift, 1.0, 1.0)


def _clean_scores(lone: DataFrame, halves: list[ToxicModel], step: float = 0.02) -> DataFrame:
    """(score, n): how often the tokens of clean documents have each score, by the model that has not seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for first, last, data, at in blocks(batch.column(0)):
                words = Words(data, at)
                half = fold[first:last][words.row]
                both = np.where(half == 0, halves[0].token_scores(words), halves[1].token_scores(words))
                steps, n = np.unique(np.round(both / step).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(steps * step), pa.array(n)], ["score", "n"])

    return lone.where("not toxic").select("text", "fold").mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))


def _find(words: Words, model: ToxicModel, most: float) -> Iterator[tuple[int, int, int, int, float, float]]:
    """(text, first word, past the last word, words of the text, score, E) of the significant segments of a block."""
    scores = model.token_scores(words)
    for t in np.unique(words.row[scores > 0]):
        a, b = words.of[t], words.of[t + 1]
        for first, end, score in segments(scores[a:b]):
            e = model.expected(score, b - a)
            if e <= most:
                yield int(t), int(first), int(end), int(b - a), float(score), e


PASSAGES = "doc_id long, first_word int, end_word int, n_words int, score double, e_value double, passage string"


def toxic_passages(docs: DataFrame, model: ToxicModel, expected: float = 0.005) -> DataFrame:
    """Every significant toxic passage: its words from first_word up to end_word, its score and its text.

    e_value is the number of such passages that clean text of the same length has by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw = batch.column(1)
            for first, _, data, at in blocks(raw):
                words = Words(data, at)
                rows = list(_find(words, model, expected))
                if not rows:
                    continue
                text, a, b, n, score, e = zip(*rows)
                spans = [(words.start[words.of[t] + i], words.end[words.of[t] + j - 1]) for t, i, j in zip(text, a, b)]
                said = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in spans]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([first + t for t in text])), *(pa.array(x, pa.int32()) for x in (a, b, n)), pa.array(score), pa.array(e), pa.array(said)],
                    ["doc_id", "first_word", "end_word", "n_words", "score", "e_value", "passage"],
                )

    if not model.known:
        return docs.sparkSession.createDataFrame([], PASSAGES)
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PASSAGES)


def is_toxic(model: ToxicModel, expected: float = 0.005):
    """A column function of a text: whether it has a significant toxic passage; null and empty texts have none."""

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for first, _, data, at in blocks(text):
            for row in _find(Words(data, at), model, expected):
                out[first + row[0]] = True
        return pa.array(out)

    return toxic


def reject_toxic(docs: DataFrame, labels: DataFrame, expected: float = 0.005, **how) -> DataFrame:
    """The documents without those that have a significant toxic passage; the model is learned from `labels`."""
    model = train(docs, labels, **how)
    return docs.where(~is_toxic(model, expected)("text")) if model.known else docs
