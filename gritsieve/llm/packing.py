"""Best-fit packing by a configuration linear program.

Documents are cut into pieces of at most `capacity` tokens of a public byte-level vocabulary: full pieces, each a bin of its own, and a
remainder.  The remainders are counted in classes: exact lengths up to 128 units, and steps of less than a hundredth of the
length beyond; a unit is a token, or a 2048th of a larger capacity.  A *configuration* says how many remainders of each class lie
together in a bin.  The linear program asks for the fewest bins (fractions allowed) whose configurations cover the
counts.  Multiplicative weights solve it: every class has a price that falls as the class is covered, a knapsack
dynamic program finds the configuration that is worth most at these prices, and that one is used until some class has
been covered by a further fixed share.  Prices also give a lower bound on the bins of any packing of the
classes, and so do the volumes beside large items.

Rounding takes each configuration the whole number of times that the counts allow; what is left is packed largest first, always
with the largest remainder that still fits.  The loop rounds now and then, and ends once the rounded packing is within `gap`, and one bin,
of the lower bound; after `rounds` rounds it warns that it hasn't come so far, and takes the best packing seen.  All this works on counts,
whose size doesn't depend on the number of documents.  Documents then find their place by their rank within their
class; ranks are taken within hash buckets and shifted by the counts of the buckets before, so no sort is global.

Defined results: documents without tokens (null, empty or blank text) have no piece.  Repeated rows are packed as often
as they occur, equal lengths in the order of doc_id.  Rows with a null doc_id are packed.  A very long text fills bins of its own
up to its remainder.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm import tokenizers
from gritsieve.llm.shared import small_batches, written
from gritsieve.llm.token_files import token_count, tokenized

CAPACITY, BUCKETS = 2048, 256


def unit_of(capacity: int) -> int:
    """Tokens to a unit of the dynamic program."""
    return -(-capacity // 2048)


def length_class(tokens: Column, capacity: int) -> Column:
    """The class of a remainder, a number of units not under its length and at most the whole capacity."""
    units = F.ceil(tokens / unit_of(capacity)).cast("int")
    step = F.when(units <= 128, F.lit(1)).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.greatest(units - 1, F.lit(1)))) - 6).cast("int"))
    return F.least(F.ceil(units / step).cast("int") * step, F.lit(capacity // unit_of(capacity)))


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the prices sum highest within the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    reach = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        k = reach[c]
        values = best[c - sizes[:k]] + prices[:k]
        i = int(values.argmax())
        if values[i] > best[c - 1] + 1e-15:
            best[c], pick[c] = values[i], i
        else:
            best[c] = best[c - 1]
    out = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return out


def volume_bound(sizes: np.ndarray, n: np.ndarray, capacity: int) -> float:
    """A lower bound on the bins: items over half a bin need one each, and what small ones have to find in them or elsewhere is their volume."""
    best = float((sizes * n).sum() / capacity)
    for k in [0, *sizes[2 * sizes <= capacity].tolist()]:
        alone, large, small = sizes > capacity - k, (2 * sizes > capacity) & (sizes <= capacity - k), (2 * sizes <= capacity) & (sizes >= k)
        over = float((sizes * n)[small].sum() - (capacity * n[large].sum() - (sizes * n)[large].sum()))
        best = max(best, float(n[alone].sum() + n[large].sum()) + max(0.0, over) / capacity)
    return best


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.02, step: float = 0.05, rounds: int = 3000, every: int = 64) -> tuple[list[tuple[np.ndarray, int]], float, bool]:
    """(configurations with their number of bins, lower bound on the bins, whether the gap is met) for `counts` items of `sizes`, ascending."""
    n = counts.astype(float)
    covered = np.zeros(len(sizes))
    rate = 25 * np.log(len(sizes) + 1)
    used: dict[bytes, float] = {}
    bound, best = volume_bound(sizes, n, capacity), None
    for i in range(1, rounds + 1):
        price = np.exp(-rate * (covered - covered.min())) / n
        config = best_configuration(price, sizes, capacity)
        worth = float((price * config).sum())
        bound = max(bound, float((price * n).sum()) / worth)
        has = config > 0
        times = step * float((n[has] / config[has]).min())
        covered += times * config / n
        used[config.tobytes()] = used.get(config.tobytes(), 0.0) + times
        low = float(covered.min())
        if low > 0 and (i % every == 0 or i == rounds):
            solution = sorted(((np.frombuffer(c, np.int64), x / low) for c, x in used.items()), key=lambda e: (-e[1], e[0].tobytes()))
            made = rounded(sizes, counts, capacity, solution)
            bins = sum(k for _, k in made)
            if best is None or bins < best[0]:
                best = bins, made
            if best[0] <= (1 + gap) * bound + 1:
                return best[1], bound, True
    return best[1] if best else rounded(sizes, counts, capacity, []), bound, False


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int, solution: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """(configuration, number of bins) that hold exactly `counts` items."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def take(config: np.ndarray, most: int) -> None:
        has = config > 0
        k = min(most, int((left[has] // config[has]).min()))
        if k > 0:
            left[has] -= k * config[has]
            out.append((config.copy(), k))

    for config, x in solution:
        take(config, int(x))
    while left.any():
        room, config = capacity, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):  # the largest that fits, again and again
            fits = min(int(left[i]), room // int(sizes[i]))
            config[i] = fits
            room -= fits * int(sizes[i])
            if not room:
                break
        take(config, int(left.max()))
    return out


@dataclass(frozen=True)
class Plan:
    """Where the item of a rank in a class goes: runs of ranks, sorted by class and first rank."""

    key: np.ndarray  # class << 44 | first rank
    first_rank: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    first_place: np.ndarray
    bins: int
    bound: float
    met: bool

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, place within it)."""
        at = np.searchsorted(self.key, (classes.astype(np.int64) << 44) | ranks, "right") - 1
        inner = ranks - self.first_rank[at]
        return self.first_bin[at] + inner // self.per_bin[at], self.first_place[at] + inner % self.per_bin[at]


def plan(counts: dict[int, int], capacity: int, **how) -> Plan:
    """The packing of `counts` items by class; a class is a number of units, at most `capacity` units."""
    present = sorted(c for c, k in counts.items() if k > 0 and c > 0)
    empty = np.zeros(0, np.int64)
    if not present:
        return Plan(empty, empty, empty, empty, empty, 0, 0.0, True)
    sizes, n = np.array(present, np.int64), np.array([counts[c] for c in present], np.int64)
    made, bound, met = solve(sizes, n, capacity, **how)
    if not met:
        warnings.warn(f"packing: {sum(k for _, k in made)} bins aren't within the gap of the bound of {bound:.1f}", stacklevel=2)
    runs, next_rank, bins = [], np.zeros(len(sizes), np.int64), 0
    for config, k in made:
        placed = 0
        for i in np.flatnonzero(config)[::-1]:
            runs.append((int(sizes[i]) << 44 | int(next_rank[i]), int(next_rank[i]), bins, int(config[i]), placed))
            next_rank[i] += k * config[i]
            placed += int(config[i])
        bins += k
    return Plan(*(np.array(c, np.int64) for c in zip(*sorted(runs))), bins, bound, met)


def packed(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None, buckets: int = BUCKETS, folder: str = tokenizers.FOLDER, **how) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin, place) for every piece of every document.

    tokens: of a document, those of the byte-level vocabulary in `folder` if None.  A capacity over 2048 must be a multiple of its unit.
    """
    unit = unit_of(capacity)
    if capacity % unit:
        raise ValueError(f"the capacity must be a multiple of {unit}")
    n = (token_count(folder)("text") if tokens is None else tokens).cast("long")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).where("n > 0")
    rows = written(rows, "lengths").select("doc_id", "n", F.expr(f"n div {capacity} as full"), length_class(F.col("n") % capacity, capacity).alias("class"), F.expr(f"cast(pmod(xxhash64(doc_id, n), {buckets}) as int) as bucket"))
    # at most (classes + 1) * buckets rows, some 100,000, whatever the number of documents
    sums = written(rows.groupBy("class", "bucket").agg(F.count("*").alias("rows"), F.sum("full").alias("fulls")), "counts")
    counts = {r[0]: r[1] for r in sums.groupBy("class").agg(F.sum("rows")).collect()}
    p = plan(counts, capacity // unit, **how)
    before = sums.select("class", "bucket", (F.sum("rows").over(W.partitionBy("class").orderBy("bucket")) - F.col("rows")).alias("rows_before"))
    rest = rows.where("class > 0").withColumn("rank", F.row_number().over(W.partitionBy("class", "bucket").orderBy("doc_id", "n")) - 1)
    rest = rest.join(F.broadcast(before), ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("rows_before"))

    @F.arrow_udf("bin long, place int")
    def place(classes: pa.Array, ranks: pa.Array) -> pa.Array:
        bins, at = p.place(classes.to_numpy(), ranks.to_numpy())
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(at.astype(np.int32))], ["bin", "place"])

    rest = rest.withColumn("at", place("class", "rank")).selectExpr("doc_id", "full as piece", f"full * {capacity} as first_token", f"n % {capacity} as n_tokens", "at.bin", "at.place")
    fulls_before = sums.groupBy("bucket").agg(F.sum("fulls").alias("fulls")).select("bucket", (F.sum("fulls").over(W.orderBy("bucket")) - F.col("fulls") + p.bins).alias("bin_before"))
    own = rows.where("full > 0").withColumn("upto", F.sum("full").over(W.partitionBy("bucket").orderBy("doc_id", "n").rowsBetween(W.unboundedPreceding, 0)))
    own = own.join(F.broadcast(fulls_before), "bucket").select("doc_id", F.expr("upto - full + bin_before").alias("first_bin"), F.explode(F.expr("sequence(0L, full - 1)")).alias("piece"))
    own = own.selectExpr("doc_id", "piece", f"piece * {capacity} as first_token", f"cast({capacity} as long) as n_tokens", "first_bin + piece as bin", "0 as place")
    return rest.union(own)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, folder: str = tokenizers.FOLDER, **how) -> DataFrame:
    """(bin, token_ids, pieces): the training sequences; pieces: array of (doc_id, piece, start, n_tokens) in the order of their places.

    A bin has at most `capacity` tokens, so its group is bounded.  Rows of one doc_id and number of tokens are taken to have one text.
    """
    made = tokenized(docs, folder).where("n_tokens > 0")
    ids = written(made.withColumnRenamed("n_tokens", "total").dropDuplicates(["doc_id", "total"]), "token-ids")
    pieces = packed(docs, capacity, folder=folder, **how).withColumn("_doc", F.col("doc_id"))
    # documents that come with several lengths keep apart by the length of their last piece
    whole = ids.select(F.col("doc_id").alias("_id"), "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {capacity})")).alias("_piece"), "token_ids")
    whole = whole.select("_id", "_piece", F.expr(f"least({capacity}, total - _piece * {capacity})").cast("long").alias("_n"), F.expr(f"slice(token_ids, cast(_piece * {capacity} + 1 as int), {capacity})").alias("_tokens")).dropDuplicates(["_id", "_piece", "_n"])
    both = pieces.join(whole, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")) & (F.col("n_tokens") == F.col("_n")))
    placed = both.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "piece", "n_tokens", "_tokens"))).alias("x"))
    starts = F.expr("transform(x, (p, i) -> struct(p.doc_id as doc_id, p.piece as piece, cast(aggregate(slice(x, 1, i), 0L, (s, q) -> s + q.n_tokens) as int) as start, cast(p.n_tokens as int) as n_tokens))")
    return placed.select("bin", F.flatten(F.col("x._tokens")).alias("token_ids"), starts.alias("pieces"))
