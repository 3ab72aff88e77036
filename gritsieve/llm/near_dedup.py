"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's signature has `coordinates` minima over the hashes of its runs of `shingle` words.  Documents are
posted under (coordinate, value) pairs; two documents match if they agree in at least `ceil(threshold *
coordinates)` = t coordinates.  Equal signatures form one *node*, which is compared once for all of its documents.

*Prefix merging.*  Order all (coordinate, value) pairs by how many nodes bear them, rarest first.  Two nodes that
agree in t of k coordinates share at least one of the first k - t + 1 pairs of either, whatever the order, so only
those prefixes are posted.  Pairs borne by one node alone produce no candidate; a node with m pairs borne by others
needs only its m - t + 1 rarest of those posted, and none if m < t.  Pairs that come from passages common to many
documents are the last in this order and hardly ever posted.  Nothing is capped.

*Long lists.*  A posting list of more than BLOCK nodes is cut into salted parts; every two parts meet in a block of
their own, so that no task holds more than two parts, however long the list, and no pair is lost.

*Skip merging.*  Two nodes may meet in several lists.  `near_classes` counts a pair only in the list of the lowest
coordinate that both have in their prefixes, and skips it in the others: each matching pair counts exactly once, and no list of
pairs is ever written.  `near_groups`, which is enough to remove duplicates, skips a candidate pair that is joined already
through earlier members of its block, so that n copies cost in the order of n comparisons; its connected parts are those of
all matching pairs.

Defined results: a text without a word (null, empty, only punctuation) has no signature and is never a duplicate.
Rows with a null doc_id are not compared, and `near_dedup` keeps them.  Repeated rows with the same doc_id are one
document; `near_dedup` keeps one of them.  A doc_id that comes with several texts has the links of each of them, summed,
and joins their classes.  Classes are named after their lowest doc_id, so ties can't arise.  A very long text has a signature
like any other.  Extra columns are carried through unchanged whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.blocks import Words, blocks, mix, shingles
from gritsieve.llm.shared import discard, scratch, small_batches, unused, written

COORDINATES, SHINGLE, THRESHOLD = 64, 3, 0.45
BLOCK, SMALL = 4096, 48
"""Nodes of a posting list that meet in one block at most (twice as many where two parts meet); lists up to SMALL are compared many at once."""
BROADCAST_IDS = 2_000_000
"""Lists of up to so many ids are sent to all executors (16 MB); longer ones are joined by a shuffle of the documents."""


def needed(threshold: float, coordinates: int) -> int:
    return max(1, math.ceil(threshold * coordinates - 1e-9))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:k] | np.uint64(1), seeds[k:]


def signatures_of(data: np.ndarray, at: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have a word, their signatures) of a block of texts."""
    values, of = shingles(Words(data, at), n)
    has = np.flatnonzero(np.diff(of) > 0)
    out = np.empty((len(has), k), np.uint32)
    if len(has):
        a, b = _coefficients(k)
        starts = of[:-1][has]
        for i in range(k):
            out[:, i] = np.minimum.reduceat(((values * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return has, out


def signatures(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig, hi, lo): the signature as bytes and two hashes of it, for each text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, at in blocks(batch.column(1)):
                has, sig = signatures_of(data, at, coordinates, shingle)
                if not len(has):
                    continue
                wide = sig.astype(np.uint64)
                hashes = [mix((mix(wide + np.uint64(j)) * weights[j]).sum(axis=1)).view(np.int64) for j in (0, 1)]
                size = 4 * coordinates
                ends = pa.py_buffer(np.arange(0, size * (len(has) + 1), size, dtype=np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(has), [None, ends, pa.py_buffer(np.ascontiguousarray(sig))])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(has + first)), packed, *map(pa.array, hashes)], ["doc_id", "sig", "hi", "lo"])

    narrow = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(run, "doc_id long, sig binary, hi long, lo long")


def _keys(reps: DataFrame, k: int) -> DataFrame:
    """(doc_id, key) for all coordinates; key holds the coordinate and the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first in range(0, len(ids), 2000):
                part = batch.column(1).slice(first, 2000)
                sig = np.frombuffer(b"".join(part.to_pylist()), np.uint32).reshape(-1, k)
                keys = (np.arange(k, dtype=np.int64) << 32) | sig.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first : first + 2000], k)), pa.array(keys.ravel())], ["doc_id", "key"])

    return reps.select("doc_id", "sig").mapInArrow(run, "doc_id long, key long")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest of the numbers below n that each is connected with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label[i] == label[j]).all() and (label == label[label]).all():
            break
    return label


def _small_pairs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each of the runs of rows between bounds."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    later = ends - np.arange(len(ends)) - 1
    i = np.repeat(np.arange(len(ends)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    return i, j


def _small_matches(sig: np.ndarray, mask: np.ndarray, coordinate: np.ndarray, bounds: np.ndarray, t: int, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The matching pairs of many short lists at once; with first_only, those that share no prefix of a lower coordinate."""
    i, j = _small_pairs(bounds)
    bits = np.uint64(1) << np.arange(sig.shape[1], dtype=np.uint64)
    kept = []
    for at in range(0, len(i), 8192):
        a, b = i[at : at + 8192], j[at : at + 8192]
        same = sig[a] == sig[b]
        hit = np.flatnonzero(same.sum(axis=1) >= t)
        if first_only and len(hit):
            both = np.where(same[hit], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64) & mask[a[hit]] & mask[b[hit]]
            hit = hit[(both & ((np.uint64(1) << coordinate[a[hit]].astype(np.uint64)) - np.uint64(1))) == 0]
        kept.append(hit + at)
    hits = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[hits], j[hits]


def _block_matches(sig: np.ndarray, mask: np.ndarray, coordinate: int, left: np.ndarray, right: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matching pairs of one from left and a later one, or any, from right, that share no prefix of a lower coordinate."""
    k, whole = sig.shape[1], left is right
    value = sig.T.astype(np.int64)
    # a coordinate that isn't in a node's prefix gets a value that nothing else has
    bit = (mask[None, :] >> np.arange(k, dtype=np.uint64)[:, None]) & np.uint64(1)
    own = np.where(bit > 0, value, (np.int64(1) << 40) + np.arange(sig.shape[0]))
    sig_t = np.ascontiguousarray(sig.T)
    for at in range(0, len(left), 64):
        a = left[at : at + 64]
        b = right[at:] if whole else right
        count = np.zeros((len(a), len(b)), np.uint8)
        for c in range(k):
            count += sig_t[c, a][:, None] == sig_t[c, b][None, :]
        hit = count >= t
        if whole:
            hit &= np.arange(len(b))[None, :] > np.arange(len(a))[:, None]
        if not hit.any():
            continue
        for c in range(coordinate):
            if bit[c, a].any():
                hit &= own[c, a][:, None] != own[c, b][None, :]
        x, y = np.nonzero(hit)
        yield a[x], b[y]


def _block_parts(sig: np.ndarray, left: np.ndarray, right: np.ndarray, t: int) -> np.ndarray:
    """The part that each row is connected with by matching pairs, leaving out comparisons within a part."""
    whole = left is right
    part = np.arange(len(sig))
    for x, i in enumerate(left):
        others, at, step = right[x + 1 :] if whole else right, 0, 64
        while at < len(others):
            j = others[at : at + step]
            at, step = at + step, min(4 * step, 4096)
            j = j[part[j] != part[i]]
            if len(j):
                for p in np.unique(part[j[(sig[j] == sig[i]).sum(axis=1) >= t]]):
                    part[part == p] = part[i]
        if x % 64 == 0 and (part == part[0]).all():
            break
    return part


_FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _verify(postings: DataFrame, k: int, t: int, counted: bool) -> DataFrame:
    """(node, root, links) of the nodes that match any in their block; root is connected with node.

    postings: (key, part_a, part_b, side, node, size, mask, sig), a block's rows lying together.  links: documents of the
    matching nodes that count here (see above), 0 unless counted.
    """

    def of_small(rows: list[tuple]) -> pa.RecordBatch | None:
        sizes = [len(r[1]) for r in rows]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        node, size, mask, sig = (np.concatenate([r[c] for r in rows]) for c in (1, 2, 3, 4))
        coordinate = np.repeat([r[0] for r in rows], sizes)
        i, j = _small_matches(sig, mask, coordinate, bounds, t, counted)
        links = np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node)) if counted else np.zeros(len(node))
        return batch_of(node, _labels(len(node), i, j), links, np.union1d(i, j))

    def of_block(coordinate: int, node, size, mask, sig, side) -> pa.RecordBatch | None:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if (side == 2).all():
            right = left
        if not counted:
            part = _block_parts(sig, left, right, t)
            return batch_of(node, part, np.zeros(len(node)), np.flatnonzero(np.bincount(part, minlength=len(node))[part] > 1))
        links, label, met = np.zeros(len(node)), np.arange(len(node)), np.zeros(len(node), bool)
        for i, j in _block_matches(sig, mask, coordinate, left, right, t):
            links += np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node))
            label = _labels(len(node), np.concatenate([i, np.arange(len(node))]), np.concatenate([j, label]))
            met[i] = met[j] = True
        return batch_of(node, label, links, np.flatnonzero(met))

    def batch_of(node, label, links, which) -> pa.RecordBatch | None:
        if not len(which):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[which]), pa.array(node[label[which]]), pa.array(np.round(links[which]).astype(np.int64))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists():
            held: list[tuple] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, a, b, side, node, size, mask = (batch.column(i).to_numpy() for i in range(7))
                sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint32).reshape(-1, k)
                cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
                bounds = [0, *cut.tolist(), len(key)]
                for p, q in zip(bounds, bounds[1:]):
                    rows = ((key[p], a[p], b[p]), side[p:q], node[p:q], size[p:q], mask[p:q].view(np.uint64), sig[p:q])
                    if held and held[0][0] != rows[0]:
                        yield held
                        held = []
                    held.append(rows)
            if held:
                yield held

        small, waiting = [], 0
        for parts in lists():
            side, node, size, mask, sig = (parts[0][c] if len(parts) == 1 else np.concatenate([x[c] for x in parts]) for c in range(1, 6))
            coordinate = int(parts[0][0][0]) >> 32
            if len(node) < 2:
                continue
            if len(node) > SMALL or side[0] != 2:
                if (out := of_block(coordinate, node, size, mask, sig, side)) is not None:
                    yield out
                continue
            small.append((coordinate, node, size, mask, sig))
            waiting += len(node)
            if waiting > 8192:
                if (out := of_small(small)) is not None:
                    yield out
                small, waiting = [], 0
        if small and (out := of_small(small)) is not None:
            yield out

    return postings.mapInArrow(run, "node long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) for each end of an edge (doc_a, doc_b); group_id is the lowest id of its connected part.

    Alternates the large-star and small-star steps, which need a number of rounds in the order of the logarithm
    of the number of ids.  Each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v"))
        if large:
            both = both.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    e = written(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct(), "edges")
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(e)
    while seen[0]:
        last, e = e, written(star(star(e, True), False), "star")
        discard(last)
        now = print_of(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(e.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id"))).distinct()


def _borne(keys: DataFrame) -> DataFrame:
    """keys with `n`, the number of rows of their key, without those that stand alone.

    Counts are aggregated before they are shuffled and then joined, so that a key of very many rows is split between
    tasks by the skew handling of the join.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(counts, "key")


def _matches(nodes: DataFrame, k: int, t: int, counted: bool, block: int) -> DataFrame:
    """(node, root, links) by blocks of posting lists; see `_verify`."""
    borne = _borne(_keys(nodes.selectExpr("node as doc_id", "sig"), k).withColumnRenamed("doc_id", "node"))
    prefix = (
        borne.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
        .where(F.size("keys") >= t)
        .select("node", F.expr(f"transform(slice(keys, 1, size(keys) - {t - 1}), x -> x.key)").alias("keys"))
        .select("node", F.expr("aggregate(keys, 0L, (m, x) -> m | shiftleft(1L, cast(shiftright(x, 32) as int)))").alias("mask"), F.explode("keys").alias("key"))
    )
    posted = _borne(written(prefix, "prefixes"))
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    posted = posted.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    posted = posted.select("key", F.least("mine", "other").alias("part_a"), F.greatest("mine", "other").alias("part_b"), F.expr("case when mine = other then 2 when mine < other then 0 else 1 end").alias("side"), "node", "mask")
    rows = posted.join(nodes.select("node", "size", "sig"), "node").select("key", "part_a", "part_b", "side", "node", "size", "mask", "sig")
    return _verify(rows.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b", "node"), k, t, counted)


def _classes(docs: DataFrame, counted: bool, coordinates: int = COORDINATES, shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links) of every document that has a partner."""
    k, t = coordinates, needed(threshold, coordinates)
    if not 1 <= k <= 64:
        raise ValueError("1 to 64 coordinates")
    with scratch() as keep:
        sigs = written(signatures(docs, k, shingle), "signatures")
        once = written(sigs.select("doc_id", "hi", "lo").distinct(), "members")
        reps = once.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"))
        # one row for each signature; its number is written once, so that it stays the same whatever is read again
        nodes = written(sigs.join(reps, ["hi", "lo", "doc_id"]).dropDuplicates(["hi", "lo"]).select(F.monotonically_increasing_id().alias("node"), "hi", "lo", F.col("doc_id").alias("rep"), "size", "sig"), "nodes")
        discard(sigs)
        found = written(_matches(nodes, k, t, counted, block), "found")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        members = written(once.join(nodes.select("hi", "lo", "node", "rep", "size"), ["hi", "lo"]).select("doc_id", "node", "rep", "size"), "members")
        discard(once)
        # a document with several texts ties their nodes together
        several = members.groupBy("doc_id").agg(F.min("node").alias("doc_a"), F.collect_set("node").alias("all")).where("size(all) > 1").select("doc_a", F.explode("all").alias("doc_b"))
        groups = components(found.selectExpr("node as doc_a", "root as doc_b").union(several))
        names = groups.join(nodes.select(F.col("node").alias("doc_id"), "rep"), "doc_id")
        least = names.groupBy("group_id").agg(F.min("rep").alias("class_id"))
        named = names.join(least, "group_id").select(F.col("doc_id").alias("node"), "class_id")
        both = members.join(named, "node", "left").join(links, "node", "left")
        both = both.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
        out = written(both.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")), "classes")
        keep(out)
        return out


def near_classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, links) of every document that has a near-duplicate.

    class_id: the lowest doc_id that it is connected with.  links: how many other documents agree with it in enough coordinates;
    those of equal texts count, each of them.  how: coordinates, shingle, threshold, block.
    """
    return _classes(docs, True, **how).where("links > 0")


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id) of every document that isn't the lowest doc_id of its class; options as in `near_classes`."""
    return _classes(docs, False, **how).where("doc_id != class_id").select("doc_id", "class_id")


def _sent_if_short(ids: DataFrame) -> DataFrame:
    """A written list of ids, to be broadcast if it is short: then no text has to be shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but the lowest doc_id of each class."""
    gone_id, twice_id, place = unused(docs, "gone", "twice", "place")
    gone = _sent_if_short(written(near_groups(docs, **how).select(F.col("doc_id").alias(gone_id)), "gone"))
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice_id)).agg(F.count("*").alias("n")).where("n > 1").select(twice_id)
    twice = _sent_if_short(written(twice, "twice"))
    left = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    once = left.join(twice, left["doc_id"] == twice[twice_id], "left_anti")
    again = left.join(twice, left["doc_id"] == twice[twice_id], "left_semi")
    # of the rows of one doc_id, the least text stays; JSON orders the other columns whatever their types
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.to_json(F.struct(*(F.col(f"`{c}`") for c in again.columns))))
    first = again.select("*", F.row_number().over(order).alias(place)).where(F.col(place) == 1).drop(place)
    return once.union(first)
