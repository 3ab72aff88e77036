"""Most similar sets of words among many, exactly, without posting whole texts or writing out pairs of them.

Rows of equal sets are one node.  Nodes meet by the rare words that a pair at or above the threshold must share: the
prefixes of both, in one order of all words, so posted that a task holds all postings of its share of the words.  There a pair
must also fit by length, by the places of the shared word, and by the parity bits of both sets, which bound how many
words they can share.  What is left is counted in full, where each set of words goes to once for all partners that lie alike.
Every step loses no pair at or above the threshold; those that it lets through in vain are dropped by the count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.sources.tables import kept

TEXT, REF = 1, 2
CELLS, STRIPES = 1 << 20, 16
SHARES, PLACES, LEAST_BITS, MOST_BITS, ROOM = 16, 48, 256, 8192, 300_000
"""Shares of the words; places where pairs are counted; parity bits of a node; pairs looked at in one step."""
SENT = 2_000_000
"""Keys of up to so many nodes are sent to all executors to pick their texts, which are joined by a shuffle if there are more."""



def _mixed(x: np.ndarray) -> np.ndarray:
    """Other hashes of hashes."""
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _bits(n: np.ndarray) -> np.ndarray:
    """How many parity bits nodes of n words have, as a power of 2."""
    return np.ceil(np.log2(np.clip(n, LEAST_BITS, MOST_BITS))).astype(np.int64)


def _parity(words: np.ndarray, power: int) -> np.ndarray:
    odd = (np.bincount((_mixed(words) & np.uint64((1 << power) - 1)).astype(np.int64), minlength=1 << power) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little")


def _sets(batch: pa.RecordBatch, keyed: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, node, sorted words) of the rows that have words; keyed: texts of equal words aren't the same node unless their keys are."""
    roles = batch.column("role").to_pylist()
    keys = batch.column("key").to_pylist() if keyed else None
    for i, cell in enumerate(batch.column("words")):
        if cell.is_valid and len(cell.values):
            words = np.sort(cell.values.to_numpy(zero_copy_only=False))
            digest = md5(words.tobytes())
            if keyed and roles[i] == TEXT:
                digest.update(keys[i].encode())
            yield i, int.from_bytes(digest.digest()[:8], "little", signed=True), words


def _nodes(rows: DataFrame, keyed: bool) -> DataFrame:
    """(key, ord, role, node) of each row, and (stripe, counts): how many rows of references each task has with words of each cell."""
    schema = pa.schema([("key", pa.string()), ("ord", pa.int64()), ("role", pa.int32()), ("node", pa.int64()), ("stripe", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            roles, at, nodes, words = batch.column("role").to_pylist(), [], [], []
            for i, node, w in _sets(batch, keyed):
                at.append(i)
                nodes.append(node)
                if roles[i] & REF:
                    words.append(w)
            if words:
                cells += np.bincount((_mixed(np.concatenate(words)) >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.int32)
            if at:
                mine = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([mine.column("key"), mine.column("ord"), mine.column("role"), pa.array(nodes, pa.int64()), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], schema=schema)
        if cells.any():
            packed = [zlib.compress(part.tobytes(), 1) for part in cells.reshape(STRIPES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(STRIPES, t) for t in schema.types[:4]] + [pa.array(range(STRIPES), pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "key string, ord long, role int, node long, stripe int, counts binary")


def _frequencies(nodes: DataFrame) -> np.ndarray:
    """Rows of references with a word of each cell; words of one cell count together, which costs time alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)
                sums[stripe] = sums[stripe] + part if stripe in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["stripe", "counts"])

    parts = nodes.where("stripe is not null").select("stripe", "counts").repartitionById(STRIPES, F.col("stripe")).mapInArrow(run, "stripe int, counts binary")
    found = np.zeros((STRIPES, CELLS // STRIPES), np.int64)
    for r in parts.collect():
        found[r.stripe] = np.frombuffer(bytes(r.counts), np.int64)
    return found.reshape(-1)


def _candidates(rows: DataFrame, frequencies: np.ndarray, keyed: bool, threshold: float) -> DataFrame:
    """(place, node, pairs): pairs of nodes that may reach the threshold, up to once in each share of the words, packed; and each node of them by place."""
    share = threshold / (2.0 - threshold)
    sent = rows.sparkSession.sparkContext.broadcast(frequencies)
    posted_schema = pa.schema([("share", pa.int32()), ("node", pa.int64()), ("role", pa.int32()), ("n", pa.int32()), ("home", pa.int32()), ("parity", pa.binary()), ("words", pa.binary()), ("ranks", pa.binary())])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            roles, out = batch.column("role").to_pylist(), []
            for i, node, words in _sets(batch, keyed):
                if (node, roles[i]) in seen:
                    continue
                seen.add((node, roles[i]))
                n, mixed = len(words), _mixed(words)
                df = sent.value[(mixed >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((words, df))[: n - int(np.ceil(n * share - 1e-9)) + 1]
                ranks = np.flatnonzero(df[order] > (1 if roles[i] == TEXT | REF else 0)).astype(np.int32)
                picked = words[order[ranks]]
                if not len(picked):
                    continue
                home, parity = int(mixed.min() % np.uint64(PLACES)), _parity(words, int(_bits(np.array([n]))[0])).tobytes()
                of = (_mixed(picked) >> np.uint64(20)) % np.uint64(SHARES)
                for s in np.unique(of).tolist():
                    out.append((s, node, roles[i], n, home, parity, picked[of == s].tobytes(), (ranks[of == s] + 1).astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), posted_schema.types)], schema=posted_schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        column = lambda name: table[name].to_numpy()
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        nodes, role, n, home = column("node"), column("role"), column("n").astype(np.int64), column("home")
        lengths = np.array([len(x) // 8 for x in table["words"].to_pylist()], np.int64)
        who, word, rank = np.repeat(np.arange(len(nodes)), lengths), joined("words", np.int64), joined("ranks", np.int32).astype(np.int64)
        # parity bits of each power of 2, with those of longer sets that may be partners folded into it
        power, bits, row = _bits(n), {}, {}
        raw = table["parity"].to_pylist()
        for p in np.unique(power).tolist():
            of = [(q, np.flatnonzero(power == q)) for q in range(p, p + 1 + int(np.ceil(np.log2(1 / share))))]
            row[p] = np.full(len(nodes), -1, np.int64)
            row[p][np.concatenate([at for _, at in of])] = np.arange(sum(len(at) for _, at in of))
            wide = [np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint64).reshape(len(at), 1 << (q - p), 1 << (p - 6)) for q, at in of]
            bits[p] = np.concatenate([np.bitwise_xor.reduce(w, axis=1) for w in wide])
        del raw
        order = np.lexsort((n[who], word))
        who, word, rank = who[order], word[order], rank[order]
        group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) if len(word) else word
        size, span = n[who], int(n.max()) * 2 + 2
        # the shorter one of a pair comes first, and the longer one has at most 1 / share times as many words
        key = group * span + size
        ends = np.searchsorted(key, group * span + np.floor(size / share + 1e-9).astype(np.int64), side="right")
        partners = np.where(rank <= size - np.ceil(threshold * size - 1e-9) + 1, ends - np.arange(len(who)) - 1, 0)
        total, found = np.concatenate([[0], np.cumsum(partners)]), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        held, start = 0, 0
        while start < len(who):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + ROOM, side="right")) - 1)
            count = partners[start:stop]
            for low in range(0, int(count.max(initial=0)) if stop == start + 1 else 1, ROOM):  # one word may have more partners than there is room for
                if stop == start + 1:
                    y = np.arange(start + 1 + low, min(start + 1 + low + ROOM, start + 1 + int(count[0])))
                    x = np.full(len(y), start)
                else:
                    x = np.repeat(np.arange(start, stop), count)
                    y = x + 1 + np.arange(len(x)) - np.repeat(total[start:stop] - total[start], count)
                need = np.ceil(threshold * (size[x] + size[y]) / 2 - 1e-9)
                fit = (rank[x] <= size[x] - need + 1) & (rank[y] <= size[y] - need + 1)
                x, y, need = who[x[fit]], who[y[fit]], need[fit]
                fit = (((role[x] & TEXT) & ((role[y] & REF) >> 1)) | (((role[x] & REF) >> 1) & (role[y] & TEXT))).astype(bool) & (nodes[x] != nodes[y])
                x, y, need = x[fit], y[fit], need[fit]
                good = np.zeros(len(x), bool)
                for p in np.unique(power[x]).tolist():
                    at = np.flatnonzero(power[x] == p)
                    apart = np.bitwise_count(bits[p][row[p][x[at]]] ^ bits[p][row[p][y[at]]]).sum(axis=1, dtype=np.int64)
                    good[at] = apart <= n[x[at]] + n[y[at]] - 2 * need[at]
                pending.append(x[good] * len(nodes) + y[good])
                held += len(pending[-1])
                if held > max(8 * ROOM, len(found)):
                    found, pending, held = np.unique(np.concatenate([found, *pending])), [], 0
            start = stop
        found = np.unique(np.concatenate([found, *pending]))
        x, y = np.divmod(found, len(nodes))
        for place in np.unique(home[y]).tolist():
            at = np.flatnonzero(home[y] == place)
            these = nodes[np.unique(np.concatenate([x[at], y[at]]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(these), place, np.int32)), pa.array(these), pa.nulls(len(these), pa.binary())], ["place", "node", "pairs"])
            packed = [zlib.compress(np.stack([nodes[x[some]], nodes[y[some]]]).tobytes(), 1) for some in np.array_split(at, 1 + len(at) // 50_000)]
            yield pa.RecordBatch.from_arrays([pa.array([place] * len(packed), pa.int32()), pa.nulls(len(packed), pa.int64()), pa.array(packed, pa.binary())], ["place", "node", "pairs"])

    posts = rows.mapInArrow(posted, "share int, node long, role int, n int, home int, parity binary, words binary, ranks binary")
    return posts.repartitionById(SHARES, F.col("share")).mapInArrow(met, "place int, node long, pairs binary")


def _counted(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, score, ord, license): the best of each text node's partners at each place.

    sets: (place, node, words, role, own, refs), refs being the lowest (ord, key) of the node's references, up to two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: dict[int, tuple] = {}
        parts: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                c = {name: batch.column(name) for name in batch.schema.names}
                parts += [np.frombuffer(zlib.decompress(x), np.int64).reshape(2, -1).T for x in c["pairs"].to_pylist() if x is not None]
                for i in np.flatnonzero(c["pairs"].is_null().to_numpy(zero_copy_only=False)).tolist():
                    about.setdefault(c["node"][i].as_py(), (np.frombuffer(c["words"][i].as_py(), np.int64), c["role"][i].as_py(), c["own"][i].as_py(), c["refs"][i].as_py() or []))
        if not parts:
            return
        ids = list(about)
        known = np.array(ids, np.int64)
        rank = np.argsort(known)
        ordered = known[rank]
        packed = np.unique(np.concatenate([rank[np.searchsorted(ordered, p[:, 0])] * len(ids) + rank[np.searchsorted(ordered, p[:, 1])] for p in parts]))
        x, y = np.divmod(packed, len(ids))
        packed = np.sort(np.concatenate([packed, y * len(ids) + x]))
        one, other = np.divmod(packed, len(ids))
        flat = np.concatenate([about[i][0] for i in ids])
        sizes = np.array([len(about[i][0]) for i in ids], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        vocabulary, words = np.unique(flat, return_inverse=True)
        mark, out = np.zeros(len(vocabulary), bool), []
        firsts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        for lo, hi in zip(firsts, [*firsts[1:], len(one)]):
            me, others = int(one[lo]), other[lo:hi]
            node = ids[me]
            if not about[node][1] & TEXT:
                continue
            own = about[node][2]
            mine = words[begins[me] : begins[me + 1]]
            mark[mine] = True
            best: tuple[float, int, str] | None = None
            for k in range(0, len(others), 4096):
                some = others[k : k + 4096]
                count, ends = sizes[some], np.cumsum(sizes[some])
                places = np.arange(ends[-1]) + np.repeat(begins[some] - (ends - count), count)
                score = (2.0 * np.add.reduceat(mark[words[places]], ends - count, dtype=np.int64)) / (len(mine) + count)
                # best first, so that few are looked at one by one
                good = np.flatnonzero(score >= max(threshold, best[0] if best else 0))
                for j in good[np.argsort(-score[good], kind="stable")].tolist():
                    if best and score[j] < best[0]:
                        break
                    x = about[ids[some[j]]]
                    ref = next(((r["ord"], r["key"]) for r in x[3] if own is None or r["key"] != own), None) if x[1] & REF else None
                    if ref and (best is None or (score[j], -ref[0]) > (best[0], -best[1])):
                        best = (float(score[j]), *ref)
            mark[mine] = False
            if best:
                out.append((node, *best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64(), pa.string()))], ["node", "score", "ord", "license"])

    return sets.unionByName(pairs.where("pairs is not null").select("place", "pairs"), allowMissingColumns=True).repartitionById(PLACES, F.col("place")).mapInArrow(run, "node long, score double, ord long, license string")


def most_similar(rows: DataFrame, threshold: float, skip_self: bool) -> DataFrame:
    """(key, license, score): for each text the reference of the greatest Dice coefficient, at least `threshold`; ties go to the lowest ord.

    rows: (key string, ord long, role int, words array<long>) of texts (role 1), references (2), or both at once (3), words being
    distinct hashes.  skip_self: a reference with a text's key isn't its own match.
    """
    rows = rows.where("key is not null") if skip_self else rows
    keyed = skip_self
    nodes = kept(_nodes(rows, keyed), "nodes")
    pairs = kept(_candidates(rows, _frequencies(nodes), keyed, threshold), "pairs")
    named = nodes.where("node is not null").select("key", "ord", "role", "node")
    # the lowest two of the references of equal words: one of them isn't the text itself
    lowest = F.min(F.when(F.col("role").bitwiseAND(REF) > 0, F.struct("ord", "key")))
    first = named.groupBy("node").agg(F.min_by("key", F.struct("role", "key")).alias("_key"), F.bit_or("role").alias("role"), F.max(F.when(F.col("role") == TEXT, F.col("key"))).alias("own"), lowest.alias("_1"))
    second = named.join(first.select("node", "_1"), "node").where((F.col("role").bitwiseAND(REF) > 0) & (F.col("key") != F.col("_1.key"))).groupBy("node").agg(F.min(F.struct("ord", "key")).alias("_2"))
    own = F.col("own") if keyed else F.lit(None).cast("string")
    classes = kept(first.join(second, "node", "left").select("node", "_key", "role", own.alias("own"), F.array_compact(F.array("_1", "_2")).alias("refs")), "classes")
    wanted = pairs.where("node is not null").groupBy("node").agg(F.collect_set("place").alias("places"))
    wanted = kept(wanted.join(classes, "node"), "wanted")
    keys = wanted.select(F.col("_key").alias("key")).distinct()
    few = keys.limit(SENT + 1).count() <= SENT
    texts = rows.join(F.broadcast(keys) if few else keys, "key", "left_semi")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if got := [(node, words.tobytes()) for _, node, words in _sets(batch, keyed)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.binary()))], ["node", "words"])

    sets = texts.mapInArrow(bodies, "node long, words binary").join(wanted.drop("_key"), "node").select(F.explode("places").alias("place"), "node", "words", "role", "own", "refs")
    near = _counted(pairs, sets, threshold).groupBy("node").agg(F.max_by(F.struct("license", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("_near"))
    mine = named.where(F.col("role").bitwiseAND(TEXT) > 0).select("key", "node")
    same = F.get(F.filter("refs", lambda r: r["key"] != F.col("key")) if skip_self else F.col("refs"), F.lit(0))
    equal = mine.join(classes.select("node", "refs"), "node").select("key", "node", same["key"].alias("_same"))
    out = equal.join(near, "node", "left").select("key", F.when(F.col("_same").isNotNull(), F.struct(F.col("_same").alias("license"), F.lit(1.0).alias("score"))).otherwise(F.col("_near")).alias("x"))
    return out.where("x is not null").select("key", "x.license", "x.score")
