"""Detectors over contents: cryptographic algorithms, pattern rules, and winnowing fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+")
RULES = 2_000
"""Up to so many rules are collected and become literal patterns; more are joined."""

#: (algorithm, coding, pattern); patterns are read by Java and RE2 alike
CRYPTO: tuple[tuple[str, str, str], ...] = (
    ("AES", "symmetric", r"(?i)\b(aes|rijndael)(-?(128|192|256))?\b"),
    ("DES", "symmetric", r"(?i)\b(3des|triple-?des|desede)\b"),
    ("Blowfish", "symmetric", r"(?i)\b(blowfish|twofish)\b"),
    ("ChaCha20", "stream", r"(?i)\b(x?chacha20|salsa20)\b"),
    ("RC4", "stream", r"(?i)\b(rc4|arcfour)\b"),
    ("RSA", "asymmetric", r"(?i)\brsa\b"),
    ("ECDSA", "asymmetric", r"(?i)\b(ecdsa|ed25519|secp256[kr]1)\b"),
    ("DH", "exchange", r"(?i)\b(diffie-?hellman|ecdh|x25519)\b"),
    ("MD5", "hash", r"(?i)\bmd5\b"),
    ("SHA-1", "hash", r"(?i)\bsha-?1\b"),
    ("SHA-2", "hash", r"(?i)\bsha-?(224|256|384|512)\b"),
    ("SHA-3", "hash", r"(?i)\b(sha-?3|keccak)\b"),
    ("HMAC", "mac", r"(?i)\bhmac\b"),
)


def crypto_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CRYPTO), "algorithm string, coding string, pattern string")


def crypto_of(text: Column, table: tuple[tuple[str, str, str], ...] = CRYPTO) -> Column:
    """An array of the distinct (algorithm, coding) found in a text."""
    hits = [F.when(text.rlike(p), F.struct(F.lit(a).alias("algorithm"), F.lit(c).alias("coding"))) for a, c, p in table]
    # most texts have none, which one pattern of all of them tells
    some = text.rlike("|".join(f"(?:{p})" for _, _, p in table))
    return F.when(some, F.array_distinct(F.array_compact(F.array(*hits))))


def crypto_found(files: DataFrame, key: str = "relpath", text: str = "text", table: tuple[tuple[str, str, str], ...] = CRYPTO) -> DataFrame:
    """(key, algorithm, coding), each once for a file."""
    # outer, for which no filter is made that would search the texts once more
    hits = files.select(key, F.explode_outer(crypto_of(F.col(text), table)).alias("x")).where("x is not null")
    return hits.select(key, "x.algorithm", "x.coding").distinct()


def rule_matches(files: DataFrame, rules: DataFrame, key: str = "relpath", text: str = "text") -> DataFrame:
    """(key, rule, meta) for each rule (rule, pattern, meta) that a text fits; null texts fit none.

    Up to RULES rules, which are counted first, each becomes a pattern that is compiled once; more are joined as a nested loop.
    """
    few = rules.select("rule", "pattern", "meta").where("pattern is not null").limit(RULES + 1).collect()
    if len(few) <= RULES:
        number = {p: i for i, p in enumerate(dict.fromkeys(r.pattern for r in few))}
        hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(i)) for p, i in number.items()))) if number else F.array().cast("array<int>")
        found = files.select(F.col(key), F.explode(hits).alias("_number"))
        numbered = files.sparkSession.createDataFrame([(number[r.pattern], r.rule, r.meta) for r in few], "_number int, rule string, meta map<string,string>")
        return found.join(F.broadcast(numbered), "_number").select(key, "rule", "meta")
    return files.select(F.col(key), F.col(text).alias("_text")).join(rules, F.expr("_text rlike pattern")).select(key, "rule", "meta")


def _least_of_windows(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowing fingerprints of a text in lower case."""
    joined = " ".join(_WORDS.findall(text)).encode()
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 2 - k
    if n < 1 or not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.concatenate([[0], gaps + 1])[:n].tolist(), np.concatenate([gaps, [len(joined)]])[k - 1 :].tolist()
    hashes = np.frombuffer(b"".join([md5(joined[i:j]).digest()[:4] for i, j in zip(first, last)]), ">u4").astype(np.int64)
    # hash and place in one number, places counted down so that the rightmost wins
    ranked = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    taken = np.unique(np.lib.stride_tricks.sliding_window_view(ranked, min(window, n)).min(axis=1))
    at = (np.uint64(0xFFFFFFFF) - (taken & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at, hashes[at]


def fingerprints(files: DataFrame, key: str = "relpath", text: str = "text", k: int = 30, window: int = 64) -> DataFrame:
    """(key, position, hash): the winnowing fingerprints of a text.

    Every run of k words has a hash, the first 32 bits of an MD5; of every `window` consecutive hashes the least is taken, the
    rightmost of equals, and each place counts once.  Texts of fewer than k words, and null ones, have none; of fewer hashes than a window,
    the least of all.  Texts are hashed in one pass over Arrow batches; nothing is shuffled.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, places, hashes, held = [], [], [], 0
            for i, cell in enumerate(batch.column(1)):
                if (body := cell.as_py()) is not None:
                    at, h = _least_of_windows(body, k, window)
                    which.append(np.full(len(at), i))
                    places.append(at)
                    hashes.append(h)
                    held += len(at)
                if held and (held > 100_000 or i + 1 == batch.num_rows):
                    said = pa.array([f"{h:08x}" for h in np.concatenate(hashes).tolist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(which))), pa.array(np.concatenate(places).astype(np.int32)), said], [key, "position", "hash"])
                    which, places, hashes, held = [], [], [], 0

    return files.select(key, F.lower(F.col(text)).alias("_text")).mapInArrow(run, f"`{key}` {kind}, position int, hash string")


def fingerprint_text(files: DataFrame, prints: DataFrame, key: str = "relpath") -> DataFrame:
    """(key, wfp): a `file=` line with the content's MD5, size and path, and a line of position and hashes for each fingerprint."""
    lines = prints.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "hash"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat(x["position"].cast("string"), F.lit("="), x["hash"])), "\n")
    head = F.concat(F.lit("file="), F.md5("content"), F.lit(","), F.octet_length("content").cast("string"), F.lit(","), F.col(key))
    return files.select(key, head.alias("_head")).join(lines.select(key, body.alias("_body")), key, "left").select(key, F.concat_ws("\n", "_head", "_body").alias("wfp"))
