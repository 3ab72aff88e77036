import random
import struct

import pytest

from gritsieve.llm import media
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(20))
def test_keyframes_point_at_their_samples(seed):
    rng = random.Random(seed)
    payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 511, 512, 513, 2048, 9000])))
    raw = media.wrap(payload, seed)
    (t,) = media.read_container(raw)
    offset, size, time, key = t.samples()
    pieces = [payload[i : i + 512] for i in range(0, len(payload), 512)]
    assert [raw[o : o + s] for o, s in zip(offset, size)] == pieces
    assert [i for i, k in enumerate(key) if k] == list(range(0, len(pieces), 8)) and time.tolist() == [512 * i for i in range(len(pieces))]
    assert t.codec.split(".")[0].encode() == media.VIDEO[seed % 4] and (t.width, t.height) == (640, 360) and t.duration() == 512 * len(pieces)


def test_bad_containers_are_rows(spark):
    good = media.wrap(b"x" * 5000, 0)
    rng = random.Random(0)
    rows = [(1, None), (2, b""), (3, b"not a container"), (4, good[:-1]), (5, good[:300]), (6, struct.pack(">I4s", 0, b"moov")), (7, good), (7, good), (None, good), (8, struct.pack(">I4sQ", 1, b"mdat", 1 << 60))]
    for i in range(300):  # damaged at random
        raw = bytearray(good if i % 2 else media.wrap(b"y" * 5000, 4))
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(min(len(raw), 900))] = rng.randrange(256)
        rows.append((100 + i, bytes(raw)))
    got = media.media_tracks(spark.createDataFrame([(i, c, "x", "y") for i, c in rows], "media_id long, content binary, kind string, error string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.media_id, []).append(r)
    assert [by[i][0].error for i in (1, 2)] == ["empty", "empty"] and all(by[i][0].error for i in (3, 4, 5, 6, 8))
    assert len(by[7]) == 2 and by[7][0].error is None and by[None][0].codec.startswith("avc1") and len(by[7][0].keyframes) == 2
    assert all(100 + i in by for i in range(300))
    assert media.media_tracks(spark.createDataFrame([], "media_id long, content binary")).count() == 0


def test_the_query_against_the_texts(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.media_id: r for r in QUERIES["op4_media_tracks"](spark, SF).collect()}
    assert set(got) == set(docs.doc_id)
    for i, t in zip(docs.doc_id, docs.text):
        raw, r = t.encode(), got[i]
        wrapped = media.wrap(raw, i)
        pieces = [raw[j : j + 512] for j in range(0, len(raw), 512)]
        assert r.error is None and r.n_samples == len(pieces) and r.duration_ticks == 512 * len(pieces) and r.duration_s == r.duration_ticks / 12_800
        assert [wrapped[k.offset : k.offset + k.length] for k in r.keyframes] == pieces[::8]


def test_awkward_documents(spark):
    got = media.media_tracks(media.wrapped_texts(awkward(spark))).collect()
    assert len(got) == len(awkward_rows()) and {r.error for r in got if r.media_id == 102} == {"empty"} and all(r.error is None for r in got if r.media_id in (103, 105, 109))
    assert media.media_tracks(media.wrapped_texts(empty(spark))).count() == 0


def test_tables_of_other_forms():
    """Audio without a sync table, small sizes of 4 bits, composition shifts, and runs of chunks."""
    tables = b"".join(
        [
            media.full(b"stts", media._u32s(2, 3, 100, 2, 50)), media.full(b"ctts", media._u32s(1, 5), struct.pack(">i", -7), version=1), media.full(b"stsc", media._u32s(2, 1, 2, 1, 3, 1, 1)),
            media.full(b"stz2", bytes([0, 0, 0, 4]), media._u32s(5), bytes([0x12, 0x34, 0x50])), media.full(b"stco", media._u32s(3, 1000, 2000, 3000)),
        ]
    )
    raw = media.box(b"moov", media._header(9, "soun", b"mp4a", 1000, 0, tables))
    (t,) = media.read_container(raw)
    offset, size, time, key = t.samples()
    assert offset.tolist() == [1000, 1001, 2000, 2003, 3000] and size.tolist() == [1, 2, 3, 4, 5] and time.tolist() == [-7, 93, 193, 293, 343] and key.all() and t.duration() == 400 and t.id == 9


#: ftyp, mdat of 10 bytes, and moov with one audio track of three samples in two chunks, byte by byte
BY_HAND = bytes.fromhex(
    "00000010 66747970 69736f6d 00000200"
    "00000012 6d646174 41414142 42434343 4343"
    "000000ec 6d6f6f76"
    "000000e4 7472616b"
    "0000005c 746b6864 00000007 00000000 00000000 00000005 00000000 00000000" + "00" * 60 +
    "00000080 6d646961"
    "00000020 6d646864 00000000 00000000 00000000 00001f40 000000f0 00000000"
    "00000021 68646c72 00000000 00000000 736f756e 00000000 00000000 00000000 00"
    "00000037 6d696e66"
    "0000002f 7374626c"
    "00000027 73747364 00000000 00000001 00000017 6d703461 00000000 00000001 00000000 000000"
)


def tables_by_hand():
    """The container above with sample tables put at the end of stbl, all sizes of the boxes around them raised by hand."""
    more = bytes.fromhex(
        "00000018 73747473 00000000 00000001 00000003 00000050"
        "00000028 73747363 00000000 00000002 00000001 00000002 00000001 00000002 00000001 00000001"
        "00000020 7374737a 00000000 00000000 00000003 00000003 00000002 00000005"
        "00000018 7374636f 00000000 00000002 00000018 0000001d"
        "00000014 73747373 00000000 00000001 00000003"
    )
    raw = bytearray(BY_HAND + more)
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        at = raw.index(kind) - 4
        raw[at : at + 4] = (len(raw) - at).to_bytes(4, "big")
    return bytes(raw)


def test_a_container_written_byte_by_byte(spark):
    raw = tables_by_hand()
    (row,) = media.media_tracks(spark.createDataFrame([(1, raw)], "media_id long, content binary")).collect()
    assert row.error is None and (row.track_id, row.kind, row.codec, row.timescale, row.duration_ticks, row.n_samples) == (5, "soun", "mp4a", 8000, 240, 3) and abs(row.duration_s - 0.03) < 1e-12
    assert [tuple(k) for k in row.keyframes] == [(3, 160, 29, 5)] and raw[29:34] == b"CCCCC"
    (t,) = media.read_container(raw)
    offset, size, time, key = t.samples()
    assert [raw[o : o + n] for o, n in zip(offset, size)] == [b"AAA", b"BB", b"CCCCC"] and time.tolist() == [0, 80, 160] and key.tolist() == [False, False, True]
