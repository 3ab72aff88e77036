import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gritsieve.llm import warc
from gritsieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def chain(raw):
    """(offset, type, payload, complete) of the records, from the first on."""
    out, at = [], 0
    while head := warc.parse_header(raw[at:]):
        n, fields = head
        length = int(fields["content-length"])
        body = raw[at + n : at + n + length]
        out.append((at, fields["warc-type"], body, len(body) == length))
        at += n + length + 4
    return out


@pytest.mark.parametrize("split", [50, 333, 4096, 1 << 20])
def test_records_against_reading_from_the_start(spark, tmp_path, split):
    rng = random.Random(split)
    inner = warc.record("response", "x", b"fake", "http://x/")
    files = {"empty.warc": b"", "junk.warc": b"junk" + inner}
    for name in ("a", "b"):
        parts = [warc.record("warcinfo", "i", b"a: b\r\n")]
        for i in range(30):
            body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 200, 900])))
            parts.append(warc.record(rng.choice(["response", "conversion"]), f"r{i}", rng.choice([body, inner * 3, b"WARC/1.0\r\n" + body, inner[:-9] + body]), "http://p/"))
        files[f"{name}.warc"] = b"".join(parts)
    files["cut.warc"] = files["a.warc"][: len(files["a.warc"]) - 40]
    files["broken.warc"] = files["a.warc"][:700] + b"??" + files["a.warc"][700:]
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = warc.read_warc(spark, [str(tmp_path)], split_bytes=split).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.offset, r.type, bytes(r.payload), r.complete))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, raw in files.items() if (v := chain(raw))}


def test_the_query_against_sql(spark):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
        want = sorted(con.sql(f"SELECT page_id, record_id, url, html_bytes, html_md5 FROM ({ORACLES['op7_warc']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op7_warc"](spark, SF).collect()) == want


AWKWARD = [(0, "http://a/", "x" * 300_000), (1, None, ""), (2, "http://b/", None), (3, "http://c/\r\nX: y", "WARC/1.0\r\n"), (3, "http://c/", "twice"), (3, "http://c/", "twice"), (4, "é", "漢字 🙂\x00"), (None, "  a  b ", "no id"), (None, None, None), (-5, "", "HTTP/1.1 204 No\r\n\r\n"), (6, "<x>", "u" * 70_000)]


def test_awkward_pages(spark):
    import hashlib

    pages = spark.createDataFrame([(*r, "w", "z", "q", "o") for r in AWKWARD], "page_id long, url string, html string, path string, type string, payload string, split string")
    got = warc.response_pages(warc.read_warc(spark, [warc.write_pages(pages)], split_bytes=1000)).collect()
    md5 = lambda h: None if h is None else hashlib.md5(h.encode()).hexdigest()
    want = [(i, f"<urn:page:{'none' if i is None else i}>", u, None if h is None else len(h.encode()), md5(h)) for i, u, h in AWKWARD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    none = warc.write_pages(pages.limit(0))
    assert warc.response_pages(warc.read_warc(spark, [none])).count() == 0
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, ["/no/such/place"])


def test_the_query_on_awkward_pages_against_sql(spark, tmp_path):
    spark.createDataFrame(AWKWARD, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = sorted(map(repr, con.sql(f"SELECT page_id, record_id, url, html_bytes, html_md5 FROM ({ORACLES['op7_warc']})").fetchall()))
    assert sorted(map(repr, map(tuple, QUERIES["op7_warc"](spark, str(tmp_path)).collect()))) == want


def test_foreign_records(spark, tmp_path):
    """Ids that aren't ours, headers of any length, folded lines, records without an id or a URI."""
    http = b"HTTP/1.1 200 OK\r\n\r\n<p>"
    long = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:6f>\r\nX-Long: " + b"y" * 200_000 + b"\r\nWARC-Target-URI: <http://f/>\r\nContent-Length: 22\r\n\r\n" + http + b"\r\n\r\n"
    bare = b"WARC/1.0\nWARC-Type:\n response\nContent-Length: 22\n\n" + http + b"\r\n\r\n"
    big = warc.record("response", "urn:page:99999999999999999999", http, "http://g/") + warc.record("response", "urn:page:7", http, "http://h/")
    (tmp_path / "f.warc").write_bytes(long + bare + big)
    for split in (100, 1 << 20):
        rows = warc.read_warc(spark, [str(tmp_path)], split_bytes=split)
        got = warc.response_pages(rows).collect()
        assert sorted((r.page_id or 0, r.record_id or "", r.url or "", r.html_bytes) for r in got) == [(0, "", "", 3), (0, "<urn:page:99999999999999999999>", "http://g/", 3), (0, "<urn:uuid:6f>", "http://f/", 3), (7, "<urn:page:7>", "http://h/", 3)]
    assert rows.where("record_id is null and uri is null").count() == 1


@pytest.mark.parametrize("split", [60, 5000])
def test_gzipped_members(spark, tmp_path, split):
    import gzip

    rng = random.Random(split)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 50, 3000]))) for _ in range(25)]
    bodies[3] = gzip.compress(warc.record("response", "quoted", b"x"), 0) * 2
    members = [gzip.compress(warc.record("response", f"r{i}", b, "http://z/"), rng.choice([0, 9])) for i, b in enumerate(bodies)]
    members[7] = gzip.compress(warc.record("response", "r7", bodies[7]) + warc.record("response", "r7b", b"second"), 0)
    raw = b"".join(members)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "cut.warc.gz").write_bytes(raw[: len(raw) - len(members[-1]) // 2])
    got = {}
    for r in warc.read_warc(spark, [str(tmp_path)], split_bytes=split).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.record_id] = (bytes(r.payload), r.complete)
    want = {f"<r{i}>": (b, True) for i, b in enumerate(bodies)} | {"<r7b>": (b"second", True)}
    assert got["a.warc.gz"] == want
    last = got["cut.warc.gz"].pop("<r24>", (b"", False))
    assert got["cut.warc.gz"] == {k: v for k, v in want.items() if k != "<r24>"} and bodies[24].startswith(last[0]) and not last[1]


def test_splits_are_dealt_out_to_as_many_tasks_as_asked_for(spark):
    files = spark.createDataFrame([(f"/none/{i}", 64 << 20) for i in range(1000)], "path string, size long")
    rows, tasks = warc._splits(files, 64 << 20)
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert tasks == 500 and len(sizes) == 500 and max(sizes) <= 4 and sum(sizes) == 1000
    assert "AQEShuffleRead" not in rows._jdf.queryExecution().executedPlan().toString()


def test_headers():
    assert warc.parse_header(b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: 3\r\n\r\nabc")[1]["content-length"] == "3"
    for bad in (b"", b"WARC/1.0\r\n\r\n", b"WARC/1.0\r\nWARC-Type: a\r\n\r\n", b"WARC/x\r\nWARC-Type: a\r\nContent-Length: 3\r\n\r\n", b"WARC/1.0\r\nno colon\r\nWARC-Type: a\r\nContent-Length: 3\r\n\r\n", b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: -3\r\n\r\n"):
        assert warc.parse_header(bad) is None
