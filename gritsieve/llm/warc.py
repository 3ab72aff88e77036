"""WARC records by boundary-chain verification.

A WARC file has no index, and the record magic can also occur inside payloads, so a task that starts in the middle
of a file can't tell a record from a quotation.  Here every task reads its split, takes each magic with a valid
header as a *candidate*, and emits the offset of the candidate and of its successor: end of header, plus
Content-Length, plus the two line ends that close a record.  Chains within a split are contracted to the first
offset outside it.  Pointer jumping from the start of each file then finds the entries that are reached: each
round doubles the length of the known pointers, so their number is the logarithm of the splits of a file.  What
the chain from offset 0 never reaches is part of a payload and is dropped.

Files are read by byte range through `pyarrow.fs`, so any file system it knows will do.  Splits are dealt out evenly to as
many tasks as their bytes ask for.  Of a file whose name ends in `.gz`, each record is a gzip member of its own, as the format
recommends: a candidate is then a gzip header whose data begin with a record, and its successor the end of its
member.  A member of several records gives all of them.

Defined results: an empty file has no record.  A file whose first bytes aren't a record has none either, since
nothing is reachable.  A record that the end of the file cuts off is retained with complete = false and the part of
its payload that is there.  Where a chain breaks (damaged bytes), the records before the break are retained.
Headers may have any length and folded lines.  Files of the same bytes under two paths are separate files, and repeated
records separate records.  A record without an id or a URI has null there.

`response_pages` gives a page_id only to records whose id is `<urn:page:N>`, as `write_pages` makes them, and null to all
others; a response of status 204 has a null body.  `write_pages` writes a page_id of null as `<urn:page:none>`, leaves out the URI of a null url,
and gives a null html status 204; repeated rows are repeated records; extra columns are ignored, whatever their names; an empty
table makes an empty folder.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote as percent
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm.shared import discard, fresh_path, small_batches, written

MAGIC, GZIP = b"WARC/", b"\x1f\x8b\x08"
READ_BYTES = 1 << 16
SPLIT_BYTES = 64 << 20
TASK_BYTES = 128 << 20
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_PART_OF_VERSION = re.compile(rb"W(A(R(C(/(\d+(\.(\d+\r?)?)?)?)?)?)?)?$")


def _open(path: str):
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path if parts.scheme else path
    return pafs.FileSystem.from_uri(path)


def parse_header(raw: bytes, more: Callable[[], bytes] | None = None) -> tuple[int, dict[str, str]] | None:
    """(length of the header, its fields in lower case) of a record at the beginning of raw, or None.

    more: gives the bytes that follow, none at the end; only asked for as long as what is there may begin a header.
    """
    more = more or (lambda: b"")
    while not (version := _VERSION.match(raw)):
        if not _PART_OF_VERSION.match(raw) or not (next_ := more()):
            return None
        raw += next_
    fields: dict[str, str] = {}
    at, name = version.end(), ""
    while True:
        while (end := raw.find(b"\n", at)) < 0:
            if not (next_ := more()):
                return None
            raw += next_
        line = raw[at:end].removesuffix(b"\r")
        at = end + 1
        if not line:
            break
        if line[:1] in b" \t":  # a folded line belongs to the field before it
            if not name:
                return None
            fields[name] = f"{fields[name]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        head, colon, value = line.partition(b":")
        if not colon or not head.strip():
            return None
        name = head.strip().lower().decode("latin-1")
        if name in fields:
            name += "\x00again"  # the first of equal fields counts
        fields[name] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        return None
    return at, fields


def uri_of(fields: dict[str, str]) -> str | None:
    """The target, from its exact form where `record` had to write one."""
    if exact := fields.get("x-exact-target-uri"):
        try:
            return base64.b64decode(exact, validate=True).decode()
        except ValueError:
            pass
    uri = fields.get("warc-target-uri")
    return uri[1:-1] if uri is not None and uri.startswith("<") and uri.endswith(">") else uri


def unzipped(f, start: int, size: int, most: int = -1) -> tuple[bytes, int, bool]:
    """(data of the gzip member at start, its end in the file, whether it is whole); up to about `most` bytes of data, if that isn't negative."""
    inflate, parts, got, at = zlib.decompressobj(31), [], 0, start
    while not inflate.eof and at < size and (most < 0 or got < most):
        raw = f.read_at(min(READ_BYTES, size - at), at)
        at += len(raw)
        try:
            parts.append(inflate.decompress(raw))
        except zlib.error:
            return b"".join(parts), start, False
        got += len(parts[-1])
    return b"".join(parts), at - len(inflate.unused_data), inflate.eof


CANDIDATES = "path string, split long, offset long, successor long, exit long, body long, length long, type string, uri string, record_id string"


def file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size) of the files among paths and below the folders among them."""
    rows: list[tuple[str, int]] = []
    for path in paths:
        fs, name = _open(path)
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.Directory:
            prefix = path[: len(path) - len(name)]
            rows += [(prefix + i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
        elif info.type == pafs.FileType.File:
            rows.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return spark.createDataFrame(rows, "path string, size long")


def _splits(files: DataFrame, split_bytes: int) -> tuple[DataFrame, int]:
    """(path, size, start) of all splits, dealt out evenly, and the number of tasks, by their bytes."""
    splits, size = files.agg(F.sum(F.ceil(F.col("size") / F.lit(split_bytes))), F.sum("size")).first()
    tasks = max(1, min(int(splits or 0), max(-(-int(size or 0) // TASK_BYTES), files.sparkSession.sparkContext.defaultParallelism)))
    rows = files.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"))
    return rows.repartition(tasks), tasks  # a number that is asked for isn't changed by adaptive execution


def candidates(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every magic with a valid header: its offset, successor, and the first offset of its chain outside its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, start, size = row["path"], row["start"], row["size"]
                fs, name = _open(path)
                magic = GZIP if path.endswith(".gz") else MAGIC
                with fs.open_input_file(name) as f:
                    data = f.read_at(min(split_bytes + READ_BYTES, size - start), start)
                    found, at = [], data.find(magic)
                    while 0 <= at < split_bytes:
                        if magic is GZIP:
                            head, successor = _zipped_head(f, start + at, size)
                        else:
                            head, successor = parse_header(data[at : at + READ_BYTES], _follow(f, start + min(at + READ_BYTES, len(data)), size)), 0
                        if head:
                            n, fields = head
                            length = int(fields["content-length"])
                            body = n if successor else start + at + n
                            found.append([start + at, successor or body + length + 4, 0, body, length, fields["warc-type"], uri_of(fields), fields.get("warc-record-id")])
                        at = data.find(magic, at + 1)
                leads: dict[int, int] = {}
                for x in reversed(found):  # a successor lies behind its record, so its own exit is known
                    x[2] = leads[x[0]] = leads.get(x[1], x[1])
                if found:
                    columns = list(zip(*found))
                    n = len(found)
                    types = [pa.int64()] * 5 + [pa.string()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([start // split_bytes] * n, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["path", "split", "offset", "successor", "exit", "body", "length", "type", "uri", "record_id"])

    return _splits(files, split_bytes)[0].mapInArrow(run, CANDIDATES)


def _follow(f, at: int, size: int) -> Callable[[], bytes]:
    """A function that gives the bytes of a file from `at` on, piece by piece."""
    place = [at]

    def more() -> bytes:
        raw = f.read_at(min(READ_BYTES, size - place[0]), place[0]) if place[0] < size else b""
        place[0] += len(raw)
        return raw

    return more


def _zipped_head(f, at: int, size: int) -> tuple[tuple[int, dict[str, str]] | None, int]:
    """(header of the first record of the gzip member at `at`, end of the member), or (None, 0)."""
    data, _, _ = unzipped(f, at, size, 1)
    if not data.startswith(MAGIC):
        return None, 0
    data, end, _ = unzipped(f, at, size)
    head = parse_header(data)
    return head, max(end, at + 1) if head else 0


def reached_entries(found: DataFrame) -> DataFrame:
    """(path, offset) of the candidates at which the chain from the start of its file enters a split."""
    starts = found.select("path").distinct().withColumn("offset", F.lit(0).cast("long"))
    targets = found.select("path", F.col("exit").alias("offset")).union(starts).distinct()
    jumps = written(found.join(targets, ["path", "offset"], "left_semi").select("path", "offset", "exit"), "jumps")
    reached = written(jumps.where("offset = 0").select("path", "offset"), "reached")
    n = reached.count()
    while n:
        ahead = reached.join(jumps, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        real = jumps.select("path", "offset")
        last, reached = reached, written(reached.union(ahead.join(real, ["path", "offset"], "left_semi")).distinct(), "reached")
        discard(last)
        if (now := reached.count()) == n:
            break
        n = now
        then = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        last, jumps = jumps, written(jumps.join(then, ["path", "exit"], "left").select("path", "offset", F.coalesce("further", "exit").alias("exit")), "jumps")
        discard(last)
    discard(jumps)
    return reached


RECORDS = "path string, offset long, type string, uri string, record_id string, length long, complete boolean, payload binary"


def read_warc(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of WARC files, one row each, with their payloads."""
    files = file_list(spark, paths)
    found = written(candidates(files, split_bytes), "candidates")
    entries = reached_entries(found).withColumn("entry", F.lit(True))
    chains = found.join(entries, ["path", "offset"], "left").join(files, "path")
    chains = chains.repartition(_splits(files, split_bytes)[1], "path", "split").sortWithinPartitions("path", "split", "offset")
    names = ["path", "split", "offset", "successor", "body", "length", "type", "uri", "record_id", "entry", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, expected, opened, source = None, -1, None, None
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("length", pa.int64()), ("complete", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for path, split, offset, successor, body, length, kind, uri, record_id, entry, size in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (path, split):
                    here, expected = (path, split), -1
                if not entry and offset != expected:
                    continue
                expected = successor
                if opened != path:
                    if source:
                        source.close()
                    fs, name = _open(path)
                    opened, source = path, fs.open_input_file(name)
                if path.endswith(".gz"):
                    made = list(_member(*unzipped(source, offset, size)[::2]))
                else:
                    made = [(kind, uri, record_id, length, body + length <= size, source.read_at(max(0, min(length, size - body)), min(body, size)))]
                rows += [(path, offset, *m) for m in made]
                held += sum(len(m[-1]) for m in made)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if source:
            source.close()

    return chains.select(*names).mapInArrow(run, RECORDS)


def _member(data: bytes, whole: bool) -> Iterator[tuple[str, str | None, str | None, int, bool, bytes]]:
    """(type, uri, record_id, length, complete, payload) of the records in the data of a gzip member."""
    at = 0
    while head := parse_header(data[at : at + READ_BYTES], iter([data[at + READ_BYTES :], b""]).__next__):
        n, fields = head
        length = int(fields["content-length"])
        payload = data[at + n : at + n + length]
        yield fields["warc-type"], uri_of(fields), fields.get("warc-record-id"), length, len(payload) == length and (whole or at + n + length < len(data)), payload
        at += n + length + 4


def response_pages(records: DataFrame) -> DataFrame:
    """(page_id, record_id, url, html_bytes, html_md5) of the response records: the body behind the HTTP header."""
    split = F.expr("position(X'0D0A0D0A' in payload)")
    none = F.substring("payload", 1, 13).rlike(r"^HTTP/1\.[01] 204")
    body = F.when(~none, F.expr("substring(payload, position(X'0D0A0D0A' in payload) + 4)"))
    page_id = F.nullif(F.regexp_extract("record_id", r"^<urn:page:(-?\d{1,19})>$", 1), F.lit("")).try_cast("long")
    return (
        records.where((F.col("type") == "response") & (split > 0))
        .select(page_id.alias("page_id"), "record_id", F.col("uri").alias("url"), body.alias("body"))
        .select("page_id", "record_id", "url", F.octet_length("body").cast("long").alias("html_bytes"), F.md5("body").alias("html_md5"))
    )


# Writing: the tables here hold pages, not WARC files.


def record(kind: str, record_id: str, payload: bytes, uri: str | None = None, content: str = "application/http; msgtype=response") -> bytes:
    """A record.  A URI that can't stand in a header as it is stands there encoded, and its exact form in a field of our own."""
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
    if uri is not None:
        if uri and uri.isprintable() and uri == uri.strip() and uri[0] != "<":
            head += f"WARC-Target-URI: {uri}\r\n"
        else:
            head += f"WARC-Target-URI: {percent(uri, safe=':/?#[]@!$&()*+,;=%')}\r\n" + (f"X-Exact-Target-URI: {base64.b64encode(uri.encode()).decode()}\r\n" if uri else "")
    return f"{head}Content-Type: {content}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, html: str | None, quote: int = 3) -> bytes:
    """A response record of a page; for one page of `quote`, also a record whose payload is another record."""
    status = "200 OK" if html is not None else "204 No Content"
    http = f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode() + (html or "").encode()
    own = record("response", f"urn:page:{'none' if page_id is None else page_id}", http, url)
    if page_id is not None and page_id % quote == 0:
        small = record("response", f"urn:page:{-1 - page_id}", b"HTTP/1.1 200 OK\r\n\r\nquoted", "http://quoted.invalid/")
        own += record("conversion", f"urn:quote:{page_id}", small + small[:-4], url, "text/plain")
    return own


def write_pages(pages: DataFrame) -> str:
    """Writes (page_id, url, html) as WARC files, one for each partition, to a new folder that all executors share."""
    folder = fresh_path(pages.sparkSession, "warc")
    fs, name = _open(folder)
    fs.create_dir(name, recursive=True)  # a table of no partition makes no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, name = _open(folder)
        fs.create_dir(name, recursive=True)
        final = f"{name}/part-{task.partitionId():05d}.warc"
        draft = f"{name}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with fs.open_output_stream(draft) as out:
            out.write(record("warcinfo", "urn:info", b"software: gritsieve\r\n", content="application/warc-fields"))
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(page_records(*row))
        fs.move(draft, final)  # a later attempt at the same task replaces the file by an equal one
        yield pa.RecordBatch.from_arrays([pa.array([final])], ["file"])

    small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
    return folder
