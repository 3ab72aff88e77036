"""Trees of files as a table.

The driver lists names only, pruning ignored folders; bytes are read in tasks, grouped by size so that no task gets
much more than `task_bytes`.  Archives are opened in tasks: their members become rows with the archive's relative
path, less its extension, as a folder, and archives within archives are opened in turn.  An archive that can't be read
vanishes; a file that can't be read has null content.

Files are looked up through the local file system of the executors, so paths must be on storage that all of them mount.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions.text import relative_path
from gritsieve.sources.ignore import Rules, reason

ZIPS = (".zip", ".whl", ".jar")
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
LISTED = "path string, root string, size long, mtime timestamp, task int"
FILES = "path string, root string, relpath string, name string, size long, mtime timestamp, content binary"
IGNORED = "relpath string, reason string"


def archive_kind(name: str) -> str | None:
    """`zip` or `tar` if all suffixes of the name together are those of an archive."""
    dot = name.lstrip(".").find(".")
    suffixes = name.lstrip(".")[dot:] if dot >= 0 else ""
    return "zip" if suffixes in ZIPS else "tar" if suffixes in TARS else None


def _stem(name: str) -> str:
    lead = len(name) - len(name.lstrip("."))
    return name[: lead + name[lead:].find(".")]


@dataclass(frozen=True)
class Listing:
    """What a walk found: (path, root, size, mtime) of files, and (relpath, reason) of what was left out."""

    files: list[tuple[str, str | None, int, float]]
    ignored: list[tuple[str, str]]


def walk(paths: Sequence[str], globs: Sequence[str] = (), hidden: bool = True, default_rules: Sequence[str] = ()) -> Listing:
    """Lists files below paths.  A file given as a path is taken whatever its name, with its folder as root.

    default_rules: lines in the form of an ignore file, in force below each folder given as a path.
    """
    found: list[tuple[str, str | None, int, float]] = []
    ignored: list[tuple[str, str]] = []

    def visit(folder: str, root: str, rules: tuple[Rules, ...]) -> None:
        own = os.path.join(folder, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = (*rules, Rules.parse(folder, f.read()))
        with os.scandir(folder) as entries:
            children = sorted(entries, key=lambda e: e.name)
        for child in children:
            path, is_dir = child.path, child.is_dir()
            if why := reason(child.name, path, is_dir, globs, rules, hidden):
                ignored.append((os.path.relpath(path, root), why))
            elif is_dir:
                visit(path, root, rules)
            elif child.is_file():
                stat = child.stat()
                found.append((path, root, stat.st_size, stat.st_mtime))

    for path in map(os.path.realpath, paths):
        if os.path.isdir(path):
            visit(path, path, (Rules(path, tuple(default_rules)),) if default_rules else ())
        elif os.path.isfile(path):
            stat = os.stat(path)
            found.append((path, os.path.dirname(path), stat.st_size, stat.st_mtime))
        else:
            raise FileNotFoundError(path)
    return Listing(found, ignored)


def _members(name: str, raw: bytes) -> list[tuple[str, bytes]]:
    """(path within, content) of the regular members of an archive; raises if it can't be read."""
    if archive_kind(name) == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]


def _unpacked(relpath: str, raw: bytes, globs: Sequence[str], hidden: bool) -> Iterator[tuple[str, bytes]]:
    """(relpath, content) of the members of an archive and of the archives in it.

    The rules of outer ignore files don't reach into an archive; hidden names, globs and ignore files inside do.
    """
    try:
        members = _members(os.path.basename(relpath), raw)
    except Exception:  # whatever the formats' readers raise for bytes that aren't theirs
        return
    clean = [(os.path.normpath(n), c) for n, c in members]
    clean = [(n, c) for n, c in clean if not n.startswith(("..", "/"))]
    rules = [Rules.parse("/" + os.path.dirname(n) if os.path.dirname(n) else "", c.decode("utf-8", "replace")) for n, c in clean if os.path.basename(n) == ".gitignore"]
    base = os.path.join(os.path.dirname(relpath), _stem(os.path.basename(relpath)))
    for n, c in clean:
        parts = n.split("/")
        if any(reason(p, "/" + "/".join(parts[: i + 1]), i + 1 < len(parts), globs, rules, hidden) for i, p in enumerate(parts)):
            continue
        if archive_kind(parts[-1]):
            yield from _unpacked(os.path.join(base, n), c, globs, hidden)
        else:
            yield os.path.join(base, n), c


def listed(spark: SparkSession, listing: Listing, task_bytes: int = 64 << 20) -> DataFrame:
    """The listing as a table, with the number of the task that is to read each file."""
    rows, task, filled = [], 0, 0
    for path, root, size, mtime in listing.files:
        if filled and filled + size > task_bytes:
            task, filled = task + 1, 0
        filled += size
        rows.append((path, root, size, mtime, task))
    table = pa.table(list(map(list, zip(*rows))) if rows else [[]] * 5, pa.schema([("path", pa.string()), ("root", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("task", pa.int32())]))
    return spark.createDataFrame(table).withColumn("mtime", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long"))).repartition(max(1, task + 1), "task")


def read_files(files: DataFrame, unpack: bool = True, globs: Sequence[str] = (), hidden: bool = True) -> DataFrame:
    """The rows of `listed` with contents, archives replaced by their members; see FILES."""
    schema = pa.schema([("path", pa.string()), ("root", pa.string()), ("relpath", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, root, relpath, size, mtime in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                except OSError:
                    rows.append((path, root, relpath, os.path.basename(path), size, mtime, None))
                    continue
                if unpack and archive_kind(os.path.basename(path)):
                    made = [(path, root, r, os.path.basename(r), len(c), mtime, c) for r, c in _unpacked(relpath, raw, globs, hidden)]
                else:
                    made = [(path, root, relpath, os.path.basename(path), len(raw), mtime, raw)]
                rows += made
                held += sum(len(m[6]) for m in made)
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    narrow = files.select("path", "root", relative_path(F.col("path"), F.col("root")).alias("relpath"), "size", "mtime")
    return narrow.mapInArrow(run, FILES)


def file_tree(spark: SparkSession, paths: Sequence[str], globs: Sequence[str] = (), hidden: bool = True, default_rules: Sequence[str] = (), unpack: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files with contents, ignored paths with their reason) below some paths."""
    found = walk(paths, globs, hidden, default_rules)
    ignored = spark.createDataFrame(found.ignored, IGNORED)
    return read_files(listed(spark, found), unpack, globs, hidden), ignored


def table_files(rows: DataFrame, relpath: str = "relpath", text: str = "text") -> DataFrame:
    """A table of texts in the form of FILES, so that it can be scanned like a tree."""
    path = F.col(relpath)
    content = F.encode(F.col(text), "utf-8")
    return rows.select(path.alias("path"), F.lit(None).cast("string").alias("root"), path.alias("relpath"), F.regexp_extract(path, r"[^/]*$", 0).alias("name"), F.octet_length(text).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), content.alias("content"))
