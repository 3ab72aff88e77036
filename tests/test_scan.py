import json
import zipfile

import duckdb
import pytest

from gritsieve.operators.cache import ResultsCache
from gritsieve.plans import catalog, sinks
from gritsieve.plans.analysers import CryptoAnalyser
from gritsieve.plans.config import ScanConfig
from gritsieve.plans.scan import scan, store_results
from gritsieve.sources.files import file_tree
from gritsieve.sources.reference import alias_ref, license_ref, load_reference
from gritsieve.streaming import incoming

SF = "/root/testdata/sf0.001"
LICENSE = " ".join(f"word{i}" for i in range(60)) + "."


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "r"
    for name, body in {
        "LICENSE": LICENSE, "README.md": "x <!-- MIT License -->\n", "src/__init__.py": "# SPDX-License-Identifier: ISC OR X\n", "src/a.py": "# Copyright 2020 Ann\nimport sha1\n",
        "src/_priv/c.py": "# SPDX-License-Identifier: A OR B) AND C\n", "src/.hidden.py": "1", ".git/x.py": "1", ".gitignore": "build/\n", "build/out.js": "1", "empty.py": "", "big.txt": "a" * 1_000_001, "skip.tmp": "1",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "img.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (root / "bad.txt").write_bytes(b"\xff\xfe12")
    (root / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(root / "lib.zip", "w") as z:
        z.writestr("d/e.py", "# hi\n")
        z.writestr(".h/f.py", "1")
    return root


def test_tree(spark, tree):
    files, ignored = file_tree(spark, [str(tree)], globs=["*.tmp"])
    names = {r.relpath for r in files.select("relpath").collect()}
    assert names == {"LICENSE", "README.md", "src/__init__.py", "src/a.py", "src/_priv/c.py", "img.png", "bad.txt", "big.txt", "empty.py", "lib/d/e.py"}
    assert {(r.relpath, r.reason) for r in ignored.collect()} == {(".git", "hidden"), (".gitignore", "hidden"), ("src/.hidden.py", "hidden"), ("build", "gitignore"), ("skip.tmp", "pattern")}
    single, _ = file_tree(spark, [str(tree / "src" / ".hidden.py")])
    assert [r.relpath for r in single.collect()] == [".hidden.py"]


def test_scan(spark, tree, tmp_path):
    ref = license_ref(spark.createDataFrame([("MIT", 1, "MIT License", LICENSE)], "key string, ord long, name string, text string"), "key", order="ord", name="name")
    names = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", [])], "key string, ord long, name string, aliases array<string>"))
    store = ResultsCache(spark, str(tmp_path / "cache"))
    for turn in range(2):  # the second time from the cache
        frames = scan(spark, [str(tree)], ref, names, ScanConfig(ignore_patterns=("*.tmp",), include_fingerprints=True, gram=3, window=2), cache=store)
        found = {(r.relpath, r.category): json.loads(r.data) for r in frames.findings.collect()}
        assert found["LICENSE", "license"]["key"] == "MIT" and found["LICENSE", "license"]["score"] == 1.0
        assert found["README.md", "comments"][0]["licenses"] == ["MIT"]
        assert found["src/__init__.py", "comments"][0]["licenses"] == ["ISC", "X"]
        assert found["src/a.py", "comments"][0]["copyright"][0]["holders"] == ["Ann"]
        assert found["src/a.py", "crypto"] == [{"algorithm": "SHA-1", "coding": "hash"}]
        store_results(frames, store)
        assert {(r.relpath, r.category, r.message) for r in frames.errors.collect()} == {("src/_priv/c.py", "license", "unbalanced brackets")}
    assert {"img.png", "big.txt", "bad.txt", "lib/d/e.py"} <= {r.relpath for r in frames.no_result.collect()} | {"lib/d/e.py"}
    top = frames.summary.collect()
    assert len(top) == 1 and top[0].dir == "" and top[0].licenses == ["ISC", "MIT", "X"] and "Ann" in top[0].copyrights
    text = sinks.document(frames).first()["value"]
    (tmp_path / "doc.json").write_text(text)
    back = sinks.read_document(spark, str(tmp_path / "doc.json")).first()
    assert back.summary[""].licenses == ["ISC", "MIT", "X"] and back.stats["total"] == frames.stats.first().total
    assert any("PackageLicenseInfoFromFiles: ISC AND MIT AND X" == r.value for r in sinks.tag_value(frames, "t").collect())


def test_an_analyser_that_fails_leaves_an_error_and_the_others(spark, tree):
    from pyspark.sql import functions as F

    class Broken(CryptoAnalyser):
        category = "broken"

        def transform(self, files):
            return files.select("relpath", F.raise_error(F.lit("no luck")).cast("string").alias("data"))

    class Worse(CryptoAnalyser):
        category = "worse"

        def transform(self, files):
            raise ValueError("at once")

    ref = license_ref(spark.createDataFrame([("MIT", 1, "MIT License", LICENSE)], "key string, ord long, name string, text string"), "key", order="ord", name="name")
    names = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", [])], "key string, ord long, name string, aliases array<string>"))
    config = ScanConfig()
    frames = scan(spark, [str(tree)], ref, names, config, analysers=[Broken(config, "broken"), CryptoAnalyser(config), Worse(config, "worse")])
    assert {(r.relpath, r.category) for r in frames.findings.collect()} == {("src/a.py", "crypto")}
    failed = {r.category: r.message for r in frames.errors.where("relpath is null").collect()}
    assert set(failed) == {"broken", "worse"} and "no luck" in failed["broken"] and "at once" in failed["worse"]


def test_the_fold_reads_written_facts(spark, tree):
    ref = license_ref(spark.createDataFrame([("MIT", 1, "MIT License", LICENSE)], "key string, ord long, name string, text string"), "key", order="ord", name="name")
    names = alias_ref(spark.createDataFrame([("MIT", 1, "MIT License", [])], "key string, ord long, name string, aliases array<string>"))
    frames = scan(spark, [str(tree)], ref, names, ScanConfig())
    assert "from_json" not in frames.summary._jdf.queryExecution().optimizedPlan().toString()
    assert frames.summary.first().licenses == ["ISC", "MIT", "X"]


def test_uploads():
    sent = []
    way = lambda name, status: lambda b: (sent.append(name), status)[1]
    assert sinks.uploaded("x", way("direct", 200), way("presigned", 200)) == 200 and sent == ["direct"]
    sinks.uploaded("x" * 200_000, way("direct", 200), way("presigned", 201))
    sinks.uploaded("x", way("direct", 504), way("presigned", 201))
    assert sent == ["direct", "presigned", "direct", "presigned"]
    with pytest.raises(OSError):
        sinks.uploaded("x", way("direct", 500), way("presigned", 200))


def test_reference_is_built_once(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("GRITSIEVE_DATASET_DIR", str(tmp_path / "built"))
    (tmp_path / "ref.json").write_text('{"key":"A","name":"Name","text":"some words","aliases":["al"]}\n{"key":"B","name":"N","text":""}\n')
    ref = load_reference(spark, str(tmp_path / "ref.json"))
    assert [(r.key, r.aliases) for r in ref.collect()] == [("A", ["al"])]
    (tmp_path / "ref.json").unlink()
    assert load_reference(spark, str(tmp_path / "ref.json")).count() == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a.py", 3, b"md5"), ("b.py", 4, b"none"), ("c.txt", 3, b"md5")], incoming.INCOMING)
    rows.write.parquet(str(tmp_path / "in"))
    incoming.scan_stream(incoming.requests(spark, str(tmp_path / "in")), [CryptoAnalyser(ScanConfig())], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.relpath for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.py"]


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(catalog.ORACLES[name])
        columns = sorted(want.columns)
        expected = sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == expected
