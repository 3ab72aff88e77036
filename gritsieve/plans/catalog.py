"""Queries over the driver's tables, with equivalent SQL.

Documents act as license-like text files whose source is their folder, pages as HTML files.  The tables hold no tags,
copyright lines or names of algorithms, so queries on these put a line that depends on the row before each text, in
Spark and in SQL alike.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions import lexer, text
from gritsieve.functions.languages import comment_style, language
from gritsieve.functions.spdx import expression_leaves
from gritsieve.operators import cache, comments, copyrights, detectors, enrich, gates, licenses, summary
from gritsieve.plans import scan as scans
from gritsieve.plans import sinks
from gritsieve.plans.config import ScanConfig
from gritsieve.sources import files, ignore
from gritsieve.sources.reference import alias_ref, license_ref
from gritsieve.sources.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a relpath."""
    return _table(spark, sf_dir, "documents").withColumn("relpath", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


_RELPATH = "source || '/' || doc_id || '.txt'"
_NAMES = [("Apache-2.0", 1, "Apache License", ["Apache License, Version 2.0"]), ("MIT", 2, "MIT License", []), ("GPL-3.0", 3, "GNU General Public License, version 3", []), ("CC-BY-NC-4.0", 4, "CC BY-NC 4.0", [])]
_ALIASES = "(VALUES ('Apache-2.0', 1, 'Apache License, Version 2.0'), ('Apache-2.0', 1, 'Apache-2.0'), ('Apache-2.0', 1, 'Apache License'), ('MIT', 2, 'MIT License'), ('GPL-3.0', 3, 'GPL-3.0'), ('GPL-3.0', 3, 'GNU General Public License, version 3'), ('CC-BY-NC-4.0', 4, 'CC-BY-NC-4.0'), ('CC-BY-NC-4.0', 4, 'CC BY-NC 4.0')) a(license, ord, alias)"


def aliases(spark: SparkSession) -> DataFrame:
    """The names of a few licenses, as a table."""
    return alias_ref(spark.createDataFrame(_NAMES, "key string, ord long, name string, aliases array<string>"))


_EDGE = r"[\t\n\x0B\f\r !-/:-@\[-`{-~]"
_ALIAS_SQL = f"""
    SELECT doc_id, source, {_RELPATH} AS relpath, a.license, a.ord, a.alias FROM documents JOIN {_ALIASES} ON strpos(text, a.alias) > 0
    WHERE (strpos(text, a.alias) = 1 OR regexp_matches(substr(text, (strpos(text, a.alias) - 1)::BIGINT, 1), '^{_EDGE}$'))
      AND (strpos(text, a.alias) + length(a.alias) > length(text) OR regexp_matches(substr(text, (strpos(text, a.alias) + length(a.alias))::BIGINT, 1), '^{_EDGE}$'))
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, license, n_files): the licenses named in the files of each folder, and how many files name none."""
    docs = doc_files(spark, sf_dir)
    docs = docs.where(gates.within_size(F.octet_length("text")) & gates.short_enough(F.col("text")))
    named = licenses.alias_matches(docs, aliases(spark)).select("relpath", "license").distinct()
    both = docs.select("relpath").join(named, "relpath", "left")
    return both.groupBy(text.directory(F.col("relpath")).alias("dir"), F.coalesce("license", F.lit("(none)")).alias("license")).agg(F.count("*").alias("n_files"))


@query(
    f"""WITH d AS (SELECT * FROM documents WHERE strlen(text) <= 1000000 AND length(text) < 100000),
        n AS (SELECT DISTINCT doc_id, license FROM ({_ALIAS_SQL}))
        SELECT source AS dir, coalesce(license, '(none)') AS license, count(*)::BIGINT AS n_files FROM d LEFT JOIN n USING (doc_id) GROUP BY ALL"""
)
def license_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


_EXTS = ["py", "c", "JS", "js", "md", "rs", "m", "clj", "yml", "hpp", "f90", "sql", "tsx", "", "xml"]


@query(
    f"""WITH f AS (SELECT page_id, 'src/p' || page_id || CASE list_extract({_EXTS!r}, (page_id % 15 + 1)::INT) WHEN '' THEN '' ELSE '.' || list_extract({_EXTS!r}, (page_id % 15 + 1)::INT) END AS relpath FROM pages),
        e AS (SELECT relpath, regexp_extract(relpath, '\\.([^./]+)$', 1) AS ext FROM f),
        l AS (SELECT relpath, CASE ext WHEN 'py' THEN 'Python' WHEN 'c' THEN 'C' WHEN 'hpp' THEN 'C' WHEN 'js' THEN 'JavaScript' WHEN 'md' THEN 'Markdown' WHEN 'rs' THEN 'Rust' WHEN 'm' THEN 'ObjectiveC'
              WHEN 'clj' THEN 'Lisp' WHEN 'f90' THEN 'Fortran' WHEN 'sql' THEN 'SQL' WHEN 'tsx' THEN 'TypeScript' WHEN 'xml' THEN 'XML' ELSE 'Unknown' END AS lang FROM e)
        SELECT relpath, lang, CASE WHEN lang = 'Python' THEN 'shell' WHEN lang IN ('C', 'JavaScript', 'Rust', 'ObjectiveC', 'TypeScript') THEN 'bcpl' WHEN lang IN ('Markdown', 'XML') THEN 'html'
               WHEN lang = 'Lisp' THEN 'lisp' WHEN lang = 'Fortran' THEN 'fortran' WHEN lang = 'SQL' THEN 'sql' ELSE 'unknown' END AS style FROM l"""
)
def file_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("page_id") % 15 + 1).cast("int"))
    path = F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    lang = language(F.col("relpath"))
    return _table(spark, sf_dir, "pages").select(path.alias("relpath")).select("relpath", lang.alias("lang"), comment_style(lang).alias("style"))


@query(
    """SELECT doc_id, strlen(text) <= 1000000 AS fits, (length(text) < 100000) AS short,
              coalesce(strlen(text) <= 1000000 AND NOT (text LIKE 'GIF8%') AND strpos(substr(text, 1, 8), chr(0)) = 0, FALSE) AS is_text FROM documents"""
)
def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = gates.routed(files.table_files(doc_files(spark, sf_dir).withColumn("relpath", F.col("doc_id").cast("string"))))
    return routed.select(F.col("relpath").cast("long").alias("doc_id"), gates.within_size(F.col("size")).alias("fits"), gates.short_enough(F.col("content").cast("string")).alias("short"), "is_text")


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '.cache/' ELSE '' END || {_PATH} AS relpath FROM pages)
        SELECT page_id, relpath FROM p WHERE len(list_filter(string_split(relpath, '/'), lambda x: starts_with(x, '.') OR regexp_matches(x, '^m\\..*$') OR regexp_matches(x, '^.*0$'))) = 0"""
)
def ignore_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 7 == 0, ".cache/").otherwise(""), F.regexp_replace("url", r"^[a-z]+://", ""))
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("relpath")).where(~ignore.left_out(F.col("relpath"), ["m.*", "*0"]))


_STEMS = ["LICENSE", "src/main.py", "docs/README.md", "COPYING.txt", "notice", "a/b/Install.rst", "x/license.html"]


@query(
    f"""WITH f AS (SELECT doc_id, list_extract({_STEMS!r}, (doc_id % 7 + 1)::INT) AS relpath FROM documents)
        SELECT doc_id, relpath, regexp_matches(regexp_extract(relpath, '[^/]*$'), '(?i)LICENSE|COPYING|COPYRIGHT|NOTICE|ABOUT|INSTALL|README|CODE_OF_CONDUCT')
               AND NOT (relpath LIKE '%.py' OR relpath LIKE '%.md' OR relpath LIKE '%.html') AS license_route FROM f"""
)
def license_name_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _STEMS)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", path.alias("relpath"))
    return rows.withColumn("license_route", gates.license_name(F.col("relpath")) & (language(F.col("relpath")) == "Unknown"))


@query(f"SELECT sha1(text) AS sha1, count(*)::BIGINT AS n_files, min({_RELPATH}) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.duplicates(doc_files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")))


_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"


@query(
    f"""WITH t AS (SELECT doc_id, md5(array_to_string({_TOKENS}, chr(1))) AS h FROM documents WHERE len({_TOKENS}) > 0)
        SELECT a.doc_id, arg_min(b.doc_id, b.doc_id)::VARCHAR AS license FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1"""
)
def token_hash_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.exact_matches(docs, license_ref(docs, "doc_id"), key="doc_id", skip_self=True)


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS w FROM documents WHERE length(text) < 100000), n AS (SELECT doc_id, len(w) AS n FROM t), x AS (SELECT doc_id, unnest(w) AS w FROM t),
        o AS (SELECT a.doc_id, b.doc_id AS ref, count(*) AS o FROM x a JOIN x b USING (w) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        s AS (SELECT o.doc_id, o.ref, (2.0::DOUBLE * o.o) / (na.n + nb.n) AS score FROM o JOIN n na ON na.doc_id = o.doc_id JOIN n nb ON nb.doc_id = o.ref)
        SELECT doc_id, ref::VARCHAR AS license, round(score, 9) AS score FROM s WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ref) = 1"""
)
def license_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(gates.short_enough(F.col("text")))
    return licenses.similar_others(docs, "doc_id").withColumn("score", F.round("score", 9))


@query(f"SELECT doc_id, license, alias FROM ({_ALIAS_SQL})")
def license_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.alias_matches(_table(spark, sf_dir, "documents"), aliases(spark), key="doc_id").select("doc_id", "license", "alias")


_EXPRESSIONS = ["MIT", " MIT OR Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "A AND B OR C", "A B", "MIT and BSD", "A AND"]


def _tagged(column: str = "doc_id") -> Column:
    x = F.element_at(F.array(*map(F.lit, _EXPRESSIONS)), (F.col(column) % 7 + 1).cast("int"))
    return F.when(F.col(column) % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("# spdx-License-Identifier:"), x, F.lit("\n"), F.col("text")))


_TAGGED = f"CASE WHEN doc_id % 3 = 0 THEN text ELSE '# spdx-License-Identifier:' || list_extract({_EXPRESSIONS!r}, (doc_id % 7 + 1)::INT) || chr(10) || text END"


@query(f"SELECT doc_id, nullif(regexp_extract({_TAGGED}, '(?i)spdx-license-identifier:([^\\n]*)', 1), '') AS spdx FROM documents")
def spdx_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.license_tag(_tagged()).alias("spdx"))


_CLAIMS = "'SPDX-FileCopyrightText: 2020 Source ' || source || chr(10) || substr(text, 1, 40) || chr(10) || '// spdx-filecopyrighttext:Doc ' || doc_id || chr(10) || text"


@query(f"SELECT doc_id, unnest(regexp_extract_all({_CLAIMS}, '(?i)spdx-filecopyrighttext:([^\\n]*)', 1)) AS claim FROM documents")
def spdx_copyright_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("SPDX-FileCopyrightText: 2020 Source "), F.col("source"), F.lit("\n"), F.substring("text", 1, 40), F.lit("\n// spdx-filecopyrighttext:Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.copyright_tags(body)).alias("claim"))


_LEAVES = {
    "MIT": "MIT", " MIT OR Apache-2.0": "MIT,Apache-2.0", "(MIT OR Apache-2.0) AND BSD-3-Clause": "MIT,Apache-2.0,BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only,Classpath-exception-2.0",
    "(A) AND B": "A,B", "A AND": "A", "(A OR B": "A,B", "A AND B OR C": "", "A B": "", "": "", "A AND (B)": "", "MIT and BSD": "", "X AND(A OR B)": "", "MIT AND MIT": "MIT,MIT", "(A AND (B)) OR C": "",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _LEAVES.items()) + ") t(expr, leaves)")
def spdx_expression_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in _LEAVES], "expr string")
    return rows.select("expr", F.array_join(expression_leaves(F.col("expr")), ",").alias("leaves"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.+?)-->.?', 1)) AS text FROM pages")
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("lang", F.lit("HTML"))
    return lexer.comments(pages, key="page_id", text="html", mode=lexer.STRICT).where("error is null").select("page_id", "text")


SNIPPETS: list[tuple[str, str, list[tuple[int, int, str]]]] = [
    ("C", "// a\nint x;\n/* b */ // c\n", [(1, 1, " a"), (3, 3, " b "), (3, 3, " c")]),
    ("C", "/**/ int a; /* z */\n", [(1, 1, "*/ int a; /* z ")]),
    ("Python", '"""doc"""\ndef f():\n    """inner"""\n    # c\n', [(1, 1, "doc"), (4, 4, " c")]),
    ("JavaScript", "let a = `t`;\n// x\n", []),
    ("Swift", "/* a /* b */ c */\n", [(1, 1, " a /* b */ c ")]),
    ("SQL", "-- a\n# b\n/* c */\n", [(1, 1, " a"), (2, 2, " b"), (3, 3, " c ")]),
    ("Rust", "/* a */\n// b\n", [(2, 2, " b")]),
    ("Markdown", "it's\n<!-- a -->\n", []),
    ("AppleScript", "-- a\n", []),
    ("HTML", "<!-- a --><!-- b -->\n", [(1, 1, " a ")]),
    ("Go", "s := `\\`\n// b\n", [(2, 2, " b")]),
    ("Haskell", "{- a\nb -}\n-- c\n", [(1, 2, " a\nb "), (3, 3, " c")]),
    ("Batch", "@REM hi\n", [(1, 1, " hi")]),
    ("Lisp", "(f) ; one\n", [(1, 1, " one")]),
    ("ObjectiveC", "%{ a %}\n% b\n// c\n", [(1, 1, " a "), (2, 2, " b"), (3, 3, " c")]),
    ("Ruby", "=begin\nx\n=end\n# y\n", [(1, 3, "\nx\n"), (4, 4, " y")]),
]
_COMMENT_ROWS = [(i, *c) for i, (_, _, found) in enumerate(SNIPPETS) for c in found]


@query("SELECT id, first_line, last_line, text FROM (VALUES " + ", ".join("({}, {}, {}, '{}')".format(*r[:3], r[3].replace("'", "''").replace("\n", "' || chr(10) || '")) for r in _COMMENT_ROWS) + ") t(id, first_line, last_line, text)")
def comment_lex_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, lang, body) for i, (lang, body, _) in enumerate(SNIPPETS)], "id int, lang string, text string")
    return lexer.comments(rows, key="id").where("error is null").select("id", F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"), "text")


@query(
    """WITH l AS (SELECT conv_id, turn * 2 - (turn // 3) AS a, turn * 2 - (turn // 3) + (CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS b, text FROM conversations),
        g AS (SELECT *, CASE WHEN a = lag(b) OVER w + 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY a, b, text)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY a, b, text ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT conv_id, run::INT AS run, min(a)::BIGINT AS start_line, max(b)::BIGINT AS end_line, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY a, b, text)) AS text_md5 FROM r GROUP BY 1, 2"""
)
def comment_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("turn") * 2 - F.floor(F.col("turn") / 3)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", first.alias("start_line"), (first + F.when(F.col("role") == "user", 0).otherwise(1)).alias("end_line"), "text")
    return comments.merge_runs(rows, key="conv_id").select("conv_id", "run", "start_line", "end_line", F.md5("text").alias("text_md5"))


_CLAIMED = "'Copyright (c) 20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || ' Studio ' || source || '. All rights reserved' || chr(10) || 'Written by Ada ' || doc_id || chr(10) || text"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split({_CLAIMED}, chr(10))) AS line FROM documents),
        c AS (SELECT doc_id, regexp_replace(regexp_extract(line, '(?i)((?:\\bcopyright\\b|\\(c\\)|©).*)$', 1), '^[\\s,.;:*/#-]+|[\\s,.;:*/#-]+$', '', 'g') AS clause FROM l)
        SELECT doc_id, clause, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(clause, '(?i)\\bcopyright\\b|\\(c\\)|©|\\ball rights reserved\\b', ' ', 'g'), '\\b[0-9]{{4}}(?:\\s*[-,]\\s*[0-9]{{2,4}})*\\b', ' ', 'g'),
               '(?i)^[\\s,.;:]*by\\b', ' '), '\\s+', ' ', 'g'), '^[\\s,.;:*/#-]+|[\\s,.;:*/#-]+$', '', 'g')) AS holder FROM c WHERE clause <> ''"""
)
def copyright_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")
    body = F.concat(F.lit("Copyright (c) 20"), year, F.lit(" Studio "), F.col("source"), F.lit(". All rights reserved\nWritten by Ada "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(copyrights.statements(body, "nearest")).alias("x"))
    return rows.select("doc_id", "x.clause", F.coalesce(F.get("x.holders", F.lit(0)), F.lit("")).alias("holder"))


_SPELLS = ["uses AES-256 and sha1", "MD5 only", "plain prose", "RSA with sha-256, hmac", "ed25519"]
_SPELLED = f"list_extract({_SPELLS!r}, (doc_id % 5 + 1)::INT) || chr(10) || text"


@query(
    f"WITH d AS (SELECT doc_id, source, {_SPELLED} AS t FROM documents), k AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{c}', '{p}')" for a, c, p in detectors.CRYPTO)
    + ") k(algorithm, coding, pattern)) SELECT source AS dir, algorithm, coding, count(*)::BIGINT AS n_files FROM d JOIN k ON regexp_matches(t, pattern) GROUP BY ALL"
)
def crypto_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = F.element_at(F.array(*map(F.lit, _SPELLS)), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = doc_files(spark, sf_dir).withColumn("text", F.concat(spell, F.lit("\n"), F.col("text")))
    found = detectors.crypto_found(docs)
    return found.groupBy(text.directory(F.col("relpath")).alias("dir"), "algorithm", "coding").agg(F.count("*").alias("n_files"))


_RULES = [("license-line", r"(?i)licensed under", {"level": "info"}), ("secret", r"password=[0-9a-f]{8,}", {"level": "high"}), ("mail", r"[a-z]+@[a-z]+\.[a-z]{2,}", {"level": "low"})]


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c['level']}')" for a, b, c in _RULES) + ") r(rule, pattern, level)) SELECT doc_id, rule, level FROM documents JOIN r ON regexp_matches(text, pattern)")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "rule string, pattern string, meta map<string,string>")
    return detectors.rule_matches(_table(spark, sf_dir, "documents"), rules, key="doc_id").select("doc_id", "rule", F.col("meta")["level"].alias("level"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
        h AS (SELECT doc_id, i, substr(md5(array_to_string(w[i:i + 7], ' ')), 1, 8) AS h FROM g), n AS (SELECT doc_id, max(i) AS n FROM h GROUP BY 1),
        s AS (SELECT h.doc_id, i, n, min({'h': h, 'back': -i}) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m FROM h JOIN n USING (doc_id))
        SELECT DISTINCT doc_id, ((-m.back) - 1)::INT AS position, m.h AS hash FROM s WHERE i <= greatest(n - 15, 1)"""
)
def winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.fingerprints(_table(spark, sf_dir, "documents"), key="doc_id", k=8, window=16)


@query(
    """SELECT doc_id, CASE WHEN count(l.quality) = 0 THEN NULL ELSE string_agg('pkg:' || l.quality || '@' || l.toxic, ',' ORDER BY l.quality, l.toxic) END AS scan
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY doc_id"""
)
def component_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file="), F.md5(F.col("doc_id").cast("string")), F.lit(",1,x")).alias("wfp"))
    found = _table(spark, sf_dir, "labels").select(F.md5(F.col("doc_id").cast("string")).alias("file_hash"), F.array(F.concat(F.lit("pkg:"), F.col("quality").cast("string"))).alias("purl"), F.col("toxic").cast("string").alias("version"))
    rows = enrich.with_components(prints, found, key="doc_id")
    return rows.select("doc_id", F.array_join(F.transform("scan", lambda x: F.concat(x["purl"][0], F.lit("@"), x["version"])), ",").alias("scan"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'fast' WHEN o_custkey % 2 = 0 THEN 'primary' END AS hit, CASE WHEN (o_custkey % 3 = 0 AND o_orderkey % 5 <> 0) OR o_custkey % 2 = 0 THEN 'r' || o_custkey END AS data
       FROM orders"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    content, path, now = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")), F.lit("2024-01-01").cast("timestamp")
    rows = orders.select("o_orderkey", "o_custkey", content.alias("cache_key"), path.alias("fastpath_key"), F.col("o_orderkey").alias("size"), now.alias("mtime"))
    odd = F.col("o_custkey") % 3 == 0
    kept = rows.where(odd | (F.col("o_custkey") % 2 == 0)).select("cache_key", F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("data"), now.alias("stored_at")).distinct()
    # half of the paths whose content is known only by path have a key of their own, which isn't the content's
    fast = rows.where(odd).select("fastpath_key", "cache_key", F.when(F.col("o_orderkey") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", now.alias("stored_at"))
    asked = rows.withColumn("cache_key", F.when(odd & (F.col("o_custkey") % 2 == 1), F.lit("unknown")).otherwise(F.col("cache_key")))
    return cache.looked_up(asked, kept, fast).select("o_orderkey", "hit", "data")


@query(f"SELECT {_RELPATH} AS relpath FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_ALIAS_SQL}))")
def no_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_files(spark, sf_dir)
    return summary.no_result(docs, licenses.alias_matches(docs, aliases(spark)))


_MATRIX = [("GPL-3.0", "Apache-2.0", "Yes"), ("Apache-2.0", "GPL-3.0", "No"), ("CC-BY-NC-4.0", "GPL-3.0", "No"), ("GPL-3.0", "CC-BY-NC-4.0", "No"), ("MIT", "CC-BY-NC-4.0", "Yes"), ("CC-BY-NC-4.0", "MIT", "No")]


@query(
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{v}')" for a, b, v in _MATRIX) + f""") c(l, r, v)), n AS (SELECT DISTINCT license, ord FROM ({_ALIAS_SQL})),
        p AS (SELECT a.license AS a, b.license AS b FROM n a JOIN n b ON a.ord > b.ord)
        SELECT CASE WHEN x.l IS NOT NULL THEN p.a ELSE p.b END AS license, CASE WHEN x.l IS NOT NULL THEN p.b ELSE p.a END AS other FROM p LEFT JOIN c x ON x.l = p.a AND x.r = p.b AND x.v = 'No' LEFT JOIN c y ON y.l = p.b AND y.r = p.a AND y.v = 'No'
        WHERE x.l IS NOT NULL OR y.l IS NOT NULL"""
)
def license_incompatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = licenses.alias_matches(_table(spark, sf_dir, "documents"), aliases(spark), key="doc_id").select("license", "ord").distinct()
    return enrich.incompatible_pairs(named, spark.createDataFrame(_MATRIX, "left string, right string, verdict string"))


@query(
    """WITH f AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem), x AS (SELECT l_orderkey, l_returnflag, max({'n': l_linenumber, 's': l_linestatus}).s AS s FROM f GROUP BY 1, 2)
       SELECT l_orderkey::VARCHAR AS relpath, string_agg(l_returnflag || '=' || s, ',' ORDER BY l_returnflag) AS results FROM x GROUP BY 1"""
)
def result_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("relpath"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("data"), F.col("l_linenumber").alias("ord"))
    return summary.result_map(rows).select("relpath", F.array_join(F.transform(F.array_sort(F.map_entries("results")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("results"))


def _region_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts of a three-level tree r/n/c: customers' segments as components of the folders, nations' names as licenses."""
    region, nation, customer = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    folder = F.when(F.col("c_custkey") % 4 == 0, F.col("r_name")).when(F.col("c_custkey") % 4 == 1, F.concat_ws("/", "r_name", "n_name")).otherwise(F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), (F.col("c_custkey") % 3).cast("string"))))
    has = (F.col("r_regionkey") != 0) | (F.col("c_mktsegment") != "BUILDING")
    rows = tree.select(F.concat(folder, F.lit("/f"), F.col("c_custkey").cast("string")).alias("relpath"), F.when(has & (F.col("c_custkey") % 11 < 7), F.array("c_mktsegment")).alias("purl"), (F.col("c_custkey") % 2).cast("string").alias("version"), F.col("n_name").alias("license"))
    none = spark.createDataFrame([], "relpath string, license string")
    return rows, summary.component_facts(rows).unionByName(summary.license_facts(rows.select("relpath", "license"), none))


_TREE = """t AS (SELECT r_name, n_name, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN r_name WHEN c_custkey % 4 = 1 THEN r_name || '/' || n_name ELSE r_name || '/' || n_name || '/c' || (c_custkey % 3) END AS dir,
              CASE WHEN (r_regionkey <> 0 OR c_mktsegment <> 'BUILDING') AND c_custkey % 11 < 7 THEN c_mktsegment END AS purl, (c_custkey % 2)::VARCHAR AS version FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        f AS (SELECT DISTINCT dir, 'component' AS kind, purl AS name, version AS value FROM t WHERE purl IS NOT NULL UNION ALL SELECT DISTINCT dir, 'license', n_name, NULL FROM t)"""


@query(f"WITH {_TREE} SELECT dir, kind, name, coalesce(string_agg(value, ',' ORDER BY value), '') AS vals FROM f GROUP BY ALL")
def dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = _region_facts(spark, sf_dir)
    return facts.groupBy("dir", "kind", "name").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


_FOLD = f"""{_TREE}, own AS (SELECT DISTINCT dir FROM t), comp AS (SELECT DISTINCT dir, name FROM f WHERE kind = 'component'),
        up AS (SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/'))), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) AS up FROM own),
        bad AS (SELECT DISTINCT up.up FROM comp JOIN up USING (dir) WHERE NOT EXISTS (SELECT 1 FROM comp c WHERE c.dir = up.up AND c.name = comp.name)),
        top AS (SELECT dir, arg_min(up, length(up)) AS top FROM up WHERE up NOT IN (SELECT up FROM bad) GROUP BY 1),
        reps AS (SELECT own.dir, CASE WHEN NOT EXISTS (SELECT 1 FROM comp) THEN '' ELSE coalesce(top, own.dir) END AS rep FROM own LEFT JOIN top USING (dir)),
        m AS (SELECT DISTINCT rep AS dir, kind, name, value FROM f JOIN reps USING (dir))"""


@query(f"WITH {_FOLD} SELECT dir, kind, name, coalesce(string_agg(value, ',' ORDER BY value), '') AS vals FROM m GROUP BY ALL")
def summary_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, facts = _region_facts(spark, sf_dir)
    folded = summary.merged(facts, summary.fold(facts, rows.select(text.directory(F.col("relpath")).alias("dir"))))
    return folded.groupBy("dir", "kind", "name").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


@query(f"WITH {_FOLD} SELECT DISTINCT kind, name, value FROM m WHERE starts_with(dir, 'A')")
def summary_at_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, facts = _region_facts(spark, sf_dir)
    return summary.at_prefix(summary.merged(facts, summary.fold(facts, rows.select(text.directory(F.col("relpath")).alias("dir")))), "A")


@query(f"WITH n AS (SELECT DISTINCT doc_id FROM ({_ALIAS_SQL})) SELECT count(*)::BIGINT AS total, count(n.doc_id)::BIGINT AS with_result, (count(*) - count(n.doc_id))::BIGINT AS without_result FROM documents d LEFT JOIN n USING (doc_id)")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_files(spark, sf_dir)
    return summary.scan_stats(docs, licenses.alias_matches(docs, aliases(spark)))


@query("SELECT 'Supplier ' || (l_suppkey % 50) AS holder, count(DISTINCT l_orderkey)::BIGINT AS n_files FROM lineitem GROUP BY 1")
def holder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relpath"), F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 50).cast("string")).alias("holder"))
    return summary.holder_stats(rows)


_FLAT = "CASE doc_id % 7 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT,Apache-2.0' WHEN 2 THEN 'GPL-2.0-only,Classpath-exception-2.0' WHEN 6 THEN 'A' ELSE '' END"


@query(
    f"""WITH n AS (SELECT doc_id, string_agg(license, ',' ORDER BY ord, license) AS named FROM ({_ALIAS_SQL}) GROUP BY 1)
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN list_extract({_EXPRESSIONS!r}, (doc_id % 7 + 1)::INT) END AS spdx, CASE WHEN doc_id % 3 <> 0 THEN {_FLAT} ELSE named END AS licenses
        FROM documents LEFT JOIN n USING (doc_id) WHERE doc_id % 3 <> 0 OR named IS NOT NULL"""
)
def fallback_text_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text", _tagged())
    return licenses.analysed(docs, aliases(spark), key="doc_id").select("doc_id", "spdx", F.array_join("licenses", ",").alias("licenses"))


@query(
    """WITH h AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT h, (row_number() OVER (ORDER BY h) - 1) // 999 AS batch FROM h)
       SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n, md5(string_agg(h, ',' ORDER BY h)) AS hashes_md5 FROM b GROUP BY 1"""
)
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.request_batches(_table(spark, sf_dir, "documents").select(F.md5("text").alias("file_hash")))
    return rows.select("batch", F.size("hashes").cast("long").alias("n"), F.md5(F.array_join("hashes", ",")).alias("hashes_md5"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END), '\r\n?', chr(10), 'g')) AS text_md5 FROM documents WHERE strlen(text) < 500000")
def universal_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they go to the analyses, from files with the line ends of other systems; texts that double ends could take over the size gate are gated."""
    docs = _table(spark, sf_dir, "documents").where(F.octet_length("text") < 500_000)
    broken = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    routed = gates.routed(files.table_files(docs.select(F.col("doc_id").cast("string").alias("relpath"), broken.alias("text"))))
    return routed.select(F.col("relpath").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query(
    """SELECT doc_id, doc_id % 6 IN (0, 4) AND strlen(text) + CASE WHEN doc_id % 6 = 4 THEN 9001 ELSE 0 END <= 1000000 AND NOT regexp_matches(text, '^(GIF8|PK\x03\x04)') AND strpos(substr(text, 1, 8), chr(0)) = 0 AS is_text
       FROM documents WHERE text IS NOT NULL"""
)
def binary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a magic, a NUL, or a byte that isn't UTF-8 put in: before the end of the first chunk it shuts the gate, behind it it doesn't."""
    body, kind = F.encode("text", "utf-8"), F.col("doc_id") % 6
    many = lambda n: F.encode(F.repeat(F.lit("x"), F.lit(n)), "utf-8")
    bad = F.expr("X'FF'")
    content = F.when(kind == 1, F.concat(F.expr("X'89504E470D0A1A0A'"), body)).when(kind == 2, F.concat(F.expr("X'612000'"), body)).when(kind == 3, F.concat(many(100), bad, body)).when(kind == 4, F.concat(body, many(9000), bad)).when(kind == 5, F.concat(many(5000), bad, body)).otherwise(body)
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("relpath"), content.alias("content"))
    routed = gates.routed(rows.withColumn("size", F.octet_length("content").cast("long")))
    return routed.select("doc_id", "is_text")


_PLANTED = "CASE doc_id % 3 WHEN 0 THEN coalesce(b.text, d.text) WHEN 1 THEN coalesce(b.text || ' one more word', d.text) ELSE d.text END"


@query(
    f"""WITH p AS (SELECT d.doc_id, {_PLANTED} AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50),
        t AS (SELECT doc_id, {_TOKENS} AS w FROM p), r AS (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE length(text) > 0),
        e AS (SELECT t.doc_id, min(r.item_id) AS ref FROM t JOIN r ON array_to_string(t.w, chr(1)) = array_to_string(r.w, chr(1)) WHERE len(t.w) > 0 GROUP BY 1),
        x AS (SELECT doc_id, unnest(list_distinct(w)) AS w FROM t WHERE doc_id NOT IN (SELECT doc_id FROM e)), y AS (SELECT item_id, unnest(list_distinct(w)) AS w FROM r),
        nx AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT item_id, count(*) AS n FROM y GROUP BY 1), o AS (SELECT doc_id, item_id, count(*) AS o FROM x JOIN y USING (w) GROUP BY 1, 2),
        s AS (SELECT doc_id, item_id, 2.0::DOUBLE * o / (nx.n + ny.n) AS score FROM o JOIN nx USING (doc_id) JOIN ny USING (item_id))
        SELECT doc_id, ref::VARCHAR AS license, 1.0::DOUBLE AS score FROM e UNION ALL
        SELECT doc_id, item_id::VARCHAR, round(score, 9) FROM s WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1"""
)
def license_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License files against whole license texts: documents of which a third is a benchmark text and another third one with words added."""
    bench = _table(spark, sf_dir, "benchmark")
    both = _table(spark, sf_dir, "documents").join(bench.select("item_id", F.col("text").alias("planted")), F.col("item_id") == F.col("doc_id") % 50, "left")
    body = F.when(F.col("doc_id") % 3 == 0, F.coalesce("planted", "text")).when(F.col("doc_id") % 3 == 1, F.coalesce(F.concat("planted", F.lit(" one more word")), "text")).otherwise(F.col("text"))
    return licenses.text_matches(both.select("doc_id", body.alias("text")), license_ref(bench, "item_id"), key="doc_id").withColumn("score", F.round("score", 9))


@query(
    f"WITH d AS (SELECT source, {_SPELLED} AS t FROM documents), k AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{c}', '{p}')" for a, c, p in detectors.CRYPTO)
    + ") k(algorithm, coding, pattern)) SELECT DISTINCT source AS dir, 'crypto' AS kind, algorithm AS name, coding AS value FROM d JOIN k ON regexp_matches(t, pattern)"
)
def crypto_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cryptographic algorithms by directory."""
    spell = F.element_at(F.array(*map(F.lit, _SPELLS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return summary.crypto_facts(detectors.crypto_found(doc_files(spark, sf_dir).withColumn("text", F.concat(spell, F.lit("\n"), F.col("text")))))


_CLAIMED_TWICE = f"{_CLAIMED} || chr(10) || '(c) 1999-2001 Ann ' || doc_id"
_CLAUSES = f"""l AS (SELECT doc_id, source, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, source, string_split({_CLAIMED_TWICE}, chr(10)) AS x FROM documents)),
        c AS (SELECT doc_id, source, i, regexp_replace(regexp_extract(line, '(?i)((?:\\bcopyright\\b|\\(c\\)|©).*)$', 1), '^[\\s,.;:*/#-]+|[\\s,.;:*/#-]+$', '', 'g') AS clause FROM l),
        h AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(clause, '(?i)\\bcopyright\\b|\\(c\\)|©|\\ball rights reserved\\b', ' ', 'g'), '\\b[0-9]{{4}}(?:\\s*[-,]\\s*[0-9]{{2,4}})*\\b', ' ', 'g'), '(?i)^[\\s,.;:]*by\\b', ' '), '\\s+', ' ', 'g')) AS bare FROM c WHERE clause <> ''),
        n AS (SELECT doc_id, source, i, clause, regexp_replace(bare, '^[\\s,.;:*/#-]+|[\\s,.;:*/#-]+$', '', 'g') AS holder FROM h),
        a AS (SELECT doc_id, max(i) AS last, coalesce(string_agg(holder, '|' ORDER BY i) FILTER (WHERE holder <> ''), '') AS holders FROM n GROUP BY 1)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")
    body = F.concat(F.lit("Copyright (c) 20"), year, F.lit(" Studio "), F.col("source"), F.lit(". All rights reserved\nWritten by Ada "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n(c) 1999-2001 Ann "), F.col("doc_id").cast("string"))
    return doc_files(spark, sf_dir).select("doc_id", "relpath", F.explode(copyrights.statements(body, "reference")).alias("x"))


@query(f"WITH {_CLAUSES} SELECT n.doc_id, clause, CASE WHEN i = last THEN holders ELSE '' END AS holders FROM n JOIN a USING (doc_id)")
def copyright_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with their holders in the default mode, in which all holders belong to the last clause."""
    return _claims(spark, sf_dir).select("doc_id", "x.clause", F.array_join("x.holders", "|").alias("holders"))


@query(f"WITH {_CLAUSES} SELECT DISTINCT source AS dir, 'copyright' AS kind, holder AS name, NULL::VARCHAR AS value FROM n WHERE holder <> ''")
def copyright_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders by directory."""
    return summary.copyright_facts(_claims(spark, sf_dir).select("relpath", "x.clause", F.explode("x.holders").alias("holder")))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'fast' WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 'primary' END AS hit,
              CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN length(text)::VARCHAR END AS data FROM documents WHERE text IS NOT NULL"""
)
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds the results of half of the files, asked for all of them after a third has moved."""
    store = cache.ResultsCache(spark, f"{shared_folder(spark)}/gritsieve/cache-{uuid.uuid4().hex}")
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.encode("text", "utf-8").alias("content"), F.length("text").cast("string").alias("found"))
    store.set_with_fastpath(cache.keyed_files(rows.where("doc_id % 2 = 0"), "t").select("cache_key", F.col("found").alias("data"), "fastpath_key", "size", "mtime"))
    moved = rows.withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/b"), F.col("path"))).otherwise(F.col("path")))
    return store.get_with_fastpath(cache.keyed_files(moved, "t"), refresh=False).select("doc_id", "hit", "data")


def _scanned(spark: SparkSession, sf_dir: str) -> scans.ScanFrames:
    docs = files.table_files(doc_files(spark, sf_dir).withColumn("relpath", F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string")))))
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("relpath"), F.col("html").alias("text"))
    ref = license_ref(_table(spark, sf_dir, "benchmark"), "item_id")
    config = ScanConfig(analyse_all_text_files=True, lexer_mode=lexer.STRICT)
    return scans.scan_files(docs.unionByName(files.table_files(pages)), ref, aliases(spark), config)


@query()
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of a scan of documents and pages."""
    return _scanned(spark, sf_dir).findings


@query()
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.document(_scanned(spark, sf_dir))


@query()
def file_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files made for the purpose, with an archive and ignore files; it needs a folder that the tasks share."""
    shared = shared_folder(spark).removeprefix("file://")
    os.makedirs(shared, exist_ok=True)
    root = tempfile.mkdtemp(prefix="tree-", dir=shared)
    for name, body in (("LICENSE", "MIT License\n"), ("src/a.py", "# SPDX-License-Identifier: MIT\n"), ("src/.hidden.py", "x"), (".gitignore", "build/\n"), ("build/out.js", "x"), ("src/_priv/c.py", "x")):
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(body)
    with zipfile.ZipFile(os.path.join(root, "lib.zip"), "w") as z:
        z.writestr("d/e.py", "# hi\n")
    found, _ = files.file_tree(spark, [root])
    return found.select("relpath", "name", "size", F.sha1("content").alias("sha1"))
