import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gritsieve.functions.languages import EXTENSIONS, LANGUAGES, language
from gritsieve.functions.lexer import REFERENCE, STRICT, comments_of
from gritsieve.functions.spdx import Unbalanced, leaves, licenses_of
from gritsieve.operators import gates
from gritsieve.plans.catalog import _LEAVES, SNIPPETS
from gritsieve.sources.files import archive_kind
from gritsieve.sources.ignore import Rules


@pytest.mark.parametrize("lang,text,found", SNIPPETS)
def test_lexer_rules(lang, text, found):
    assert list(comments_of(text, lang)) == found


def test_lexer_modes_and_empty_texts():
    html = '<p class="x"><!-- a -->\n'
    assert list(comments_of(html, "HTML", REFERENCE)) == []
    assert list(comments_of(html, "HTML", STRICT)) == [(1, 1, " a ")]
    assert list(comments_of(None, "C")) == list(comments_of("", "C")) == list(comments_of("// x", None)) == []
    assert list(comments_of('x = "unclosed\n// a\n', "C")) == []
    assert list(comments_of("x = 'a\n// b\n", "JavaScript")) == [(2, 2, " b")]


def _slow(text, lang):
    """One character at a time, for languages without triple quotes or backticks."""
    spec, out, i, line = LANGUAGES[lang], [], 0, 1
    text = text if text.endswith("\n") else text + "\n"
    while i < len(text):
        if text[i] in "\"'":
            quote, i = text[i], i + 1
            while i < len(text) and text[i] != quote:
                i += 2 if text[i] == "\\" else 1
            if i >= len(text):
                return out
            i += 2
        elif any(text.startswith(s, i) for s, _ in spec.blocks):
            start, end = next(b for b in spec.blocks if text.startswith(b[0], i))
            first, j = i, i + len(start) + 1
            while j < len(text) and not text.startswith(end, j):
                j += 1
            if j >= len(text):
                return out
            out.append((1 + text.count("\n", 0, first), 1 + text.count("\n", 0, j), text[first + len(start) : j]))
            i = j + len(end) + 1
        elif any(text.startswith(s, i) for s in spec.lines):
            s = next(s for s in spec.lines if text.startswith(s, i))
            j = text.index("\n", i)
            line = 1 + text.count("\n", 0, i)
            out.append((line, line, text[i + len(s) : j]))
            i = j + 1
        else:
            i += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab/*\n\"'\\#%{}- ", max_size=60), st.sampled_from(["C", "SQL", "ObjectiveC", "Rust", "Haskell", "Shell"]))
def test_lexer_is_the_same_as_a_scan_by_character(text, lang):
    assert list(comments_of(text, lang)) == _slow(text, lang)


@pytest.mark.parametrize("expression,want", _LEAVES.items())
def test_expressions(expression, want):
    assert ",".join(licenses_of(expression)[0]) == want


def test_expression_errors():
    assert licenses_of(None) == (None, None)
    assert licenses_of("A OR B) AND C")[1] == "unbalanced brackets"
    with pytest.raises(Unbalanced):
        leaves("A OR B) AND C")


def test_languages(spark):
    assert "Clojure" not in EXTENSIONS.values() and "Matlab" not in EXTENSIONS.values()
    names = [f"d/x.{e}" for e in EXTENSIONS] + ["A.PY", "Makefile", ".py", "x.yml", "a.b/c", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = dict(rows.select("p", language(rows.p)).collect())
    assert all(got[f"d/x.{e}"] == lang for e, lang in EXTENSIONS.items())
    assert all(got[n] == "Unknown" for n in ("A.PY", "Makefile", ".py", "x.yml", "a.b/c")) and got[None] is None


def test_text_gate(spark):
    bodies = {"ok": b"plain", "png": b"\x89PNG1234", "nul": b"ab\x00c", "bad": b"\xff\xfe12", "late": b"a" * 5000 + b"\xff", "later": b"a" * 9000 + b"\xff", "cut": "é".encode() * 2050, "empty": b"", "big": b"a" * 1_000_001, "zip": b"PK\x03\x04xx"}
    rows = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in bodies.items()], "k string, size long, content binary")
    got = dict(rows.select("k", gates.is_text(rows.size, rows.content)).collect())
    assert {k for k, v in got.items() if v} == {"ok", "later", "cut", "empty"}


def test_ignore_rules():
    r = Rules.parse("/r", "# c\n*.log\nbuild/\n/top\na/**/z\n!keep.log\n")
    hit = lambda p, d=False: r.match("/r/" + p, d)
    assert hit("x.log") and hit("d/x.log") and not hit("keep.log") and hit("build", True) and not hit("build")
    assert hit("top") and not hit("d/top") and hit("a/z") and hit("a/b/c/z") and not r.match("/other/x.log", False)


def test_archive_kinds():
    assert [archive_kind(n) for n in ("a.zip", "a.tar.gz", "a.whl", "a.b.zip", "zip", ".zip", "a.txt")] == ["zip", "tar", "zip", None, None, None, None]


def test_snippet_rules_match_a_regular_expression_for_html():
    html = "<!-- a --> <!-- b --><!-- c --> <!----> x -->"
    assert [c[2] for c in comments_of(html, "HTML", STRICT)] == re.findall(r"(?s)<!--(.+?)-->.?", html)
