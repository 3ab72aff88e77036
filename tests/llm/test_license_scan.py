import itertools
import random
import re

import pytest

from gritsieve.llm import license_scan as ls
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.01"
EDGE = r"[0-9A-Za-z_\x80-\xff]"


BLANKS = rb"(?:(?:(?:^|(?<=[\n\r]))[\t-\r *#/;%|>!-]+)|[\t-\r ]+(?:(?<=[\n\r])[\t-\r *#/;%|>!-]+)?|[\t-\r ]*[\n\r][\t-\r *#/;%|>!-]*)"


def brute(text):
    """(first, past the last, license) by searching for each phrase on its own, with any white space or comment marks for a blank."""
    raw = (text or "").encode()
    low, hits = raw.lower(), []
    for phrase, license_id in [*((t, None) for t in ls.TAGS), *ls.NOTICES]:
        words = phrase.split(" ")
        if words[0].encode() not in low or words[-1].encode() not in low:
            continue
        for m in re.finditer(b"(?=(" + BLANKS.join(re.escape(w.encode()) for w in words) + b"))", low):
            a, b = m.start(), m.end(1)
            inside = lambda i: 0 <= i < len(raw) and re.match(EDGE.encode(), raw[i : i + 1])
            if (a > 0 and inside(a - 1) and inside(a)) or (license_id and inside(b) and inside(b - 1)):
                continue
            hits.append((a, b, license_id))
    return sorted(h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] for o in hits))


def test_notices_over_lines_and_later_versions():
    machine = ls.automaton()
    cases = {
        "Licensed under the Apache License,\n   Version 2.0": ["Apache-2.0"],
        "/*\n * under the terms of the GNU General Public\n * License as published by the Free Software Foundation; either\n * version 2 of the License, or (at your option) any later\n * version.": ["GPL-2.0-or-later"],
        "GNU General Public License, version 3 or (at your option) any later version": ["GPL-3.0-or-later"],
        "# gnu general\n# public license,\r\n# version 3.": ["GPL-3.0-only"],
        "GNU Lesser General Public License, version 2.1": ["LGPL-2.1-only"],
        "CC BY-NC-SA 3.0, not CC BY 4.0": ["CC-BY-NC-SA-3.0", "CC-BY-4.0"],
        "the mit * license": [], "mit - license": [], "MIT\t LICENSE": ["MIT"], "* MIT License": ["MIT"],
        "SPDX-License-Identifier:\tMIT": [None],
    }
    for text, want in cases.items():
        got = ls.scan_bytes(text.encode(), machine)
        assert [x[2] for x in got] == want and got == brute(text), text
    assert len(ls.NOTICES) > 400 and all(ls.is_known(i) for _, i in ls.NOTICES) and all(p == " ".join(p.lower().split()) for p, _ in ls.NOTICES)
    assert ls.all_known("mit AND (GPL-2.0+ WITH Classpath-exception-2.0 OR LicenseRef-x)") and not ls.all_known("Nonsense-99 AND Foo") and not ls.all_known("MIT WITH MIT")


def test_random_breaks_against_single_searches():
    rng, machine = random.Random(4), ls.automaton()
    pieces = ["MIT", "license", "GNU", "General", "Public", "License,", "version", "3", "or", "later", "x", "é", "Apache"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "\n", "\r\n * ", "  ", "\n# ", " * ", "-", ""]) for _ in range(rng.randint(1, 30)))
        assert ls.scan_bytes(text.encode(), machine) == brute(text), text


def test_the_query_against_single_searches(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = sorted((i, a, license_id) for i, t in zip(docs.doc_id, docs.text) for a, _, license_id in brute(t))
    got = QUERIES["op8_license_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.offset, r.expression if r.kind == "notice" else None) for r in got) == want and len(want) > 30


def test_awkward_documents(spark):
    from pyspark.sql import functions as F

    extra = "é SPDX-License-Identifier: (mit OR GPL-3.0-only) and ISC */\n MIT License mit licensed xMIT License\rLicense-Expression: A B"
    docs = awkward(spark).withColumn("text", F.when(F.col("doc_id") == 101, extra).otherwise(F.col("text")))
    got = ls.license_findings(docs).orderBy("doc_id", "offset").collect()
    assert [(r.offset, r.kind, r.licenses, r.valid, r.allowed) for r in got] == [(3, "tag", ["mit", "GPL-3.0-only", "ISC"], True, True), (extra.encode().index(b"MIT License"), "notice", ["MIT"], True, True), (extra.encode().index(b"License-Exp"), "tag", [], False, False)]
    assert len(brute(extra)) == 3 and len(awkward_rows()) == docs.count()
    assert ls.license_findings(empty(spark)).count() == 0


def test_expressions_against_all_truth_values():
    rng = random.Random(0)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("ABCD")
        a, b, op = make(depth - 1), make(depth - 1), rng.choice(["AND", "OR", "and", "or"])
        return f"({a} {op} {b})" if rng.random() < 0.5 else f"{a} {op} {b}"

    for _ in range(200):
        e = make(4)
        for n in range(5):
            for ok in itertools.combinations("ABCD", n):
                want = eval(e.lower().replace("and", " & ").replace("or", " | "), {c.lower(): c in ok for c in "ABCD"})  # & binds closer than |
                named, got = ls.evaluate(e, frozenset(ok))
                assert got == want and named == list(dict.fromkeys(re.findall("[ABCD]", re.sub("(?i)and|or", "", e))))


def test_exceptions_and_bad_expressions():
    assert ls.evaluate("GPL-2.0 WITH cp AND MIT", frozenset(["MIT", "GPL-2.0 WITH cp"])) == (["GPL-2.0", "MIT"], True)
    assert ls.evaluate("GPL-2.0 with cp", frozenset(["MIT"])) == (["GPL-2.0"], False)
    for bad in ("", "AND", "A B", "A AND", "(A", "A)", "()", "A (B)", "A OR OR B", "(A OR B) WITH c"):
        with pytest.raises(ls.BadExpression):
            ls.evaluate(bad)
