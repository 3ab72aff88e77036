from collections import defaultdict

import numpy as np

from gritsieve.llm import quality_rules as qr
from gritsieve.llm import tokenizers
from gritsieve.llm.queries import QUERIES
from tests.llm.cases import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


def test_measures_against_the_definition():
    model, is_byte = tokenizers.piece_bpe()
    texts = ["the cat and the cat", "漢字 🙂 \x00", "", "a" * 5000]
    got = qr.measure(texts)
    for i, t in enumerate(texts):
        ids = model.encode(t)
        n = len(ids)
        assert got["n_tokens"][i] == n
        if n:
            share = np.unique(ids, return_counts=True)[1] / n
            assert abs(got["entropy"][i] + (share * np.log2(share)).sum()) < 1e-9 and abs(got["chars_per_token"][i] - len(t) / n) < 1e-12
            assert abs(got["byte_share"][i] - sum(is_byte[j] for j in ids) / n) < 1e-12
            assert abs(got["chars_per_byte_token"][i] - len(t) / len(tokenizers.byte_bpe().encode_ordinary(t))) < 1e-12


def judged(rows, least):
    """reasons by the definition, from rows with measures."""
    classes = defaultdict(list)
    size = lambda r: int(np.floor(np.log2(max(1, r.n_tokens))))
    for r in rows:
        if r.n_tokens is not None:
            classes[r.lang, size(r)].append(r)
    out = {}
    rules = qr.BANDS | {"deficit": qr._DEFICIT}
    value = lambda r, name: np.log2(max(1, r.n_tokens)) - r.entropy if name == "deficit" else getattr(r, name)
    for (lang, s), members in classes.items():
        alike = [r for (x, _), v in classes.items() if x == lang for r in v]
        if len(alike) < least:
            alike = [r for v in classes.values() for r in v]
        far = 0
        while len(pool := [r for r in alike if abs(size(r) - s) <= far]) < min(least, len(alike)):
            far += 1
        wide = any(size(r) != s for r in pool)
        bounds = {}
        for name, b in rules.items():
            steps = np.sort([np.floor(value(r, name) / b.step) for r in pool])
            q1, q3 = (steps[int(np.ceil(q * len(steps))) - 1] for q in (0.25, 0.75))
            spread = max((q3 - q1) * b.step, b.least_spread)
            bounds[name] = (-np.inf if b.low is None else q1 * b.step - b.low * spread, np.inf if b.high is None else (q3 + 1) * b.step + b.high * spread, b.noise)
        for r in members:
            def outside(name):
                low, high, noise = bounds[name]
                more = noise / np.sqrt(max(1, r.n_tokens)) if wide else 0.0
                return not low - more <= value(r, name) <= high + more

            out[id(r)] = [n for n in qr.BANDS if outside(n) and (n != "entropy" or not wide or outside("deficit"))]
    return [",".join(out[id(r)]) if r.n_tokens is not None else "empty" for r in rows]


def test_the_query_against_the_definition(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs.doc_id) and len(rows) == len(docs)
    assert [r.reasons for r in rows] == judged(rows, qr.LEAST) and all(r.keep == (r.reasons == "") for r in rows)
    texts = dict(zip(docs.doc_id, docs.text))
    got = qr.measure([texts[r.doc_id] for r in rows])
    assert all(r.n_tokens == got["n_tokens"][i] and abs(r.entropy - got["entropy"][i]) < 1e-9 for i, r in enumerate(rows))


def test_awkward_documents(spark):
    docs = awkward(spark)
    for least in (1, 5, 30, 1000):
        rows = qr.fertility_report(docs, least=least).collect()
        assert len(rows) == len(awkward_rows()) and [r.reasons for r in rows] == judged(rows, least)
    rows = qr.fertility_report(docs, least=5).collect()
    assert {r.reasons for r in rows if r.doc_id in (102, 103, 104)} == {"empty"}
    kept = qr.keep_by_rules(docs, least=5)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert qr.fertility_report(empty(spark)).count() == 0 and qr.keep_by_rules(empty(spark)).count() == 0
    assert qr.keep_by_rules(docs.drop("lang"), least=5).count() > 0


def test_rare_languages_and_sizes_are_judged(spark):
    """Junk alone in its language, or longer than anything else in it, goes; clean text of a rare language stays."""
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    clean = docs[(docs.lang == "en") & (docs.n_chars > 1000)].text.iloc[0]
    more = [(10**6, "for " * 20_000, "en"), (10**6 + 1, "for " * 300, "xx"), (10**6 + 2, clean, "xx"), (10**6 + 3, "for " * 300, None), (10**6 + 4, clean, None)]
    both = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text, docs.lang), *more], "doc_id long, text string, lang string")
    rows = qr.fertility_report(both).collect()
    assert [r.reasons for r in rows] == judged(rows, qr.LEAST)
    assert [r.keep for r in sorted(rows, key=lambda r: r.doc_id)[-5:]] == [False, False, True, False, True]


def test_labels_are_followed(spark):
    import pandas as pd

    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r.keep for r in QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    good, bad = (labels[labels.quality == q].doc_id for q in (1, 0))
    assert np.mean([rows[i] for i in good]) > 0.98 and np.mean([rows[i] for i in bad]) < 0.1


def test_recall_and_false_rejections(spark):
    import pandas as pd

    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r.keep for r in QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.1").select("doc_id", "keep").collect()}
    good, bad = (labels[labels.quality == q].doc_id for q in (1, 0))
    assert np.mean([rows[i] for i in good]) > 0.998 and np.mean([rows[i] for i in bad]) < 0.1
