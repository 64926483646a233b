import math
import re
from collections import Counter

import numpy as np

from newsmill.llm import toxicity
from newsmill.llm.common import bounded

from .helpers import empty, folder, odd

LABELS = "doc_id long, quality int, toxic int"


def test_thresholds_rise_and_gradient_is_right():
    rng = np.random.default_rng(1)
    rows = [[(0, 1)] if i % 3 == 0 else [(0, 3), (1, 1)] if i % 3 == 1 else [(1, 4)] for i in range(300)]
    grade = np.array([0 if i % 3 == 2 else 1 if i % 3 == 0 else 2 for i in range(300)])
    w, cut = toxicity.fit_ordinal(rows, grade, 2, ridge=1e-3)
    assert cut[0] < cut[1] and w[0] > 0
    model = toxicity.Model({"bad": 0, "fine": 1}, w, cut)
    p = model.grades(["bad", "bad bad bad fine", "fine fine fine fine", ""])
    assert np.allclose(p.sum(1), 1) and p.argmax(1).tolist()[:3] == [1, 2, 0]

    def likelihood(w, cut):
        p = toxicity.Model({"bad": 0, "fine": 1}, w, cut).grades([" ".join(["bad"] * dict(r).get(0, 0) + ["fine"] * dict(r).get(1, 0)) for r in rows])
        return np.log(p[np.arange(300), grade]).mean() - 1e-3 * (w @ w)

    best = likelihood(w, cut)
    for _ in range(20):  # near a maximum
        assert likelihood(w + rng.normal(0, 0.3, 2), cut + rng.normal(0, 0.3, 2)) < best + 0.01


def test_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (9, 0, None), (None, 1, 1)], LABELS)
    found = toxicity.query(spark, folder(tmp_path, documents=odd(spark), labels=labels)).collect()
    assert len(found) == 11 and not any(r.is_toxic for r in found)
    assert toxicity.score(empty(spark), toxicity.Model({}, np.zeros(0), np.array([1.0, 2.0]))).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x", 5)], "severity long, text string, word string, toxic long")
    model = toxicity.Model({"idiot": 0}, np.array([9.0]), np.array([1.0, 2.0]))
    row = toxicity.score(docs, model).first()
    assert row.word == "x" and row.toxic == 5 and row.is_toxic and row.severity > 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    found = toxicity.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).select("toxic", "is_toxic", "severity").collect()
    clean = [r for r in found if not r.toxic]
    toxic = [r for r in found if r.toxic]
    assert sum(r.is_toxic for r in clean) <= 0.01 * len(clean)
    assert sum(r.is_toxic for r in toxic) >= 0.8 * len(toxic)


def brute_features(text):
    own = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = Counter(own)
    for n in (5, 6, 7):
        out.update("^" + w[:n] for w in own if len(w) > n)
    out.update({"^" + k: 1 for k, c in list(out.items()) if k[0] == "^" and c > 1})
    return out


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels, most_words=None)
    toxic = {r.doc_id: r.toxic > 0 for r in labels.collect() if r.toxic is not None}
    rows = {r.doc_id: brute_features(r.text) for r in docs.collect()}
    held = [Counter(k for i, f in rows.items() if toxic.get(i) is side for k in f) for side in (False, True)]
    n = [sum(toxic.get(i) is side for i in rows) for side in (False, True)]
    telling = set()
    for w in held[0].keys() | held[1].keys():
        b, a = held[0][w] + 0.5, held[1][w] + 0.5
        z = (math.log(a / (n[1] + 1 - a)) - math.log(b / (n[0] + 1 - b))) / math.sqrt(1 / a + 1 / b)
        if held[0][w] + held[1][w] >= 5 and abs(z) >= toxicity.TELLING:
            telling.add(w)
    assert model.index.keys() == telling and len(telling) > 5
    for r in toxicity.score(docs, model).collect():
        s = sum(model.weights[model.index[k]] * math.log1p(c) for k, c in rows[r.doc_id].items() if k in model.index)
        below = [1 / (1 + math.exp(min(50, max(-50, s - t)))) for t in model.thresholds]
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert math.isclose(r.severity, p[1] + 2 * p[2], abs_tol=1e-9) and math.isclose(r.p_toxic, 1 - p[0], abs_tol=1e-9)
        assert r.is_toxic == (1 - p[0] > 0.5) and r.grade == p.index(max(p))


def test_empty_tables(spark, tmp_path):
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS)
    for name, docs, labels in (("a", empty(spark), some), ("b", odd(spark), some.limit(0)), ("c", empty(spark), some.limit(0))):
        (tmp_path / name).mkdir()
        found = toxicity.query(spark, folder(tmp_path / name, documents=docs, labels=labels)).collect()
        assert len(found) == docs.count() and not any(r.is_toxic for r in found)


def test_samples_stay_within_their_bounds_where_one_id_has_most_rows(spark):
    rows = [(7, f"plain words {i}", "x") for i in range(300)] + [(i, "you awful idiot", "x") for i in range(1, 6)] + [(None, "lost", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    labels = spark.createDataFrame([(7, 1, 0), *((i, 1, 1) for i in range(1, 6))], LABELS)
    sample = docs.dropDuplicates(["text"]).select("text")
    assert bounded(sample, 40, 1 << 20).count() == 40 and bounded(sample, 400, 1 << 20).count() == 302
    assert bounded(sample, 400, 500).agg({"text": "count"}).first()[0] < 50 and bounded(sample, 400, 0).count() == 0
    model = toxicity.fit(docs, labels)
    assert model.grades(["you idiot"])[0, 0] < 0.5 < model.grades(["plain words"])[0, 0]
    assert toxicity.fit(docs, labels, most_bytes=0).index == {}


def test_more_features_than_512_are_kept(spark):
    rows = [(i, " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)), a) for i, a in enumerate("xy" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    labels = docs.selectExpr("doc_id", "1 quality", "cast(kind = 'x' as int) toxic")
    assert len(toxicity.fit(docs, labels).index) == 1200 and len(toxicity.fit(docs, labels, most_words=10).index) == 10
