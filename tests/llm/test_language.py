import math
import pickle
import re
import zlib
from collections import Counter

import pytest

from newsmill.llm import language
from newsmill.llm.common import WordCache

from .helpers import empty, folder, odd


def test_words_come_before_grams():
    model = language.Model(["a", "b"], {"cat": {0: 1.0}}, {"ca": {1: 1.0}, "d": {0: 2.0, 1: 3.0}}, 2)
    assert model.cost("cat").tolist() == [1.0, 7.0]
    assert model.cost("car").tolist() == [7.0, 1.0]
    assert model.cost("dx").tolist() == [2.0, 3.0]
    assert model.cost("zz").tolist() == [7.0, 7.0]
    assert model.predict(["cat cat", "", "12 --", "½ ²"], WordCache(model.cost))[0] == ["a", "und", "und", "und"]


def test_odd_rows(spark, tmp_path):
    found = language.query(spark, folder(tmp_path, documents=odd(spark))).collect()
    assert len(found) == 11
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {"en", "de", "fr", "und"}


def test_empty(spark, tmp_path):
    assert language.query(spark, folder(tmp_path, documents=empty(spark))).collect() == []


def test_held_out_accuracy_and_counts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = language.query(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    rows = docs.where(~language.held_out(docs.doc_id)).collect()
    model = language.fit(docs.where(~language.held_out(docs.doc_id)))
    en = [w for r in rows if r.lang == "en" for w in language.words(r.text)]
    assert math.isclose(model.words["the"][model.languages.index("en")], -math.log10(en.count("the") / len(en)))


def brute(rows, most):
    """doc_id -> (language, score), from rows(doc_id, text, lang) by the rules alone."""
    found = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    cut = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts = {}
    for d, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(d).encode()) % 5:
            for w in found(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in (1, 2, 3, 4):
                    counts.setdefault((lang, n), Counter()).update(cut(w, n))
    langs = sorted({lang for lang, _ in counts})
    sizes = {k: sum(c.values()) for k, c in counts.items()}
    kept = {}
    for lang in langs:
        some = sorted(((-n, g, k) for k in (1, 2, 3, 4) for g, n in counts[lang, k].items()))[:most]
        kept[lang] = {w for _, w in sorted((-n, w) for w, n in counts[lang, 0].items())[:most]}, {g for _, g, _ in some}

    def costs(w):
        if any(w in kept[g][0] for g in langs):
            return [-math.log10(counts[g, 0][w] / sizes[g, 0]) if w in kept[g][0] else 7.0 for g in langs]
        for n in (4, 3, 2, 1):
            own = [x for x in cut(w, n) if any(x in kept[g][1] for g in langs)]
            if own:
                return [sum(-math.log10(counts[g, n][x] / sizes[g, n]) if x in kept[g][1] else 7.0 for x in own) / len(own) for g in langs]
        return [7.0] * len(langs)

    memo, out = {}, {}
    for d, text, _ in rows:
        own = found(text or "")
        each = [memo.get(w) or memo.setdefault(w, costs(w)) for w in own]
        if not own:
            out[d] = "und", 0.0
            continue
        mean = [sum(c[i] for c in each) / len(each) for i in range(len(langs))]
        share = [10.0 ** (min(mean) - m) for m in mean]
        out[d] = langs[mean.index(min(mean))], max(share) / sum(share)
    return out


@pytest.mark.parametrize("most", [60, 20_000])
def test_against_brute_force(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    want = brute([tuple(r) for r in docs.collect()], most)
    model = language.fit(docs.where(~language.held_out(docs.doc_id)), most_words=most, most_grams=most)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert found.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert found[d].lang_pred == lang and math.isclose(found[d].score, score, abs_tol=1e-9)


def test_no_bound_keeps_all_and_repeated_rows_count_once(spark):
    rows = [(1, "one two two", "en"), (1, "one two two", "en"), (2, "eins zwei", "de"), (None, "never seen", "en"), (3, None, "fr"), (4, "neither", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=None, most_grams=None)
    assert model.languages == ["de", "en"] and model.words.keys() == {"one", "two", "eins", "zwei"}
    assert math.isclose(model.words["two"][1], -math.log10(2 / 3))


def test_a_small_cache_and_many_words_at_once_change_nothing():
    model = language.Model(["a", "b"], {"cat": {0: 1.0}}, {"ca": {1: 1.0}, "d": {0: 2.0, 1: 3.0}}, 2)
    texts = ["cat car dx zz", "dx dx cat", "car zz " * 3, "zz", "½ cat"]
    alone = [model.predict([t], WordCache(model.cost)) for t in texts]
    for most in (1, 2, 100):
        langs, scores = model.predict(texts, WordCache(model.cost, most))
        assert langs == [x[0] for x, _ in alone] and scores == [y[0] for _, y in alone]
    assert model.costs([]).shape == (0, 2)


def test_tasks_get_the_tables_and_give_the_same_answers():
    model = language.Model(["a", "b"], {"cat": {0: 1.0}}, {"ca": {1: 1.0}, "d": {0: 2.0, 1: 3.0}}, 2)
    sent = pickle.loads(pickle.dumps(model))
    texts = ["cat car dx zz", "dx dx cat", "zz", ""]
    assert sent.words == {} and sent.predict(texts, sent.cache) == model.predict(texts, WordCache(model.cost))


def test_all_words_of_a_sample_are_kept_and_its_bytes_are_bounded(spark):
    named = lambda a, i: f"{a}{i}".translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, " ".join(named("x", 100 * i + k) for k in range(100)), "en") for i in range(250)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(train).words) == 25_000
    assert 0 < len(language.fit(train, most_bytes=20_000).words) < 5_000
