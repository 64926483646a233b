import random

import numpy as np

from newsmill.llm import simhash


def test_near_copies_are_those_of_like_shingle_sets(spark):
    rng = random.Random(12)
    rows = []
    for family in range(120):  # one text and a copy of it from which words are cut at the end: similarities of 0.5 to 1
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))]
        rows += [(2 * family, " ".join(words)), (2 * family + 1, " ".join(words[: int(len(words) * rng.uniform(0.5, 1))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {k: set(simhash.shingle_hashes(t, 5)) for k, t in rows}
    pairs = [len(own[k] & own[k + 1]) / len(own[k] | own[k + 1]) for k in range(0, len(rows), 2)]
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {k for k in own if k % 2 == 0 or pairs[k // 2] < 0.8}


def test_no_like_pair_stays_and_none_goes_without_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()}
    own = {r.doc_id: set(simhash.shingle_hashes(r.text, 5)) for r in docs.collect()}
    linked = lambda a, b: len(own[a] & own[b]) * 5 >= len(own[a] | own[b]) * 4
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    assert all(any(linked(d, o) for o in own if o != d) for d in set(own) - kept)


def test_components_of_sets():
    rng = random.Random(5)
    sets = [set(), {1}, set(), {1}]
    for _ in range(30):
        base = rng.sample(range(10**6), rng.randrange(5, 40))
        sets += [{x if rng.random() < 0.95 else rng.randrange(10**6) for x in base} for _ in range(rng.randrange(1, 6))]
    roots = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) * 5 >= len(a | b) * 4:
                    roots[i] = roots[j] = min(roots[i], roots[j])
    assert simhash.alike([np.array(sorted(s), np.uint64) for s in sets]).tolist() == roots


def test_sets_with_common_elements():
    rng = random.Random(6)
    common, sets = rng.sample(range(10**6), 60), [set()]
    for _ in range(40):
        base = [*rng.sample(common, rng.randrange(60)), *rng.sample(range(10**6), rng.randrange(1, 40))]
        sets += [{x if rng.random() < 0.94 else rng.randrange(10**6) for x in base} for _ in range(rng.randrange(1, 6))]
    roots = brute_roots(sets)
    assert simhash.alike([np.array(sorted(s), np.uint64) for s in sets]).tolist() == roots
    assert len(set(roots)) < len(sets) - 20
    # alike sets share one of the elements that lead them, whichever count as common
    order = rng.sample(common, 40)
    by = np.argsort(np.array(order, np.uint64))
    lead = [set(simhash.leads(np.array(sorted(s), np.uint64), np.array(sorted(order), np.uint64), by).tolist()) for s in sets]
    assert all(lead[i] & lead[j] for i, a in enumerate(sets) for j, b in enumerate(sets) if a and len(a & b) * 5 >= len(a | b) * 4)


def brute_roots(sets):
    roots = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4 and roots[i] != roots[j]:
                least, most = sorted((roots[i], roots[j]))
                roots = [least if r == most else r for r in roots]
    return roots


def test_a_common_line_does_not_gather_texts(spark, monkeypatch):
    rng = random.Random(7)
    line = " ".join(f"line{i}" for i in range(16))
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(25)), line]) for _ in range(1500)]
    rows = list(enumerate([*texts, *(t + " more" for t in texts[:50])]))
    sizes, written = [], simhash.written

    def seen(df, name, **options):
        found = written(df, name, **options)
        if name == "candidates":
            sizes.extend(r["count"] for r in found.groupBy("root").count().collect())
        return found

    monkeypatch.setattr(simhash, "written", seen)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(1500))
    assert max(sizes) <= 4
