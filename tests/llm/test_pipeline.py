import corpus_pipeline
from newsmill.llm import simhash, toxicity
from newsmill.llm.common import tokenizer_path

from .helpers import empty, folder, odd
from .test_decontaminate import brute_tiles
from .test_pieces import brute as brute_pieces
from .test_suffix import brute as brute_repeats

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def brute_near(sets):
    """The first of each set's component, sets of a Jaccard similarity of 0.8 being linked."""
    roots = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4 and roots[i] != roots[j]:
                least, most = sorted((roots[i], roots[j]))
                roots = [least if r == most else r for r in roots]
    return roots


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d).cache()
        steps.append(now)
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [sorted(s.collect(), key=lambda r: r.doc_id) for s in steps]
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert [r.doc_id for r in rows[1]] == [r.doc_id for r in rows[0] if 1 - model.grades([r.text])[0][0] <= toxicity.CUT]
    roots = brute_near([set(simhash.shingle_hashes(r.text, 5)) for r in rows[1]])
    assert [r.doc_id for r in rows[2]] == [r.doc_id for i, r in enumerate(rows[1]) if roots[i] == i]
    cut = brute_repeats([r.text for r in rows[2]], 200)
    left = {r.doc_id: (n, gone) for r, (n, gone, _, _) in zip(rows[2], cut, strict=True)}
    assert {r.doc_id for r in rows[3]} >= {k for k, (n, gone) in left.items() if n > gone + 3}
    for r in rows[3]:
        n, gone = left[r.doc_id]
        assert abs(len(r.text.encode()) - (n - gone)) <= 8 and r.n_chars == len(r.text)
    items = [toks for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if len(toks := corpus_pipeline.decontaminate.tokens(r.text)) >= 5]
    gone = {r.doc_id for r in rows[3]} - {r.doc_id for r in rows[4]}
    for r in rows[3]:
        own = corpus_pipeline.decontaminate.tokens(r.text)
        shared = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
        near = [i for i in items if sum(tuple(i[j : j + 5]) in shared for j in range(len(i) - 4)) * 5 >= len(i) / 2]
        assert (r.doc_id in gone) == any(sum(k for *_, k in brute_tiles(i, own, 5)) >= len(i) / 2 for i in near)
    assert {r.doc_id: r.ids for r in rows[5]} == {r.doc_id: brute_pieces(r.text) for r in rows[4]}
    assert all(r.round_trip for r in rows[5])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == [r.doc_id for r in rows[5]]


def test_odd_and_empty_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, "nothing like the others at all"), (2, None)], ITEMS)
    d = folder(tmp_path, documents=odd(spark), labels=labels, benchmark=bench)
    found = corpus_pipeline.run(spark, d).collect()
    # blank texts are one group, the three equal texts another; one letter over and over (7) is all repeats
    assert sorted((r.doc_id or 0) for r in found) == [0, 1, 2, 5, 8, 9]
    (tmp_path / "e").mkdir()
    d = folder(tmp_path / "e", documents=empty(spark), labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, d).collect() == []
    assert tokenizer_path("piece_bpe_32k.model")


def test_near_copies_go_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()}
    own = {r.doc_id: set(simhash.shingle_hashes(r.text, 5)) for r in docs.collect()}
    like = lambda a, b: len(own[a] & own[b]) / max(1, len(own[a] | own[b])) if own[a] or own[b] else 1.0
    gone = set(own) - kept
    assert all(max(like(d, o) for o in own if o != d) >= 0.8 for d in gone)
    assert not [(a, b) for a in kept for b in kept if a < b and own[a] & own[b] and like(a, b) >= 0.8]
    assert len(gone) > 70
