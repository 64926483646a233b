import random
import time

import numpy as np

from newsmill.llm import decontaminate as d

from .helpers import empty, odd

ITEMS = "item_id long, text string"


def brute_tiles(item, doc, least):
    """The textbook greedy string tiling: every longest match of free tokens in turn, by item start, then document start."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                best.append((k, i, j))
        top = max((k for k, _, _ in best), default=0)
        if top < least:
            return tiles
        for k, i, j in sorted(best):
            if k == top and not any(a[i : i + k]) and not any(b[j : j + k]):
                tiles.append((i, j, k))
                a[i : i + k] = b[j : j + k] = [True] * k


def test_tiles_match_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(3, 40))]
        doc = [rng.randrange(1, 6) for _ in range(rng.randrange(3, 60))]
        for _ in range(3):
            i = rng.randrange(len(item))
            doc[rng.randrange(len(doc)) : 0] = item[i : i + rng.randrange(3, 15)]
        seeds = np.array([j for j in range(len(doc) - 2) if any(item[i : i + 3] == doc[j : j + 3] for i in range(len(item) - 2))], np.int64)
        item, doc = np.array(item), np.array(doc)
        got = d.tile(item, doc, seeds, 3, d.Hashes(item), d.Hashes(doc)) if len(seeds) else []
        want = brute_tiles(item, doc, 3)
        assert sum(k for *_, k in got) == sum(k for *_, k in want)
        assert sorted(got) == sorted(want)


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_reordered_and_clean(spark):
    rng = random.Random(2)
    item = words(rng, 40)
    moved = item[30:] + words(rng, 3) + item[:15] + words(rng, 2) + item[15:30]
    rows = [
        (1, " ".join(words(rng, 50) + item + words(rng, 50)), "x"), (2, " ".join(words(rng, 2000) + moved + words(rng, 9)).upper(), "x"), (3, " ".join(words(rng, 900)), "x"),
        (4, " ".join(words(rng, 30) + item[:12] + words(rng, 30)), "x"), (5, None, "x"), (None, " ".join(item), None), (6, " ".join(item), ""), (6, " ".join(item), ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (None, " ".join(words(rng, 30)))], ITEMS)
    found = d.leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 7), (1, 7), (2, 7), (6, 7), (6, 7)]
    assert {r.coverage for r in found} == {1.0} and {r.tiles for r in found if r.doc_id == 2} == {3}
    assert d.leaks(empty(spark), bench).collect() == [] == d.leaks(odd(spark), bench.where("item_id < 0")).collect()


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    one = sorted(map(tuple, d.leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, d.leaks(docs, bench).collect())) == one and one


def test_repeated_tokens_do_not_stall():
    start = time.perf_counter()
    for text, item in (("la " * 20_000, "la " * 2_000), ("la la lu " * 7_000, "lu la la la " * 500), (" ".join(f"w{i % 7} w{i % 11}" for i in range(10_000)), " ".join(f"w{i % 11} w{i % 7}" for i in range(1_000)))):
        found = list(d.Block([(1, item, 1)], 5).search(text, 0.5))
        assert [f[0] for f in found] == [0]
    assert time.perf_counter() - start < 6


def test_repeated_items_give_repeated_pairs(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "two three four five six"), (7, "two three four five six"), (8, "two three four five six"), (None, None), (None, None)], ITEMS)
    assert sorted(r.item_id for r in d.leaks(docs, bench).collect()) == [7, 7, 8]
