import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import phrases

from .helpers import ODD, empty, odd


def plain(rows, least, top=2000):
    """Brute force by Python's integers."""
    total, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in some.items():
            gone |= {p[i : i + n] for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * a >= 80 * f[p[i : i + n]]}
        ranked = []
        for p, a in some.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, lf, rf, total[lang], -score) for i, (score, a, p, lf, rf) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def check(found, rows, least, top=2000):
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, least, top)


def made(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "x-y", "🙂", "longer", "q"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice([text, text, None, "b b b b b b"]), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


def test_against_brute_force(spark):
    for seed, least, words in ((1, 3, 50), (2, 8, 1_000_000), (3, 2, 1)):
        rows = made(seed, 120)
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
        check(phrases.mined(docs, least, words=words), rows, least)
        assert plain(rows, least)


def test_ranks_end_at_the_top(spark):
    rows = made(4, 80)
    check(phrases.mined(spark.createDataFrame(rows, "text string, lang string"), 2, 7), rows, 2, 7)


def test_a_saturated_bitmap_changes_nothing(spark):
    rows = made(5, 60)
    own = phrases.pieces(spark.createDataFrame(rows, "text string, lang string"))
    full = bytes([255]) * (1 << (phrases.BITS - 3))
    bits = phrases.bitmap(phrases.frequent(own, 1, None, 4))
    assert 0 < sum(map(int.bit_count, bits)) < 60
    one, two = (sorted(map(tuple, phrases.frequent(own, 2, b, 4).collect())) for b in (full, bits))
    assert one == two and one


def test_buckets_are_added_up_out_of_core():
    rng = np.random.default_rng(1)
    names = np.array([f"phrase number {i} of some length" for i in range(40_000)])
    batches, want = [], Counter()
    for _ in range(25):
        own, f = rng.integers(0, len(names), 20_000), rng.integers(1, 1 << 40, 20_000)
        batches.append(pa.RecordBatch.from_pydict({"lang": ["en"] * len(own), "phrase": names[own].tolist(), "f": f}))
        for i, x in zip(own.tolist(), f.tolist(), strict=True):
            want[names[i]] += x
    got = {p: f for b in phrases._added_up(iter(batches), 1 << 43, "24MB") for p, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert got == {p: f for p, f in want.items() if f >= 1 << 43} and got


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b c", big - 3), ("en", "a b", big - 2), ("en", "b c", big), ("en", "a", big + 7), ("en", "b", big + 8), ("en", "c", big + 9)], "lang string, phrase string, f long")
    got = {r.phrase: r for r in phrases.scored(counts).collect()}
    assert got["a b c"].score == min(2_000_000 * (big - 3) // (2 * big + 7), 2_000_000 * (big - 3) // (2 * big + 7)) and (got["a b c"].l, got["a b c"].r) == (big + 7, big)
    assert [r.phrase for r in phrases.standing(phrases.scored(counts)).collect()] == ["a b c"]


def test_odd_rows(spark):
    named = odd(spark).select("*", *[F.lit("x").alias(n) for n in ("piece", "words", "copies", "phrase", "f", "n", "rank", "share")])
    check(phrases.mined(named, 2), [(r[1], r[2]) for r in ODD], 2)
    assert phrases.mined(empty(spark)).collect() == []
    long = "one two three " * 60_000
    check(phrases.mined(spark.createDataFrame([(long, "en"), (long, "en")], "text string, lang string")), [(long, "en")] * 2, 30)
