import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import suffix

from .helpers import ODD, empty, odd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = bytes(gone).replace(b"\0", b" ").split()
        out.append((len(r), len(r) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes_are_sorted():
    rng = random.Random(4)
    for letters, n in ((1, 60), (2, 300), (4, 500), (60, 400)):
        text = bytes(rng.randrange(letters) for _ in range(n))
        text += text[: n // 2] + text[n // 3 :]
        buf = np.frombuffer(text + bytes(80), np.uint8)
        starts = np.array(rng.sample(range(len(text)), len(text) // 2))
        order, lcp = suffix.suffix_order(buf, starts, 50, 16)
        cut = [bytes(buf[s : s + 50]) for s in starts[order]]
        assert cut == sorted(cut) and sorted(order) == list(range(len(starts)))
        for a, b, k in zip(cut, cut[1:], lcp[1:].tolist(), strict=False):
            assert k == next((i for i in range(50) if a[i] != b[i]), 50)


def passages(rng, n):
    some = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(30, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(some)[rng.randrange(20) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))
        out.append(text)
    return [*out, "a" * 200, "ab" * 150, "", None, out[0], out[0]]


def test_against_brute_force(spark):
    for seed, length in ((1, 40), (2, 25), (3, 60)):
        texts = passages(random.Random(seed), 60)
        docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, spans string")
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, length).collect()}
        assert found == dict(enumerate(brute(texts, length)))
        assert any(r[1] for r in found.values()) and any(r[0] > r[1] > 0 for r in found.values())


def test_lengths_beyond_a_byte(spark):
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300, 1500))) for _ in range(4)]
    texts = ["".join(rng.choice(common)[rng.randrange(200) : rng.randrange(500, 1500)] if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(100)) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (286, 287, 400):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, length).collect()}
        assert found == dict(enumerate(brute(texts, length))) and any(r[0] > r[1] > 0 for r in found.values())
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs, 1 << 24)


def test_very_many_repeated_rows(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(1, text[:2500] + "x" * 150), (2, "own " * 40)], "doc_id long, text string"))
    start = time.perf_counter()
    found = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans): r.n for r in suffix.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").agg(F.count("*").alias("n")).collect()}
    assert found == {(None, 3000, 3000, 1): 5000, (1, 2650, 2500, 1): 1, (2, 160, 0, 0): 1}
    assert time.perf_counter() - start < 60


def test_odd_rows(spark):
    found = suffix.remove_repeats(odd(spark), 20).collect()
    want = brute([r[1] for r in ODD], 20)
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found))) == sorted(str((o[0], *w)) for o, w in zip(ODD, want, strict=True))
    assert suffix.remove_repeats(empty(spark)).collect() == []


def test_driver_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.query(spark, d).collect()}
    assert found == dict(zip((r.doc_id for r in rows), brute([r.text for r in rows], 200), strict=True))
