import random

import numpy as np
import xxhash

from newsmill.llm import simhash

from .helpers import ODD, empty, folder, odd


def brute_fp(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_roots(fps, radius, keys=None):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and (a == b or keys is None or keys[i] & keys[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def planted(n, radius, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64)}
    while len(fps) < n:
        x = rng.choice(list(fps)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(radius + 2)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    return sorted(fps)


def partition(pairs, n):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_bit_sliced_matches_popcount():
    rng = random.Random(3)
    for radius in (0, 1, 2, 3, 4, 7, 10):
        base = rng.getrandbits(64)
        fps = np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))) for _ in range(150)], np.uint64)
        planes, valid = simhash._planes(fps)
        for q in fps[:40]:
            bits = simhash.within(np.full(len(valid), q), np.arange(len(valid)), planes, valid, radius)
            got = np.unpackbits(bits.view(np.uint8), bitorder="little")[:150].astype(bool)
            assert got.tolist() == [(int(q) ^ int(x)).bit_count() <= radius for x in fps]


def test_links_of_buckets():
    for n in (3, 64, 65, 200):
        fps = np.array(planted(n, 2, n), np.uint64)
        at = {int(x): i for i, x in enumerate(fps)}
        want = brute_roots([int(x) for x in fps], 2)
        m, r = simhash.link_large(fps, 2)
        assert partition([(at[int(a)], at[int(b)]) for a, b in zip(m, r, strict=True)], n) == want
        if n <= 64:
            m, r = simhash.link_small(fps, np.array([0]), np.array([n]), 2)
            assert partition([(at[int(a)], at[int(b)]) for a, b in zip(m, r, strict=True)], n) == want


def test_components_over_chains(spark):
    fps = planted(400, 2, 9)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = [found.get(x, x) for x in signed]
    want = brute_roots(fps, 2)
    assert len(set(zip(groups, want, strict=True))) == len(set(groups)) == len(set(want))


def test_odd_rows(spark, tmp_path):
    found = simhash.query(spark, folder(tmp_path, documents=odd(spark))).collect()
    fps = [brute_fp(r[1]) for r in ODD]
    roots = brute_roots(fps, 2)
    least = {k: min((ODD[i][0] for i, r in enumerate(roots) if r == k and ODD[i][0] is not None), default=None) for k in roots}
    want = [(r[0], f"{fp:016x}", least[root]) for r, fp, root in zip(ODD, fps, roots, strict=True)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert simhash.query(spark, folder(tmp_path, documents=empty(spark))).collect() == []


def test_driver_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    fps = [brute_fp(r.text) for r in rows]
    roots = brute_roots(fps, 2) if len(rows) <= 300 else None
    found = {r.doc_id: r for r in simhash.query(spark, d).collect()}
    assert {k: r.fingerprint for k, r in found.items()} == {r.doc_id: f"{fp:016x}" for r, fp in zip(rows, fps, strict=True)}
    if roots:
        assert {k: r.component_id for k, r in found.items()} == {r.doc_id: rows[k].doc_id for r, k in zip(rows, roots, strict=True)}
