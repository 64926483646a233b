"""SimHash fingerprints, linked within a radius by bit-sliced comparison, and near-copy groups.

Fingerprints are compared where some `BLOCKS - radius` of their BLOCKS blocks of 8 bits agree (pigeonhole: at most
`radius` blocks can differ), so a bucket of radius 2 holds fingerprints that differ in 16 known bits only: at most
65,536 distinct ones, however many documents there are. Documents are first reduced to distinct fingerprints.
Within a bucket the fingerprints stand vertically, one word a bit plane and 64 of them; a query's distances to all
64 are counted at once with carry-save counters, and words whose 64 counters all passed the radius are given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, components, free_names, prepare, strings, table, written

SEED, BLOCKS, MOST_RADIUS = 42, 8, 3
#: Bits at which a similarity of 0.8 lies on average, and buckets by which near copies are looked for in the pipeline.
NEAR, BANDS = 10, 8
#: Bits within which two texts of a bucket may be near copies, and the similarity (4 of 5) that makes them so.
CANDIDATES, ALIKE = 22, (4, 5)
#: One text in SAMPLE is looked at for common shingles: those of OFTEN of these texts or more, the most frequent MOST_COMMON.
SAMPLE, OFTEN, MOST_COMMON = 16, 4, 100_000
_ORDERS = [xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(2 * BANDS)]
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every run of `width` words, repeats included; of the whole sequence where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    return [h(line[s:e], SEED) for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def hash_arrays(texts: list[str], width: int) -> list[np.ndarray]:
    return [np.array(shingle_hashes(t, width), np.uint64) for t in texts]


def fingerprints(own: list[np.ndarray]) -> np.ndarray:
    """Of each text's hashes: a bit is set where over half of them have it; zero without words."""
    out = np.zeros(len(own), np.uint64)
    full = [i for i, x in enumerate(own) if len(x)]
    for i in range(0, len(full), 64):
        some = full[i : i + 64]
        sizes = np.array([len(own[j]) for j in some])
        flat = np.concatenate([own[j] for j in some])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        counts = np.add.reduceat(np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp long) of docs(doc_id, text)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(hash_arrays(strings(b.column(1)), width)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def within(queries: np.ndarray, word: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each lane (a query and a word of 64 fingerprints): the bits of those within the radius.

    planes: (64, words) uint64, bit planes. Carry-save counters of one, two, four and so on and a flag for what passes them
    are kept for 64 fingerprints a word; every eighth plane, lanes in which all have passed the radius are abandoned.
    """
    found = np.zeros(len(queries), np.uint64)
    lane, q, w = np.arange(len(queries)), queries, word
    counters = [np.zeros(len(queries), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(queries), np.uint64)

    def passed() -> np.ndarray:
        more, same = over, np.full(len(over), _ALL)
        for i in range(len(counters) - 1, -1, -1):
            if radius >> i & 1:
                same = same & counters[i]
            else:
                more, same = more | (same & counters[i]), same & ~counters[i]
        return more

    for p in range(64):
        carry = planes[p][w] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over = over | carry
        if p % 8 == 7 and p < 63:
            live = (passed() & valid[w]) != valid[w]
            if not live.all():
                lane, q, w, over = (x[live] for x in (lane, q, w, over))
                counters = [c[live] for c in counters]
                if not len(lane):
                    return found
    found[lane] = ~passed() & valid[w]
    return found


def _planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of words of 64 fingerprints, and which bits of each word stand for one."""
    words = -(-len(fps) // 64)
    full = np.zeros(words * 64, np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(64, words, 64), axis=2, bitorder="little")).view("<u8").reshape(64, words)
    there = np.zeros(words * 64, np.uint8)
    there[: len(fps)] = 1
    return planes, np.packbits(there.reshape(words, 64), axis=1, bitorder="little").view("<u8").ravel()


def link_large(fps: np.ndarray, radius: int, lanes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the linked fingerprints of one bucket: searches outwards from a root among those not yet reached."""
    left, members, roots = fps, [], []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            planes, valid = _planes(left)
            reached = np.zeros(len(valid), np.uint64)
            step = max(1, lanes // len(valid))
            for i in range(0, len(frontier), step):
                q = np.repeat(frontier[i : i + step], len(valid))
                w = np.tile(np.arange(len(valid)), len(q) // len(valid))
                reached |= np.bitwise_or.reduce(within(q, w, planes, valid, radius).reshape(-1, len(valid)), axis=0)
            hit = np.unpackbits(reached.astype("<u8").view(np.uint8), bitorder="little")[: len(left)].astype(bool)
            frontier, left = left[hit], left[~hit]
            members.append(frontier)
            roots.append(np.full(len(frontier), root))
    return (np.concatenate(members), np.concatenate(roots)) if members else (fps[:0], fps[:0])


def link_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """As link_large, for many buckets of at most 64 at once, one word each."""
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = fps[np.repeat(starts, sizes) + place]
    full = np.zeros(len(starts) * 64, np.uint64)
    full[group * 64 + place] = own
    planes, _ = _planes(full)
    valid = np.where(sizes == 64, _ALL, (np.uint64(1) << (sizes.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
    near = (within(own, group, planes, valid, radius) & ~(np.uint64(1) << place.astype(np.uint64))).tolist()
    members, roots = [], []
    at = 0
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        adj, left = near[at : at + size], (1 << size) - 1
        at += size
        if not any(adj):
            continue
        while left:
            low = left & -left
            root = start + low.bit_length() - 1
            left ^= low
            frontier = adj[low.bit_length() - 1] & left
            while frontier:
                bit = frontier & -frontier
                frontier ^= bit
                left ^= bit
                members.append(start + bit.bit_length() - 1)
                roots.append(root)
                frontier |= adj[bit.bit_length() - 1] & left
    return fps[members], fps[roots]


def edges(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect what the radius connects, of distinct fingerprints fps(fp): at most one a member and bucket."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius must be 0 to {MOST_RADIUS}")
    spark = fps.sparkSession
    masks = []
    for gone in combinations(range(BLOCKS), radius):
        mask = sum(0 if b in gone else 0xFF << (8 * b) for b in range(BLOCKS))
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("t", "mask")).select("fp", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
    return edges_of(keyed, radius)


def edges_of(keyed: DataFrame, radius: int, distinct: bool = True) -> DataFrame:
    """(a, b): links within the radius among the fingerprints of each bucket k of keyed(fp, k), whose rows are distinct or made so."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "k", 50_000):
            k, fp = t.column("k").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            small = (sizes > 1) & (sizes <= 64)
            found = [link_small(fp, starts[small], sizes[small], radius)] if small.any() else []
            found += [link_large(fp[s : s + n], radius) for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True)]
            if found:
                a, b = (np.concatenate([f[i] for f in found]).astype(np.uint64).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = keyed.repartition(parts, "k")
    return (dealt if distinct else dealt.distinct()).sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def _roots(own: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint in own(fp)."""
    distinct = written(own.select("fp").distinct(), "distinct-fingerprints")
    found = components(edges(distinct, radius))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text, ...).

    component_id is the least doc_id that links of at most `radius` differing bits reach, itself included. Null text:
    empty, fingerprint zero, linked like any other. Rows of a null doc_id take part and get the least id of their
    group, null if it has none. Repeated rows stay. Equal fingerprints are one node, so copies cost one row each.
    """
    own = written(with_fingerprint(docs, width), "fingerprints")
    with_root = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_roots(own, radius), "fp"), "rooted-fingerprints")
    of_root = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(with_root.join(of_root, "root").select("fp", "component_id"), "components")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def bands(own: list[np.ndarray]) -> list[list[int]]:
    """BANDS numbers of each text's hashes, each from the least in two orders: texts whose shingle sets have a
    Jaccard similarity of s share one with probability 1 - (1 - s * s) ** BANDS, 0.9997 at 0.8. Without words all zero."""
    out = np.zeros((len(own), BANDS), np.uint64)
    full = [i for i, x in enumerate(own) if len(x)]
    if full:
        flat = np.concatenate([own[i] for i in full])
        starts = np.cumsum([0, *(len(own[i]) for i in full[:-1])])
        for b in range(BANDS):
            one, two = (np.minimum.reduceat((flat ^ (flat >> np.uint64(29))) * np.uint64(_ORDERS[2 * b + i]), starts) for i in (0, 1))
            out[full, b] = (one * np.uint64(0x9E3779B97F4A7C15) ^ two) + np.uint64(b)
    return out.view(np.int64).tolist()


def leading(n: np.ndarray) -> np.ndarray:
    """How many elements of sets of n, first in an order that all sets follow, hold one that a set alike to them leads with too."""
    return np.where(n > 0, n - -(-n * ALIKE[0] // ALIKE[1]) + 1, 0)


def leads(own: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The leading elements of a sorted set: common shingles (sorted, with their ranks) come last, the most frequent at the end."""
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, ranks[at] + 1, 0)
    return own[np.argsort(rank, kind="stable")[: int(leading(np.array(len(own))))]]


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of texts(text, ...) hold, sorted, and their ranks, the most frequent last. Only costs depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(x) for x in hash_arrays(strings(b.column(0)), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = often.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], len(found) - order


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the sets the number of the first of its component; sets of a Jaccard similarity of 0.8 are linked.

    Searches outwards from a root as link_large. A set is compared with those not yet reached that share one of its leading
    elements, rarest first, and whose sizes allow it; sets that are alike do.
    """
    out, n = np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    out[n == 0] = np.flatnonzero(n == 0)[:1].sum()
    ids, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    order = np.argsort(count := np.bincount(flat, minlength=len(ids)), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    starts, owner = np.cumsum(n) - n, np.repeat(np.arange(len(sets), dtype=np.int32), n)
    flat = np.sort((owner.astype(np.int64) << 32) | rank[flat])  # by set, rarest first
    flat = (flat & 0xFFFFFFFF).astype(np.int32)
    # places of elements that lead a set, and that another set holds too
    lead = (np.arange(len(flat)) - starts[owner] < leading(n)[owner]) & (count[order][flat] > 1)
    element, holder = flat[lead], owner[lead]
    own = np.split(element, np.cumsum(np.bincount(holder, minlength=len(sets)))[:-1]) if len(sets) else []
    by = np.argsort(element, kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(element[by]) != 0))) if len(element) else []
    holders = dict(zip(element[by][firsts].tolist(), np.split(holder[by], firsts[1:]), strict=True)) if len(element) else {}
    left, mark = n > 0, np.zeros(len(ids), bool)
    for root in np.flatnonzero(left).tolist():
        frontier = [root] if left[root] else []
        left[root] = False
        while frontier:
            one = frontier.pop()
            near = [np.zeros(0, np.int64)]
            for e in own[one].tolist():
                some = holders[e][left[holders[e]]]
                if 2 * len(some) <= len(holders[e]):
                    holders[e] = some  # those reached need not be passed over again
                near.append(some)
            near = np.unique(np.concatenate(near))
            near = near[(n[near] * ALIKE[1] >= n[one] * ALIKE[0]) & (n[one] * ALIKE[1] >= n[near] * ALIKE[0])]
            if not len(near):
                continue
            size = n[near]
            ends = np.cumsum(size)
            mark[flat[starts[one] : starts[one] + n[one]]] = True
            both = np.add.reduceat(mark[flat[np.repeat(starts[near] - ends + size, size) + np.arange(ends[-1])]], ends - size, dtype=np.int64)
            mark[flat[starts[one] : starts[one] + n[one]]] = False
            hit = near[both * ALIKE[1] >= (size + n[one] - both) * ALIKE[0]]
            out[hit], left[hit] = root, False
            frontier += hit.tolist()
    return out


def _verified(texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cls, first): the components of classes(cls, one, root) by the similarity of their shingle sets, within each root."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = classes.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    wanted = classes.join(several, "root").select("root", "cls", "one.key", "one.hash")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(x).tobytes() for x in hash_arrays(strings(b.column(2)), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary())], ["root", "cls", "own"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "root", 2_000):
            root, cls, own = t.column("root").to_numpy(), t.column("cls").to_pylist(), t.column("own")
            starts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
            for s, e in zip(starts, starts[1:], strict=False):
                first = alike([np.frombuffer(x.as_py(), np.uint64) for x in own[s:e]])
                yield pa.RecordBatch.from_arrays([pa.array(cls[s:e], pa.binary()), pa.array([cls[s + i] for i in first.tolist()], pa.binary())], ["cls", "first"])

    own = texts.join(wanted, ["key", "hash"]).select("root", "cls", "text").dropDuplicates(["cls"])  # repeated rows are alike
    members = own.mapInArrow(sets, "root long, cls binary, own binary")
    return members.repartition(parts, "root").sortWithinPartitions("root", "cls").mapInArrow(link, "cls binary, first binary")


def one_of_each(docs: DataFrame, width: int = 5, radius: int = CANDIDATES) -> DataFrame:
    """One row of docs, with its columns, for each group: that of the least doc_id (a null one last), the least hash of ties.

    Groups are the components of the texts whose shingle sets have a Jaccard similarity of 0.8 or more. Texts with a fingerprint
    within `radius` in a bucket of `bands` are candidates. Those of a common line are so by chance, the more the larger the
    table; candidates are therefore grouped by fingerprints within `radius` in the buckets of the shingles that lead their
    sets, rare ones first, of which alike sets share one. Within each group sets are compared. Texts of equal sets are one
    class, of which one set is compared.
    """
    names = docs.columns
    key, row = free_names(names, "key", "row")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias(key), F.xxhash64(*[F.col(f"`{n}`") for n in names]).alias(row))
    texts = keyed.select(F.col(key).alias("key"), F.col(row).alias("hash"), F.col("text").cast("string").alias("text"))
    prepare(docs.sparkSession)
    common, ranks = common_shingles(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = hash_arrays(strings(b.column(2)), width)
            sets = [np.unique(x) for x in own]
            cls = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            lead = [leads(x, common, ranks).view(np.int64) for x in sets]
            cells = (pa.array(fingerprints(own).view(np.int64)), pa.array(bands(sets), pa.list_(pa.int64())), pa.array(lead, pa.list_(pa.int64())), pa.array(cls, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], ["key", "hash", "fp", "bands", "leads", "cls"])

    own = written(texts.mapInArrow(run, "key long, hash long, fp long, bands array<long>, leads array<long>, cls binary"), "fingerprints")
    classes = written(own.groupBy("cls").agg(F.min("fp").alias("fp"), F.min(F.struct("key", "hash")).alias("one")), "classes")
    # a class has several fingerprints where its shingles are repeated differently
    same = written(own.select("cls", F.col("fp").alias("a")).join(classes.select("cls", F.col("fp").alias("b")), "cls").where("a <> b").select("a", "b").distinct(), "same")
    near = edges_of(own.select("fp", F.explode("bands").alias("k")).distinct(), radius)
    near = written(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "near")
    links = edges_of(own.join(near, "fp", "left_semi").select("fp", F.explode("leads").alias("k")), radius, distinct=False).unionByName(same)
    found = components(links).withColumnRenamed("node", "fp")
    classes = written(classes.join(found, "fp", "left").select("cls", "one", F.coalesce("root", "fp").alias("root")), "candidates")
    first = written(_verified(texts, classes, width), "verified")
    kept = classes.join(first, "cls", "left").groupBy(F.coalesce("first", "cls").alias("first")).agg(F.min("one").alias("one")).select(F.col("one.key").alias(key), F.col("one.hash").alias(row))
    # repeated rows are alike in both: one of them stays
    return keyed.join(written(kept, "kept"), [key, row], "left_semi").dropDuplicates([key, row]).select(*[F.col(f"`{n}`") for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of 3-word shingles, linked at two bits or fewer."""
    found = near_groups(table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
