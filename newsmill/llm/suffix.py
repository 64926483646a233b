"""Removal of byte strings that occur more than once, by deep-shallow suffix sorting in buckets.

Every string of LENGTH bytes belongs to one anchor, the leftmost KGRAM-byte substring of least hash in it, so equal
strings have equal anchors at equal offsets; successive strings with the same anchor form a segment. Spark counts the
anchors by hash: segments whose anchor stands nowhere else hold no repeat; whole segments that are equal (128 bits of
hash) are repeats all through. Segments that share an anchor and differ, at the ends of copied passages, go to the
bucket of their anchor, where all their suffixes are sorted: multikey quicksort by characters of eight bytes to a
shallow depth, then blind tries order the groups that still agree. Neighbours that agree over LENGTH bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, free_names, prepare, table, written

LENGTH, KGRAM, SHALLOW = 200, 32, 32
#: Bytes joined for one pass of hashing; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
#: Bits of a segment's location that hold how many strings it has; a text's bytes are counted in the other 40.
COUNT_BITS = 24
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers for a pass of PASS_BYTES, kept by a worker; those for a longer text are made for it alone.
_tables: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    if n > PASS_BYTES:
        return [_powers(_BASE, n), _powers(_INVERSE, n)]
    if not _tables:
        _tables[:] = _powers(_BASE, PASS_BYTES), _powers(_INVERSE, PASS_BYTES)
    return _tables


def kgram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes: differences of prefix sums of a polynomial, divided by their first power and mixed."""
    powers, inverses = power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * powers[: len(buf)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * inverses[: len(buf) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, from running minima of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def segments(buf: bytes, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text number, first string, strings, anchor hash, content hash) of the segments of texts joined in buf."""
    if len(buf) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    own = kgram_hashes(np.frombuffer(buf, np.uint8), k)
    anchor = sliding_min((own & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(own), dtype=np.uint64), length - k + 1) & np.uint64(0xFFFFFFFF)
    anchor = anchor.astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= ends[doc]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(anchor)])))
    first, count = first[whole[first]], count[whole[first]]
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    content = np.array([digest(view[i : i + n + length - 1]) for i, n in zip(first.tolist(), count.tolist(), strict=True)], np.uint64)
    return doc[first], first - (ends - sizes)[doc[first]], count, own[anchor[first]].view(np.int64), content.view(np.int64)


def suffix_order(buf: np.ndarray, starts: np.ndarray, limit: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the suffixes at `starts`, compared over `limit` bytes.

    Returns (order, lcp): lcp[i] is the common prefix of suffixes order[i - 1] and order[i], `limit` at most. buf needs
    limit + 8 bytes of padding behind the last start.
    """
    n = len(starts)
    chars = np.zeros(max(len(buf) - 7, 0), np.uint64)
    for i in range(8):
        chars = (chars << np.uint64(8)) | buf[i : len(buf) - 7 + i]

    def common(x: np.ndarray) -> np.ndarray:
        """Equal leading bytes of two characters of which x is the (non-zero) exclusive or."""
        out = np.zeros(len(x), np.int64)
        alive = np.ones(len(x), bool)
        for i in range(7):
            alive &= (x >> np.uint64(56 - 8 * i)) & np.uint64(0xFF) == 0
            out += alive
        return out

    order, lcp = np.arange(n), np.full(n, limit, np.int64)
    if n:
        lcp[0] = 0
    # shallow: in each round quicksort the groups that still agree by their next character of eight bytes
    at, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(0, min(shallow, limit), 8):
        if len(at) < 2:
            break
        key = chars[starts[order[at]] + depth]
        by = np.argsort(key) if depth == 0 else np.lexsort((key, group))
        order[at], key, group = order[at][by], key[by], group[by]
        same = group[1:] == group[:-1]
        differ = same & (key[1:] != key[:-1])
        lcp[at[1:][differ]] = np.minimum(depth + common(key[1:][differ] ^ key[:-1][differ]), limit)
        fresh = np.concatenate(([True], differ | ~same))
        group = np.cumsum(fresh)
        keep = np.bincount(group)[group] > 1
        at, group = at[keep], group[keep]
    # deep: a blind trie a group, laid out level by level: its first suffix is a path, the others leave it at their depths
    known = np.full(len(at), min(-(-shallow // 8) * 8, limit), np.int64)
    while len(at):
        fresh = np.concatenate(([True], group[1:] != group[:-1]))
        leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        mine, its = starts[order[at]], starts[order[at[leader]]]
        left, side = np.full(len(at), limit, np.int64), np.zeros(len(at), np.int64)
        live, depth = np.flatnonzero(~fresh), known // 8 * 8
        d = depth[live]
        while len(live):
            a, b = chars[mine[live] + d], chars[its[live] + d]
            x = a ^ b
            off = x != 0
            if off.any():
                out = live[off]
                left[out] = np.minimum(d[off] + common(x[off]), limit)
                side[out] = np.where(left[out] >= limit, 0, np.where(a[off] < b[off], -1, 1))
            d = d + 8
            more = ~off & (d < limit)
            live, d = live[more], d[more]
        rank = np.where(side < 0, left, np.where(side == 0, limit + 1, 2 * limit + 2 - left))
        by = np.lexsort((rank, group))
        order[at], left, side, group, rank = order[at][by], left[by], side[by], group[by], rank[by]
        same = group[1:] == group[:-1]
        parted = same & (rank[1:] != rank[:-1])
        lcp[at[1:][parted]] = np.minimum(left[1:], left[:-1])[parted]
        group = np.cumsum(np.concatenate(([True], ~same | parted)))
        keep = (np.bincount(group)[group] > 1) & (side != 0)
        at, group, known = at[keep], group[keep], left[keep]
    return order, lcp


def repeated(contents: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the strings of `length` bytes that occur more than once among the first counts[i] of each content."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    buf = np.frombuffer(b"".join([*contents, bytes(length + 8)]), np.uint8)
    row = np.repeat(np.arange(len(contents)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, lcp = suffix_order(buf, (np.cumsum(sizes) - sizes)[row] + offset, length)
    again = lcp >= length
    again[:-1] |= again[1:]
    hit = np.sort(order[again])
    return row[hit], offset[hit]


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and 64 bits of its text's hash: rows of one doc_id may differ, repeated rows are alike."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("th"), "doc_id", "text")


def spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(docs with their keys, spans): spans(key, th, spans array<struct<lo, hi>>) are the bytes that repeated strings cover."""
    if not 1 <= length < 1 << COUNT_BITS:
        raise ValueError(f"length must be 1 to {(1 << COUNT_BITS) - 1}")
    spark = docs.sparkSession
    prepare(spark)
    k = min(KGRAM, length)
    keyed = _keyed(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PASS_BYTES):
                    size += len(texts[to])
                    to += 1
                doc, lo, n, ah, sh = segments(b"".join(texts[at:to]), np.array([len(x) for x in texts[at:to]]), length, k)
                if len(doc):
                    # the first string's place, and how many there are in the last bits: a run of one anchor holds fewer than `length`
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ah, sh, key[at:to][doc], th[at:to][doc], (lo << COUNT_BITS) | n)], ["ah", "sh", "key", "th", "loc"])
                at = to

    own = keyed.select("key", "th", "text").mapInArrow(find, "ah long, sh long, key long, th long, loc long")
    # sums by anchor: combined before the shuffle, so a common passage costs a row a task
    shared = own.groupBy("ah").agg(F.count("*").alias("n"), F.min("sh").alias("least"), F.max("sh").alias("most")).where("n > 1").select("ah", (F.col("least") != F.col("most")).alias("mixed"))
    shared = written(shared, "shared-anchors")
    members = written(own.join(shared, "ah"), "shared-segments")
    alike = members.where("not mixed").select("key", "th", "loc")
    mixed = members.where("mixed").select("ah", "sh", "key", "th", "loc")
    classes = written(mixed.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "loc")).alias("one")), "classes")
    alike = alike.unionByName(mixed.join(classes.where("n > 1").select("ah", "sh"), ["ah", "sh"]).select("key", "th", "loc"))
    unpacked = (F.shiftrightunsigned("loc", COUNT_BITS).alias("lo"), F.col("loc").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).alias("n"))
    whole = alike.select("key", *unpacked, "th")
    # the bytes of one segment of each class, from its text
    wanted = classes.select("ah", "one.key", "one.th", "one.loc").select("ah", "key", "th", *unpacked)
    wanted = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("ah", "lo", "n")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows are in one task: their segments are cut once
        for batch in batches:
            for key, th, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, th) in seen:
                    continue
                seen.add((key, th))
                raw = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["ah"] for w in want], pa.int64()), pa.array([key] * len(want), pa.int64()), pa.array([th] * len(want), pa.int64()), pa.array([w["lo"] for w in want], pa.int64()), pa.array([w["n"] for w in want], pa.int64()), pa.array([raw[w["lo"] : w["lo"] + w["n"] + length - 1] for w in want], pa.binary())],
                    ["ah", "key", "th", "lo", "n", "content"],
                )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "ah", 10_000):
            row, offset = repeated(t.column("content").to_pylist(), t.column("n").to_numpy(), length)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate((first, [len(row)])))
            at = row[first]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("key").to_numpy()[at]), pa.array(t.column("lo").to_numpy()[at] + offset[first]), pa.array(n), pa.array(t.column("th").to_numpy()[at])], ["key", "lo", "n", "th"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = keyed.select("key", "th", "text").join(wanted.hint("shuffle_hash"), ["key", "th"]).select("key", "th", "text", "wanted").mapInArrow(cut, "ah long, key long, th long, lo long, n long, content binary")
    ends = content.repartition(parts, "ah").sortWithinPartitions("ah").mapInArrow(sort, "key long, lo long, n long, th long")
    all_spans = whole.unionByName(ends).select("key", "th", F.struct("lo", (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("hi")).alias("span"))
    # repeated rows have the same spans: a set of them, combined before the shuffle, does not grow with the copies
    return keyed, all_spans.groupBy("key", "th").agg(F.collect_set("span").alias("spans"))


def merged(found: list[dict] | None) -> list[list[int]]:
    """Sorted runs without touching neighbours."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in found or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every row of docs(doc_id, text, ...).

    Removed is each byte of a string of `length` bytes that starts anywhere else too, in any row or the same; strings
    do not cross rows. Null text: empty. Repeated rows are each other's repeats. A null doc_id is one like any other.
    Texts may have 4 GB at most.
    """
    keyed, found = spans(docs, length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, runs = text.encode("utf-8", "surrogatepass"), merged(own)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = keyed.join(found.hint("shuffle_hash"), ["key", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with its columns, texts cut down to what remove_repeats keeps (halves of characters dropped) and n_chars brought in line.

    Rows of which nothing is left are gone; rows that were empty before stay.
    """
    keyed, found = spans(docs, length)
    names = docs.columns
    at = names.index("text")
    key, th, own = free_names(names, "key", "th", "spans")
    both = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(key), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(th))
    joined = both.join(found.toDF(key, th, own).hint("shuffle_hash"), [key, th], "left").select(*[F.col(f"`{n}`") for n in names], own)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if own:
                    raw, runs = text.encode("utf-8", "surrogatepass"), merged(own)
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
                texts.append(text)
                stay.append(not own or bool(text.strip()))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([len(t) if own else n for t, own, n in zip(texts, batch.column(len(names)).to_pylist(), columns[i].to_pylist(), strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay))

    return joined.mapInArrow(apply, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: repeated strings of 200 bytes, over all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), LENGTH).drop("kept")
