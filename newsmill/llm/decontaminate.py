"""Benchmark decontamination by greedy string tiling.

Documents meet the benchmark where they share a seed, MIN_TILE tokens in a row. A document and an item that share one
are tiled: matches of the longest length are looked for first, by Karp-Rabin hashes of all their stretches of that
length, and marked, longest first, where none of their tokens is marked; then the length falls, down to MIN_TILE. Tiles
may lie in any order, so a reordered passage is covered all the same. An item leaks into a document if its tiles
cover at least THRESHOLD of the item's tokens.

The benchmark is a stated query set held against all documents in blocks of BLOCK_CHARS characters at most (a longer
item is a block of its own); only one block's tokens are sent to the executors for each pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, strings, table

MIN_TILE, THRESHOLD = 5, 0.5
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Hashes:
    """Karp-Rabin hashes of stretches of a sequence of token numbers, of any length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power, inverse = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        power[:1] = inverse[:1] = 1
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * np.cumprod(power, dtype=np.uint64), out=self.sums[1:])
        self.inverse = np.cumprod(inverse, dtype=np.uint64)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def free_starts(marks: bytearray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of starts behind which `length` tokens are free."""
    sums = np.concatenate(([0], np.cumsum(np.frombuffer(marks, np.uint8), dtype=np.int64)))
    starts = starts[starts + length <= len(marks)]
    return starts[sums[starts + length] == sums[starts]]


def tile(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray, least: int, item_hashes: Hashes, doc_hashes: Hashes) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length) of tiles of at least `least` tokens.

    seeds: starts in the document, rising, where `least` tokens stand in the item too. Equal lengths go by item start, then
    by document start. The longest length at which free stretches still agree is found by halving; all tiles of that length
    are laid in one pass, in which a stretch once covered is never looked at again. Lengths fall, so there are at most as
    many passes as tiles of different lengths fit into the item.
    """
    first = int(seeds[0])
    of_item, of_doc = bytearray(len(item)), bytearray(min(len(doc), int(seeds[-1]) + len(item)) - first)
    every, places = np.arange(len(item)), seeds - first
    tiles: list[tuple[int, int, int]] = []

    def agreeing(length: int) -> tuple[np.ndarray, ...]:
        """(starts in the item, their hashes, starts in the document, their hashes) of free stretches with an equal hash."""
        i, j = free_starts(of_item, every, length), free_starts(of_doc, places, length)
        hi, hj = item_hashes.at(i, length), doc_hashes.at(j + first, length)
        of_i, of_j = np.isin(hi, hj), np.isin(hj, hi)
        return i[of_i], hi[of_i], j[of_j], hj[of_j]

    most = min(len(item), len(of_doc))
    while most >= least:
        lo, hi = least - 1, most
        while lo < hi:
            middle = (lo + hi + 1) // 2
            lo, hi = (middle, hi) if len(agreeing(middle)[0]) else (lo, middle - 1)
        if lo < least:
            break
        at_item, h_item, at_doc, h_doc = agreeing(lo)
        by = np.lexsort((at_doc, h_doc))
        at_doc, h_doc = at_doc[by].tolist(), h_doc[by]
        begin, end = np.searchsorted(h_doc, h_item, "left").tolist(), np.searchsorted(h_doc, h_item, "right").tolist()
        passed: dict[int, int] = {}
        for i, a, z in zip(at_item.tolist(), begin, end, strict=True):
            if of_item.find(1, i, i + lo) >= 0:
                continue
            p = passed.get(a, a)
            while p < z and of_doc.find(1, at_doc[p], at_doc[p] + lo) >= 0:
                p += 1
            passed[a] = p
            for q in range(p, z):  # more than one only where hashes agree and tokens do not
                j = at_doc[q]
                if of_doc.find(1, j, j + lo) < 0 and np.array_equal(item[i : i + lo], doc[j + first : j + first + lo]):
                    tiles.append((i, j + first, lo))
                    of_item[i : i + lo] = of_doc[j : j + lo] = b"\1" * lo
                    break
        most = lo - 1
    return tiles


class Block:
    """Items ready to be looked for: token numbers, hashes, and the items of each seed."""

    def __init__(self, items: list[tuple[int | None, str | None, int]], least: int):
        self.least, self.vocabulary = least, {}
        self.ids = [[i] * n for i, _, n in items]
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(t)] for _, t, _ in items]
        self.items = [np.array(x, np.int64) for x in self.items]
        self.hashes = [Hashes(x) for x in self.items]
        found = [np.unique(h.at(np.arange(len(x) - least + 1), least) if len(x) >= least else np.zeros(0, np.uint64)) for x, h in zip(self.items, self.hashes, strict=True)]
        every = np.concatenate([*found, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        by = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[by], owner[by]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.seeds >> np.uint64(42)] = True

    def search(self, text: str | None, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, item tokens, covered tokens, tiles, coverage) of the items that cover enough."""
        words = tokens(text)
        if len(words) < self.least or not len(self.seeds):
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero(unknown[self.least :] == unknown[: -self.least])
        if not len(at):
            return
        own = Hashes(ids)
        h = own.at(at, self.least)
        maybe = self.bits[h >> np.uint64(42)]
        at, h = at[maybe], h[maybe]
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        # (item, place) of all seeds, an item's together, places rising
        n = hi - lo
        places = np.repeat(at, n)
        owner = self.owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        by = np.argsort(owner, kind="stable")
        owner, places = owner[by], places[by]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else by
        for item, seeds in zip(owner[starts].tolist(), np.split(places, starts[1:]), strict=False):
            size = len(self.items[item])
            if min(size, len(seeds) * self.least) < threshold * size:
                continue  # these seeds cannot cover enough
            tiles = tile(self.items[item], ids, seeds, self.least, self.hashes[item], own)
            covered = sum(k for _, _, k in tiles)
            if covered >= threshold * size:
                yield item, size, covered, len(tiles), covered / size


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens, tiles, coverage) of every row of docs and item that leaks into it.

    Tokens are runs of word characters, lower-cased. Null texts are empty; items of fewer than `least` tokens never
    match; repeated rows of either table give repeated pairs; null ids stay null.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(shared.value, least)
            for batch in batches:
                found = [(d, item_id, *x) for d, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True) for i, *x in block.search(t, threshold) for item_id in block.ids[i]]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "item_tokens", "matched_tokens", "tiles", "coverage"])

        own = docs.mapInArrow(run, "doc_id long, item_id long, item_tokens long, matched_tokens long, tiles long, coverage double")
        out = own if out is None else out.unionByName(own)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with its columns, into which no item leaks."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for shared in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(shared.value, least)
            for batch in batches:
                yield batch.filter(pa.array([next(block.search(t, threshold), None) is None for t in strings(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def blocks(benchmark: DataFrame) -> Iterator:
    """Broadcasts of (item_id, text, repeats), BLOCK_CHARS characters or so in each: different items are dealt out by hash."""
    spark = benchmark.sparkSession
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).agg(F.count("*").alias("n"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for b in range(n):
        yield spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: items of the benchmark that leak into documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
