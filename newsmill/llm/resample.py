"""Importance resampling: documents weighed by hashed n-gram models of target and raw text, drawn by Gumbel top-k.

Words and pairs of neighbouring words are hashed into BUCKETS. The raw model counts all documents, the target model
documents labelled good (a sample of MOST_TARGET at most); both are smoothed by one count a bucket. A document's log weight is the sum over its
n-grams of log target - log raw. The k documents of the highest log weight + Gumbel noise are a sample without
replacement in proportion to the weights; the noise comes from a hash of seed and doc_id, so a rerun draws the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, prepare, strings, table, written

BUCKETS, FRACTION, SEED = 1 << 16, 0.5, 11
#: Documents that the target model counts at most, those whose ids hash lowest.
MOST_TARGET = 20_000
_WORD = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def word_cache() -> WordCache:
    return WordCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def buckets(text: str, cache: WordCache, n: int = BUCKETS) -> np.ndarray:
    """The bucket of each word (a run of word characters or of marks, lower-cased) and of each pair of neighbours."""
    found = _WORD.findall(text.lower())
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    pair = h[:-1] * _PAIR + h[1:]
    pair ^= pair >> np.uint64(32)
    return (np.concatenate((h, pair)) % np.uint64(n)).astype(np.int64)


def model_counts(docs: DataFrame, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts a bucket over docs(text, good). A task sends one row a bucket at most; the driver gets n rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, both = word_cache(), np.zeros((2, n), np.int64)
        for b in batches:
            own = [buckets(t, cache, n) for t in strings(b.column(0))]
            for k, some in enumerate((own, [x for x, good in zip(own, b.column(1).to_pylist(), strict=True) if good])):
                both[k] += np.bincount(np.concatenate([*some, np.zeros(0, np.int64)]), minlength=n)
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], ["bucket", "raw", "target"])

    rows = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, n), np.int64)
    out[:, rows["bucket"].to_numpy(np.int64)] = rows[["raw", "target"]].to_numpy(np.int64).T
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def noise(doc_id: int | None, text: str, seed: int) -> int:
    """64 bits drawn by the doc_id; by the text where there is none, so that rows without one are drawn each by itself."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass") if doc_id is None else str(doc_id), seed)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, sort_key) of docs(doc_id, text); null text is empty and weighs 0."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = word_cache(), shared.value
        for b in batches:
            texts = strings(b.column(1))
            w = np.array([own[buckets(t, cache, len(own))].sum() for t in texts])
            u = (np.array([noise(d, t, seed) for d, t in zip(b.column(0).to_pylist(), texts, strict=True)], np.float64) + 0.5) / 2.0**64
            key = w - np.log(-np.log(np.clip(u, 1e-18, 1 - 1e-16)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(key)], ["doc_id", "log_weight", "sort_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, log_weight double, sort_key double")


def ranked(rows: DataFrame) -> DataFrame:
    """rows(doc_id, sort_key, ...) with `rank` from 1, by sort_key from the highest, then by doc_id.

    Rows are dealt by ranges of their keys and written in order; a row's number in its range and the sizes of the
    ranges before it give its rank, so nothing is sorted in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("sort_key").desc(), F.col("doc_id")).sortWithinPartitions(F.col("sort_key").desc(), "doc_id")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, base = dealt.groupBy(part.alias("_part")).count().orderBy("_part").collect(), 0, []
    for r in sizes:  # a row a range
        base.append((r["_part"], before))
        before += r["count"]
    bases = spark.createDataFrame(base, "_part long, _base long")
    return dealt.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + place + 1).drop("_at", "_part", "_base")


def resample(docs: DataFrame, good_ids: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, sort_key, rank, selected) of every row of docs; the best ceil(fraction * rows) are selected.

    good_ids(doc_id): the target's documents. Repeated rows get the same key and neighbouring ranks. A row of a null
    doc_id is weighed like any other, drawn by its text and never in the target.
    """
    prepare(docs.sparkSession)
    good = good_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TARGET).withColumn("good", F.lit(True))
    raw, target = model_counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select(F.col("text").cast("string").alias("text"), F.coalesce("good", F.lit(False)).alias("good")))
    # written first: finding the ranges reads the rows once more, and must not weigh them again
    weights = written(weigh(docs, log_ratio(raw, target), seed), "weights")
    n = weights.count()
    return ranked(weights).withColumn("selected", F.col("rank") <= math.ceil(fraction * n))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: half of the documents, drawn towards those labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)
