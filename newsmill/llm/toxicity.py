"""Toxicity by cumulative-link ordinal regression on sparse words.

Grades: 0 for documents labelled clean; toxic ones get 1, or 2 where they hold more toxic words than the middle toxic
document. One weight a feature is shared by all thresholds: P(grade <= k) = logistic(threshold_k - weights . counts).
Features are words, beginnings of words (`^stem`, PREFIXES letters, for insults that inflect or compound) and
beginnings that a text has at least twice (`^^stem`). The model is fitted on MOST_LABELS labelled documents and MOST_BYTES
of text at most, those whose ids hash lowest; its features are all that tell in that sample. The bounds are defaults of
parameters of `fit`. All documents are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, bounded, give_back, prepare, strings, table, written

MOST_LABELS, MOST_BYTES, GRADES = 20_000, 1 << 28, 3
PREFIXES = (5, 6, 7)
#: A word tells if its log odds stand so many standard errors from zero.
TELLING = 4.0
#: A document is toxic if P(grade >= 1) exceeds this.
CUT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def items(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def counted(found: Iterable[str]) -> Counter:
    """How often each item occurs, with `^^stem` once for stems that occur twice."""
    own = Counter(found)
    own.update({"^" + k: 1 for k, n in own.items() if n > 1 and k[0] == "^"})
    return own


class Index:
    """The features of a text that a model knows, as (number, count), by number."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        stems = {k.lstrip("^") for k in index if k[0] == "^"}
        keep = lambda i: i in index or i[0] == "^" and i[1:] in stems
        self.cache = WordCache(lambda w: tuple(filter(keep, items(w))))

    def of(self, text: str) -> list[tuple[int, int]]:
        own = counted(i for found in map(self.cache.__getitem__, words(text)) if found for i in found)
        return sorted((self.index[k], n) for k, n in own.items() if k in self.index)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, texts: list[str], known: Index | None = None) -> np.ndarray:
        """P(grade = k), a row a text."""
        score, index = np.zeros(len(texts)), known or Index(self.index)
        for i, text in enumerate(texts):
            if own := index.of(text):
                at, n = zip(*own, strict=True)
                score[i] = self.weights[list(at)] @ np.log1p(n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -50, 50)))
        return np.diff(np.concatenate((np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))), axis=1), axis=1)


def fit_ordinal(rows: list[list[tuple[int, int]]], grade: np.ndarray, n_words: int, grades: int = GRADES, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps (Adam) on the mean log likelihood. rows: (word, count) pairs."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    pairs = np.array([p for row in rows for p in row], np.int64).reshape(-1, 2)
    return fit_sparse(sizes, pairs[:, 0], pairs[:, 1], grade, n_words, grades, steps, rate, ridge)


def fit_sparse(sizes: np.ndarray, word: np.ndarray, n: np.ndarray, grade: np.ndarray, n_words: int, grades: int = GRADES, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The same of rows one behind the other: sizes[i] words and their counts belong to row i."""
    rows, row, x = len(sizes), np.repeat(np.arange(len(sizes)), sizes), np.log1p(n)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(1, len(grade)), 0.01, 0.99)
    first = np.log(share / (1 - share))
    # thresholds rise: the first, then logarithms of the gaps
    theta = np.concatenate((np.zeros(n_words), first[:1], np.log(np.maximum(np.diff(first), 0.05))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(rows)
    for t in range(1, steps + 1 if rows else 1):
        gaps = np.exp(theta[n_words + 1 :])
        cut = theta[n_words] + np.concatenate(([0], np.cumsum(gaps)))
        below = 1 / (1 + np.exp(np.clip(np.bincount(row, x * theta[word], rows)[:, None] - cut, -50, 50)))
        edge = np.concatenate((np.zeros((rows, 1)), below, np.ones((rows, 1))), axis=1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[at, grade + 1] - edge[at, grade], 1e-9)
        up, down = slope[at, grade + 1] / p, slope[at, grade] / p
        d_cut = np.zeros(len(cut))
        for k in range(len(cut)):
            d_cut[k] = up[grade == k].sum() - down[grade == k + 1].sum()
        gradient = np.empty_like(theta)
        gradient[:n_words] = -np.bincount(word, x * (up - down)[row], n_words) / rows - 2 * ridge * theta[:n_words]
        gradient[n_words] = d_cut.sum() / rows
        gradient[n_words + 1 :] = gaps * np.cumsum(d_cut[::-1])[::-1][1:] / rows
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / (1 + t / 100)
    return theta[:n_words], theta[n_words] + np.concatenate(([0], np.cumsum(np.exp(theta[n_words + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_words: int | None = None, most_bytes: int = MOST_BYTES) -> Model:
    """Of the documents that labels(doc_id, toxic) knows; of several labels of an id the greatest holds.

    Rows with equal id and text count once; null ids and labels do not. Of ids with many texts as many rows count as the
    bounds let in. most_words keeps that many most telling features only. Features of equal weight go by name. Without labels, or
    with those of one kind only, no word has a weight and every document is clean.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    sample = written(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic"), "labelled")
    sample = bounded(sample, most_labels, most_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own[toxic > 0].update(counted(i for w in words(text) for i in items(w)).keys())
        both = sorted(own[0].keys() | own[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([own[0][w] for w in both], pa.int64()), pa.array([own[1][w] for w in both], pa.int64())], ["word", "clean", "toxic"])

    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    counts = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counts.where("clean + toxic >= 5").select("word", z.alias("z"), odds.alias("odds")).where(F.abs("z") >= TELLING).orderBy(F.abs("z").desc(), "word")
    told = (telling if most_words is None else telling.limit(most_words)).collect() if n0 and n1 else []
    index, toxic_words = {r["word"]: i for i, r in enumerate(told)}, frozenset(i for i, r in enumerate(told) if r["odds"] > 0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(index)
        for b in batches:
            own = [known.of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), b.column(2), pa.array([[j for j, _ in r] for r in own], pa.list_(pa.int64())), pa.array([[n for _, n in r] for r in own], pa.list_(pa.int64()))], ["toxic", "place", "word", "n"])

    if not told:
        return Model({}, np.zeros(0), np.array([20.0, 21.0]))
    # numbers of a bounded sample, in an order of their own
    picked = sample.withColumn("place", F.xxhash64("text")).mapInArrow(pick, "toxic long, place long, word array<long>, n array<long>").toArrow().sort_by([("toxic", "ascending"), ("place", "ascending")]).combine_chunks()
    lists = [picked.column(c).combine_chunks() for c in ("word", "n")]
    word, n = (x.flatten().to_numpy() for x in lists)
    sizes, toxic = np.diff(lists[0].offsets.to_numpy()), picked.column("toxic").to_numpy() > 0
    bad = np.isin(word, [*toxic_words])
    held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[bad], n[bad], len(sizes))
    grade = np.where(toxic, 1 + (held > np.median(held[toxic])), 0)
    return Model(index, *fit_sparse(sizes, word, n, grade, len(told)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (expected grade, 0 to 2), p_toxic (of grade 1 or more), grade (likeliest, the lowest of ties) and is_toxic.

    Every row stays; null text is empty. Columns of docs with these names are replaced.
    """
    prepare(docs.sparkSession)
    give_back()  # what fitting has held in the driver
    out = ("severity", "p_toxic", "grade", "is_toxic")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in out]
    keep = [i for i, f in enumerate(docs.schema) if f.name not in out]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(model.index)
        for b in batches:
            p = model.grades(strings(b.column(at)), known)
            new = [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array(p.argmax(1)), pa.array(1 - p[:, 0] > CUT)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *new], [*(b.schema.field(i).name for i in keep), *out])

    return docs.mapInArrow(run, ", ".join([*schema, "severity double, p_toxic double, grade long, is_toxic boolean"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
