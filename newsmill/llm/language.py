"""Language of a text, word first: known words by their log frequency in each language, others by character n-grams.

A word is a run of letters, lower-cased. If any language knows it, its cost in each language is -log10 of its relative
frequency there, or PENALTY; if none does, its n-grams of N characters (a space on either side) are tried, then shorter
ones, and the first length of which some language knows any decides by the mean over those known. A text takes the
language of least mean cost over its words.

Counts are learned from MOST_TRAIN texts and MOST_BYTES of text at most, those whose ids hash lowest; all words and n-grams
of that sample are kept, so its bounds are the model's. They are defaults of parameters of `fit`. Prediction reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import chain, repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCache, bounded, prepare, strings, table, written

MOST_TRAIN, MOST_BYTES, N, PENALTY = 20_000, 1 << 28, 4, 7.0
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Costs:
    """{key: {number of a language: cost}} as arrays: the languages and costs of a key are those from start to start + size."""

    def __init__(self, known: dict[str, dict[int, float]]):
        self.row = {key: i for i, key in enumerate(known)}
        self.size = np.fromiter(map(len, known.values()), np.int64, len(known))
        self.start = np.cumsum(self.size) - self.size
        self.lang = np.fromiter(chain.from_iterable(known.values()), np.int64, self.size.sum())
        self.cost = np.fromiter(chain.from_iterable(found.values() for found in known.values()), np.float64, self.size.sum())

    def sums(self, keys: list[str], of: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """By word, of[i] being that of keys[i]: how many of its keys are known, and by language the sum of what each is under PENALTY."""
        row = np.fromiter(map(self.row.get, keys, repeat(-1)), np.int64, len(keys))
        row, of = row[row >= 0], of[row >= 0]
        size = self.size[row]
        entry = np.repeat(self.start[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.bincount(np.repeat(of, size) * shape[1] + self.lang[entry], self.cost[entry] - PENALTY, shape[0] * shape[1])
        return np.bincount(of, minlength=shape[0]), sums.reshape(shape)


@dataclass
class Model:
    """words and grams: {number of a language: cost} for those languages that know them. Tasks get the tables alone."""

    languages: list[str]
    words: dict[str, dict[int, float]]
    grams: dict[str, dict[int, float]]
    n: int = N

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "words": {}, "grams": {}, "n": self.n, "tables": self.tables}

    @cached_property
    def tables(self) -> tuple[Costs, Costs]:
        return Costs(self.words), Costs(self.grams)

    @cached_property
    def cache(self) -> WordCache:
        """Costs by word, kept from task to task by a worker that holds the model; about 100 MB at most."""
        return WordCache(self.cost, 50_000_000 // (8 * len(self.languages) + 200))

    def costs(self, words: list[str]) -> np.ndarray:
        """By word and language; of n-grams the mean of those known. Only the languages that know one are added up."""
        of_words, of_grams = self.tables
        shape = len(words), len(self.languages)
        out = np.full(shape, PENALTY)
        known, sums = of_words.sums(words, np.arange(len(words)), shape)
        out += sums
        left = np.flatnonzero(known == 0)
        for n in range(self.n, 0, -1):
            own = [grams(words[i], n) for i in left]
            of = np.repeat(np.arange(len(left)), np.fromiter(map(len, own), np.int64, len(own)))
            known, sums = of_grams.sums([*chain.from_iterable(own)], of, (len(left), shape[1]))
            out[left] += sums / np.maximum(known, 1)[:, None]
            left = left[known == 0]
        return out

    def cost(self, word: str) -> np.ndarray:
        return self.costs([word])[0]

    def predict(self, texts: list[str], cache: WordCache) -> tuple[list[str], list[float]]:
        """Languages and their shares of 10 ** -(mean cost) (0 to 1). Ties go to the first language by name."""
        langs, scores = [], []
        counts = [Counter(words(text)) if any(map(str.isalpha, text)) else Counter() for text in texts]
        if self.languages:
            cache.fill(set().union(*counts), lambda new: map(np.ndarray.tobytes, self.costs(new)))
        for own in counts:
            if not own or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            n = np.fromiter(own.values(), np.float64, len(own))
            mean = n @ np.frombuffer(b"".join(map(cache.__getitem__, own))).reshape(len(own), -1) / n.sum()
            share = 10.0 ** (mean.min() - mean)
            best = int(mean.argmin())
            langs.append(self.languages[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def fit(train: DataFrame, most_train: int = MOST_TRAIN, most_words: int | None = None, most_grams: int | None = None, most_bytes: int = MOST_BYTES) -> Model:
    """Of train(doc_id, text, lang), rows with an id, a language and a text.

    Rows with equal id, text and language count once; of ids with many texts as many rows count as the bounds let in.
    most_words and most_grams keep that many a language only, the most frequent; those of equal frequency go by name. Without such rows the model has no
    language and every text is `und`.
    """
    prepare(train.sparkSession)
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    ids = train.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_train)
    some = written(train.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").dropDuplicates().select("text", "lang"), "learned")
    some = bounded(some, most_train, most_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
            for lang, found in own.items():
                keys = [*found]
                gram = Counter()
                for w, n in found.items():
                    for k in range(1, N + 1):
                        for g in grams(w, k):
                            gram[g] += n
                for kind, own_keys, values in ((0, keys, found), (1, [*gram], gram)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own_keys), pa.string()), pa.array([kind] * len(own_keys), pa.int64()), pa.array([len(g) if kind else 0 for g in own_keys], pa.int64()), pa.array(own_keys, pa.string()), pa.array([values[x] for x in own_keys], pa.int64())], ["lang", "kind", "size", "item", "n"])

        own: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, own.values())) > 300_000:
                yield from out(own)
                own = {}
        yield from out(own)

    counts = some.mapInArrow(count, "lang string, kind long, size long, item string, n long").groupBy("lang", "kind", "size", "item").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    totals = {(r["lang"], r["kind"], r["size"]): r["n"] for r in counts.groupBy("lang", "kind", "size").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({k[0] for k in totals})
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    within = [(F.col("kind") == kind) & (place <= most) for kind, most in ((0, most_words), (1, most_grams)) if most is not None]
    unbounded = [F.col("kind") == kind for kind, most in ((0, most_words), (1, most_grams)) if most is None]
    tables: tuple[dict[str, dict[int, float]], ...] = ({}, {})
    kept = counts.withColumn("stays", reduce(or_, within + unbounded)).where("stays").select("lang", "kind", "size", "item", "n").toArrow()
    for lang, kind, size, item, n in zip(*(c.to_pylist() for c in kept.columns), strict=True):
        tables[kind].setdefault(item, {})[languages.index(lang)] = -math.log10(n / totals[lang, kind, size])
    return Model(languages, *tables)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs(doc_id, text). `und` with score 0 where a text is null or has no letter.

    Repeated rows and null doc_ids stay; of languages of equal cost the first by name is taken.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            langs, scores = model.predict(strings(b.column(1)), model.cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: languages of all documents; those whose crc32(doc_id) leaves 0 by five were not learned from. A null doc_id neither is held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
