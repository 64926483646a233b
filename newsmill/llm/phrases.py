"""Phrase collocation mining.

Texts become pieces, equal pieces one row with their multiplicity. N-grams are counted level by level, by their number of
words: a task counts those of many pieces at once, weighted by multiplicity, what it has counted is dealt to hash
buckets, and each bucket is added up by DuckDB, which spills to the task's own scratch folder once its memory is used up.
A phrase is frequent only where both phrases that are one word shorter are, so a level leaves out what the
level before rules out: frequent phrases set bits of a bitmap of fixed size (4 MB, broadcast), which may let an
infrequent one pass but never keeps a frequent one back; nothing but work depends on it.

A candidate's parts are counted in other buckets. Each cut sends two lookup requests, which are shuffled to where the
part's count is and come back by a second shuffle. A part that very many candidates ask for is a hot key of that join
of narrow rows only, which adaptive execution splits.
"""

from __future__ import annotations

import os
import string
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, written

#: Words of a piece; where texts are cut; words of a phrase at most; occurrences a phrase needs; percent of them inside a longer one that drop it.
WORD, CUT, LONGEST, LEAST, INSIDE = r"[^\x20\x09]+", r"[.,;:!?\x0A-\x0D]", 4, 30, 80
#: Scores are this times a / (l + r); phrases a language.
SCALE, TOP = 2_000_000, 2000
#: Words that a task counts at once, memory of a bucket's DuckDB, bits of the bitmap (as a power of two), shares a language is ranked in.
WORDS, MEMORY, BITS, SHARES = 1_000_000, "256MB", 25, 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pieces(docs: DataFrame) -> DataFrame:
    """A written table (lang, piece, words, copies) of docs(text, lang, ...): words of a piece stand one space apart.

    A null text is empty, a null lang `und`; pieces without words are left out.
    """
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, CUT)).alias("piece"))
    tidy = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    counted = cut.select("lang", tidy.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("copies"))
    return written(counted.select("lang", "piece", F.size(F.split("piece", " ")).cast("long").alias("words"), "copies"), "pieces")


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.as_py() or "") for w in words), np.uint64, len(words))


def _chained(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Places in the bitmap of phrases whose words have these hashes, one array a word."""
    h = lang
    for w in words:
        h = ((h ^ w) * _FACTOR) ^ (h >> np.uint64(29))
    return h >> np.uint64(64 - BITS)


def _dictionary(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def counted(lang: pa.Array, piece: pa.Array, copies: np.ndarray, n: int, shorter: np.ndarray | None) -> pa.RecordBatch:
    """(lang, phrase, f): the n-grams of the pieces weighted by copies; those that the bitmap `shorter` of (n-1)-grams rules out are left out."""
    split = pc.split_pattern(piece, " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    word, names = _dictionary(split.flatten())
    of_lang, langs = _dictionary(lang)
    own = np.repeat(np.arange(len(size)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the end of the piece
    at = np.flatnonzero(room >= n)
    if shorter is not None and len(at):
        hash_word, hash_lang = _hashes(names)[word], _hashes(langs)[of_lang]
        for first in (0, 1):
            slot = _chained(hash_lang[own[at]], [hash_word[at + first + i] for i in range(n - 1)])
            at = at[(shorter[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    key, bound = of_lang[own[at]], len(langs)
    for i in range(n):
        if bound * len(names) >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            bound = len(seen)
        key, bound = key * len(names) + word[at + i], bound * len(names)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, which, copies[own[at]])
    place = at[first]
    phrase = pc.binary_join_element_wise(*[names.take(pa.array(word[place + i])) for i in range(n)], " ")
    return pa.RecordBatch.from_arrays([langs.take(pa.array(of_lang[own[place]])), phrase, pa.array(total)], ["lang", "phrase", "f"])


def _added_up(rows: Iterator[pa.RecordBatch], least: int, memory: str) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of one bucket's rows, added up out of core; those under `least` are left out."""
    import duckdb

    first = next((b for b in rows if b.num_rows), None)
    if first is None:
        return

    def given() -> Iterator[pa.RecordBatch]:
        yield first
        yield from rows

    with tempfile.TemporaryDirectory(prefix="bucket-") as scratch, duckdb.connect() as con:
        con.execute("SET threads = 1")
        con.execute(f"SET memory_limit = '{memory}'")
        con.execute("SET preserve_insertion_order = false")
        con.execute(f"SET temp_directory = '{os.path.abspath(scratch)}'")
        reader = pa.RecordBatchReader.from_batches(first.schema, given())
        con.register("given", reader)
        for b in con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM given GROUP BY ALL HAVING sum(f) >= {least:d}").to_arrow_reader(100_000):
            yield b.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))


def frequent(own: DataFrame, n: int, shorter: bytes | None, least: int = LEAST, words: int = WORDS, memory: str = MEMORY) -> DataFrame:
    """A written table (lang, phrase, f) of the n-grams that occur `least` times or more in the pieces `own`."""
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent.value is None else np.frombuffer(sent.value, np.uint8)
        held, many = [], 0
        for b in batches:
            # a batch may hold more words than are counted at once, and one piece may
            ends = np.cumsum(b.column(2).to_numpy())
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + words - many, "right")))
                held.append(b.slice(start, end - start))
                many += int(ends[end - 1] - (ends[start - 1] if start else 0))
                start = end
                if many >= words or start < b.num_rows:
                    yield flush(held, bits)
                    held, many = [], 0
        if held:
            yield flush(held, bits)
        give_back()

    def flush(held: list[pa.RecordBatch], bits: np.ndarray | None) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lang, piece = (t.column(i).chunk(0).cast(pa.string()) if t.num_rows else pa.array([], pa.string()) for i in (0, 1))
        return counted(lang, piece, t.column(3).to_numpy(), n, bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added_up(batches, least, memory)
        give_back()

    some = own.where(F.col("words") >= n).mapInArrow(count, "lang string, phrase string, f long")
    return written(some.repartition(parts, "lang", "phrase").mapInArrow(add, "lang string, phrase string, f long"), f"frequent-{n}")


def bitmap(found: DataFrame) -> bytes:
    """2 ** BITS bits of which those of the phrases of found(lang, phrase, f) are set."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of_lang, langs = _dictionary(b.column(0).cast(pa.string()))
            split = pc.split_pattern(b.column(1).cast(pa.string()), " ")
            word, names = _dictionary(split.flatten())
            hashes = _hashes(names)[word].reshape(b.num_rows, -1)
            slot = np.unique(_chained(_hashes(langs)[of_lang], list(hashes.T))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(1, slot & 63))], ["word", "bits"])

    set_bits = found.select("lang", "phrase").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def part(phrase: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


def wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the candidates, phrases of two words or more, of counts(lang, phrase, f)."""
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), F.size(F.split("phrase", " ")).alias("size")).where("size > 1")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.col("phrase"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    ))
    requests = cuts.select("lang", "phrase", "size", "a", "k", asked.alias("asked")).select("lang", "phrase", "size", "a", "k", "asked.side", "asked.part")
    answers = requests.join(counts.withColumnRenamed("phrase", "part"), ["lang", "part"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    both = answers.groupBy("lang", "phrase", "size", "a", "k").agg(of("l").alias("l"), of("r").alias("r"))
    score = F.expr(f"({SCALE}BD * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def standing(candidates: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The candidates but those whose words lie inside a longer one, dropped or not, that has `inside` percent of their occurrences."""
    spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    longer = candidates.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside)).drop("longer")


def first_of_each(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language, with their rank: first of shares of it, then of those left, so no task sorts a whole language."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    shares = candidates.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", rank("lang", "share")).where(F.col("rank") <= top)
    return shares.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= top).drop("share")


def mined(docs: DataFrame, least: int = LEAST, top: int = TOP, words: int = WORDS, memory: str = MEMORY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(text, lang, ...).

    Nulls: see `pieces`. Repeated rows count each time. Ties are settled by score, a and the phrase's bytes, so ranks are
    unique. Further columns are not looked at. No rows for an empty table or where nothing is frequent.
    """
    own = pieces(docs)
    levels, bits = [], None
    for n in range(1, LONGEST + 1):
        levels.append(frequent(own, n, bits, least, words, memory))
        if n < LONGEST:
            bits = bitmap(levels[-1])
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    found = written(first_of_each(standing(written(scored(counts), "scored")), top), "first")
    total = own.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("n"))
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the first 2,000 collocations of each language."""
    return mined(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, unnest([array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})]) AS phrase, {n} AS size FROM pieces" for n in range(1, LONGEST + 1))
SQL = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{CUT}')) AS piece FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '{WORD}') AS w FROM cut
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS ({_GRAMS}), counts AS (
  SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), often AS MATERIALIZED (
  SELECT lang || chr(0) || phrase AS id, lang, phrase, size, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= {LEAST}
), candidates AS (
  SELECT lang, phrase, size, f AS a, w FROM often WHERE size > 1
), asked AS (
  SELECT *, lang || chr(0) || array_to_string(w[1:k], ' ') AS left_id, lang || chr(0) || array_to_string(w[k + 1:], ' ') AS right_id
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.w, k, l.f AS l, r.f AS r, ({SCALE} * c.a) // (l.f + r.f) AS score
  FROM asked c JOIN often l ON l.id = left_id JOIN often r ON r.id = right_id
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, unnest(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, size - n + 2)] for n in range(2, size)])) AS phrase, a FROM candidates
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM spans GROUP BY ALL
), left_over AS (
  SELECT b.* FROM best b LEFT JOIN longer g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most < {INSIDE} * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
