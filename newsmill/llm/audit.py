"""Filter interaction audit: which documents each filter removes in every order of the filters.

The orders form a trie; a prefix leaves the same survivors in whatever order its filters came, so the trie's nodes with the
same set of filters are one state. States are walked depth first. A state's survivors are a persisted DataFrame, filtered
from those of the state above it; counting its edges (one for each filter not yet applied: what that filter actually removes
from these survivors) fills it, and it is given up once the states below have been walked. Each set of
filters is visited once, so five filters take 31 passes over narrow rows instead of 120 orders of five.

Whole texts are read once, for the facts that filters look at. A persisted frame that is lost with its executor is
filtered again from the written facts. Counts are aggregated by part before they are shuffled and written state by state.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, strings, table, written
from .exact import KEYS, settled

_CAPITALS = bytes(range(65, 91))
_SIGNS = re.compile(r"[#$%&*|]")
_FACTS = "doc_id long, part string, place long, words long, distinct_words long, capitals long, chars long, signs boolean, digest binary, size long, second long"
#: Each filter's condition of failure on the columns of `facts`.
FILTERS = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 3 * chars",
    "D": "signs",
    "E": "again",
}


def measured(text: str) -> tuple:
    """words, distinct words, A-Z, code points, any of the signs, and what texts are told apart by."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: at the six ASCII spaces
    return len(words), len(set(words)), len(raw) - len(raw.translate(None, _CAPITALS)), len(text), bool(_SIGNS.search(text)), hashlib.sha256(raw).digest(), len(raw), int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table, one row a document of docs(doc_id, text, lang, ...): what the filters look at, part, good, toxic.

    part is the lang, empty where it is null. A null text is empty. `again`: the text is that of a smaller doc_id too (a null doc_id is
    neither smaller nor greater). good and toxic come from labels(doc_id, quality, toxic, ...), once however many rows it has for a
    document; a document without a label is neither.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("place", pa.int64()), ("words", pa.int64()), ("distinct_words", pa.int64()), ("capitals", pa.int64()), ("chars", pa.int64()), ("signs", pa.bool_()), ("digest", pa.binary()), ("size", pa.int64()), ("second", pa.int64())])
        for b in batches:
            found = list(zip(*map(measured, strings(b.column(3))), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[3:], strict=True))], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").alias("text"))
    rows = written(own.mapInArrow(run, _FACTS), "facts")
    smallest = settled(rows, KEYS, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)))
    flags = smallest.select("*", F.coalesce(F.col("doc_id") > F.col("best"), F.lit(False)).alias("again"))
    one = lambda c: (F.max(F.when(F.col(c) == 1, 1).otherwise(0)) == 1).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg(one("quality"), one("toxic")).withColumn("some", F.lit(True))
    # rows without an id ask for a label by their place under `some` = false, which none has: they do not meet in one task
    asks = flags.withColumns({"key": F.coalesce("doc_id", "place"), "some": F.col("doc_id").isNotNull()})
    met = asks.join(known, ["key", "some"], "left")
    return written(met.select("doc_id", "part", "words", "distinct_words", "capitals", "chars", "signs", "again", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "audited")


def edges(found: DataFrame, filters: dict[str, str]) -> DataFrame:
    """(state, filter, part, survivors, removed, good_lost, toxic_lost) of all states and the filters not in them; a state is a number
    with a bit for each filter applied."""
    spark, names = found.sparkSession, list(filters)
    root, seen = new_path(spark, "edges"), set()

    def count(rows: DataFrame, state: int) -> None:
        left = [n for i, n in enumerate(names) if not state >> i & 1]
        sums = [F.count("*").alias("survivors")]
        for n in left:
            sums += [F.count_if(c).alias(f"{n}_{k}") for k, c in (("removed", F.col(n)), ("good", F.col(n) & F.col("good")), ("toxic", F.col(n) & F.col("toxic")))]
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"{n}_removed").alias("removed"), F.col(f"{n}_good").alias("good_lost"), F.col(f"{n}_toxic").alias("toxic_lost")) for n in left]))
        by_part = rows.groupBy("part").agg(*sums)
        by_part.select(F.lit(state).alias("state"), "part", "survivors", each.alias("edge")).select("state", "part", "survivors", "edge.*").write.parquet(f"{root}/{state}")

    def walk(rows: DataFrame, state: int) -> None:
        seen.add(state)
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        count(kept, state)
        for i, n in enumerate(names):
            below = state | 1 << i
            if below not in seen and below != (1 << len(names)) - 1:
                walk(kept.where(~F.col(n)), below)
        kept.unpersist()

    walk(found.select("part", "good", "toxic", *[F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in filters.items()]), 0)
    return reduce(DataFrame.unionByName, [spark.read.schema("state int, part string, survivors long, filter string, removed long, good_lost long, toxic_lost long").parquet(f"{root}/{s}") for s in sorted(seen)])


def audited(found: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order of
    the filters and step of it, zeros included. No rows for an empty table.

    filters: a one-letter name and a condition of failure on found's columns (null: not failed) each; six at most, for their orders are all
    listed. shapley: what the filter removes, summed over all orders.
    """
    filters = FILTERS if filters is None else filters
    names, spark = list(filters), found.sparkSession
    if not 1 <= len(names) <= 6:
        raise ValueError("one to six filters")
    at = written(edges(found, filters), "edges")
    steps = []
    for order in itertools.permutations(names):
        applied = 0
        for i, n in enumerate(order, 1):
            steps.append(("".join(order), i, applied, n))
            applied |= 1 << names.index(n)
    listed = spark.createDataFrame(steps, "filter_order string, step int, state int, filter string")
    every = (1 << len(names)) - 1
    ways = F.create_map(*[F.lit(x) for s in range(every + 1) for x in (s, math.factorial(s.bit_count()) * math.factorial(max(0, len(names) - 1 - s.bit_count())))])
    last = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, every ^ 1 << i)])
    # of each part and filter: all that fail it, those that fail it alone, and the sum over the orders
    of_filter = at.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("failing"),
        F.coalesce(F.max(F.when(F.col("state") == last[F.col("filter")], F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways[F.col("state")]).alias("shapley"),
    )
    # a state that no document of a part reaches has no row: its edges are zeros
    full = of_filter.join(F.broadcast(listed), F.col("f") == F.col("filter"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    got = full.join(at.select(F.col("state").alias("s"), F.col("filter").alias("g"), F.col("part").alias("q"), "survivors", "removed", "good_lost", "toxic_lost"), F.expr("state = s AND filter = g AND p = q"), "left")
    return got.select(
        F.col("p").alias("part"), "filter_order", "step", F.coalesce(F.col("survivors") - F.col("removed"), F.lit(0)).alias("kept"), zero("removed"),
        (F.col("failing") - F.coalesce(F.col("removed"), F.lit(0))).alias("redundant"), "unique_fails", zero("good_lost"), zero("toxic_lost"), "shapley",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: five filters in all 120 orders."""
    return audited(facts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM worded LEFT JOIN known USING (doc_id)
), kinds AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)
), masks AS (
  SELECT *, 1 << (ascii(filter) - 65) AS own, list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) for i in range(1, step)])::BIGINT AS before FROM steps
), counted AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN fails & coalesce(before, 0) = 0 AND fails & own = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & coalesce(before, 0) = 0 AND fails & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & coalesce(before, 0) <> 0 AND fails & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & coalesce(before, 0) = 0 AND fails & own <> 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & coalesce(before, 0) = 0 AND fails & own <> 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM kinds, masks GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted
"""
