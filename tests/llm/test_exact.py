import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newsmill.llm import exact

from .helpers import ODD, empty, odd


def plain(rows, largest=True):
    """One line a row: doc_id, keep_id, group_size, text_sha256; and how many of each (doc_id, text) are kept."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        ids = [x for x in own if x is not None]
        out.append((i, (max if largest else min)(ids) if ids else None, len(own), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(map(str, out)), len(groups)


def check(found, rows, largest=True):
    got = found.collect()
    want, groups = plain(rows, largest)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("step", [1, 2, 4])
def test_runs_of_many_partitions_are_merged(spark, step):
    rng = random.Random(step)
    rows = []
    for i in range(600):
        text = "Hot" if rng.random() < 0.4 else rng.choice(["A", "a", "É", "é", ""]) + "b" * rng.randrange(9)
        rows.append((rng.choice([None, i, i // 3]), rng.choice([text, text.upper() if text.isascii() else text, None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    check(exact.copies(docs, step=step), rows)
    check(exact.copies(docs, largest=False, step=step), rows, largest=False)


def test_entries_of_one_digest_are_verified(spark):
    rows = spark.createDataFrame([(f"text {i % 7}", i) for i in range(90)], "text string, doc_id long").repartition(9)
    weak = exact.digested(rows, F.col("text"), F.col("doc_id"), F.col("text").alias("own")).withColumn("digest", F.lit(b"same"))
    found = exact.settled(weak, exact.KEYS, F.struct("doc_id", "place"), 1).collect()
    assert len(found) == 90
    for r in found:
        same = [i for i in range(90) if f"text {i % 7}" == r.own]
        assert (r.best.doc_id, r.copies) == (min(same), len(same))


def test_odd_rows(spark):
    check(exact.copies(odd(spark)), [(r[0], r[1]) for r in ODD])
    assert exact.copies(empty(spark)).collect() == []
    named = odd(spark).select("*", *[F.lit("x").alias(n) for n in ("place", "run", "digest", "size", "second", "best", "copies", "key", "sha", "up")])
    check(exact.copies(named), [(r[0], r[1]) for r in ODD])
    left = exact.one_of_each(named)
    assert left.columns == named.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 3, 4, 6, 7, 8, 9, None]))


def test_very_long_and_repeated_rows(spark):
    long = "Lorem ipsum " * 200_000
    rows = [(1, long), (2, long.lower()), (3, long + "!")] + [(None, long)] * 5
    check(exact.copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)


def test_ends_of_the_range(spark):
    rows = [(-(1 << 63), "a"), ((1 << 63) - 1, "A"), (0, "a"), (-(1 << 63), "b")]
    check(exact.copies(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_no_python_in_the_plan(spark):
    plan = exact.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
