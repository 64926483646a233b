"""Tables whose own columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from newsmill.llm import decontaminate, simhash, suffix, toxicity

from .helpers import ODD, odd

NAMES = ("key", "Key_", "th", "hash", "row", "spans", "_key", "_th", "_hash", "_spans", "fp", "root", "cls", "_own_text", "lo", "n", "ah", "severity", "word")


def clashing(spark):
    return odd(spark).select("*", *[F.lit(n).alias(n) for n in NAMES])


@pytest.mark.parametrize("operator", [suffix.without_repeats, simhash.one_of_each])
def test_columns_stay_as_they_are(spark, operator):
    found, plain = operator(clashing(spark)), operator(odd(spark))
    assert found.columns == clashing(spark).columns
    rows = found.collect()
    assert sorted(map(str, (r[:5] for r in rows))) == sorted(map(str, (tuple(r) for r in plain.collect()))) and all(tuple(r[5:]) == NAMES for r in rows)


def test_scores_and_leaks(spark):
    model = toxicity.fit(clashing(spark), spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int"))
    assert toxicity.score(clashing(spark), model).count() == len(ODD)
    bench = spark.createDataFrame([(1, "same words here again and again", "x")], "item_id long, text string, n string")
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(clashing(spark), bench).collect()) == ["5", "5", "6"]
    assert decontaminate.clean(clashing(spark), bench).count() == len(ODD) - 3


def test_keys_at_the_ends_of_their_range(spark):
    rows = [(-(1 << 63), "a" * 100 + "b" * 300), (None, "c" * 50), ((1 << 63) - 1, "d e f"), (None, "d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.remove_repeats(docs).collect()}
    assert got == {(-(1 << 63), 400): 300, (None, 50): 0, ((1 << 63) - 1, 5): 0, (None, 5): 0}
    assert simhash.one_of_each(docs).count() == 3
