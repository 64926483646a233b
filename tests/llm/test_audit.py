import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from newsmill.llm import audit

from .helpers import ODD, empty, odd

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    out = []
    for i, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        marks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), again)
        out.append("".join(n for n, m in zip("ABCDE", marks, strict=True) if m))
    return out


def plain(rows, labels, fails=None, names="ABCDE"):
    """Brute force: every order runs over all documents."""
    fails = failing(rows) if fails is None else fails
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        lines, removed_in_all = [], dict.fromkeys(names, 0)
        for order in itertools.permutations(names):
            left = own
            for step, n in enumerate(order, 1):
                gone = [d for d in left if n in d[1]]
                left = [d for d in left if n not in d[1]]
                removed_in_all[n] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(n in d[1] for d in own) - len(gone), sum(d[1] == n for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), n))
        out += [(*x[:-1], removed_in_all[x[-1]]) for x in lines]
    return sorted(out)


def rows_and_labels(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = rng.choice([["a", "b"], [f"w{j}" for j in range(500)], ["A", "B", "c"], ["x#", "y"]])
        text = " ".join(rng.choice(w) for _ in range(rng.choice([3, 199, 200, 201, 400])))
        rows.append((rng.choice([i, i, i, None]), rng.choice([text, "same text", None, ""]), rng.choice(["en", "de", None, ""]), "s", 1))
    return rows, [(rng.choice([i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)]


def test_against_brute_force(spark):
    rows, labels = rows_and_labels(1, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = audit.audited(audit.facts(docs, spark.createDataFrame(labels + labels[:9], LABELS)))
    got = sorted(map(tuple, found.collect()))
    assert got == plain(rows, labels) and len({r[0] for r in got}) == 3 and len(got) == 3 * 600


def test_each_state_is_walked_once(spark):
    found = spark.createDataFrame([("p", True, False, i) for i in range(8)], "part string, good boolean, toxic boolean, x int")
    filters = {"A": "x & 1 = 1", "B": "x & 2 = 2", "C": "CASE WHEN x = 7 THEN NULL ELSE x & 4 = 4 END"}
    at = audit.edges(found, filters)
    assert sorted((r.state, r.filter) for r in at.collect()) == sorted((s, n) for s in range(7) for i, n in enumerate("ABC") if not s >> i & 1)
    fails = ["".join(n for n, bit in (("A", 1), ("B", 2), ("C", 4)) if x & bit and not (n == "C" and x == 7)) for x in range(8)]
    got = sorted(map(tuple, audit.audited(found, filters).collect()))
    assert got == plain([(i, "", "p") for i in range(8)], [(i, 1, 0) for i in range(8)], fails, "ABC")


def test_odd_rows(spark):
    clashing = odd(spark).select("*", *[F.lit("x").alias(n) for n in ("place", "part", "words", "digest", "key", "some", "good", "again")])
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (None, 1, 1)], LABELS)
    got = sorted(map(tuple, audit.audited(audit.facts(clashing, labels)).collect()))
    assert got == plain(ODD, [(5, 1, 1)])
    one = {"A": audit.FILTERS["A"]}
    assert audit.audited(audit.facts(empty(spark), labels), one).collect() == []
    assert audit.audited(audit.facts(odd(spark), spark.createDataFrame([], LABELS)), one).where("good_lost + toxic_lost > 0").count() == 0


def test_filters_are_bounded(spark):
    with pytest.raises(ValueError):
        audit.audited(odd(spark), {})
