import math
from collections import Counter

import numpy as np
import xxhash

from newsmill.llm import resample

from .helpers import ODD, empty, folder, odd

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, good, n=resample.BUCKETS):
    raw, target = Counter(), Counter()
    own = []
    for doc_id, text in rows:
        b = resample.buckets(text or "", resample.word_cache(), n).tolist()
        own.append(b)
        raw.update(b)
        if doc_id in good:
            target.update(b)
    r, t = sum(raw.values()) + n, sum(target.values()) + n
    return [sum(math.log((target[x] + 1) / t) - math.log((raw[x] + 1) / r) for x in b) for b in own]


def test_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (9, 0, 1), (None, 1, 0), (8, None, None)], LABELS)
    found = resample.query(spark, folder(tmp_path, documents=odd(spark), labels=labels)).collect()
    want = brute([r[:2] for r in ODD], {1, 5})
    assert np.allclose(sorted(r.log_weight for r in found), sorted(want))
    assert sorted(r["rank"] for r in found) == list(range(1, len(ODD) + 1))
    assert sum(r.selected for r in found) == math.ceil(len(ODD) / 2)
    by_rank = sorted(found, key=lambda r: r["rank"])
    assert [r.sort_key for r in by_rank] == sorted((r.sort_key for r in found), reverse=True)


def test_empty(spark, tmp_path):
    d = folder(tmp_path, documents=empty(spark), labels=spark.createDataFrame([], LABELS))
    assert resample.query(spark, d).collect() == []


def test_good_documents_rank_higher(spark):
    d = "/root/testdata/sf0.01"
    held = spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 2 = 1")
    learned = spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 2 = 0 AND quality = 1")
    found = resample.resample(spark.read.parquet(f"{d}/documents.parquet"), learned.select("doc_id"))
    share = {r.quality: r.s for r in found.join(held, "doc_id").groupBy("quality").agg({"selected": "max", "rank": "avg"}).withColumnRenamed("avg(rank)", "s").collect()}
    assert share[1] < share[0]


def test_top_k_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality == 1}
    keys = []
    for (doc_id, _), w in zip(rows, brute(rows, good), strict=True):
        u = (xxhash.xxh64_intdigest(str(doc_id), resample.SEED) + 0.5) / 2**64
        keys.append((-(w - math.log(-math.log(u))), doc_id))
    keys.sort()
    found = {r.doc_id: r for r in resample.query(spark, d).collect()}
    assert [found[i]["rank"] for _, i in keys] == list(range(1, len(rows) + 1))
    assert {i for i, r in found.items() if r.selected} == {i for _, i in keys[: math.ceil(len(rows) / 2)]}


def test_noise_draws_in_proportion_to_the_weights(spark):
    # of pairs of a weight twice as great, two thirds come first
    docs = spark.createDataFrame([(i, "heavy" if i % 2 else "light") for i in range(6000)], "doc_id long, text string")
    ratio = np.zeros(1 << 10)
    ratio[resample.buckets("heavy", resample.word_cache(), 1 << 10)] = math.log(2)
    found = {r.doc_id: r.sort_key for r in resample.weigh(docs, ratio).collect()}
    assert abs(sum(found[i] > found[i - 1] for i in range(1, 6000, 2)) / 3000 - 2 / 3) < 0.03


def test_rows_without_an_id_are_drawn_each_by_itself(spark):
    docs = spark.createDataFrame([(None, f"same words {i}") for i in range(400)] + [(i, "same words") for i in range(200)], "doc_id long, text string")
    found = resample.resample(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()
    none = [r for r in found if r.doc_id is None]
    assert len({r.sort_key for r in none}) == 400 and 100 < sum(r.selected for r in none) < 300
    assert sorted(r["rank"] for r in found) == list(range(1, 601))
