import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from newsmill.llm import tokenbin
from newsmill.llm.common import new_path, tokenizer_path

from .helpers import ODD, empty, folder, odd


def brute(rows):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_encode_as_the_whole():
    own, t = tokenbin.Encoder(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a b", "a\n b", "a \n b", "a\t b \n\n c", " lead", "x  y", "it's 12 3.5, (ok) -- no", "trail ", "two  spaces", "a \n", "\0 z", "\n\n x\n y", "é 🙂 ü", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y <|endoftext", "don't ''S", "\x1c\x85\u2028 a\u00a0 b", "漢字 ½²x_y"]
    for text in texts:
        assert np.frombuffer(own.batch([text])[0], "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_odd_rows(spark, tmp_path):
    found = tokenbin.query(spark, folder(tmp_path, documents=odd(spark))).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == brute([(r[0], r[1]) for r in ODD])


def test_random_access_and_hash(spark):
    path = tokenbin.write_tokens(odd(spark), new_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"))
    found = tokenbin.read_tokens(spark, path, [8, 5]).collect()
    assert sorted(r.doc_id for r in found) == [5, 5, 8]
    want = {r[0]: r for r in brute([(r[0], r[1]) for r in ODD])}
    assert {r.ids_crc32 for r in found if r.doc_id == 8} == {want[8][3]}
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in found)


def test_empty(spark, tmp_path):
    assert tokenbin.query(spark, folder(tmp_path, documents=empty(spark))).collect() == []


def test_driver_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, tokenbin.query(spark, d).collect()), key=lambda r: r[1]) == brute(rows)


def test_every_script_and_class_of_character():
    own, t = tokenbin.Encoder(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(chr(c) if not 0xD800 <= (c := rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0x110000)])) < 0xE000 else " '" for _ in range(rng.randrange(12)))
        assert np.frombuffer(own.batch([text])[0], "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_the_sample_is_scanned_in_parallel(spark):
    rows = [(i % 50, f"text {i}") for i in range(3000)]
    path = new_path(spark, "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    before = {s for s in range(10_000) if spark.sparkContext.statusTracker().getStageInfo(s)}
    spark.conf.set("spark.sql.files.openCostInBytes", 64 << 20)
    tokenbin.train_dictionary(spark.read.parquet(path), tokenizer_path("byte_bpe_50k.json"))
    spark.conf.unset("spark.sql.files.openCostInBytes")
    stages = [i for s in range(10_000) if s not in before and (i := spark.sparkContext.statusTracker().getStageInfo(s))]
    assert sum(i.numTasks > 1 for i in stages) >= 2  # the ids and the texts


def test_rows_without_an_id_are_dealt_to_all_tasks(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text number {i}") for i in range(3000)], "doc_id long, text string").repartition(4)
    path = tokenbin.write_tokens(docs, new_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"))
    sizes = [r.n for r in spark.read.parquet(f"{path}/blocks").selectExpr("shard", "size(doc_ids) AS n").groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
    assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) < 1500
    found = tokenbin.read_tokens(spark, path).orderBy("start").collect()
    assert all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:], strict=False))
    ids = [r.doc_id for r in found]
    assert ids == [None] * 2000 + list(range(0, 3000, 3))
