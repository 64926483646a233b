import random
import zlib

import numpy as np
import pytest
import sentencepiece

from newsmill.llm import common, pieces
from newsmill.llm.common import tokenizer_path

from .helpers import ODD, empty, folder, odd

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(text):
    """What the model's own library gives for the whole text."""
    return LIBRARY.encode(text or "")


def test_odd_rows(spark, tmp_path):
    found = pieces.query(spark, folder(tmp_path, documents=odd(spark))).collect()
    assert all(r.round_trip for r in found)
    want = sorted((r[0] or 0, brute(r[1])) for r in ODD)
    assert sorted((r.doc_id or 0, r.ids) for r in found) == want
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    assert pieces.query(spark, folder(tmp_path, documents=empty(spark))).collect() == []


def test_random_texts_and_small_packs(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PACK_WORDS", 40)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("the and ingéx,.\n▁12ß  🙂") for _ in range(rng.randrange(80)))) for i in range(200)]
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).cache()
    found = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()}
    for i, text in rows:
        assert found[i].ids == brute(text), text
        assert found[i].round_trip and back[i] == text.replace("▁", " ")


def test_documents_get_the_ids_of_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in pieces.encode(docs, PATH).collect()}
    assert all(found[r.doc_id].ids == brute(r.text) and found[r.doc_id].round_trip for r in docs.collect())


def test_long_words_stay_whole(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(["international", "information", "the", "er", "q", "ß", "🙂"]) for _ in range(n)) for n in (60, 90, 150)]
    rows = [*rows, "x" * 3000, "ab" * 300, "abc" * 400, f"{rows[0]} and {rows[1]} and {rows[0]}", "y" * 255, "y" * 256, "y" * 257, " " * 700, "z" + " " * 500 + "z", "la" * 40_000]
    found = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), PATH).collect()}
    assert len(found) == len(rows) and all(r.round_trip for r in found.values())
    assert [found[i].ids for i in range(len(rows))] == [brute(t) for t in rows]


def test_decoding_odd_ids(spark):
    rows = [(1, None), (2, []), (None, brute("é 🙂")), (None, brute("é 🙂")), (3, [3 + 0xFF])]
    found = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "é 🙂"), (0, "é 🙂"), (1, ""), (2, ""), (3, "�")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>"), PATH).collect()


def test_what_was_written_can_be_cleared(spark):
    pieces.encode(odd(spark), PATH).collect()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("newsmill_packs")]
    made = list(common._made)
    common.clean_up(spark)
    assert made and not [t.name for t in spark.catalog.listTables() if t.name.startswith("newsmill_packs")]


def test_the_vocabulary_is_not_printed_with_the_plan(spark):
    encoded = pieces.encode(odd(spark), PATH)
    assert len(encoded._jdf.queryExecution().executedPlan().toString()) < 300_000
    assert encoded.count() == len(ODD)
