from newsmill.llm import suffix

from .test_suffix import brute


def texts_of_one_short_hash(spark):
    """Two texts that agree in the last 24 bits of their hash, the first with a passage that repeats in a third text."""
    passage = "".join(chr(97 + i * i % 23) for i in range(60))
    tried = spark.range(60_000).selectExpr(f"concat(id, ' {passage} ', id * 7919) AS a", "concat(id, ' ', sha2(string(id), 512)) AS b")
    low = "xxhash64({0}) & 16777215 AS h"
    one, two = tried.selectExpr("a", low.format("a")), tried.selectExpr("b", low.format("b"))
    a, b = one.join(two, "h").select("a", "b").orderBy("a", "b").first()
    return [a, b, f"{passage} elsewhere"]


def test_texts_of_one_id_keep_their_own_spans(spark):
    texts = texts_of_one_short_hash(spark)
    for doc_id in (None, 5):
        docs = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
        found = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, 40).collect()]
        assert sorted(found) == sorted(brute(texts, 40))
        assert sorted(r.text for r in suffix.without_repeats(docs, 40).collect() if r.text in texts) == [texts[1]]
