import hashlib
import io
import random
import shutil
import wave
import zlib

import pytest

from newsmill.llm import media
from newsmill.llm.common import new_path

from .helpers import ODD, empty, folder, odd


def brute(doc_id, text):
    raw = (text or "").encode()
    full = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
    return (doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def gear_cuts(data):
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - last
        if n >= media.LEAST and h >> (32 - media.BITS) == 0 or n == media.MOST:
            last = i + 1
            ends.append(last)
    return ends if last == len(data) else [*ends, len(data)]


def test_cuts_are_those_of_the_rolling_hash():
    rng = random.Random(1)
    for n in (44, 300, 5000, 60_000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert media.cuts(data) == gear_cuts(data)
        assert b"".join(media.chunks(data)) == data
    assert media.cuts(bytes(20_000)) == gear_cuts(bytes(20_000))


def test_odd_rows(spark, tmp_path):
    found = media.query(spark, folder(tmp_path, documents=odd(spark))).collect()
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found]
    assert sorted(map(str, got)) == sorted(str(brute(*r[:2])) for r in ODD)
    assert all(r.media_bytes == r.payload_bytes + 44 for r in found)
    assert media.query(spark, folder(tmp_path, documents=empty(spark))).collect() == []


def test_shared_chunks_are_stored_once(spark, tmp_path):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    rows = [(i, base[: 18_000 - i] + str(i) if i % 2 else base) for i in range(8)] + [(9, "alone " * 10)]
    path = new_path(spark, "m")
    media.store(spark.createDataFrame(rows, "doc_id long, text string"), path)
    chunks = spark.read.parquet(f"{path}/media").where("kind = 1").selectExpr("digests[0] as d", "sizes[0] as n")
    assert chunks.count() == chunks.distinct().count()
    assert chunks.groupBy().sum("n").first()[0] < 30_000
    back = {r.doc_id: bytes(r.media) for r in media.rebuilt(spark, path).collect()}
    assert back == {i: media.wav(media.payload(t)[0]) for i, t in rows}
    equal = media.features(media.rebuilt(spark, path)).where("doc_id IN (0, 2, 4)").drop("doc_id").distinct().count()
    assert equal == 1


def test_damage_is_found(spark):
    path = new_path(spark, "m")
    media.store(spark.createDataFrame([(1, "x" * 900)], "doc_id long, text string"), path)
    rows = spark.read.schema(media.MEDIA).parquet(f"{path}/media")
    other = new_path(spark, "m")
    shutil.copytree(f"{path}/dictionary", f"{other}/dictionary")
    rows.selectExpr("kind", "key", "th", "doc_id", "n_bytes", "sha256", "transform(digests, d -> cast('0' as binary)) AS digests", "sizes", "shared", "data").write.partitionBy("kind").parquet(f"{other}/media")
    with pytest.raises(Exception, match="does not match its digest"):
        media.rebuilt(spark, other).collect()


def test_a_lost_chunk_raises(spark):
    path, text = new_path(spark, "m"), "".join(random.Random(6).choice("abcdefgh ") for _ in range(9000))
    media.store(spark.createDataFrame([(1, text), (2, text), (3, "alone")], "doc_id long, text string"), path)
    assert media.rebuilt(spark, path).count() == 3
    shutil.rmtree(f"{path}/media/kind=1")
    with pytest.raises(Exception, match="is missing"):
        media.rebuilt(spark, path).collect()


def test_contract_values_of_driver_rows(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: brute(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in media.query(spark, d).collect():
        full = (t := want[r.doc_id]) and r
        assert (full.doc_id, full.n_bytes, full.payload_bytes, full.payload_sha256, full.tail_crc32) == t


def test_stored_form_and_feature(spark):
    rows = [(1, "Some text, é."), (2, None), (3, "Some text, é.")]
    found = {r.doc_id: r for r in media.features(media.rebuilt(spark, media.store(spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "m")))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        full = raw + bytes(64 - len(raw))
        with io.BytesIO() as out:
            with wave.open(out, "wb") as w:
                w.setparams((1, 1, media.RATE, 0, "NONE", "none"))
                w.writeframes(full)
            assert found[i].media_sha256 == hashlib.sha256(out.getvalue()).hexdigest()
        x = [b - 128 for b in full]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert found[i].feature == f"mean={sum(x) / 64:.4f};rms={(sum(v * v for v in x) / 64) ** 0.5:.4f};peak={max(map(abs, x))};crossings={crossings}"
