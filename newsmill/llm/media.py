"""Media columns: payloads in content-defined chunks, stored once each, and rebuilt.

A text's bytes, padded with zeros to a multiple of UNIT, are the samples of an 8-bit mono WAV file, which is the stored
form. A rolling gear hash cuts the file into chunks of about 1 KB; Spark joins find the chunks that more than one place
holds. The store is a folder of two Parquet tables. `dictionary` has one row, the dictionary of all frames and its hash.
`media` has two kinds of rows: kind=0, a row a document with its ordered list of chunk digests and the bytes of the chunks
that stand nowhere else; kind=1, every chunk that is shared, once. A file is rebuilt from its list, each chunk is held
against its digest and the file against its SHA-256; a chunk that is not there raises.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, new_path, prepare, table, written

UNIT, RATE = 64, 8000
LEAST, MOST, BITS, WINDOW = 256, 4096, 10, 32
LEVEL, TRAIN_DOCS, DICT_BYTES = 15, 800, 112 << 10
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 5) for b in range(256)], np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 padded with zeros to a positive multiple of UNIT, bytes before that)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def wav(samples: bytes) -> bytes:
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data" or struct.unpack("<I", media[40:44])[0] != len(media) - 44:
        raise ValueError("not a WAV file of this store")
    return media[44:]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last WINDOW bytes has BITS zero bits, LEAST to MOST bytes apart."""
    h = _GEAR[np.frombuffer(media, np.uint8)]
    step = 1
    while step < WINDOW:  # the sum of 2 * step bytes from two of step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = at
            ends.append(last)
    while len(media) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(media):
        ends.append(len(media))
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(samples: bytes) -> str:
    """Mean, root mean square, peak and zero crossings of the samples about 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("th"), "doc_id", "text")


def dictionary(trained: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(trained) if trained else None


def train(docs: DataFrame) -> bytes:
    """A dictionary of the TRAIN_DOCS texts whose ids hash lowest; it changes sizes only."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [t.encode("utf-8", "surrogatepass") for b in batches for t in b.column(0).to_pylist() if t]
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b""
        yield pa.RecordBatch.from_pydict({"d": [made]})

    # the scan stays parallel; the limit brings what it found into one task, rows of a repeated id included
    rows = docs.join(F.broadcast(ids.distinct()), "doc_id").select("text").limit(TRAIN_DOCS).mapInArrow(run, "d binary").collect()
    return bytes(rows[0][0]) if rows else b""


MEDIA = "kind int, key long, th long, doc_id long, n_bytes long, sha256 string, digests array<binary>, sizes array<int>, shared array<boolean>, data binary"


def store(docs: DataFrame, path: str) -> str:
    """Writes the store of docs(doc_id, text) to path. Null text: empty. Repeated rows, null doc_ids and rows that share one are rows of their own."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(docs)
    trained = train(docs.select("doc_id", "text"))
    spark.createDataFrame([(xxhash.xxh64_hexdigest(trained), trained)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[digest(c) for c in chunks(wav(payload(t)[0]))] for t in b.column(2).to_pylist()]
            n = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([d for x in own for d in x], pa.binary()), *(pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in (0, 1)), pa.array(np.concatenate([*(np.arange(k) for k in n), np.zeros(0, int)]).astype(np.int32))], ["digest", "key", "th", "seq"])

    places = written(keyed.select("key", "th", "text").mapInArrow(index, "digest binary, key long, th long, seq int"), "chunk-index", compression="zstd")
    shared = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "seq")).alias("owner")).where("n > 1").select("digest", "owner")
    shared = written(shared, "shared-chunks")
    marks = places.join(shared, "digest").select("key", "th", F.struct("seq", (F.struct("key", "th", "seq") == F.col("owner")).alias("owns")).alias("mark")).groupBy("key", "th").agg(F.collect_set("mark").alias("marks"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(trained))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()], pa.binary())], ["key", "th", "doc_id", "frame"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = dictionary(trained)
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL, dict_data=given), zstandard.ZstdDecompressor(dict_data=given)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                raw = unpack.decompress(r["frame"])
                media = wav(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                own = chunks(media)
                digests = [digest(c) for c in own]
                marks = {m["seq"]: m["owns"] for m in r["marks"] or []}
                inline = b"".join(c for i, c in enumerate(own) if i not in marks)
                rows.append((0, r["key"], r["th"], r["doc_id"], len(raw), hashlib.sha256(media).hexdigest(), digests, [len(c) for c in own], [i in marks for i in range(len(own))], pack.compress(inline)))
                rows += [(1, r["key"], r["th"], r["doc_id"], 0, "", [digests[i]], [len(own[i])], [True], pack.compress(own[i])) for i, owns in marks.items() if owns]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in MEDIA.split(", ")])

    frames = keyed.mapInArrow(squeeze, "key long, th long, doc_id long, frame binary")
    rows = frames.join(marks.hint("shuffle_hash"), ["key", "th"], "left").mapInArrow(build, MEDIA)
    # frames are compressed already
    rows.write.partitionBy("kind").option("compression", "none").parquet(f"{path}/media")
    return path


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of the store; raises where a chunk is missing or a chunk or a file is not what its digest says."""
    prepare(spark)
    row = spark.read.parquet(f"{path}/dictionary").first()
    trained = bytes(row["dictionary"])
    if xxhash.xxh64_hexdigest(trained) != row["dict_hash"]:
        raise ValueError("the dictionary does not match its hash")
    rows = spark.read.schema(MEDIA).parquet(f"{path}/media")
    media = rows.where("kind = 0").select("key", "th", "doc_id", "n_bytes", "sha256", "digests", "sizes", "shared", "data")
    has = F.exists("shared", lambda x: x)
    # a repeated row owns its chunks twice
    chunk = rows.where("kind = 1").groupBy(F.get("digests", F.lit(0)).alias("digest")).agg(F.min("data").alias("data"))
    wanted = media.where(has).select("key", "th", F.posexplode(F.arrays_zip("digests", "shared")).alias("seq", "c")).where("c.shared").select("key", "th", "seq", F.col("c.digests").alias("digest")).distinct()
    fetched = wanted.join(chunk, "digest", "left").groupBy("key", "th").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    columns = ["doc_id", "n_bytes", "sha256", "digests", "sizes", "shared", "data", "fetched"]
    nothing = F.lit(None).cast("array<struct<seq:int,data:binary>>").alias("fetched")
    ready = media.where(~has).select(*columns[:-1], nothing).unionByName(media.where(has).join(fetched, ["key", "th"], "left").select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=dictionary(trained))
        for b in batches:
            out = []
            for r in b.to_pylist():
                inline, at, parts = unpack.decompress(r["data"]), 0, []
                fetched = {f["seq"]: f["data"] for f in r["fetched"] or []}
                for i, (d, n, shared) in enumerate(zip(r["digests"], r["sizes"], r["shared"], strict=True)):
                    if shared:
                        if fetched.get(i) is None:
                            raise ValueError(f"chunk {i} of document {r['doc_id']} is missing")
                        part = unpack.decompress(fetched[i])
                    else:
                        part, at = inline[at : at + n], at + n
                    if digest(part) != d:
                        raise ValueError(f"chunk {i} of document {r['doc_id']} does not match its digest")
                    parts.append(part)
                whole = b"".join(parts)
                if hashlib.sha256(whole).hexdigest() != r["sha256"]:
                    raise ValueError(f"the media of document {r['doc_id']} do not match their digest")
                out.append(whole)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return ready.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_pylist()
            samples = [samples_of(m) for m in own]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(s) for s in samples], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in samples], pa.string()), pa.array([crc(s[-UNIT:]) for s in samples], pa.int64()),
                    pa.array([len(m) for m in own], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in own], pa.string()), pa.array([feature(s) for s in samples], pa.string()),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document stored, rebuilt and measured. Null text: empty. Repeated rows and null doc_ids stay."""
    return features(rebuilt(spark, store(table(spark, sf_dir, "documents"), new_path(spark, "media"))))
