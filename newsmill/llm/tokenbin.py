"""Token ids in a binary format with a shared zstandard dictionary and an offset index.

Format, a folder with three Parquet tables (Spark commits them, so lost tasks leave nothing behind):

* `dictionary`: one row, dict_hash (XXH64 of the dictionary, hex), width (bytes of an id) and the dictionary;
* `blocks`: shard, block, first_doc, dict_hash, `payload` (zstandard frames, one a document, end to end) and the
  index: doc_ids, starts (ids of the shard's documents before), n_tokens, offsets (of each frame in the payload);
* `shards`: shard, base (ids in all earlier shards).

Shards are ranges of doc_id in ascending order and so are the blocks in them. A short document is read by its
index columns alone (Parquet prunes the payload) and then one frame of one payload.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache as memo

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, crc, new_path, prepare, strings, tokenizer_path

END_ID = 0
#: Documents and bytes that the dictionary is trained on at most; it only changes sizes, never what is read back.
TRAIN_DOCS, TRAIN_BYTES, DICT_BYTES = 400, 8_000_000, 65_536
BLOCK_BYTES = 1 << 20


#: Fixed value: the pre-token pattern of the byte-level vocabulary.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


_SHORT = regex.compile(r"'(?:[stmd]|re|ve|ll)")
_SPACE = 3


@memo
def character_classes() -> np.ndarray:
    """Of each code point: 1 a letter, 2 a number, 3 a space, 0 anything else."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def pretokens(text: str) -> list[str]:
    """What the pattern finds: runs of a class, with a space before; the last space of a run of spaces stands apart."""
    if not text:
        return []
    if "'" in text and _SHORT.search(text):
        return _PATTERN.findall(text)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = character_classes()[points]
    start = np.ones(len(points), bool)
    start[1:] = kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & start[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


def byte_letters() -> dict[int, str]:
    """byte -> the letter that the library writes it with, learned from characters that hold every byte of UTF-8."""
    from tokenizers import pre_tokenizers

    own, out = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in (*range(0x800), *range(0x800, 0xD800, 0x100), *range(0xE000, 0x110000, 0x1000)):
        for b, letter in zip(chr(c).encode(), own.pre_tokenize_str(chr(c))[0][0], strict=True):
            out[b] = letter
    return out


class Encoder:
    """Whole texts to ids as little-endian bytes.

    A text is cut into pre-tokens as the vocabulary's pattern cuts it, the library's model turns each into ids.
    Pre-tokens repeat, so their ids are kept. A text that holds the string of an added token (`<|endoftext|>`) is
    given to the library whole, which makes it that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.tokens = WordCache(self.token, 600_000)
        self.bytes = byte_letters()
        self.end = np.array([END_ID], self.kind).tobytes()

    def token(self, token: str) -> bytes:
        letters = token.encode("utf-8").decode("latin-1").translate(self.bytes)
        return array(self.code, [x.id for x in self.tokenizer.model.tokenize(letters)]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        get = self.tokens.__getitem__
        return [(self.whole(t) if any(a in t for a in self.added) else b"".join(map(get, pretokens(t)))) + self.end for t in texts]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, so that its cache serves later tasks too."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def train_dictionary(docs: DataFrame, path: str) -> tuple[bytes, int]:
    """(dictionary, width of an id). Trained on the TRAIN_DOCS rows whose ids hash lowest; empty for few or tiny documents."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # the scan stays parallel; the limit brings what it found into one task, rows of a repeated id included
    some = docs.join(F.broadcast(ids.distinct()), "doc_id").select("text").limit(TRAIN_DOCS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, samples, size = encoder(path), [], 0
        for batch in batches:
            for raw in own.batch(strings(batch.column(0))) if size < TRAIN_BYTES else []:
                samples.append(raw)
                size += len(raw)
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            trained = b""
        yield pa.RecordBatch.from_pydict({"dictionary": [trained], "width": [own.width]})

    rows = some.mapInArrow(train, "dictionary binary, width long").collect()
    return (bytes(rows[0][0]), rows[0][1]) if rows else (b"", 2)


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Encodes docs(doc_id, text) and writes the format to path. Null text: empty; null doc_id comes first; rows may repeat."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained, width = train_dictionary(docs, tokenizer)
    dict_hash = xxhash.xxh64_hexdigest(trained)
    spark.createDataFrame([(dict_hash, width, trained)], "dict_hash string, width long, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            raw = own.batch(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // width for x in raw], pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())], ["doc_id", "n_tokens", "frame"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts are dealt out, not frames: finding the ranges reads the rows once before, and must not encode them
    # ids alone would put all rows of one id, or of none, into one range; of equal ids the order is free
    ranged = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    frames = ranged.mapInArrow(encode, "doc_id long, n_tokens long, frame binary").withColumn("shard", F.spark_partition_id())

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, counts, frames, size, at, number, shard = [], [], [], 0, 0, 0, None

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in frames])
            starts = at + np.cumsum([0, *counts[:-1]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([doc_ids[0]], pa.int64()), pa.array([dict_hash]), pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([[0, *ends.tolist()]], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary()),
                ],
                ["shard", "block", "first_doc", "dict_hash", "doc_ids", "starts", "n_tokens", "offsets", "payload"],
            )

        for batch in batches:
            for doc_id, n, frame, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                doc_ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield out()
                    at, number = at + sum(counts), number + 1
                    doc_ids, counts, frames, size = [], [], [], 0
        if frames:
            yield out()

    schema = "shard int, block long, first_doc long, dict_hash string, doc_ids array<long>, starts array<long>, n_tokens array<long>, offsets array<long>, payload binary"
    # the frames are compressed already
    frames.mapInArrow(block, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").select("shard", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    bases, base = [], 0
    for row in totals:  # a row a shard, of which there are as many as shuffle partitions
        bases.append((row["shard"], base))
        base += row["n"]
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")
    return path


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary of unsigned 32-bit little-endian integers) from the files at path.

    doc_ids: only these, decompressing no other frame.
    """
    row = spark.read.parquet(f"{path}/dictionary").first()
    trained, width, dict_hash = bytes(row["dictionary"]), row["width"], row["dict_hash"]
    if xxhash.xxh64_hexdigest(trained) != dict_hash:
        raise ValueError("the dictionary does not match its hash")
    wanted = None if doc_ids is None else frozenset(doc_ids)
    # a row a shard: as many as the writer's shuffle partitions
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    if doc_ids is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in doc_ids])))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != dict_hash:
                    raise ValueError("a block names another dictionary")
                keep = [i for i, d in enumerate(b["doc_ids"]) if wanted is None or d in wanted]
                for j in range(0, len(keep), 256):
                    ids = [np.frombuffer(unpack.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]]), f"<u{width}").astype("<u4").tobytes() for i in keep[j : j + 256]]
                    at = keep[j : j + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b["doc_ids"][i] for i in at], pa.int64()), pa.array([b["base"] + b["starts"][i] for i in at], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([crc(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    columns = ["dict_hash", "doc_ids", "starts", "offsets", "base", "payload"]
    return blocks.select(columns).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document through the files; start, n_tokens and ids_crc32 come from what was read back."""
    from .common import table

    path = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, path).drop("ids")
