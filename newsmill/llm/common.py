"""What the training-data operators share: tables, the shared folder, written stages, graph components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most; Spark bounds its bytes too (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
BATCH_ROWS = 500
#: What this process has written in the shared folder: paths and tables.
_made: list[str] = []
_tables: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, for whole texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session may be without; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="newsmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made_table(spark: SparkSession, name: str) -> str:
    """The name, noted for `clean_up`."""
    _tables.append(name)
    return name


def clean_up(spark: SparkSession) -> None:
    """Drops the tables and deletes the folders that operators of this process have written; frames that read them are of no use then."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(sample: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows of sample(text, ...) in the order of their hash, as many as stay within both bounds; equal rows go together."""
    place = F.xxhash64(*sample.columns)
    first = sample.select(place.alias("place"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("place").limit(most_rows).collect()
    within, held = [], 0
    for row in first:
        held += row["n"]
        if held > most_bytes:
            break
        within.append(row["place"])
    return sample.where(place <= within[-1]) if within else sample.limit(0)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with as many underscores behind as it takes to differ from the columns', case apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def strings(column: pa.Array) -> list[str]:
    """Null: empty."""
    return [x or "" for x in column.to_pylist()]


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on and the executor's memory counts what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class WordCache(dict):
    """word -> make(word), kept for the next use. Bounded: once it holds `most` words they become the old half, from which a word used again comes back."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        value = self.old.get(word)
        return self.put(word, self.make(word) if value is None else value)

    def put(self, word, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def fill(self, words, make) -> None:
        """Puts the values that make(list) gives to those of the words that are not held."""
        new = [w for w in words if w not in self and w not in self.old]
        for word, value in zip(new, make(new), strict=True):
            self.put(word, value)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, root), root being the least node of the component.

    Rounds of contraction: every node hooks on to its least neighbour where that is smaller, pointers are
    jumped until they rest on roots, and the edges are rewritten between the roots. Each step joins or
    aggregates by node; a node's pointer is one row, however many edges it has.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).withColumnRenamed("a", "v"), "parents")
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = written(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            parent, moved = jumped.select("v", "p"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            nxt = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            labels = written(labels.join(nxt, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "labels")
        of_a, of_b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = written(edges.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        labels = spark.createDataFrame([], edges.select(F.col("a").alias("v"), F.col("b").alias("p")).schema)
    return labels.select(F.col("v").alias("node"), F.col("p").alias("root"))


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def by_key(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows where there are so many, from batches sorted by key; no key's rows are torn apart."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            count = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; NEWSMILL_TOKENIZERS names another folder."""
    folder = os.environ.get("NEWSMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
