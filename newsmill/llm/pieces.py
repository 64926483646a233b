"""SentencePiece encoding and decoding over a relational lattice.

Pieces never hold certain neighbouring characters (a letter before a space mark, say), so a text falls apart into words
between which every segmentation has a boundary. Spark joins do the segmentation once for each distinct word: its
substrings of at most the longest piece's length are exploded and equi-joined to the piece table, the edges are
grouped by word, and a higher-order aggregate folds them (Viterbi). Texts wait meanwhile as codes of their words, in
packs of some megabytes; a pack's words are joined with their ids and the codes replaced by ids.

The scores of a BPE model are ranks of merges, so a sum of them says nothing. The fold weighs an edge by whether merging
would leave its piece beside the one before it: no piece may join the right end of the one to the left end of the
other before both ends are merged into their own. Of the edges to a place exactly one is so; the path is the model's own
encoding.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache as memo

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import crc, give_back, made_table, new_path, prepare, strings, table, tokenizer_path

SPACE = "▁"
#: Longer words are segmented one by one where they are found, by the same rule, not in the lattice of Spark.
MOST_CHARS = 256
PACK_WORDS, PACK_BYTES = 400_000, 32 << 20
#: Words whose codes a task keeps at hand.
CACHED = 150_000
#: An edge is one number: end, begin, id of the piece, BITS bits each. An end of a piece: piece, rank of the merge that takes it.
BITS = 20
NEVER = (1 << BITS) - 1
#: Slots that joins are filed in.
SLOTS = 1 << 16
_WORD = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


@dataclass(frozen=True)
class Vocabulary:
    """ids: of the pieces that merging can make; of_byte: ids of bytes; decoded: the bytes of each id; pairs: neighbours
    that stand in any piece; right, left: by id, the pieces that are its ends while it is merged, itself first, each with
    the rank of the merge that takes it; joins: (left piece, right piece) -> rank of their merge."""

    ids: dict[str, int]
    of_byte: dict[int, int]
    decoded: list[bytes]
    pairs: frozenset[str]
    longest: int
    right: list[list[tuple[int, int]]]
    left: list[list[tuple[int, int]]]
    joins: dict[tuple[int, int], int]


def last_join(piece: str, score: dict[str, float]) -> int:
    """Where the last merge of a piece joins its two parts: neighbours of the best score are merged first, the leftmost of equals. 0: merging never makes it."""
    parts, at = list(piece), 0
    while len(parts) > 1:
        joined = [(score[x], -i) for i, x in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if x in score]
        if not joined:
            return 0
        i = -max(joined)[1]
        at = len(parts[0])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return at


@memo
def vocabulary(path: str) -> Vocabulary:
    """Of a BPE model's file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score, ids, of_byte, decoded = {}, {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            decoded.append(b"")
        else:
            decoded.append(piece.replace(SPACE, " ").encode())
            ids[piece], score[piece] = i, sp.get_score(i)
    pairs = frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1))
    at = {p: last_join(p, score) for p in ids if len(p) > 1}
    ids = {p: i for p, i in ids.items() if len(p) == 1 or at[p]}
    place = {s: n for n, s in enumerate(sorted({score[p] for p in ids if len(p) > 1}, reverse=True))}
    right, left = [[] for _ in decoded], [[] for _ in decoded]
    for piece, i in ids.items():
        for ends, part in ((right, lambda p: p[at[p] :]), (left, lambda p: p[: at[p]])):
            p, rank = piece, NEVER
            ends[i].append((i, rank))
            while len(p) > 1:
                p, rank = part(p), place[score[p]]
                ends[i].append((ids[p], rank))
    joins = {(ids[p[: at[p]]], ids[p[at[p] :]]): place[score[p]] for p in ids if len(p) > 1}
    return Vocabulary(ids, of_byte, decoded, pairs, max(map(len, ids)), right, left, joins)


class Codes(dict):
    """word without its first space mark -> the codes of its cells, 4 bytes each; cells: cell -> code, in order.

    A word is cut into cells where no piece goes on; words of letters alone hardly ever could be, and need not be.
    """

    def __init__(self, pairs: frozenset[str]):
        super().__init__()
        self.pairs, self.cells = pairs, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        cells, own = self.cells, SPACE + word
        if word.isalpha() and len(own) <= MOST_CHARS:
            value = cells.setdefault(own, len(cells)).to_bytes(4, "little")
        else:
            pairs = self.pairs
            at = [0, *[i for i in range(1, len(own)) if own[i - 1 : i + 1] not in pairs], len(own)]
            value = b"".join([cells.setdefault(own[a:b], len(cells)).to_bytes(4, "little") for a, b in zip(at, at[1:], strict=False)])
        self[word] = value
        return value


def words_of(text: str) -> list[str]:
    """The text's words behind the first of the space marks before each; the text has one before it."""
    if "  " in text or text[0] == " ":
        return _WORD.findall(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


def best_path(word: str, v: Vocabulary) -> list[int]:
    """The ids that `lattice` gives, for a word of any length: the last piece by place, followed back from the end."""
    last, begin = [-1], [0]
    for e in range(1, len(word) + 1):
        for b in range(max(0, e - v.longest), e):
            own = v.ids.get(word[b:e], -1)
            if (own >= 0 or e - b == 1) and not (own >= 0 and last[b] >= 0 and any(v.joins.get((r, x), NEVER) < min(m, n + 1) for r, m in v.right[last[b]] for x, n in v.left[own])):
                last.append(own)
                begin.append(b)
                break
    out, e = [], len(word)
    while e:
        out += [last[e]] if last[e] >= 0 else [v.of_byte[x] for x in reversed(word[begin[e] : e].encode())]
        e = begin[e]
    return out[::-1]


def blob(code: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted codes by their steps, numbers of ids and ids, compressed."""
    raw = np.diff(code.astype(np.int64), prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes() + ids.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Packs of docs(doc_id, text): doc_ids, crcs of the texts, words a document, codes of those words, and the pack's words.

    longs has the ids of the words over MOST_CHARS as `gather` gives those of the others; they are null among the words.
    """
    pairs = vocabulary(path).pairs
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # looked at where a long word is found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        codes, doc_ids, crcs, counts, parts = Codes(pairs), [], [], [], []
        size = 0

        def out() -> pa.RecordBatch:
            number = int.from_bytes(os.urandom(8), "little", signed=True)
            # codes by falling frequency, their bytes apart: high bytes are nearly all zero
            flat = np.frombuffer(b"".join(parts), "<u4")
            parts.clear()
            by = np.argsort(-np.bincount(flat, minlength=len(codes.cells)), kind="stable")
            rank = np.empty(len(by), "<u4")
            rank[by] = np.arange(len(by))
            listed = list(codes.cells)
            listed = [listed[i] for i in by.tolist()]
            long = [i for i, w in enumerate(listed) if len(w) > MOST_CHARS]
            paths = [best_path(listed[i], shared.value) for i in long]
            longs = {"n": len(long), "blob": blob(np.array(long), np.array([len(x) for x in paths]), np.concatenate(paths))} if long else None
            for i in long:
                listed[i] = None
            planes = np.ascontiguousarray(rank[flat].view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()
            cells = ([number], [doc_ids], [crcs], [counts], [squeeze.compress(planes)], [listed], [longs])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.struct([("n", pa.int64()), ("blob", pa.binary())]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["pack", "doc_ids", "crcs", "counts", "codes", "words", "longs"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                text = text.replace(SPACE, " ")
                own = b"".join(map(codes.__getitem__, words_of(text))) if text else b""
                doc_ids.append(doc_id)
                crcs.append(crc(text.encode("utf-8", "surrogatepass")))
                counts.append(len(own) // 4)
                parts.append(own)
                size += len(text)
                if len(codes.cells) >= PACK_WORDS or size >= PACK_BYTES:
                    yield out()
                    codes, doc_ids, crcs, counts, parts = Codes(pairs), [], [], [], []
                    give_back()
                    size = 0
        if doc_ids:
            yield out()
        del codes, doc_ids, crcs, counts, parts
        give_back()

    schema = "pack long, doc_ids array<long>, crcs array<long>, counts array<long>, codes binary, words array<string>, longs struct<n:long,blob:binary>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(NEVER))


def _high(x: Column) -> Column:
    return F.shiftright(x, BITS)


def merges(spark: SparkSession, v: Vocabulary) -> Column:
    """(right, left, joins) of the vocabulary as one value: ends by id, and joins by slot. It comes from a subquery, for literals of that
    size would be printed whole with every state of the plan, which the driver keeps."""
    filed: list[list[int]] = [[] for _ in range(SLOTS)]
    for (r, x), m in v.joins.items():
        filed[(r * 31 + x * 17) % SLOTS].append((r << BITS | x) << BITS | m)
    right, left = ([[i << BITS | m for i, m in own] for own in side] for side in (v.right, v.left))
    kind = pa.list_(pa.list_(pa.int64()))
    row = pa.table({k: pa.array([x], kind) for k, x in (("right", right), ("left", left), ("joins", filed))})
    return spark.createDataFrame(row).select(F.struct("right", "left", "joins")).scalar()


def joined_before(known: Column, before: Column, edge: Column) -> Column:
    """Of two edges, one behind the other: whether a piece would join an end of the one to an end of the other. known: `merges`."""
    def found(r: Column, x: Column) -> Column:
        pair = F.shiftleft(_high(r), BITS).bitwiseOR(_high(x))
        slot = (_high(r) * 31 + _high(x) * 17).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
        return F.exists(F.get(known["joins"], slot), lambda j: (_high(j) == pair) & (_low(j) < _low(r)) & (_low(j) <= _low(x)))

    return F.exists(F.get(known["right"], _low(before).cast("int")), lambda r: F.exists(F.get(known["left"], _low(edge).cast("int")), lambda x: found(r, x)))


def lattice(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of each distinct word: the one path on which merging would leave every two neighbours apart."""
    spark, v = words.sparkSession, vocabulary(path)
    known = spark.createDataFrame(list(v.ids.items()), "known string, id int").select(F.xxhash64("known").alias("hash"), "known", "id")
    # a number of its own spares the sort by word; it lives and dies in one stage
    sub = words.select("word", F.length("word").alias("n"), F.monotonically_increasing_id().alias("at")).where("n > 0")
    sub = sub.select("at", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"))
    sub = sub.select("at", "word", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(v.longest), F.col("n") - F.col("b")))).alias("l"))
    sub = sub.select("at", "word", "b", "l", F.substring("word", F.col("b") + 1, F.col("l")).alias("piece")).withColumn("hash", F.xxhash64("piece"))
    # the piece table is the vocabulary, of one size whatever the corpus; a character that is no piece has id 0
    edge = sub.join(F.broadcast(known), "hash", "left").where("piece = known OR l = 1")
    end, begin = (F.shiftleft(x.cast("long"), n * BITS) for x, n in ((F.col("b") + F.col("l"), 2), (F.col("b"), 1)))
    edge = edge.select("at", "word", end.bitwiseOR(begin).bitwiseOR(F.when(F.col("piece") == F.col("known"), F.col("id")).otherwise(0).cast("long")).alias("edge"))
    grouped = edge.groupBy("at", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def last_edges(known: Column) -> Column:
        """The edge to each place, for places below the first that is open."""
        def step(last: Column, edge: Column) -> Column:
            begin = _low(_high(edge)).cast("int")
            settled = F.size(last) > _high(_high(edge))
            return F.when(settled, last).when((begin > 0) & joined_before(known, F.get(last, begin), edge), last).otherwise(F.array_append(last, edge))

        return F.aggregate("edges", F.array(F.lit(0).cast("long")), step)

    def follow(acc: Column, edge: Column) -> Column:
        on_path = _high(_high(edge)) == acc["at"]
        return F.when(on_path, F.struct(_low(_high(edge)).alias("at"), F.array_append(acc["path"], edge).alias("path"))).otherwise(acc)

    zero = F.struct(F.length("word").cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("path"))
    # a fold takes no subquery but a column, which the optimizer puts in place of it again
    found = grouped.select("word", "edges", merges(spark, v).alias("known")).select("word", let(F.col("known"), last_edges).alias("last"))
    behind = F.reverse(F.slice("last", 2, F.length("word")))
    found = found.select("word", F.reverse(F.aggregate(behind, zero, follow)["path"]).alias("path")).withColumn("ids", F.transform("path", lambda e: _low(e).cast("int")))
    byte_ids = F.array(*[F.lit(v.of_byte[b]) for b in range(256)])
    raw = lambda e: F.hex(F.encode(F.substring(F.col("word"), (_low(_high(e)) + 1).cast("int"), F.lit(1)), "UTF-8"))
    in_bytes = lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.element_at(byte_ids, F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int") + 1))
    by_bytes = F.flatten(F.transform("path", lambda e: F.when(_low(e) == 0, in_bytes(raw(e))).otherwise(F.array(_low(e).cast("int")))))
    return found.select("word", F.when(F.array_contains("ids", 0), by_bytes).otherwise(F.col("ids")).alias("ids"))


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, n, blob) of (pack, code, ids): n words of a pack, their codes, numbers of ids and ids, compressed. A few rows a
    pack and task, so that words come back to their packs in a tenth of the bytes."""

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        packs, code = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype("<u4")
        lists = rows.column(2).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        for p in np.unique(packs):
            at = np.flatnonzero(packs == p)
            at = at[np.argsort(code[at])]
            own = lists.take(pa.array(at))
            cell = blob(code[at], np.diff(own.offsets.to_numpy()), own.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([cell], pa.binary())], ["pack", "n", "blob"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 150_000:
            yield from out(pa.Table.from_batches(held))
            held = []
    if held:
        yield from out(pa.Table.from_batches(held))
    del held
    give_back()


def spread(words: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, numbers of ids, ids) of the blobs of one pack."""
    found = [(w["n"], np.frombuffer(zstandard.ZstdDecompressor().decompress(w["blob"]), "<u4")) for w in words]
    none = [np.zeros(0, np.uint32)]
    code = np.concatenate(none + [np.cumsum(x[:n]) for n, x in found]).astype(np.int64)
    return code, np.concatenate(none + [x[n : 2 * n] for n, x in found]).astype(np.int64), np.concatenate(none + [x[2 * n :] for n, x in found])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids, ids_crc32, round_trip) of every row of docs(doc_id, text).

    The ids are those that the model's own library gives. The text is taken as it is, a space mark put before it and for
    each space. Null and empty texts have no ids.
    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip: the ids decode to the text, a space
    mark in it read as a space. Repeated rows and null doc_ids stay.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by pack, so that the codes stay where they are when the ids come to them
    name = f"newsmill_packs_{uuid.uuid4().hex}"
    pack(docs, path).write.bucketBy(parts, "pack").option("path", new_path(spark, "packs")).option("compression", "zstd").saveAsTable(made_table(spark, name))
    packs = spark.table(name)
    # each distinct word of a pack, by word: the lattice and the join use one exchange, if both read the same columns
    used = packs.select("pack", F.posexplode("words").alias("code", "word")).where("word IS NOT NULL").repartition(parts, "word")
    distinct = used.groupBy("word").agg(F.max(F.xxhash64("pack", "code")).alias("any")).where("any IS NOT NULL").select("word")
    blobs = used.join(lattice(distinct, path), "word").select("pack", "code", "ids").mapInArrow(gather, "pack long, n long, blob binary")
    mapped = blobs.groupBy("pack").agg(F.collect_list(F.struct("n", "blob")).alias("words"))
    joined = packs.select("pack", "doc_ids", "crcs", "counts", "codes", "longs").join(mapped, "pack", "left").drop("pack")
    decoded = vocabulary(path).decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                doc_ids, crcs, counts = (one.column(i).to_pylist()[0] for i in range(3))
                longs, words = (one.column(i).to_pylist()[0] for i in (4, 5))
                code, lengths_of, ids = spread((words or []) + ([longs] if longs else []))
                lengths = np.zeros(len(code), np.int64)
                lengths[code] = lengths_of
                starts = np.zeros(len(code), np.int64)
                starts[code] = np.cumsum(lengths_of) - lengths_of
                values = ids
                planes = np.frombuffer(unpack.decompress(one.column(3).to_pylist()[0]), np.uint8).reshape(3, -1)
                at = 0
                for i in range(0, len(doc_ids), 200):
                    n = np.array(counts[i : i + 200], np.int64)
                    low, middle, high = planes[:, at : at + n.sum()].astype(np.uint32)
                    mine = low | middle << np.uint32(8) | high << np.uint32(16)
                    at += len(mine)
                    size = lengths[mine]
                    ends = np.cumsum(size)
                    flat = values[np.repeat(starts[mine] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
                    listed = flat.tolist()
                    texts = [b"".join(map(decoded.__getitem__, listed[a:z]))[1:] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    raw = flat.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[i : i + 200], pa.int64()), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))),
                            pa.array([crc(raw[a:z].tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.int64()), pa.array([crc(t) == c for t, c in zip(texts, crcs[i : i + 200], strict=True)]),
                        ],
                        ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"],
                    )
                give_back()

    return joined.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of encoded(doc_id, ids).

    The text of the ids without the space mark that encoding put first; bytes that are no UTF-8 become U+FFFD. Null and empty
    ids: an empty text. Ids outside the vocabulary raise. Repeated rows and null doc_ids stay.
    """
    prepare(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path).decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            raw = []
            for ids in b.column(1).to_pylist():
                if ids and not 0 <= min(ids) <= max(ids) < len(of):
                    raise ValueError("an id is outside the vocabulary")
                raw.append(b"".join(map(of.__getitem__, ids or [])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.removeprefix(b" ").decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: pieces of every document."""
    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
