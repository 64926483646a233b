"""Exact dedup by a tree merge of sorted digest runs, with DataFrame functions only.

Each partition of the input is a run: its digests, each with the row that stays and the number of copies. Runs are merged
in binomial rounds: in a round, runs whose numbers differ in their last STEP bits only are merged (as many steps of a
binomial tree at once), and the merged run has the number without those bits, until one run number is left. A round deals
rows out by run number and digest, so no task gets a whole run. An entry is verified whenever it is merged: entries of
one digest become one only where the length and a second hash of their texts agree too.

What a round kept is written, and the way back goes down the same levels: an entry asks the merged run above it, so a
group of copies that holds a third of all rows is one row a run on each level and never meets in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table, written

#: Steps of the binomial tree that one exchange takes: 2 ** STEP runs are merged at once.
STEP = 4


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null: empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def settled(rows: DataFrame, keys: list[str], best: Column, step: int = STEP) -> DataFrame:
    """rows (a written table with a column `place`, the row's monotonically increasing id) with `best` and `copies` of its group.

    Rows are of one group where all keys agree (keys are never null); `best` is an expression over the rows' columns of which
    the least stays. A row of rows is a row of the result.
    """
    run = F.shiftright("place", 33).cast("int")
    kept = rows.select(run.alias("run"), *keys, best.alias("best")).groupBy("run", *keys).agg(F.min("best").alias("best"), F.count("*").alias("copies"))
    levels = [written(kept, "runs")]
    last = levels[0].agg(F.max("run")).first()[0] or 0
    while last:
        last >>= step
        above = levels[-1].withColumn("run", F.shiftright("run", step))
        levels.append(written(above.groupBy("run", *keys).agg(F.min("best").alias("best"), F.sum("copies").alias("copies")), "runs"))
    found = levels.pop()
    while levels:
        asked = levels.pop().select("run", *keys).withColumn("up", F.shiftright("run", step))
        found = asked.join(found.withColumnRenamed("run", "up"), ["up", *keys]).drop("up")
    return rows.withColumn("run", run).join(found, ["run", *keys]).drop("run")


def digested(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    """A written table (place, digest, size, second, others): the text's SHA-256, its length in bytes and its XXH64."""
    own = docs.select(*others, F.monotonically_increasing_id().alias("place"), text.alias("text"))
    made = own.select("*", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("second"))
    return written(made.drop("text"), "digests")


KEYS = ["digest", "size", "second"]


def copies(docs: DataFrame, largest: bool = True, step: int = STEP) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs(doc_id, text, ...).

    Texts are equal when their normalised forms are; the row of the largest doc_id stays (of the smallest where `largest` is
    false). A null text is empty. A null doc_id stays only where its group has no other (keep_id is null then). Of rows that
    repeat both text and doc_id one is kept. Further columns of docs are not looked at, whatever their names.
    """
    rows = digested(docs, normalised(F.col("text")), F.col("doc_id"))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(38,0)") if largest else F.col("doc_id").cast("decimal(38,0)")).alias("rank"), F.col("place"), F.col("doc_id").alias("id"))
    found = settled(rows, KEYS, ranked, step)
    kept = F.col("best.place") == F.col("place")
    return found.select("doc_id", F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one row of each group."""
    key, sha = free_names(docs.columns, "key", "sha")
    kept = written(copies(docs, largest).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)), "kept")
    own = docs.withColumn(sha, F.sha2(F.encode(normalised(F.col("text")), "utf-8"), 256)).withColumn(key, F.col("doc_id"))
    met = own.join(kept.withColumnsRenamed({key: key + "0", sha: sha + "0"}), F.col(sha).eqNullSafe(F.col(sha + "0")) & F.col(key).eqNullSafe(F.col(key + "0")), "left_semi")
    return met.dropDuplicates([key, sha]).drop(key, sha)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: exact copies after lower-casing A-Z; the largest doc_id stays."""
    return copies(table(spark, sf_dir, "documents"))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY {_LOWER} ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256({_LOWER}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {_LOWER})
"""
