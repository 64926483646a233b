"""A training corpus from `documents`: toxic texts out, one of each near copy, repeated passages out, benchmark leaks out, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsmill.llm import decontaminate, pieces, simhash, suffix, toxicity
from newsmill.llm.common import table, tokenizer_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of P(grade >= 1) over one half go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c != "text"}), model).where("NOT is_toxic")
    return found.select(*[found["text"] if c == "text" else found[f"_own_{c}"].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are linked where four fifths of their five-word shingles are shared; the least doc_id of each group stays."""
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in two places are cut out of both."""
    return suffix.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of what is left."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("suffix_dedup", drop_repeats), ("decontamination", drop_leaks), ("sentencepiece", encode)]
#: SQL has no way to these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
