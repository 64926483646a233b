"""Rows that every operator must survive."""

import pyarrow as pa
import pyarrow.parquet as pq

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, ties, repeated rows, long words, odd characters.
ODD = [
    (1, "The cat sat on the mat and the dog sat on the log.", "en", "a", 50),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t  ", "de", "b", 5),
    (5, "same words here again and again", "en", "b", 31),
    (5, "same words here again and again", "en", "b", 31),
    (6, "same words here again and again", None, "b", 31),
    (7, "x" * 3000, "fr", None, 3000),
    (8, "ünï  çødé 🙂   <|endoftext|> a\0b", "fr", "c", 20),
    (9, "ONE two\tthree\x0bfour", "de", "c", 18),
    (None, "no id at all but text", "en", "c", 21),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def folder(tmp_path, **tables):
    """A folder of Parquet tables as the queries read them; lists of rows or DataFrames."""
    for name, df in tables.items():
        pq.write_table(pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=df.toArrow().schema), tmp_path / f"{name}.parquet")
    return str(tmp_path)
