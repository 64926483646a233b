import importlib
import sys

import duckdb
import pytest

import __spark_entry__
from newsmill.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["draft_id", "article_id", "title", "shown_title"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("newsmill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "newsmill.llm", None)
    bare = importlib.reload(__spark_entry__)
    assert set(bare.queries()) == set(catalog.QUERIES) and set(bare.oracle_sql()) == set(catalog.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = catalog.QUERIES[name](spark, D)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
