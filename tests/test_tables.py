"""Tables over a real JDBC driver (Derby, which Spark ships) and over folders."""

import pytest

from newsmill.sources import tables


@pytest.fixture(params=["database", "folder"])
def address(request, tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true" if request.param == "database" else str(tmp_path / "warehouse")


def articles(spark, ids):
    return spark.createDataFrame([(i, f"назва {i}", i % 2 == 0) for i in ids], "id long, title string, level1_ok boolean").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_written_and_read_again(spark, address):
    own = articles(spark, range(200))
    tables.write(own, address, "articles")
    tables.write(articles(spark, range(200, 210)), address, "articles")
    assert rows(tables.read(spark, address, "articles")) == rows(articles(spark, range(210)))


def test_ranges_are_looked_up(spark, tmp_path):
    address = f"jdbc:derby:{tmp_path}/db;create=true"
    tables.write(articles(spark, range(1000, 1400)), address, "articles")
    assert tables.bounds(spark, tables.connection(address), "articles", "id") == (1000, 1399)
    got = tables.read(spark, address, "articles", by="id", parts=4)
    sizes = [sum(1 for _ in part) for part in got.rdd.glom().collect()]
    assert sizes == [100] * 4 and rows(got) == rows(articles(spark, range(1000, 1400)))
    tables.write(articles(spark, []), address, "empty")
    assert tables.bounds(spark, tables.connection(address), "empty", "id") is None
    assert tables.read(spark, address, "empty", by="id").count() == 0


def test_a_broken_batch_is_run_again(spark, address):
    """What a batch wrote before it broke off stays once; keys that are given twice or not at all."""
    tables.write(articles(spark, range(10)), address, "articles")
    batch = articles(spark, range(5, 30))
    tables.write(batch.where("id BETWEEN 10 AND 17"), address, "articles")  # the tasks that had finished
    for _ in range(2):
        tables.append_once(batch.unionByName(batch.where("id > 25")).unionByName(batch.limit(1).selectExpr("cast(null AS long) AS id", "title", "level1_ok")), address, "articles", "id")
    assert rows(tables.read(spark, address, "articles")) == rows(articles(spark, range(30)))
    tables.append_once(articles(spark, []), address, "articles", "id")
    assert tables.read(spark, address, "articles").count() == 30


def test_first_batch_of_a_folder(spark, tmp_path):
    tables.append_once(articles(spark, range(3)), str(tmp_path / "w"), "articles", "id")
    assert rows(tables.read(spark, str(tmp_path / "w"), "articles")) == rows(articles(spark, range(3)))
