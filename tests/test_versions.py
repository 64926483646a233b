"""Tables that change together: crashes between any two writes, updates that write what changes, a stream that reads what it asks for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from newsmill.plans import drafts
from newsmill.sources.versions import Conflict, Kind, Tables
from newsmill.streaming import ingest as stream

NOW = dt.datetime(2024, 3, 20, 12)
KINDS = {"t": Kind("id long, a string, b boolean"), "u": Kind("id long, x int", "id", "x")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def articles(spark, n):
    made = [(i, f"Title {i}", f"https://a.org/{i}", "a.org", "Something was said.", i % 4 != 0, i % 5 == 0) for i in range(1, n + 1)]
    return spark.createDataFrame(made, "id long, title string, url string, source_domain string, summary string, level1_ok boolean, taken boolean")


def started(spark, root, n=12):
    tables = Tables(spark, str(root), drafts.kinds())
    change = tables.change()
    change.append("articles", articles(spark, n))
    change.commit()
    return tables, spark.createDataFrame([], "article_id long, raw string")


def whole(tables):
    return {n: rows_of(tables.read(n).drop("created_at")) for n in ("articles", "drafts", "previews")}


def breaking(monkeypatch, at):
    """The at-th write from here on is lost."""
    plain, left = DataFrameWriter.parquet, [at]

    def broken(self, *args, **more):
        left[0] -= 1
        if not left[0]:
            raise OSError("lost")
        return plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)


def test_store_commits_all_or_nothing(spark, tmp_path, monkeypatch):
    tables, raw = started(spark, tmp_path)
    old = whole(tables)
    breaking(monkeypatch, 3)  # drafts and previews are written, the articles' flags are not
    with pytest.raises(OSError):
        drafts.store(tables, raw, F.lit(NOW), 7)
    monkeypatch.undo()
    assert whole(tables) == old
    drafts.store(tables, raw, F.lit(NOW), 7)
    got = whole(tables)
    assert [d[:2] for d in got["drafts"]] == [(i, a) for i, a in enumerate((1, 2, 3, 6, 7, 9, 11), 1)] and len(got["previews"]) == 14
    assert [p[:3] for p in got["previews"][:4]] == [(1, 1, "with_image"), (10, 5, "without_image"), (11, 6, "with_image"), (12, 6, "without_image")]
    assert {r[0] for r in got["articles"] if r[-1]} == {1, 2, 3, 5, 6, 7, 9, 10, 11}
    assert drafts.reset(tables) == {"previews": 14, "drafts": 7, "articles": 12} and whole(tables) == {"articles": [], "drafts": [], "previews": []}
    change = tables.change()  # ids are not given out again
    assert (change.last("drafts"), change.last("previews")) == (7, 14)


def test_a_crash_between_any_two_writes(spark, tmp_path, monkeypatch):
    tables, both = Tables(spark, str(tmp_path), KINDS), lambda: (rows_of(tables.read("t")), rows_of(tables.read("u")))

    def once(n):
        change = tables.change()
        change.append("t", spark.createDataFrame([(n, f"a{n}")], "id long, a string"))
        change.append("u", spark.createDataFrame([(n, n)], "id long, x int"))
        change.update("t", spark.createDataFrame([(1, True)], "id long, b boolean"), "b")
        return change.commit()

    once(1)
    states = [both()]
    for at in (1, 2, 3):
        breaking(monkeypatch, at)
        with pytest.raises(OSError):
            once(2)
        monkeypatch.undo()
        assert both() == states[0]
    (tmp_path / "_versions" / f"{2:012d}.json").write_text('{"version": 2, "tab')  # a manifest that a crash cut short is not one
    assert both() == states[0]
    assert once(2) == 3
    assert both() == ([(1, "a1", True), (2, "a2", None)], [(1, 1), (2, 2)])
    assert tables.vacuum() >= 3 and both() == ([(1, "a1", True), (2, "a2", None)], [(1, 1), (2, 2)])


def test_updates_write_what_changes(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), KINDS)
    first = tables.change()
    first.append("t", spark.range(1000).select("id", F.lit("old").alias("a")))
    first.commit()
    plain = {i: ("old", None) for i in range(1000)}
    for ids, values, columns in (([5], ("old", True), ["b"]), ([5, 6], ("new", None), ["a"]), ([6, 2000], (None, False), ["a", "b"]), ([5], ("x", None), ["b"])):
        change = tables.change()
        change.update("t", spark.createDataFrame([(i, *values) for i in ids], "id long, a string, b boolean"), *columns)
        change.commit()
        part = tables.state()["tables"]["t"]["changes"][-1]
        assert spark.read.parquet(f"{tmp_path}/t/part={part}").count() == len(ids)
        for i in ids:
            if i in plain:
                plain[i] = tuple(v if c in columns else o for c, v, o in zip("ab", values, plain[i], strict=True))
        assert {r.id: (r.a, r.b) for r in tables.read("t").collect()} == plain
    before = rows_of(tables.read("t"))
    tables.compact("t")
    assert rows_of(tables.read("t")) == before and tables.state()["tables"]["t"]["changes"] == [] and len(tables.state()["tables"]["t"]["rows"]) == 1


def test_second_of_two_changes_fails(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), KINDS)
    one, two = tables.change(), tables.change()
    one.append("u", spark.createDataFrame([(1, 3)], "id long, x int"))
    two.append("u", spark.createDataFrame([(2, 3)], "id long, x int"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows_of(tables.read("u")) == [(1, 3)] and rows_of(tables.read("t")) == []


def test_flags_and_clean_up(spark, tmp_path):
    tables, raw = started(spark, tmp_path)
    drafts.store(tables, raw, F.lit(NOW))
    drafts.approve(tables, 3)
    assert {r.id for r in tables.read("drafts").where("approved").collect()} == {3}
    change = tables.change()
    change.update("drafts", spark.createDataFrame([(2, "Зовсім інше")], "id long, llm_raw_md string"), "llm_raw_md")
    change.replace("previews", tables.read("previews", change.before).where("draft_id <> 5"))
    change.commit()
    own, arts, have = (tables.read(n) for n in ("drafts", "articles", "previews"))
    bodies, shown = drafts.clean_up(own, arts, have)
    want = rows_of(bodies.select("id", "body_md")), rows_of(shown.select("draft_id", "kind", "text_md"))
    drafts.refresh(tables, F.lit(NOW))
    assert rows_of(tables.read("drafts").select("id", "body_md")) == want[0] and rows_of(tables.read("previews").select("draft_id", "kind", "text_md")) == want[1]
    assert tables.read("previews").select("id").distinct().count() == 14
    part = tables.state()["tables"]["previews"]["changes"][-1]
    assert spark.read.parquet(f"{tmp_path}/previews/part={part}").count() == shown.where("change = 'update'").count() < 14


def landed(spark, folder, links, at=NOW):
    rows = [("feed", i, link, f"News {link}", "What it says", at) for i, link in enumerate(links)]
    spark.createDataFrame(rows, stream.ENTRIES).coalesce(1).write.mode("append").json(folder)


def test_stream_reads_the_buckets_that_it_asks_for(spark, tmp_path, monkeypatch):
    p = {n: str(tmp_path / n) for n in ("in", "pages", "tables", "cp")}
    link = lambda i: f"https://tax.gov.ua/media-tsentr/novini/{10000 + i}.html"
    spark.createDataFrame([(link(i), f"<article><h1>t</h1><p>Article number {i} says this.</p></article>", 200) for i in range(60)], "url string, html string, status int").write.parquet(p["pages"])

    def run():
        stream.run(stream.landed(spark, p["in"]), p["pages"], p["tables"], p["cp"], str(NOW), buckets=16).awaitTermination()

    tables = Tables(spark, p["tables"], stream.kinds())
    landed(spark, p["in"], [link(i) for i in range(40)])
    run()
    run()  # finds nothing new
    assert sorted(r.id for r in tables.read("articles").collect()) == list(range(1, 41)) and tables.state()["version"] == 1
    # a batch that breaks off leaves no version and is run again
    before, plain = whole_stream(tables), DataFrameWriter.parquet
    landed(spark, p["in"], [link(3), link(45), link(45), "https://tax.gov.ua/media-tsentr/novini/print-10046.html"])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (_ for _ in ()).throw(OSError("lost")) if "/urls/" in path else plain(self, path, *a, **k))
    with pytest.raises(Exception):  # noqa: B017
        run()
    monkeypatch.undo()
    assert whole_stream(tables) == before
    run()
    rows = {r.url: r.id for r in tables.read("articles").collect()}
    assert len(rows) == 42 and set(rows.values()) == set(range(1, 43)) and rows_of(tables.read("urls").select("url", "id")) == sorted(rows.items())
    assert sorted(r.status for r in tables.read("statuses").where("batch = 1").collect()) == ["created", "created", "duplicate", "duplicate"]
    # what one link asks for is read from the folders of its forms only
    asked = spark.createDataFrame([(link(3),)], "link string")
    found = stream.known_urls(tables, asked, 16)
    files = {re.search(r"bucket=(\d+)", f)[1] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and 1 <= found.select(F.input_file_name()).distinct().count() <= 6 < len(files)
    assert (link(3), rows[link(3)]) in set(map(tuple, found.collect()))
    tables.compact("urls")
    assert rows_of(stream.known_urls(tables, asked, 16)) == rows_of(found)


def whole_stream(tables):
    return {n: rows_of(tables.read(n)) for n in tables.kinds}
