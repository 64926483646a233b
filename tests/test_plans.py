"""Statements, the ingest cycle, drafts and the stream on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from newsmill.operators import relational as R
from newsmill.operators import reports
from newsmill.plans import catalog, drafts, ingest
from newsmill.sources import tables
from newsmill.streaming import ingest as stream

NOW = dt.datetime(2024, 3, 20, 12)
BASE = "https://tax.gov.ua/media-tsentr/novini/"


def table(spark, ddl, *rows):
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def test_queue_and_latest(spark):
    arts = table(spark, R.ARTICLES, *[{"id": i, "title": "т" * (79 + i), "url": f"u{i}", "taken": [None, True, False][i % 3]} for i in range(1, 8)])
    own = table(spark, R.DRAFTS, *[{"id": i, "article_id": i, "approved": [None, True, False][i % 3]} for i in range(1, 9)])
    got = R.queue(own, arts).collect()
    assert [r.draft_id for r in got] == [6, 5, 3, 2] and [len(r.shown_title) for r in got] == [81, 81, 81, 81]
    assert [r.id for r in R.latest(arts, 3, True).collect()] == [6, 5, 3]
    assert R.latest(arts, 0).count() == 1 and R.latest(arts, 500).count() == 7
    assert R.queue(own.limit(0), arts).count() == 0
    assert R.drafts_with_articles(own, arts).count() == 7
    assert R.by_id(arts, 3).count() == 1


def test_probe(spark):
    arts = table(spark, R.ARTICLES, {"id": 1, "url": f"{BASE}12345.html"}, {"id": 2, "url": f"{BASE}print-12345.html"}, {"id": 3, "url": "https://a.org/1"})
    found = spark.createDataFrame([(1, f"{BASE}12345.html"), (2, "https://a.org/1"), (3, "https://a.org/2"), (4, None)], "item int, url string")
    got = {r.item: R_status for r in R.probe(found, arts).withColumn("s", R.probe_status(F.col("n_known"))).collect() for R_status in [r.s]}
    assert got == {1: "error", 2: "duplicate", 3: None, 4: None}


def test_previews(spark):
    old = table(spark, R.PREVIEWS, {"id": 1, "draft_id": 1, "kind": "with_image", "text_md": "a"}, {"id": 2, "draft_id": 1, "kind": "without_image", "text_md": "b"}, {"id": 3, "draft_id": 2, "kind": "with_image", "text_md": "c"}, {"id": 4, "draft_id": 1, "kind": "with_image", "text_md": "a2"})
    assert {r.draft_id: r.kinds for r in R.previews_by_kind(old).collect()} == {1: {"with_image": "a2", "without_image": "b"}, 2: {"with_image": "c"}}
    new = spark.createDataFrame([(1, "x", "y"), (2, "p", "q")], "draft_id long, with_image string, without_image string")
    got = sorted(map(tuple, R.ensure_previews(old.where("id < 4"), new).collect()))
    assert got == [(1, "with_image", "a"), (1, "without_image", "b"), (2, "with_image", "p"), (2, "without_image", "q")]
    fresh = spark.createDataFrame([(1, "with_image", " a "), (2, "with_image", "z"), (3, "with_image", "n")], "draft_id long, kind string, text_md string")
    got = sorted((r.draft_id, r.kind, r.text_md, r.change) for r in R.refresh_previews(old.where("id < 4"), fresh).collect())
    assert got == [(1, "with_image", "a", "keep"), (1, "without_image", "b", "keep"), (2, "with_image", "z", "update"), (3, "with_image", "n", "insert")]


def test_small_statements(spark):
    users = table(spark, R.USERS, {"id": 1, "username": "a"})
    new = table(spark, R.USERS, {"id": 1, "username": "b"}, {"id": 2}, {"id": 2})
    assert sorted(r.id for r in R.register(users, new).collect()) == [1, 2]
    assert [r.id for r in R.admins(R.register(users, new), " 2, x,, -5").collect()] == [2]
    own = table(spark, R.DRAFTS, {"id": 1, "article_id": 1}, {"id": 2, "article_id": 9})
    assert {r.id: r.approved for r in R.flagged(own, 1, "approved").collect()} == {1: True, 2: None}
    assert "llm_raw_md" in R.with_raw_text(own.drop("llm_raw_md")).columns
    counts, emptied = R.reset(own, own, users)
    assert counts == {"previews": 2, "drafts": 2, "articles": 1} and all(t.count() == 0 for t in emptied)
    pick = spark.createDataFrame([("i", ""), ("", ""), ("i", "TEXT"), ("", "photo"), ("i", None)], "image string, asked string")
    assert [r[0] for r in pick.select(R.publish_kind(F.col("image"), F.col("asked"))).collect()] == ["with_image", "without_image", "without_image", "without_image", "with_image"]
    assert [r.id for r in R.numbered(own.select("article_id"), 7, "article_id").collect()] == [8, 9]
    arts = table(spark, R.ARTICLES, {"id": 1, "image_url": " i ", "level1_ok": True})
    shown = table(spark, R.PREVIEWS, {"id": 1, "draft_id": 1, "kind": "with_image", "text_md": "t"})
    assert list(map(tuple, R.outbox(R.flagged(own, 1, "approved"), arts, shown).collect())) == [(1, "with_image", "i", "t")]
    assert R.outbox(R.flagged(own, 1, "approved"), arts.withColumn("level1_ok", F.lit(None).cast("boolean")), shown).count() == 0


BODY = "<article><h1>Н</h1><p>Тіло статті про податки.</p><img src='/i.png'></article>"


def entries(spark):
    def e(pos, link, title="Н", published=NOW, source="feed", summary=None):
        return (source, pos, link, title, summary, published)

    rows = [
        e(0, f"{BASE}11111.html"), e(1, f"{BASE}print-11111.html"), e(2, "https://a.org/x"), e(3, f"{BASE}22222.html", published=None), e(4, f"{BASE}22222.html", published=NOW - dt.timedelta(days=7, seconds=1)),
        e(5, None), e(6, f"{BASE}33333.html"), e(7, f"{BASE}44444.html", published=NOW - dt.timedelta(days=7), title=""), e(8, "https://bank.gov.ua/n/1"), e(9, f"{BASE}55555.html", summary="Тизер"),
    ]
    return spark.createDataFrame(rows, stream.ENTRIES.replace("string, pos", "string, pos"))


def pages(spark):
    rows = [(f"{BASE}11111.html", BODY, 200), (f"{BASE}print-11111.html", BODY.replace("Тіло", "Друк"), 200), (f"{BASE}44444.html", BODY, 200), ("https://bank.gov.ua/n/1", "<h1>x</h1><p>коротко</p>", 200), (f"{BASE}55555.html", "<p></p>", 200)]
    return spark.createDataFrame(rows, "url string, html string, status int")


def known(spark):
    return table(spark, R.ARTICLES, {"id": 5, "url": f"{BASE}33333.html"})


def test_cycle(spark):
    made, found = ingest.cycle(entries(spark), pages(spark), known(spark), F.lit(NOW))
    status = sorted((r.link or "", r.status) for r in found.collect())
    assert status == sorted([(f"{BASE}11111.html", "created"), (f"{BASE}print-11111.html", "duplicate"), ("https://a.org/x", "skipped_level1"), (f"{BASE}22222.html", "skipped_no_date"), (f"{BASE}22222.html", "skipped_old"), (f"{BASE}33333.html", "duplicate"), (f"{BASE}44444.html", "created"), ("https://bank.gov.ua/n/1", "skipped_no_body"), (f"{BASE}55555.html", "created")])
    rows = {r.url: r for r in made.collect()}
    assert rows[f"{BASE}11111.html"].summary == "Друк статті про податки." and rows[f"{BASE}11111.html"].image_url == "https://tax.gov.ua/i.png"
    assert rows[f"{BASE}44444.html"].title == f"{BASE}44444.html" and rows[f"{BASE}55555.html"].summary == "Тизер"
    counts = {r.status: r.n for r in reports.status_counts(found).collect()}
    assert counts == {"created": 3, "duplicate": 2, "skipped_level1": 1, "skipped_no_body": 1, "error": 0, "skipped_old": 1, "skipped_no_date": 1}


def test_reports(spark):
    items = spark.createDataFrame([("a", "created"), ("a", "error"), ("b", "created")], "key string, status string")
    sources = spark.createDataFrame([("a", "Б", True), ("b", "а", True), ("b", "а", False), ("c", "В", True)], "key string, label string, ok boolean")
    failed = spark.createDataFrame([("c",), ("z",), ("z",)], "key string")
    report = reports.source_report(items, sources, failed)
    assert [tuple(r) for r in report.collect()] == [("z", "z", 0, False), ("b", "а", 1, False), ("a", "Б", 1, True), ("c", "В", 0, False)]
    assert reports.failed_sources(failed).first()[0] == ["c", "z"]
    text = reports.report_text(reports.status_counts(items), report, "H").first()[0].split("\n")
    assert text[0] == "H" and text[1].startswith("created=2, duplicate=0") and "skipped_no_body" not in text[1] and text[2:] == ["❌ z: 0", "❌ а: 1", "✅ Б: 1", "❌ В: 0"]


def test_drafts_and_clean_up(spark):
    arts = table(spark, R.ARTICLES, {"id": 1, "title": "Назва", "url": f"{BASE}print-12345.html", "source_domain": "tax.gov.ua", "summary": "s", "level1_ok": True, "image_url": "https://tax.gov.ua/preview.png"}, {"id": 2, "title": "Друга", "url": "https://a.org", "summary": "s2", "level1_ok": True, "source_domain": "a.org"}, {"id": 3, "level1_ok": None})
    raw = spark.createDataFrame([(1, "Довгий пост:\nНазва\nТекст посту.\nКороткий пост: к\nТеги: #x, #y")], "article_id long, raw string")
    made, shown = drafts.make(arts, raw)
    rows = {r.article_id: r for r in made.collect()}
    assert set(rows) == {1, 2} and rows[1].body_md.startswith("Текст посту.\n\n[**") and rows[1].tags == "#x #y"
    assert f"({BASE}12345.html?utm_source=" in rows[1].sources_md and rows[2].llm_raw_md == "Друга\n\ns2\n\nhttps://a.org"
    assert shown.groupBy("article_id").count().where("count = 2").count() == 2
    image = drafts.upgraded_images(arts, spark.createDataFrame([(f"{BASE}print-12345.html", "<img src='/full.png'>")], "url string, html string"))
    assert {r.id: r.image_url for r in image.collect()} == {1: "https://tax.gov.ua/full.png", 2: None, 3: None}
    old = made.select(F.col("article_id").alias("id"), "article_id", F.lit("старе").alias("body_md"), "llm_raw_md", "sources_md", "tags", "image_url", F.lit(False).alias("approved"), F.lit(None).cast("long").alias("created_by"), F.lit(None).cast("timestamp").alias("created_at"))
    have = table(spark, R.PREVIEWS, {"id": 1, "draft_id": 1, "kind": "with_image", "text_md": "x"})
    bodies, changed = drafts.clean_up(old, arts, have)
    assert {r.id: (r.body_md, r.changed) for r in bodies.collect()}[1] == ("Текст посту.", True)
    counts = reports.cleanup_counts(bodies, changed).first()
    assert (counts.drafts_updated, counts.previews_refreshed) == (2, 4)


def test_numbered(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.lit(None).cast("int").alias("x"))
    got = R.numbered(rows, 5, "k", bucket=F.floor(F.col("k") / 7)).collect()
    assert sorted((r.id, r.k) for r in got) == [(k + 6, k) for k in range(100)]


def test_tables(spark, tmp_path):
    assert tables.connection(None) is None and tables.connection("./warehouse") is None and tables.connection("sqlite:///./app.db") is None
    found = {"url": "jdbc:postgresql://h:5433/db?sslmode=require", "driver": "org.postgresql.Driver", "user": "u", "password": "p@ss"}
    for scheme in ("postgres", "postgresql", "postgresql+asyncpg"):
        assert tables.connection(f"{scheme}://u:p%40ss@h:5433/db?sslmode=require") == found
    assert tables.connection("postgres://h/db") == {"url": "jdbc:postgresql://h/db", "driver": "org.postgresql.Driver"}
    tables.write(spark.range(3), str(tmp_path), "t")
    tables.write(spark.range(2), str(tmp_path) + "/", "t")
    assert tables.read(spark, str(tmp_path), "t").count() == 5


def test_stream_dedup(spark, tmp_path):
    folder = str(tmp_path / "in")
    entries(spark).where("link IS NOT NULL AND published IS NOT NULL").coalesce(1).write.json(folder)
    query = stream.first_of_each(stream.landed(spark, folder)).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 7


def test_catalog_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 35
