"""Extraction rules on small pages of our own."""

import datetime as dt
import time
from urllib.parse import quote_plus

from pyspark.sql import functions as F

from newsmill.functions import html as H
from newsmill.sources import feeds, listing


def on_page(spark, html, f, **more):
    row = {"html": html, **more}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).withColumn("page", H.parse_page("html"))
    return df.select(f(F.col("page"))).first()[0]


def texts(spark, html):
    return on_page(spark, html, lambda p: F.transform(p["nodes"], lambda n: F.concat_ws("|", n["tag"], n["parent"].cast("string"), H.said(p, n))))


def test_tree_recovers(spark):
    got = texts(spark, "<div><p><b>a<br><p>b</div></span><ul><li>x<li>y</ul><script>'</p>'</script><style>z</style>")
    assert [g for g in got if not g.startswith("-text")] == ["div|-1|a b", "p|0|a", "b|1|a", "br|2|", "p|0|b", "ul|-1|x y", "li|7|x", "li|7|y", "script|-1|", "style|-1|"]


def test_article(spark):
    page = "<body><h1>Other</h1><div class='news__text'><h1>T</h1><p>First part.</p><div><p>Second part.</p><p>First part.</p><ul><li>Item one</li></ul></div><h2>Читайте також</h2><p>Noise here</p></div>"
    assert on_page(spark, page, H.article_text) == "First part.\n\nSecond part.\n\nItem one"
    assert on_page(spark, "<article><div>Тіло без заголовка</div><div>abc</div><div>Теги: x</div><div>після</div></article>", H.article_text) == "Тіло без заголовка"
    assert on_page(spark, "<div><h1>T</h1><p>Лише текст</p></div>", H.article_text) == "Лише текст"
    assert on_page(spark, "<p>x", H.article_text) is None and on_page(spark, None, H.article_text) is None
    long = "<article><h1>t</h1>" + "".join(f"<p>{'слово ' * 100}{i}</p>" for i in range(12)) + "</article>"
    got = on_page(spark, long, H.article_text)
    assert 2000 < len(got) <= 4000 and got.endswith("5")


def test_bank_and_generic_bodies(spark):
    body = "Речення про облікову ставку та валютний ринок. " * 6
    page = f"<main><h1>T</h1><div>вступ</div><div>12 березня 2024 10:00</div><p>{body}</p><ul><li>пункт</li></ul><p>Останні новини</p><p>ні</p></main>"
    got = on_page(spark, page, H.bank_body)
    assert got == f"{body.strip()}\n\n• пункт"
    assert on_page(spark, "<main><h1>T</h1><p>коротко</p></main>", H.bank_body) is None
    assert on_page(spark, f"<div><section><p>{body}</p></section></div>", H.generic_body) == body.strip()
    assert on_page(spark, page, lambda p: H.is_reliable(H.bank_body(p), F.lit(page))) is True
    assert on_page(spark, page, lambda p: H.is_reliable(H.bank_body(p), F.lit("<html>інше</html>"))) is False


def test_regulator(spark):
    text = "Абзац про податкові накладні, достатньо довгий для блоку статті."
    page = f"<article><h1>Назва</h1><div>Назва</div><div>01.02.2024</div><div>{text}</div><div><p>{text}2</p></div><ul><li>перше</li></ul><div>Поділитися</div><p>ні</p></article>"
    assert on_page(spark, page, lambda p: H.regulator_article(p, F.lit("Назва"))) == f"{text}\n\n{text}2\n\n• перше"
    assert on_page(spark, "<div>x</div>", lambda p: H.regulator_article(p, F.lit(None).cast("string"))) is None


def test_images_and_meta(spark):
    base = F.lit("https://s.org/a/b.html")
    image = lambda html: on_page(spark, html, lambda p: H.image(p, base))
    assert image('<meta property="og:image" content=" /x.png "><img src="y.png">') == "https://s.org/x.png"
    assert image('<img data-src="//cdn.org/z.jpg" src="data:abc">') == "https://cdn.org/z.jpg"
    assert image('<picture><source srcset="a.jpg 320w, b.jpg 640w, c.jpg 640w"></picture>') == "https://s.org/a/b.jpg"
    assert image('<img srcset="a.jpg 1x, b.jpg 2x">') == "https://s.org/a/b.jpg"
    assert image('<link rel="image_src" href="l.png">') == "https://s.org/a/l.png"
    assert image("<img src='ftp://x/y'>") is None
    better = lambda html, old: on_page(spark, html, lambda p: H.better_image(p, base, F.lit(old).cast("string")))
    page = "<img src='preview_1.jpg'><img srcset='preview.jpg 1x, full.jpg 2x'>"
    assert better(page, "https://s.org/preview_1.jpg") == "https://s.org/a/full.jpg"
    assert better(page, "https://s.org/own.jpg") == "https://s.org/own.jpg"
    assert better("<div style=\"background-image: url('bg.png')\">", "https://s.org/preview.jpg") == "https://s.org/a/bg.png"
    assert better("<a href='big.webp'>x</a>", None) == "https://s.org/a/big.webp"
    assert on_page(spark, '<meta name="description" content=" d\n e "><meta property="og:description" content="">', H.meta_description) == "d e"


LISTING = """
<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"@type": "NewsArticle", "headline": "З даних", "url": "/ua/news/ld", "datePublished": "2024-03-01T09:00:00+02:00", "description": "опис"},
 {"@type": "NewsArticle", "headline": "Повтор", "url": "/ua/news/one", "datePublished": "2024-03-01"}]}</script>
<div class="card"><a href="/ua/news/one"><h3>Перша</h3></a><span class="date">15 березня 2024 10:00</span><p>Опис першої новини.</p></div>
<li><a href="https://bank.gov.ua/ua/news/two">Друга</a><time datetime="2024-03-02T10:00:00">2 березня</time></li>
<div><a href="https://other.org/news/x">Чужа</a><time datetime="2024-03-02T10:00:00"></time></div>
"""


def items(spark, site, html):
    pages = spark.createDataFrame([(1, html, dt.datetime(2024, 3, 20, 12))], "page_id int, html string, now timestamp")
    return [(r.title, r.url, r.published, r.summary) for r in listing.items(pages, site).orderBy("pos").collect()]


def test_bank_listing(spark):
    assert items(spark, listing.BANK, LISTING) == [
        ("Перша", "https://bank.gov.ua/ua/news/one", dt.datetime(2024, 3, 15, 8), "Опис першої новини."),
        ("Друга", "https://bank.gov.ua/ua/news/two", dt.datetime(2024, 3, 2, 8), None),
        ("З даних", "https://bank.gov.ua/ua/news/ld", dt.datetime(2024, 3, 1, 7), "опис"),
    ]


def test_listing_without_dates(spark):
    assert items(spark, listing.BANK, '<div><a href="/ua/news/none">Без дати</a></div>') == []
    assert items(spark, listing.TAX, "") == items(spark, listing.BANK, None) == []


def test_tax_listing(spark):
    page = """<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "headline": "З даних", "url": "/media-tsentr/novini/1.html", "datePublished": "2024-03-01T09:00:00+02:00"}]}</script>
    <li><a href="/media-tsentr/novini/2.html">Друга</a><span>05.03.2024 12:00</span><p>Короткий опис із крапкою.</p></li><li><a href="/media-tsentr/novini/1.html">Повтор</a><span>05.03.2024</span></li>"""
    assert items(spark, listing.TAX, page) == [
        ("З даних", "https://tax.gov.ua/media-tsentr/novini/1.html", dt.datetime(2024, 3, 1, 7), None),
        ("Друга", "https://tax.gov.ua/media-tsentr/novini/2.html", dt.datetime(2024, 3, 5, 10), "Короткий опис із крапкою."),
    ]


def test_feeds(spark):
    rss = "<rss><channel>" + "".join(f"<item><link>https://a.org/{i}</link><title>t{i}</title><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item>" for i in range(25)) + "</channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://b.org/1"/><updated>2024-03-01T10:00:00Z</updated><summary>s</summary></entry></feed>'
    rows = [("r", 200, "a.org", None, rss), ("m", 200, "b.org", None, atom), ("d", 500, "c.org", None, rss), ("c", 200, "consent.x.org", None, rss), ("e", None, None, "timeout", None), ("b", 200, "z.org", None, "<rss><item>")]
    df = spark.createDataFrame(rows, "source string, status int, final_host string, error string, body string")
    got = feeds.entries(df).collect()
    assert sorted((r.source, r.pos) for r in got) == [("m", 0)] + [("r", i) for i in range(20)]
    assert {r.published for r in got} == {dt.datetime(2024, 3, 1, 10)}
    assert {r.source for r in feeds.available(df).where("available").collect()} == {"r", "m", "b"}
    topics = feeds.topic_feeds(spark, "https://n.org/rss?q={query}")
    assert topics.count() == 13 and topics.where("url LIKE '%+site%3Abank.gov.ua'").count() == 3
    assert feeds.topic_feeds(spark, "{query}", enabled=False).count() == 0
    pages = spark.createDataFrame([("https://tax.gov.ua/x?y#z", None, "", "two", "three")], "url string, html_1 string, html_2 string, html_3 string, html_4 string")
    assert feeds.staged(pages).select("html", "fetch_url").first() == ("two", "https://www.tax.gov.ua/x?y")


def test_feeds_to_read(spark):
    said = ["a b", 'x "y" & (z)', "*~-_.", "податки+%", None, "a b"]
    topics = spark.createDataFrame([(str(i % 5), q) for i, q in enumerate(said)], "topic string, query string")
    got = feeds.feeds_to_read(topics, "https://n.org/rss?q={query}&hl", seeds=("https://s.org/",)).collect()
    want = {(str(i), f"https://n.org/rss?q={quote_plus(q)}&hl") for i, q in enumerate(said[:4])} | {(None, "https://s.org/")}
    assert len(got) == 5 and set(map(tuple, got)) == want
    assert feeds.feeds_to_read(topics.limit(0), "{query}").count() == len(feeds.SEED_FEEDS)


def test_faulty_feeds(spark):
    item = lambda n, title: f"<item><link>https://a.org/{n}</link><title>{title}</title></item>"
    whole = "<rss><channel>" + item(1, "a & b &amp; c&nbsp;d &#8211; R&D; &copy;") + item(2, "x")
    broken = {
        "cut": "<item><link>https",  # nothing of it is closed
        "crossed": "<item></channel>" + item(3, "x"),
        "third": "<item><link>https://a.org/3</link><title>x</title><description><b>y</description></item>" + "".join(item(i, "x") for i in range(4, 26)),
        "open": "<item><link>https://a.org/3</link><title>x</title>" + item(4, "x"),
        "prefix": '<item><media:content url="u"/><link>https://a.org/3</link><dc:title><![CDATA[x]]></dc:title></item>',
        "held": "<item><link>https://a.org/3</link><title>x</title><description><![CDATA[</item><item>]]></description></item><!-- <item> -->" + item(4, "x"),
        "atom": "<entry><link rel='alternate' href='https://a.org/3'/><title>x</title><summary><p></summary></entry>",
    }
    df = spark.createDataFrame([(k, whole + v) for k, v in broken.items()] + [("empty", ""), ("none", None), ("items", "<items/><item/>")], "source string, body string")
    got = feeds.entries(df.selectExpr("source", "200 AS status", "'h' AS final_host", "cast(null AS string) AS error", "body")).collect()
    most = {"cut": 2, "crossed": 3, "third": 20, "open": 4, "prefix": 3, "held": 4, "atom": 3}
    assert sorted((r.source, r.pos, r.link) for r in got) == sorted((s, i, f"https://a.org/{i + 1}") for s, n in most.items() for i in range(n))
    assert {r.title for r in got} == {"a & b & c\xa0d – R&D; ©", "x"}


def test_long_feeds_are_read_to_the_entries_asked_for():
    one = "<item><link>https://a.org</link><title>t</title></item>"
    found = feeds._items("<rss>" + one * 400_000)  # 22 MB
    start = time.perf_counter()
    assert [next(found) for _ in range(20)] == [one] * 20
    assert time.perf_counter() - start < 0.1


def test_merged_listings(spark):
    rows = [(2, 0, "u1", "late"), (1, 0, "u1", "first"), (1, 1, "u2", "x")]
    df = spark.createDataFrame(rows, "page_id int, pos int, url string, title string")
    assert sorted((r.url, r.title) for r in listing.merged(df, [1, 2]).collect()) == [("u1", "first"), ("u2", "x")]
