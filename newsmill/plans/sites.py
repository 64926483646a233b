"""Queries over feeds, listings and articles in markup, made from the rows of `pages`, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..sources import feeds, listing
from . import drafts
from .catalog import _KYIV, NOW, query


def _made(*parts):
    """Text with numbers of the row: strings as they are, integers as page_id plus that."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else (F.col("page_id") + p).cast("string") if isinstance(p, int) else p for p in parts])


@query("""SELECT page_id, i::INT AS pos, 'https://n.example/' || page_id || '/' || i AS link, 'News & more ' || i AS title, 'What it says' AS summary,
CASE i % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 10:20:00' WHEN 1 THEN TIMESTAMP '2024-01-16 11:30:00' END AS published FROM pages, range(20) r(i) WHERE page_id % 4 > 1""")
def feed_entries(t):
    """The first 20 of 25 entries a feed, ampersands bare in every other one; feeds not found or behind a consent page have none."""
    times = (("pubDate", "Mon, 15 Jan 2024 10:20:00 GMT"), ("updated", "2024-01-16T11:30:00Z"), ("pubDate", "soon"))
    stamp = lambda i: F.get(F.array(*[F.lit(f"<{k}>{v}</{k}>") for k, v in times]), i % 3)
    amp = F.when(F.col("page_id") % 2 == 0, " & ").otherwise(" &amp; ")
    item = lambda i: F.concat(F.lit("<item><link>https://n.example/"), F.col("page_id").cast("string"), F.lit("/"), i.cast("string"), F.lit("</link><title>News"), amp, F.lit("more "), i.cast("string"), F.lit("</title>"), stamp(i), F.lit("<description>What it says</description></item>"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), item), ""), F.lit("</channel></rss>"))
    landed = t("pages").select(F.col("page_id").cast("string").alias("source"), F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 4 == 1, "consent.example.com").alias("final_host"), F.lit(None).cast("string").alias("error"), body.alias("body"))
    return feeds.entries(landed).select(F.col("source").cast("long").alias("page_id"), "pos", "link", "title", "summary", "published")


_TOPIC_ROWS = ", ".join("('{}', '{}')".format(k, q.replace("'", "''")) for k, q in feeds.TOPICS.items())


@query(f"SELECT topic, 'https://search.example/rss?q=' || replace(url_encode(q), '%20', '+') || '&hl=uk' AS url FROM (VALUES {_TOPIC_ROWS}) v(topic, q)")
def topic_feeds(t):
    return feeds.topic_feeds(t("region").sparkSession, "https://search.example/rss?q={query}&hl=uk")


_SEEDS = ", ".join(f"('{url}')" for url in feeds.SEED_FEEDS)


@query(f"""SELECT NULL AS topic, url FROM (VALUES {_SEEDS}) v(url)
UNION ALL SELECT DISTINCT source, 'https://search.example/rss?q=' || replace(url_encode('("' || source || '" OR *~' || lang || ') site:tax.gov.ua'), '%20', '+') || '&hl=uk' FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def feeds_to_read(t):
    """The seed feeds, and a search feed for each source and language of the documents."""
    said = F.concat(F.lit('("'), "source", F.lit('" OR *~'), "lang", F.lit(") site:tax.gov.ua"))
    return feeds.feeds_to_read(t("documents").select(F.col("source").alias("topic"), said.alias("query")), "https://search.example/rss?q={query}&hl=uk")


_SAID = [f"Paragraph {i} of the article says what the bank decided about matter {i} and why it did so in the end." for i in range(4)]
_BODY = " || chr(10) || chr(10) || ".join([f"'{p}'" for p in _SAID] + ["'• Point ' || page_id"])


@query(f"SELECT page_id, {_BODY} AS body, true AS reliable, 'Described & told' AS description FROM pages")
def bank_article(t):
    """Behind the date under the heading up to the stop phrase; whether the page's words bear it out; its description."""
    head = ["<html><head><meta name='twitter:description' content='third'><meta property='og:description' content=' Described &amp;  told '></head><body><div><h1>Decision ", 0, "</h1><p>Menu</p><p>12 січня 2024 10:20</p>"]
    html = _made(*head, *[f"<p>{p}</p>" for p in _SAID], "<ul><li>Point ", 0, "</li></ul><p>Останні новини</p><p>Other news of the day</p></div></body></html>")
    own = t("pages").select("page_id", html.alias("html")).withColumn("page", H.parse_page("html")).withColumn("body", H.bank_body(F.col("page")))
    return own.select("page_id", "body", H.is_reliable(F.col("body"), F.col("html")).alias("reliable"), H.meta_description(F.col("page")).alias("description"))


_FIRST, _NEXT = "The first paragraph of the body tells what has changed in the law.", "Another one tells whom it concerns and from when on, in some more words than the first had, so that the whole is long enough. " * 2


@query(f"""SELECT page_id, '{_FIRST}' || chr(10) || chr(10) || 'What follows' || chr(10) || chr(10) || 'Point ' || page_id || chr(10) || chr(10) || '{_NEXT.strip()}' AS article,
'{_FIRST}' || chr(10) || chr(10) || 'What follows' || chr(10) || chr(10) || '• Point ' || page_id || chr(10) || chr(10) || '{_NEXT.strip()}' AS regulator,
'{_FIRST}' || chr(10) || chr(10) || 'What follows' || chr(10) || chr(10) || 'Point ' || page_id || chr(10) || chr(10) || '{_NEXT.strip()}' AS generic FROM pages""")
def article_bodies(t):
    """Behind the heading without short and repeated blocks; the regulator's without title and date; the fullest place, first of equals."""
    blocks = f"<p>{_FIRST}</p><h2>What follows</h2><ul><li>Point ", 0, f"</li></ul><p>{_FIRST}</p><p>{_NEXT}</p>"
    # the second section is as full as the first
    other = f"<section><p>{_FIRST}</p><h2>what follows</h2><ul><li>Point ", 0, f"</li></ul><p>{_FIRST}</p><p>{_NEXT}</p></section>"
    pages = t("pages").select("page_id", H.parse_page(_made("<html><body><article><h1>Title ", 0, "</h1>", *blocks, "<h3>Читайте також</h3><p>Something else entirely</p></article></body></html>")).alias("own"), H.parse_page(_made("<html><body><article><h1>Title ", 0, "</h1><p>12.01.2024</p>", *blocks, "<p>Теги: a</p></article></body></html>")).alias("dated"), H.parse_page(_made("<html><body><section>", *blocks, "</section>", *other, "</body></html>")).alias("two"))
    return pages.select("page_id", H.article_text(F.col("own")).alias("article"), H.regulator_article(F.col("dated"), _made("Title ", 0)).alias("regulator"), H.generic_body(F.col("two")).alias("generic"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://p.example/og-' || page_id || '.jpg' WHEN 1 THEN 'https://p.example/link-' || page_id || '.jpg' WHEN 2 THEN 'https://s.example/wide-' || page_id || '.jpg'
WHEN 3 THEN 'https://s.example/news/lazy-' || page_id || '.jpg' END AS image FROM pages""")
def page_image(t):
    """Pictures by their order: meta, link, the widest source, an image's attributes; data: is none."""
    og = _made('<meta property="og:image" content="//p.example/og-', 0, '.jpg">')
    link = _made('<link rel="image_src" href="https://p.example/link-', 0, '.jpg">')
    source = _made('<picture><source srcset="/thin-', 0, ".jpg 320w, /wide-", 0, '.jpg 2x, /late.jpg 2000w"></picture>')
    img = _made('<img src="data:image/gif;base64,AAAA" data-src="lazy-', 0, '.jpg">')
    kind = F.col("page_id") % 5
    chosen = F.concat(*[F.when(kind <= n, x).otherwise("") for n, x in enumerate((og, link, source, img))])
    html = F.concat(F.lit("<html><body>"), chosen, F.lit("</body></html>"))
    own = t("pages").select("page_id", H.parse_page(html).alias("page"))
    return own.select("page_id", H.image(F.col("page"), F.lit("https://s.example/news/item")).alias("image"))


@query("""SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'https://tax.gov.ua/full-' || page_id || '.jpg' WHEN 1 THEN 'https://tax.gov.ua/kept.jpg' WHEN 2 THEN 'https://else.example/preview.jpg' ELSE 'https://tax.gov.ua/bg-' || page_id || '.png' END AS image_url FROM pages""")
def image_upgrade(t):
    """The tax service's preview pictures give way to the first full one of the page; others' stay."""
    kind = F.col("page_id") % 4
    url = _made("https://tax.gov.ua/n/", 0)
    articles = t("pages").select(F.col("page_id").alias("id"), url.alias("url"), F.when(kind == 2, "else.example").otherwise("www.tax.gov.ua").alias("source_domain"), F.when(kind == 0, "https://tax.gov.ua/preview/1.jpg").when(kind == 1, "https://tax.gov.ua/kept.jpg").when(kind == 2, "https://else.example/preview.jpg").alias("image_url"))
    img = F.when(kind == 0, _made('<img src="/preview/2.jpg" data-full="/full-', 0, '.jpg"><img src="/full-', 0, '.jpg">')).otherwise("")
    html = F.concat(F.lit("<html><body>"), img, _made('<div style="color: red; background-image: url(\'/bg-', 0, ".png')\">x</div></body></html>"))
    return drafts.upgraded_images(articles, t("pages").select(url.alias("url"), html.alias("html"))).select("id", "image_url")


@query(f"""SELECT page_id, 0 AS pos, 'Рішення номер ' || page_id AS title, 'https://bank.gov.ua/news/' || page_id AS url, {_KYIV.format("TIMESTAMP '2024-01-15 00:00:00'")} AS published, 'Про що мова в новині.' AS summary FROM pages
UNION ALL SELECT page_id, 1, 'Зі скрипта ' || page_id, 'https://bank.gov.ua/news/ld-' || page_id, TIMESTAMP '2024-01-16 09:30:00', 'Коротко' FROM pages""")
def bank_listing(t):
    """A listing page for each page: a card, which comes first, the same link again in JSON-LD, and a link of JSON-LD's own."""
    card = ['<div class="news-list__item"><a class="news-list__item-title" href="/news/', 0, '">Рішення номер ', 0, '</a><time>15.01.2024</time><p class="news-list__item-desc">Про що мова в новині.</p></div>']
    again = ['{"@type": "NewsArticle", "headline": "Ще раз", "url": "/news/', 0, '", "datePublished": "2024-01-17"}']
    own = ['{"@type": "NewsArticle", "headline": "Зі скрипта ', 0, '", "mainEntityOfPage": {"@id": "https://bank.gov.ua/news/ld-', 0, '"}, "dateCreated": "2024-01-16T11:30:00+02:00", "abstract": "Коротко"}']
    html = _made("<html><body>", *card, '<script type="application/ld+json">{"@graph": [', *again, ", ", *own, "]}</script></body></html>")
    found = listing.items(t("pages").select("page_id", html.alias("html"), F.lit(NOW).cast("timestamp").alias("now")), listing.BANK)
    return found


@query("SELECT url, min(page_id) AS page_id FROM (SELECT page_id, 'https://bank.gov.ua/news/' || (page_id // 2) AS url FROM pages) GROUP BY url")
def listings_merged(t):
    """Items of several listing pages, two to a URL: the page read first keeps it."""
    found = t("pages").select("page_id", F.lit(0).alias("pos"), F.concat(F.lit("https://bank.gov.ua/news/"), F.expr("page_id div 2").cast("string")).alias("url"))
    return listing.merged(found, None).select("url", "page_id")


_CLEAN = "trim(regexp_replace(left(coalesce(text, ''), 400), '[^A-Za-z0-9]+', ' ', 'g'))"
_CAPPED = """CASE WHEN length(j) <= {most} THEN j ELSE trim(left(j, CASE WHEN {brk} > {least} THEN {brk} WHEN strpos(reverse(left(j, {most})), ' ') > 0 THEN {most} - strpos(reverse(left(j, {most})), ' ') ELSE {most} END)) END"""


def _cap(most, least):
    brk = f"(CASE WHEN strpos(reverse(left(j, {most})), chr(10) || chr(10)) > 0 THEN {most} - 1 - strpos(reverse(left(j, {most})), chr(10) || chr(10)) ELSE -1 END)"
    return _CAPPED.format(most=most, least=least, brk=brk)


@query(f"""WITH said AS (SELECT conv_id, turn, {_CLEAN} AS p, turn % 3 AS kind FROM conversations),
ps AS (SELECT conv_id, list({{'k': turn, 'p': p, 'kind': kind}} ORDER BY turn, p) AS own FROM said GROUP BY conv_id),
kept AS (SELECT conv_id, [x.p for x in own if length(x.p) >= 4] AS blocks, own FROM ps),
once AS (SELECT conv_id, own, list_filter(blocks, lambda b, i: list_position(blocks, b) = i) AS blocks FROM kept),
long AS (SELECT conv_id, [CASE WHEN x.kind = 2 THEN '• ' ELSE '' END || x.p for x in own if x.p <> '' AND (conv_id % 4 <> 3 OR x.kind <> 0)] AS items FROM ps),
full_list AS (SELECT conv_id, list_filter(items, lambda b, i: list_position(items, b) = i) AS items FROM long),
j AS (SELECT conv_id, array_to_string(blocks, chr(10) || chr(10)) AS j FROM once),
r AS (SELECT conv_id, array_to_string(list_append(items, 'Читайте також'), chr(10) || chr(10)) AS j FROM full_list)
SELECT conv_id, (SELECT CASE WHEN j <> '' THEN {_cap(4000, 2000)} END FROM j WHERE j.conv_id = r.conv_id) AS article, CASE WHEN length(r.j) >= 200 THEN r.j END AS bank FROM r""")
def article_shapes(t):
    """A page for each conversation, its turns as paragraphs, headings or points, in six shapes of page: a named class, an article
    within main, nested divs, a property, a section beside a menu, and only what stands around the heading."""
    clean = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 400), "[^A-Za-z0-9]+", " "))
    rows = t("conversations").select("conv_id", F.struct("turn", clean.alias("p")).alias("r")).groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("own"))
    kind = F.col("conv_id") % 6
    # where conv_id % 4 = 3 the first kind of turn is no block of the bank's: h4
    first = F.when(F.col("conv_id") % 4 == 3, "h4").otherwise("p")
    tag = lambda r: F.when(r["turn"] % 3 == 0, first).when(r["turn"] % 3 == 1, "h3").otherwise("li")
    blocks = F.array_join(F.transform("own", lambda r: F.concat(F.lit("<"), tag(r), F.lit(">"), r["p"], F.lit("</"), tag(r), F.lit(">"))), "")
    body = F.concat(F.lit("<h1>Title</h1><div>12 січня 2024 10:20</div>"), blocks, F.lit("<h2>Читайте також</h2><p>Останні новини</p><p>Something else entirely</p>"))
    shapes = (('<div class="a article__content b">', "</div>"), ("<main><article>", "</article></main>"), ("<div><div><div>", "</div></div></div>"), ('<div itemprop="articleBody">', "</div>"), ("<nav><ul><li>Menu</li></ul></nav><section>", "</section><p>Foot</p>"), ("<span>", "</span>"))
    html = F.concat(F.lit("<html><body>"), F.get(F.array(*[F.lit(a) for a, _ in shapes]), kind), body, F.get(F.array(*[F.lit(b) for _, b in shapes]), kind), F.lit("</body></html>"))
    page = rows.select("conv_id", H.parse_page(html).alias("page"))
    return page.select("conv_id", H.article_text(F.col("page")).alias("article"), H.bank_body(F.col("page")).alias("bank"))
