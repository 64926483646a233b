"""Queries over whole ingest cycles with landed pages, made from the rows of `pages`, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ingest
from .catalog import NOW, query
from .sites import _made

_NEWS = "https://tax.gov.ua/media-tsentr/novini/"
_LONG = " It was said that the rule holds for all who report, from the first day of the month on, and that it ends with the year."
# kinds by page_id % 8: a teaser; a print page; nothing landed; the bank's article; one of the bank's whose words the page does not bear
# out; another trusted site; no link; an untrusted site
_LINK = "CASE page_id % 8 WHEN 3 THEN 'https://bank.gov.ua/ua/news/' || page_id WHEN 4 THEN 'https://bank.gov.ua/ua/news/' || page_id WHEN 5 THEN 'https://www.oecd.org/tax/' || page_id WHEN 6 THEN NULL WHEN 7 THEN 'https://elsewhere.example/' || page_id ELSE '" + _NEWS + "' || (page_id + 10000) || '.html' END"


def _rows(t) -> tuple[DataFrame, DataFrame]:
    """(entries, landed pages)."""
    page, kind = F.col("page_id"), F.col("page_id") % 8
    tax, of = _made(_NEWS, 10000, ".html"), lambda *parts: _made(*parts)
    link = F.when(kind.isin(3, 4), of("https://bank.gov.ua/ua/news/", 0)).when(kind == 5, of("https://www.oecd.org/tax/", 0)).when(kind == 7, of("https://elsewhere.example/", 0)).when(kind != 6, tax)
    own = t("pages").select("page_id", kind.alias("kind"), link.alias("link"))
    title = F.when(kind == 0, "").otherwise(of("Title ", 0))
    entries = own.select(F.lit("feed").alias("source"), page.cast("int").alias("pos"), "link", title.alias("title"), F.when(kind == 0, of("  Teaser\n", 0, " ")).alias("summary"), (F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("published"))
    head = '<html><head><meta property="og:image" content="/img-', 0, '.jpg"><meta name="description" content="title ', 0, '"></head><body>'
    article = "<article><h1>Title ", 0, "</h1><p>Article ", 0, f" says this.{_LONG}</p><ul><li>Point ", 0, "</li></ul><h2>Читайте також</h2><p>Noise here</p></article></body></html>"
    bank = "<div><h1>Title ", 0, "</h1><div>12 січня 2024 10:20</div><p>Article ", 0, f" says this.{_LONG}{_LONG}</p><ul><li>Point ", 0, "</li></ul><p>Теги</p><p>Noise here</p></div></body></html>"
    hidden = "<main><p>", " ".join(f"&#{ord(w[0])};{w[1:]}" for w in (_LONG * 5).split() if len(w) > 3), "</p></main></body></html>"
    html = F.when(kind.isin(0, 1, 5), of(*head, *article)).when(kind == 3, of(*head, *bank)).when(kind == 4, of("<html><body>", *hidden))
    landed = own.select(F.col("link").alias("url"), html.alias("html"), F.lit(200).alias("status")).where("html IS NOT NULL")
    printed = own.where("kind = 1").select(of(_NEWS, "print-", 10000, ".html").alias("url"), of("<html><body><h1>Title ", 0, "</h1><p>Printed ", 0, "</p><p>And more.</p></body></html>").alias("html"), F.lit(200).alias("status"))
    return entries, landed.unionByName(printed)


def _cycle(t) -> tuple[DataFrame, DataFrame]:
    entries, landed = _rows(t)
    none = entries.limit(0).select(F.lit(0).cast("long").alias("id"), F.col("link").alias("url"))
    return ingest.cycle(entries, landed, none, F.lit(NOW).cast("timestamp"))


@query(f"""WITH e AS (SELECT page_id, page_id % 8 AS kind, {_LINK} AS url, chr(10) || chr(10) AS gap FROM pages)
SELECT CASE kind WHEN 0 THEN url ELSE 'Title ' || page_id END AS title, url, regexp_extract(url, '://([^/]*)', 1) AS source_domain, TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS published_at,
CASE kind WHEN 0 THEN 'Teaser ' || page_id WHEN 1 THEN 'Printed ' || page_id || gap || 'And more.' WHEN 3 THEN 'Article ' || page_id || ' says this.{_LONG * 2}' || gap || '• Point ' || page_id ELSE 'Article ' || page_id || ' says this.{_LONG}' || gap || 'Point ' || page_id END AS summary,
regexp_extract(url, '^[a-z]+://[^/]*') || '/img-' || page_id || '.jpg' AS image_url, true AS level1_ok FROM e WHERE kind IN (0, 1, 3, 5)""")
def ingest_articles(t):
    """The articles that a cycle adds, taken from landed pages and print pages."""
    made, _ = _cycle(t)
    return made.select("title", "url", "source_domain", "published_at", "summary", "image_url", "level1_ok")


@query(f"SELECT {_LINK} AS link, CASE WHEN page_id % 8 IN (2, 4) THEN 'skipped_no_body' WHEN page_id % 8 = 7 THEN 'skipped_level1' ELSE 'created' END AS status FROM pages WHERE page_id % 8 <> 6")
def ingest_statuses(t):
    """What became of each entry; those without a link are not counted, and a body that its page does not bear out is none."""
    _, statuses = _cycle(t)
    return statuses.select("link", "status")
