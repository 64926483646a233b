"""Feeds and pages as landed files: what a fetcher leaves, this turns into rows.

Fetching itself is outside the engine. A landed feed is (source, status, final_host, error, body); a landed page
(url, html, status) and, where several ways were tried, html_1 .. html_4 in their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from itertools import islice
from urllib.parse import quote_plus
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import html as H
from ..functions import urls as U

# The feeds read, the topics searched for, and how many entries of a feed count.
SEED_FEEDS = (
    "https://www.oecd.org/tax/topics/tax-challenges-arising-from-the-digitalisation-of-the-economy/feed/",
    "https://eur-lex.europa.eu/homepage.html?locale=en&WT.rss_f=EUR-Lex%20-%20News&WT.rss_a=All%20content&WT.rss_ev=a&WT.rss_fv=1&WT.rss_s=1&type=rss",
    "https://bank.gov.ua/control/uk/publish/rss?cat_id=258190",
    "https://tax.gov.ua/rss/",
)
TOPICS = {
    "PillarTwo": '("Pillar Two" OR GloBE OR BEPS) site:oecd.org OR site:europa.eu OR site:eur-lex.europa.eu',
    "CFC": '(КІК OR "controlled foreign company" OR CFC) site:zakon.rada.gov.ua OR site:tax.gov.ua OR site:minfin.gov.ua',
    "CRS": "(AEOI OR CRS OR FATCA) site:oecd.org OR site:nabu.gov.ua OR site:bank.gov.ua",
    "BO": '(UBO OR "beneficial owner" OR бенефіціар) site:minjust.gov.ua OR site:europa.eu',
    "TP": '("transfer pricing" OR ТЦУ) site:tax.gov.ua OR site:zakon.rada.gov.ua',
    "WHT": '("withholding tax" OR WHT) site:europa.eu OR site:oecd.org',
    "IPBox": '("IP Box" OR R&D) site:europa.eu OR site:oecd.org',
    "HOLDING": "(KYC OR сабстенс OR substance) site:europa.eu OR site:oecd.org OR site:bank.gov.ua",
    "UA_TAX": "(податкові зміни OR законопроект) site:zakon.rada.gov.ua OR site:minfin.gov.ua OR site:tax.gov.ua",
    "NBU": '(НБУ OR "National Bank of Ukraine") site:bank.gov.ua',
    "DiiaCity": '("Дія Сіті" OR Diia City) site:diia.gov.ua OR site:tax.gov.ua OR site:zakon.rada.gov.ua',
    "CASELAW": '("Court of Justice" OR судова практика) site:curia.europa.eu OR site:reyestr.court.gov.ua',
    "PRACTICE": '("tax alert" OR "tax newsletter") site:kpmg.com OR site:ey.com OR site:pwc.com OR site:deloitte.com OR site:taxfoundation.org',
}
FIRST_ENTRIES = 20
ENTRIES = ArrayType(StructType([StructField(n, StringType()) for n in ("link", "title", "summary", "published", "updated")]))


_BARE = re.compile(r"&(?!#\d+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)")
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
#: What can hold the tags of an item, and those tags.
_EDGE = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<(?P<end>/?)(?:[\w.-]+:)?(?P<name>item|entry)(?=[\s/>])[^>]*>", re.S | re.I)
_FIELD = re.compile(r"<(?:[\w.-]+:)?(link|title|description|summary|pubdate|published|updated|date)(?=[\s>/])([^>]*?)(?:/>|>(.*?)</(?:[\w.-]+:)?\1\s*>)", re.S | re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_RAW = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def topic_feeds(spark: SparkSession, pattern: str, topics: dict[str, str] = TOPICS, enabled: bool = True) -> DataFrame:
    """(topic, url) of a search feed for each topic; `pattern` holds {query}. None where the toggle is off."""
    rows = [(k, pattern.replace("{query}", quote_plus(q))) for k, q in topics.items()] if enabled else []
    return spark.createDataFrame(rows, "topic string, url string")


def feeds_to_read(topics: DataFrame, pattern: str, seeds: tuple[str, ...] = SEED_FEEDS) -> DataFrame:
    """(topic, url) of the seed feeds, which have no topic, and of a search feed for each row of topics(topic, query);
    `pattern` holds {query}. Rows without a query have none, and equal rows count once."""
    # as forms are encoded, but that a star is and a tilde is not
    words = F.replace(F.replace(F.url_encode("query"), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    found = topics.where(F.col("query").isNotNull()).select("topic", F.replace(F.lit(pattern), F.lit("{query}"), words).alias("url")).distinct()
    seeded = topics.sparkSession.createDataFrame([(u,) for u in seeds], "url string")
    return seeded.select(F.lit(None).cast(topics.schema["topic"].dataType).alias("topic"), "url").unionByName(found)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _items(body: str) -> Iterator[str]:
    """Items or entries as they are written, in order, each found when it is asked for. One that is not closed ends where
    the next begins, or with the feed; items behind a fault are found like any other."""
    start = None
    for m in _EDGE.finditer(body):
        if not m["name"]:
            continue
        if not m["end"]:
            if start is not None:
                yield body[start : m.start()]
            start = m.start()
        if start is not None and (m["end"] or m[0].endswith("/>")):
            yield body[start : m.end()]
            start = None
    if start is not None:
        yield body[start:]


def _fields(item: str) -> dict[str, str | None]:
    """The first of each field. Bare ampersands and names of HTML's entities are mended; of an item that is no XML even then,
    the fields that are closed count, read as they stand."""
    mended = _ENTITY.sub(lambda m: m[0] if m[1] in _XML_NAMES else escape(unescape(m[0])), _BARE.sub("&amp;", item))
    names = " ".join(f'xmlns:{p}="urn:{p}"' for p in sorted(set(_PREFIX.findall(mended)) - {"xml", "xmlns"}))
    own: dict[str, str | None] = {}
    try:
        for x in ElementTree.fromstring(f"<feed {names}>{mended}</feed>")[0]:
            own.setdefault(_local(x.tag), (x.text or x.attrib.get("href") or "").strip() or None)
    except (ElementTree.ParseError, ValueError):
        for name, attributes, said in _FIELD.findall(item):
            href = _HREF.search(attributes)
            text = _RAW.sub(lambda m: escape(m[1]), said) or (href[1] or href[2] or "" if href else "")
            own.setdefault(name.lower(), unescape(text).strip() or None)
    return own


def _entries(body: str | None, most: int) -> list[dict]:
    """The first RSS items or Atom entries; what stands behind them is not looked at."""
    out = []
    for own in map(_fields, islice(_items(body or ""), most)):
        out.append({"link": own.get("link"), "title": own.get("title"), "summary": own.get("description") or own.get("summary"), "published": own.get("pubdate") or own.get("published"), "updated": own.get("updated") or own.get("date")})
    return [e for e in out if any(e.values())]


def feed_entries(body: Column, most: int = FIRST_ENTRIES) -> Column:
    """An array of the first entries of a feed's text."""

    @pandas_udf(ENTRIES)
    def read(given: pd.Series) -> pd.Series:
        return pd.Series([_entries(b, most) for b in given])

    return read(body)


def feed_time(x):
    """An RFC 822 or ISO time; one without a zone is UTC's."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^\s*\w{3},\s*", ""), r"\s*(GMT|UTC|Z)\s*$", " +0000")
    rfc = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])
    return F.coalesce(rfc, F.try_to_timestamp(x))


def entries(feeds: DataFrame, most: int = FIRST_ENTRIES) -> DataFrame:
    """(source, pos, link, title, summary, published) of the first entries of each available feed, before any filter.

    The time is that of publication where there is one, even a broken one (then null), else that of the last change.
    """
    found = available(feeds).where("available").select("source", F.posexplode(feed_entries(F.col("body"), most)).alias("pos", "e"))
    stamp = F.when(F.col("e.published").isNotNull(), feed_time(F.col("e.published"))).otherwise(feed_time(F.col("e.updated")))
    return found.select("source", "pos", "e.link", "e.title", "e.summary", stamp.alias("published"))


def available(feeds: DataFrame) -> DataFrame:
    """feeds with `available`: answered with 200, by no consent page, without a transport error. Malformed bodies count as available."""
    ok = F.col("error").isNull() & (F.col("status") == 200) & ~F.startswith(F.coalesce("final_host", F.lit("")), F.lit("consent."))
    return feeds.withColumn("available", F.coalesce(ok, F.lit(False)))


def staged(pages: DataFrame, ways: tuple[str, ...] = ("html_1", "html_2", "html_3", "html_4")) -> DataFrame:
    """pages with `html`: the first way that brought any, and `fetch_url`, where the fetcher was to ask."""
    return pages.withColumn("html", F.coalesce(*[F.nullif(F.col(w), F.lit("")) for w in ways])).withColumn("fetch_url", U.fetch_address(F.col("url")))


def article_pages(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """articles(url) with the page itself and its print page: primary_html, print_html, print_url. Null where not landed."""
    primary = pages.where(F.coalesce("status", F.lit(200)) == 200).select(F.col("url"), F.col("html").alias("primary_html"))
    printed = primary.select(F.col("url").alias("print_url"), F.col("primary_html").alias("print_html"))
    own = articles.withColumn("print_url", U.tax_print(F.col("url")))
    return own.join(primary, "url", "left").join(printed, "print_url", "left")


def parsed(pages: DataFrame) -> DataFrame:
    """pages with `page`, their nodes."""
    return pages.withColumn("page", H.parse_page("html"))
