"""News items of listing pages: cards in the markup and JSON-LD.

Each page is parsed once; its cards come out as structs of strings by higher-order functions, then every card's candidate
dates are exploded, parsed as columns, and the first that is a date is taken. Items without title, link or date are
dropped; of items with one URL the first stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import dates as D
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..functions.batches import parts

BANK, TAX = "https://bank.gov.ua", "https://tax.gov.ua"
# Where the bank's cards keep titles and summaries.
BANK_TITLES = ("news-list__item-title", "news-card__title", "news-item__title", "news__title")
BANK_SUMMARIES = ("news-list__item-desc", "news-card__text", "news-item__text", "news__text", "news__summary", "news-feed__item-text", "article__summary")
_BOXES = ("article", "div", "li", "section")
_LD = ArrayType(StructType([StructField(n, StringType()) for n in ("url", "title", "published", "summary")]))
_ARROW = to_arrow_type(_LD)


def _walk(data: object, deep: bool) -> Iterator[dict]:
    """deep: every object, last first, as from a stack; else the top level, lists and @graph in order."""
    if deep:
        stack = [data]
        while stack:
            now = stack.pop()
            if isinstance(now, dict):
                yield now
            stack += [x for x in (now.values() if isinstance(now, dict) else now) if isinstance(x, dict | list)]
        return
    if isinstance(data, list):
        for x in data:
            yield from _walk(x, deep)
    elif isinstance(data, dict):
        if isinstance(data.get("@graph"), list):
            yield from _walk(data["@graph"], deep)
        yield data


def _plain(value: object, *keys: str) -> str | None:
    """A string; of an object one of its keys; of a list its parts joined."""
    if isinstance(value, dict):
        value = next((value[k] for k in keys if value.get(k)), None)
    if isinstance(value, list):
        value = " ".join(str(x).strip() for x in value if x)
    return value.strip() if isinstance(value, str) and value.strip() else None


def _articles(scripts: list[str], deep: bool) -> list[dict]:
    out = []
    for script in scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        for x in _walk(data, deep) if isinstance(data, dict | list) else ():
            kinds = x.get("@type")
            kinds = {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])}
            wanted = any(t in k for k in kinds for t in ("article", "blogposting")) if deep else kinds & {"article", "newsarticle"}
            if wanted:
                link = x.get("url") or (x.get("mainEntityOfPage") if deep else None)
                link = link[0] if isinstance(link, list) and link else link
                out.append({"url": _plain(link, "@id", "url"), "title": _plain(x.get("headline") or x.get("name")), "published": _plain(x.get("datePublished") or x.get("dateCreated") or x.get("dateModified")), "summary": _plain(x.get("description") or x.get("abstract"), "@value")})
    return out


def _found(scripts: Iterator[pa.Array], deep: bool) -> Iterator[pa.Array]:
    for batch in scripts:
        for own in parts(batch):
            yield pa.array([_articles(s, deep) for s in own.to_pylist()], _ARROW)


@arrow_udf(_LD)
def ld_all(scripts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _found(scripts, True)


@arrow_udf(_LD)
def ld_top(scripts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _found(scripts, False)


def _has_class(n: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(H.attr(n, "class"), F.lit("")), r"\s+"), name)


def _cards(nodes: Column, words: tuple[str, ...]) -> Column:
    """The boxes, at most five levels up, of links whose address holds one of the words, each once, by their first link."""
    links = F.filter(nodes, lambda n: (n["tag"] == "a") & ~F.startswith(F.coalesce(T.strip(H.attr(n, "href")), F.lit("#")), F.lit("#")) & (T.strip(H.attr(n, "href")) != "") & T.contains_any(H.attr(n, "href"), words))
    box = lambda n: H._first(F.filter(H.ancestors(nodes, n, 5), lambda m: m["tag"].isin(*_BOXES)))
    ids = F.array_distinct(F.filter(F.transform(links, lambda n: box(n)["id"]), lambda i: i.isNotNull()))
    return F.transform(ids, lambda i: F.get(nodes, i))


def _attr_dates(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda n: F.filter(F.array(*[H.attr(n, a) for a in ("datetime", "data-date", "data-published")]), lambda x: x.isNotNull())))


def _dates(page: Column, card: Column, up: int) -> Column:
    """Texts that may be the card's date, the likeliest first: attributes, dated classes and <time>, then lines of text; then
    those of siblings and, `up` levels, of what stands around."""
    nodes = page["nodes"]
    beside = F.filter(H.siblings(nodes, card), lambda n: n["tag"] != "-text")
    after = F.slice(F.filter(beside, lambda n: n["id"] > card["id"]), 1, 2)
    before = F.slice(F.reverse(F.filter(beside, lambda n: n["id"] < card["id"])), 1, 2)
    around = F.concat(F.array(card), after, before, H.ancestors(nodes, card, up)) if up else F.array(card)

    def of(box: Column) -> Column:
        inside = F.filter(F.slice(nodes, box["id"] + 1, box["stop"] - box["id"]), lambda n: n["tag"] != "-text")
        marked = F.filter(inside, lambda n: (n["tag"] == "time") | F.rlike(F.lower(F.coalesce(H.attr(n, "class"), F.lit(""))), F.lit("date|time")))
        small = F.filter(inside, lambda n: n["tag"].isin("span", "p", "div"))
        texts = F.transform(F.concat(marked, small) if not up else marked, lambda n: H.said(page, n))
        return F.concat(_attr_dates(inside), texts, F.split(H.said(page, box), "[|•\n]") if not up else F.slice(texts, 1, 0))

    return F.filter(F.flatten(F.transform(around, of)), lambda x: ~T.blank(x))


def _card(page: Column, card: Column, site: str) -> Column:
    text = lambda n: H.said(page, n)
    inside = H.within(page["nodes"], card)
    link = H._first(F.filter(inside, lambda n: (n["tag"] == "a") & H.attr(n, "href").isNotNull()))
    of_tag = lambda t: F.filter(inside, lambda n: n["tag"] == t)
    of_class = lambda c: text(H._first(F.filter(inside, lambda n: _has_class(n, c))))
    heads = lambda tags: [T.non_blank(text(H._first(of_tag(t)))) for t in tags]
    first_line = H._first(F.filter(F.transform(F.split(text(link), "\n"), T.strip), lambda x: x != ""))
    if site == BANK:
        classes = [T.non_blank(of_class(c)) for c in BANK_TITLES]
        title = F.coalesce(*classes, *heads(("h1", "h2", "h3", "h4", "h5", "h6")), first_line)
        told = [of_class(c) for c in BANK_SUMMARIES]
        plain = F.transform(F.filter(inside, lambda n: n["tag"].isin("p", "div", "span") & ~F.contains(F.lower(F.coalesce(H.attr(n, "class"), F.lit(""))), F.lit("date"))), text)
        texts = F.concat(F.array(*told), plain)
    else:
        title = F.coalesce(T.non_blank(text(link)), *heads(("h1", "h2", "h3", "h4")), T.non_blank(text(card)))
        texts = F.flatten(F.array(*[F.transform(of_tag(t), text) for t in ("p", "div", "span")]))
        texts = F.filter(texts, lambda x: (F.length(x) >= 30) | F.endswith(x, F.lit(".")))
    texts = F.filter(texts, lambda x: ~T.blank(x) & (F.lower(x) != F.lower(title)))
    return F.struct(H.attr(link, "href").alias("url"), title.alias("title"), _dates(page, card, 4 if site == BANK else 0).alias("dates"), F.array_distinct(texts).alias("texts"))


def _first_date(texts: Column, now: Column, parse=D.parse_ukrainian) -> Column:
    return H._first(F.filter(F.transform(texts, lambda x: parse(x, now)), lambda d: d.isNotNull()))


def items(pages: DataFrame, site: str) -> DataFrame:
    """(page_id, pos, title, url, published, summary) of pages(page_id, html, now). The bank's cards come before its JSON-LD,
    the tax service's after."""
    host = site.split("//")[1]
    parsed = pages.select("page_id", "now", H.parse_page("html").alias("page"))
    nodes = F.col("page.nodes")
    cards = F.transform(_cards(nodes, ("news",) if site == BANK else ("nov", "media")), lambda c: _card(F.col("page"), c, site))
    cards = parsed.select("page_id", "now", F.posexplode(cards).alias("pos", "c"))
    # an own step: parsing dates inside the card's expression would repeat it
    cards = cards.select("page_id", "pos", "c.url", "c.title", _first_date(F.col("c.dates"), F.col("now")).alias("published"), "c.texts", "now")
    key = F.lower(F.col("title"))

    def tells(x: Column) -> Column:
        """Not a date, nor the title with nothing or a date beside it."""
        rest = F.regexp_replace(F.replace(F.lower(x), key, F.lit("")), r"(?U)^[\s\-,:]+|[\s\-,:]+$", "")
        return D.parse_ukrainian(x, F.col("now")).isNull() & (~F.contains(F.lower(x), key) | (rest != "") & D.parse_ukrainian(rest, F.col("now")).isNull())

    cards = cards.select("page_id", F.lit(1 if site == TAX else 0).alias("kind"), "pos", "url", "title", "published", H._first(F.filter("texts", tells)).alias("summary"))
    scripts = F.col("page.ld")
    ld = parsed.select("page_id", "now", F.posexplode((ld_all if site == BANK else ld_top)(scripts)).alias("pos", "c"))
    parse = D.coerce if site == BANK else D.parse_ukrainian
    ld = ld.select("page_id", F.lit(0 if site == TAX else 1).alias("kind"), "pos", "c.url", "c.title", parse(F.col("c.published"), F.col("now")).alias("published"), "c.summary")
    found = cards.unionByName(ld).withColumn("url", U.listing_link(F.col("url"), F.lit(site + "/"), host))
    found = found.where("url IS NOT NULL AND title IS NOT NULL AND published IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("kind", "pos"))
    kept = found.withColumn("rn", first).where("rn = 1")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "pos")) - 1
    return kept.select("page_id", place.alias("pos"), "title", "url", "published", "summary")


def merged(found: DataFrame, order: list | None = None) -> DataFrame:
    """Items of several listing pages read in the given order of page_id (ascending without one): of one URL the first stays."""
    rank = F.col("page_id") if order is None else F.array_position(F.array(*[F.lit(x) for x in order]), F.col("page_id"))
    first = F.row_number().over(Window.partitionBy("url").orderBy(rank, "pos"))
    return found.withColumn("rn", first).where("rn = 1").drop("rn")
