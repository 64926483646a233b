"""Pages as arrays of nodes over one text, and what articles hold as column expressions over them.

A small parser turns a page into one text (its visible runs, a space between two) and its nodes in document order. A node
has its place `id`, `parent`, `depth`, `stop` (the place behind its last descendant), `kids` (places of its children), tag and
attributes; its text is the stretch `start`, `size` (bytes) of the page's text, `chars` characters long, so nested text is stored
once. `prose`, `lists` and `boxes` are the characters that the content tags inside a node hold. Text runs are nodes of tag
`-text`. What stands inside a node is a slice of the array, its children and ancestors are looked up by place. All
extraction rules are higher-order functions over that array, so they run inside Spark's plan without another pass over the HTML.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, MapType, StringType, StructField, StructType

from . import text as T
from . import urls as U
from .batches import parts

NODE = StructType([
    *[StructField(n, IntegerType()) for n in ("id", "parent", "depth", "stop")], StructField("kids", ArrayType(IntegerType())), StructField("tag", StringType()), StructField("attrs", MapType(StringType(), StringType())),
    *[StructField(n, IntegerType()) for n in ("start", "size", "chars", "prose", "lists", "boxes")],
])
PAGE = StructType([StructField("text", BinaryType()), StructField("nodes", ArrayType(NODE)), StructField("ld", ArrayType(StringType()))])
#: Tags whose text counts as prose, as a list of points, as a box.
_COUNTED = {"prose": frozenset(("p", "h2", "h3", "li", "blockquote")), "lists": frozenset(("ul", "ol")), "boxes": frozenset(("td", "div"))}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))
_WHOLE = frozenset(("html", "body", "head"))

# Where articles stand, what ends them, and what counts as content.
ARTICLE_PLACES = (".article__content", ".article__body", ".article__text", ".news__content", ".news__text", "main article", "article", "main", "section", "[data-component=article]", "[itemprop=articleBody]")
REGULATOR_PLACES = (".article__content", ".article__body", ".news__content", ".news__text", "main article", "article", "main", "section", "[data-component=article]", "[itemprop=articleBody]")
CONTENT = ("p", "li", "h2", "h3", "h4", "blockquote")
STOP_HEADINGS = ("новини по темі", "по темі", "related", "читайте також")
STOP_SECTIONS = ("теги", "поділитися", "поделиться", "останні новини", "останні публікації", "related", "читайте також")
BANK_STOPS = ("теги", "поділитися", "останн")
BANK_DATE = r"(?iU)\d{1,2}\s+[А-Яа-яІіЄєҐґ.]+\s+\d{4}\s+\d{2}:\d{2}|^\d{1,2}:\d{2}$"
REGULATOR_DATE = r"(?iuU)\b\d{1,2}\s+[А-Яа-яІіЄєҐґ.]{2,}\s+\d{4}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}\b"
MOST_REGULATOR, MOST_GENERIC, LEAST_BODY = 5000, 3500, 200
IMAGE_METAS = (("property", "og:image"), ("property", "og:image:url"), ("property", "og:image:secure_url"), ("name", "twitter:image"), ("name", "twitter:image:src"))
IMAGE_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-srcset", "srcset", "src")
BETTER_IMAGE_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-lazy", "data-image", "data-full", "data-large", "src", "srcset", "data-srcset")


class _Builder(HTMLParser):
    """`open` holds the places of open elements, `at` for each tag where in `open` its elements stand: nothing is searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.at, self.ld, self.runs, self.silent = [], [], defaultdict(list), [], [], 0

    def add(self, tag: str, attrs: dict) -> dict:
        up = self.open[-1] if self.open else -1
        node = {"id": len(self.nodes), "parent": up, "depth": len(self.open), "stop": len(self.nodes) + 1, "kids": [], "tag": tag, "attrs": attrs, "first": len(self.runs), "last": len(self.runs)}
        if up >= 0:
            self.nodes[up]["kids"].append(node["id"])
        self.nodes.append(node)
        return node

    def shut(self, to: int) -> None:
        while len(self.open) > to:
            node = self.nodes[self.open.pop()]
            node["stop"], node["last"] = len(self.nodes), len(self.runs)
            self.at[node["tag"]].pop()
            self.silent -= node["tag"] in _SILENT

    def innermost(self, tags, until=()) -> int | None:
        last = lambda some: max((self.at[t][-1] for t in some if self.at[t]), default=-1)
        own = last(tags)
        return own if own > last(until) else None

    def handle_starttag(self, tag, attrs):
        at = self.innermost(("p",), ("td", "th", "button", "table")) if tag in _CLOSES_P else self.innermost((tag,), ("ul", "ol", "table", "dl")) if tag in ("li", "tr", "td", "th", "dt", "dd") else None
        if at is not None:
            self.shut(at)
        node = self.add(tag, {k: v or "" for k, v in attrs})
        if tag not in _VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node["id"])
            self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.innermost((tag,))
        if at is not None:
            self.shut(at)

    def handle_data(self, data):
        around = self.nodes[self.open[-1]] if self.open else None
        if around and around["tag"] == "script" and "ld+json" in around["attrs"].get("type", ""):
            self.ld.append(data)
        if not self.silent and data.strip():
            node = self.add("-text", {})
            self.runs.append(data)
            node["last"] = len(self.runs)


def nodes_of(html: str | None) -> dict:
    """Markup that breaks off or closes what is not open is taken as it comes; an end tag closes all inside it."""
    own = _Builder()
    try:
        own.feed(html or "")
        own.close()
    except (AssertionError, ValueError):
        pass
    own.shut(0)
    raw = [r.encode("utf-8", "surrogatepass") for r in own.runs]
    # where runs start in bytes and in characters, and what is space at their ends
    bytes_at, chars_at = ([0, *accumulate(len(x) + 1 for x in some)] for some in (raw, own.runs))
    ends = [(len(r[: len(r) - len(r.lstrip())].encode()), len(r) - len(r.lstrip()), len(r[len(r.rstrip()) :].encode()), len(r) - len(r.rstrip())) for r in own.runs]
    sums = {k: [0] for k in _COUNTED}
    for node in own.nodes:
        first, last = node.pop("first"), node.pop("last")
        if first == last or node["tag"] in _WHOLE:
            node |= {"start": 0, "size": 0, "chars": 0}
        else:
            # no run is blank, so only the ends of the first and the last have to be stripped
            start = bytes_at[first] + ends[first][0]
            node |= {"start": start, "size": bytes_at[last] - 1 - ends[last - 1][2] - start, "chars": chars_at[last] - 1 - ends[last - 1][3] - chars_at[first] - ends[first][1]}
        for k, tags in _COUNTED.items():
            sums[k].append(sums[k][-1] + node["chars"] * (node["tag"] in tags))
    for node in own.nodes:
        node |= {k: x[node["stop"]] - x[node["id"] + 1] for k, x in sums.items()}
    return {"text": b" ".join(raw), "nodes": own.nodes, "ld": own.ld}


_ARROW = to_arrow_type(PAGE)


@arrow_udf(PAGE)
def parse_page(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in html:
        for own in parts(batch):
            # page by page, so that no more than one stands as Python objects
            yield pa.concat_arrays([pa.array([nodes_of(x.as_py())], _ARROW) for x in own] or [pa.array([], _ARROW)])


def said(page: Column, n: Column) -> Column:
    """A node's text: bytes are cut, for to find a character's place its string would be read from the start."""
    return F.substr(page["text"], n["start"] + 1, n["size"]).cast("string")


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _inside(node: Column, of: Column) -> Column:
    return (node["id"] > of["id"]) & (node["id"] < of["stop"])


def within(nodes: Column, of: Column) -> Column:
    """All that stands inside a node."""
    return F.slice(nodes, of["id"] + 2, of["stop"] - of["id"] - 1)


def children(nodes: Column, of: Column) -> Column:
    return F.transform(of["kids"], lambda i: F.get(nodes, i))


def siblings(nodes: Column, of: Column) -> Column:
    """The children of a node's parent, itself included; at the top all nodes without a parent."""
    return F.when(of["parent"] >= 0, children(nodes, F.get(nodes, of["parent"]))).otherwise(F.filter(nodes, lambda n: n["parent"] < 0))


def ancestors(nodes: Column, node: Column, most: int | None = None) -> Column:
    """From the nearest outwards, `most` of them, from parent to parent."""
    up = node["depth"] if most is None else F.least(node["depth"], F.lit(most))
    step = lambda ids, _: F.array_append(ids, F.get(nodes, F.element_at(ids, -1))["parent"])
    ids = F.when(up > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(up, F.lit(2))), F.array(node["parent"]), step)).otherwise(F.slice(F.array(node["parent"]), F.lit(1), up))
    return F.transform(ids, lambda i: F.get(nodes, i))


def _matches(n: Column, place: str) -> Column:
    if place[0] == ".":
        classes = F.coalesce(attr(n, "class"), F.lit(""))
        return F.contains(classes, F.lit(place[1:])) & F.array_contains(F.split(classes, r"\s+"), place[1:])
    if place[0] == "[":
        name, value = place[1:-1].split("=")
        return F.coalesce(attr(n, name) == value, F.lit(False)) & ((n["tag"] == "div") | (name == "role"))
    return n["tag"] == place


def find(nodes: Column, place: str) -> Column:
    """The first node at a place, null without one."""
    if " " in place:
        outer, inner = place.split()
        around = F.filter(nodes, lambda m: m["tag"] == outer)
        return T.let(around, lambda own: _first(F.filter(nodes, lambda n: (n["tag"] == inner) & F.exists(own, lambda m: _inside(n, m)))))
    return _first(F.filter(nodes, lambda n: _matches(n, place)))


def _until(found: Column, stops) -> Column:
    """The elements before the first that stops."""
    def cut(own: Column) -> Column:
        return T.let(F.array_position(F.transform(own, stops), True).cast("int"), lambda at: F.when(at > 0, F.slice(own, 1, F.greatest(at - 1, F.lit(0)))).otherwise(own))

    return T.let(found, cut)


def _worded(page: Column, found: Column) -> Column:
    """The nodes' tags and texts."""
    return F.transform(found, lambda n: F.struct(n["id"].alias("id"), n["tag"].alias("tag"), said(page, n).alias("text")))


def _texts(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda n: n["text"]))


def _pointed(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda n: F.when(n["tag"] == "li", F.concat(F.lit("• "), n["text"])).otherwise(n["text"])))


def first_yield(found: Column, f: Callable[[Column], Column]) -> Column:
    """f of the first element for which it has any elements; f is not worked out for those behind it."""
    return F.aggregate(found, F.lit(None).cast("array<string>"), lambda got, x: F.when(F.coalesce(F.size(got), F.lit(0)) > 0, got).otherwise(f(x)))


def content_of(page: Column) -> Column:
    """Content of at least 4 characters in order: (id, text, ends), `ends` at stop phrases."""
    own = _worded(page, F.filter(page["nodes"], lambda n: n["tag"].isin(*CONTENT) & (n["chars"] >= 4)))
    ends = lambda n: n["tag"].isin("h2", "h3", "h4") & T.contains_any(n["text"], STOP_HEADINGS) | T.contains_any(n["text"], STOP_SECTIONS)
    return F.transform(own, lambda n: F.struct(n["id"].alias("id"), n["text"].alias("text"), ends(n).alias("ends")))


def blocks_after(content: Column, heading: Column) -> Column:
    """Content behind a heading, to the end of the page or the first stop phrase, each text once."""
    return _texts(_until(F.filter(content, lambda n: n["id"] >= heading["stop"]), lambda n: n["ends"]))


def child_blocks(page: Column, of: Column) -> Column:
    own = _worded(page, F.filter(children(page["nodes"], of), lambda n: ~n["tag"].isin(*_SILENT) & (n["chars"] > 0)))
    return _texts(F.filter(_until(own, lambda n: T.contains_any(n["text"], STOP_SECTIONS)), lambda n: F.length(n["text"]) >= 4))


def article_text(page: Column) -> Column:
    """The first candidate place that yields text: behind its first heading that has content, or its children where it has
    no heading. Candidates: ARTICLE_PLACES, then what stands around each h1. Null where nothing is found."""
    nodes = page["nodes"]

    def found(content: Column, headings: Column) -> Column:
        def blocks(of: Column) -> Column:
            return T.let(F.filter(headings, lambda h: _inside(h, of)), lambda own: F.when(F.size(own) > 0, first_yield(own, lambda h: blocks_after(content, h))).otherwise(child_blocks(page, of)))

        places = F.filter(F.array(*[find(nodes, p) for p in ARTICLE_PLACES]), lambda n: n.isNotNull())
        return F.coalesce(F.nullif(first_yield(places, blocks), F.array().cast("array<string>")), first_yield(headings, lambda h: first_yield(ancestors(nodes, h), blocks)))

    headed = F.filter(nodes, lambda n: n["tag"] == "h1")
    return T.let(T.let(content_of(page), lambda c: T.let(headed, lambda h: found(c, h))), lambda b: F.when(F.size(b) > 0, T.cap_blocks(b)))


def bank_body(page: Column) -> Column:
    """Behind the first of 50 siblings of the heading that looks like a date, else behind the first that has text."""
    nodes = page["nodes"]

    def behind(start: Column, end: Column) -> Column:
        own = F.filter(F.slice(nodes, start + 1, F.greatest(end - start, F.lit(0))), lambda n: n["tag"].isin("p", "h2", "h3", "li", "blockquote") & (n["chars"] > 0))
        return F.array_join(_pointed(_until(_worded(page, own), lambda n: T.contains_any(n["text"], BANK_STOPS))), "\n\n")

    def body(h: Column) -> Column:
        near = F.filter(siblings(nodes, h), lambda n: (n["id"] > h["id"]) & ~n["tag"].isin(*_SILENT) & (n["chars"] > 0))
        start = T.let(near, lambda x: F.coalesce(_first(F.filter(F.slice(x, 1, 50), lambda n: F.rlike(said(page, n), F.lit(BANK_DATE)))), _first(x), h)["stop"])
        end = F.coalesce(F.get(nodes, h["parent"])["stop"], F.size(nodes))
        return T.let(start, lambda s: T.let(end, lambda e: behind(s, e)))

    joined = T.let(find(nodes, "h1"), lambda h: F.when(h.isNotNull(), body(h)))
    return T.let(joined, lambda x: F.when(F.length(x) >= LEAST_BODY, x))


def best_place(places: Column, score: Callable[[Column], Column]) -> Column:
    """The first of the highest score, null if all are zero."""
    best = T.let(places, lambda own: F.aggregate(own, _first(own), lambda a, n: F.when(score(n) > score(a), n).otherwise(a)))
    return T.let(best, lambda b: F.when(score(b) > 0, b))


def generic_body(page: Column, least: int = LEAST_BODY, most: int = MOST_GENERIC) -> Column:
    """The place fullest of text, nested text counted each time, cut hard at `most`; null if shorter than `least`."""
    nodes = page["nodes"]
    around = T.let(find(nodes, "h1")["parent"], lambda p: F.when(p >= 0, F.get(nodes, p)))
    own = F.filter(F.array(*[find(nodes, p) for p in ("main", "article", "[role=main]", "[itemprop=articleBody]")], around), lambda n: n.isNotNull())
    own = T.let(own, lambda x: F.when(F.size(x) > 0, x).otherwise(F.filter(nodes, lambda n: n["tag"].isin("div", "section"))))

    def body(best: Column) -> Column:
        inside = F.filter(within(nodes, best), lambda n: n["tag"].isin("p", "h2", "h3", "li", "blockquote") & (n["chars"] > 0))
        inside = _until(_worded(page, inside), lambda n: T.contains_any(n["text"], BANK_STOPS))
        return F.substring(T.strip(F.array_join(_texts(inside), "\n\n")), 1, most)

    joined = T.let(best_place(own, lambda n: n["prose"] + n["lists"]), lambda b: F.when(b.isNotNull(), body(b)))
    return T.let(joined, lambda x: F.when(F.length(x) >= least, x))


def is_reliable(body: Column, html: Column) -> Column:
    """At least 200 characters, and three (or all, if fewer) of the first eight words of four letters stand in the page."""
    def held(text: Column) -> Column:
        words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\wЀ-ӿ]{4,})"), F.lit(1)), 1, 8)
        enough = lambda own: (F.size(own) > 0) & (T.let(F.lower(html), lambda low: F.size(F.filter(own, lambda w: F.contains(low, w)))) >= F.least(F.lit(3), F.size(own)))
        return (F.length(text) >= LEAST_BODY) & T.let(words, enough)

    return F.coalesce(T.let(body, held), F.lit(False))


def regulator_article(page: Column, title: Column) -> Column:
    """Blocks of the best place: paragraphs, headings, table cells, list items and divs that hold text of their own (40
    characters, 80 beside other blocks), without title, dates and stop phrases; else all paragraphs of the page. Valid from 250
    characters or two blocks."""
    nodes = page["nodes"]

    def is_block(n: Column) -> Column:
        # the runs are stripped, so their lengths and the spaces between them are the length of what they say together
        direct = lambda own: T.let(F.filter(own, lambda m: m["tag"] == "-text"), lambda runs: F.aggregate(runs, F.size(runs) - 1, lambda a, m: a + m["chars"]))
        atomic = lambda own: ~F.exists(own, lambda m: m["tag"].isin("p", "ul", "ol", "li", "blockquote", "table", "tr", "td", "h2", "h3", "div"))
        filled = lambda own: atomic(own) & ((n["chars"] >= 40) | T.contains_any(said(page, n), STOP_SECTIONS)) | (direct(own) >= 80)
        return n["tag"].isin("p", "h2", "h3", "li", "blockquote", "td") | (n["tag"] == "div") & T.let(children(nodes, n), filled)

    def joined(found: Column, key: Column) -> Column:
        kept = lambda n: (n["text"] != "") & (key != T.title_key(n["text"])) & ~((F.length(n["text"]) < 40) & F.rlike(n["text"], F.lit(REGULATOR_DATE)))
        return _pointed(_until(F.filter(_worded(page, found), kept), lambda n: T.contains_any(n["text"], STOP_SECTIONS)))

    def valid(found: Column) -> Column:
        return T.let(found, lambda b: F.when((F.size(b) >= 2) | (F.length(F.array_join(b, "\n\n")) >= 250), b))

    around = F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "h1"), lambda h: ancestors(nodes, h)))
    places = F.concat(F.filter(F.array(*[find(nodes, p) for p in REGULATOR_PLACES]), lambda n: n.isNotNull()), around)
    best = best_place(places, lambda n: n["prose"] + n["boxes"])

    def chosen(key: Column) -> Column:
        own = T.let(best, lambda b: F.when(b.isNotNull(), valid(joined(F.filter(within(nodes, b), is_block), key))))
        return F.coalesce(own, valid(joined(F.filter(nodes, lambda n: n["tag"].isin("p", "li")), key)))

    return T.let(T.let(F.coalesce(T.title_key(title), F.lit("")), chosen), lambda b: T.cap_blocks(b, MOST_REGULATOR, None))


def meta_content(page: Column, name: str, value: str) -> Column:
    """The content of the first such meta that has any."""
    own = F.filter(page["nodes"], lambda n: (n["tag"] == "meta") & (F.lower(attr(n, name)) == value) & ~T.blank(attr(n, "content")))
    return attr(_first(own), "content")


def meta_description(page: Column) -> Column:
    return T.normalize_paragraphs(F.coalesce(meta_content(page, "property", "og:description"), meta_content(page, "name", "description"), meta_content(page, "name", "twitter:description")))


def image_url(x: Column, base: Column) -> Column:
    """A usable image address: http(s) after resolving it against the page; null for data: and blank ones."""
    def of(own: Column) -> Column:
        full = F.when(F.startswith(own, F.lit("//")), F.concat(F.lit("https:"), own)).when(base.isNotNull(), U.absolute(own, base)).otherwise(own)
        return F.when((own != "") & ~F.startswith(own, F.lit("data:")), T.let(full, lambda u: F.when(U.part(u, 1).isin("http", "https"), u)))

    return T.let(F.regexp_replace(T.strip(x), "^[\"']+|[\"']+$", ""), of)


def best_of_srcset(x: Column, base: Column) -> Column:
    """The widest candidate (`w`, or `x` times a thousand), the first of ties."""
    parts = F.filter(F.transform(F.split(x, ","), T.strip), lambda c: c != "")

    def candidate(c: Column) -> Column:
        size = F.regexp_extract(c, r"\s(\S+)", 1)
        width = F.when(F.rlike(size, F.lit(r"^\d+(\.\d+)?w$")), F.regexp_extract(size, r"^(.*)w$", 1).cast("double")).when(F.rlike(size, F.lit(r"^\d+(\.\d+)?x$")), F.regexp_extract(size, r"^(.*)x$", 1).cast("double") * 1000)
        return F.struct(image_url(F.regexp_extract(c, r"^(\S+)", 1), base).alias("url"), F.coalesce(width, F.lit(0.0)).alias("score"))

    known = F.filter(F.transform(parts, candidate), lambda c: c["url"].isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("url"), F.lit(-1.0).alias("score"))
    return F.aggregate(known, none, lambda a, c: F.when(c["score"] > a["score"], c).otherwise(a))["url"]


def _first_url(found: Column, shown: Callable[[Column], Column]) -> Column:
    """What the first candidate gives that gives an address; those behind it are not looked at."""
    return F.aggregate(found, F.lit(None).cast("string"), lambda got, c: F.coalesce(got, shown(c)))


def image(page: Column, base: Column) -> Column:
    """The page's own picture: metas, the image_src link, sources, then images."""
    nodes = page["nodes"]
    told = lambda x, wide=False: F.struct(x.alias("at"), F.lit(wide).alias("wide"))
    of_tag = lambda tag: F.filter(nodes, lambda n: n["tag"] == tag)
    of_meta = lambda k, v: F.transform(F.filter(of_tag("meta"), lambda n: attr(n, k) == v), lambda n: told(attr(n, "content")))
    metas = [of_meta(k, v) for k, v in IMAGE_METAS]
    link = F.transform(F.slice(F.filter(of_tag("link"), lambda n: attr(n, "rel") == "image_src"), 1, 1), lambda n: told(attr(n, "href")))
    sources = F.transform(of_tag("source"), lambda n: told(F.coalesce(F.nullif(attr(n, "srcset"), F.lit("")), attr(n, "data-srcset")), True))
    images = F.flatten(F.transform(of_tag("img"), lambda n: F.array(*[told(attr(n, a), "srcset" in a) for a in IMAGE_ATTRS])))
    return _first_url(F.concat(*metas, link, sources, images), lambda c: F.when(c["wide"], best_of_srcset(c["at"], base)).otherwise(image_url(c["at"], base)))


def better_image(page: Column, base: Column, found: Column) -> Column:
    """`found`, unless it is a preview picture (or none): then the first picture of the page that is not."""
    nodes = page["nodes"]
    listed = lambda x: F.coalesce(F.transform(F.split(x, ","), lambda c: F.regexp_extract(T.strip(c), r"^(\S+)", 1)), F.array().cast("array<string>"))
    of = lambda tag, names: F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == tag), lambda n: F.concat(*[listed(attr(n, a)) if "srcset" in a else F.array(attr(n, a)) for a in names])))
    is_picture = lambda n: F.rlike(F.lower(attr(n, "href")), F.lit(r"\.(jpe?g|png|webp|gif)(\?|$)"))
    links = F.transform(F.filter(nodes, lambda n: (n["tag"] == "a") & F.coalesce(is_picture(n), F.lit(False))), lambda n: attr(n, "href"))
    styles = F.transform(F.filter(nodes, lambda n: attr(n, "style").isNotNull()), lambda n: F.nullif(F.regexp_extract(attr(n, "style"), r"(?i)background(?:-image)?\s*:[^;]*url\(([^)]+)\)", 1), F.lit("")))
    every = F.concat(of("source", ("srcset", "data-srcset")), of("img", BETTER_IMAGE_ATTRS), links, styles)
    preview = found.isNull() | F.contains(F.lower(found), F.lit("preview"))
    full = lambda x: T.let(image_url(x, base), lambda u: F.when(~F.contains(F.lower(u), F.lit("preview")), u))
    return F.when(preview, F.coalesce(_first_url(every, full), found)).otherwise(found)
