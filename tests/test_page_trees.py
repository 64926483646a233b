"""Extraction rules against a plain walk over trees of objects, on the driver's pages and on random ones; pages of many nodes and of deep ones."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from newsmill.functions import html as H

D = "/root/testdata/sf0.001"
SKIP = ("script", "style", "noscript", "template")


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def runs(self):
        return [x for k in self.kids for x in (k.runs() if isinstance(k, Node) else [k])]

    @property
    def text(self):
        return "" if self.tag in ("html", "body", "head") else " ".join(self.runs()).strip()

    def ups(self):
        return [] if self.up is None or self.up.up is None else [self.up, *self.up.ups()]


class Tree(HTMLParser):
    """The recovery that the parser's docstrings state, by searching the open elements."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.feed(html or "")
        self.close()

    def open(self, tags, until=()):
        at = self.now
        while at.up is not None and at.tag not in tags:
            if at.tag in until:
                return None
            at = at.up
        return at if at.up is not None else None

    def handle_starttag(self, tag, attrs):
        found = None
        if tag in H._CLOSES_P:
            found = self.open(("p",), ("td", "th", "button", "table"))
        elif tag in ("li", "tr", "td", "th", "dt", "dd"):
            found = self.open((tag,), ("ul", "ol", "table", "dl"))
        self.now = found.up if found else self.now
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.kids.append(node)
        self.now = self.now if tag in H._VOID else node

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        found = self.open((tag,))
        self.now = found.up if found else self.now

    def handle_data(self, data):
        if data.strip() and not any(n.tag in SKIP for n in (self.now, *self.now.ups())):
            self.now.kids.append(data)


def says(text, phrases):
    return any(p in text.lower() for p in phrases)


def find(root, place):
    for n in root.walk():
        classes = n.attrs.get("class", "").split()
        if place[0] == ".":
            hit = place[1:] in classes
        elif place[0] == "[":
            name, value = place[1:-1].split("=")
            hit = n.attrs.get(name) == value and (n.tag == "div" or name == "role")
        else:
            *outer, inner = place.split()
            hit = n.tag == inner and all(any(u.tag == o for u in n.ups()) for o in outer)
        if hit:
            return n
    return None


def until(nodes, stops):
    out = []
    for n in nodes:
        if stops(n):
            break
        out.append(n)
    return out


def once(texts):
    return list(dict.fromkeys(texts))


def article(root):
    order = list(root.walk())
    heads = [n for n in order if n.tag == "h1"]

    def behind(h):
        skip = order.index(h) + 1 + len(list(h.walk()))
        own = [n for n in order[skip:] if n.tag in H.CONTENT and len(n.text) >= 4]
        return once(n.text for n in until(own, lambda n: n.tag in ("h2", "h3", "h4") and says(n.text, H.STOP_HEADINGS) or says(n.text, H.STOP_SECTIONS)))

    def blocks(of):
        own = [h for h in heads if of in h.ups()]
        if own:
            return next((b for b in map(behind, own) if b), [])
        kids = [Node("-text", {}, of) if isinstance(k, str) else k for k in of.kids]
        for k, x in zip(kids, of.kids, strict=True):
            k.kids = [x] if isinstance(x, str) else k.kids
        kids = [k for k in kids if k.tag not in SKIP and k.text]
        return once(k.text for k in until(kids, lambda n: says(n.text, H.STOP_SECTIONS)) if len(k.text) >= 4)

    places = [p for p in (find(root, x) for x in H.ARTICLE_PLACES) if p] + [u for h in heads for u in h.ups()]
    joined = "\n\n".join(next((b for b in map(blocks, places) if b), []))
    if len(joined) > 4000:
        cut = joined[:4000]
        at = cut.rfind("\n\n") if cut.rfind("\n\n") > 2000 else cut.rfind(" ")
        joined = cut[:at].strip() if at >= 0 else cut
    return joined or None


def generic(root):
    head = find(root, "h1")
    places = [p for p in (*(find(root, x) for x in ("main", "article", "[role=main]", "[itemprop=articleBody]")), head and head.up) if p and p.up is not None]
    places = places or [n for n in root.walk() if n.tag in ("div", "section")]
    score = lambda p: sum(len(n.text) for n in p.walk() if n.tag in ("p", "h2", "h3", "ul", "ol", "li", "blockquote"))
    best = max(places, key=score, default=None)
    if not best or not score(best):
        return None
    own = [n for n in best.walk() if n.tag in ("p", "h2", "h3", "li", "blockquote") and n.text]
    body = "\n\n".join(once(n.text for n in until(own, lambda n: says(n.text, H.BANK_STOPS)))).strip()[:3500]
    return body if len(body) >= 200 else None


def bank(root):
    h, order = find(root, "h1"), list(root.walk())
    if not h:
        return None
    beside = [k if isinstance(k, Node) else None for k in h.up.kids]
    after = beside[beside.index(h) + 1 :]
    texts = [(k, n.text if n else k.strip()) for k, n in zip(h.up.kids[beside.index(h) + 1 :], after, strict=True)]
    texts = [(k, x) for k, x in texts if x and not (isinstance(k, Node) and k.tag in SKIP)]
    dated = [k for k, x in texts[:50] if re.search(H.BANK_DATE.replace("(?iU)", "(?i)"), x)]
    start = dated[0] if dated else texts[0][0] if texts else h
    seen, own = False, []
    for k in h.up.kids:
        if seen and isinstance(k, Node):
            own += [k, *k.walk()]
        seen = seen or k is start
    own = [n for n in own if n.tag in ("p", "h2", "h3", "li", "blockquote") and n.text]
    own = until(own, lambda n: says(n.text, H.BANK_STOPS))
    body = "\n\n".join(once(("• " if n.tag == "li" else "") + n.text for n in own))
    assert order
    return body if len(body) >= 200 else None


def pages(rng, n):
    words = ["слово", "банк", "a&amp;b", "податок", "довге слово тут", "12 січня 2024 10:20", "Теги", "Читайте також", "ok", "рішення про ставку", "é🙂"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 40])))

    def inner(depth):
        out = ""
        for _ in range(rng.randrange(5)):
            tag = rng.choice(["p", "div", "li", "ul", "h1", "h2", "h3", "span", "section", "blockquote", "br", "table", "td", "script", "main", "article"])
            attrs = rng.choice(["", "", "", " class='x news__text'", " class='article__content'", " itemprop='articleBody'", " role='main'"])
            body = inner(depth - 1) if depth and rng.random() < 0.6 else said()
            out += f"<{tag}{attrs}>{body}" + ("" if rng.random() < 0.15 else f"</{rng.choice([tag, tag, tag, tag, 'div'])}>") + rng.choice(["", "", said()])
        return out

    return [f"<html><body>{inner(4)}</body></html>" for _ in range(n)]


@pytest.fixture(scope="module")
def all_pages(spark):
    own = [r.html for r in spark.read.parquet(f"{D}/pages.parquet").select("html").collect()]
    return own + pages(random.Random(7), 300) + ["", None, "no markup", "<p>a" * 50]


def test_rules_against_a_plain_walk(spark, all_pages):
    df = spark.createDataFrame(list(enumerate(all_pages)), "id int, html string").repartition(8).withColumn("page", H.parse_page("html"))
    got = {r.id: r for r in df.select("id", H.article_text(F.col("page")).alias("article"), H.generic_body(F.col("page")).alias("generic"), H.bank_body(F.col("page")).alias("bank")).collect()}
    found = {"article": 0, "generic": 0, "bank": 0}
    for i, html in enumerate(all_pages):
        root = Tree(html).root
        for name, rule in (("article", article), ("generic", generic), ("bank", bank)):
            assert got[i][name] == rule(root), (name, i, html)
            found[name] += got[i][name] is not None
    assert min(found.values()) > 20


def test_nodes_against_a_plain_walk(all_pages):
    for html in all_pages:
        own, root = H.nodes_of(html), Tree(html).root
        nodes = [n for n in own["nodes"] if n["tag"] != "-text"]
        assert [(n["tag"], own["text"][n["start"] : n["start"] + n["size"]].decode()) for n in nodes] == [(n.tag, n.text) for n in root.walk()]
        for n, x in zip(nodes, root.walk(), strict=True):
            assert n["chars"] == len(x.text) and n["depth"] == len(x.ups()) and own["nodes"][n["id"]] is n
            assert n["prose"] == sum(len(y.text) for y in x.walk() if y.tag in ("p", "h2", "h3", "li", "blockquote"))
            assert all(own["nodes"][k]["parent"] == n["id"] for k in n["kids"]) and len(n["kids"]) == len(x.kids)


def test_nested_text_is_stored_once():
    deep = H.nodes_of("<div>word " * 6000)
    assert len(deep["text"]) < 40_000 and deep["nodes"][0]["size"] == len(deep["text"].strip()) and len(deep["nodes"]) == 12_000


def test_time_grows_with_the_nodes(spark):
    rules = (H.article_text, H.bank_body, H.generic_body, lambda p: H.regulator_article(p, F.lit("T")))
    took = {}
    for n in (700, 700, 7000):
        page = "<body><div class='news__text'><h1>T</h1><p>12 січня 2024 10:20</p>" + "".join(f"<div><p>Paragraph number {i} says something long enough.</p></div>" for i in range(n)) + "</div></body>"
        df = spark.createDataFrame([(page,)] * 4, "html string").withColumn("page", H.parse_page("html")).select(*[f(F.col("page")) for f in rules])
        start = time.perf_counter()
        assert all(all(r) for r in df.collect())
        took[n] = time.perf_counter() - start
    assert took[7000] < 25 * took[700]  # ten times the nodes; scanning all nodes for each would take a hundred times as long
