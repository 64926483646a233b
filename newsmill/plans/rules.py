"""Queries over the rules for texts, links and dates, added to the catalog, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import preview as P
from ..functions import text as T
from ..functions import urls as U
from ..sources import feeds
from . import ingest
from .catalog import _KYIV, _NEWS, _TIDY, NOW, ORACLES, query

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_MARKS = T._CLASS.replace("'", "''")
_UA = T._UA_DATE.removeprefix("(?U)")


def _key(x: str) -> str:
    """title_key in SQL."""
    return rf"lower(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g'), '^[\-–—•:*]+\s*', ''))"


def _lines(x: str) -> str:
    return rf"list_transform(regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c]'), lambda l: trim(l, {_WS}))"


def _stripped(lines: str, key: str) -> str:
    """strip_preamble in SQL over an array of stripped lines."""
    mine = _key("l")
    skipped = rf"l = '' OR regexp_matches(l, '^\s*\p{{Lu}}[^:]{{2,99}}:') OR ({key} <> '' AND starts_with({mine}, {key}) AND regexp_matches(substr({mine}, length({key}) + 1), '^[ .,:;!?\-–—]*$')) OR regexp_matches({mine}, '{_UA}')"
    at = f"list_position(list_transform({lines}, lambda l: {skipped}), false)"
    return f"CASE WHEN coalesce({at}, 0) > 0 THEN trim(array_to_string({lines}[{at}:], chr(10)), {_WS}) ELSE '' END"


def _text(x) -> F.Column:
    return x.cast("string")


@query(f"""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'plain ' || page_id ELSE url END AS source, CASE WHEN page_id % 3 = 0 THEN 'Label ' || page_id END AS given FROM pages)
SELECT page_id, CASE WHEN given IS NOT NULL THEN source ELSE coalesce(nullif({_HOST.format("source")}, ''), source) END AS key, coalesce(given, nullif({_HOST.format("source")}, ''), source) AS label FROM s""")
def source_key(t):
    page = F.col("page_id")
    source = F.when(page % 3 == 1, F.concat(F.lit("plain "), _text(page))).otherwise(F.col("url"))
    own = t("pages").select("page_id", U.resource(source, F.when(page % 3 == 0, F.concat(F.lit("Label "), _text(page)))).alias("r"))
    return own.select("page_id", "r.key", "r.label")


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'Title ' || page_id ELSE url END AS title FROM pages")
def title_default(t):
    page = F.col("page_id")
    return t("pages").select("page_id", ingest.title_or_url(F.when(page % 3 == 0, "").when(page % 3 == 2, F.concat(F.lit("Title "), _text(page))), F.col("url")).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.tax.gov.ua/a/' || page_id || '?x=1' ELSE url END AS address FROM pages")
def fetch_address(t):
    asked = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://sub.TAX.gov.ua/a/"), _text(F.col("page_id")), F.lit("?x=1#y"))).otherwise(F.col("url"))
    return t("pages").select("page_id", U.fetch_address(asked).alias("address"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN md5(html) END AS html FROM pages")
def staged_fetch(t):
    """The first of four ways that brought a page."""
    way = F.col("page_id") % 5
    tried = t("pages").select("page_id", "url", F.when(way == 0, "one").otherwise("").alias("html_1"), F.when(way <= 1, "two").alias("html_2"), F.when(way <= 2, "three").otherwise("").alias("html_3"), F.when(way <= 3, F.md5("html")).alias("html_4"))
    return feeds.staged(tried).select("page_id", "html")


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN 'page ' || page_id END AS primary_html, CASE WHEN page_id % 3 = 0 THEN 'print ' || page_id END AS print_html,
'{_NEWS}print-' || (page_id + 1000) || '.html' AS print_url FROM pages""")
def article_pair(t):
    """A page and its print page where they have landed; an answer other than 200 has not."""
    page = F.col("page_id")
    number = _text(page + 1000)
    own = t("pages").select("page_id", F.concat(F.lit(_NEWS), number, F.lit(".html")).alias("url"))
    primary = t("pages").where(page % 2 == 0).select(F.concat(F.lit(_NEWS), number, F.lit(".html")).alias("url"), F.concat(F.lit("page "), _text(page)).alias("html"), F.when(page % 5 == 0, 404).otherwise(200).alias("status"))
    printed = t("pages").where(page % 3 == 0).select(F.concat(F.lit(_NEWS + "print-"), number, F.lit(".html")).alias("url"), F.concat(F.lit("print "), _text(page)).alias("html"), F.lit(None).cast("int").alias("status"))
    return feeds.article_pages(own, primary.unionByName(printed)).select("page_id", "primary_html", "print_html", "print_url")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://tax.gov.ua/n/' || page_id WHEN 1 THEN 'https://tax.gov.ua/n/' || page_id WHEN 2 THEN 'https://tax.gov.ua/n/' || page_id
WHEN 3 THEN 'https://tax.gov.ua/media/n/' || page_id END AS link FROM pages""")
def listing_link(t):
    """Absolute, from the root, without a scheme, relative; mail addresses and other sites go."""
    n, kind = _text(F.col("page_id")), F.col("page_id") % 6
    heads = ("https://tax.gov.ua/n/", " /n/", "//tax.gov.ua/n/", "n/", "mailto:a@tax.gov.ua?", "https://other.example/")
    link = F.concat(F.get(F.array(*map(F.lit, heads)), kind.cast("int")), n, F.lit(" "))
    return t("pages").select("page_id", U.listing_link(link, F.lit("https://tax.gov.ua/media/list"), "tax.gov.ua").alias("link"))


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://s.example/' || page_id WHEN 1 THEN '{_NEWS}' || (page_id + 1000) || '.html' ELSE url END AS link,
'Читати далі: [s.example](https://s.example/' || page_id || ')' || chr(10) || chr(10) || '_{T.DISCLAIMER}_' AS sources_md FROM pages""")
def cleanup_link(t):
    """The first link of a draft's sources, else its article's own page, else the article's URL."""
    page = F.col("page_id")
    line = T.sources_line(F.lit("s.example"), F.concat(F.lit("https://s.example/"), _text(page)))
    url = F.when(page % 3 == 1, F.concat(F.lit(_NEWS + "print-"), _text(page + 1000), F.lit(".html"))).otherwise(F.col("url"))
    link = F.coalesce(U.first_markdown_link(F.when(page % 3 == 0, line).otherwise("[x](ftp://y)")), U.tax_canonical(url), url, F.lit(""))
    return t("pages").select("page_id", link.alias("link"), line.alias("sources_md"))


@query("SELECT doc_id, 'Теги #a. {{' || replace(replace(text, '{', '{{'), '}', '}}') || '}} і все' AS prompt FROM documents")
def prompt_text(t):
    return t("documents").select("doc_id", T.prompt("Теги {base_tags}. {article_title} і все", F.lit("#a"), F.concat(F.lit("{"), "text", F.lit("}"))).alias("prompt"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'given ' || doc_id WHEN doc_id % 3 = 1 THEN 'told here' ELSE text END AS summary,
CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS teaser FROM documents""")
def summary_choice(t):
    """The given summary unless it is the title, is blank or missing; the page's own unless it is; else the body. No teaser beside a print page."""
    own = F.col("doc_id")
    given = F.when(own % 4 == 0, F.upper("source")).when(own % 4 == 2, " ").when(own % 4 == 3, F.concat(F.lit("given  "), _text(own)))
    meta = F.when(own % 3 == 0, F.col("source")).when(own % 3 == 1, "told\nhere")
    teaser = T.initial_summary(F.lit("www.tax.gov.ua"), F.when(own % 2 == 0, "print").otherwise("page"), F.col("source"))
    return t("documents").select("doc_id", T.choose_summary(F.col("source"), given, meta, F.col("text")).alias("summary"), teaser.alias("teaser"))


@query(rf"SELECT doc_id, md5({_key('text')}) AS key_md5, regexp_matches(text, '^\s*\p{{Lu}}[^:]{{2,99}}:') AS person_intro, doc_id % 2 = 0 AS dated FROM documents")
def line_kinds(t):
    """What a text is compared by, whether it introduces a person, whether it holds a Ukrainian date."""
    said = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " від 5  Січня 2024, ").otherwise(" 5 січня 20245"))
    return t("documents").select("doc_id", F.md5(T.title_key(F.col("text"))).alias("key_md5"), T.is_person_intro(F.col("text")).alias("person_intro"), T.has_ua_date(said).alias("dated"))


@query(rf"""WITH g AS (SELECT doc_id, {_key('source')} AS key, {_lines("chr(10) || '**' || source || '**.' || chr(10) || '12 січня 2024 року' || chr(10) || 'Ivan P.: said' || chr(10) || text")} AS lines FROM documents)
SELECT doc_id, {_stripped("lines", "key")} AS body FROM g""")
def preamble_stripped(t):
    head = F.concat(F.lit("\n**"), "source", F.lit("**.\n12 січня 2024 року\nIvan P.: said\n"), "text")
    return t("documents").select("doc_id", T.strip_preamble(head, F.col("source")).alias("body"))


@query(f"SELECT doc_id, {_TIDY.format('text')} AS review FROM (SELECT *, {_WS} AS ws FROM documents)")
def review_lines(t):
    return t("documents").select("doc_id", T.clean_review(F.col("text")).alias("review"))


@query(rf"SELECT doc_id, trim(array_to_string(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), chr(10)), {_WS}) AS body FROM documents")
def leading_title(t):
    """A title as a heading behind an introduction, said again below it: all of that goes."""
    made = F.concat(F.lit("Intro\n\n## **"), "source", F.lit("**\n\n"), "source", F.lit("\n\n"), "text")
    return t("documents").select("doc_id", T.drop_leading_title(made, F.upper("source")).alias("body"))


@query(f"SELECT doc_id, array_to_string(list_filter([trim(text, {_WS}), trim(lang, {_WS}), CASE WHEN doc_id % 2 = 0 THEN source END], lambda b: b <> ''), chr(10) || chr(10)) AS post FROM documents")
def post_blocks(t):
    return t("documents").select("doc_id", T.join_blocks(F.col("text"), F.lit(" "), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("post"))


@query(rf"""WITH b AS (SELECT doc_id, trim(array_to_string(regexp_split_to_array(text, '\n'), chr(10) || chr(10)), {_WS}) AS whole FROM documents),
c AS (SELECT *, substr(whole, 1, 4000) AS cut FROM b), p AS (SELECT *, strpos(reverse(cut), chr(10) || chr(10)) AS gap, strpos(reverse(cut), ' ') AS space FROM c)
SELECT doc_id, nullif(CASE WHEN length(whole) <= 4000 THEN whole WHEN gap > 0 AND length(cut) - gap - 1 > 2000 THEN trim(substr(cut, 1, length(cut) - gap - 1), {_WS})
 WHEN space > 0 THEN trim(substr(cut, 1, length(cut) - space), {_WS}) ELSE cut END, '') AS body FROM p""")
def capped_article(t):
    """Lines as blocks, cut at the last blank line past 2,000 of 4,000 characters, else at the last space."""
    return t("documents").select("doc_id", T.cap_blocks(F.split("text", "\n")).alias("body"))


_SHORT = [names[-1] for _, names in sorted(D.MONTHS.items())]


@query(f"""SELECT event_id, {_KYIV.format("date_trunc('minute', ts)")} AS named, {_KYIV.format("date_trunc('minute', ts)")} AS dotted, {_KYIV.format("date_trunc('day', ts)")} AS by_day, date_trunc('second', ts) AS zoned FROM events""")
def date_forms(t):
    """Short months, dotted dates with a time, ISO days of Kyiv, ISO times with an offset."""
    ts, now = F.col("ts"), F.lit(NOW).cast("timestamp")
    named = F.concat(_text(F.dayofmonth(ts)), F.lit(" "), F.get(F.array(*map(F.lit, _SHORT)), F.month(ts) - 1), F.lit(". "), _text(F.year(ts)), F.date_format(ts, " HH:mm"))
    zoned = F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+0200'")
    forms = {"named": D.parse_ukrainian(named, now), "dotted": D.parse_ukrainian(F.date_format(ts, "d.MM.yyyy, HH:mm"), now), "by_day": D.coerce(F.date_format(ts, "yyyy-MM-dd"), now), "zoned": D.coerce(zoned, now)}
    return t("events").select("event_id", *[c.alias(k) for k, c in forms.items()])


_PROMO = f"'{T.PROMO_MD}'"
# no document holds a section's label, so the whole text is the long post; what is made of it starts with its title and ends with the promo line
ORACLES["draft_body"] = rf"""WITH o AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, {_WS} AS ws FROM documents),
g AS (SELECT *, {_key("title")} AS key, trim(text, ws) AS untagged, nullif({_TIDY.format("text")}, '') AS long, CASE WHEN trim(title, ws) = '' THEN '' ELSE '**' || trim(title, ws) || '**' END AS head,
 trim('**' || title || '**' || chr(10) || text || chr(10) || chr(10) || {_PROMO}, ws) AS whole FROM o),
r AS (SELECT *, CASE WHEN head <> '' AND starts_with(whole, head) THEN regexp_replace(substr(whole, length(head) + 1), '^[\n ]+', '') ELSE whole END AS rest FROM g),
l AS (SELECT *, {_lines("coalesce(long, untagged)")} AS first_lines, {_lines(f"rtrim(substr(rest, 1, length(rest) - length({_PROMO})), ws)")} AS second_lines FROM r),
c AS (SELECT *, {_stripped("first_lines", "key")} AS core, {_stripped("second_lines", "key")} AS again FROM l)
SELECT doc_id, trim(coalesce(nullif(trim(core, ws), ''), untagged) || chr(10) || chr(10) || {_PROMO}, ws) AS body_md,
trim(array_to_string(list_filter([head, again, {_PROMO}], lambda p: p <> ''), chr(10) || chr(10)), ws) AS rebuilt FROM c"""


@query(r"""SELECT page_id, up, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || array_to_string(list_transform(range(1, 13 - least(up, 12)), lambda i: 'd' || i), '/') || CASE WHEN up < 12 THEN '/' ELSE '' END || 'p' || page_id AS link
FROM pages, range(0, 15) r(up)""")
def reference_steps(t):
    """A link 0 to 14 levels up from a page 12 levels deep, on the host of each page."""
    base = F.concat(F.lit("https://"), U.part(F.col("url"), 2), F.lit("/" + "/".join(f"d{i}" for i in range(1, 13)) + "/page.html?x#y"))
    rows = t("pages").select("page_id", base.alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("up"))
    link = F.concat(F.repeat(F.lit("../"), F.col("up").cast("int")), F.lit("./p"), F.col("page_id").cast("string"))
    return rows.select("page_id", "up", U.absolute(link, F.col("base")).alias("link"))


def _last(x: str, what: str) -> str:
    """Zero-based place of the last `what`, null if there is none."""
    return f"CASE WHEN strpos({x}, {what}) > 0 THEN length({x}) - strpos(reverse({x}), {what}) END"


def _fit(source: str, limit: str, most: int) -> str:
    """SELECT of `source` (doc_id, own, least) with the review trimmed to `limit`, rendered, and what is over `most`."""
    ends = [(f"'{e}'", 1, 0.4) for e in T.SENTENCE_ENDS] + [("chr(10)", 0, 0.3), ("' '", 0, 0.0)]
    kept = ", ".join(f"CASE WHEN {_last('cut', e)} >= floor(most_kept * {least}::DOUBLE) THEN nullif(trim(substr(cut, 1, {_last('cut', e)} + {more}), {_WS}), '') END" for e, more, least in ends)
    line = rf"CASE WHEN starts_with(l, '- ') THEN '• ' || trim(substr(l, 3), {_WS}) WHEN regexp_matches(l, '^\d+[.)]\s+') THEN regexp_replace(l, '^(\d+)[.)]\s+', '\1. ') ELSE l END"
    return rf"""SELECT * EXCLUDE (cut, best, kept), least + length(shown) + CASE WHEN shown = '' THEN 0 ELSE 2 END - {most} AS over FROM (
SELECT *, array_to_string(list_transform(string_split(kept, chr(10)), lambda l: {line}), chr(10)) AS shown FROM (
SELECT *, CASE WHEN length(own) <= most_kept THEN own WHEN best = '' OR regexp_matches(best, '[.!?…]$') THEN best ELSE best || '…' END AS kept FROM (
SELECT *, rtrim(coalesce({kept}, cut), '-•') AS best FROM (SELECT *, rtrim(substr(own, 1, most_kept), {_WS}) AS cut FROM (SELECT *, {limit} AS most_kept FROM ({source}))))))"""


def _plain_preview(most: int) -> str:
    """A trimmed text is at most the ellipsis over, so that a second trial fits."""
    first = _fit("SELECT doc_id, own, least FROM r", f"{most} - least - 2", most)
    again = _fit(f"SELECT doc_id, own, least, most_kept - greatest(over, 0) AS rest FROM ({first})", "rest", most)
    return f"SELECT doc_id, shown FROM ({again})"


_AROUND = len(f"читати далі>>#a #b{P.PROMO_TEXT}") + 6


def _shown(x: str) -> str:
    tail = f'</a>\n\n#a #b\n\n<a href="{P.PROMO_URL}"><b>{P.PROMO_TEXT}</b></a>'.replace("\n", "' || chr(10) || '")
    return f"'<b>Документ ' || doc_id || '</b>' || chr(10) || chr(10) || CASE WHEN {x} = '' THEN '' ELSE {x} || chr(10) || chr(10) END || '<a href=\"https://example.org/' || doc_id || '\">читати далі>>{tail}'"


@query(f"""WITH d AS (SELECT doc_id, 'Документ ' || doc_id AS title, translate(coalesce(text, ''), '*_`[]&<>#', '') AS text, {_WS} AS ws FROM documents),
l AS (SELECT doc_id, {_key("title")} AS key, {_lines(_TIDY.format("text"))} AS lines, length(title) + {_AROUND} AS least FROM d),
r AS (SELECT doc_id, {_stripped("lines", "key")} AS own, least FROM l)
SELECT doc_id, {_shown("a.shown")} AS with_image, {_shown("b.shown")} AS without_image FROM ({_plain_preview(P.WITH_IMAGE)}) a JOIN ({_plain_preview(P.WITHOUT_IMAGE)}) b USING (doc_id)""")
def preview_plain(t):
    """Previews of whole texts without inline marks: cleaned, trimmed until they fit, bullets and numbers rendered."""
    own = F.col("doc_id").cast("string")
    docs = t("documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "*_`[]&<>#", "").alias("text"))
    shown = P.with_variants(docs, F.concat(F.lit("Документ "), own), F.col("text"), F.concat(F.lit("https://example.org/"), own), F.lit("#a #b"))
    return shown.select("doc_id", "with_image", "without_image")
