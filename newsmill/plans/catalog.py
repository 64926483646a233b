"""Queries by name, each with the DuckDB statement that must give the same rows.

statements.py, rules.py and sites.py add theirs. Where a rule works on text that SQL handles otherwise (whole HTML trees,
rendered previews), the query has no statement and the tests hold it against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import preview as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import relational as R
from ..operators import reports
from ..sources import listing
from . import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _drafts(t) -> DataFrame:
    """labels as drafts of documents, approved where toxic."""
    return t("labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("article_id"), (F.col("toxic") == 1).alias("approved"))


def _articles(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


@query("""SELECT l.doc_id AS draft_id, d.doc_id AS article_id, d.text AS title, substr(d.text, 1, 80) || CASE WHEN length(d.text) > 80 THEN '…' ELSE '' END AS shown_title
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE NOT coalesce(l.toxic = 1, false) ORDER BY 1 DESC LIMIT 5""")
def moderation_queue(t):
    return R.queue(_drafts(t), _articles(t))


@query("""SELECT d.doc_id AS draft_id, d.doc_id AS article_id, d.text AS title, substr(d.text, 1, 80) || CASE WHEN length(d.text) > 80 THEN '…' ELSE '' END AS shown_title
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(l.toxic = 1, false) ORDER BY 1 DESC LIMIT 5""")
def moderation_queue_unlabelled(t):
    drafts = t("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("article_id")).join(_drafts(t).select("id", "approved"), "id", "left")
    return R.queue(drafts, _articles(t))


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false) ORDER BY 1 DESC LIMIT 20")
def latest_items(t):
    return R.latest(t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", (F.col("o_orderstatus") == "F").alias("taken")), None, True).drop("taken")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedup_keep_first(t):
    # by digest: partial minima and 32 characters a text cross the shuffle, not the texts
    return t("documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_md5")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_vs_known(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def known_only(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_semi")


@query("""WITH n AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT doc_id, n - 1 AS n_known, CASE WHEN n - 1 = 1 THEN 'duplicate' WHEN n - 1 > 1 THEN 'error' END AS status FROM documents JOIN n USING (text)""")
def duplicate_probe_status(t):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    counts = docs.groupBy("digest").agg((F.count("*") - 1).alias("n_known"))
    return docs.join(counts, "digest").select("doc_id", "n_known", R.probe_status(F.col("n_known")).alias("status"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def url_host(t):
    return t("pages").select("page_id", U.host(F.col("url")).alias("host"))


_SITES = ("site1.example", "site2.example", "site3.example", "example.org", "example.com")


@query("WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, host FROM h WHERE " + " OR ".join(f"ends_with(host, '{s}')" for s in _SITES))
def url_whitelist(t):
    own = t("pages").select("page_id", U.host(F.col("url")).alias("host"))
    return own.where(U.trusted(F.col("host"), _SITES))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=tg_channel&utm_medium=post&utm_campaign=tax_watch' AS link FROM pages")
def url_utm(t):
    return t("pages").select("page_id", U.with_utm(F.col("url")).alias("link"))


@query("""WITH made AS (SELECT page_id, 'https://tax.gov.ua/media-tsentr/novini/' || (page_id + 1000) || '.html?x=1#y' AS url FROM pages)
SELECT page_id, 'https://tax.gov.ua/media-tsentr/novini/print-' || (page_id + 1000) || '.html' AS print_url, 'https://tax.gov.ua/media-tsentr/novini/' || (page_id + 1000) || '.html' AS own_url FROM made""")
def url_print_and_canonical(t):
    url = F.concat(F.lit("https://tax.gov.ua/media-tsentr/novini/"), (F.col("page_id") + 1000).cast("string"), F.lit(".html?x=1#y"))
    return t("pages").select("page_id", U.tax_print(url).alias("print_url"), U.canonical(url).alias("own_url"))


@query("SELECT page_id, url FROM pages")
def url_unwrap(t):
    wrapped = F.concat(F.lit("https://news.google.com/rss?oc=5&url="), F.url_encode("url"))
    return t("pages").select("page_id", U.unwrap(wrapped).alias("url"))


@query(r"""SELECT doc_id, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)), '') AS body FROM documents""")
def normalize_paragraphs(t):
    return t("documents").select("doc_id", T.normalize_paragraphs(F.col("text")).alias("body"))


_NAMES = ", ".join("('{}', {})".format(n, len(said)) for n, said in sorted(html5.items()))


@query(rf"""WITH n AS (SELECT map(list(name), list(size)) AS sizes FROM (VALUES {_NAMES}) v(name, size)),
p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&') AS parts FROM pages),
r AS (SELECT page_id, length(parts[1]) AS before, list_transform(parts[2:], lambda x: {{'part': x, 'r': regexp_extract(x, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)', 1)}}) AS found FROM p),
o AS (SELECT page_id, before, list_transform(found, lambda f: {{'part': f.part, 'r': CASE WHEN f.r LIKE '#%' OR map_contains(sizes, f.r) THEN f.r ELSE regexp_extract(f.r, '{T._OLD}', 1) END}}) AS found, sizes FROM r, n)
SELECT page_id, (before + coalesce(list_sum(list_transform(found, lambda f: length(f.part) - length(f.r) + CASE WHEN map_contains(sizes, f.r) THEN sizes[f.r] ELSE 1 END)), 0))::INT AS visible FROM o""")
def visible_length(t):
    return t("pages").select("page_id", T.visible_length(F.col("html")).alias("visible"))


_RF = "(length(cut) - strpos(reverse(cut), '{0}'))"
_END = " ".join(f"WHEN strpos(cut, '{e}') > 0 AND {_RF.format(e)} >= 80 THEN trim(substr(cut, 1, {_RF.format(e)} + 1), ws)" for e in T.SENTENCE_ENDS)
_LINE, _GAP = _RF.format("' || chr(10) || '"), _RF.format(" ")


@query(rf"""WITH o AS (SELECT doc_id, ' ' || chr(9) || chr(10) || chr(13) AS ws, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS own FROM documents),
c AS (SELECT *, rtrim(substr(own, 1, 200), ws) AS cut FROM o),
b AS (SELECT *, rtrim(coalesce(CASE {_END} END,
 CASE WHEN strpos(cut, chr(10)) > 0 AND (length(cut) - strpos(reverse(cut), chr(10))) >= 60 THEN nullif(trim(substr(cut, 1, length(cut) - strpos(reverse(cut), chr(10))), ws), '') END,
 CASE WHEN strpos(cut, ' ') > 0 THEN nullif(trim(substr(cut, 1, {_GAP}), ws), '') END, cut), '-•') AS best FROM c)
SELECT doc_id, CASE WHEN length(own) <= 200 THEN own WHEN best = '' THEN '' WHEN regexp_matches(best, '[.!?…]$') THEN best ELSE best || '…' END AS trimmed FROM b""")
def smart_trim(t):
    return t("documents").select("doc_id", T.smart_trim(F.col("text"), 200).alias("trimmed"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS attribute FROM documents")
def html_escape(t):
    return t("documents").select("doc_id", T.escape_html(F.col("text")).alias("escaped"), T.escape_attribute(F.col("text")).alias("attribute"))


@query("SELECT doc_id, substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END AS shown FROM documents")
def title_ellipsis(t):
    return t("documents").select("doc_id", T.ellipsis(F.col("text")).alias("shown"))


@query("SELECT doc_id, substr(text, 1, 3800) AS rewritten FROM documents")
def rewrite_fallback(t):
    return t("documents").select("doc_id", T.rewrite_fallback(F.col("text")).alias("rewritten"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events")
def json_field(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.k", "bigint").alias("k_number"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'created' WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'skipped_level1' WHEN 'error' THEN 'error' ELSE 'skipped_no_body' END"


@query(f"""WITH e AS (SELECT {_STATUS} AS status FROM events), s AS (SELECT unnest({list(reports.STATUSES)}) AS status)
SELECT s.status, count(e.status) AS n FROM s LEFT JOIN e ON e.status = s.status GROUP BY s.status""")
def status_counts(t):
    return reports.status_counts(t("events").select(F.expr(_STATUS).alias("status")))


@query("""WITH s AS (SELECT source AS key, bool_and(n_chars < 20000) AS ok, count(*) FILTER (lang = 'en') AS created FROM documents GROUP BY source)
SELECT key, key AS label, created, ok AND key <> 'src1' AS available FROM s UNION ALL SELECT 'gone', 'gone', 0, false""")
def source_report(t):
    docs = t("documents")
    items = docs.select(F.col("source").alias("key"), F.when(F.col("lang") == "en", "created").otherwise("duplicate").alias("status"))
    sources = docs.select(F.col("source").alias("key"), F.col("source").alias("label"), (F.col("n_chars") < 20000).alias("ok"))
    failed = docs.sparkSession.createDataFrame([("src1",), ("gone",)], "key string")
    return reports.source_report(items, sources, failed)


@query("SELECT list_sort(list_distinct(list(source))) AS failed_sources FROM documents WHERE lang = 'fr'")
def failed_sources(t):
    return reports.failed_sources(t("documents").where("lang = 'fr'").select(F.col("source").alias("key")))


@query(f"SELECT event_id, CASE WHEN ts IS NULL THEN 'skipped_no_date' WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS THEN 'skipped_old' END AS status FROM events")
def stale_filter(t):
    return t("events").select("event_id", ingest.date_status(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("status"))


@query("""WITH o AS (SELECT doc_id AS draft_id, 'with_image' AS kind, CASE WHEN toxic = 1 THEN 'old' ELSE cast(doc_id AS VARCHAR) END AS old FROM labels),
n AS (SELECT doc_id AS draft_id, 'with_image' AS kind, cast(doc_id AS VARCHAR) AS new FROM documents WHERE lang = 'en')
SELECT draft_id, kind, CASE WHEN new IS NULL OR old = new THEN coalesce(old, new) ELSE new END AS text_md,
CASE WHEN new IS NULL THEN 'keep' WHEN old IS NULL THEN 'insert' WHEN old = new THEN 'keep' ELSE 'update' END AS change FROM o FULL JOIN n USING (draft_id, kind)""")
def preview_upsert(t):
    own = F.col("doc_id").cast("string")
    old = t("labels").select(F.col("doc_id").alias("draft_id"), F.lit("with_image").alias("kind"), F.when(F.col("toxic") == 1, "old").otherwise(own).alias("text_md"))
    new = t("documents").where("lang = 'en'").select(F.col("doc_id").alias("draft_id"), F.lit("with_image").alias("kind"), own.alias("text_md"))
    return R.refresh_previews(old, new)


@query("SELECT l.doc_id AS draft_id, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def drafts_with_articles(t):
    both = R.drafts_with_articles(_drafts(t), t("documents").select(F.col("doc_id").alias("id"), "lang"))
    return both.select(F.col("d.id").alias("draft_id"), "a.lang")


@query("SELECT conv_id AS draft_id, max(text) FILTER (turn = 0) AS first_text, max(text) FILTER (turn = 1) AS second_text FROM conversations GROUP BY conv_id")
def previews_by_kind(t):
    rows = t("conversations").select(F.col("conv_id").alias("draft_id"), F.col("turn").cast("string").alias("kind"), F.col("text").alias("text_md"), F.col("turn").alias("id"))
    kinds = R.previews_by_kind(rows)
    return kinds.select("draft_id", F.try_element_at("kinds", F.lit("0")).alias("first_text"), F.try_element_at("kinds", F.lit("1")).alias("second_text"))


@query("SELECT doc_id, CASE WHEN trim(lang) <> 'xx' AND trim(lang) <> '' AND doc_id % 2 = 0 THEN trim(lang) ELSE coalesce(nullif(trim(source), ''), '') END AS image FROM documents")
def resolved_image(t):
    return t("documents").select("doc_id", R.picture(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang")), F.col("source")).alias("image"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::INT AS whole FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(t):
    """An extension: the reference has no grouping sets."""
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").cast("int").alias("whole"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 3")
def rank_in_group(t):
    """An extension."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", rn.alias("rn")).where("rn <= 3")


@query("SELECT lang FROM documents UNION SELECT event_type FROM events")
def union_distinct(t):
    """An extension."""
    return t("documents").select("lang").union(t("events").select("event_type")).distinct()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window_counts(t):
    """An extension."""
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize(t):
    """An extension."""
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query()
def page_article(t):
    """What the pages' articles say, their pictures and descriptions."""
    own = t("pages").select("page_id", "url", "html", H.parse_page("html").alias("page"))
    page = F.col("page")
    return own.select("page_id", H.article_text(page).alias("body"), H.generic_body(page).alias("generic_body"), H.bank_body(page).alias("bank_body"), H.image(page, F.col("url")).alias("image"), H.meta_description(page).alias("description"), H.is_reliable(H.generic_body(page), F.col("html")).alias("reliable"))


@query()
def regulator_article(t):
    own = t("pages").select("page_id", H.parse_page("html").alias("page"))
    return own.select("page_id", H.regulator_article(F.col("page"), H.said(F.col("page"), H.find(F.col("page.nodes"), "h1"))).alias("body"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(a, 'href="(/[^"]*)"', 1) AS link, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS label FROM a""")
def page_links(t):
    """Links of the pages as absolute ones; those of the tables all start at the root."""
    own = t("pages").select("page_id", "url", H.parse_page("html").alias("page"))
    links = own.select("page_id", "url", F.explode(F.transform(F.filter("page.nodes", lambda n: n["tag"] == "a"), lambda n: F.struct(n["attrs"].alias("attrs"), H.said(F.col("page"), n).alias("text")))).alias("n"))
    return links.select("page_id", U.absolute(F.coalesce(H.attr(F.col("n"), "href"), F.lit("")), F.col("url")).alias("link"), F.col("n.text").alias("label"))


@query()
def preview_html(t):
    docs = t("documents").select("doc_id", "text")
    shown = P.with_variants(docs, F.substring_index("text", "\n", 1), F.col("text"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")), F.lit("#a #b"))
    return shown.select("doc_id", "with_image", "without_image")


_TIDY = r"trim(regexp_replace(array_to_string(list_transform(regexp_split_to_array({0}, '\r\n|[\n\r\x0b\x0c]'), lambda l: trim(l, ws)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ws)"


@query(rf"""WITH c AS (SELECT conv_id, turn, text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws FROM conversations)
SELECT conv_id, turn, {_TIDY.format("text")} AS long, {_TIDY.format("text || chr(10) || 'Теги: #a, #b #a'")} AS short, '#a #b' AS tags FROM c""")
def post_sections(t):
    raw = F.concat(F.lit("Довгий пост: "), F.col("text"), F.lit("\nКороткий пост:\n"), F.col("text"), F.lit("\nТеги: #a, #b #a"))
    own = t("conversations").select("conv_id", "turn", T.post_sections(raw).alias("s"), T.tags_of(raw).alias("tags"))
    return own.select("conv_id", "turn", "s.long", "s.short", "tags")


@query()
def draft_body(t):
    title = F.substring_index("text", "\n", 1)
    return t("documents").select("doc_id", T.draft_body(F.col("text"), title).alias("body_md"), T.rebuild_body(F.concat(F.lit("**"), title, F.lit("**\n"), F.col("text"), F.lit("\n\n" + T.PROMO_MD)), title).alias("rebuilt"))


@query("""WITH RECURSIVE l AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
p AS (SELECT conv_id, k, 0 AS message, text FROM l WHERE k = 1 UNION ALL
 SELECT l.conv_id, l.k, CASE WHEN length(p.text) + 1 + length(l.text) <= 200 THEN p.message ELSE p.message + 1 END,
  CASE WHEN length(p.text) + 1 + length(l.text) <= 200 THEN p.text || chr(10) || l.text ELSE l.text END FROM p JOIN l ON l.conv_id = p.conv_id AND l.k = p.k + 1)
SELECT conv_id, message::INT AS message, arg_max(text, k) AS text FROM p GROUP BY conv_id, message""")
def line_packing(t):
    """A conversation's lines in messages of 200 characters at most, so that most take several."""
    lines = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("lines"))
    return lines.select("conv_id", F.posexplode(T.pack_lines(F.col("lines"), 200)).alias("message", "text"))


_KYIV = "timezone('UTC', timezone('Europe/Kyiv', {0}))"


@query(f"""WITH s AS (SELECT event_id, ts, {list(T.MONTHS_GENITIVE)} AS months FROM events)
SELECT event_id, day(ts) || ' ' || months[month(ts)] || ' ' || year(ts) || ' року о ' || strftime(ts, '%H:%M') AS said, {_KYIV.format("date_trunc('minute', ts)")} AS published FROM s""")
def ukrainian_dates(t):
    months = F.array(*[F.lit(m) for m in T.MONTHS_GENITIVE])
    said = F.concat(F.dayofmonth("ts").cast("string"), F.lit(" "), F.get(months, F.month("ts") - 1), F.lit(" "), F.year("ts").cast("string"), F.lit(" року о "), F.date_format("ts", "HH:mm"))
    return t("events").select("event_id", said.alias("said"), D.parse_ukrainian(said, F.lit(NOW).cast("timestamp")).alias("published"))


_NEWS = "https://tax.gov.ua/media-tsentr/novini/"


@query(f"""WITH p AS (SELECT page_id, url, '{_NEWS}' || (page_id + 1000) || '.html' AS own, '{_NEWS}print-' || (page_id + 1000) || '.html' AS print FROM pages),
known AS (SELECT own AS url FROM p WHERE page_id % 5 IN (0, 1) UNION ALL SELECT print FROM p WHERE page_id % 5 IN (1, 2) UNION ALL SELECT own || '?x=' || page_id FROM p WHERE page_id % 5 = 3),
n AS (SELECT page_id, count(known.url) AS n_known FROM p LEFT JOIN known ON known.url IN (own, print, own || '?x=' || page_id) GROUP BY page_id)
SELECT page_id, n_known, CASE WHEN n_known = 1 THEN 'duplicate' WHEN n_known > 1 THEN 'error' END AS status FROM n""")
def duplicate_probe(t):
    """Known articles under a link's own form, its canonical form and its print page."""
    pages = t("pages").select("page_id", F.concat(F.lit(_NEWS), (F.col("page_id") + 1000).cast("string"), F.lit(".html")).alias("own"))
    asked = F.concat("own", F.lit("?x="), F.col("page_id").cast("string"))
    rest = F.col("page_id") % 5
    forms = F.array(F.when(rest.isin(0, 1), F.col("own")), F.when(rest.isin(1, 2), F.replace(F.col("own"), F.lit("novini/"), F.lit("novini/print-"))), F.when(rest == 3, asked))
    known = pages.select("page_id", F.posexplode(F.array_compact(forms)).alias("k", "url")).select((F.col("page_id") * 3 + F.col("k")).alias("id"), "url")
    found = R.probe(pages.select(F.col("page_id").alias("item"), asked.alias("url")), known)
    return found.select(F.col("item").alias("page_id"), "n_known", R.probe_status(F.col("n_known")).alias("status"))


@query(f"""WITH e AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://elsewhere.example/' || page_id ELSE '{_NEWS}' || (page_id + 1000) || '.html' END AS link FROM pages)
SELECT page_id, link, CASE WHEN page_id % 5 = 0 THEN 'skipped_no_date' WHEN page_id % 7 = 0 THEN 'skipped_old' WHEN page_id % 4 = 0 THEN 'skipped_level1' WHEN page_id % 3 = 0 THEN 'duplicate'
 WHEN page_id % 2 = 0 THEN 'skipped_no_body' ELSE 'created' END AS status FROM e""")
def ingest_cycle(t):
    """A cycle over an entry a page: no date, old, untrusted, known, without a body, new."""
    page = F.col("page_id")
    link = F.when(page % 4 == 0, F.concat(F.lit("https://elsewhere.example/"), page.cast("string"))).otherwise(F.concat(F.lit(_NEWS), (page + 1000).cast("string"), F.lit(".html")))
    now = F.lit(NOW).cast("timestamp")
    published = F.when(page % 5 == 0, None).when(page % 7 == 0, now - F.expr("INTERVAL 10 DAYS")).otherwise(now - F.expr("INTERVAL 1 DAY"))
    own = t("pages").select("page_id", "html", link.alias("link"), published.alias("published"))
    entries = own.select(F.col("page_id").cast("string").alias("source"), F.lit(0).alias("pos"), "link", F.concat(F.lit("News "), page.cast("string")).alias("title"), F.when(page % 2 == 1, F.concat(F.lit("What was said "), page.cast("string"))).alias("summary"), "published")
    landed = own.select(F.col("link").alias("url"), "html", F.lit(404).alias("status"))
    articles = own.where("page_id % 3 = 0").select(F.col("page_id").alias("id"), F.col("link").alias("url"))
    _, statuses = ingest.cycle(entries, landed, articles, now)
    return statuses.select(F.col("source").cast("long").alias("page_id"), "link", "status")


@query(f"""SELECT page_id, 1 AS pos, 'Новина номер ' || page_id AS title, '{_NEWS}' || (page_id + 1000) || '.html' AS url, {_KYIV.format("TIMESTAMP '2024-01-15 10:20:00'")} AS published, 'Про що мова.' AS summary FROM pages
UNION ALL SELECT page_id, 0, 'Друга новина ' || page_id, '{_NEWS}' || (page_id + 5000) || '.html', {_KYIV.format("TIMESTAMP '2024-01-16 11:30:00'")}, 'Зі скрипта' FROM pages""")
def tax_listing(t):
    """A listing page for each page: an article in JSON-LD, which comes first, and a card in the markup."""
    number = lambda n: (F.col("page_id") + n).cast("string")
    ld = ['<script type="application/ld+json">{"@type": "NewsArticle", "headline": "Друга новина ', number(0), '", "url": "/media-tsentr/novini/', number(5000), '.html", "datePublished": "2024-01-16T11:30:00", "description": "Зі скрипта"}</script>']
    card = ['<div class="news-card"><a href="/media-tsentr/novini/', number(1000), '.html">Новина номер ', number(0), "</a><time>15.01.2024 10:20</time><p>Про що мова.</p></div>"]
    html = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in ("<html><body>", *ld, *card, "</body></html>")])
    return listing.items(t("pages").select("page_id", html.alias("html"), F.lit(NOW).cast("timestamp").alias("now")), listing.TAX)
