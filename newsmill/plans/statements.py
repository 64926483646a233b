"""Queries over users, drafts, previews and the outbox, added to the catalog, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import reports
from . import catalog
from .catalog import ORACLES, query

_KINDS = "(VALUES ('with_image'), ('without_image')) k(kind)"


def _both_kinds(text):
    return F.explode(F.create_map(*[x for k in R.KINDS for x in (F.lit(k), text(k))])).alias("kind", "text_md")


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def item_lookup(t):
    """One row by its key: the filter reaches the scan."""
    return R.by_id(t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus"), 7)


@query("SELECT o_orderkey AS id, o_orderkey = 7 OR o_orderstatus = 'F' AS approved FROM orders")
def flag_update(t):
    return R.flagged(t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("approved")), 7, "approved")


@query("""SELECT DISTINCT o_custkey AS id, 'known' AS username FROM orders
UNION ALL SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def user_register(t):
    """Customers who have ordered are known; every customer comes twice."""
    known = t("orders").select(F.col("o_custkey").alias("id"), F.lit("known").alias("username")).distinct()
    came = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return R.register(known, came.unionByName(came))


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey IN (3, 7, 12)")
def admin_users(t):
    return R.admins(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username")), " 3, x,7 ,-1,,12,1.5")


@query(f"""SELECT doc_id AS draft_id, kind, 'old' AS text_md FROM labels, {_KINDS} WHERE toxic = 1
UNION ALL SELECT d.doc_id, kind, kind || ' ' || d.source FROM documents d, {_KINDS} WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)
UNION ALL SELECT doc_id, 'with_image', 'old' FROM labels l WHERE coalesce(toxic, 0) <> 1 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def previews_ensured(t):
    """Labelled documents have a preview with an image, toxic ones both kinds."""
    labels = t("labels").select(F.col("doc_id").alias("draft_id"), "toxic", F.lit("old").alias("text_md"))
    old = labels.withColumn("kind", F.explode(F.when(F.col("toxic") == 1, F.array(*map(F.lit, R.KINDS))).otherwise(F.array(F.lit(R.KINDS[0])))))
    computed = t("documents").select(F.col("doc_id").alias("draft_id"), *[F.concat(F.lit(f"{k} "), "source").alias(k) for k in R.KINDS])
    return R.ensure_previews(old, computed)


_REBUILT = "CASE lang WHEN 'en' THEN text WHEN 'de' THEN '' WHEN 'fr' THEN NULL ELSE source || text END"


def _bodies(t):
    return R.refresh_bodies(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body_md"), F.expr(_REBUILT).alias("rebuilt")), F.col("rebuilt"))


@query(f"""WITH r AS (SELECT doc_id, text, {_REBUILT} AS rebuilt FROM documents), c AS (SELECT *, coalesce(rebuilt <> '' AND rebuilt <> coalesce(text, ''), false) AS changed FROM r)
SELECT doc_id AS id, changed, md5(CASE WHEN changed THEN rebuilt ELSE text END) AS body_md5 FROM c""")
def bodies_refreshed(t):
    return _bodies(t).select("id", "changed", F.md5("body_md").alias("body_md5"))


@query(f"SELECT (SELECT count(*) FILTER (changed) FROM ({ORACLES['bodies_refreshed']})) AS drafts_updated, (SELECT count(*) FILTER (change <> 'keep') FROM ({ORACLES['preview_upsert']})) AS previews_refreshed")
def cleanup_counts(t):
    return reports.cleanup_counts(_bodies(t), catalog.preview_upsert(t))


@query("SELECT 'previews' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'drafts', count(*) FROM labels UNION ALL SELECT 'articles', count(*) FROM documents")
def tables_reset(t):
    """What a reset of the three tables reports, and that nothing is left of them."""
    previews = t("conversations")
    gone, (a, b, c) = R.reset(previews, t("labels"), t("documents"))
    left = F.lit(a.count() + b.count() + c.count()).cast("long")
    return previews.sparkSession.createDataFrame(list(gone.items()), "name string, n long").select("name", (F.col("n") + left).alias("n"))


_LEVEL1 = "CASE source WHEN 'src1' THEN false WHEN 'src2' THEN NULL ELSE true END"


@query(f"SELECT doc_id, coalesce({_LEVEL1}, false) AS by_command, true AS by_button FROM documents")
def publish_policy(t):
    level1 = F.expr(_LEVEL1)
    return t("documents").select("doc_id", R.may_publish(level1).alias("by_command"), R.may_publish(level1, True).alias("by_button"))


_ASKED = "CASE doc_id % 9 WHEN 0 THEN 'with' WHEN 1 THEN ' Image ' WHEN 2 THEN 'PHOTO' WHEN 3 THEN 'without' WHEN 4 THEN 'Text' WHEN 5 THEN 'no_image' WHEN 6 THEN '' WHEN 7 THEN 'other' END"


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 9 IN (3, 4, 5) THEN 'without_image' ELSE 'with_image' END AS kind FROM documents")
def publish_variant(t):
    """Every alias in turn, every other post without an image."""
    return t("documents").select("doc_id", R.publish_kind(F.when(F.col("doc_id") % 2 == 0, "").otherwise("i"), F.expr(_ASKED)).alias("kind"))


@query(f"""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END AS image_url FROM documents WHERE lang = 'en' AND coalesce({_LEVEL1}, false))
SELECT doc_id AS draft_id, CASE image_url WHEN '' THEN 'without_image' ELSE 'with_image' END AS kind, image_url, kind || ' ' || doc_id AS text_md FROM o""")
def outbox(t):
    """Approved drafts of trusted articles with their picture and the preview that goes with it."""
    docs, own = t("documents"), F.col("doc_id")
    drafts = docs.select(own.alias("id"), own.alias("article_id"), F.when(F.col("lang") == "en", True).when(F.col("lang") == "de", False).alias("approved"), F.when(own % 2 == 0, " d ").alias("image_url"))
    articles = docs.select(own.alias("id"), F.expr(_LEVEL1).alias("level1_ok"), F.when(own % 3 == 0, "a").otherwise(" ").alias("image_url"))
    previews = docs.select(own.alias("draft_id"), _both_kinds(lambda k: F.concat(F.lit(f"{k} "), own.cast("string"))))
    return R.outbox(drafts, articles, previews)


_SHOWN = [s for s in reports.STATUSES if s != "skipped_no_body"]
_COUNTS = " || ', ' || ".join(f"'{s}=' || (SELECT count(*) FROM events WHERE ({catalog._STATUS}) = '{s}')" for s in _SHOWN)


@query(f"""WITH s AS (SELECT source, '✅' AS mark, count(*) FILTER (lang = 'en') AS n FROM documents GROUP BY source)
SELECT 'Оновлення завершено' || chr(10) || {_COUNTS} || chr(10) || string_agg(CASE WHEN source = 'src1' THEN '❌' ELSE mark END || ' ' || source || ': ' || n, chr(10) ORDER BY lower(source), source) AS report FROM s""")
def report_text(t):
    docs = t("documents")
    counts = reports.status_counts(t("events").select(F.expr(catalog._STATUS).alias("status")))
    items = docs.select(F.col("source").alias("key"), F.when(F.col("lang") == "en", "created").otherwise("duplicate").alias("status"))
    sources = docs.select(F.col("source").alias("key"), F.col("source").alias("label"), (F.col("source") != "src1").alias("ok"))
    return reports.report_text(counts, reports.source_report(items, sources, docs.sparkSession.createDataFrame([], "key string")))
