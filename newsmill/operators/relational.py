"""Statements over users, articles, drafts and previews, as DataFrames.

There is no row update in a folder of Parquet: what changes rows returns the new table, which a job writes to a new
folder before swapping it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

USERS = "id long, username string, first_name string, last_name string, language_code string"
ARTICLES = "id long, title string, url string, source_domain string, published_at timestamp, summary string, image_url string, level1_ok boolean, topics string, created_at timestamp, taken boolean"
DRAFTS = "id long, article_id long, body_md string, llm_raw_md string, sources_md string, tags string, image_url string, approved boolean, created_by long, created_at timestamp"
PREVIEWS = "id long, draft_id long, kind string, text_md string, created_at timestamp"
KINDS = ("with_image", "without_image")
QUEUE_ROWS = 5


def not_set(flag: Column) -> Column:
    """False or null."""
    return ~F.coalesce(flag, F.lit(False))


def by_id(rows: DataFrame, key: int, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key)


def queue(drafts: DataFrame, articles: DataFrame, rows: int = QUEUE_ROWS) -> DataFrame:
    """The newest drafts not yet approved, with their articles: (draft_id, article_id, title, shown_title)."""
    joined = drafts.where(not_set(F.col("approved"))).select(F.col("id").alias("draft_id"), "article_id").join(articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    return joined.select("draft_id", "article_id", "title", T.ellipsis(F.col("title")).alias("shown_title")).orderBy(F.desc("draft_id")).limit(rows)


def latest(articles: DataFrame, rows: int | None = None, fresh_only: bool = False) -> DataFrame:
    """The newest articles: 20, or as many as asked for, 1 to 100; only those not taken if so asked."""
    n = min(max(20 if rows is None else rows, 1), 100)
    return (articles.where(not_set(F.col("taken"))) if fresh_only else articles).orderBy(F.desc("id")).limit(n)


def probe(found: DataFrame, articles: DataFrame) -> DataFrame:
    """found(item, url, ...) with n_known, the known articles that its URL, its canonical form or its print page match."""
    urls = F.array_distinct(F.array_compact(F.array(F.col("url"), U.canonical(F.col("url")), U.tax_print(F.col("url")))))
    probes = found.select("item", F.explode(urls).alias("url")).join(articles.select("url", F.col("id").alias("known")), "url")
    counts = probes.groupBy("item").agg(F.countDistinct("known").alias("n_known"))
    return found.join(counts, "item", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0).cast("long")))


def probe_status(n_known: Column) -> Column:
    """null for a new item, duplicate for one match, error for more."""
    return F.when(n_known == 1, "duplicate").when(n_known > 1, "error")


def drafts_with_articles(drafts: DataFrame, articles: DataFrame) -> DataFrame:
    """All pairs; drafts whose article is gone are left out."""
    return drafts.alias("d").join(articles.alias("a"), F.col("d.article_id") == F.col("a.id"))


def previews_by_kind(previews: DataFrame) -> DataFrame:
    """(draft_id, kinds map<kind, text>); of several rows of one kind the newest id counts."""
    newest = previews.groupBy("draft_id", "kind").agg(F.max_by("text_md", "id").alias("text_md"))
    return newest.groupBy("draft_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "text_md")))).alias("kinds"))


def numbered(rows: DataFrame, after: int, *order: str, bucket: Column | None = None) -> DataFrame:
    """rows with ids that go on from `after` in the given total order.

    `bucket` grows with the order (the hour of a time, a range of ids); without one all rows are one bucket. Every bucket
    is sorted by itself; only the buckets' sizes meet in one task. rows is read twice and must not change between.
    """
    own = rows.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    sizes = own.groupBy(F.col("_bucket").alias("_of")).agg(F.count("*").alias("_n"))
    before = sizes.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    found = own.withColumn("_place", place).join(before, F.col("_bucket").eqNullSafe(F.col("_of")))
    return found.withColumn("id", F.lit(after) + F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_of", "_before")


def taken(articles: DataFrame, drafts: DataFrame) -> DataFrame:
    """articles, those with a draft marked as taken."""
    made = drafts.select(F.col("article_id").alias("_drafted")).distinct().withColumn("_made", F.lit(True))
    return articles.join(made, F.col("id") == F.col("_drafted"), "left").withColumn("taken", F.coalesce("_made", "taken")).select(*articles.columns)


def ensure_previews(previews: DataFrame, computed: DataFrame) -> DataFrame:
    """(draft_id, kind, text_md): where a draft lacks one of the two kinds both are taken from computed(draft_id, with_image, without_image)."""
    old = previews.select("draft_id", "kind", "text_md")
    whole = old.where(F.col("kind").isin(*KINDS)).groupBy("draft_id").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == len(KINDS)).select("draft_id")
    fresh = computed.join(whole, "draft_id", "left_anti").select("draft_id", F.explode(F.create_map(*[x for k in KINDS for x in (F.lit(k), F.col(k))])).alias("kind", "text_md"))
    return old.join(fresh.select("draft_id", "kind"), ["draft_id", "kind"], "left_anti").unionByName(fresh)


def refresh_previews(previews: DataFrame, computed: DataFrame) -> DataFrame:
    """(draft_id, kind, text_md, change): computed(draft_id, kind, text_md) over previews; change is insert, update or keep."""
    old = previews.select("draft_id", "kind", F.col("text_md").alias("old"))
    new = computed.select("draft_id", "kind", F.col("text_md").alias("new"))
    same = T.strip(F.coalesce("old", F.lit(""))) == T.strip(F.coalesce("new", F.lit("")))
    change = F.when(F.col("new").isNull(), "keep").when(F.col("old").isNull(), "insert").when(same, "keep").otherwise("update")
    both = old.join(new, ["draft_id", "kind"], "full")
    return both.select("draft_id", "kind", F.when(change == "keep", F.coalesce("old", "new")).otherwise(F.col("new")).alias("text_md"), change.alias("change"))


def refresh_bodies(drafts: DataFrame, rebuilt: Column) -> DataFrame:
    """drafts with the rebuilt body where it is not empty and differs, and `changed`."""
    changed = F.coalesce((rebuilt != "") & (rebuilt != F.coalesce("body_md", F.lit(""))), F.lit(False))
    return drafts.withColumn("changed", changed).withColumn("body_md", F.when(F.col("changed"), rebuilt).otherwise(F.col("body_md")))


def reset(previews: DataFrame, drafts: DataFrame, articles: DataFrame) -> tuple[dict[str, int], tuple[DataFrame, DataFrame, DataFrame]]:
    """(rows deleted by table, the three tables without rows)."""
    tables = {"previews": previews, "drafts": drafts, "articles": articles}
    return {k: t.count() for k, t in tables.items()}, tuple(t.limit(0) for t in tables.values())


def flagged(rows: DataFrame, key: int, flag: str, column: str = "id") -> DataFrame:
    return rows.withColumn(flag, F.when(F.col(column) == key, F.lit(True)).otherwise(F.col(flag)))


def register(users: DataFrame, new: DataFrame) -> DataFrame:
    """users and those of `new` that were not there, one each."""
    return users.unionByName(new.dropDuplicates(["id"]).join(users.select("id"), "id", "left_anti"))


def with_raw_text(drafts: DataFrame) -> DataFrame:
    """Older tables lack the raw text of the rewrite; it is null there."""
    return drafts if "llm_raw_md" in drafts.columns else drafts.withColumn("llm_raw_md", F.lit(None).cast("string"))


def picture(draft: Column, article: Column) -> Column:
    """The draft's own, else the article's, else empty."""
    return F.coalesce(T.non_blank(draft), T.non_blank(article), F.lit(""))


def publish_kind(image: Column, asked: Column) -> Column:
    """The preview to send: as asked for (by any of the aliases), with an image if there is one; never with one if there is none."""
    word = F.lower(T.strip(F.coalesce(asked, F.lit(""))))
    wanted = F.when(word.isin("with", "with_image", "image", "photo"), KINDS[0]).when(word.isin("without", "without_image", "noimage", "no_image", "text"), KINDS[1]).when(image != "", KINDS[0]).otherwise(KINDS[1])
    return F.when(image == "", KINDS[1]).otherwise(wanted)


def may_publish(level1_ok: Column, by_button: bool = False) -> Column:
    """Commands need a trusted source; the button does not ask."""
    return F.lit(True) if by_button else F.coalesce(level1_ok, F.lit(False))


def outbox(drafts: DataFrame, articles: DataFrame, previews: DataFrame, by_button: bool = False) -> DataFrame:
    """(draft_id, kind, image_url, text_md) to send for approved drafts."""
    own = drafts_with_articles(drafts.where(F.coalesce("approved", F.lit(False))), articles).where(may_publish(F.col("a.level1_ok"), by_button))
    own = own.select(F.col("d.id").alias("draft_id"), picture(F.col("d.image_url"), F.col("a.image_url")).alias("image_url"))
    own = own.withColumn("kind", publish_kind(F.col("image_url"), F.lit("")))
    return own.join(previews.select("draft_id", "kind", "text_md"), ["draft_id", "kind"]).select("draft_id", "kind", "image_url", "text_md")


def admins(users: DataFrame, ids: str) -> DataFrame:
    """The users whose ids a comma-separated list names; what is no number in it is ignored."""
    known = [int(x) for x in (p.strip() for p in ids.split(",")) if x.lstrip("-").isdigit()]
    return users.where(F.col("id").isin(known))
