"""From articles to drafts and previews, and the clean-up of older ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import preview as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import relational as R
from ..sources.versions import Kind, Tables

#: Articles numbered in one task.
ID_RANGE = 100_000


def upgraded_images(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """articles with image_url read again from their landed page where it is a preview or missing and the page is the tax service's."""
    own = articles.join(pages.select("url", "html"), "url", "left").withColumn("p", H.parse_page("html"))
    ours = F.endswith(F.coalesce("source_domain", F.lit("")), F.lit("tax.gov.ua")) & F.col("html").isNotNull()
    stale = F.col("image_url").isNull() | F.contains(F.lower("image_url"), F.lit("preview"))
    better = H.better_image(F.col("p"), F.col("url"), F.coalesce("image_url", H.image(F.col("p"), F.col("url"))))
    return own.withColumn("image_url", F.when(ours & stale, F.coalesce(better, F.col("image_url"))).otherwise(F.col("image_url"))).select(*articles.columns)


def make(articles: DataFrame, rewrites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, previews) of trusted articles; rewrites(article_id, raw) hold what the writer made, else the article's own
    text cut to length stands for it."""
    own = articles.where(R.may_publish(F.col("level1_ok"))).join(rewrites, articles["id"] == rewrites["article_id"], "left")
    payload = F.concat_ws("\n\n", "title", "summary", "url")
    raw = F.coalesce("raw", T.rewrite_fallback(payload))
    link = U.with_utm(F.coalesce(U.tax_canonical(F.col("url")), F.col("url")))
    drafts = own.select(
        F.col("id").alias("article_id"), "title", T.draft_body(raw, F.col("title")).alias("body_md"), raw.alias("llm_raw_md"),
        T.sources_line(F.col("source_domain"), link).alias("sources_md"), T.tags_of(raw).alias("tags"), "image_url", link.alias("link"),
    )
    shown = P.with_variants(drafts, F.col("title"), F.col("body_md"), F.col("link"), F.col("tags"))
    return drafts.drop("link"), by_kind(shown, "article_id")


def kinds() -> dict[str, Kind]:
    return {"articles": Kind(R.ARTICLES), "drafts": Kind(R.DRAFTS), "previews": Kind(R.PREVIEWS)}


def store(tables: Tables, rewrites: DataFrame, now: Column, by: int | None = None) -> int:
    """Drafts of the articles not yet taken, their previews, and the articles marked as taken, in one version; its number."""
    change = tables.change()
    articles = tables.read("articles", change.before)
    made, shown = make(articles.where(R.not_set(F.col("taken"))), rewrites)
    own = R.numbered(made, change.last("drafts"), "article_id", bucket=F.floor(F.col("article_id") / ID_RANGE))
    before = change.last("drafts")
    drafts = change.append("drafts", own.withColumns({"approved": F.lit(False), "created_by": F.lit(by).cast("long"), "created_at": now}))
    pairs = shown.join(drafts.select("article_id", F.col("id").alias("draft_id")), "article_id")
    # two previews a draft: their ids follow from the draft's
    place = (F.col("draft_id") - before - 1) * len(R.KINDS) + F.array_position(F.array(*map(F.lit, R.KINDS)), F.col("kind"))
    change.append("previews", pairs.withColumns({"id": F.lit(change.last("previews")) + place, "created_at": now}))
    change.update("articles", drafts.select(F.col("article_id").alias("id"), F.lit(True).alias("taken")), "taken")
    return change.commit()


def approve(tables: Tables, draft_id: int) -> int:
    """One row of changes, whatever the table's size."""
    change = tables.change()
    change.update("drafts", R.by_id(tables.read("drafts", change.before), draft_id).select("id", F.lit(True).alias("approved")), "approved")
    return change.commit()


def refresh(tables: Tables, now: Column) -> int:
    """The clean-up as a version: only bodies and previews that change are written, missing previews are added."""
    change = tables.change()
    drafts, articles, previews = (tables.read(n, change.before) for n in ("drafts", "articles", "previews"))
    bodies, shown = clean_up(drafts, articles, previews)
    change.update("drafts", bodies.where("changed").select("id", "body_md"), "body_md")
    newest = previews.groupBy("draft_id", "kind").agg(F.max("id").alias("id"))
    told = shown.where("change <> 'keep'").join(newest, ["draft_id", "kind"], "left")
    change.update("previews", told.where("change = 'update'").select("id", "text_md"), "text_md")
    added = told.where("change = 'insert'").select("draft_id", "kind", "text_md")
    change.append("previews", R.numbered(added, change.last("previews"), "draft_id", "kind", bucket=F.floor(F.col("draft_id") / ID_RANGE)).withColumn("created_at", now))
    return change.commit()


def reset(tables: Tables) -> dict[str, int]:
    """Empties previews, drafts and articles in one version; the rows each had."""
    change = tables.change()
    had = {name: tables.read(name, change.before).count() for name in ("previews", "drafts", "articles")}
    for name in had:
        change.replace(name, None)
    change.commit()
    return had


def by_kind(shown: DataFrame, key: str) -> DataFrame:
    """(key, kind, text_md), two rows a post."""
    return shown.select(key, F.explode(F.create_map(*[x for k in R.KINDS for x in (F.lit(k), F.col(k))])).alias("kind", "text_md"))


def rebuilt_body(raw: Column, body: Column, title: Column) -> Column:
    """From the raw rewrite where there is one, else from the body, its heading lines dropped."""
    long_post = T.strip_preamble(T.post_sections(raw)["long"], F.coalesce(title, F.lit("")))
    return F.coalesce(T.non_blank(long_post), T.rebuild_body(body, title))


def clean_up(drafts: DataFrame, articles: DataFrame, previews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts with rebuilt bodies and `changed`, previews with `change`); drafts whose article is gone are left out."""
    own = R.drafts_with_articles(drafts, articles).select("d.*", F.col("a.title").alias("_title"), F.col("a.url").alias("_url"))
    bodies = R.refresh_bodies(own, rebuilt_body(F.col("llm_raw_md"), F.col("body_md"), F.col("_title")))
    link = F.coalesce(U.first_markdown_link(F.col("sources_md")), U.tax_canonical(F.col("_url")), F.col("_url"), F.lit(""))
    shown = P.with_variants(bodies.select(F.col("id").alias("draft_id"), "_title", "body_md", link.alias("link"), "tags"), F.col("_title"), F.col("body_md"), F.col("link"), F.col("tags"))
    return bodies.drop("_title", "_url"), R.refresh_previews(previews, by_kind(shown, "draft_id"))
