"""One ingest cycle: entries to new articles and the status of each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import relational as R
from ..sources import feeds

FRESH = "INTERVAL 7 DAYS"
BANK_HOST, TAX_HOST = "bank.gov.ua", "tax.gov.ua"


def date_status(published: Column, now: Column) -> Column:
    """skipped_no_date, skipped_old (strictly older than seven days) or null."""
    return F.when(published.isNull(), "skipped_no_date").when(published < now - F.expr(FRESH), "skipped_old")


def title_or_url(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), url)


def extracted(pages: DataFrame) -> DataFrame:
    """pages(primary_html, print_html, url, title, summary, domain, ...) with body, image_url and text; each page is parsed once."""
    kept = [F.col(c) for c in pages.columns if c not in ("primary_html", "print_html")]
    page = pages.withColumn("p", H.parse_page("primary_html")).withColumn("q", H.parse_page("print_html"))
    p, q, printed = F.col("p"), F.col("q"), F.col("print_html").isNotNull()
    # what the rules below use more than once is a column first, so that it is worked out once
    found = page.select(
        *kept, "p", "primary_html", printed.alias("printed"), F.coalesce(F.when(printed, H.article_text(q)), H.article_text(p)).alias("article"), H.bank_body(p).alias("bank"),
        H.generic_body(p).alias("generic"), H.image(p, F.col("url")).alias("found"), F.coalesce(H.meta_description(p), H.meta_description(q)).alias("described"),
    )
    is_bank, is_tax = F.endswith("domain", F.lit(BANK_HOST)), F.endswith("domain", F.lit(TAX_HOST))
    given = T.initial_summary(F.col("domain"), F.when(F.col("printed"), "print").otherwise("page"), F.col("summary"))
    told = T.choose_summary(F.col("title"), given, F.col("described"), F.col("article"))
    reliable = H.is_reliable(F.col("bank"), F.col("primary_html"))
    chosen = found.select(*kept, "p", "found", "primary_html", "generic", "bank", reliable.alias("sure"), told.alias("told"))
    body = F.when(is_bank, F.coalesce(F.when(F.col("sure"), F.col("bank")), F.col("generic"))).when(is_tax, F.coalesce("told", T.normalize_paragraphs(F.col("summary")))).otherwise(F.col("told"))
    made = chosen.select(*kept, "primary_html", body.alias("body"), F.when(is_tax, H.better_image(p, F.col("url"), F.col("found"))).otherwise(F.col("found")).alias("image_url"))
    return made.select(*kept, "body", "image_url", H.is_reliable(F.col("body"), F.col("primary_html")).alias("reliable"))


def cycle(entries: DataFrame, pages: DataFrame, articles: DataFrame, now: Column, check_level1: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new articles, (source, link, status)) of entries(source, pos, link, title, summary, published).

    Checks go in this order: date, age, link (those without one are not counted), trusted host, known URL, body. Of
    entries with one URL in a cycle the first by source and place is taken, the others are duplicates.
    """
    dated = entries.withColumn("status", date_status(F.col("published"), now)).where(F.col("status").isNotNull() | F.col("link").isNotNull())
    own = dated.withColumn("url", U.canonical(F.col("link"))).withColumn("domain", U.host(F.col("url")))
    if check_level1:
        own = own.withColumn("status", F.coalesce("status", F.when(~U.trusted(F.col("domain")), "skipped_level1")))
    again = F.row_number().over(Window.partitionBy("url", F.col("status").isNull()).orderBy("source", "pos")) > 1
    own = own.withColumn("status", F.coalesce("status", F.when(again, "duplicate"))).withColumn("item", F.struct("source", "pos"))
    live = R.probe(own.where("status IS NULL"), articles)
    live = live.withColumn("status", R.probe_status(F.col("n_known"))).drop("n_known")
    fresh = extracted(feeds.article_pages(live.where("status IS NULL"), pages))
    fresh = fresh.withColumn("status", F.when(F.col("body").isNull(), "skipped_no_body").when(F.endswith("domain", F.lit(BANK_HOST)) & ~F.col("reliable"), "skipped_no_body").otherwise("created"))
    made = fresh.where("status = 'created'").select(
        title_or_url(F.col("title"), F.col("url")).alias("title"), "url", F.col("domain").alias("source_domain"), F.col("published").alias("published_at"), F.col("body").alias("summary"),
        "image_url", U.trusted(F.col("domain")).alias("level1_ok"), F.lit(None).cast("string").alias("topics"), now.alias("created_at"), F.lit(False).alias("taken"),
    )
    keep = ("source", "link", "status")
    return made, own.where("status IS NOT NULL").select(*keep).unionByName(live.where("status IS NOT NULL").select(*keep)).unionByName(fresh.select(*keep))
