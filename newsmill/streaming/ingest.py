"""Ingest as a stream: landed entries, one micro-batch a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators import relational as R
from ..plans import ingest
from ..sources.versions import Kind, Tables

#: Folders that the known URLs are dealt to.
BUCKETS = 256
ENTRIES = "source string, pos int, link string, title string, summary string, published timestamp"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as they land in a folder of JSON lines."""
    return spark.readStream.schema(ENTRIES).json(folder)


def first_of_each(entries: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each URL once within the lateness; what is older than the watermark is dropped with its state."""
    own = entries.withColumn("url", U.canonical(F.col("link")))
    return own.withWatermark("published", lateness).dropDuplicatesWithinWatermark(["url"])


def kinds() -> dict[str, Kind]:
    """The stream's tables; `urls` is its memory of what it knows, by a bucket of the URL's hash."""
    return {"articles": Kind(R.ARTICLES), "statuses": Kind("source string, link string, status string, batch long", None), "urls": Kind("url string, id long, bucket int", None, "bucket")}


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def known_urls(tables: Tables, asked: DataFrame, buckets: int, state: dict | None = None) -> DataFrame:
    """(url, id) of the buckets in which the links of asked(link), or their canonical or print forms, would be: no other is read."""
    url = U.canonical(F.col("link"))
    forms = asked.where("link IS NOT NULL").select(F.explode(F.array_compact(F.array(F.col("link"), url, U.canonical(url), U.tax_print(url)))).alias("url"))
    wanted = [r[0] for r in forms.select(bucket_of(F.col("url"), buckets).alias("b")).distinct().collect()]  # as many as there are buckets at most
    return tables.read("urls", state).where(F.col("bucket").isin(wanted)).select("url", "id")


def run(entries: DataFrame, pages: str, root: str, checkpoint: str, now: str, buckets: int = BUCKETS, compact_after: int = 48) -> StreamingQuery:
    """Every landed entry once: appends new articles, their URLs and the statuses in one version, then stops. A scheduler calls it
    each half hour.

    What is known is looked up by bucket, so a batch's reading follows its own entries, not the articles of all time. A batch
    that broke off has no version and runs again as new; one that has is not run twice. `buckets` must stay as it was. Each
    batch adds a file a bucket at most; every `compact_after` batches the URLs are written anew.
    """
    spark = entries.sparkSession
    tables = Tables(spark, root, kinds())

    def cycle(batch: DataFrame, number: int) -> None:
        if tables.done(number):
            return
        at, change = F.lit(now).cast("timestamp"), tables.change(number)
        known = known_urls(tables, batch, buckets, change.before)
        made, found = ingest.cycle(batch, spark.read.parquet(pages), known, at)
        # pages are parsed once: both the numbering and the tables read what is written here
        kept = f"{root}/_made/{number}"
        made.write.mode("overwrite").parquet(kept)
        made = spark.read.schema(made.schema).parquet(kept)
        rows = change.append("articles", R.numbered(made, change.last("articles"), "published_at", "url", bucket=F.date_trunc("hour", "published_at")))
        change.append("urls", rows.select("url", "id", bucket_of(F.col("url"), buckets).alias("bucket")).repartition("bucket"))
        change.append("statuses", found.withColumn("batch", F.lit(number)))
        change.commit()
        if number % compact_after == compact_after - 1:
            tables.compact("urls")

    return entries.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
