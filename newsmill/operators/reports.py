"""Counts and reports of an ingest cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("created", "duplicate", "skipped_level1", "skipped_no_body", "error", "skipped_old", "skipped_no_date")


def status_counts(items: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, n): one row a known status, 0 where none came."""
    known = items.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return known.join(items.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def source_report(items: DataFrame, sources: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, label, created, available), by lower-cased label: sources(key, label, ok) with items(key, status) counted.

    A source is unavailable if any of its reads was, or if failed(key) names it; failed keys that are no source are added.
    """
    made = items.groupBy("key").agg(F.count_if(F.col("status") == "created").alias("created"))
    own = sources.groupBy("key").agg(F.min("label").alias("label"), F.bool_and("ok").alias("ok"))
    both = own.join(failed.select("key").distinct().withColumn("down", F.lit(True)), "key", "full").join(made, "key", "left")
    return both.select("key", F.coalesce("label", "key").alias("label"), F.coalesce("created", F.lit(0).cast("long")).alias("created"), (F.coalesce("ok", F.lit(True)) & F.col("down").isNull()).alias("available")).orderBy(F.lower("label"), "key")


def failed_sources(failed: DataFrame) -> DataFrame:
    """One row: the failed keys, each once, sorted."""
    return failed.agg(F.array_sort(F.collect_set("key")).alias("failed_sources"))


def report_text(counts: DataFrame, report: DataFrame, header: str = "Оновлення завершено") -> DataFrame:
    """One row, the report as text: header, a line of counts (without skipped_no_body) and a line a source."""
    shown = [s for s in STATUSES if s != "skipped_no_body"]
    stats = counts.agg(F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.coalesce(F.max(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("string")) for s in shown]).alias("line"))
    mark = F.when(F.col("available"), "✅").otherwise("❌")
    each = report.select(F.lit(1).alias("part"), F.lower("label").alias("place"), F.col("key"), F.concat(mark, F.lit(" "), F.col("label"), F.lit(": "), F.col("created").cast("string")).alias("line"))
    both = stats.select(F.lit(0).alias("part"), F.lit("").alias("place"), F.lit("").alias("key"), "line").unionByName(each)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "key", "line"))), lambda r: r["line"])
    return both.agg(F.concat_ws("\n", F.lit(header), F.array_join(lines, "\n")).alias("report"))


def cleanup_counts(bodies: DataFrame, previews: DataFrame) -> DataFrame:
    """One row: drafts with a new body, previews inserted or updated."""
    a = bodies.select(F.col("changed").alias("a"), F.lit(False).alias("b"))
    b = previews.select(F.lit(False).alias("a"), (F.col("change") != "keep").alias("b"))
    return a.unionByName(b).agg(F.count_if("a").alias("drafts_updated"), F.count_if("b").alias("previews_refreshed"))
