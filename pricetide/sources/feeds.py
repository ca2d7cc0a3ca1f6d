"""Feed files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.keys import (
    BOARD_RULES, canonical_link, extract_post_id, first_non_blank, legacy_key, text_or_empty,
)
from pricetide.functions.times import as_ts, kst_date, kst_label, parse_iso
from pricetide.schemas import FEED_FILE

# Texts for fields a feed leaves empty.
DEFAULTS = {"title": "제목 없음", "category": "기타", "area": "게시판", "dist": "기타", "source": "feed"}


def read_feed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per feed file with its path; unreadable files give null fields, missing ones are skipped."""
    return (
        spark.read.schema(FEED_FILE).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("ignoreMissingFiles", True).json(paths)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def feed_items(files: DataFrame) -> DataFrame:
    """Items of all files in file and list order; a file without ``items`` gives ``grouped.today``."""
    listed = F.coalesce(
        F.when(F.size("items") > 0, F.col("items")), F.col("grouped.today"), F.array().cast(files.schema["items"].dataType))
    rows = files.select("file", "sourceKey", F.posexplode(listed).alias("idx", "item"))
    return rows.select(F.struct("file", "idx").alias("pos"), "sourceKey", "item.*")


def read_feed_json(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, per-file metadata)."""
    files = read_feed_files(spark, paths)
    return feed_items(files), files.drop("items", "grouped")


def feed_protection_flags(meta: DataFrame) -> DataFrame:
    """Per source whether deletes are withheld (stale or partial) and whether it is stale."""
    stale = F.coalesce("staleFallback", F.lit(False))
    partial = F.coalesce("partialSnapshot", F.lit(False))
    return meta.where(text_or_empty(F.col("sourceKey")) != "").groupBy(F.trim("sourceKey").alias("source")).agg(
        F.bool_or(stale | partial).alias("delete_protected"), F.bool_or(stale).alias("stale"))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def normalize_item(items: DataFrame, rules=BOARD_RULES) -> DataFrame:
    """Feed item to stored row, with its keys."""
    # Step by step: each column builds on the one before, and inlining them would multiply the code.
    staged = items.withColumn("_src", first_non_blank(F.col("source"), F.lit(DEFAULTS["source"])))
    staged = staged.withColumn("_pid", extract_post_id(F.col("_src"), F.col("sourceLink"), rules))
    staged = staged.withColumn("_url", canonical_link(F.col("_src"), F.col("sourceLink"), rules, F.col("_pid")))
    source, link = F.col("_src"), F.col("_url")
    digest = F.concat(F.lit("link:"), F.substring(F.sha1(link), 1, 12))
    post_id = F.when(F.col("_pid") != "", F.col("_pid")).when(link != "", digest).otherwise(F.lit(""))
    texts = {"desc": "desc", "price": "price", "img": "img", "detail_img": "detailImg", "date": "date"}
    out = staged.select(
        "pos", source.alias("source"), post_id.alias("source_post_id"), link.alias("source_link"),
        first_non_blank(F.col("buyLink"), link).alias("buy_link"),
        *[first_non_blank(F.col(c), F.lit(DEFAULTS[c])).alias(c) for c in ("title", "category", "area", "dist")],
        *[text_or_empty(F.col(c)).alias(name) for name, c in texts.items()],
        first_non_blank(F.col("time"), F.col("date")).alias("time"),
        *[_count(c).alias(c) for c in ("likes", "dislikes", "views", "comments")],
        _count("commentSignalScore").alias("comment_signal_score"),
        _count("positiveCommentSignals").alias("positive_comment_signals"),
        _count("negativeCommentSignals").alias("negative_comment_signals"),
        parse_iso(F.col("registeredAt")).alias("registered_at"),
    )
    key = F.when(
        F.col("source_post_id") != "", F.concat_ws("::", "source", F.lit("post"), "source_post_id")
    ).otherwise(F.concat_ws("::", "source", F.lit("link"), "source_link"))
    return out.withColumn("key", key).withColumn("legacy_key", legacy_key(F.col("source"), F.col("source_link")))


def item_from_row(rows: DataFrame) -> DataFrame:
    """S5, other way: stored row to feed item with the feed's field names and defaults."""
    day = first_non_blank(F.col("date"), F.substring(kst_label(F.col("registered_at")), 1, 10))
    category = first_non_blank(F.col("category"), F.lit(DEFAULTS["category"]))
    return rows.select(
        F.col("id").cast("string").alias("id"), text_or_empty(F.col("title")).alias("title"),
        first_non_blank(F.col("area"), F.lit(DEFAULTS["area"])).alias("area"), category.alias("dist"),
        day.alias("time"), F.date_format("registered_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("registeredAt"),
        text_or_empty(F.col("price")).alias("price"),
        *[_count(c).alias(c) for c in ("likes", "dislikes", "views", "comments")],
        _count("comment_signal_score").alias("commentSignalScore"),
        _count("positive_comment_signals").alias("positiveCommentSignals"),
        _count("negative_comment_signals").alias("negativeCommentSignals"),
        category.alias("category"), text_or_empty(F.col("desc")).alias("desc"), text_or_empty(F.col("img")).alias("img"),
        text_or_empty(F.col("buy_link")).alias("buyLink"), text_or_empty(F.col("source_link")).alias("sourceLink"),
        F.col("source"), day.alias("date"))


def feed_envelope(items: DataFrame, now: str | Column, range_hours: int = 48) -> DataFrame:
    """Per source the envelope fields beside every item, one item per row.

    The item list is not gathered into one document: each source becomes a directory of JSON lines, so
    a feed of any size is written by many tasks. The counts come from one small aggregate.
    """
    n = as_ts(now)
    today = kst_date(n)
    day = kst_date(F.col("registered_at"))
    part = F.when(day == today, "today").when(day == F.date_sub(today, 1), "yesterday").otherwise("older")
    return items.withColumn("feed_day", part).withColumn("source_key", F.col("source")).withColumn(
        "generated_at", n).withColumn("since", n - F.expr(f"INTERVAL {range_hours} HOURS"))


def feed_metadata(items: DataFrame, now: str | Column, range_hours: int = 48, expired: DataFrame | None = None) -> DataFrame:
    """The envelope itself, one row per source: times and day labels, item counts by day, and the post ids seen in this run
    that have expired (``expired``: source, source_post_id)."""
    n = as_ts(now)
    rows = feed_envelope(items, now, range_hours)
    counts = rows.groupBy("source_key").agg(
        F.count_if(F.col("feed_day") == "today").alias("today_count"), F.count_if(F.col("feed_day") == "yesterday").alias("yesterday_count"),
        F.count(F.lit(1)).alias("total_count"))
    out = counts.select(
        "source_key", n.alias("generated_at"), F.lit(range_hours).alias("range_hours"), (n - F.expr(f"INTERVAL {range_hours} HOURS")).alias("since"),
        kst_date(n).cast("string").alias("today"), F.date_sub(kst_date(n), 1).cast("string").alias("yesterday"),
        "today_count", "yesterday_count", "total_count")
    none = F.array().cast("array<string>")
    if expired is None:
        return out.withColumn("expired_post_ids", none)
    gone = expired.select(F.col("source").alias("source_key"), F.col("source_post_id").cast("string").alias("_id")).distinct()
    listed = gone.groupBy("source_key").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    return out.join(listed, "source_key", "left").withColumn("expired_post_ids", F.coalesce("_ids", none)).drop("_ids")


def write_feed_snapshot(items: DataFrame, path: str, now: str | Column, expired: DataFrame | None = None) -> None:
    """Replace the written sources' partitions only; the commit protocol publishes them at job end. The envelope goes to
    ``<path>_meta``, one JSON line per source."""
    feed_metadata(items, now, expired=expired).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "source_key").json(f"{path}_meta")
    (
        feed_envelope(items, now).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_key").json(path)
    )
