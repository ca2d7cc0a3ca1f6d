"""Dedup and ordering rules of the feed (W1-W7, W16, A22 use, P10, P20, U1, U2, U4, U5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.keys import canonical_feed_key, text_or_empty
from pricetide.functions.text import title_key
from pricetide.functions.times import parse_iso
from pricetide.operators import scale

# The policy filter.
BLINDED_SOURCE = "beta"
BLINDED_PHRASE = "블라인드 처리된 글"


def is_excluded(
    source: Column, title: Column, blocked_source: str = BLINDED_SOURCE, phrase: str = BLINDED_PHRASE
) -> Column:
    """P10: a post its board has blinded."""
    return (F.lower(text_or_empty(source)) == blocked_source) & title_key(title).contains(phrase)


def require_fields(df: DataFrame, *cols: str) -> DataFrame:
    """P20: rows with all the named fields filled."""
    for c in cols:
        df = df.where(text_or_empty(F.col(c)) != "")
    return df


def with_list_pos(items: DataFrame, array_col: str, file_order: str) -> DataFrame:
    """Explode an item list keeping its order as ``pos`` (file order, then index in the file)."""
    return items.select("*", F.posexplode(array_col).alias("_idx", "item")).withColumn(
        "pos", F.struct(F.col(file_order).alias("file"), F.col("_idx").alias("idx"))).drop("_idx", array_col)


def dedup_feed(items: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """First row per (source, title), then last row per sync key, in input order."""
    first = scale.keep_one(items, ["source", title_key(F.col("title"))], F.col(pos).asc())
    return scale.keep_one(first, [key], F.col(pos).desc())


def existing_score(updated: Column) -> list[Column]:
    """W2, W3 order: active rows first, then rows with a picture, then the newest."""
    pictured = F.coalesce(F.nullif(F.trim("img"), F.lit("")), F.lit("")) != ""
    return [
        F.col("deleted_at").isNull().desc(), pictured.desc(),
        F.coalesce(updated, F.timestamp_seconds(F.lit(0))).desc(),
    ]


def _updated(df: DataFrame) -> Column:
    present = [c for c in ("updated_at", "registered_at", "created_at") if c in df.columns]
    return F.coalesce(*[F.col(c) for c in present])


def pick_existing(existing: DataFrame, key: str = "key", pos: str = "id") -> DataFrame:
    """Best stored row per key; equal scores go to the later row."""
    kept = require_fields(existing, "source", "source_link")
    return scale.keep_one(kept, [key], *existing_score(_updated(existing)), F.col(pos).desc())


def duplicate_deletes(existing: DataFrame, sources: list[str], key: str = "key", pos: str = "id") -> DataFrame:
    """Active rows beside a better row of the same key; equal scores keep the earlier row.

    The keepers are one row per key; the others follow by an anti-join on the unique row id, so a key
    with very many copies is never gathered.
    """
    active = require_fields(existing, "source", "source_link").where(
        F.col("deleted_at").isNull() & F.col("source").isin(sources))
    best = scale.keep_one(active, [key], *existing_score(_updated(existing)), F.col(pos).asc())
    return active.join(best.select(pos), pos, "left_anti")


def dedup_read(items: DataFrame, rules=None, pos: str = "pos") -> DataFrame:
    """Per canonical key a row with a picture beats one without, then the newest, then the later."""
    extra = {} if rules is None else {"rules": rules}
    key = canonical_feed_key(F.col("source"), F.col("source_post_id"), F.col("source_link"), **extra)
    pictured = F.coalesce(F.nullif(F.trim("img"), F.lit("")), F.lit("")) != ""
    when = F.coalesce(_updated(items), F.timestamp_seconds(F.lit(0)))
    return scale.keep_one(items, [key], pictured.desc(), when.desc(), F.col(pos).desc())


def dedup_response(items: DataFrame, pos: str = "pos") -> DataFrame:
    """First row per link, else per ``id:date``."""
    key = F.when(text_or_empty(F.col("source_link")) != "", F.col("source_link")).otherwise(
        F.concat_ws(":", F.col("id").cast("string"), F.coalesce(F.col("date").cast("string"), F.lit(""))))
    return scale.keep_one(items, [key], F.col(pos).asc())


def dedup_title(items: DataFrame, pos: str = "pos") -> DataFrame:
    """First row per collapsed lower-case title; untitled rows all stay."""
    key = title_key(F.col("title"))
    titled = scale.keep_one(items.where(key != ""), [key], F.col(pos).asc())
    return titled.unionByName(items.where(key == ""))


def dedup_merge_nonempty(local: DataFrame, remote: DataFrame, key: str, cols: list[str], pos: str = "pos") -> DataFrame:
    """Per key the last non-empty value of every field; remote rows come after local ones.

    ``max_by`` keeps one value per field and key in the map-side buffer.
    """
    both = local.withColumn("_gen", F.lit(0)).unionByName(
        remote.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_gen", pos)
    aggs = []
    for c in cols:
        filled = text_or_empty(F.col(c)) != ""
        aggs.append(F.max_by(F.col(c), F.when(filled, order)).alias(c))
    return both.where(text_or_empty(F.col(key)) != "").groupBy(key).agg(*aggs)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds; fields a feed lacks are null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def union_user_and_feed(user: DataFrame, feed: DataFrame, pos: str = "pos") -> DataFrame:
    """User rows before feed rows, then W5."""
    both = user.withColumn("_origin", F.lit(0)).unionByName(
        feed.withColumn("_origin", F.lit(1)), allowMissingColumns=True)
    ordered = both.withColumn("_order", F.struct("_origin", pos))
    return dedup_response(ordered, "_order").drop("_origin", "_order")


def key_intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """U4: keys both sides hold."""
    return left.select(*keys).intersect(right.select(*keys))


def distinct_terms(df: DataFrame, col: str) -> DataFrame:
    """Distinct elements of an array column."""
    return df.select(F.explode(F.array_distinct(F.col(col))).alias("term")).distinct()


def iso_or_null(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps from text columns, unparseable ones null."""
    for c in cols:
        df = df.withColumn(c, parse_iso(F.col(c)))
    return df
