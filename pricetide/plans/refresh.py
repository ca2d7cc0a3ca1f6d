"""The batch refresh as one job (R9 in batch): read, normalise, dedup, plan, write, snapshot, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.keys import BOARD_RULES, FEED_SOURCES
from pricetide.functions.times import as_ts, is_future_dated, is_older_than
from pricetide.operators import dedup as D
from pricetide.operators import snapshots as N
from pricetide.operators import sync as Y
from pricetide.sources import feeds, tables

PAYLOAD = [
    "source", "source_post_id", "source_link", "buy_link", "title", "desc", "price", "category", "img", "detail_img", "area",
    "dist", "time", "likes", "dislikes", "views", "comments", "comment_signal_score", "positive_comment_signals",
    "negative_comment_signals", "date", "registered_at",
]

# The stored table's partitions: days do not depend on the session's zone.
PARTITIONS = ["source", "unix_seconds(registered_at) div 86400"]


@dataclass
class Refreshed:
    version: int
    plan: DataFrame
    snapshot: DataFrame
    alert_candidates: DataFrame


def window_rows(rows: DataFrame, now: str) -> DataFrame:
    """Rows neither expired nor dated ahead."""
    none = F.lit(None).cast("timestamp")
    n = as_ts(now)
    return rows.where(
        ~is_older_than(F.col("registered_at"), none, n - F.expr(f"INTERVAL {Y.PRUNE_HOURS} HOURS"))
        & ~is_future_dated(F.col("registered_at"), none, n + F.expr(f"INTERVAL {Y.FUTURE_SKEW_MINUTES} MINUTES")))


def refresh(
    spark: SparkSession, feed_paths: str | list[str], table_root: str, now: str,
    sources: list[str] = FEED_SOURCES, rules=BOARD_RULES,
) -> Refreshed:
    """One run over the feed files against the newest table version; publishes the next version.

    Partitions (source and day) without a changed row are carried over as they are.

    ``tables.VersionConflict`` where another writer has published meanwhile: run again.

    The stored table needs ``key``, ``id``, the payload columns, ``updated_at`` and ``deleted_at``.
    """
    items, meta = feeds.read_feed_json(spark, feed_paths)
    flags = feeds.feed_protection_flags(meta)
    # One row per feed source: the list of expected sources bounds what is collected.
    flagged = flags.where(F.col("source").isin(sources)).limit(len(sources)).collect()
    protected = [r["source"] for r in flagged if r["delete_protected"]]
    stale = [r["source"] for r in flagged if r["stale"]]

    kept = D.require_fields(items, "sourceLink").where(~D.is_excluded(F.col("source"), F.col("title")))
    incoming = window_rows(D.dedup_feed(feeds.normalize_item(kept, rules)), now).withColumn("id", F.sha1("key"))
    incoming = Y.scale.cut_lineage(incoming)

    base = tables.current_version(spark, table_root)
    stored = tables.read_current(spark, table_root)
    existing = D.pick_existing(stored)
    plan = Y.scale.cut_lineage(Y.plan_sync(incoming, existing, now, sources, protected))
    extra = Y.delete_plan_union([
        ("duplicate", D.duplicate_deletes(stored, sources)), ("expired", Y.prune_deletes(stored, now, sources)),
        ("future", Y.future_deletes(stored, now, sources)),
        ("policy", stored.where(F.col("deleted_at").isNull() & D.is_excluded(F.col("source"), F.col("title")))),
    ])
    extra = Y.scale.cut_lineage(extra)
    touched, carried = tables.split(spark, table_root, base, PARTITIONS, lambda rows: Y.affected_rows(rows, plan, extra))
    written = Y.soft_delete(Y.apply_plan(touched, incoming, plan, now, PAYLOAD), extra, now)
    version = tables.publish(Y.purge_soft_deleted(written), table_root, PARTITIONS, base=base, carried=carried)

    fresh = tables.read_current(spark, table_root)
    observed = incoming.where(~F.col("source").isin(stale)) if stale else incoming
    population = fresh.where(F.col("deleted_at").isNull()).join(
        Y.scale.broadcast_checked(observed.select("source").distinct()), "source", "left_semi")
    snapshot = N.temperature_snapshot(window_rows(population.where(F.col("registered_at").isNotNull()), now), now, sources)
    return Refreshed(version, plan, snapshot, Y.push_candidates(plan))
