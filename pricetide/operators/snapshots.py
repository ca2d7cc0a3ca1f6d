"""Per-source statistics over time (A1-A4, A19-A22, A28, J15, R6 batch twin, S10, S11, W12, W13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.scoring import MODEL_VERSION
from pricetide.functions.times import age_hours, as_ts, bucket_30min, is_future_dated, is_older_than, kst_date
from pricetide.operators import scale

# The snapshot statistics.
SNAPSHOT_METRICS = ["views", "comments", "likes", "dislikes", "comment_signal_score"]
SNAPSHOT_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
STATS = ["mean", "variance", "stddev", "min", *SNAPSHOT_PROBS, "max", "nonzero_rate"]
RETENTION_DAYS = 90


def _r4(col: Column) -> Column:
    return F.round(col, 4) + F.lit(0.0)


def summarize_numeric(df: DataFrame, metrics: list[Column | str], by: list[str]) -> DataFrame:
    """A1, A2: population statistics and exact quantiles per (by, metric), four places; null counts as 0.

    ``metrics`` are column names or aliased columns. Moments are combined map-side; quantiles come
    from value histograms.
    """
    named = [(m, F.coalesce(F.col(m).cast("double"), F.lit(0.0))) for m in metrics]
    long = df.select(
        *by,
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in named])).alias("m"),
    ).select(*by, "m.metric", "m.value")
    return summarize_long(long, [*by, "metric"])


def summarize_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """A1 for rows already in (keys, value) form."""
    value = F.col("value")
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        _r4(F.avg(value)).alias("mean"), _r4(F.var_pop(value)).alias("variance"),
        _r4(F.stddev_pop(value)).alias("stddev"), _r4(F.min(value)).alias("min"), _r4(F.max(value)).alias("max"),
        _r4(F.avg((value != 0).cast("double"))).alias("nonzero_rate"),
    )
    hist = scale.value_histogram(long, keys, "value")
    quantiles = scale.histogram_quantiles(hist, keys, "value", SNAPSHOT_PROBS)
    rounded = quantiles.select(*keys, *[_r4(F.col(p)).alias(p) for p in SNAPSHOT_PROBS])
    return moments.join(rounded, keys).select(*keys, "sample_count", *STATS)


def summarize_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A1 for rows in (keys, value, n) form: histograms that were counted elsewhere, each value once per key."""
    value, n = F.col("value"), F.col("n")
    moments = counts.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"), (F.sum(value * n) / F.sum("n")).alias("_mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.when(value != 0, n).otherwise(0)) / F.sum("n")).alias("nonzero_rate"))
    away = counts.join(moments.select(*keys, "_mean"), keys)
    spread = away.groupBy(*keys).agg((F.sum(n * F.pow(value - F.col("_mean"), 2)) / F.sum("n")).alias("variance"))
    quantiles = scale.histogram_quantiles(counts, keys, "value", SNAPSHOT_PROBS)
    whole = moments.join(spread, keys).join(quantiles, keys).withColumns({"mean": F.col("_mean"), "stddev": F.sqrt("variance")})
    return whole.select(*keys, "sample_count", *[_r4(F.col(name)).alias(name) for name in STATS])


def temperature_snapshot(rows: DataFrame, captured_at: str | Column, sources: list[str]) -> DataFrame:
    """A3 in long form: (source, captured_at, model_version, metric, statistics) of one capture.

    ``age_hours`` leaves out rows without a timestamp; the other metrics count them.
    """
    now = as_ts(captured_at)
    kept = rows.where(F.col("source").isin(sources))
    entries = [
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"))
        for m in SNAPSHOT_METRICS
    ]
    entries.append(F.struct(
        F.lit("age_hours").alias("metric"),
        F.when(F.col("registered_at").isNotNull(), age_hours(F.col("registered_at"), now)).alias("value")))
    long = kept.select("source", F.explode(F.array(*entries)).alias("m")).select("source", "m.metric", "m.value")
    return (
        summarize_long(long.where(F.col("value").isNotNull()), ["source", "metric"])
        .withColumn("captured_at", bucket_30min(now))
        .withColumn("model_version", F.lit(MODEL_VERSION))
    )


def snapshot_rows(long: DataFrame) -> DataFrame:
    """A3: one row per (source, captured_at) with ``metrics`` as map of metric to statistics."""
    entry = F.struct(F.col("metric"), F.struct(*[F.col(s) for s in STATS]).alias("stats"))
    return long.groupBy("source", "captured_at", "model_version").agg(
        F.max("sample_count").alias("sample_count"),
        F.map_from_entries(F.collect_list(entry)).alias("metrics"),  # at most one entry per metric
    )


def snapshot_series(rows: DataFrame, metrics: list[str], ts: str = "registered_at") -> DataFrame:
    """A3 per 30-minute bucket of the rows' own time: the history J15 and R6 work on."""
    return summarize_numeric(
        rows.withColumn("captured_at", bucket_30min(F.col(ts))), metrics, ["source", "captured_at"])


def snapshot_population(
    observed: DataFrame, existing: DataFrame, changed: DataFrame, deleted: DataFrame,
    now: str | Column, excluded: Column | None = None, back_hours: int = 48, skew_minutes: int = 10,
) -> DataFrame:
    """A4: active rows after a write: existing then changed (later wins per ``key``), observed sources
    only, without deleted ids, undated, expired, future or excluded rows."""
    n = as_ts(now)
    both = existing.withColumn("_gen", F.lit(0)).unionByName(
        changed.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    created = F.lit(None).cast("timestamp")
    cutoff = n - F.expr(f"INTERVAL {back_hours} HOURS")
    future = n + F.expr(f"INTERVAL {skew_minutes} MINUTES")
    keep = (
        F.col("deleted_at").isNull() & F.col("registered_at").isNotNull()
        & ~is_older_than(F.col("registered_at"), created, cutoff)
        & ~is_future_dated(F.col("registered_at"), created, future)
    )
    if excluded is not None:
        keep = keep & ~excluded
    live = both.where(keep).join(scale.broadcast_checked(observed.select("source").distinct()), "source", "left_semi")
    live = live.join(deleted.where(F.col("id").isNotNull()).select("id").distinct(), "id", "left_anti")
    return scale.keep_one(live, ["key"], F.col("_gen").desc(), F.col("pos").desc()).drop("_gen")


def upsert_snapshots(base: DataFrame, snaps: DataFrame) -> DataFrame:
    """Merge on (source, captured_at); a new capture replaces the stored one."""
    keys = ["source", "captured_at"]
    return base.join(snaps.select(*keys).distinct(), keys, "left_anti").unionByName(snaps)


def expire_snapshots(base: DataFrame, now: str | Column, days: int = RETENTION_DAYS) -> DataFrame:
    """At the midnight bucket, drop captures older than the retention (at least seven days)."""
    n = as_ts(now)
    bucket = bucket_30min(n)
    midnight = (F.hour(bucket) == 0) & (F.minute(bucket) == 0)
    return base.where(~midnight | (F.col("captured_at") >= n - F.expr(f"INTERVAL {max(7, days)} DAYS")))


def snapshot_trend(snapshots: DataFrame, metrics: list[str], gap_hours: int = 20) -> DataFrame:
    """Per source the snapshot count, the latest snapshot and the newest one at least
    ``gap_hours`` before it. Two aggregations that combine map-side; no ordered window over a source.
    """
    row = F.struct(F.col("captured_at"), *[F.col(m) for m in metrics])
    latest = snapshots.groupBy("source").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max_by(row, "captured_at").alias("latest"))
    latest = scale.broadcast_checked(latest)
    earlier = (
        snapshots.join(latest.select("source", F.col("latest.captured_at").alias("_at")), "source")
        .where(F.col("captured_at") <= F.col("_at") - F.expr(f"INTERVAL {gap_hours} HOURS"))
        .groupBy("source").agg(F.max_by(row, "captured_at").alias("previous"))
    )
    return latest.join(earlier, "source", "left")


def metric_delta(trend: DataFrame, metrics: list[str]) -> DataFrame:
    """Change of each metric since the previous snapshot; null before there is one."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(f"latest.{m}") - F.col(f"previous.{m}")).alias("delta"))
        for m in metrics
    ])
    return trend.select("source", F.explode(pairs).alias("p")).select("source", "p.metric", "p.delta")


def feed_health(items: DataFrame, meta: DataFrame, now: str | Column, stale_minutes: int = 180) -> DataFrame:
    """Item count, feed age and a label per expected source.

    ``meta`` has one row per source: (source, feed_exists, generated_at).
    """
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    age = F.floor((F.unix_micros(as_ts(now)) - F.unix_micros(F.col("generated_at"))) / F.lit(60_000_000))
    out = meta.join(counts, "source", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("bigint")))
    out = out.withColumn("age_minutes", age.cast("bigint"))
    label = (
        F.when(~F.coalesce(F.col("feed_exists"), F.lit(False)), "missing")
        .when(F.col("items") <= 0, "empty")
        .when(F.col("age_minutes").isNull(), "unknown")
        .when(F.col("age_minutes") > stale_minutes, "stale")
        .otherwise("ok")
    )
    return out.withColumn("label", label)


def latest_by_source(items: DataFrame) -> DataFrame:
    """Row count and newest update / registration per source."""
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.max("updated_at").alias("latest_updated_at"),
        F.max("registered_at").alias("latest_registered_at"))


def day_counts(items: DataFrame, now: str | Column, by: list[str] = ()) -> DataFrame:
    """Rows of today and yesterday in Seoul, and all rows."""
    today = kst_date(as_ts(now))
    day = kst_date(F.col("registered_at"))
    return items.groupBy(*by).agg(
        F.count_if(day == today).alias("today"), F.count_if(day == F.date_sub(today, 1)).alias("yesterday"),
        F.count(F.lit(1)).alias("total"))


def repeated_values(items: DataFrame, col: str, n: int = 3) -> DataFrame:
    """Non-empty values shared by at least n rows (placeholder pictures)."""
    return items.where(F.coalesce(F.trim(F.col(col)), F.lit("")) != "").groupBy(col).agg(
        F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= n)


def feed_quality_gate(
    items: DataFrame, source: str, now: str | Column, link_pattern: str,
    excluded: Column | None = None, back_hours: int = 48, skew_minutes: int = 10,
) -> DataFrame:
    """One verdict row for a feed: empty, wrong_source, no_recent, malformed or ok.

    ``registered_at`` is text here: a timestamp without an offset is malformed.
    """
    n = as_ts(now)
    text = F.trim(F.coalesce(F.col("registered_at"), F.lit("")))
    ts = F.when(text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), text.try_cast("timestamp"))
    bad = ts.isNull() | ~F.coalesce(F.col("source_link"), F.lit("")).rlike(link_pattern)
    recent = ~bad & ts.between(
        n - F.expr(f"INTERVAL {back_hours} HOURS"), n + F.expr(f"INTERVAL {skew_minutes} MINUTES"))
    if excluded is not None:
        recent = recent & ~excluded
    counts = items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.trim(F.coalesce(F.col("source"), F.lit(""))) != source).alias("wrong_source"),
        F.count_if(bad).alias("malformed"), F.count_if(recent).alias("recent"),
    )
    verdict = (
        F.when(F.col("items") == 0, "empty").when(F.col("wrong_source") > 0, "wrong_source")
        .when(F.col("recent") == 0, "no_recent").when(F.col("malformed") > 0, "malformed").otherwise("ok")
    )
    return counts.withColumn("verdict", verdict)
