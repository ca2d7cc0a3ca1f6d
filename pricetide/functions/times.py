"""Timestamps: ISO and board-style parsing, 30-minute buckets, ages, Seoul dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KST = "Asia/Seoul"


def as_ts(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def parse_iso(col: Column) -> Column:
    """ISO timestamp with offset or Z; without one it is UTC (session zone); unparseable is null."""
    return F.trim(col.cast("string")).try_cast("timestamp")


def bucket_30min(col: Column) -> Column:
    """F16: floor to :00 / :30."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / 1800) * 1800)


def age_hours(col: Column, now: str | Column) -> Column:
    """hours since, never negative."""
    micros = F.unix_micros(as_ts(now)) - F.unix_micros(col)
    return F.greatest(F.lit(0.0), micros / F.lit(3.6e9))


def kst_date(col: Column) -> Column:
    """calendar date in Seoul."""
    return F.to_date(F.from_utc_timestamp(col, KST))


def kst_label(col: Column) -> Column:
    """date text ``YYYY-MM-DD`` in Seoul."""
    return F.date_format(F.from_utc_timestamp(col, KST), "yyyy-MM-dd")


def in_feed_window(ts: Column, now: str | Column, back_hours: int = 48, skew_minutes: int = 10) -> Column:
    """Between now-48h and now+10min, bounds included; no timestamp means out.

    The bounds are literals on the bare column so the test reaches the Parquet reader.
    """
    n = as_ts(now)
    inside = (ts >= n - F.expr(f"INTERVAL {back_hours} HOURS")) & (
        ts <= n + F.expr(f"INTERVAL {skew_minutes} MINUTES"))
    return F.coalesce(inside, F.lit(False)) if isinstance(now, Column) else inside


def is_older_than(registered: Column, created: Column, cutoff: Column) -> Column:
    """Strictly before the cutoff; a row without any timestamp is not old."""
    return F.coalesce(F.coalesce(registered, created) < cutoff, F.lit(False))


def is_future_dated(registered: Column, created: Column, cutoff: Column) -> Column:
    """Strictly after the cutoff; a row without any timestamp is not future."""
    return F.coalesce(F.coalesce(registered, created) > cutoff, F.lit(False))


def feed_window_kst(
    ts: Column, now: Column, since: Column, skew_minutes: int = 10, keep_unparsed: bool = True
) -> Column:
    """Since the window start or on its Seoul date, not ahead of now by more than the skew."""
    inside = (ts <= now + F.expr(f"INTERVAL {skew_minutes} MINUTES")) & (
        (ts >= since) | (kst_date(ts) == kst_date(since)))
    return F.coalesce(inside, F.lit(keep_unparsed))


def parse_relative_time(col: Column, now: Column, skew_minutes: int = 10) -> Column:
    """board time labels to instants, reading clock and calendar in Seoul; unknown labels are null.

    ``방금``; ``n초/분/시간/일 전``; ``어제``/``그저께`` (24 / 48 hours ago); ``HH:MM`` (ahead of now means
    yesterday); ``YYYY.MM.DD`` or ``YY.MM.DD``, optionally with a clock; ``MM.DD``, optionally with a
    clock (ahead of now means last year).
    """
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    local = F.from_utc_timestamp(now, KST)
    today = F.to_date(local)

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    def day_of(year: Column, month: Column, day: Column) -> Column:
        stamp = F.format_string("%04d-%02d-%02d", year, month, day)
        return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), stamp.try_cast("date"))

    seconds = {"초": 1, "분": 60, "시간": 3600, "일": 86400}
    ago = r"^([0-9]+) ?(초|분|시간|일) ?전$"
    unit = F.lit(None).cast("int")
    for name, value in seconds.items():
        unit = F.when(F.regexp_extract(text, ago, 2) == name, value).otherwise(unit)
    relative = F.timestamp_micros(
        F.unix_micros(now) - number(ago).cast("bigint") * unit.cast("bigint") * 1_000_000)

    clock = r"^([0-9]{2}):([0-9]{2})$"
    valid_clock = number(clock).between(0, 23) & number(clock, 2).between(0, 59)
    clock_today = F.to_utc_timestamp(
        F.timestamp_seconds(
            F.unix_seconds(today.cast("timestamp")) + number(clock) * 3600 + number(clock, 2) * 60), KST)
    clock_at = F.when(
        clock_today > now + F.expr("INTERVAL 5 MINUTES"), clock_today - F.expr("INTERVAL 24 HOURS")
    ).otherwise(clock_today)

    def at_clock(day: Column, hour: Column, minute: Column, second: Column) -> Column:
        seconds_in = (
            F.coalesce(hour, F.lit(0)) * 3600 + F.coalesce(minute, F.lit(0)) * 60 + F.coalesce(second, F.lit(0)))
        return F.to_utc_timestamp(
            F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds_in), KST)

    full = r"^([0-9]{4}|[0-9]{2})[-./]([0-9]{1,2})[-./]([0-9]{1,2})\.?(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"
    year = number(full)
    day = day_of(F.when(year < 100, year + 2000).otherwise(year), number(full, 2), number(full, 3))
    dated = at_clock(day, number(full, 4), number(full, 5), number(full, 6))

    short = r"^([0-9]{1,2})[-./]([0-9]{1,2})(?: ([0-9]{1,2}):([0-9]{2}))?$"

    def in_year(year: Column) -> Column:
        return at_clock(
            day_of(year, number(short), number(short, 2)), number(short, 3), number(short, 4), F.lit(0))

    this_year = in_year(F.year(today))
    ahead = this_year > now + F.expr(f"INTERVAL {skew_minutes} MINUTES")

    return (
        F.when(text.isin("방금", "방금 전", "조금 전"), now)
        .when(text.rlike(ago), relative)
        .when(text == "어제", now - F.expr("INTERVAL 24 HOURS"))
        .when(text == "그저께", now - F.expr("INTERVAL 48 HOURS"))
        .when(text.rlike(clock) & valid_clock, clock_at)
        .when(text.rlike(full), dated)
        .when(text.rlike(short), F.when(ahead, in_year(F.year(today) - 1)).otherwise(this_year))
    )
