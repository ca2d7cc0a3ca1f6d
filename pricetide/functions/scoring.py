"""Numeric helpers of the popularity model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of the temperature model, version 2.
MODEL_VERSION = 2
METRICS = ["views", "comments", "likes"]
METRIC_WEIGHTS = {"views": 1.0, "comments": 1.8, "likes": 1.2}
SOURCE_RELATIVE_WEIGHT = 0.85
GLOBAL_ABSOLUTE_WEIGHT = 0.15
ENGAGEMENT_WEIGHT = 0.88
RECENCY_WEIGHT = 0.12
ELITE_THRESHOLD = 95.0
ELITE_MAX_BONUS = 8.0
MIN_SAMPLES = 8
MIN_NONZERO = 5
MIN_COVERAGE = 0.2
MIN_LOG_STD = 0.08
Z_CLAMP = 3.0
QUALITY_WEIGHT = 5.0
QUALITY_CAP = 12.0
DISLIKE_WEIGHT = 8.0
RECENCY_WINDOW_HOURS = 48.0
HOT_BOOST_HOURS = 3.0
NEGATIVE_CAP_THRESHOLD = 3
NEGATIVE_TEMPERATURE_CAP = 50
CONTAMINATED_RATE = 0.6
LEGACY_COMMENT_WEIGHT = 1.8
LEGACY_LIKE_WEIGHT = 1.2
LEGACY_DISLIKE_WEIGHT = 4.0
LEGACY_SIGNAL_WEIGHT = 0.75
LEGACY_RECENCY_WEIGHT = 0.65
SIGNAL_MIN, SIGNAL_MAX = -60, 16
# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_COEFFICIENTS = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
# z is compared for ties, so it is cut to this many places first.
Z_PLACES = 9


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def clamp_z(col: Column) -> Column:
    return clamp(col, -Z_CLAMP, Z_CLAMP)


def half_up(col: Column) -> Column:
    """Whole number, halves towards plus infinity."""
    return F.floor(col + 0.5).cast("bigint")


def non_negative(col: Column) -> Column:
    return F.greatest(F.coalesce(col, F.lit(0)).cast("double"), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """standard normal distribution function, z clamped to three deviations."""
    x = clamp_z(F.coalesce(z, F.lit(0.0))) / F.lit(math.sqrt(2))
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    series = F.lit(0.0)
    for coefficient in reversed(ERF_COEFFICIENTS):
        series = (series + F.lit(coefficient)) * t
    erf = F.when(x < 0, -1.0).otherwise(1.0) * (1 - series * F.exp(-x * x))
    return (1 + erf) * 0.5


def freshness(age: Column) -> Column:
    """1 now, falling to 0 at the end of the 48 h window; unknown age counts as the end."""
    hours = F.coalesce(age, F.lit(RECENCY_WINDOW_HOURS))
    return F.greatest(F.lit(0.0), 1 - hours / F.lit(RECENCY_WINDOW_HOURS))


def negative_capped(negative_signals: Column, dislikes: Column) -> Column:
    """A row whose comments or dislikes warn enough to cap its temperature."""
    return (non_negative(negative_signals) >= NEGATIVE_CAP_THRESHOLD) | (
        non_negative(dislikes) >= NEGATIVE_CAP_THRESHOLD)


def hot_score_v1(age: Column, avg_views: Column, avg_comments: Column) -> Column:
    """M5: the earlier log10 score with scarcity and the first-hours boost."""
    views, comments = non_negative(F.col("views")), non_negative(F.col("comments"))
    signal = clamp(F.coalesce(F.col("comment_signal_score"), F.lit(0)).cast("double"), SIGNAL_MIN, SIGNAL_MAX)
    hours = F.coalesce(age, F.lit(RECENCY_WINDOW_HOURS))

    def deficit(value: Column, mean: Column) -> Column:
        floor = F.greatest(F.lit(1.0), F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1.0)))
        return clamp((floor - value) / floor, 0.0, 1.0)

    scarcity = 0.2 + 0.8 * ((deficit(views, avg_views) + deficit(comments, avg_comments)) / 2)
    boost = F.when(hours <= HOT_BOOST_HOURS, 2.0).otherwise(1.0)
    return (
        F.log10(views + 1)
        + F.log10(comments + 1) * LEGACY_COMMENT_WEIGHT
        + F.log10(non_negative(F.col("likes")) + 1) * LEGACY_LIKE_WEIGHT
        - F.log10(non_negative(F.col("dislikes")) + 1) * LEGACY_DISLIKE_WEIGHT
        + signal * LEGACY_SIGNAL_WEIGHT
        + freshness(age) * scarcity * boost * LEGACY_RECENCY_WEIGHT
    )


def manual_temperature(col: Column, zero_is_full: bool = True) -> Column:
    """M7: user-entered temperature within 0..100; missing counts as 100, and so does 0 by default."""
    value = F.when(F.isnan(col.cast("double")), None).otherwise(col.cast("double"))
    if zero_is_full:
        value = F.nullif(value, F.lit(0.0))
    return clamp(F.coalesce(value, F.lit(100.0)), 0.0, 100.0)
