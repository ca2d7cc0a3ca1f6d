"""Cross-source popularity model.

One scan builds the per-source profile: every statistic is algebraic, so it is combined map-side and
the shuffle carries one row per source and task. Global statistics are merged from the source rows
(no second scan). Ranks come from a ``(source, z) -> count`` histogram, never from a sorted source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scoring as S
from pricetide.functions.prices import FREE
from pricetide.functions.times import age_hours
from pricetide.operators import scale


def _metric_aggs(metric: str) -> list[Column]:
    value = S.non_negative(F.col(metric))
    return [
        F.sum(F.when(value > 0, 1).otherwise(0)).alias(f"{metric}_nonzero"),
        F.avg(F.log1p(value)).alias(f"{metric}_log_mean"),
        F.var_pop(F.log1p(value)).alias(f"{metric}_log_var"),
    ]


def _usable(n: Column, nonzero: Column, log_var: Column) -> Column:
    return (
        (n >= S.MIN_SAMPLES) & (nonzero >= S.MIN_NONZERO)
        & (nonzero / n >= S.MIN_COVERAGE) & (F.sqrt(log_var) >= S.MIN_LOG_STD)
    )


def source_profile(items: DataFrame) -> DataFrame:
    """One row per source with log statistics per metric, signed quality statistics,
    negative-cap rate and the derived usable / contaminated flags."""
    signal = F.coalesce(F.col("comment_signal_score"), F.lit(0)).cast("double")
    capped = S.negative_capped(F.col("negative_comment_signals"), F.col("dislikes"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for metric in S.METRICS:
        aggs += _metric_aggs(metric)
    aggs += [
        F.avg(S.non_negative(F.col("views"))).alias("avg_views"),
        F.avg(S.non_negative(F.col("comments"))).alias("avg_comments"),
        F.avg(signal).alias("signal_mean"),
        F.stddev_pop(signal).alias("signal_std"),
        F.avg(F.when(capped, 1.0).otherwise(0.0)).alias("negative_cap_rate"),
    ]
    stats = items.groupBy("source").agg(*aggs)
    for metric in S.METRICS:
        stats = stats.withColumn(
            f"{metric}_usable",
            _usable(F.col("n"), F.col(f"{metric}_nonzero"), F.col(f"{metric}_log_var")))
    return (
        stats
        .withColumn("signal_usable", (F.col("n") >= S.MIN_SAMPLES) & (F.col("signal_std") >= 1))
        .withColumn(
            "contaminated",
            (F.col("n") >= S.MIN_SAMPLES) & (F.col("negative_cap_rate") >= S.CONTAMINATED_RATE))
    )


def global_profile(profile: DataFrame) -> DataFrame:
    """One row of log statistics over the rows of sources whose metric is usable.

    Merged from source means and variances: ``var = E[var_s] + E[(mean_s - mean)^2]`` weighted by n.
    """
    aggs, columns = [], []
    for metric in S.METRICS:
        n = F.when(F.col(f"{metric}_usable"), F.col("n"))
        mean, var = F.col(f"{metric}_log_mean"), F.col(f"{metric}_log_var")
        aggs += [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"g_{metric}_n"),
            F.coalesce(F.sum(F.when(n.isNotNull(), F.col(f"{metric}_nonzero"))), F.lit(0)).alias(f"g_{metric}_nonzero"),
            F.sum(n * mean).alias(f"_{metric}_s1"),
            F.sum(n * (var + mean * mean)).alias(f"_{metric}_s2"),
        ]
        g_mean = F.col(f"_{metric}_s1") / F.col(f"g_{metric}_n")
        g_var = F.greatest(F.lit(0.0), F.col(f"_{metric}_s2") / F.col(f"g_{metric}_n") - g_mean * g_mean)
        some = F.col(f"g_{metric}_n") > 0
        columns += [
            F.col(f"g_{metric}_n"), F.col(f"g_{metric}_nonzero"),
            F.when(some, g_mean).alias(f"g_{metric}_log_mean"),
            F.when(some, F.sqrt(g_var)).alias(f"g_{metric}_log_std"),
            F.coalesce(
                F.when(some, _usable(F.col(f"g_{metric}_n"), F.col(f"g_{metric}_nonzero"), g_var)),
                F.lit(False)).alias(f"g_{metric}_usable"),
        ]
    return profile.agg(*aggs).select(*columns)


def temperature_profile(items: DataFrame) -> DataFrame:
    """M1: source rows with the global row attached; one small table, checked before it is broadcast."""
    stored = scale.broadcast_checked(source_profile(items))
    overall = global_profile(stored)
    packed = overall.select(F.struct(*overall.columns)).scalar()
    return stored.withColumn("_g", packed).select("*", "_g.*").drop("_g")


def attach_profile(items: DataFrame, profile: DataFrame) -> DataFrame:
    """Source and global statistics beside every item."""
    return items.join(profile, "source", "left")


def composite_z(scope: str) -> Column:
    """M2: weighted sum of metric z values over the usable metrics, rescaled and clamped.

    ``scope`` is '' for the item's own source or 'g_' for the global statistics (still gated by the
    source's usable flags).
    """
    score, squares = F.lit(0.0), F.lit(0.0)
    for metric in S.METRICS:
        weight = S.METRIC_WEIGHTS[metric]
        std = F.sqrt(F.col(f"{metric}_log_var")) if not scope else F.col(f"g_{metric}_log_std")
        use = F.coalesce(F.col(f"{metric}_usable"), F.lit(False)) & (std > 0)
        if scope:
            use = use & F.coalesce(F.col(f"g_{metric}_usable"), F.lit(False))
        z = S.clamp_z((F.log1p(S.non_negative(F.col(metric))) - F.col(f"{scope}{metric}_log_mean")) / std)
        score = score + F.when(use, z * weight).otherwise(0.0)
        squares = squares + F.when(use, weight * weight).otherwise(0.0)
    return F.when(squares > 0, S.clamp_z(score / F.sqrt(squares))).otherwise(0.0)


def metric_count(scope: str) -> Column:
    flags = []
    for metric in S.METRICS:
        use = F.coalesce(F.col(f"{metric}_usable"), F.lit(False))
        if scope:
            use = use & F.coalesce(F.col(f"g_{metric}_usable"), F.lit(False))
        flags.append(use.cast("int"))
    return reduce(lambda a, b: a + b, flags)


def with_z(items: DataFrame, profile: DataFrame) -> DataFrame:
    """Items with profile, source z (cut to nine places, the rank key) and global z."""
    return (
        attach_profile(items, profile)
        .withColumn("source_z", F.round(composite_z(""), S.Z_PLACES) + F.lit(0.0))
        .withColumn("global_z", composite_z("g_"))
        .withColumn("global_metrics", metric_count("g_"))
        .withColumn("source_metrics", metric_count(""))
    )


def _mid_rank(below: Column, ties: Column, total: Column) -> Column:
    rank = (below + F.greatest(below, below + ties - 1)) / 2
    return F.when(total <= 1, 50.0).otherwise(rank / (total - 1) * 100)


def empirical_percentile(scored: DataFrame, row_id: str = "id") -> DataFrame:
    """Mid-rank percentile 0..100 of ``source_z`` within its source; ties share a rank.

    The histogram that gives the ranks also names the hot (source, z) pairs of the join back.
    """
    hist = scale.cut_lineage(scored.groupBy("source", "source_z").agg(F.count(F.lit(1)).alias("n")))
    ranks = scale.histogram_ranks(hist, ["source"], "source_z").select(
        "source", "source_z", _mid_rank(F.col("below"), F.col("n"), F.col("total")).alias("source_pct"))
    return scale.salted_join(
        scored, ranks, ["source", "source_z"], [row_id], "left")


def empirical_percentile_external(
    items: DataFrame, population: DataFrame, z: str = "source_z", row_id: str = "id"
) -> DataFrame:
    """Percentile of items against another population's z values.

    The distinct item values join the population histogram as rows of count 0, so one running sum
    ranks both; an item value the population lacks has no ties.
    """
    own = population.groupBy("source", z).agg(F.count(F.lit(1)).alias("n"))
    wanted = items.select("source", z).distinct().withColumn("n", F.lit(0).cast("bigint"))
    hist = scale.cut_lineage(own.unionByName(wanted).groupBy("source", z).agg(F.sum("n").alias("n")))
    ranks = scale.histogram_ranks(hist, ["source"], z).select(
        "source", z, _mid_rank(F.col("below"), F.col("n"), F.col("total")).alias("source_pct"))
    return scale.salted_join(items, ranks, ["source", z], [row_id], "left")


def temperature_components(ranked: DataFrame, now: str | Column) -> DataFrame:
    """M3: all parts of the score for rows that carry profile, z values and ``source_pct``."""
    age = age_hours(F.col("registered_at"), now)
    quality_z = F.when(
        F.coalesce(F.col("signal_usable"), F.lit(False)),
        S.clamp_z((F.coalesce(F.col("comment_signal_score"), F.lit(0)) - F.col("signal_mean")) / F.col("signal_std")),
    ).otherwise(0.0)
    out = (
        ranked
        .withColumn(
            "global_pct",
            F.when(F.col("global_metrics") > 0, S.normal_cdf(F.col("global_z")) * 100)
            .otherwise(F.col("source_pct")))
        .withColumn(
            "engagement",
            F.col("source_pct") * S.SOURCE_RELATIVE_WEIGHT + F.col("global_pct") * S.GLOBAL_ABSOLUTE_WEIGHT)
        .withColumn("recency", S.freshness(age) * 100)
        .withColumn("quality_z", quality_z)
        .withColumn(
            "quality_adjustment",
            S.clamp(F.col("quality_z") * S.QUALITY_WEIGHT, -S.QUALITY_CAP, S.QUALITY_CAP)
            - F.log1p(S.non_negative(F.col("dislikes"))) * S.DISLIKE_WEIGHT)
        .withColumn(
            "elite_bonus",
            F.when(
                F.col("global_pct") > S.ELITE_THRESHOLD,
                (F.col("global_pct") - S.ELITE_THRESHOLD) / (100 - S.ELITE_THRESHOLD) * S.ELITE_MAX_BONUS,
            ).otherwise(0.0))
        .withColumn(
            "raw_temperature",
            F.col("engagement") * S.ENGAGEMENT_WEIGHT + F.col("recency") * S.RECENCY_WEIGHT
            + F.col("quality_adjustment") + F.col("elite_bonus"))
        .withColumn(
            "blended_z",
            F.col("source_z") * S.SOURCE_RELATIVE_WEIGHT + F.col("global_z") * S.GLOBAL_ABSOLUTE_WEIGHT)
    )
    return out


def apply_temperature(components: DataFrame) -> DataFrame:
    """M4: whole degrees 0..100; free deals lie in 80..100; warned rows stop at 50 unless their
    source's signals are contaminated. ``hot_score`` is the blended z to four places."""
    plain = S.clamp(S.half_up(F.col("raw_temperature")), 0, 100)
    free = F.trim(F.coalesce(F.col("price"), F.lit(""))) == FREE
    lifted = F.when(free, S.clamp(S.half_up(80 + plain * 0.2), 80, 100)).otherwise(plain)
    capped = S.negative_capped(F.col("negative_comment_signals"), F.col("dislikes"))
    cap = capped & ~F.coalesce(F.col("contaminated"), F.lit(False))
    return (
        components
        .withColumn(
            "temperature",
            F.when(cap, F.least(lifted, F.lit(S.NEGATIVE_TEMPERATURE_CAP))).otherwise(lifted).cast("bigint"))
        .withColumn("hot_score", F.round(F.col("blended_z"), 4) + F.lit(0.0))
    )


def temperature_scores(items: DataFrame, now: str | Column, profile: DataFrame | None = None) -> DataFrame:
    """Profile, rank and score one population (``items`` must already be cut to the feed window)."""
    profile = temperature_profile(items) if profile is None else profile
    scored = apply_temperature(temperature_components(empirical_percentile(with_z(items, profile)), now))
    return scored


def scores_external(page: DataFrame, population: DataFrame, now: str | Column) -> DataFrame:
    """Page items scored by the profile and ranks of other rows (the paged read)."""
    profile = temperature_profile(population)
    ranked = empirical_percentile_external(with_z(page, profile), with_z(population, profile))
    return apply_temperature(temperature_components(ranked, now))


def source_metric_averages(items: DataFrame) -> DataFrame:
    """Mean views and comments per source, negatives as 0."""
    return items.groupBy("source").agg(
        F.avg(S.non_negative(F.col("views"))).alias("avg_views"),
        F.avg(S.non_negative(F.col("comments"))).alias("avg_comments"),
    )


def hot_score_v1(items: DataFrame, now: str | Column) -> DataFrame:
    """M5 with A9 as its averages."""
    averages = scale.broadcast_checked(source_metric_averages(items))
    return items.join(averages, "source", "left").withColumn(
        "hot_score_v1",
        S.hot_score_v1(age_hours(F.col("registered_at"), now), F.col("avg_views"), F.col("avg_comments")))


def manual_rows(user_rows: DataFrame) -> DataFrame:
    """M7: user posts keep the temperature they were given."""
    return user_rows.withColumn(
        "temperature", S.manual_temperature(F.col("manual_temperature")).cast("bigint"))


METRIC_PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def _long(items: DataFrame, metrics: list[str]) -> DataFrame:
    return items.select(
        "source",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), S.non_negative(F.col(m)).alias("value")) for m in metrics
        ])).alias("m"),
    ).select("source", "m.metric", "m.value")


def metric_stats(items: DataFrame, metrics: list[str] = S.METRICS) -> DataFrame:
    """A5: raw and log statistics with quantiles per (source, metric) and the usable flag."""
    return _metric_stats(_long(items, metrics), ["source", "metric"])


def global_metric_stats(items: DataFrame, metrics: list[str] = S.METRICS) -> DataFrame:
    """A8 in full: A5 per metric over the rows whose source has that metric usable."""
    long = _long(items, metrics)
    usable = scale.broadcast_checked(
        _moments(long, ["source", "metric"]).where("usable").select("source", "metric"))
    return _metric_stats(long.join(usable, ["source", "metric"], "left_semi"), ["metric"])


def _moments(long: DataFrame, keys: list[str]) -> DataFrame:
    value = F.col("value")
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(F.when(value > 0, 1).otherwise(0)).alias("non_zero"),
        F.avg(value).alias("raw_mean"),
        F.var_pop(value).alias("raw_variance"),
        F.max(value).alias("max"),
        F.avg(F.log1p(value)).alias("log_mean"),
        F.var_pop(F.log1p(value)).alias("log_variance"),
    ).withColumn("coverage", F.col("non_zero") / F.col("sample_count")).withColumn(
        "usable", _usable(F.col("sample_count"), F.col("non_zero"), F.col("log_variance")))


def _metric_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    hist = scale.value_histogram(long, keys, "value")
    quantiles = scale.histogram_quantiles(hist, keys, "value", METRIC_PROBS)
    return _moments(long, keys).join(quantiles, keys)


def signed_metric_stats(items: DataFrame, col: str = "comment_signal_score") -> DataFrame:
    """Population statistics of the signed quality score per source."""
    value = F.coalesce(F.col(col), F.lit(0)).cast("double")
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std_dev"),
    ).withColumn("usable", (F.col("sample_count") >= S.MIN_SAMPLES) & (F.col("std_dev") >= 1))


def negative_cap_rate(items: DataFrame) -> DataFrame:
    """Share of warned rows per source and whether that source's signals are contaminated."""
    capped = S.negative_capped(F.col("negative_comment_signals"), F.col("dislikes"))
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.when(capped, 1.0).otherwise(0.0)).alias("negative_cap_rate"),
    ).withColumn(
        "contaminated",
        (F.col("sample_count") >= S.MIN_SAMPLES) & (F.col("negative_cap_rate") >= S.CONTAMINATED_RATE))


REPORT_COLUMNS = ["id", "source", "temperature", "negative_cap_rate", "contaminated", *[f"{m}_usable" for m in S.METRICS]]


def source_report(scored: DataFrame, sources: list[str]) -> DataFrame:
    """A10: count, mean, quartile points and top temperature plus active metrics for every listed
    source; a source without rows reports zeros. ``scored`` is the output of ``temperature_scores``; the
    columns the reports read are stored once."""
    return _source_report(scale.cut_lineage(scored.select(*REPORT_COLUMNS)), sources)


def _source_report(scored: DataFrame, sources: list[str]) -> DataFrame:
    listed = scored.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    active = F.concat_ws(",", *[F.when(F.first(f"{m}_usable"), F.lit(m)) for m in S.METRICS])
    stats = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("count"), F.avg("temperature").alias("temperature_mean"),
        F.max("temperature").alias("temperature_max"), active.alias("active_metrics"),
        F.first("negative_cap_rate").alias("negative_cap_rate"), F.first("contaminated").alias("contaminated"),
    )
    hist = scale.value_histogram(scored, ["source"], "temperature")
    quantiles = scale.histogram_quantiles(
        hist, ["source"], "temperature", {"temperature_p50": 0.5, "temperature_p90": 0.9})
    out = listed.join(stats, "source", "left").join(quantiles, "source", "left")
    zero = {c: 0 for c in ["count", "temperature_mean", "temperature_max", "temperature_p50", "temperature_p90",
                           "negative_cap_rate"]}
    return out.fillna(zero).fillna({"active_metrics": "", "contaminated": False})


def top_mix(scored: DataFrame, k: int = 20) -> DataFrame:
    """Source composition of the k hottest deals."""
    top = scored.orderBy(F.col("temperature").desc(), F.col("id")).limit(k)
    return top.groupBy("source").agg(F.count(F.lit(1)).alias("deals"))


def saturation_rate(scored: DataFrame, limit: float = 0.08) -> DataFrame:
    """Share of deals at 100 degrees and whether it is too high."""
    return scored.agg(
        F.coalesce(F.avg(F.when(F.col("temperature") >= 100, 1.0).otherwise(0.0)), F.lit(0.0)).alias("rate")
    ).withColumn("saturated", F.col("rate") > limit)


def mean_gap(report: DataFrame, stable: float = 8.0) -> DataFrame:
    """Spread of the source means over sources that have rows."""
    populated = report.where("count > 0")
    gap = F.coalesce(F.max("temperature_mean") - F.min("temperature_mean"), F.lit(0.0))
    return populated.agg(
        gap.alias("gap"), F.count_if(F.col("count") < 20).alias("small_samples"),
    ).withColumn("stable", F.col("gap") <= stable)


def model_report(scored: DataFrame, trend: DataFrame, sources: list[str]) -> DataFrame:
    """M8: A10, A23-A25 and W13 as tidy (section, source, metric, value) rows."""
    scored = scale.cut_lineage(scored.select(*REPORT_COLUMNS))
    report = scale.cut_lineage(_source_report(scored, sources))

    def rows(df: DataFrame, section: str, source: Column, values: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in values.items()
        ])
        return df.select(F.lit(section).alias("section"), source.alias("source"), F.explode(pairs).alias("p")).select(
            "section", "source", "p.metric", "p.value")

    numbers = ["count", "temperature_mean", "temperature_p50", "temperature_p90", "temperature_max",
               "negative_cap_rate"]
    parts = [
        rows(report, "source", F.col("source"),
             {**{c: F.col(c) for c in numbers}, "contaminated": F.col("contaminated").cast("int")}),
        rows(mean_gap(report), "balance", F.lit(""),
             {"gap": F.col("gap"), "stable": F.col("stable").cast("int"), "small_samples": F.col("small_samples")}),
        rows(top_mix(scored), "top", F.col("source"), {"deals": F.col("deals")}),
        rows(saturation_rate(scored), "saturation", F.lit(""),
             {"rate": F.col("rate"), "saturated": F.col("saturated").cast("int")}),
        trend.select(F.lit("trend").alias("section"), "source", "metric", F.col("delta").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
