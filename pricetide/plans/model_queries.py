"""Popularity model, statistics and reports on the events-derived deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import scoring as S
from pricetide.functions.times import bucket_30min, in_feed_window
from pricetide.operators import scale
from pricetide.operators import snapshots as N
from pricetide.operators import temperature as M
from pricetide.plans.registry import query, r, sql_ts, ts_text
from pricetide.plans.views import NOW, SOURCES, oracle_with, table, view

W = "registered_at BETWEEN TIMESTAMP '2024-01-29 00:00:00' AND TIMESTAMP '2024-01-31 00:10:00'"


def window_deals(spark, sf_dir):
    """Deals of the 48 hours before the literal now; the bounds reach the Parquet reader."""
    return view(spark, sf_dir, "v_deals").where(in_feed_window(F.col("registered_at"), NOW))


def score_sql(population: str = "d", items: str = "d") -> str:
    """CTEs that score ``items`` by the profile and ranks of ``population`` (both tables of deals)."""
    def long(t):
        return " UNION ALL ".join(f"SELECT id, source, '{m}' AS metric, {m} AS v FROM {t}" for m in S.METRICS)
    return f"""
lp AS ({long(population)}), li AS ({long(items)}),
w AS (SELECT * FROM (VALUES ('views', 1.0::DOUBLE), ('comments', 1.8::DOUBLE), ('likes', 1.2::DOUBLE)) t(metric, weight)),
st AS (SELECT source, metric, count(*) n, count(*) FILTER (v > 0) nz, avg(ln(1 + v)) lm, stddev_pop(ln(1 + v)) ls FROM lp GROUP BY ALL),
us AS (SELECT *, n >= 8 AND nz >= 5 AND nz * 1.0 / n >= 0.2 AND ls >= 0.08 AS usable FROM st),
gs AS (SELECT metric, count(*) n, count(*) FILTER (v > 0) nz, avg(ln(1 + v)) lm, stddev_pop(ln(1 + v)) ls
       FROM lp JOIN us USING (source, metric) WHERE usable GROUP BY metric),
gu AS (SELECT *, n >= 8 AND nz >= 5 AND nz * 1.0 / n >= 0.2 AND ls >= 0.08 AS usable FROM gs),
ps AS (SELECT source, count(*) n, avg(comment_signal_score) qm, stddev_pop(comment_signal_score) qs,
              avg(CASE WHEN negative_comment_signals >= 3 OR dislikes >= 3 THEN 1.0 ELSE 0.0 END) ncr
       FROM {population} GROUP BY source),
zz AS (SELECT 'p' side, id, source, metric, v FROM lp UNION ALL SELECT 'i', id, source, metric, v FROM li),
sz AS (SELECT side, id, source,
         greatest(-3, least(3, sum(weight * greatest(-3, least(3, (ln(1 + v) - u.lm) / u.ls))) / sqrt(sum(weight * weight)))) z, count(*) nm
       FROM zz JOIN us u USING (source, metric) JOIN w USING (metric) WHERE u.usable GROUP BY ALL),
gz AS (SELECT id, greatest(-3, least(3, sum(weight * greatest(-3, least(3, (ln(1 + v) - g.lm) / g.ls))) / sqrt(sum(weight * weight)))) z, count(*) nm
       FROM li JOIN us u USING (source, metric) JOIN gu g USING (metric) JOIN w USING (metric) WHERE u.usable AND g.usable GROUP BY id),
pz AS (SELECT p.id, p.source, round(coalesce(z, 0), 9) + 0.0 z FROM {population} p LEFT JOIN (SELECT * FROM sz WHERE side = 'p') s USING (id, source)),
iz AS (SELECT i.*, round(coalesce(s.z, 0), 9) + 0.0 sz, coalesce(g.z, 0.0) gz, coalesce(g.nm, 0) gm
       FROM {items} i LEFT JOIN (SELECT * FROM sz WHERE side = 'i') s USING (id, source) LEFT JOIN gz g ON g.id = i.id),
hz AS (SELECT source, z, count(*) c FROM pz GROUP BY ALL),
rk AS (SELECT k.source, k.sz, coalesce(sum(h.c) FILTER (h.z < k.sz), 0) lo, coalesce(sum(h.c) FILTER (h.z = k.sz), 0) eq, coalesce(sum(h.c), 0) tot
       FROM (SELECT DISTINCT source, sz FROM iz) k LEFT JOIN hz h ON h.source = k.source GROUP BY ALL),
c1 AS (SELECT iz.*, ps.n pn, ps.qm, ps.qs, ps.ncr,
         CASE WHEN tot <= 1 THEN 50.0 ELSE (lo + greatest(lo, lo + eq - 1)) / 2.0 / (tot - 1) * 100 END pct,
         abs(greatest(-3, least(3, gz)) / sqrt(2)) ax
       FROM iz JOIN rk ON rk.source = iz.source AND rk.sz = iz.sz LEFT JOIN ps ON ps.source = iz.source),
c2 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * ax) t FROM c1),
c3 AS (SELECT *, 0.5 * (1 + CASE WHEN gz < 0 THEN -1 ELSE 1 END * (1 - (0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t * t + 1.421413741::DOUBLE * t * t * t
              - 1.453152027::DOUBLE * t * t * t * t + 1.061405429::DOUBLE * t * t * t * t * t) * exp(-ax * ax))) * 100 cdf FROM c2),
c4 AS (SELECT *, CASE WHEN gm > 0 THEN cdf ELSE pct END gp,
         greatest(0, 1 - greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(registered_at)) / 3.6e9) / 48.0) * 100 rec,
         CASE WHEN pn >= 8 AND qs >= 1 THEN greatest(-3, least(3, (comment_signal_score - qm) / qs)) ELSE 0.0 END qz FROM c3),
c5 AS (SELECT *, pct * 0.85::DOUBLE + gp * 0.15::DOUBLE eng, greatest(-12, least(12, qz * 5)) - ln(1 + dislikes) * 8 qa,
         CASE WHEN gp > 95 THEN (gp - 95) / 5 * 8 ELSE 0.0 END eb FROM c4),
c6 AS (SELECT *, eng * 0.88::DOUBLE + rec * 0.12::DOUBLE + qa + eb raw FROM c5),
c7 AS (SELECT *, greatest(0, least(100, floor(raw + 0.5))) pl FROM c6),
c8 AS (SELECT *, CASE WHEN trim(price) = '무료' THEN greatest(80, least(100, floor(80 + pl * 0.2::DOUBLE + 0.5))) ELSE pl END li8 FROM c7),
sc AS (SELECT *, CAST(CASE WHEN (negative_comment_signals >= 3 OR dislikes >= 3) AND NOT (pn >= 8 AND ncr >= 0.6) THEN least(li8, 50) ELSE li8 END AS BIGINT) AS temperature,
         round(sz * 0.85::DOUBLE + gz * 0.15::DOUBLE, 4) + 0.0 AS hot_score FROM c8)"""


D = f"{oracle_with('v_deals')}, d AS (SELECT * FROM v_deals WHERE {W})"


@query("temperature_scores", f"""{D}, {score_sql()}
SELECT id, source, temperature, hot_score, round(pct, 6) AS source_pct FROM sc""")
def temperature_scores(spark, sf_dir):
    """Every deal of the window with its temperature."""
    scored = M.temperature_scores(window_deals(spark, sf_dir), NOW)
    return scored.select("id", "source", "temperature", "hot_score", r(F.col("source_pct"), 6).alias("source_pct"))


@query("temperature_scores_all_time", f"""{oracle_with('v_deals')}, d AS (SELECT * FROM v_deals), {score_sql()}
SELECT id, source, temperature, hot_score FROM sc""")
def temperature_scores_all_time(spark, sf_dir):
    """M1-M4 over the whole table, not only the feed window."""
    scored = M.temperature_scores(view(spark, sf_dir, "v_deals"), NOW)
    return scored.select("id", "source", "temperature", "hot_score")


@query("temperature_components", f"""{D}, {score_sql()}
SELECT id, round(eng, 5) AS engagement, round(rec, 5) AS recency, round(qa, 5) AS quality_adjustment, round(eb, 5) AS elite_bonus,
       round(gp, 5) AS global_pct FROM sc""")
def temperature_components(spark, sf_dir):
    """M3: the parts of the score."""
    c = M.temperature_scores(window_deals(spark, sf_dir), NOW)
    names = ["engagement", "recency", "quality_adjustment", "elite_bonus", "global_pct"]
    return c.select("id", *[r(F.col(n), 5).alias(n) for n in names])


@query("temperature_top10", f"""{D}, {score_sql()}
SELECT id, source, temperature FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY temperature DESC, id) rn FROM sc) WHERE rn <= 10""")
def temperature_top10(spark, sf_dir):
    """Flagship: the ten hottest deals of every source."""
    scored = M.temperature_scores(window_deals(spark, sf_dir), NOW).select("id", "source", "temperature")
    return scale.keep_top(scored, ["source"], 10, F.col("temperature").desc(), F.col("id").asc())


@query("composite_z", f"""{D}, {score_sql()}
SELECT id, round(sz, 6) + 0.0 AS source_z, round(gz, 6) + 0.0 AS global_z, gm AS global_metrics FROM sc""")
def composite_z(spark, sf_dir):
    """M2."""
    items = window_deals(spark, sf_dir)
    z = M.with_z(items, M.temperature_profile(items))
    return z.select("id", r(F.col("source_z"), 6).alias("source_z"), r(F.col("global_z"), 6).alias("global_z"),
                    F.col("global_metrics").cast("bigint").alias("global_metrics"))


@query("scores_external_population", f"""{D}, page AS (SELECT * FROM d WHERE id % 2 = 0), pop AS (SELECT * FROM d WHERE id % 2 = 1),
{score_sql('pop', 'page')}
SELECT id, source, temperature, hot_score, round(pct, 6) AS source_pct FROM sc""")
def scores_external_population(spark, sf_dir):
    """Page rows scored by the profile and ranks of the other rows (two halves of the window)."""
    items = window_deals(spark, sf_dir)
    scored = M.scores_external(items.where("id % 2 = 0"), items.where("id % 2 = 1"), NOW)
    return scored.select("id", "source", "temperature", "hot_score", r(F.col("source_pct"), 6).alias("source_pct"))


@query("normal_cdf", f"""{oracle_with('v_deals')},
x AS (SELECT id, greatest(-3, least(3, comment_signal_score / 2.0)) / sqrt(2) q FROM v_deals),
y AS (SELECT id, q, 1 / (1 + 0.3275911::DOUBLE * abs(q)) t FROM x)
SELECT id, round(0.5 * (1 + sign(q) * (1 - (0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t ** 2 + 1.421413741::DOUBLE * t ** 3
  - 1.453152027::DOUBLE * t ** 4 + 1.061405429::DOUBLE * t ** 5) * exp(-q * q))), 6) AS p FROM y""")
def normal_cdf(spark, sf_dir):
    """F38."""
    d = view(spark, sf_dir, "v_deals")
    return d.select("id", r(S.normal_cdf(F.col("comment_signal_score") / 2.0), 6).alias("p"))


@query("hot_score_v1", f"""{D},
a AS (SELECT source, avg(greatest(views, 0)) av, avg(greatest(comments, 0)) ac FROM d GROUP BY source),
x AS (SELECT d.*, greatest(1, av) av, greatest(1, ac) ac,
        greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(registered_at)) / 3.6e9) h FROM d JOIN a USING (source))
SELECT id, round(log10(views + 1) + log10(comments + 1) * 1.8::DOUBLE + log10(likes + 1) * 1.2::DOUBLE - log10(dislikes + 1) * 4.0
  + greatest(-60, least(16, comment_signal_score)) * 0.75::DOUBLE
  + 0.65::DOUBLE * greatest(0, 1 - h / 48) * (0.2::DOUBLE + 0.8::DOUBLE * ((greatest(0, least(1, (av - views) / av)) + greatest(0, least(1, (ac - comments) / ac))) / 2))
    * CASE WHEN h <= 3 THEN 2 ELSE 1 END, 5) + 0.0 AS hot_score_v1 FROM x""")
def hot_score_v1(spark, sf_dir):
    """M5 with A9."""
    scored = M.hot_score_v1(window_deals(spark, sf_dir), NOW)
    return scored.select("id", r(F.col("hot_score_v1"), 5).alias("hot_score_v1"))


@query("source_metric_averages", f"""{D}
SELECT source, round(avg(greatest(views, 0)), 5) AS avg_views, round(avg(greatest(comments, 0)), 5) AS avg_comments FROM d GROUP BY source""")
def source_metric_averages(spark, sf_dir):
    """A9."""
    a = M.source_metric_averages(window_deals(spark, sf_dir))
    return a.select("source", r(F.col("avg_views"), 5).alias("avg_views"), r(F.col("avg_comments"), 5).alias("avg_comments"))


@query("manual_temperature", f"""{oracle_with('v_deals')}
SELECT id, CAST(CASE WHEN likes = 0 THEN 100 ELSE greatest(0, least(100, likes * 15 - 10)) END AS BIGINT) AS temperature FROM v_deals""")
def manual_temperature(spark, sf_dir):
    """M7: user rows with a hand-set temperature (likes stand in; zero likes mean none was given)."""
    rows = view(spark, sf_dir, "v_deals").withColumn(
        "manual_temperature", F.expr("CASE WHEN likes = 0 THEN 0 ELSE likes * 15 - 10 END"))
    return M.manual_rows(rows).select("id", "temperature")


def _stats_sql(values: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS sample_count, count(*) FILTER (v > 0) AS non_zero,
  round(count(*) FILTER (v > 0) * 1.0 / count(*), 5) AS coverage, round(avg(v), 5) AS raw_mean, round(var_pop(v), 4) AS raw_variance,
  round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75, round(quantile_cont(v, 0.9), 5) AS p90,
  round(quantile_cont(v, 0.95), 5) AS p95, CAST(max(v) AS DOUBLE) AS max, round(avg(ln(1 + v)), 6) AS log_mean, round(var_pop(ln(1 + v)), 6) AS log_variance,
  count(*) >= 8 AND count(*) FILTER (v > 0) >= 5 AND count(*) FILTER (v > 0) * 1.0 / count(*) >= 0.2 AND stddev_pop(ln(1 + v)) >= 0.08 AS usable
FROM {values} GROUP BY {keys}"""


def _stats_out(df, keys):
    five = ["coverage", "raw_mean", "p50", "p75", "p90", "p95"]
    return df.select(
        *keys, "sample_count", F.col("non_zero").cast("bigint").alias("non_zero"), *[r(F.col(c), 5).alias(c) for c in five],
        r(F.col("raw_variance"), 4).alias("raw_variance"), "max", r(F.col("log_mean"), 6).alias("log_mean"),
        r(F.col("log_variance"), 6).alias("log_variance"), "usable")


LONG = " UNION ALL ".join(f"SELECT source, '{m}' AS metric, greatest({m}, 0)::DOUBLE AS v FROM d" for m in S.METRICS)


@query("metric_stats_usable", f"{D}, l AS ({LONG}) {_stats_sql('l', 'source, metric')}")
def metric_stats_usable(spark, sf_dir):
    """A5."""
    return _stats_out(M.metric_stats(window_deals(spark, sf_dir)), ["source", "metric"])


@query("metric_stats_all_time",
       f"{oracle_with('v_deals')}, d AS (SELECT * FROM v_deals), l AS ({LONG}) {_stats_sql('l', 'source, metric')}")
def metric_stats_all_time(spark, sf_dir):
    """A5 over the whole table."""
    return _stats_out(M.metric_stats(view(spark, sf_dir, "v_deals")), ["source", "metric"])


@query("global_metric_stats", f"""{D}, l AS ({LONG}), s AS ({_stats_sql('l', 'source, metric')}),
u AS (SELECT l.* FROM l JOIN s USING (source, metric) WHERE s.usable) {_stats_sql('u', 'metric')}""")
def global_metric_stats(spark, sf_dir):
    """A8."""
    return _stats_out(M.global_metric_stats(window_deals(spark, sf_dir)), ["metric"])


@query("signed_stats", f"""{D}
SELECT source, count(*) AS sample_count, round(avg(comment_signal_score), 5) + 0.0 AS mean, round(var_pop(comment_signal_score), 5) AS variance,
  round(stddev_pop(comment_signal_score), 5) AS std_dev, count(*) >= 8 AND stddev_pop(comment_signal_score) >= 1 AS usable FROM d GROUP BY source""")
def signed_stats(spark, sf_dir):
    """A6."""
    s = M.signed_metric_stats(window_deals(spark, sf_dir))
    return s.select("source", "sample_count", *[r(F.col(c), 5).alias(c) for c in ("mean", "variance", "std_dev")], "usable")


@query("negative_cap_rate", f"""{D}
SELECT source, count(*) AS sample_count, round(avg(CASE WHEN negative_comment_signals >= 3 OR dislikes >= 3 THEN 1.0 ELSE 0.0 END), 6) AS negative_cap_rate,
  count(*) >= 8 AND avg(CASE WHEN negative_comment_signals >= 3 OR dislikes >= 3 THEN 1.0 ELSE 0.0 END) >= 0.6 AS contaminated FROM d GROUP BY source""")
def negative_cap_rate(spark, sf_dir):
    """A7."""
    s = M.negative_cap_rate(window_deals(spark, sf_dir))
    return s.select("source", "sample_count", r(F.col("negative_cap_rate"), 6).alias("negative_cap_rate"), "contaminated")


LISTED = [*SOURCES, "refund"]
LISTED_SQL = "(VALUES " + ", ".join(f"('{s}')" for s in LISTED) + ") listed(source)"
REPORT = f"""rep AS (SELECT source, count(id) AS "count", coalesce(avg(temperature), 0) tm, coalesce(quantile_cont(temperature, 0.5), 0) t5,
    coalesce(quantile_cont(temperature, 0.9), 0) t9, coalesce(max(temperature), 0) tx, coalesce(max(ncr), 0) ncr, coalesce(bool_or(pn >= 8 AND ncr >= 0.6), false) con
  FROM {LISTED_SQL} LEFT JOIN sc USING (source) GROUP BY source)"""


@query("source_report", f"""{D}, {score_sql()}, {REPORT}
SELECT source, "count", round(tm, 5) AS temperature_mean, round(t5, 5) AS temperature_p50, round(t9, 5) AS temperature_p90,
  CAST(tx AS BIGINT) AS temperature_max, coalesce(am, '') AS active_metrics, round(ncr, 6) AS negative_cap_rate, con AS contaminated
FROM rep LEFT JOIN (SELECT source, string_agg(metric, ',' ORDER BY CASE metric WHEN 'views' THEN 1 WHEN 'comments' THEN 2 ELSE 3 END) am
                    FROM us WHERE usable GROUP BY source) USING (source)""")
def source_report(spark, sf_dir):
    """A10: the five sources and one without rows."""
    rep = M.source_report(M.temperature_scores(window_deals(spark, sf_dir), NOW), LISTED)
    means = ["temperature_mean", "temperature_p50", "temperature_p90"]
    return rep.select(
        "source", "count", *[r(F.col(c), 5).alias(c) for c in means], "temperature_max", "active_metrics",
        r(F.col("negative_cap_rate"), 6).alias("negative_cap_rate"), "contaminated")


@query("top_mix", f"""{D}, {score_sql()}
SELECT source, count(*) AS deals FROM (SELECT * FROM sc ORDER BY temperature DESC, id LIMIT 20) GROUP BY source""")
def top_mix(spark, sf_dir):
    """A23."""
    return M.top_mix(M.temperature_scores(window_deals(spark, sf_dir), NOW))


@query("saturation_rate", f"""{D}, {score_sql()}
SELECT round(avg(CASE WHEN temperature >= 100 THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN temperature >= 100 THEN 1.0 ELSE 0.0 END) > 0.08 AS saturated FROM sc""")
def saturation_rate(spark, sf_dir):
    """A24."""
    s = M.saturation_rate(M.temperature_scores(window_deals(spark, sf_dir), NOW))
    return s.select(r(F.col("rate"), 6).alias("rate"), "saturated")


@query("mean_gap", f"""{D}, {score_sql()}, {REPORT}
SELECT round(max(tm) - min(tm), 5) AS gap, count(*) FILTER ("count" < 20) AS small_samples, max(tm) - min(tm) <= 8 AS stable FROM rep WHERE "count" > 0""")
def mean_gap(spark, sf_dir):
    """A25."""
    rep = M.source_report(M.temperature_scores(window_deals(spark, sf_dir), NOW), LISTED)
    return M.mean_gap(rep).select(r(F.col("gap"), 5).alias("gap"), "small_samples", "stable")


SNAP = N.SNAPSHOT_METRICS


def _summary_sql(values: str, keys: str) -> str:
    qs = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for n, p in N.SNAPSHOT_PROBS.items())
    return f"""SELECT {keys}, count(*) AS sample_count, round(avg(v), 4) + 0.0 AS mean, round(var_pop(v), 4) AS variance, round(stddev_pop(v), 4) AS stddev,
  round(min(v), 4) + 0.0 AS min, {qs}, round(max(v), 4) AS max, round(avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END), 4) AS nonzero_rate
FROM {values} GROUP BY ALL"""


def _snap_long(t: str, extra: str = "", metrics=SNAP) -> str:
    return " UNION ALL ".join(f"SELECT source{extra}, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM {t}" for m in metrics)


@query("numeric_summary", f"{oracle_with('v_deals')}, l AS ({_snap_long('v_deals')}) {_summary_sql('l', 'source, metric')}")
def numeric_summary(spark, sf_dir):
    """A1, A2 over all deals."""
    return N.summarize_numeric(view(spark, sf_dir, "v_deals"), SNAP, ["source"])


@query("temperature_snapshot", f"""{D}, l AS ({_snap_long('d')}
  UNION ALL SELECT source, 'age_hours', greatest(0, (epoch_us(TIMESTAMP '2024-01-31 00:47:12') - epoch_us(registered_at)) / 3.6e9) FROM d)
SELECT s.*, '2024-01-31 00:30:00.000000' AS captured_at, 2 AS model_version FROM ({_summary_sql('l', 'source, metric')}) s""")
def temperature_snapshot(spark, sf_dir):
    """One capture of the window, age included."""
    snap = N.temperature_snapshot(window_deals(spark, sf_dir), "2024-01-31 00:47:12", SOURCES)
    return snap.withColumn("captured_at", ts_text("captured_at"))


@query("snapshot_map", f"""{D}, l AS ({_snap_long('d')})
SELECT source, count(*) AS sample_count, round(avg(views), 4) AS views_mean, round(quantile_cont(comments, 0.9), 4) AS comments_p90,
  '2024-01-31 00:30:00.000000' AS captured_at FROM d GROUP BY source""")
def snapshot_map(spark, sf_dir):
    """A3 as stored: one row per source and capture with the statistics in a map."""
    rows = N.snapshot_rows(N.temperature_snapshot(window_deals(spark, sf_dir), "2024-01-31 00:47:12", SOURCES))
    return rows.select(
        "source", "sample_count", F.col("metrics")["views"]["mean"].alias("views_mean"),
        F.col("metrics")["comments"]["p90"].alias("comments_p90"), ts_text("captured_at").alias("captured_at"))


BUCKET = "time_bucket(INTERVAL 30 MINUTE, registered_at)"


@query("snapshot_30min", f"""{oracle_with('v_deals')}, b AS (SELECT *, {sql_ts(BUCKET)} AS captured_at FROM v_deals), l AS ({_snap_long('b', ', captured_at')})
{_summary_sql('l', 'source, captured_at, metric')}""")
def snapshot_30min(spark, sf_dir):
    """A3 per half-hour of registration (R6 batch twin)."""
    return N.snapshot_series(view(spark, sf_dir, "v_deals"), SNAP).withColumn("captured_at", ts_text("captured_at"))


SERIES = f"""s AS (SELECT source, {BUCKET} AS captured_at, avg(views) AS views, avg(comments) AS comments FROM v_deals GROUP BY ALL),
top AS (SELECT source, max(captured_at) AS lat, count(*) AS snapshots FROM s GROUP BY source),
prev AS (SELECT s.source, max(s.captured_at) AS pat FROM s JOIN top USING (source) WHERE s.captured_at <= top.lat - INTERVAL 20 HOUR GROUP BY s.source),
tr AS (SELECT top.source, snapshots, lat, pat, a.views av, a.comments ac, p.views pv, p.comments pc FROM top JOIN s a ON a.source = top.source AND a.captured_at = lat
  LEFT JOIN prev ON prev.source = top.source LEFT JOIN s p ON p.source = top.source AND p.captured_at = pat)"""


def _series(spark, sf_dir):
    d = view(spark, sf_dir, "v_deals")
    return d.groupBy("source", bucket_30min(F.col("registered_at")).alias("captured_at")).agg(
        F.avg("views").alias("views"), F.avg("comments").alias("comments"))


@query("snapshot_trend_asof", f"""{oracle_with('v_deals')}, {SERIES}
SELECT source, snapshots, {sql_ts('lat')} AS latest_at, {sql_ts('pat')} AS previous_at, round(av, 5) AS latest_views, round(pv, 5) AS previous_views FROM tr""")
def snapshot_trend_asof(spark, sf_dir):
    """J15, W12."""
    t = N.snapshot_trend(_series(spark, sf_dir), ["views", "comments"])
    return t.select(
        "source", "snapshots", ts_text("latest.captured_at").alias("latest_at"), ts_text("previous.captured_at").alias("previous_at"),
        r(F.col("latest.views"), 5).alias("latest_views"), r(F.col("previous.views"), 5).alias("previous_views"))


@query("metric_delta", f"""{oracle_with('v_deals')}, {SERIES}
SELECT source, 'views' AS metric, round(av - pv, 5) + 0.0 AS delta FROM tr UNION ALL SELECT source, 'comments', round(ac - pc, 5) + 0.0 FROM tr""")
def metric_delta(spark, sf_dir):
    """W13."""
    t = N.metric_delta(N.snapshot_trend(_series(spark, sf_dir), ["views", "comments"]), ["views", "comments"])
    return t.withColumn("delta", r(F.col("delta"), 5))


@query("model_report", f"""{D}, {score_sql()}, {REPORT}, {SERIES}
SELECT section, source, metric, round(value, 4) + 0.0 AS value FROM (
  SELECT 'source' section, source, unnest(['count', 'temperature_mean', 'temperature_p50', 'temperature_p90', 'temperature_max', 'negative_cap_rate', 'contaminated']) metric,
    unnest(["count"::DOUBLE, tm, t5, t9, tx, ncr, con::INT::DOUBLE]) AS value FROM rep
  UNION ALL SELECT 'balance', '', unnest(['gap', 'stable', 'small_samples']), unnest([max(tm) - min(tm), (max(tm) - min(tm) <= 8)::INT::DOUBLE, (count(*) FILTER ("count" < 20))::DOUBLE])
    FROM rep WHERE "count" > 0
  UNION ALL SELECT 'top', source, 'deals', count(*)::DOUBLE FROM (SELECT * FROM sc ORDER BY temperature DESC, id LIMIT 20) GROUP BY source
  UNION ALL SELECT 'saturation', '', unnest(['rate', 'saturated']), unnest([avg(CASE WHEN temperature >= 100 THEN 1.0 ELSE 0.0 END)::DOUBLE, (avg(CASE WHEN temperature >= 100 THEN 1.0 ELSE 0.0 END) > 0.08)::INT::DOUBLE]) FROM sc
  UNION ALL SELECT 'trend', source, 'views', av - pv FROM tr UNION ALL SELECT 'trend', source, 'comments', ac - pc FROM tr)""")
def model_report(spark, sf_dir):
    """M8."""
    trend = N.metric_delta(N.snapshot_trend(_series(spark, sf_dir), ["views", "comments"]), ["views", "comments"])
    rep = M.model_report(M.temperature_scores(window_deals(spark, sf_dir), NOW), trend, LISTED)
    return rep.withColumn("value", r(F.col("value"), 4))


@query("snapshot_merge", f"""{oracle_with('v_deals')}, s AS (SELECT source, {BUCKET} AS captured_at, count(*) AS sample_count FROM v_deals GROUP BY ALL),
n AS (SELECT source, {BUCKET} AS captured_at, count(*) AS sample_count FROM v_deals WHERE id % 2 = 0 AND registered_at >= TIMESTAMP '2024-01-25' GROUP BY ALL)
SELECT source, {sql_ts('captured_at')} AS captured_at, coalesce(n.sample_count, s.sample_count) AS sample_count FROM s LEFT JOIN n USING (source, captured_at)""")
def snapshot_merge(spark, sf_dir):
    """Re-captured buckets replace the stored ones."""
    d = view(spark, sf_dir, "v_deals")

    def counts(rows):
        return rows.groupBy("source", bucket_30min(F.col("registered_at")).alias("captured_at")).agg(
            F.count(F.lit(1)).alias("sample_count"))

    late = d.where("id % 2 = 0").where(F.col("registered_at") >= F.lit("2024-01-25").cast("timestamp"))
    return N.upsert_snapshots(counts(d), counts(late)).withColumn("captured_at", ts_text("captured_at"))


@query("snapshot_retention", f"""{oracle_with('v_deals')}, s AS (SELECT source, {BUCKET} AS captured_at, count(*) AS sample_count FROM v_deals GROUP BY ALL)
SELECT source, {sql_ts('captured_at')} AS captured_at, sample_count FROM s WHERE captured_at >= TIMESTAMP '2024-01-31 00:12:00' - INTERVAL 7 DAY""")
def snapshot_retention(spark, sf_dir):
    """The midnight run keeps seven days."""
    d = view(spark, sf_dir, "v_deals")
    s = d.groupBy("source", bucket_30min(F.col("registered_at")).alias("captured_at")).agg(F.count(F.lit(1)).alias("sample_count"))
    return N.expire_snapshots(s, "2024-01-31 00:12:00", 3).withColumn("captured_at", ts_text("captured_at"))


@query("feed_health", f"""{oracle_with('v_deals')}, m AS (SELECT * FROM (VALUES ('click', true, TIMESTAMP '2024-01-30 23:10:30'), ('error', true, TIMESTAMP '2024-01-30 20:00:00'),
  ('purchase', true, NULL), ('refund', true, TIMESTAMP '2024-01-30 23:59:00'), ('absent', false, NULL)) t(source, feed_exists, generated_at)),
c AS (SELECT source, count(*) AS items FROM v_deals GROUP BY source)
SELECT source, coalesce(items, 0) AS items, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(generated_at)) / 6e7) AS BIGINT) AS age_minutes,
  CASE WHEN NOT feed_exists THEN 'missing' WHEN coalesce(items, 0) = 0 THEN 'empty' WHEN generated_at IS NULL THEN 'unknown'
       WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(generated_at) >= 181 * 60000000::BIGINT THEN 'stale' ELSE 'ok' END AS label
FROM m LEFT JOIN c USING (source)""")
def feed_health(spark, sf_dir):
    """A19."""
    meta = spark.createDataFrame(
        [("click", True, "2024-01-30 23:10:30"), ("error", True, "2024-01-30 20:00:00"), ("purchase", True, None),
         ("refund", True, "2024-01-30 23:59:00"), ("absent", False, None)],
        "source string, feed_exists boolean, generated_at string",
    ).withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    return N.feed_health(view(spark, sf_dir, "v_deals"), meta, NOW).select("source", "items", "age_minutes", "label")


@query("latest_by_source", f"""{oracle_with('v_existing')}
SELECT source, count(*) AS items, {sql_ts('max(updated_at)')} AS latest_updated_at, {sql_ts('max(registered_at)')} AS latest_registered_at FROM v_existing GROUP BY source""")
def latest_by_source(spark, sf_dir):
    """A20."""
    out = N.latest_by_source(view(spark, sf_dir, "v_existing"))
    return out.withColumn("latest_updated_at", ts_text("latest_updated_at")).withColumn(
        "latest_registered_at", ts_text("latest_registered_at"))


@query("day_counts", f"""{oracle_with('v_deals')}
SELECT source, count(*) FILTER (CAST(registered_at + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-30') AS today,
  count(*) FILTER (CAST(registered_at + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-29') AS yesterday, count(*) AS total FROM v_deals GROUP BY source""")
def day_counts(spark, sf_dir):
    """Seoul dates."""
    return N.day_counts(view(spark, sf_dir, "v_deals"), "2024-01-30 06:00:00", ["source"])


@query("repeated_values", """SELECT text AS title, count(*) AS uses FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) >= 3""")
def repeated_values(spark, sf_dir):
    """A22."""
    titled = table(spark, sf_dir, "documents").select(F.col("text").alias("title"))
    return N.repeated_values(titled, "title")


@query("feed_quality_gate", f"""{oracle_with('v_deals')}
SELECT count(*) AS items, count(*) FILTER (source <> 'click') AS wrong_source, count(*) FILTER (id % 97 = 0) AS malformed,
  count(*) FILTER (id % 97 <> 0 AND {W}) AS recent,
  CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (source <> 'click') > 0 THEN 'wrong_source' WHEN count(*) FILTER (id % 97 <> 0 AND {W}) = 0 THEN 'no_recent'
       WHEN count(*) FILTER (id % 97 = 0) > 0 THEN 'malformed' ELSE 'ok' END AS verdict
FROM v_deals WHERE source = 'click'""")
def feed_quality_gate(spark, sf_dir):
    """One source's feed; every 97th row has lost its offset."""
    d = view(spark, sf_dir, "v_deals").where("source = 'click'")
    iso = F.date_format("registered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    items = d.withColumn("registered_at", F.when(F.col("id") % 97 == 0, iso).otherwise(F.concat(iso, F.lit("Z"))))
    return N.feed_quality_gate(items, "click", NOW, r"^https?://board\.example/click/views/[0-9]+$")
