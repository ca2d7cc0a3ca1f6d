"""Properties of the popularity model and values of the snapshots."""

import datetime as dt

from pyspark.sql import functions as F

from pricetide.operators import snapshots as N
from pricetide.operators import temperature as M

NOW = "2026-08-27 12:00:00"
AT = dt.datetime(2026, 8, 27, 10, tzinfo=dt.timezone.utc)
SCHEMA = ("id string, source string, price string, views int, comments int, likes int, dislikes int, "
          "comment_signal_score int, negative_comment_signals int, registered_at timestamp")


def deals(spark, rows):
    base = {"price": "1,000원", "views": 0, "comments": 0, "likes": 0, "dislikes": 0, "comment_signal_score": 0,
            "negative_comment_signals": 0, "registered_at": AT}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMA)


def scores(spark, rows):
    return {r["id"]: r["temperature"] for r in M.temperature_scores(deals(spark, rows), NOW).select("id", "temperature").collect()}


def test_negative_rows_stop_at_50(spark):
    got = scores(spark, [
        {"id": "good", "source": "a", "views": 100, "comments": 1},
        {"id": "warned", "source": "a", "price": "무료", "views": 999999, "comments": 999, "likes": 999, "negative_comment_signals": 3},
        {"id": "disliked", "source": "a", "views": 999999, "comments": 999, "likes": 999, "dislikes": 3}])
    assert got["warned"] <= 50 and got["disliked"] <= 50


def test_contaminated_source_is_not_capped(spark):
    rows = [{"id": str(i), "source": "old", "views": 100 + i * 100, "comments": i, "negative_comment_signals": 5, "comment_signal_score": -60} for i in range(20)]
    assert M.source_profile(deals(spark, rows)).first()["contaminated"]
    assert max(scores(spark, rows).values()) > 50


def test_scale_balance_with_reward_for_size(spark):
    rows = []
    for i in range(20):
        rows.append({"id": f"s{i}", "source": "small", "views": 100 + i * 25, "comments": i % 6})
        rows.append({"id": f"l{i}", "source": "large", "views": (100 + i * 25) * 20, "comments": (i % 6) * 20})
    got = scores(spark, rows)
    small, large = [[v for k, v in got.items() if k[0] == c] for c in "sl"]
    assert abs(sum(large) / 20 - sum(small) / 20) <= 12
    assert max(large) >= max(small) + 5


def test_only_covered_metrics_count(spark):
    rows = []
    for i in range(20):
        rows.append({"id": f"f{i}", "source": "f", "likes": i % 11})
        rows.append({"id": f"r{i}", "source": "r", "views": 9000 if i < 2 else 0, "comments": i + 1})
    got = {r["source"]: r for r in M.source_profile(deals(spark, rows)).collect()}
    assert (got["f"]["views_usable"], got["f"]["likes_usable"]) == (False, True)
    assert (got["r"]["views_usable"], got["r"]["comments_usable"]) == (False, True)


def test_outlier_leaves_ordinary_rows(spark):
    rows = [{"id": str(i), "source": "s", "views": 100000 if i == 19 else 100 + i * 10} for i in range(20)]
    got = scores(spark, rows)
    assert 40 <= got["9"] <= 60 and got["19"] >= 95


def test_free_deals_are_lifted(spark):
    rows = [{"id": str(i), "source": "s", "views": 10 + i, "price": " 무료 " if i == 0 else "1원"} for i in range(12)]
    assert scores(spark, rows)["0"] >= 80


def test_external_population(spark):
    rows = [{"id": str(i), "source": "s", "views": 100 + i * 10} for i in range(20)]
    page = [{"id": "low", "source": "s", "views": 1}, {"id": "high", "source": "s", "views": 10 ** 6}, {"id": "new", "source": "t"}]
    got = {r["id"]: r["source_pct"] for r in M.scores_external(deals(spark, page), deals(spark, rows), NOW).collect()}
    assert got["low"] == 0.0 and got["high"] > 100 and got["new"] == 50.0


def test_snapshot_values(spark):
    rows = deals(spark, [
        {"id": "1", "source": "a", "views": 100, "comments": 0, "registered_at": dt.datetime(2026, 5, 29, 9, 47, tzinfo=dt.timezone.utc)},
        {"id": "2", "source": "a", "views": 300, "comments": 4, "registered_at": dt.datetime(2026, 5, 29, 6, 47, tzinfo=dt.timezone.utc)},
        {"id": "3", "source": "zzz", "views": 9}])
    got = {r["metric"]: r for r in N.temperature_snapshot(rows, "2026-05-29 09:47:00", ["a", "b"]).collect()}
    assert (got["views"]["mean"], got["views"]["variance"], got["views"]["p50"]) == (200.0, 10000.0, 200.0)
    assert got["comments"]["nonzero_rate"] == 0.5 and got["age_hours"]["mean"] == 1.5
    assert got["views"]["captured_at"].strftime("%H:%M") == "09:30"
    row = N.snapshot_rows(N.temperature_snapshot(rows, "2026-05-29 09:47:00", ["a", "b"])).first()
    assert row["sample_count"] == 2 and row["metrics"]["views"]["mean"] == 200.0


def test_snapshot_population(spark):
    def at(hours):
        return dt.datetime(2026, 5, 29, 12, tzinfo=dt.timezone.utc) - dt.timedelta(hours=hours)
    schema = "key string, id int, source string, views int, registered_at timestamp, deleted_at timestamp, pos int"
    existing = spark.createDataFrame([
        ("k1", 1, "a", 100, at(1), None, 1), ("k2", 2, "a", 300, at(2), None, 2), ("k3", 3, "a", 5, at(1), at(0), 3), ("k4", 4, "a", 5, at(60), None, 4),
        ("k5", 5, "a", 5, at(-1), None, 5), ("k6", 6, "b", 5, at(1), None, 6), ("k7", 7, "a", 5, None, None, 7), ("k8", 8, "a", 5, at(1), None, 8)], schema)
    changed = spark.createDataFrame([("k1", 1, "a", 150, at(1), None, 9), ("k9", 9, "a", 7, at(1), None, 10)], schema)
    out = N.snapshot_population(changed, existing, changed, existing.where("id = 8"), "2026-05-29 12:00:00")
    assert {r["id"]: r["views"] for r in out.collect()} == {1: 150, 2: 300, 9: 7}


def test_trend_and_delta(spark):
    def at(h):
        return dt.datetime(2026, 5, 29, h % 24, tzinfo=dt.timezone.utc) + dt.timedelta(days=h // 24)
    s = spark.createDataFrame([("a", at(0), 1.0), ("a", at(3), 2.0), ("a", at(10), 4.0), ("a", at(23), 9.0), ("b", at(5), 1.0)], "source string, captured_at timestamp, views double")
    got = {r["source"]: r["delta"] for r in N.metric_delta(N.snapshot_trend(s, ["views"]), ["views"]).collect()}
    assert got == {"a": 7.0, "b": None}


def test_quality_gate_precedence(spark):
    ok = ("x", "2026-08-27T11:00:00Z", "https://b.example/views/1")
    cases = {
        "empty": [], "wrong_source": [ok, ("y", *ok[1:])], "no_recent": [("x", "2026-08-20T11:00:00Z", ok[2]), ("x", "2026-08-27T11:00:00", ok[2])],
        "malformed": [ok, ("x", "2026-08-27T11:00:00", ok[2])], "ok": [ok, ("x", "2026-08-25T12:00:00Z", ok[2]), ("x", "2026-08-27T12:10:00+00:00", ok[2])]}
    for verdict, rows in cases.items():
        df = spark.createDataFrame(rows, "source string, registered_at string, source_link string")
        got = N.feed_quality_gate(df, "x", NOW, r"^https?://b\.example/views/[0-9]+$").first()
        assert got["verdict"] == verdict
        if verdict == "ok":
            assert got["recent"] == 3


def test_expire_only_at_midnight(spark):
    s = spark.createDataFrame([(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc),)], "captured_at timestamp")
    assert N.expire_snapshots(s, "2026-08-27 00:10:00").count() == 0
    assert N.expire_snapshots(s, "2026-08-27 12:10:00").count() == 1
    assert M.manual_rows(spark.createDataFrame([(0.0,)], "manual_temperature double")).select(F.col("temperature")).first()[0] == 100
