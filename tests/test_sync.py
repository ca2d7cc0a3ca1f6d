"""Change planning: guards, expiry, legacy keys, idempotence, dedup rules."""

import datetime as dt

from pyspark.sql import functions as F

from pricetide.operators import dedup as D
from pricetide.operators import sync as Y

NOW = "2026-05-29 01:00:00"
FRESH = dt.datetime(2026, 5, 29, tzinfo=dt.timezone.utc)
OLD = dt.datetime(2026, 5, 26, tzinfo=dt.timezone.utc)
ALL = ["alpha", "beta", "gamma", "delta"]
IN = "key string, legacy_key string, source string, source_link string, title string, registered_at timestamp"
EX = "key string, id int, source string, source_link string, title string, registered_at timestamp, deleted_at timestamp"


def incoming(spark, source, ids, title="t", at=FRESH):
    return spark.createDataFrame([
        (f"{source}::post::{i}", f"{source}::https://b.example/{i}", source, f"https://b.example/{i}", title, at) for i in ids], IN)


def existing(spark, rows):
    return spark.createDataFrame([
        (r.get("key") or f"{r['source']}::post::{r['i']}", r["i"], r["source"], f"https://b.example/{r['i']}", r.get("title", "t"),
         r.get("at", FRESH), r.get("deleted")) for r in rows], EX)


def plan(spark, inc, ex, **kw):
    rows = Y.plan_sync(inc, ex, NOW, kw.pop("sources", ALL), **kw).collect()
    return {r["key"]: r["action"] for r in rows}


def test_source_without_items_keeps_its_rows(spark):
    ex = existing(spark, [{"source": "alpha", "i": 1}, {"source": "gamma", "i": 2}])
    assert plan(spark, incoming(spark, "alpha", [1]), ex) == {"alpha::post::1": "unchanged", "gamma::post::2": "keep_guarded"}


def test_stale_source_keeps_its_rows(spark):
    ex = existing(spark, [{"source": "gamma", "i": 1}, {"source": "gamma", "i": 2}])
    got = plan(spark, incoming(spark, "gamma", [1]), ex, stale=["gamma"])
    assert got["gamma::post::2"] == "keep_guarded"


def test_sparse_source_is_guarded(spark):
    ex = existing(spark, [{"source": "gamma", "i": i} for i in range(100, 130)])
    got = plan(spark, incoming(spark, "gamma", [100, 101]), ex)
    assert set(got.values()) == {"unchanged", "keep_guarded"}


def test_missing_rows_are_deleted(spark):
    ex = existing(spark, [{"source": "gamma", "i": 1}])
    got = plan(spark, incoming(spark, "gamma", [2]), ex)
    assert got == {"gamma::post::2": "insert", "gamma::post::1": "delete_missing"}


def test_expired_rows_go_even_when_stale(spark):
    ex = existing(spark, [{"source": "gamma", "i": 1, "at": OLD}])
    got = plan(spark, incoming(spark, "gamma", [2]), ex, stale=["gamma"])
    assert got["gamma::post::1"] == "delete_expired"


def test_other_sources_are_left_alone(spark):
    ex = existing(spark, [{"source": "alpha", "i": 1}, {"source": "gamma", "i": 2}])
    got = plan(spark, incoming(spark, "gamma", [3]), ex, sources=["gamma"])
    assert got == {"gamma::post::3": "insert", "gamma::post::2": "delete_missing"}


def test_reactivate_update_legacy(spark):
    ex = existing(spark, [
        {"source": "beta", "i": 1, "deleted": FRESH}, {"source": "beta", "i": 2, "title": "before"},
        {"source": "beta", "i": 3, "key": "beta::https://b.example/3"}])
    got = plan(spark, incoming(spark, "beta", [1, 2, 3]), ex)
    assert got == {"beta::post::1": "reactivate", "beta::post::2": "update", "beta::post::3": "unchanged"}


def test_old_incoming_is_skipped_and_not_counted(spark):
    ex = existing(spark, [{"source": "beta", "i": 1}])
    got = plan(spark, incoming(spark, "beta", [1], at=OLD), ex)
    assert got["beta::post::1"] in ("skip_expired", "delete_missing")
    assert "unchanged" not in got.values()


def test_applying_twice_changes_nothing(spark):
    ex = existing(spark, [{"source": "beta", "i": i, "title": "a"} for i in range(5)]).withColumn("updated_at", F.col("registered_at"))
    inc = incoming(spark, "beta", [2, 3, 4, 9], title="b").withColumn("id", F.lit(77))
    payload = ["source", "source_link", "title", "registered_at"]

    def step(stored):
        p = Y.plan_sync(inc, stored, NOW, ["beta"])
        return p, Y.apply_plan(stored, inc, p, NOW, payload)

    _, once = step(ex)
    second_plan, twice = step(Y.scale.cut_lineage(once))
    assert {r["action"] for r in second_plan.collect()} == {"unchanged"}
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r["key"]: r["id"] for r in once.collect()}["beta::post::2"] == 2


def test_changed_ignores_kind_of_empty(spark):
    df = spark.createDataFrame([(None, 0, "", None), ("a", 1, "a", 2)], "n_t string, n_v int, o_t string, o_v int")
    got = [r[0] for r in df.select(Y.is_changed(df, "n_", "o_", ["t", "v"])).collect()]
    assert got == [False, True]


def test_dedup_feed_title_first_key_last(spark):
    df = spark.createDataFrame([(1, "a", "A  b", "k1"), (2, "a", "a B", "k2"), (3, "a", "c", "k1"), (4, "b", "a b", "k3")], "pos int, source string, title string, key string")
    assert sorted(r["pos"] for r in D.dedup_feed(df).collect()) == [3, 4]


def test_duplicates_keep_the_best(spark):
    rows = [(1, "k", "a", "l", "", FRESH, None), (2, "k", "a", "l", "i", OLD, None), (3, "k", "a", "l", "i", OLD, None), (4, "k", "a", "l", "i", FRESH, FRESH)]
    df = spark.createDataFrame(rows, "id int, key string, source string, source_link string, img string, updated_at timestamp, deleted_at timestamp")
    assert sorted(r["id"] for r in D.duplicate_deletes(df, ["a"]).collect()) == [1, 3]
    assert [r["id"] for r in D.pick_existing(df).collect()] == [3]


def test_merge_keeps_last_filled(spark):
    a = spark.createDataFrame([("k", "x", "1", 1)], "k string, t string, p string, pos int")
    b = spark.createDataFrame([("k", "", "2", 1), ("k", "y", None, 2)], "k string, t string, p string, pos int")
    assert tuple(D.dedup_merge_nonempty(a, b, "k", ["t", "p"]).first()) == ("k", "y", "2")


def test_row_found_by_its_legacy_key_is_rewritten_in_place(spark):
    ex = existing(spark, [{"source": "beta", "i": 3, "key": "beta::https://b.example/3", "title": "before"}]).withColumn("updated_at", F.col("registered_at"))
    inc = incoming(spark, "beta", [3], title="after").withColumn("id", F.lit(77))
    plan_ = Y.plan_sync(inc, ex, NOW, ["beta"])
    rows = Y.apply_plan(ex, inc, plan_, NOW, ["source", "source_link", "title", "registered_at"]).collect()
    assert [(r["key"], r["id"], r["title"], r["deleted_at"]) for r in rows] == [("beta::post::3", 3, "after", None)]


def test_one_stored_row_has_one_owner(spark):
    """A stored key that is the key of one new row and the legacy key of another."""
    ex = existing(spark, [{"source": "beta", "i": 1, "title": "before"}]).withColumn("updated_at", F.col("registered_at"))
    inc = incoming(spark, "beta", [1, 2], title="after").withColumn("legacy_key", F.lit("beta::post::1")).withColumn("id", F.lit(70) + F.monotonically_increasing_id())
    out = Y.apply_plan(ex, inc, Y.plan_sync(inc, ex, NOW, ["beta"]), NOW, ["source", "source_link", "title", "registered_at"])
    assert {r["key"] for r in out.collect()} == {"beta::post::1", "beta::post::2"} and out.count() == 2
