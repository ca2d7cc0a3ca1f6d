"""Versions written partition by partition."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide.operators import sync as Y
from pricetide.session import work_path
from pricetide.sources import tables
from pricetide.streaming import jobs as J

BY = ["pmod(k, 8)"]
SCHEMA = "k int, v long"


def rows(spark, root):
    return sorted((r.k, r.v) for r in tables.read_current(spark, root).collect())


def parts(spark, root):
    newest = tables.versions(spark, root)[-1]
    return {tables._label_of(p): p for p in tables._listed(spark, newest)["parts"]}


def change(new):
    """Rows of ``new`` replace the stored ones of their key; a null value removes."""
    def plan(stored):
        return stored.join(new, "k", "left_anti").unionByName(new.where("v IS NOT NULL"))
    return plan


def test_untouched_partitions_keep_their_folders(spark):
    root = work_path(spark, "t")
    tables.publish(spark.range(80).selectExpr("CAST(id AS INT) AS k", "id AS v"), root, BY)
    before = parts(spark, root)
    assert len(before) == 8
    seen = []

    def plan(stored):
        seen.append({r.k % 8 for r in stored.collect()})
        return change(new)(stored)
    new = spark.createDataFrame([(3, -1), (11, None), (81, 7)], SCHEMA)
    assert tables.update(spark, root, plan, BY, touches=lambda stored: new) == 2
    after = parts(spark, root)
    assert seen == [{3, 1}]
    assert {k for k in after if after[k] != before.get(k)} == {"p~3", "p~1"}
    assert rows(spark, root) == sorted([(k, k) for k in range(80) if k not in (3, 11)] + [(3, -1), (81, 7)])


def test_random_changes_against_a_dict_with_expiry_after_each(spark):
    root, want, rng = work_path(spark, "t"), {}, random.Random(5)
    tables.publish(spark.createDataFrame([], SCHEMA), root, BY)
    for step in range(6):
        batch = {rng.randrange(40): rng.choice([None, step]) for _ in range(4)}
        new = spark.createDataFrame(list(batch.items()), SCHEMA)
        tables.update(spark, root, change(new), BY, touches=lambda stored: new)
        want = {k: v for k, v in {**want, **batch}.items() if v is not None}
        tables.expire_versions(spark, root, 1)
        assert rows(spark, root) == sorted(want.items()) and len(tables.versions(spark, root)) == 1
    live = {p.split("/")[0] for p in parts(spark, root).values()} | {tables.versions(spark, root)[-1].path.rsplit("/", 1)[1]}
    assert tables.folders(spark, root) == len(live) + 1  # folders nothing refers to are gone; the claims stay


def test_added_rows_may_land_beside_carried_ones_and_are_put_together_later(spark, monkeypatch):
    monkeypatch.setattr(tables, "MAX_PIECES", 2)
    root = work_path(spark, "t")
    tables.publish(spark.createDataFrame([(0, 0), (1, 1)], SCHEMA), root, BY)
    for i in range(1, 5):
        fresh = spark.createDataFrame([(8 * i, i)], SCHEMA)
        tables.update(spark, root, lambda stored: stored.unionByName(fresh), BY, touches=lambda stored: stored.limit(0))
    newest = tables._listed(spark, tables.versions(spark, root)[-1])["parts"]
    assert sum(tables._label_of(p) == "p~0" for p in newest) <= 3
    assert rows(spark, root) == [(0, 0), (1, 1), (8, 1), (16, 2), (24, 3), (32, 4)]


def test_odd_partition_values_other_partitions_and_other_columns(spark):
    root = work_path(spark, "t")
    odd = [("a/b c%", 1), ("", 2), (None, 3), ("{x}*[y]", 4), ("가", 5)]
    tables.publish(spark.createDataFrame(odd, "s string, v int"), root, ["s"])
    new = spark.createDataFrame([("a/b c%", 9), (None, 8)], "s string, v int")
    tables.update(spark, root, lambda stored: stored.where("v NOT IN (1, 3)").unionByName(new), ["s"], touches=lambda stored: new)
    want = {("a/b c%", 9), ("", 2), (None, 8), ("{x}*[y]", 4), ("가", 5)}
    assert set(map(tuple, tables.read_current(spark, root).collect())) == want
    with pytest.raises(ValueError, match="other columns"):
        tables.update(spark, root, lambda stored: stored.withColumn("w", F.lit(1)), ["s"], touches=lambda stored: new)
    tables.update(spark, root, lambda stored: stored.withColumn("w", F.lit(1)), ["v % 2"], touches=lambda stored: stored)  # a new layout: whole
    assert {(r.s, r.v, r.w) for r in tables.read_current(spark, root).collect()} == {(*x, 1) for x in want}


def test_the_slower_of_two_writers_plans_again_from_the_newer_partitions(spark):
    root = work_path(spark, "t")
    tables.publish(spark.createDataFrame([(0, 0), (1, 1), (2, 2)], SCHEMA), root, BY)
    other = spark.createDataFrame([(0, 10), (1, 11)], SCHEMA)
    mine = spark.createDataFrame([(1, 21)], SCHEMA)
    planned = []

    def plan(stored):
        if not planned:
            tables.update(spark, root, change(other), BY, touches=lambda s: other)
        planned.append(sorted((r.k, r.v) for r in stored.collect()))
        return change(mine)(stored)
    assert tables.update(spark, root, plan, BY, touches=lambda s: mine) == 3
    assert planned == [[(1, 1)], [(1, 11)]] and rows(spark, root) == [(0, 10), (1, 21), (2, 2)]


def test_a_replayed_batch_changes_no_partition(spark):
    root, source, checkpoint = (work_path(spark, n) for n in ("t", "s", "c"))
    tables.publish(spark.createDataFrame([(5, 1)], SCHEMA), root, BY)

    def merge(stored, batch):
        return stored.unionByName(batch).groupBy("k").agg(F.sum("v").alias("v"))
    sink = J.upsert_sink(root, merge, checkpoint, BY, lambda stored, batch: batch)
    for k in (0, 1, 8):
        spark.createDataFrame([(k, 1)], SCHEMA).write.mode("append").parquet(source)
        spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    before = parts(spark, root)
    sink(spark.createDataFrame([(8, 1)], SCHEMA), 2)
    assert parts(spark, root) == before and rows(spark, root) == [(0, 1), (1, 1), (5, 1), (8, 1)]


def test_affected_rows_are_all_that_a_plan_changes(spark):
    at = dt.datetime(2026, 5, 29)
    stored = spark.createDataFrame(
        [("a", "1", "s", "l1", None), ("old", "2", "s", "l2", None), ("c", "3", "s", "l3", None), ("d", None, "s", "l4", None),
         ("e", "5", "user", "l5", at), ("f", "6", None, "l6", at), ("g", "7", "s", "l7", None)],
        "key string, id string, source string, source_link string, deleted_at timestamp")
    plan = spark.createDataFrame([("update", "b", "old"), ("unchanged", "a", "a"), ("insert", "n", None)], "action string, key string, prev_key string")
    deletes = spark.createDataFrame([("3", "s", "l3"), (None, "s", "l4")], "id string, source string, source_link string")
    assert {r.key for r in Y.affected_rows(stored, plan, deletes).collect()} == {"old", "c", "d", "f"}
