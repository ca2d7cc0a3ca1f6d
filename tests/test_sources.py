"""Feed files, table versions and the whole refresh run."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricetide.plans.refresh import PAYLOAD, refresh
from pricetide.sources import feeds, tables

NOW = "2026-05-29 01:00:00"


def item(i, source="beta", **kw):
    return {"title": f"deal {i}", "source": source, "sourceLink": f"https://beta.example/board/sale/views/{i}?page=2",
            "registeredAt": "2026-05-29T09:30:00+09:00", "views": i, "price": "1,000원", **kw}


def write(path, name, **doc):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")


def test_items_fall_back_to_today_and_flags(spark, tmp_path):
    d = tmp_path / "feeds"
    write(d, "a", sourceKey="beta", staleFallback=True, items=[item(1), item(2)])
    write(d, "b", sourceKey="delta", partialSnapshot=True, grouped={"today": [item(3, "delta")], "yesterday": []})
    write(d, "c", sourceKey="gamma", items=[])
    (d / "broken.json").write_text("{not json", encoding="utf-8")
    items, meta = feeds.read_feed_json(spark, str(d))
    assert sorted(r["title"] for r in items.collect()) == ["deal 1", "deal 2", "deal 3"]
    flags = {r["source"]: (r["delete_protected"], r["stale"]) for r in feeds.feed_protection_flags(meta).collect()}
    assert flags == {"beta": (True, True), "delta": (True, False), "gamma": (False, False)}


def test_positions_follow_file_and_list(spark, tmp_path):
    d = tmp_path / "feeds"
    write(d, "a", sourceKey="beta", items=[item(5), item(4)])
    write(d, "b", sourceKey="beta", items=[item(3)])
    items, _ = feeds.read_feed_json(spark, str(d))
    assert [r["title"] for r in items.orderBy("pos").collect()] == ["deal 5", "deal 4", "deal 3"]


def test_snapshot_replaces_only_written_sources(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([("a", 1, dt.datetime(2026, 5, 29)), ("b", 2, dt.datetime(2026, 5, 28))], "source string, id int, registered_at timestamp")
    feeds.write_feed_snapshot(rows, path, NOW)
    feeds.write_feed_snapshot(rows.where("source = 'a'").withColumn("id", F.lit(9)), path, NOW)
    back = {r["source_key"]: (r["id"], r["feed_day"]) for r in spark.read.json(path).collect()}
    assert back == {"a": (9, "today"), "b": (2, "yesterday")}


def test_unfinished_version_is_invisible(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert tables.current_version(spark, root) == 0
    assert tables.publish(spark.range(3), root) == 1
    (tmp_path / "t" / "v000000002").mkdir()
    assert tables.current_version(spark, root) == 1 and tables.read_current(spark, root).count() == 3


def test_stored_deals_prune(spark, tmp_path):
    path = f"{tmp_path}/deals"
    rows = spark.createDataFrame([("a", 1, dt.datetime(2026, 5, 1)), ("b", 2, dt.datetime(2026, 5, 2))], "source string, id int, registered_at timestamp")
    tables.write_deals(rows, path)
    df = tables.read_deals(spark, path, ["id"], (F.col("source") == "b") & (F.col("registered_at") > F.lit("2026-05-01").cast("timestamp")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "GreaterThan(registered_at" in plan
    assert [r["id"] for r in df.collect()] == [2]


@pytest.fixture
def stored(spark, tmp_path):
    kinds = {"likes": "int", "dislikes": "int", "views": "int", "comments": "int", "comment_signal_score": "int",
             "positive_comment_signals": "int", "negative_comment_signals": "int", "registered_at": "timestamp"}
    schema = "key string, id string, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in PAYLOAD) + ", updated_at timestamp, deleted_at timestamp"
    at = dt.datetime(2026, 5, 29, 0, 30, tzinfo=dt.timezone.utc)

    def row(i, views, deleted=None, when=at):
        base = {c: (0 if kinds.get(c) == "int" else "") for c in PAYLOAD}
        base.update(source="beta", source_post_id=str(i), source_link=f"https://beta.example/board/sale/views/{i}",
                    buy_link=f"https://beta.example/board/sale/views/{i}", title=f"deal {i}", price="1,000원", category="기타", area="게시판",
                    dist="기타", views=views, registered_at=when)
        return (f"beta::post::{i}", f"id{i}", *[base[c] for c in PAYLOAD], when, deleted)
    old = dt.datetime(2026, 5, 20, tzinfo=dt.timezone.utc)
    root = f"{tmp_path}/table"
    tables.publish(spark.createDataFrame([row(1, 1), row(2, 99), row(3, 3, at), row(4, 4), row(5, 5, None, old)], schema), root)
    return root


def test_refresh_run(spark, tmp_path, stored):
    d = tmp_path / "feeds"
    write(d, "q", sourceKey="beta", items=[item(1), item(2), item(3), item(6), item(6, title="deal 6 again"), item(7, title="블라인드 처리된 글입니다")])
    done = refresh(spark, str(d), stored, NOW)
    actions = {r["key"].split("::")[-1]: r["action"] for r in done.plan.collect()}
    assert actions == {"1": "unchanged", "2": "update", "3": "reactivate", "4": "delete_missing", "5": "delete_expired", "6": "insert"}
    table = {r["source_post_id"]: (r["views"], r["title"], r["id"]) for r in tables.read_current(spark, stored).collect()}
    assert {k: v[:2] for k, v in table.items()} == {"1": (1, "deal 1"), "2": (2, "deal 2"), "3": (3, "deal 3"), "6": (6, "deal 6 again")}
    assert table["2"][2] == "id2"
    assert sorted(r["key"][-1] for r in done.alert_candidates.collect()) == ["3", "6"]
    views = {r["metric"]: r for r in done.snapshot.collect()}["views"]
    assert (views["sample_count"], views["mean"]) == (4, 3.0)
    assert len(tables._listed(spark, tables.versions(spark, stored)[-1])["parts"]) > 0
    again = refresh(spark, str(d), stored, NOW)
    second, third = (tables._listed(spark, v)["parts"] for v in tables.versions(spark, stored)[-2:])
    assert second == third  # nothing changed, nothing was written again
    assert {r["action"] for r in again.plan.collect()} == {"unchanged"} and again.version == 3


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    """Its tasks are as many as the cores, but one of them would read every row."""
    from pricetide.plans import views

    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/f")
    (part,) = (tmp_path / "f").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    cost, most = (spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert views.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= 8
        dealt = views.text_table(spark, str(tmp_path), "documents")
        held = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(held) == 4000 and max(held) <= 1000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
