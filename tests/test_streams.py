"""Sinks and filters of the streaming jobs."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from pricetide.operators import serving as V
from pricetide.session import work_path
from pricetide.sources import tables
from pricetide.streaming import jobs as J

SCHEMA = "k int, v long"


def run(spark, source, sink, checkpoint):
    spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def merge(stored, batch):
    return stored.unionByName(batch).groupBy("k").agg(F.sum("v").alias("v"))


def test_no_batch_is_lost_beside_foreign_versions_and_none_is_doubled(spark):
    root, source, checkpoint = (work_path(spark, n) for n in ("t", "s", "c"))
    tables.publish(spark.createDataFrame([], SCHEMA), root)
    tables.publish(tables.read_current(spark, root), root)  # a table of two versions before the stream starts
    sink = J.upsert_sink(root, merge, checkpoint)
    for i in range(3):
        spark.createDataFrame([(i, 1), (9, 1)], SCHEMA).write.mode("append").parquet(source)
        run(spark, source, sink, checkpoint)
        tables.publish(tables.read_current(spark, root), root)
    want = {0: 1, 1: 1, 2: 1, 9: 3}
    assert {r.k: r.v for r in tables.read_current(spark, root).collect()} == want
    sink(spark.createDataFrame([(2, 1), (9, 1)], SCHEMA), 2)  # a replay
    assert {r.k: r.v for r in tables.read_current(spark, root).collect()} == want
    run(spark, source, J.upsert_sink(root, merge, other := work_path(spark, "c")), other)  # a fresh checkpoint is another stream
    assert {r.k: r.v for r in tables.read_current(spark, root).collect()} == {0: 2, 1: 2, 2: 2, 9: 6}
    assert tables.expire_versions(spark, root, 1) > 0 and tables.has_batch(spark, root, tables.stream_id(spark, checkpoint), 2)
    assert {r.k: r.v for r in tables.read_current(spark, root).collect()} == {0: 2, 1: 2, 2: 2, 9: 6}


def test_ledger_survives_a_fresh_checkpoint(spark):
    root, source = work_path(spark, "l"), work_path(spark, "s")
    spark.createDataFrame([(1, 5), (1, 5), (2, 6)], SCHEMA).write.parquet(source)
    for _ in range(2):
        checkpoint = work_path(spark, "c")
        pairs = spark.readStream.schema(SCHEMA).parquet(source).select(F.col("k").alias("deal_id"), F.col("v").alias("uid"))
        pairs.writeStream.foreachBatch(J.ledger_sink(root, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(root).select("deal_id", "uid").collect())) == [(1, 5), (2, 6)]


@pytest.mark.parametrize("replay", [False, True])
def test_late_and_early_rows_go(spark, replay):
    now = dt.datetime.now()
    rows = [(1, now - dt.timedelta(hours=1)), (2, now - dt.timedelta(hours=60)), (3, now + dt.timedelta(hours=1)), (4, dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id int, registered_at timestamp").withColumn("seen", F.current_timestamp())
    assert [r.id for r in J.late_and_future_filter(df, "seen" if replay else None).collect()] == [1]


def test_comment_cycles_end(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "z"), ("u", "t"), ("self", "self"), ("lost", "nobody")]
    got = {r.id: (r.root_id, r.depth) for r in V.comment_depths(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert got == {
        "a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "z": ("x", 1), "y": ("x", 2), "t": ("x", 2), "u": ("x", 3), "self": ("self", 0), "lost": ("lost", 0)}


def test_long_chain(spark):
    rows = [(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(300)]
    got = {r.id: r.depth for r in V.comment_depths(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert got == {f"{i:04d}": i for i in range(300)}


EVENTS = "id int, source string, views long, registered_at timestamp"


def feed(spark, source, rows):
    df = spark.createDataFrame(rows, "id int, source string, views long, s long").withColumn("registered_at", F.timestamp_seconds(F.col("s") + 1_700_006_400)).drop("s")
    df.coalesce(1).write.mode("append").parquet(source)


def drive(stream, sink, checkpoint):
    stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_half_hours_are_counted_across_restarts(spark):
    """A hot source; every run is a new query on the old checkpoint."""
    root, source, checkpoint = (work_path(spark, n) for n in ("r", "s", "c"))
    runs = [[(i, "hot" if i % 3 else "b", (i * 7) % 13, at + i % 1800) for i in range(at // 10, at // 10 + 300)] for at in (0, 900, 5400, 9000, 20000)]
    for rows in runs:
        feed(spark, source, rows)
        drive(J.value_counts_stream(spark.readStream.schema(EVENTS).parquet(source), ["views"], "30 minutes"), J.snapshot_sink(root, checkpoint), checkpoint)
    rows = [r for run in runs for r in run]
    slots = {}
    for _, name, views, at in rows:
        slots.setdefault((name, at // 1800), []).append(views)
    latest = max(r[3] for r in rows)
    want = {k: v for k, v in slots.items() if (k[1] + 1) * 1800 <= latest - 1800}
    got = {(r.source, (int(r.captured_at.timestamp()) - 1_700_006_400) // 1800): r for r in spark.read.parquet(root).collect()}
    assert got.keys() == want.keys() and len(want) >= 6 and spark.read.parquet(root).count() == len(want)
    for key, values in want.items():
        r = got[key]
        assert (r.sample_count, r.min, r.max, r.p50) == (len(values), min(values), max(values), statistics.median(values))
        assert abs(r.mean - statistics.fmean(values)) < 1e-4 and abs(r.variance - statistics.pvariance(values)) < 1e-4


def test_open_half_hours_are_read_from_the_state(spark):
    """Closed and open half hours together hold every row."""
    root, source, checkpoint = (work_path(spark, n) for n in ("r", "s", "c"))
    rows = [(i, "a" if i % 3 else "b", i % 7, i * 60) for i in range(240)]
    feed(spark, source, rows)
    drive(J.value_counts_stream(spark.readStream.schema(EVENTS).parquet(source), ["views", "id"], "1 hour"), J.snapshot_sink(root, checkpoint), checkpoint)
    closed = spark.read.parquet(root).groupBy("metric").agg(F.sum("sample_count").alias("n"))
    still_open = J.open_counts(spark, checkpoint)
    assert {r.metric: r.n for r in closed.collect()} == {"views": 150, "id": 150}
    assert sorted({int(r.captured_at.timestamp() - 1_700_006_400) // 1800 for r in still_open.collect()}) == [5, 6, 7]
    got = {(r.source, r.metric, r.value): r.n for r in still_open.groupBy("source", "metric", "value").agg(F.sum("n").alias("n")).collect()}
    late = [r for r in rows if r[3] >= 5 * 1800]
    assert sum(n for (_, metric, _), n in got.items() if metric == "id") == len(late) == 90
    assert all(n == sum(1 for r in late if (r[1], r[2]) == (source, value)) for (source, metric, value), n in got.items() if metric == "views")


def test_classes_of_subscriptions_count_like_their_members(spark):
    terms, deals = work_path(spark, "t"), work_path(spark, "d")
    rows = [(u, ("red tv", " Red TV", "fridge")[u % 3], u != 4, 86_400 * (u % 2)) for u in range(30)]
    subs = spark.createDataFrame(rows + rows[:5], "uid int, term string, enabled boolean, s int").withColumn("since", F.timestamp_seconds(F.col("s") + 1_700_006_400))
    subs.drop("s").write.parquet(terms)
    spark.createDataFrame([(i, "a red tv" if i % 2 else "fridge", 10_000 * i) for i in range(20)], "id int, title string, s int").withColumn(
        "ts", F.timestamp_seconds(F.col("s") + 1_700_006_400)).drop("s").write.parquet(deals)

    def counted(change):
        s = change(spark.readStream.schema(spark.read.parquet(terms).schema).parquet(terms))
        d = spark.readStream.schema("id int, title string, ts timestamp").parquet(deals)
        return J.read_all(J.keyword_match_stream(d, s, ["title"]), work_path(spark, "c"), work_path(spark, "o")).groupBy("uid", "term").count()

    wanted = {(r.uid, r.term): r["count"] for r in counted(lambda s: s).collect()}
    classes = counted(J.subscription_classes)
    members = J.read_all(J.class_members_stream(spark.readStream.schema(spark.read.parquet(terms).schema).parquet(terms)), work_path(spark, "c"), work_path(spark, "o"))
    got = members.join(classes.withColumnRenamed("uid", "class"), ["term", "class"])
    assert classes.count() == 4 and {(r.uid, r.term): r["count"] for r in got.collect()} == wanted and len(wanted) == 29


def test_active_set_loses_deals_after_their_time(spark):
    root, source, checkpoint = (work_path(spark, n) for n in ("r", "s", "c"))
    hour = 3600
    tables.publish(spark.createDataFrame([], "id int, registered_at timestamp"), root)
    seen = []
    for rows in ([(1, "a", 0, 0), (2, "a", 0, 10 * hour)], [(1, "a", 0, 40 * hour), (3, "a", 0, 50 * hour)], [(4, "a", 0, 60 * hour)], [(5, "a", 0, 120 * hour)]):
        feed(spark, source, rows)
        fresh = spark.createDataFrame(rows, "id int, source string, views long, s long").select("id", F.timestamp_seconds(F.col("s") + 1_700_006_400).alias("registered_at"))
        stored = tables.read_current(spark, root).unionByName(fresh).groupBy("id").agg(F.max("registered_at").alias("registered_at"))
        tables.publish(stored, root)
        drive(J.expiry_stream(spark.readStream.schema(EVENTS).parquet(source)), J.upsert_sink(root, J.without_expired, checkpoint), checkpoint)
        seen.append({r.id for r in tables.read_current(spark, root).collect()})
    assert seen == [{1, 2}, {1, 2, 3}, {1, 3, 4}, {5}]


def test_a_term_added_between_two_batches_matches_in_the_second(spark):
    deals, terms, checkpoint, out = (work_path(spark, n) for n in ("d", "t", "c", "o"))

    def write(path, rows, schema, at):
        spark.createDataFrame(rows, schema).withColumn(at, F.timestamp_seconds(F.col("s") + 1_700_006_400)).drop("s").coalesce(1).write.mode("append").parquet(path)

    def run():
        streams = [spark.readStream.schema(schema).parquet(path) for schema, path in (
            ("id int, title string, ts timestamp", deals), ("uid string, term string, enabled boolean, since timestamp", terms))]
        J.read_all(J.keyword_match_stream(*streams, ["title"], salts=3), checkpoint, out)

    write(terms, [("u", "red tv", True, 0), ("u", " Red TV", True, 5), ("x", "fridge", False, 0)], "uid string, term string, enabled boolean, s int", "since")
    write(deals, [(1, "A red TV!", 10), (2, "blue fridge", 20)], "id int, title string, s int", "ts")
    run()
    write(terms, [("v", "fridge", True, 30)], "uid string, term string, enabled boolean, s int", "since")
    write(deals, [(3, "big fridge", 40), (4, "red tv fridge", 25)], "id int, title string, s int", "ts")
    run()
    got = sorted((r.deal_id, r.uid, r.term) for r in spark.read.parquet(out).collect())
    assert got == [(1, "u", "red tv"), (3, "v", "fridge"), (4, "u", "red tv")]


def test_two_writers_that_planned_from_one_version_lose_nothing(spark):
    root = work_path(spark, "t")
    tables.publish(spark.createDataFrame([(0, 1)], SCHEMA), root)
    add = lambda stored, k: stored.unionByName(spark.createDataFrame([(k, 1)], SCHEMA))
    mine = add(tables.read_current(spark, root), 1)
    assert tables.publish(add(tables.read_current(spark, root), 2), root, base=1) == 2  # the other one is faster
    with pytest.raises(tables.VersionConflict):
        tables.publish(mine, root, base=1)
    assert {r.k for r in tables.read_current(spark, root).collect()} == {0, 2} and tables.current_version(spark, root) == 2
    planned = []

    def plan(stored):
        if not planned:  # somebody publishes between this plan and its write
            tables.publish(add(tables.read_current(spark, root), 3), root)
        planned.append(1)
        return add(stored, 4)

    assert tables.update(spark, root, plan) == 4 and len(planned) == 2
    assert {r.k for r in tables.read_current(spark, root).collect()} == {0, 2, 3, 4}
    assert tables.folders(spark, root) == 5  # four versions and the claims; the loser's folder is gone


def test_two_streams_write_a_table_at_the_same_time(spark):
    root = work_path(spark, "t")
    tables.publish(spark.createDataFrame([], SCHEMA), root)
    queries = []
    for n in range(2):
        source, checkpoint = work_path(spark, "s"), work_path(spark, "c")
        for i in range(3):
            spark.createDataFrame([(10 * n + i, 1), (99, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        queries.append(stream.writeStream.foreachBatch(J.upsert_sink(root, merge, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    for q in queries:
        q.awaitTermination()
    assert {r.k: r.v for r in tables.read_current(spark, root).collect()} == {**{k: 1 for k in (0, 1, 2, 10, 11, 12)}, 99: 6}


def test_a_claim_without_a_folder_stops_writers(spark, monkeypatch):
    root = work_path(spark, "t")
    tables.publish(spark.createDataFrame([(1, 1)], SCHEMA), root)
    path, fs = tables._hadoop(spark, f"{root}/{tables.CLAIMS}/{2:09d}")
    fs.create(path, False).close()
    monkeypatch.setattr(tables, "CLAIM_WAIT", 1)
    assert tables.read_current(spark, root).count() == 1
    with pytest.raises(RuntimeError, match="died"):
        tables.update(spark, root, lambda stored: stored)
    fs.delete(path, False)
    assert tables.update(spark, root, lambda stored: stored) == 2


def test_pages_at_any_depth(spark, monkeypatch):
    monkeypatch.setattr(V, "PAGE_ROWS", 5)
    at = [dt.datetime(2024, 1, 1 + i % 9, i % 24, 0, 0, (i % 3) * 400) if i % 11 else None for i in range(400)] + [dt.datetime(2024, 1, 5)] * 40
    rows = [(i, t) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    order = [r.id for r in df.orderBy(F.col("ts").desc_nulls_last(), F.col("id").desc()).collect()]
    for offset in (0, 3, 100, 201, 380, 398, 401, 430, 439, 440, 900):
        page = V.page_at(df, 20, offset, "ts", "id").collect()
        assert [r.id for r in page] == order[offset : offset + 20], offset
        assert all(r.has_more == (offset + 20 < 440) and r.next_offset == min(440, offset + 20) for r in page)


def test_ledger_reads_only_what_may_hold_a_pair(spark):
    root, checkpoint = work_path(spark, "l"), work_path(spark, "c")
    spark.createDataFrame([('{"id":"0-b"}',)], "value string").coalesce(1).write.text(f"{checkpoint}/metadata")
    write = J.ledger_sink(root, checkpoint)
    pairs = lambda a, b: spark.range(a, b).select(F.col("id").alias("deal_id"), (F.col("id") * 7).alias("uid"))
    for i in range(4):
        write(pairs(300 * i, 300 * i + 300), i)
    assert spark.read.parquet(root).count() == 1200
    all_folders = 4 * J.LEDGER_SLICES
    known, unknown = (J.ledger_candidates(spark, root, pairs(*r)) for r in ((100, 110), (90_000, 90_300)))
    assert len(known) <= 14 and len(unknown) < all_folders / 10  # ten slices hold them; the rest is chance
    homes = {(r.batch, r.slice) for r in spark.read.parquet(root).where("deal_id between 100 and 109").select("batch", "slice").collect()}
    assert homes <= set(known)
    write(pairs(1000, 1500), 4)
    write(pairs(1000, 1500), 4)  # a replay
    got = spark.read.parquet(root)
    assert got.count() == 1500 and got.select("deal_id").distinct().count() == 1500
    write(pairs(0, 0), 5)
    assert spark.read.parquet(root).count() == 1500
