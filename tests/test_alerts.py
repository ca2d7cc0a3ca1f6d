"""Matching, throttling (batch, stream and a plain loop agree), devices."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from pricetide.operators import alerts as A
from pricetide.operators import devices as G
from pricetide.session import cut_lineage
from pricetide.streaming import jobs as J

MATCH = "uid int, term string, deal_id int, ts timestamp"


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        uid = 1 if rng.random() < 0.4 else rng.randrange(2, 12)
        rows.append((uid, rng.choice(["tv", "ssd"]), i, rng.randrange(0, 3 * 86400) // 7 * 7))
    rows += [(99, "tv", 9000, 0), (99, "tv", 9001, 1800), (99, "tv", 9002, 3599), (99, "tv", 9003, 3599), (99, "tv", 9004, 3600)]
    df = spark.createDataFrame(rows, "uid int, term string, deal_id int, s int")
    return df.select("uid", "term", "deal_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))


def loop(rows):
    """The rule as a plain walk in time order."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["deal_id"])):
        key, at = (r["uid"], r["term"]), r["ts"].timestamp()
        start, pending = state.get(key, (None, 0))
        if start is None or at - start >= 1800:
            out[r["deal_id"]] = ("send", 0, pending)
            state[key] = (at, 0)
        else:
            out[r["deal_id"]] = ("queue", pending + 1, 0)
            state[key] = (start, pending + 1)
    return out


def test_throttle_equals_walk(matches):
    got = {r["deal_id"]: (r["action"], r["pending_count"], r["digest_count"]) for r in A.alert_throttle(matches).collect()}
    assert got == loop(matches.collect())
    assert [got[i][0] for i in range(9000, 9005)] == ["send", "send", "queue", "queue", "send"]


@pytest.fixture(scope="module")
def timed(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "uid int, term string, deal_id int, s int")
        return df.select("uid", "term", "deal_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    return make


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 40_000)), min_size=1, max_size=60))
def test_jumps_equal_the_walk_on_any_times(timed, times):
    matches = timed([(uid, "t", i, s) for i, (uid, s) in enumerate(times)])
    assert {r["deal_id"]: (r["action"], r["pending_count"], r["digest_count"]) for r in A.alert_throttle(matches).collect()} == loop(matches.collect())


def test_one_long_chain_without_a_pause(timed):
    matches = timed([(1, "t", i, 11 * i + i % 7) for i in range(20_000)] + [(2, "t", 20_000 + i, 1799 * i) for i in range(300)] + [(3, "t", 30_000 + i, 1800 * i) for i in range(70)])
    assert {r["deal_id"]: (r["action"], r["pending_count"], r["digest_count"]) for r in A.alert_throttle(matches).collect()} == loop(matches.collect())
    plan = A.alert_windows(matches, ["uid", "term"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "hashpartitioning(uid#" in plan and ", slot#" in plan


def test_due_windows_leave_in_cycles_of_fifty(spark):
    rows = [(f"u{i:03d}", "t", i % 9, 1 + i % 3) for i in range(117)] + [("gone", "t", 1, 5), ("deaf", "t", 2, 5), ("idle", "t", 3, 0), ("later", "t", 10_000, 1)]
    windows = spark.createDataFrame(rows, "uid string, term string, s int, pending_count long").select(
        "uid", "term", F.timestamp_seconds(F.col("s") + 1_700_000_000 - 1800).alias("window_started_at"),
        F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("due_at"), "pending_count")
    now = F.timestamp_seconds(F.lit(1_700_000_060))
    subs = windows.where("uid <> 'gone'").select("uid", "term")
    targets = windows.select("uid", F.lit(1).alias("tokens"), F.when(F.col("uid") == "deaf", -1).otherwise(0).alias("web_devices"))
    left, sizes, outcomes = windows, [], {}
    for _ in range(3):
        cycle = cut_lineage(A.digest_cycle(left, now, subs, targets))
        taken = [r for r in cycle.collect() if r.outcome not in ("open", "deferred")]
        sizes.append(len(taken))
        outcomes = {r.uid: r.outcome for r in taken} | outcomes
        left = A.after_cycle(cycle, now)
    assert sizes == [50, 50, 21] and len(outcomes) == 120  # the emptied window is due once more, and dropped
    assert [outcomes[u] for u in ("gone", "deaf", "idle", "u000")] == ["keyword_deleted", "no_tokens", "dropped", "digest"]
    after = {r.uid: r for r in left.collect()}
    assert set(after) == {r[0] for r in rows} - {"gone", "idle", "deaf"} and all(after[r[0]].pending_count == (1 if r[0] == "later" else 0) for r in rows if r[0] in after)


def test_stream_equals_batch(spark, matches, tmp_path):
    matches.write.parquet(f"{tmp_path}/in")
    stream = J.tables.read_documents_stream(spark, f"{tmp_path}/in", matches.schema)
    out = J.read_all(J.alert_throttle_stream(stream, flush=False), f"{tmp_path}/c", f"{tmp_path}/o")
    got = {int(r["deal_id"]): (r["action"], r["pending_count"], r["digest_count"]) for r in out.collect()}
    assert got == loop(matches.collect())


def test_timer_flushes_pending(spark, tmp_path):
    rows = spark.createDataFrame([(1, "tv", 1, "a", 0), (1, "tv", 2, "b", 60)], "uid int, term string, deal_id int, title string, s int")
    late = spark.createDataFrame([(2, "tv", 3, "c", 7200), (2, "tv", 4, "d", 9300)], rows.schema)
    with_ts = [d.select("uid", "term", "deal_id", "title", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")) for d in (rows, late)]
    source = f"{tmp_path}/in"
    for i, d in enumerate(with_ts):
        d.coalesce(1).write.mode("append").parquet(source)
        stream = J.tables.read_documents_stream(spark, source, with_ts[0].schema)
        out = J.read_all(J.alert_throttle_stream(stream), f"{tmp_path}/c", f"{tmp_path}/o")
    got = {(r["uid"], r["action"]): (r["deal_id"], r["digest_count"], r["digest_titles"]) for r in out.collect()}
    assert got[("1", "digest")] == ("", 1, "b") and {r["digest_ids"] for r in out.where("action = 'digest'").collect()} == {"2"}
    assert got[("1", "queue")][0] == "2" and got[("2", "send")][0] == "4"


def test_ledger_and_replay(spark, tmp_path):
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    batch = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "deal_id int, uid int")
    spark.createDataFrame([('{"id":"0-a"}',)], "value string").coalesce(1).write.text(f"{root}-c/metadata")
    write = J.ledger_sink(root, f"{root}-c")
    write(batch, 0)
    write(batch, 0)
    write(batch.unionByName(spark.createDataFrame([(3, 1)], batch.schema)), 1)
    rows = sorted((r["deal_id"], r["uid"]) for r in spark.read.parquet(root).collect())
    assert rows == [(1, 1), (2, 1), (3, 1)]


def test_strict_terms_never_match_punctuation(spark):
    deals = spark.createDataFrame([(1, "learn C++ today")], "id int, title string")
    subs = spark.createDataFrame([("u", "c++", True), ("u", "learn c", True), ("v", "today", False)], "uid string, term string, enabled boolean")
    assert [r["term"] for r in A.keyword_match(deals, subs, ["title"]).collect()] == ["learn c"]
    loose = spark.createDataFrame([("u", "c++ today", True)], subs.schema)
    assert A.keyword_match(deals, loose, ["title"], strict=False).count() == 1


def test_terms_longest_first(spark):
    m = spark.createDataFrame([(1, 1, "ab"), (1, 1, "abcd"), (1, 1, "abce"), (1, 1, "ab")], "deal_id int, uid int, term string")
    r = A.collect_terms(m).first()
    assert r["terms"] == ["abcd", "abce", "ab"] and r["primary_term"] == "abcd"


DEVICE = ("id string, uid string, enabled boolean, client_kind string, display_mode string, installation_id string, "
          "user_agent string, endpoint string, fcm_token string, s int")


def cleanup(spark, rows):
    base = {"uid": "u", "enabled": True, "client_kind": "pwa", "display_mode": "standalone", "installation_id": "", "user_agent": "", "fcm_token": "", "s": 0}
    names = [c.split()[0] for c in DEVICE.split(", ")]
    full = [tuple({**base, "endpoint": r["id"], **r}[n] for n in names) for r in rows]
    df = spark.createDataFrame(full, DEVICE).withColumn("last_seen_at", F.timestamp_seconds("s"))
    return {r["id"]: (r["reason"], r["superseded_by"]) for r in G.device_cleanup(df).collect()}


def test_same_installation_keeps_newest(spark):
    got = cleanup(spark, [{"id": "old", "installation_id": "installation_123456", "s": 10}, {"id": "new", "installation_id": "installation_123456", "s": 20}])
    assert got == {"old": ("duplicate_web_push_installation", "new")}


def test_browser_and_legacy(spark):
    got = cleanup(spark, [
        {"id": "browser", "client_kind": "browser", "display_mode": "browser", "user_agent": "same", "s": 30},
        {"id": "old", "user_agent": "same", "s": 10}, {"id": "new", "user_agent": "same", "s": 20}])
    assert got == {"browser": ("standalone_pwa_registered", "new"), "old": ("duplicate_legacy_pwa_user_agent", "new")}


def test_different_agents_stay(spark):
    assert cleanup(spark, [{"id": "phone", "user_agent": "a"}, {"id": "tablet", "user_agent": "b"}]) == {}


def test_identified_installation_replaces_legacy(spark):
    got = cleanup(spark, [{"id": "legacy", "user_agent": "same", "s": 30}, {"id": "named", "installation_id": "installation_123456", "user_agent": "same", "s": 20}])
    assert got == {"legacy": ("duplicate_legacy_pwa_user_agent", "named")}


def test_distinct_installations_stay(spark):
    rows = [{"id": n, "installation_id": f"installation_{n * 6}", "user_agent": "same"} for n in "ab"]
    assert cleanup(spark, rows) == {}


def test_token_twice(spark):
    rows = [{"id": "o", "endpoint": "", "fcm_token": "t", "s": 10}, {"id": "n", "endpoint": "", "fcm_token": "t", "s": 20}, {"id": "x", "endpoint": "", "fcm_token": "t", "s": 99, "enabled": False}]
    assert cleanup(spark, rows) == {"o": ("duplicate_fcm_token", "n")}


def test_unsubscribed_term_closes_its_window(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "tv", 1, 0, True), (1, "tv", 2, 60, True), (1, "tv", 3, 90, False), (1, "tv", 4, 120, True)], "uid int, term string, deal_id int, s int, subscribed boolean")
    m = rows.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    m.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = J.tables.read_documents_stream(spark, f"{tmp_path}/in", m.schema)
    out = J.read_all(J.alert_throttle_stream(stream, flush=False), f"{tmp_path}/c", f"{tmp_path}/o")
    assert {int(r["deal_id"]): r["action"] for r in out.collect()} == {1: "send", 2: "queue", 3: "skip", 4: "send"}


def test_digest_of_an_unreachable_user_is_emptied(spark, tmp_path):
    rows = spark.createDataFrame([(1, "tv", 1, 0), (1, "tv", 2, 60)], "uid int, term string, deal_id int, s int")
    late = spark.createDataFrame([(2, "tv", 3, 7200), (2, "tv", 4, 9300)], rows.schema)
    for d in (rows, late):
        m = d.withColumn("reachable", F.col("uid") != 1).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        m.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = J.tables.read_documents_stream(spark, f"{tmp_path}/in", m.schema)
        out = J.read_all(J.alert_throttle_stream(stream), f"{tmp_path}/c", f"{tmp_path}/o")
    assert [r["digest_count"] for r in out.where("action = 'no_tokens'").collect()] == [1] and out.where("action = 'digest'").isEmpty()


def test_subscriptions_and_ledgers_are_not_broadcast(spark, tmp_path):
    from pricetide.plans import views

    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).select(F.col("id").alias("p_partkey"), F.lit("red tv").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    subs = views.view(spark, str(tmp_path), "v_subscriptions")
    matches = subs.select("uid", "term", F.col("uid").alias("deal_id"))
    kept = A.validate_subscription(matches, subs, subs.where("uid % 3 <> 0"))
    fresh = A.suppress_already_matched(matches, matches.where("uid < 10"))
    for df in (subs, fresh):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert (subs.count(), kept.count(), fresh.count()) == (30, 16, 20)


class CountedState:
    """A stand-in for the handle of a stateful processor; counts the messages that a key costs."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.discard(at)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


def test_a_key_costs_few_messages_however_many_its_rows(monkeypatch):
    """state and timers are asked for once per key and batch, and the alerts of a key leave together."""
    monkeypatch.setattr(J, "ALERT_CHUNK", 40)
    state, minute, start = CountedState(), 60_000_000, 1_700_000_000_000_000
    processor = J.AlertThrottle()
    processor.init(state)
    at = lambda i: start + i * 20 * minute
    row = Row("uid", "term", "deal_id", "at")
    out = [r for b in (range(50), range(50, 100)) for r in processor.handleInputRows(("u", "t"), iter([row("u", "t", i, at(i)) for i in reversed(b)]), None)]
    assert [len(r.alerts) for r in out] == [40, 10, 40, 10]
    alerts = [a for r in out for a in r.alerts]
    assert [(a[0], a[1], a[2]) for a in alerts] == [(str(i), at(i), "queue" if i % 2 else "send") for i in range(100)]
    assert state.calls == ["get", "update", "registerTimer", "get", "update", "deleteTimer", "registerTimer"]
    assert state.value[:2] == (at(98), 1) and state.timers == {(at(98) + 30 * minute) // 1000 + 1}
    (digest,) = processor.handleExpiredTimer(("u", "t"), None, None)
    assert digest.alerts == [("", at(98) + 30 * minute, "digest", 0, 1, "", "99")] and state.value[:2] == (at(98) + 30 * minute, 0)
    gone = Row("uid", "term", "deal_id", "at", "subscribed")("u", "t", 100, at(100), False)
    assert [r.alerts[0][2] for r in processor.handleInputRows(("u", "t"), iter([gone]), None)] == ["skip"] and state.value is None


def test_windows_and_timers_go_on_over_batches(spark, tmp_path):
    """Titles, null columns and equal instants, in two runs of one stream; the open windows are read from its state."""
    rows = [[(1, "tv", 2, " b ", 60), (1, "tv", 1, "a", 0), (1, "tv", 3, None, 60), (None, "tv", 4, "x", 0)], [(1, "tv", 5, "e", 1799), (1, "tv", 6, "f", 1800), (None, "tv", 7, "y", 5)]]
    for some in rows:
        df = spark.createDataFrame(some, "uid int, term string, deal_id int, title string, s int")
        m = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        m.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = J.tables.read_documents_stream(spark, f"{tmp_path}/in", m.schema)
        out = J.read_all(J.alert_throttle_stream(stream, flush=False), f"{tmp_path}/c", f"{tmp_path}/o")
    got = {int(r.deal_id): (r.uid, r.action, r.pending_count, r.digest_count, r.digest_titles, r.digest_ids) for r in out.collect()}
    assert got == {
        1: ("1", "send", 0, 0, "", ""), 2: ("1", "queue", 1, 0, "", ""), 3: ("1", "queue", 2, 0, "", ""), 5: ("1", "queue", 3, 0, "", ""),
        6: ("1", "send", 0, 3, "b|e", "2|3|5"), 4: (None, "send", 0, 0, "", ""), 7: (None, "queue", 1, 0, "", "")}
    left = {r.uid: (r.pending_count, r.titles, r.deal_ids) for r in J.open_windows(spark, f"{tmp_path}/c").collect()}
    assert left == {"1": (0, [], []), None: (1, ["y"], ["7"])}
