"""Keyword alerts, throttling, devices."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from pricetide.functions.keys import subscription_id, user_keyword_id
from pricetide.functions.text import candidate_terms, normalize_term, normalize_text
from pricetide.operators import alerts as A
from pricetide.operators import dedup as D
from pricetide.operators import devices as G
from pricetide.operators import scale
from pricetide.operators import snapshots as N
from pricetide.plans.registry import query, sql_ts, ts_text
from pricetide.plans.views import VIEW_SQL, NOW, oracle_with, table, text_table, view
from pricetide.session import STATE_STORE_CONF, cut_lineage, work_path
from pricetide.streaming import jobs as J

NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '<!--[\s\S]*?-->|<[^>]*>', ' ', 'g')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def grams_sql(table_name: str, text: str) -> str:
    """CTEs ``gram(id, term)``: distinct 1-3 word phrases of 2 to 20 characters."""
    return f"""wd AS (SELECT id, w, i FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT id, string_split({NORM.format(text)}, ' ') AS ws FROM {table_name}) y) q WHERE w <> ''),
n3 AS (SELECT id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM wd WINDOW o AS (PARTITION BY id ORDER BY i)),
gram AS (SELECT DISTINCT id, term FROM (SELECT id, w AS term FROM n3 UNION ALL SELECT id, w || ' ' || w2 FROM n3 UNION ALL SELECT id, w || ' ' || w2 || ' ' || w3 FROM n3) g
  WHERE length(term) BETWEEN 2 AND 20)"""


POSTS = f"{oracle_with('v_posts', 'v_subscriptions')}, {grams_sql('v_posts', 'title')}, sub AS (SELECT DISTINCT uid, lower(trim(term)) AS term FROM v_subscriptions WHERE enabled)"
UK = "uk AS (SELECT DISTINCT uid, lower(trim(term)) AS term FROM v_subscriptions WHERE enabled AND uid % 3 <> 0)"
MATCHES = "mt AS (SELECT gram.id AS deal_id, uid, term FROM gram JOIN sub USING (term))"


def _subs(spark, sf_dir):
    return view(spark, sf_dir, "v_subscriptions")


def _matches(spark, sf_dir):
    return A.keyword_match(view(spark, sf_dir, "v_posts"), _subs(spark, sf_dir), ["title"])


@query("normalize_text", f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalized(spark, sf_dir):
    """F6 over whole documents."""
    return text_table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("norm"))


@query("normalize_term", r"SELECT c_custkey, lower(trim(regexp_replace('  ' || replace(c_name, '#', ' #  ') || ' ', '\s+', ' ', 'g'))) AS term FROM customer")
def normalized_term(spark, sf_dir):
    """punctuation stays."""
    messy = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" #  ")), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_term(messy).alias("term"))


@query("candidate_terms", f"WITH b AS (SELECT doc_id AS id, text FROM documents), {grams_sql('b', 'text')} SELECT id, count(*) AS terms, sum(length(term))::BIGINT AS chars FROM gram GROUP BY id")
def terms(spark, sf_dir):
    """F8 over whole documents: number and total length of the distinct phrases."""
    # The phrases come out of a generator: a filter on a plain column would parse the texts again, before they are dealt out.
    t = F.explode_outer(F.array(candidate_terms(normalize_text(F.col("text")))))
    d = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.alias("t")).where(F.size("t") > 0)
    chars = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + F.char_length(x))
    return d.select("id", F.size("t").cast("bigint").alias("terms"), chars.alias("chars"))


@query("distinct_terms", f"{oracle_with('v_posts')}, {grams_sql('v_posts', 'title')} SELECT DISTINCT term FROM gram")
def distinct_terms(spark, sf_dir):
    """U5."""
    p = view(spark, sf_dir, "v_posts").select(candidate_terms(normalize_text(F.col("title"))).alias("t"))
    return D.distinct_terms(p, "t")


@query("keyword_matches", f"{POSTS}, {MATCHES} SELECT uid, count(*) AS matches, count(DISTINCT deal_id) AS deals, sum(deal_id)::BIGINT AS id_sum FROM mt GROUP BY uid")
def keyword_matches(spark, sf_dir):
    """J8, per user."""
    return _matches(spark, sf_dir).groupBy("uid").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("deal_id").alias("deals"), F.sum("deal_id").alias("id_sum"))


@query("keyword_match_documents", f"""WITH b AS (SELECT doc_id AS id, text FROM documents), {grams_sql('b', 'text')},
q AS (SELECT DISTINCT item_id AS uid, lower(unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+'))) AS term FROM benchmark)
SELECT uid, term, count(*) AS deals FROM gram JOIN q USING (term) GROUP BY ALL""")
def keyword_match_documents(spark, sf_dir):
    """J8 over whole document texts, against the two-word phrases of whole benchmark items."""
    q = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("uid"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+ [A-Za-z]+)"), 1)).alias("term"), F.lit(True).alias("enabled"))
    docs = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return A.keyword_match(docs, q, ["text"]).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("deals"))


@query("keyword_match_loose", f"""WITH b AS (SELECT doc_id AS id, text FROM documents), {grams_sql('b', 'text')},
p AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+, [A-Za-z]+')) AS phrase FROM benchmark),
q AS (SELECT DISTINCT item_id AS uid, {NORM.format('phrase')} AS term FROM p)
SELECT uid, term, count(*) AS deals FROM gram JOIN q USING (term) GROUP BY ALL""")
def keyword_match_loose(spark, sf_dir):
    """J8 with punctuation removed from the stored terms too."""
    q = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("uid"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+, [A-Za-z]+)"), 1)).alias("term"), F.lit(True).alias("enabled"))
    docs = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return A.keyword_match(docs, q, ["text"], strict=False).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("deals"))


@query("validated_matches", f"{POSTS}, {MATCHES}, {UK} SELECT uid, count(*) AS matches FROM mt JOIN uk USING (uid, term) GROUP BY uid")
def validated_matches(spark, sf_dir):
    """The user's own list lacks every third user."""
    own = _subs(spark, sf_dir).where("uid % 3 <> 0")
    return A.validate_subscription(_matches(spark, sf_dir), _subs(spark, sf_dir), own).groupBy("uid").agg(
        F.count(F.lit(1)).alias("matches"))


@query("unmatched_pairs", f"""{POSTS}, {MATCHES}, lg AS (SELECT deal_id, uid FROM mt WHERE deal_id % 3 = 0 UNION ALL SELECT p_partkey, c_custkey FROM part JOIN customer ON c_custkey = p_partkey + 1)
SELECT uid, count(*) AS matches FROM mt WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.deal_id = mt.deal_id AND lg.uid = mt.uid) GROUP BY uid""")
def unmatched_pairs(spark, sf_dir):
    """J10."""
    matches = _matches(spark, sf_dir)
    others = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("deal_id"), (F.col("p_partkey") + 1).alias("uid")).join(
        scale.shuffled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"))), "uid").select("deal_id", "uid")
    fresh = A.suppress_already_matched(matches, matches.where("deal_id % 3 = 0").select("deal_id", "uid").unionByName(others))
    return fresh.groupBy("uid").agg(F.count(F.lit(1)).alias("matches"))


@query("matched_terms", f"""WITH b AS (SELECT doc_id AS id, text FROM documents), {grams_sql('b', 'text')},
q AS (SELECT DISTINCT item_id % 7 AS uid, lower(w) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) x WHERE length(w) BETWEEN 5 AND 20),
h AS (SELECT gram.id AS deal_id, uid, term FROM gram JOIN q USING (term))
SELECT deal_id, uid, string_agg(term, '|' ORDER BY length(term) DESC, term) AS terms, true AS has_primary FROM h GROUP BY ALL""")
def matched_terms(spark, sf_dir):
    """Terms longest first."""
    words = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % 7).alias("uid"), F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("term"))
    subs = words.where(F.char_length("term").between(5, 20)).distinct().withColumn("enabled", F.lit(True))
    docs = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    t = A.collect_terms(A.keyword_match(docs, subs, ["text"]))
    return t.select("deal_id", "uid", F.array_join("terms", "|").alias("terms"), F.col("primary_term").isNotNull().alias("has_primary"))


@query("keyword_first_alerts", f"{POSTS}, {MATCHES} SELECT uid, term, min(deal_id) AS deal_id FROM mt GROUP BY uid, term")
def keyword_first_alerts(spark, sf_dir):
    """First alert per (user, term)."""
    m = _matches(spark, sf_dir)
    return A.first_alerts(m, "deal_id", "deal_id").select("uid", "term", "deal_id")


@query("subscription_index", r"""SELECT sha1(CAST(uid AS VARCHAR) || '::' || term) AS id, uid, term AS term_normalized, left(sha1(term), 24) AS user_keyword_id
FROM (SELECT DISTINCT c_custkey AS uid, p_name || ' m' || CAST(p_partkey AS VARCHAR) AS term FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 5 <> 0)""")
def subscription_index(spark, sf_dir):
    """S13, F22."""
    rows = _subs(spark, sf_dir).withColumn("term_normalized", normalize_term(F.col("term")))
    return A.backfill_subscription_index(rows).select("id", "uid", "term_normalized", "user_keyword_id")


@query("subscription_ids", "SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR) || '::' || c_mktsegment) AS sid, left(sha1(c_mktsegment), 24) AS kid FROM customer")
def subscription_ids(spark, sf_dir):
    """F22."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", subscription_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("sid"),
                    user_keyword_id(F.col("c_mktsegment")).alias("kid"))


# --- throttling ----------------------------------------------------------------------------------

SPLIT_F = """f AS (SELECT uid, count(DISTINCT nullif(fcm_token, '')) AS tokens, count(*) FILTER (endpoint <> '') AS web, count(*) FILTER (endpoint <> '' AND display_mode = 'browser') AS br,
  bool_or(endpoint <> '' AND display_mode = 'standalone') AS sa FROM v_devices WHERE enabled{0} GROUP BY uid),
sd AS (SELECT uid, tokens, web - CASE WHEN sa THEN br ELSE 0 END AS web_devices, CASE WHEN sa THEN br ELSE 0 END AS suppressed FROM f)"""
SPLIT = f"{oracle_with('v_devices')}, {SPLIT_F.format('')}"
SPLIT_CTES = f"v_devices AS ({VIEW_SQL['v_devices']}), {SPLIT_F.format(' AND uid % 4 <> 1')}"

EV = "ev AS (SELECT user_id AS uid, event_type AS term, event_id AS deal_id, ts FROM events)"
CHAIN = """ch AS (SELECT uid, term, min(ts) AS st FROM ev GROUP BY ALL
  UNION ALL SELECT c.uid, c.term, min(e.ts) FROM ch c JOIN ev e ON e.uid = c.uid AND e.term = c.term AND e.ts >= c.st + INTERVAL 30 MINUTE GROUP BY c.uid, c.term, c.st)"""
THROTTLED = f"""WITH RECURSIVE {EV}, {CHAIN},
aw AS (SELECT e.*, c.st, row_number() OVER (PARTITION BY e.uid, e.term, c.st ORDER BY e.ts, e.deal_id) AS rk FROM ev e ASOF JOIN ch c ON e.uid = c.uid AND e.term = c.term AND e.ts >= c.st),
sz AS (SELECT uid, term, st, count(*) AS n FROM aw GROUP BY ALL),
dg AS (SELECT uid, term, st, coalesce(lag(n) OVER (PARTITION BY uid, term ORDER BY st) - 1, 0) AS dc FROM sz),
th AS (SELECT uid, term, deal_id, ts, CASE WHEN rk = 1 THEN 'send' ELSE 'queue' END AS action, CASE WHEN rk = 1 THEN 0 ELSE rk - 1 END AS pending_count,
  CASE WHEN rk = 1 THEN dc ELSE 0 END AS digest_count FROM aw JOIN dg USING (uid, term, st))"""


def _event_matches(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("term"), F.col("event_id").alias("deal_id"), "ts")


@query("alert_throttle", f"{THROTTLED} SELECT uid, term, deal_id, action, pending_count, digest_count FROM th")
def alert_throttle(spark, sf_dir):
    """R11."""
    return A.alert_throttle(_event_matches(spark, sf_dir)).drop("ts")


@query("alert_throttle_dense", f"""{THROTTLED.replace("event_type AS term", "'all' AS term").replace("SELECT user_id AS uid", "SELECT 0 AS uid")}
SELECT deal_id, action, pending_count, digest_count FROM th""")
def alert_throttle_dense(spark, sf_dir):
    """R11 with every match under one key."""
    m = _event_matches(spark, sf_dir).withColumn("uid", F.lit(0)).withColumn("term", F.lit("all"))
    return A.alert_throttle(m).select("deal_id", "action", "pending_count", "digest_count")


@query("due_digests", f"""{THROTTLED}, ls AS (SELECT uid, term, max(st) AS st FROM aw GROUP BY ALL), pd AS (SELECT uid, term, st, count(*) - 1 AS p FROM aw JOIN ls USING (uid, term, st) GROUP BY ALL)
SELECT uid, term, {sql_ts('st')} AS window_started_at, p AS pending_count,
  CASE WHEN st + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-30 22:00:00' THEN 'open' WHEN p > 0 THEN 'digest' ELSE 'dropped' END AS state FROM pd""")
def due_digests(spark, sf_dir):
    """R2, batch form."""
    d = A.due_digests(_event_matches(spark, sf_dir), "2024-01-30 22:00:00")
    return d.select("uid", "term", ts_text("window_started_at").alias("window_started_at"), "pending_count", "state")


@query("digest_contents", f"""{THROTTLED}, {SPLIT_CTES}, ls AS (SELECT uid, term, max(st) AS st FROM aw GROUP BY ALL),
q AS (SELECT uid, term, st, deal_id, 'deal ' || CAST(deal_id % 9 AS VARCHAR) AS title, rk FROM aw JOIN ls USING (uid, term, st) WHERE rk > 1),
tt AS (SELECT uid, term, string_agg(title, '|' ORDER BY f) AS titles FROM (SELECT * FROM (SELECT uid, term, title, min(rk) AS f FROM q GROUP BY ALL) g
  QUALIFY row_number() OVER (PARTITION BY uid, term ORDER BY f DESC) <= {A.MAX_PENDING_TITLES}) GROUP BY ALL),
ii AS (SELECT uid, term, string_agg(CAST(deal_id AS VARCHAR), '|' ORDER BY rk) AS ids FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY uid, term ORDER BY rk DESC) <= {A.MAX_PENDING_IDS}) GROUP BY ALL),
pd AS (SELECT uid, term, st, count(*) - 1 AS p FROM aw JOIN ls USING (uid, term, st) GROUP BY ALL)
SELECT uid, term, {sql_ts('st')} AS window_started_at, p AS pending_count, coalesce(titles, '') AS titles, coalesce(ids, '') AS deal_ids,
  CASE WHEN uid % 5 = 0 THEN 'keyword_deleted' WHEN st + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-30 22:00:00' THEN 'open' WHEN p = 0 THEN 'dropped'
       WHEN coalesce(tokens + web_devices, 0) = 0 THEN 'no_tokens' ELSE 'digest' END AS state
FROM pd LEFT JOIN tt USING (uid, term) LEFT JOIN ii USING (uid, term) LEFT JOIN sd USING (uid)""")
def digest_contents(spark, sf_dir):
    """Pending titles and ids; windows of unsubscribed terms and of users no device of whom is left after a filter."""
    m = _event_matches(spark, sf_dir).withColumn("title", F.concat(F.lit("deal "), (F.col("deal_id") % 9).cast("string")))
    subscribed = m.where("uid % 5 <> 0").select("uid", "term")
    d = A.digest_contents(m, "2024-01-30 22:00:00", subscribed, A.split_devices(view(spark, sf_dir, "v_devices").where("uid % 4 <> 1")))
    return d.select("uid", "term", ts_text("window_started_at").alias("window_started_at"), "pending_count",
                    F.array_join("titles", "|").alias("titles"), F.array_join("deal_ids", "|").alias("deal_ids"), "state")


@query("send_targets", f"""{oracle_with('v_devices')}, e AS (SELECT * FROM v_devices WHERE enabled)
SELECT DISTINCT uid, 'token' AS kind, fcm_token AS target FROM e WHERE fcm_token <> ''
UNION ALL SELECT uid, 'web', CAST(id AS VARCHAR) FROM e WHERE endpoint <> '' AND NOT (display_mode = 'browser' AND uid IN (SELECT uid FROM e WHERE endpoint <> '' AND display_mode = 'standalone'))""")
def send_targets(spark, sf_dir):
    """The rows alerts are sent to."""
    return A.send_targets(view(spark, sf_dir, "v_devices"))


def _run(spark, stream, mode="append"):
    """Drives a stream over what its source holds, into a fresh folder beside the shared checkpoints."""
    base = work_path(spark, "stream")
    return J.read_all(stream, f"{base}/checkpoint", f"{base}/rows", mode)


@contextlib.contextmanager
def rocksdb(spark):
    """The state store that ``transformWithState`` needs; the session's own choice comes back afterwards."""
    (name, store), = STATE_STORE_CONF.items()
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return J.tables.read_documents_stream(spark, f"{sf_dir}/events*.parquet", schema)


@query("alert_throttle_stream", f"{THROTTLED} SELECT uid, term, deal_id, action, pending_count, digest_count FROM th")
def alert_throttle_stream(spark, sf_dir):
    """R1 as a stateful stream; equal to its batch twin when no timer flushes between."""
    m = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("term"), F.col("event_id").alias("deal_id"), "ts")
    with rocksdb(spark):
        out = _run(spark, J.alert_throttle_stream(m, flush=False))
    return out.select(F.col("uid").cast("bigint").alias("uid"), "term", F.col("deal_id").cast("bigint").alias("deal_id"),
                      "action", "pending_count", "digest_count")


@query("alert_digest_stream")
def alert_digest_stream(spark, sf_dir):
    """R1 with R2: timers flush pending digests as event time passes a window's end."""
    m = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("term"), F.col("event_id").alias("deal_id"), "ts")
    with rocksdb(spark):
        return _run(spark, J.alert_throttle_stream(m, flush=True)).groupBy("action").agg(F.count(F.lit(1)).alias("alerts"))


@query("alert_dedup_stream", "SELECT DISTINCT event_type AS deal_id, user_id AS uid FROM events")
def alert_dedup_stream(spark, sf_dir):
    """One row per (deal, user) within the watermark; the deal is the event type here."""
    m = _event_stream(spark, sf_dir).select(F.col("event_type").alias("deal_id"), F.col("user_id").alias("uid"), "ts")
    return _run(spark, J.alert_dedup_stream(m, "60 days")).select("deal_id", "uid")


@query("alert_dedup", "WITH l AS (SELECT DISTINCT event_type AS deal_id, user_id AS uid FROM events WHERE value > 150) SELECT event_type AS deal_id, user_id AS uid, min(event_id) AS first_event FROM events e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.deal_id = e.event_type AND l.uid = e.user_id) GROUP BY ALL")
def alert_dedup(spark, sf_dir):
    """R3, exact: ledger anti-join, then one per pair."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("deal_id"), F.col("user_id").alias("uid"), F.col("event_id").alias("first_event"), "value")
    return A.alert_dedup(e, e.where("value > 150"), F.col("first_event").asc()).select("deal_id", "uid", "first_event")


SNAP_SQL = f"""{oracle_with('v_deals')}, b AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, registered_at) AS captured_at FROM v_deals),
l AS (SELECT source, captured_at, 'views' AS metric, views AS v FROM b UNION ALL SELECT source, captured_at, 'comments', comments FROM b UNION ALL SELECT source, captured_at, 'likes', likes FROM b
  UNION ALL SELECT source, captured_at, 'dislikes', dislikes FROM b UNION ALL SELECT source, captured_at, 'comment_signal_score', comment_signal_score FROM b)
SELECT source, {sql_ts('captured_at')} AS captured_at, metric, count(*) AS sample_count, round(avg(v), 4) AS mean, round(var_pop(v), 4) AS variance,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90,
  round(quantile_cont(v, 0.95), 4) AS p95 FROM l GROUP BY ALL"""


def _deal_stream(spark, sf_dir):
    e = _event_stream(spark, sf_dir)
    digits = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.floor(F.col("value") * 10).cast("bigint").alias("views"),
        (digits % 20).alias("comments"), (F.col("user_id") % 11).alias("likes"),
        F.expr("CASE WHEN event_id % 37 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END").alias("dislikes"), ((digits % 7 - 3) * 2).alias("comment_signal_score"),
        F.col("ts").alias("registered_at"))


@query("snapshot_stream", SNAP_SQL)
def snapshot_stream(spark, sf_dir):
    """The same numbers as the batch series. Append mode; the half hours still open are read from the stream's state."""
    base = work_path(spark, "stream")
    counts = J.value_counts_stream(_deal_stream(spark, sf_dir), ["views", "comments", "likes", "dislikes", "comment_signal_score"], late="1 hour")
    counts.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(
        J.snapshot_sink(f"{base}/rows", f"{base}/checkpoint")).start().awaitTermination()
    still_open = N.summarize_counts(cut_lineage(J.open_counts(spark, f"{base}/checkpoint")), ["captured_at", "source", "metric"])
    rows = spark.read.parquet(f"{base}/rows").drop("batch").unionByName(still_open)
    return rows.select("source", ts_text("captured_at").alias("captured_at"), "metric", "sample_count", "mean", "variance", "p25", "p50", "p75", "p90", "p95")


@query("late_filter_stream", f"{oracle_with('v_deals')} SELECT id, source FROM v_deals WHERE registered_at BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-20 00:10:00'")
def late_filter_stream(spark, sf_dir):
    """R7 in a replay: the clock is a column."""
    d = _deal_stream(spark, sf_dir).withColumn("clock", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return _run(spark, J.late_and_future_filter(d, "clock").select("id", "source"))


@query("event_trigger_match", """SELECT c_custkey % 10 AS bucket, count(*) AS n FROM customer c JOIN events e ON e.user_id = c_custkey AND e.event_type = CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'purchase' END GROUP BY 1""")
def event_trigger_match(spark, sf_dir):
    """Stream-static keyword match; every customer follows one event type of the user with the same number."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "signup", "error", "purchase")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.concat_ws(" ", kind, F.col("c_custkey").cast("string")).alias("term"), F.lit(True).alias("enabled"))
    e = _event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), "ts")
    m = _run(spark, J.keyword_match_stream(e, subs, ["title"]))
    return m.groupBy((F.col("uid") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("ttl_prune", f"{oracle_with('v_deals')} SELECT id FROM v_deals WHERE registered_at >= TIMESTAMP '2024-01-29 00:00:00'")
def ttl_prune(spark, sf_dir):
    """R8, batch form."""
    return J.ttl_prune(view(spark, sf_dir, "v_deals"), F.lit(NOW).cast("timestamp")).select("id")


@query("expiry_stream", f"""{oracle_with('v_deals')} SELECT id, {sql_ts("registered_at + INTERVAL 48 HOUR")} AS expired_at FROM v_deals
WHERE registered_at + INTERVAL 48 HOUR <= (SELECT max(registered_at) - INTERVAL 10 MINUTE FROM v_deals)""")
def expiry_stream(spark, sf_dir):
    """R8 over event time: what leaves the active set while the stream runs."""
    return _run(spark, J.expiry_stream(_deal_stream(spark, sf_dir))).select("id", ts_text("expired_at").alias("expired_at"))


@query("active_set_stream", f"""{oracle_with('v_deals')} SELECT id, source FROM v_deals
WHERE registered_at + INTERVAL 48 HOUR > (SELECT max(registered_at) - INTERVAL 10 MINUTE FROM v_deals)""")
def active_set_stream(spark, sf_dir):
    """R8 with R9: the stored active set after the stream's expiries were taken from it."""
    base = work_path(spark, "stream")
    J.tables.publish(view(spark, sf_dir, "v_deals").select("id", "source", "registered_at"), f"{base}/deals")
    ended = J.expiry_stream(_deal_stream(spark, sf_dir))
    ended.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(
        J.upsert_sink(f"{base}/deals", J.without_expired, f"{base}/checkpoint")).start().awaitTermination()
    return J.tables.read_current(spark, f"{base}/deals").select("id", "source")


@query("subscription_stream_match", """WITH s AS (SELECT c_custkey AS uid, CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'purchase' END AS term,
  TIMESTAMP '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) * INTERVAL 1 DAY AS since FROM customer)
SELECT uid, count(*) AS matches FROM s JOIN events e ON e.event_type = s.term AND e.user_id % 100 = s.uid % 100 AND e.ts >= s.since GROUP BY uid""")
def subscription_stream_match(spark, sf_dir):
    """Deals and subscriptions are both streams; a term counts from its day on."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "signup", "error", "purchase")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    customers = J.tables.read_documents_stream(spark, f"{sf_dir}/customer*.parquet", table(spark, sf_dir, "customer").schema)
    subs = customers.select(
        F.col("c_custkey").alias("uid"), F.concat_ws(" ", kind, (F.col("c_custkey") % 100).cast("string")).alias("term"), F.lit(True).alias("enabled"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("c_custkey") % 40) * 86_400).alias("since"))
    e = _event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", (F.col("user_id") % 100).cast("string")).alias("title"), "ts")
    # Users of one term and day are a class: deals meet classes, and the members of a class share its count.
    matched = _run(spark, J.keyword_match_stream(e, J.subscription_classes(subs), ["title"]))
    counts = matched.groupBy("term", F.col("uid").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    members = _run(spark, J.class_members_stream(subs))
    return scale.join_small_or_salted(members, counts, ["term", "class"], ["uid"]).groupBy("uid").agg(F.sum("n").alias("matches"))


@query("open_windows_state", f"{THROTTLED}, ls AS (SELECT uid, term, max(st) AS st FROM aw GROUP BY ALL) SELECT uid, term, {sql_ts('st')} AS started, max(pending_count) AS pending FROM ls JOIN (SELECT uid, term, st, count(*) - 1 AS pending_count FROM aw GROUP BY ALL) USING (uid, term, st) GROUP BY ALL")
def open_windows_state(spark, sf_dir):
    """The state of the throttling stream, read as a table after its run."""
    m = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("term"), F.col("event_id").alias("deal_id"), "ts")
    base = work_path(spark, "stream")
    with rocksdb(spark):
        J.read_all(J.alert_throttle_stream(m, flush=False), f"{base}/checkpoint", f"{base}/rows")
        return J.open_windows(spark, f"{base}/checkpoint").select(
            F.col("uid").cast("bigint").alias("uid"), "term", ts_text("window_started_at").alias("started"), F.col("pending_count").alias("pending"))


@query("digest_cycles", f"""{THROTTLED}, ls AS (SELECT uid, term, max(st) AS st FROM aw GROUP BY ALL),
w AS (SELECT uid, term, st + INTERVAL 30 MINUTE AS due, count(*) - 1 AS pending FROM aw JOIN ls USING (uid, term, st) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (ORDER BY due, uid, term) AS place FROM w WHERE due <= TIMESTAMP '2024-01-30 22:00:00')
SELECT w.uid, w.term, CASE WHEN place IS NULL THEN 'open' WHEN place > 150 THEN 'deferred' WHEN w.pending <= 0 THEN 'dropped' ELSE 'digest' END AS outcome,
  CASE WHEN place <= 150 THEN CAST((place - 1) // 50 AS INTEGER) END AS cycle FROM w LEFT JOIN q USING (uid, term)""")
def digest_cycles(spark, sf_dir):
    """R2: three cycles of at most fifty digests; what is left over stays due."""
    now, left, out = "2024-01-30 22:00:00", A.due_digests(_event_matches(spark, sf_dir), "2024-01-30 22:00:00").drop("state"), []
    left = cut_lineage(left)
    subs, targets = left.select("uid", "term"), left.select("uid").distinct().withColumns({"tokens": F.lit(1), "web_devices": F.lit(0)})
    for cycle in range(3):
        done = cut_lineage(A.digest_cycle(left, now, subs, targets))
        taken = F.col("outcome").isin("digest", "dropped")
        out.append(done.where(taken).select("uid", "term", "outcome", F.lit(cycle).alias("cycle")))
        left = done.where(~taken).drop("outcome")
    rest = F.when(F.col("due_at") > F.lit(now).cast("timestamp"), "open").otherwise("deferred")
    out.append(left.select("uid", "term", rest.alias("outcome"), F.lit(None).cast("int").alias("cycle")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# --- devices -------------------------------------------------------------------------------------

CLEAN = f"""{oracle_with('v_devices')}, e AS (SELECT * FROM v_devices WHERE enabled), wb AS (SELECT *, endpoint <> '' AND display_mode = 'standalone' AS sa FROM e WHERE endpoint <> ''),
ins AS (SELECT *, CASE WHEN regexp_full_match(installation_id, '[a-zA-Z0-9_-]{{16,120}}') THEN installation_id ELSE '' END AS iid FROM wb WHERE sa),
k1 AS (SELECT uid, arg_max(id, (last_seen_at, id)) AS k FROM wb WHERE sa GROUP BY uid),
k2 AS (SELECT uid, endpoint, arg_max(id, (last_seen_at, id)) AS k FROM wb GROUP BY ALL),
k3 AS (SELECT uid, display_mode, iid, arg_max(id, (last_seen_at, id)) AS k FROM ins WHERE iid <> '' GROUP BY ALL),
k4 AS (SELECT uid, user_agent, coalesce(arg_max(id, (last_seen_at, id)) FILTER (iid <> ''), arg_max(id, (last_seen_at, id))) AS k FROM ins WHERE user_agent <> '' GROUP BY ALL),
k5 AS (SELECT uid, fcm_token, arg_max(id, (last_seen_at, id)) AS k FROM e WHERE fcm_token <> '' GROUP BY ALL),
al AS (SELECT id, uid, 1 AS p, 'standalone_pwa_registered' AS reason, k FROM wb JOIN k1 USING (uid) WHERE NOT sa
  UNION ALL SELECT id, uid, 2, 'duplicate_web_push_endpoint', k FROM wb JOIN k2 USING (uid, endpoint) WHERE id <> k
  UNION ALL SELECT id, uid, 3, 'duplicate_web_push_installation', k FROM ins JOIN k3 USING (uid, display_mode, iid) WHERE id <> k
  UNION ALL SELECT id, uid, 4, 'duplicate_legacy_pwa_user_agent', k FROM ins JOIN k4 USING (uid, user_agent) WHERE iid = '' AND id <> k
  UNION ALL SELECT id, uid, 5, 'duplicate_fcm_token', k FROM e JOIN k5 USING (uid, fcm_token) WHERE id <> k),
cl AS (SELECT id, uid, arg_min(reason, p) AS reason, arg_min(k, p) AS superseded_by FROM al GROUP BY ALL)"""


def _cleanup(spark, sf_dir):
    return G.device_cleanup(view(spark, sf_dir, "v_devices"))


@query("device_cleanup", f"{CLEAN} SELECT id, uid, reason, superseded_by FROM cl")
def device_cleanup(spark, sf_dir):
    """W10, W11, F32."""
    return _cleanup(spark, sf_dir)


@query("cleanup_reasons", f"{CLEAN} SELECT reason, count(*) AS planned FROM cl GROUP BY reason")
def cleanup_reasons(spark, sf_dir):
    """A16."""
    return G.cleanup_reason_counts(_cleanup(spark, sf_dir))


@query("cleanup_summary", f"""{CLEAN} SELECT count(*) AS scanned_devices, count(DISTINCT uid) AS scanned_users, count(*) FILTER (enabled) AS enabled_devices,
  (SELECT count(*) FROM cl) AS planned FROM v_devices""")
def cleanup_summary(spark, sf_dir):
    """A17."""
    return G.cleanup_summary(view(spark, sf_dir, "v_devices"), _cleanup(spark, sf_dir))


@query("split_devices", f"{SPLIT} SELECT * FROM sd")
def split_devices(spark, sf_dir):
    """R5."""
    return A.split_devices(view(spark, sf_dir, "v_devices"))


@query("attach_enabled_devices", f"""{oracle_with('v_devices')} SELECT c_custkey AS deal_id, count(*) AS devices, sum(d.id)::BIGINT AS id_sum
FROM customer JOIN v_devices d ON d.uid = c_custkey AND d.enabled GROUP BY 1""")
def attach_enabled_devices(spark, sf_dir):
    """J11."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deal_id"), F.col("c_custkey").alias("uid"))
    return A.attach_enabled_devices(m, view(spark, sf_dir, "v_devices")).groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("devices"), F.sum("device_id").alias("id_sum"))


@query("drop_no_device", f"""{SPLIT} SELECT c_custkey AS deal_id, CASE WHEN sd.uid IS NOT NULL AND tokens + web_devices > 0 THEN 'ready' ELSE 'skipped' END AS status,
  CASE WHEN sd.uid IS NOT NULL AND tokens + web_devices > 0 THEN '' ELSE 'no_tokens' END AS reason FROM customer LEFT JOIN sd ON sd.uid = c_custkey""")
def drop_no_device(spark, sf_dir):
    """R4."""
    alerts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deal_id"), F.col("c_custkey").alias("uid"))
    return A.drop_no_device(alerts, A.split_devices(view(spark, sf_dir, "v_devices"))).select("deal_id", "status", "reason")


@query("notification_rows", r"""SELECT p_partkey AS uid, CASE WHEN p_size % 2 = 0 THEN 'digest' ELSE 'send' END AS kind,
  CASE WHEN term <> '' THEN 'Keyword alert: ' || term ELSE 'Keyword alert' END AS title,
  CASE WHEN p_size % 2 = 0 THEN term || ': ' || CAST(greatest(1, p_size) AS VARCHAR) || ' new deals are in.' ELSE p_name END AS body,
  CASE WHEN p_size % 2 = 0 THEN 'keyword-digest-' || left(sha1('digest::' || term), 16) ELSE CAST(p_partkey AS VARCHAR) END AS target_id
FROM (SELECT *, trim(split_part(p_name, ' ', 1)) AS term FROM part)""")
def notification_rows(spark, sf_dir):
    """R13."""
    a = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("uid"), F.col("p_partkey").alias("deal_id"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'digest' ELSE 'send' END").alias("kind"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("primary_term"), F.col("p_name").alias("title"), F.col("p_size").alias("digest_count"))
    return A.notification_rows(a).drop("tag")


@query("cap_rows", """WITH t AS (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50) SELECT event_id, (SELECT count(*) - 50 FROM events) AS dropped FROM t""")
def cap_rows(spark, sf_dir):
    """The push cap (a reporting limit of the feature) and the number left over."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    first, dropped = A.cap_rows(e, A.PUSH_CAP, F.col("ts").desc(), F.col("event_id").asc())
    return first.select("event_id").withColumn("dropped", dropped.scalar())


@query("limited_append", """WITH a AS (SELECT conv_id, turn, role, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations)
SELECT conv_id, turn, array_to_string((CASE WHEN list_contains(l, role) THEN l ELSE list_append(l, role) END)[-5:], '|') AS kept FROM a""")
def limited_append(spark, sf_dir):
    """T8 on the words of every turn."""
    kept = A.limited_unique_append(F.split("text", " "), F.col("role"), 5)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(kept, "|").alias("kept"))
