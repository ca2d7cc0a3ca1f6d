"""Filters, dedup, change planning and stored-table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import prices as P
from pricetide.functions import text as X
from pricetide.functions.keys import BoardRule, legacy_key, sync_key
from pricetide.functions.times import as_ts, feed_window_kst, in_feed_window, is_future_dated, is_older_than
from pricetide.functions.urls import blocked_body_image, blocked_image_candidate, too_small_image
from pricetide.operators import dedup as D
from pricetide.operators import serving as V
from pricetide.operators import snapshots as N
from pricetide.operators import sync as Y
from pricetide.plans.registry import query, sql_ts, ts_text
from pricetide.plans.views import NOW, SOURCES, oracle_with, table, view

W = "registered_at BETWEEN TIMESTAMP '2024-01-29 00:00:00' AND TIMESTAMP '2024-01-31 00:10:00'"
T0 = f"TIMESTAMP '{NOW}'"


# --- filters -------------------------------------------------------------------------------------

@query("filter_eq_neq", f"{oracle_with('v_deals')} SELECT id, source FROM v_deals WHERE source <> 'error' AND price = '무료'")
def filter_eq_neq(spark, sf_dir):
    """P1, P5."""
    d = view(spark, sf_dir, "v_deals")
    return d.where((F.col("source") != "error") & (F.col("price") == "무료")).select("id", "source")


@query("filter_in_list", f"{oracle_with('v_deals')} SELECT id, source FROM v_deals WHERE source IN ('click', 'view')")
def filter_in_list(spark, sf_dir):
    """P2."""
    return view(spark, sf_dir, "v_deals").where(F.col("source").isin("click", "view")).select("id", "source")


@query("filter_range", f"{oracle_with('v_deals')} SELECT id FROM v_deals WHERE registered_at > TIMESTAMP '2024-01-10 00:00:00' AND registered_at <= TIMESTAMP '2024-01-20 12:00:00'")
def filter_range(spark, sf_dir):
    """Reaches the reader as PushedFilters."""
    at = F.col("registered_at")
    return view(spark, sf_dir, "v_deals").where(
        (at > as_ts("2024-01-10 00:00:00")) & (at <= as_ts("2024-01-20 12:00:00"))).select("id")


@query("filter_null", f"{oracle_with('v_existing')} SELECT id, deleted_at IS NULL AS active FROM v_existing WHERE deleted_at IS NOT NULL OR views > 1000")
def filter_null(spark, sf_dir):
    """P4."""
    e = view(spark, sf_dir, "v_existing")
    return e.where(F.col("deleted_at").isNotNull() | (F.col("views") > 1000)).select(
        "id", F.col("deleted_at").isNull().alias("active"))


@query("in_feed_window", f"{oracle_with('v_deals')} SELECT id, source FROM v_deals WHERE {W}")
def feed_window(spark, sf_dir):
    """P6."""
    return view(spark, sf_dir, "v_deals").where(in_feed_window(F.col("registered_at"), NOW)).select("id", "source")


@query("older_and_future", f"""{oracle_with('v_existing')}
SELECT id, registered_at < TIMESTAMP '2024-01-05' AS old, updated_at > TIMESTAMP '2024-01-30 12:00:00' AS future FROM v_existing""")
def older_and_future(spark, sf_dir):
    """P7, P8."""
    e = view(spark, sf_dir, "v_existing")
    return e.select(
        "id", is_older_than(F.col("registered_at"), F.col("updated_at"), as_ts("2024-01-05 00:00:00")).alias("old"),
        is_future_dated(F.col("updated_at"), F.col("registered_at"), as_ts("2024-01-30 12:00:00")).alias("future"))


@query("feed_window_kst", f"""{oracle_with('v_existing')}
SELECT id FROM v_existing WHERE deleted_at IS NULL OR (deleted_at <= {T0} + INTERVAL 10 MINUTE AND (deleted_at >= TIMESTAMP '2024-01-20 20:00:00'
  OR CAST(deleted_at + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-21'))""")
def window_kst(spark, sf_dir):
    """Rows without a time stay at item level."""
    e = view(spark, sf_dir, "v_existing")
    return e.where(feed_window_kst(F.col("deleted_at"), as_ts(NOW), as_ts("2024-01-20 20:00:00"))).select("id")


@query("excluded_items", f"""{oracle_with('v_deals')}
SELECT id, source = 'click' AND lower(title) LIKE '%deal 1%' AS excluded FROM v_deals""")
def excluded_items(spark, sf_dir):
    """P10 with another source and phrase."""
    d = view(spark, sf_dir, "v_deals")
    return d.select("id", D.is_excluded(F.col("source"), F.col("title"), "click", "deal 1").alias("excluded"))


@query("filter_by_since", f"{oracle_with('v_existing')} SELECT id FROM v_existing WHERE coalesce(updated_at, registered_at) > TIMESTAMP '2024-01-28 06:00:00'")
def since(spark, sf_dir):
    """P11."""
    return V.filter_by_since(view(spark, sf_dir, "v_existing"), "2024-01-28 06:00:00").select("id")


@query("free_deals", f"""{oracle_with('v_deals')}
SELECT id, price FROM v_deals WHERE price = '무료' OR CAST(regexp_extract(price, '([0-9]+)', 1) AS BIGINT) BETWEEN 0 AND 100""")
def free_deals(spark, sf_dir):
    """P13."""
    return view(spark, sf_dir, "v_deals").where(P.is_free_deal(F.col("price"))).select("id", "price")


@query("search_filter", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' OR lower(p_type) LIKE '%red%'")
def search(spark, sf_dir):
    """P14."""
    return V.search_filter(table(spark, sf_dir, "part"), " Red ", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("blocked_images", f"""{oracle_with('v_deals')}
SELECT id, NOT (x LIKE 'http%') OR x LIKE '%noimage%' AS blocked FROM (SELECT id, CASE WHEN id % 9 = 0 THEN replace(img, '.webp', '/noImage.gif') ELSE img END x0 FROM v_deals) q,
LATERAL (SELECT lower(x0) x)""")
def blocked_images(spark, sf_dir):
    """P15."""
    d = view(spark, sf_dir, "v_deals")
    img = F.when(F.col("id") % 9 == 0, F.replace("img", F.lit(".webp"), F.lit("/noImage.gif"))).otherwise(F.col("img"))
    return d.select("id", blocked_image_candidate(F.col("source"), img).alias("blocked"))


BODY_IMAGES = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 'https://img.example/' END || CASE user_id % 8 WHEN 0 THEN 'LOGO/' WHEN 1 THEN 'level/' WHEN 2 THEN 'Avatar_' WHEN 3 THEN 'x/level/' WHEN 4 THEN 'icon-' WHEN 5 THEN 'store/' ELSE '' END
  || CAST(event_id AS STRING) || '.png' AS url FROM events"""


@query("blocked_body_images", f"""SELECT id, url NOT LIKE 'http%' OR (source = 'alpha' AND regexp_matches(lower(url), 'logo|avatar|icon'))
  OR (source = 'beta' AND regexp_matches(lower(url), '/level/|/store/|avatar')) AS blocked FROM ({BODY_IMAGES})""")
def blocked_body_images(spark, sf_dir):
    """The lists of the boards."""
    d = spark.sql(BODY_IMAGES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return d.select("id", blocked_body_image(F.col("source"), F.col("url")).alias("blocked"))


@query("small_images", """SELECT event_id AS id, (user_id % 90 + 20 <= 100) OR (event_id % 300 + 50 <= 100) AS small FROM events""")
def small_images(spark, sf_dir):
    """Size written into the link in three notations."""
    w, h = F.col("user_id") % 90 + 20, F.col("event_id") % 300 + 50
    base = F.lit("https://img.example/a")
    url = (
        F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("-"), w, F.lit("x"), h, F.lit(".webp")))
        .when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("-"), w, F.lit("_"), h, F.lit(".webp")))
        .otherwise(F.concat(base, F.lit(".webp?w="), w, F.lit("&h="), h)))
    none = F.lit(None).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), too_small_image(none, none, url).alias("small"))


@query("broad_keywords", "SELECT p_partkey, length(regexp_extract(p_name, '^([a-z]+)', 1)) <= 2 OR regexp_extract(p_name, '^([a-z]+)', 1) IN ('red', 'hot') AS broad, length(p_name) BETWEEN 2 AND 20 AS valid FROM part")
def broad_keywords(spark, sf_dir):
    """P17, P18."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.broad_keyword(F.regexp_extract("p_name", "^([a-z]+)", 1), ["red", "hot"]).alias("broad"),
                    X.valid_keyword_length(F.col("p_name")).alias("valid"))


@query("active_notices", "SELECT doc_id FROM labels WHERE CASE WHEN toxic = 1 THEN false WHEN quality = 0 THEN NULL ELSE true END IS NOT FALSE")
def active_notices(spark, sf_dir):
    """Null counts as published."""
    n = table(spark, sf_dir, "labels").withColumn("published", F.expr("CASE WHEN toxic = 1 THEN false WHEN quality = 0 THEN NULL ELSE true END"))
    return V.active_notices(n).select("doc_id")


@query("require_fields", f"{oracle_with('v_deals')} SELECT id FROM v_deals WHERE trim(img) <> '' AND trim(title) <> ''")
def required(spark, sf_dir):
    """P20."""
    return D.require_fields(view(spark, sf_dir, "v_deals"), "img", "title").select("id")


# --- dedup ---------------------------------------------------------------------------------------

TITLED = "t AS (SELECT doc_id AS id, doc_id AS pos, source, lang, text AS title, source || '::' || CAST(n_chars AS VARCHAR) AS key FROM documents)"
KEYED = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"


def _titled(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "source", "lang",
        F.col("text").alias("title"), F.concat_ws("::", "source", F.col("n_chars").cast("string")).alias("key"))


@query("dedup_feed", f"""WITH {TITLED}, f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source, {KEYED} ORDER BY pos) = 1)
SELECT id, source, key FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1""")
def dedup_feed(spark, sf_dir):
    """W1, W16."""
    return D.dedup_feed(_titled(spark, sf_dir)).select("id", "source", "key")


@query("dedup_title", f"WITH {TITLED} SELECT id, title FROM t WHERE {KEYED} = '' OR id IN (SELECT min(id) FROM t GROUP BY {KEYED})")
def dedup_title(spark, sf_dir):
    """W6."""
    return D.dedup_title(_titled(spark, sf_dir)).select("id", "title")


@query("dedup_read", f"""{oracle_with('v_deals', 'v_existing')}
SELECT id, source, likes FROM v_existing QUALIFY row_number() OVER (PARTITION BY source, likes ORDER BY (img <> '')::INT DESC, updated_at DESC, id DESC) = 1""")
def dedup_read(spark, sf_dir):
    """Read-side key by a path rule."""
    e = view(spark, sf_dir, "v_existing")
    items = e.withColumn("source_post_id", F.lit("")).withColumn(
        "source_link", F.concat(F.lit("https://board.example/views/"), F.col("likes"), F.lit("?p="), F.col("id")))
    rules = {s: BoardRule(read_tag="view", read_path_pattern=r"/views/([0-9]+)") for s in SOURCES}
    return D.dedup_read(items, rules, pos="id").select("id", "source", "likes")


RESP = "(SELECT event_id AS pos, user_id AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://x.example/' || CAST(user_id AS VARCHAR) || event_type END AS source_link, CAST(ts AS DATE) AS date FROM events)"


def _responses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("id"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://x.example/' || CAST(user_id AS STRING) || event_type END").alias("source_link"),
        F.to_date("ts").alias("date"))


@query("dedup_response", f"""SELECT pos, id FROM {RESP} QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_link <> '' THEN source_link
  ELSE CAST(id AS VARCHAR) || ':' || CAST(date AS VARCHAR) END ORDER BY pos) = 1""")
def dedup_response(spark, sf_dir):
    """W5."""
    return D.dedup_response(_responses(spark, sf_dir)).select("pos", "id")


@query("union_user_and_feed", f"""WITH u AS (SELECT c_custkey AS pos, c_custkey % 60 AS id, '' AS source_link, DATE '2024-01-10' AS date, 0 AS o FROM customer),
b AS (SELECT * FROM u UNION ALL SELECT pos, id, source_link, date, 1 FROM {RESP})
SELECT pos, id, o = 0 AS from_user FROM b QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_link <> '' THEN source_link
  ELSE CAST(id AS VARCHAR) || ':' || CAST(date AS VARCHAR) END ORDER BY o, pos) = 1""")
def union_user_and_feed(spark, sf_dir):
    """U2, W5."""
    user = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 60).alias("id"), F.lit("").alias("source_link"),
        F.lit("2024-01-10").cast("date").alias("date"), F.lit(True).alias("from_user"))
    out = D.union_user_and_feed(user, _responses(spark, sf_dir))
    return out.select("pos", "id", F.coalesce("from_user", F.lit(False)).alias("from_user"))


@query("merge_nonempty", f"""{oracle_with('v_existing', 'v_incoming')}, b AS (SELECT title, img, price, id AS o FROM v_existing UNION ALL SELECT title, img, price, 1000000000 + id FROM v_incoming)
SELECT title, arg_max(img, o) FILTER (img <> '') AS img, arg_max(price, o) FILTER (price <> '') AS price FROM b GROUP BY title""")
def merge_nonempty(spark, sf_dir):
    """W7."""
    e, i = view(spark, sf_dir, "v_existing"), view(spark, sf_dir, "v_incoming")
    return D.dedup_merge_nonempty(
        e.select("title", "img", "price", F.col("id").alias("pos")), i.select("title", "img", "price", "pos"), "title", ["img", "price"])


@query("union_feeds", f"""{oracle_with('v_deals')} SELECT id, source, CASE WHEN source IN ('view', 'error') THEN dislikes END AS dislikes, CASE WHEN source = 'signup' THEN views END AS views FROM v_deals
WHERE source IN ('click', 'view', 'signup', 'error', 'purchase')""")
def union_feeds(spark, sf_dir):
    """Fields one feed lacks are null."""
    d = view(spark, sf_dir, "v_deals")
    feed = lambda name, *more: d.where(F.col("source") == name).select("id", "source", *more)
    return D.union_feeds(feed("click"), feed("view", "dislikes"), feed("signup", "views"), feed("error", "dislikes"), feed("purchase"))


@query("key_intersection", f"{oracle_with('v_existing', 'v_incoming')} SELECT source, title FROM v_existing INTERSECT SELECT source, title FROM v_incoming")
def key_intersection(spark, sf_dir):
    """U4."""
    return D.key_intersection(view(spark, sf_dir, "v_existing"), view(spark, sf_dir, "v_incoming"), ["source", "title"])


# --- change planning -----------------------------------------------------------------------------

EX = """ex AS (SELECT *, CASE WHEN id % 7 = 0 THEN source || '::' || source_link ELSE source || '::post::' || source_post_id END AS key FROM v_existing),
inc AS (SELECT *, source || '::post::' || source_post_id AS key, source || '::' || source_link AS legacy_key FROM v_incoming)"""
MATCH = """m AS (SELECT i.*, coalesce(a.key, b.key) AS pk, CASE WHEN a.key IS NOT NULL THEN a.id ELSE b.id END AS pid,
  CASE WHEN a.key IS NOT NULL THEN a.views ELSE b.views END AS pviews, CASE WHEN a.key IS NOT NULL THEN a.deleted_at ELSE b.deleted_at END AS pdel,
  CASE WHEN a.key IS NOT NULL THEN a.registered_at ELSE b.registered_at END AS preg
  FROM inc i LEFT JOIN ex a ON a.key = i.key LEFT JOIN ex b ON b.key = i.legacy_key)"""
SRC = "(VALUES " + ", ".join(f"('{s}')" for s in SOURCES) + ") s(source)"
BASE = f"{oracle_with('v_existing', 'v_incoming')}, {EX}, {MATCH}"


def plan_sql(prune: bool) -> str:
    cut = f"{T0} - INTERVAL 48 HOUR"
    expired = f"(registered_at < {cut} OR (pk IS NOT NULL AND preg < {cut}))" if prune else "false"
    old = f"registered_at < {cut}" if prune else "false"
    return f"""a AS (SELECT *, CASE WHEN {expired} THEN 'skip_expired' WHEN pk IS NULL THEN 'insert' WHEN pdel IS NOT NULL THEN 'reactivate'
    WHEN views <> pviews THEN 'update' ELSE 'unchanged' END AS action FROM m),
el AS (SELECT * FROM a WHERE action <> 'skip_expired'),
g AS (SELECT s.source, coalesce(e.n, 0) AS existing_rows, coalesce(c.n, 0) AS incoming_rows, i.source IS NULL OR (coalesce(e.n, 0) >= 10 AND coalesce(c.n, 0) < coalesce(e.n, 0) * 0.5) AS guarded
  FROM {SRC} LEFT JOIN (SELECT source, count(DISTINCT id) n FROM ex WHERE deleted_at IS NULL GROUP BY source) e USING (source)
  LEFT JOIN (SELECT source, count(*) n FROM el GROUP BY source) c USING (source) LEFT JOIN (SELECT DISTINCT source FROM inc) i USING (source)),
pl AS (SELECT action, key, pid AS id FROM a
  UNION ALL SELECT 'delete_expired', key, id FROM ex WHERE deleted_at IS NULL AND {old}
  UNION ALL SELECT CASE WHEN guarded THEN 'keep_guarded' ELSE 'delete_missing' END, key, id FROM ex JOIN g USING (source)
    WHERE deleted_at IS NULL AND NOT ({old}) AND key NOT IN (SELECT key FROM el UNION ALL SELECT legacy_key FROM el))"""


def planned_tables(spark, sf_dir):
    """Stored rows (every seventh under its old link key) and the new feed."""
    e, i = view(spark, sf_dir, "v_existing"), view(spark, sf_dir, "v_incoming")
    src, link = F.col("source"), F.col("source_link")
    key = sync_key(src, F.col("source_post_id"), link)
    existing = e.withColumn("key", F.when(F.col("id") % 7 == 0, legacy_key(src, link)).otherwise(key))
    return existing, i.withColumn("key", key).withColumn("legacy_key", legacy_key(src, link))


def _plan(spark, sf_dir, prune):
    existing, incoming = planned_tables(spark, sf_dir)
    return Y.plan_sync(incoming, existing, NOW, SOURCES, prune=prune)


@query("sync_match", f"{BASE} SELECT key, pk AS prev_key, pid AS prev_id FROM m")
def sync_match(spark, sf_dir):
    """J1."""
    existing, incoming = planned_tables(spark, sf_dir)
    return Y.sync_match(incoming, existing, ["id"]).select("key", "prev_key", "prev_id")


@query("sync_missing", f"{BASE} SELECT key, id FROM ex WHERE key NOT IN (SELECT key FROM inc UNION ALL SELECT legacy_key FROM inc)")
def sync_missing(spark, sf_dir):
    """J2."""
    existing, incoming = planned_tables(spark, sf_dir)
    return Y.sync_missing(existing, incoming).select("key", "id")


@query("sync_changed", f"{BASE} SELECT key, views <> pviews AS changed FROM m WHERE pk IS NOT NULL")
def sync_changed(spark, sf_dir):
    """P12."""
    existing, incoming = planned_tables(spark, sf_dir)
    cols = [c for c in Y.TRACKED_FIELDS if c in existing.columns and c in incoming.columns]
    m = Y.sync_match(incoming, existing, cols).where(F.col("prev_key").isNotNull())
    return m.select("key", Y.is_changed(m, "", "prev_", cols).alias("changed"))


@query("sync_plan", f"{BASE}, {plan_sql(True)} SELECT action, key, id FROM pl")
def sync_plan(spark, sf_dir):
    """J3, U3 with the 48-hour prune cutoff."""
    return _plan(spark, sf_dir, True).select("action", "key", "id")


@query("sync_plan_unpruned", f"{BASE}, {plan_sql(False)} SELECT action, key, id FROM pl")
def sync_plan_unpruned(spark, sf_dir):
    """J3 over all rows; the thinned source is guarded."""
    return _plan(spark, sf_dir, False).select("action", "key", "id")


@query("delete_guard", f"{BASE}, {plan_sql(False)} SELECT source, existing_rows, incoming_rows, guarded FROM g")
def delete_guard(spark, sf_dir):
    """A11-A13, U3."""
    existing, incoming = planned_tables(spark, sf_dir)
    matched = Y.sync_match(incoming, existing, ["registered_at"])
    return Y.delete_guard(existing, incoming, Y.eligible_incoming(matched, None), SOURCES).select(
        "source", "existing_rows", "incoming_rows", "guarded")


@query("expected_minus_current", f"{oracle_with('v_incoming')} SELECT s.source FROM (VALUES ('click'), ('view'), ('refund'), ('gift')) s(source) WHERE source NOT IN (SELECT source FROM v_incoming) UNION SELECT 'view'")
def expected_minus_current(spark, sf_dir):
    """Absent sources and the stale one."""
    return Y.expected_minus_current(spark, ["click", "view", "refund", "gift"], view(spark, sf_dir, "v_incoming"), ["view"])


@query("push_candidates", f"{BASE}, {plan_sql(True)} SELECT DISTINCT key FROM pl WHERE action IN ('insert', 'reactivate')")
def push_candidates(spark, sf_dir):
    """W15."""
    return Y.push_candidates(_plan(spark, sf_dir, True)).select("key")


@query("sync_apply", f"""{BASE}, {plan_sql(False)}, ch AS (SELECT * FROM a WHERE action IN ('insert', 'reactivate', 'update')),
gone AS (SELECT id FROM pl WHERE action IN ('delete_missing', 'delete_expired'))
SELECT coalesce(c.key, e.key) AS key, coalesce(e.id, c.id) AS id, CASE WHEN c.key IS NOT NULL THEN c.views ELSE e.views END AS views,
  CASE WHEN c.key IS NOT NULL THEN NULL WHEN d.id IS NOT NULL AND e.deleted_at IS NULL THEN {sql_ts(T0)} ELSE {sql_ts('e.deleted_at')} END AS deleted_at,
  CASE WHEN c.key IS NOT NULL OR (d.id IS NOT NULL AND e.deleted_at IS NULL) THEN {sql_ts(T0)} ELSE {sql_ts('e.updated_at')} END AS updated_at
FROM ex e FULL JOIN ch c ON c.pid = e.id LEFT JOIN gone d ON d.id = e.id""")
def sync_apply(spark, sf_dir):
    """The stored table after the plan."""
    existing, incoming = planned_tables(spark, sf_dir)
    payload = ["source", "source_post_id", "source_link", "title", "price", "img", "views", "comments", "likes", "registered_at"]
    out = Y.apply_plan(existing, incoming, Y.plan_sync(incoming, existing, NOW, SOURCES, prune=False), NOW, payload)
    return out.select("key", "id", "views", ts_text("deleted_at").alias("deleted_at"), ts_text("updated_at").alias("updated_at"))


@query("purge_soft_deleted", f"{oracle_with('v_existing')} SELECT id FROM v_existing WHERE source = 'view' OR deleted_at IS NULL")
def purge(spark, sf_dir):
    """S9 (one source plays the user rows)."""
    e = view(spark, sf_dir, "v_existing").withColumn("source", F.when(F.col("source") == "view", "user").otherwise(F.col("source")))
    return Y.purge_soft_deleted(e).select("id")


@query("soft_delete", f"""{oracle_with('v_existing')}, d AS (SELECT id, source, source_link, likes FROM v_existing WHERE comments = 3)
SELECT e.id, CASE WHEN e.comments = 3 AND e.deleted_at IS NULL THEN {sql_ts(T0)} ELSE {sql_ts('e.deleted_at')} END AS deleted_at FROM v_existing e""")
def soft_delete(spark, sf_dir):
    """Half of the deletes name the id, the others only source and link."""
    e = view(spark, sf_dir, "v_existing")
    d = e.where("comments = 3").select(F.expr("CASE WHEN likes % 2 = 0 THEN id END").alias("id"), "source", "source_link")
    return Y.soft_delete(e, d, NOW).select("id", ts_text("deleted_at").alias("deleted_at"))


@query("upsert_keyed", """WITH b AS (SELECT user_id, event_type AS deal_key, min(event_id) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL),
c AS (SELECT user_id, event_type AS deal_key, max(event_id) AS n FROM events WHERE value > 100 GROUP BY ALL)
SELECT user_id, deal_key, coalesce(c.n, b.n) AS n FROM b FULL JOIN c USING (user_id, deal_key)""")
def upsert_keyed(spark, sf_dir):
    """Favourites-like table keyed by (user, deal)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("deal_key"), "event_id", "value")
    base = e.where("deal_key <> 'view'").groupBy("user_id", "deal_key").agg(F.min("event_id").alias("n"))
    changes = e.where("value > 100").groupBy("user_id", "deal_key").agg(F.max("event_id").alias("n"))
    return Y.upsert(base, changes, ["user_id", "deal_key"])


DUPS = "dp AS (SELECT *, source || '::' || CAST(likes * 20 + comments AS VARCHAR) AS key FROM v_existing)"


def _dups(spark, sf_dir):
    return view(spark, sf_dir, "v_existing").withColumn(
        "key", F.concat_ws("::", "source", (F.col("likes") * 20 + F.col("comments")).cast("string")))


@query("pick_existing", f"""{oracle_with('v_existing')}, {DUPS}
SELECT key, id FROM dp QUALIFY row_number() OVER (PARTITION BY key ORDER BY (deleted_at IS NULL)::INT DESC, (img <> '')::INT DESC, updated_at DESC, id DESC) = 1""")
def pick_existing(spark, sf_dir):
    """W2."""
    return D.pick_existing(_dups(spark, sf_dir)).select("key", "id")


DUP_DELETES = """(SELECT id, source, source_link FROM dp WHERE deleted_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY (img <> '')::INT DESC, updated_at DESC, id ASC) > 1)"""


@query("duplicate_deletes", f"{oracle_with('v_existing')}, {DUPS} SELECT id, source FROM {DUP_DELETES}")
def duplicate_deletes(spark, sf_dir):
    """W3."""
    return D.duplicate_deletes(_dups(spark, sf_dir), SOURCES).select("id", "source")


@query("prune_deletes", f"{oracle_with('v_existing')} SELECT id FROM v_existing WHERE deleted_at IS NULL AND registered_at < {T0} - INTERVAL 48 HOUR")
def prune_deletes(spark, sf_dir):
    """P7 deletes."""
    return Y.prune_deletes(view(spark, sf_dir, "v_existing"), NOW, SOURCES).select("id")


@query("future_deletes", f"{oracle_with('v_existing')} SELECT id FROM v_existing WHERE deleted_at IS NULL AND registered_at > TIMESTAMP '2024-01-20 00:10:00'")
def future_deletes(spark, sf_dir):
    """P8 deletes, as seen from an earlier now."""
    return Y.future_deletes(view(spark, sf_dir, "v_existing"), "2024-01-20 00:00:00", SOURCES).select("id")


@query("delete_plan_union", f"""{oracle_with('v_existing')}, {DUPS}, u AS (
  SELECT id, 'duplicate' AS reason, 0 AS p FROM {DUP_DELETES}
  UNION ALL SELECT id, 'expired', 1 FROM dp WHERE deleted_at IS NULL AND registered_at < {T0} - INTERVAL 48 HOUR
  UNION ALL SELECT id, 'future', 2 FROM dp WHERE deleted_at IS NULL AND registered_at > TIMESTAMP '2024-01-20 00:10:00'
  UNION ALL SELECT id, 'policy', 3 FROM dp WHERE deleted_at IS NULL AND source = 'click' AND title LIKE '%deal 1%')
SELECT id, arg_min(reason, p) AS reason FROM u GROUP BY id""")
def delete_plan_union(spark, sf_dir):
    """U7, W14."""
    e = _dups(spark, sf_dir)
    policy = e.where(F.col("deleted_at").isNull() & D.is_excluded(F.col("source"), F.col("title"), "click", "deal 1"))
    return Y.delete_plan_union([
        ("duplicate", D.duplicate_deletes(e, SOURCES)), ("expired", Y.prune_deletes(e, NOW, SOURCES)),
        ("future", Y.future_deletes(e, "2024-01-20 00:00:00", SOURCES)), ("policy", policy),
    ]).select("id", "reason")


@query("append_id_deletes", f"""{oracle_with('v_existing')}, b AS (SELECT CASE WHEN id % 50 = 1 THEN NULL ELSE id END AS id, 'base' AS reason FROM v_existing WHERE likes = 1),
c AS (SELECT CASE WHEN id % 50 = 2 THEN NULL ELSE id END AS id, 'more' AS reason FROM v_existing WHERE likes <= 2)
SELECT id, reason FROM b UNION ALL SELECT id, reason FROM c WHERE id IS NULL OR id NOT IN (SELECT id FROM b WHERE id IS NOT NULL)""")
def append_id_deletes(spark, sf_dir):
    """Rows without id always stay."""
    e = view(spark, sf_dir, "v_existing")
    b = e.where("likes = 1").select(F.expr("CASE WHEN id % 50 = 1 THEN NULL ELSE id END").alias("id"), F.lit("base").alias("reason"))
    c = e.where("likes <= 2").select(F.expr("CASE WHEN id % 50 = 2 THEN NULL ELSE id END").alias("id"), F.lit("more").alias("reason"))
    return Y.append_id_deletes(b, c)


@query("snapshot_population", f"""{BASE}, {plan_sql(False)}, al AS (
  SELECT key, id, source, views, registered_at, deleted_at, 0 AS g FROM ex
  UNION ALL SELECT inc.key, inc.id, inc.source, inc.views, inc.registered_at, NULL, 1 FROM inc JOIN pl USING (key) WHERE action IN ('insert', 'reactivate', 'update'))
SELECT key, id, views FROM al WHERE deleted_at IS NULL AND {W} AND id NOT IN (SELECT id FROM pl WHERE action LIKE 'delete%' AND id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY g DESC, id DESC) = 1""")
def snapshot_population(spark, sf_dir):
    """A4."""
    existing, incoming = planned_tables(spark, sf_dir)
    plan = Y.plan_sync(incoming, existing, NOW, SOURCES, prune=False)
    changed = incoming.join(plan.where("action IN ('insert', 'reactivate', 'update')").select("key"), "key", "left_semi").withColumn(
        "deleted_at", F.lit(None).cast("timestamp"))
    cols = ["key", "id", "source", "title", "views", "registered_at", "deleted_at"]
    out = N.snapshot_population(
        incoming, existing.select(*cols, F.col("id").alias("pos")), changed.select(*cols, F.col("id").alias("pos")),
        plan.where("action LIKE 'delete%'"), NOW)
    return out.select("key", "id", "views")


@query("cached_detail_enrich", f"""{oracle_with('v_existing', 'v_incoming')}, pv AS (SELECT likes AS pid, title AS plink, id AS pos, img, price FROM v_existing),
a AS (SELECT * FROM pv WHERE pid % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pos DESC) = 1),
b AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY plink ORDER BY pos DESC) = 1)
SELECT i.id AS row_id, coalesce(nullif(CASE WHEN a.pid IS NOT NULL THEN a.img ELSE b.img END, ''), i.img) AS img,
  coalesce(nullif(CASE WHEN a.pid IS NOT NULL THEN a.price ELSE b.price END, ''), i.price) AS price, a.pid IS NOT NULL OR b.plink IS NOT NULL AS detail_cached
FROM v_incoming i LEFT JOIN a ON a.pid = i.likes LEFT JOIN b ON b.plink = i.title""")
def cached_detail_enrich(spark, sf_dir):
    """By id, else by link."""
    prev = view(spark, sf_dir, "v_existing").select(
        F.expr("CASE WHEN likes % 3 <> 0 THEN CAST(likes AS STRING) ELSE '' END").alias("id"), F.col("title").alias("link"),
        F.col("id").alias("pos"), "img", "price")
    rows = view(spark, sf_dir, "v_incoming").select(
        F.col("id").alias("row_id"), F.col("likes").cast("string").alias("id"), F.col("title").alias("link"), "img", "price")
    return Y.cached_detail_enrich(rows, prev, ["img", "price"]).select("row_id", "img", "price", "detail_cached")


@query("preserve_unseen", f"""{oracle_with('v_existing', 'v_incoming')}
SELECT id, 'new' AS origin FROM v_incoming UNION ALL SELECT id, 'kept' FROM v_existing
WHERE source_link NOT IN (SELECT source_link FROM v_incoming) AND source_post_id NOT IN (SELECT source_post_id FROM v_incoming)""")
def preserve_unseen(spark, sf_dir):
    """J5."""
    e = view(spark, sf_dir, "v_existing").select("id", "source_link", "source_post_id", F.lit("kept").alias("origin"))
    i = view(spark, sf_dir, "v_incoming").select("id", "source_link", "source_post_id", F.lit("new").alias("origin"))
    return Y.preserve_unseen(e, i, ["source_post_id", "source_link"]).select("id", "origin")


@query("page_tail_seen", f"""{oracle_with('v_existing', 'v_incoming')}, t AS (SELECT source || CAST(CAST(registered_at AS DATE) AS VARCHAR) AS page, source_link, id FROM v_incoming
  QUALIFY row_number() OVER (PARTITION BY source || CAST(CAST(registered_at AS DATE) AS VARCHAR) ORDER BY id DESC) <= 3)
SELECT page, bool_or(source_link IN (SELECT source_link FROM v_existing WHERE likes < 4)) AS tail_seen FROM t GROUP BY page""")
def page_tail_seen(spark, sf_dir):
    """One page per source and day."""
    rows = view(spark, sf_dir, "v_incoming").select(
        F.concat("source", F.to_date("registered_at").cast("string")).alias("page"), F.col("source_link").alias("key"), "pos")
    known = view(spark, sf_dir, "v_existing").where("likes < 4").select(F.col("source_link").alias("key"))
    return Y.page_tail_seen(rows, known)


@query("hidden_anti_join", f"""{oracle_with('v_deals')} SELECT id FROM v_deals
WHERE source_link NOT IN (SELECT source_link FROM v_deals WHERE comments = 0 AND likes = 0) AND source_post_id NOT IN (SELECT source_post_id FROM v_deals WHERE views > 1500)""")
def hidden_anti_join(spark, sf_dir):
    """J7."""
    d = view(spark, sf_dir, "v_deals")
    return Y.hidden_anti_join(
        d, d.where("comments = 0 AND likes = 0").select("source_link"), d.where("views > 1500").select("source_post_id")).select("id")
