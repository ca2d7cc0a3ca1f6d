"""Paged reads, comments, moderation, storage, similarity, feed files."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.functions.times import bucket_30min
from pricetide.functions.urls import video_key
from pricetide.operators import similarity as B
from pricetide.operators import serving as V
from pricetide.operators import storage as O
from pricetide.operators import sync as Y
from pricetide.operators import temperature as M
from pricetide.plans.model_queries import D as WINDOW_SQL
from pricetide.plans.model_queries import W, score_sql, window_deals
from pricetide.plans.registry import query, r, sql_ts, ts_text
from pricetide.plans.views import NOW, oracle_with, table, text_table, view
from pricetide.session import work_path
from pricetide.sources import feeds, tables
from pricetide.streaming import jobs as J

T0 = f"TIMESTAMP '{NOW}'"


@query("sort_deals", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events")
def sort_deals(spark, sf_dir):
    """The order itself is checked, so the place is written beside the row."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("pos"), F.col("ts").alias("registered_at"))
    # The sorted rows are numbered partition by partition: offsets come from the partition sizes.
    ranged = V.sort_deals(e).withColumn("_part", F.spark_partition_id()).withColumn(
        "_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    stored = Y.scale.cut_lineage(ranged)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = Y.scale.broadcast_checked(sizes.withColumn("_before", before).select("_part", "_before"))
    return stored.join(offsets, "_part").select("event_id", (F.col("_in") + F.col("_before") + 1).alias("place"))


@query("feed_page", f"""{oracle_with('v_deals')}, d AS (SELECT * FROM v_deals WHERE {W}), p AS (SELECT id, source FROM d ORDER BY registered_at DESC, id DESC LIMIT 100 OFFSET 100)
SELECT id, source, (SELECT count(*) FROM d) > 200 AS has_more, 100 + (SELECT count(*) FROM p) AS next_offset FROM p""")
def feed_page(spark, sf_dir):
    """Second page of the window."""
    d = window_deals(spark, sf_dir).select("id", "source", "registered_at")
    return V.page(d, 100, 100, F.col("registered_at").desc(), F.col("id").desc()).drop("registered_at")


@query("feed_page_scored", f"""{WINDOW_SQL}, page AS (SELECT * FROM d ORDER BY registered_at DESC, id DESC LIMIT 100), pop AS (SELECT * FROM d), {score_sql('pop', 'page')}
SELECT id, source, temperature, hot_score FROM sc""")
def feed_page_scored(spark, sf_dir):
    """The paged read: first page scored by the profile of the whole window."""
    d = window_deals(spark, sf_dir)
    page = V.page(d, 100, 0, F.col("registered_at").desc(), F.col("id").desc()).drop("has_more", "next_offset")
    return M.scores_external(page, d, NOW).select("id", "source", "temperature", "hot_score")


@query("deep_page", """WITH p AS (SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET (SELECT count(*) // 2 FROM events))
SELECT event_id, event_type, (SELECT count(*) - count(*) // 2 FROM events) > 100 AS has_more, (SELECT count(*) // 2 FROM events) + (SELECT count(*) FROM p) AS next_offset FROM p""")
def deep_page(spark, sf_dir):
    """T2 half way down: counts by day, minute and so on lead to the page."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return V.page_at(e, 100, e.count() // 2, "ts", "event_id").drop("ts")


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 100")
def keyset_page(spark, sf_dir):
    """T2, deep: continue after the last row seen."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return V.page_after(e, 100, "ts", "event_id", "2024-01-15 00:00:00", 5000).drop("ts")


@query("delta_page", f"""{oracle_with('v_existing')}, d AS (SELECT * FROM v_existing WHERE updated_at > TIMESTAMP '2024-01-28 00:00:00')
SELECT id, (SELECT count(*) FROM d) > 150 AS has_more FROM d ORDER BY updated_at DESC, id DESC LIMIT 150""")
def delta_page(spark, sf_dir):
    """T3."""
    return V.delta_page(view(spark, sf_dir, "v_existing"), "2024-01-28 00:00:00", 150).select("id", "has_more")


@query("top_hot", f"{oracle_with('v_deals')} SELECT id, coalesce(nullif(likes, 0), views) AS heat FROM v_deals ORDER BY 2 DESC, id LIMIT 10")
def top_hot(spark, sf_dir):
    """T4: a row without a temperature is ranked by its views (likes stand in for the temperature)."""
    d = view(spark, sf_dir, "v_deals").withColumn("temperature", F.col("likes"))
    return V.top_hot(d).select("id", "heat")


@query("recent_rows", f"{oracle_with('v_existing')} SELECT id FROM v_existing ORDER BY updated_at DESC, id DESC LIMIT 8")
def recent_rows(spark, sf_dir):
    """T5."""
    return V.recent(view(spark, sf_dir, "v_existing"), 8, "updated_at").select("id")


@query("popular_order", f"{WINDOW_SQL}, {score_sql()} SELECT id, temperature FROM sc ORDER BY temperature DESC, registered_at DESC, id LIMIT 30")
def popular_order(spark, sf_dir):
    """First thirty of the popular tab."""
    return V.popular_order(M.temperature_scores(window_deals(spark, sf_dir), NOW)).limit(30).select("id", "temperature")


@query("top_candidates", f"""{oracle_with('v_deals')}, c AS (SELECT source AS channel, id AS pos, registered_at AS published_at, 'https://youtu.be/vid' || lpad(CAST(id % 900 AS VARCHAR), 5, '0') AS url, id FROM v_deals),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY channel ORDER BY pos) <= 10)
SELECT id, url FROM f WHERE id % 900 NOT IN (SELECT doc_id % 900 FROM documents WHERE doc_id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at DESC, pos) = 1""")
def top_candidates(spark, sf_dir):
    """T9."""
    c = view(spark, sf_dir, "v_deals").select(
        F.col("source").alias("channel"), F.col("id").alias("pos"), F.col("registered_at").alias("published_at"), "id",
        F.expr("'https://youtu.be/vid' || lpad(CAST(id % 900 AS STRING), 5, '0')").alias("url"))
    used = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(
        F.expr("'youtube:vid' || lpad(CAST(doc_id % 900 AS STRING), 5, '0')").alias("source_key"))
    return V.top_candidates(c.withColumn("source_key", video_key(F.col("url"))), used).select("id", "url")


@query("favorites", "SELECT DISTINCT c_custkey AS user_id, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def favorites(spark, sf_dir):
    """Orders as deals, each kept by its customer."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    deals = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("id:"), F.col("o_orderkey").cast("string")).alias("deal_key"))
    fav = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("id:"), F.col("o_orderkey").cast("string")).alias("deal_key"))
    return V.favorites_join(deals, fav).select("user_id", "id")


@query("favorites_of_user", "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 370")
def favorites_of_user(spark, sf_dir):
    """J12 for one user."""
    o = table(spark, sf_dir, "orders")
    deals = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("deal_key"))
    fav = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").cast("string").alias("deal_key"))
    return V.favorites_join(deals, fav, 370).select("id")


@query("comment_threads", f"{oracle_with('v_comments')} SELECT c.id, p.nickname AS parent_nickname, p.id IS NOT NULL AS is_reply FROM v_comments c LEFT JOIN v_comments p ON p.id = c.parent_id")
def comment_threads(spark, sf_dir):
    """J16."""
    return V.comment_thread(view(spark, sf_dir, "v_comments")).select("id", "parent_nickname", "is_reply")


@query("comment_depths", f"""{oracle_with('v_comments')}, t AS (SELECT id, id AS root_id, 0 AS depth FROM v_comments WHERE parent_id = '' OR parent_id NOT IN (SELECT id FROM v_comments)
  UNION ALL SELECT c.id, t.root_id, t.depth + 1 FROM t JOIN v_comments c ON c.parent_id = t.id) SELECT id, root_id, depth FROM t""")
def comment_depths(spark, sf_dir):
    """J16, full depth."""
    return V.comment_depths(view(spark, sf_dir, "v_comments"))


@query("comments_topn_per_key", f"{oracle_with('v_comments')} SELECT id, deal_key FROM v_comments WHERE deal_key IN (SELECT 'conv-' || CAST(doc_id AS VARCHAR) FROM labels) QUALIFY row_number() OVER (PARTITION BY deal_key ORDER BY turn DESC, id DESC) <= 3")
def comments_topn_per_key(spark, sf_dir):
    """J17 with a short list per key."""
    keys = table(spark, sf_dir, "labels").select(F.concat(F.lit("conv-"), F.col("doc_id").cast("string")).alias("deal_key"))
    return V.comments_for_keys(view(spark, sf_dir, "v_comments"), keys, 3, "turn").select("id", "deal_key")


@query("author_nicknames", """SELECT doc_id AS id, CASE WHEN s_suppkey % 40 < 25 THEN s_name WHEN doc_id % 3 = 0 THEN 'session ' || lang WHEN doc_id % 3 = 1 THEN source ELSE '익명' END AS author
FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % 1000""")
def author_nicknames(spark, sf_dir):
    """J19."""
    posts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 1000).alias("user_key"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'session ' || lang ELSE '' END").alias("session_name"),
        F.expr("CASE WHEN doc_id % 3 = 1 THEN source END").alias("author"))
    profiles = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_key"), F.expr("CASE WHEN s_suppkey % 40 < 25 THEN s_name ELSE ' ' END").alias("nickname"))
    return V.author_nickname(posts, profiles).select("id", "author")


@query("report_threshold", f"{oracle_with('v_reports')} SELECT target_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending') >= 5 AS hidden FROM v_reports GROUP BY target_id")
def report_threshold(spark, sf_dir):
    """A15."""
    return V.report_threshold(view(spark, sf_dir, "v_reports"))


@query("dashboard_summary", f"""{oracle_with('v_deals', 'v_reports')} SELECT (SELECT count(*) FROM v_deals) AS total_deals, (SELECT count(*) FROM v_deals WHERE CAST(registered_at AS DATE) = DATE '2024-01-30') AS today_deals,
  (SELECT count(*) FROM conversations) AS comments, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM documents) AS board_posts,
  (SELECT count(*) FROM v_reports WHERE status = 'pending') AS pending_reports, (SELECT count(*) FROM labels WHERE toxic = 0) AS active_notices""")
def dashboard_summary(spark, sf_dir):
    """A14."""
    notices = table(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("published"))
    return V.dashboard_summary(
        view(spark, sf_dir, "v_deals"), table(spark, sf_dir, "conversations"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents"),
        view(spark, sf_dir, "v_reports"), notices, "2024-01-30 18:00:00")


# --- storage -------------------------------------------------------------------------------------

CUT = "2024-01-07 00:00:00"
ORPHAN = f"updated_at < TIMESTAMP '{CUT}' AND path NOT IN (SELECT path FROM v_refs)"


@query("orphan_objects", f"{oracle_with('v_objects', 'v_refs')} SELECT path, size FROM v_objects WHERE {ORPHAN}")
def orphan_objects(spark, sf_dir):
    """J13."""
    return O.orphan_objects(view(spark, sf_dir, "v_objects"), view(spark, sf_dir, "v_refs"), CUT).select("path", "size")


@query("missing_references", f"{oracle_with('v_objects', 'v_refs')} SELECT path FROM v_refs WHERE path NOT IN (SELECT path FROM v_objects)")
def missing_references(spark, sf_dir):
    """J14 (large objects taken for lost)."""
    return O.missing_references(view(spark, sf_dir, "v_refs"), view(spark, sf_dir, "v_objects"))


@query("storage_usage", f"""{oracle_with('v_objects', 'v_refs')} SELECT count(*) AS objects, sum(size)::BIGINT AS storage_bytes, (SELECT count(*) FROM v_refs) AS referenced,
  count(*) FILTER ({ORPHAN}) AS orphans, coalesce(sum(size) FILTER ({ORPHAN}), 0)::BIGINT AS orphan_bytes FROM v_objects""")
def storage_usage(spark, sf_dir):
    """A18."""
    return O.storage_usage(view(spark, sf_dir, "v_objects"), view(spark, sf_dir, "v_refs"), CUT)


@query("referenced_paths", f"""{oracle_with('v_deals')} SELECT DISTINCT CAST(id % 300 AS VARCHAR) || '.webp' AS path FROM v_deals WHERE id % 4 <> 0
UNION SELECT DISTINCT 'full/' || CAST(likes AS VARCHAR) || '.webp' FROM v_deals UNION SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html' FROM pages WHERE page_id IN (1, 2)""")
def referenced_paths(spark, sf_dir):
    """Both picture columns and the default objects that exist."""
    p = "https://store.example/public/deal-images/"
    d = view(spark, sf_dir, "v_deals").select(
        F.expr(f"CASE WHEN id % 4 <> 0 THEN '{p}' || CAST(id % 300 AS STRING) || '.webp' ELSE '' END").alias("img"),
        F.expr(f"'{p}full/' || CAST(likes AS STRING) || '.webp?v=2'").alias("detail_img"))
    defaults = spark.createDataFrame([("pages/1.html",), ("pages/2.html",), ("pages/none.html",)], "path string")
    return O.referenced_paths(d, p, defaults, view(spark, sf_dir, "v_objects"))


# --- similarity ----------------------------------------------------------------------------------

SIM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0}, E' \n\t\r')), '\s*[\[(]?(?:20\d{{6}}|20\d{{2}}[./-]\d{{1,2}}[./-]\d{{1,2}})[\])]?$', ''), 'https?://[^\s)]+', ' ', 'gi'), '[#*_`~>|\[\](){{}},.!?:;''\"/\\+-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _token_sql(name: str, table_name: str, row_id: str) -> str:
    return f"{name} AS (SELECT DISTINCT {row_id} AS id, unnest(regexp_extract_all({SIM.format('text')}, '[0-9a-z가-힣]{{2,}}')) AS t FROM {table_name}), {name}n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)"


def _jaccard_sql(limit: float) -> str:
    return f"""WITH {_token_sql('a', 'benchmark', 'item_id')}, {_token_sql('b', 'documents', 'doc_id')},
i AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM a JOIN b USING (t) GROUP BY ALL)
SELECT l AS left_id, r AS right_id, round(c * 1.0 / (an.n + bn.n - c), 6) AS jaccard FROM i JOIN an ON an.id = l JOIN bn ON bn.id = r WHERE c * 1.0 / (an.n + bn.n - c) >= {limit}"""


@query("token_jaccard_pairs", _jaccard_sql(0.3))
def token_jaccard_pairs(spark, sf_dir):
    """J21, word sets: benchmark items against whole documents."""
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    right = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    p = B.token_jaccard_pairs(left, right, 0.3)
    return p.withColumn("jaccard", r(F.col("jaccard"), 6))


@query("token_jaccard_documents", f"""WITH {_token_sql('a', 'documents', 'doc_id')}, i AS (SELECT x.id AS l, y.id AS r, count(*) AS c FROM a x JOIN a y USING (t) GROUP BY ALL),
p AS (SELECT l, r FROM i JOIN an p ON p.id = l JOIN an q ON q.id = r WHERE c * 1.0 / (p.n + q.n - c) >= 0.8)
SELECT l AS left_id, count(*) AS similar FROM p GROUP BY l""")
def token_jaccard_documents(spark, sf_dir):
    """J21, word sets, documents against themselves: near copies per document."""
    d = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.similar_counts(d, d, 0.8)


@query("similar_text_join", f"""WITH {_token_sql('a', 'benchmark', 'item_id')}, {_token_sql('b', 'documents', 'doc_id')},
i AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM a JOIN b USING (t) GROUP BY ALL)
SELECT l AS draft_id, min(r) AS post_pos FROM i JOIN an ON an.id = l JOIN bn ON bn.id = r WHERE c * 1.0 / (an.n + bn.n - c) >= 0.3 GROUP BY l""")
def similar_text_join(spark, sf_dir):
    """J21 over whole texts: per benchmark item the first document with a similar word set."""
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    right = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.lit("").alias("title"), "text")
    return B.first_similar(left, right, 0.3).select("draft_id", "post_pos")


NAMES_SQL = "(SELECT p_partkey, p_name || ' ' || lower(p_type) AS text FROM part)"


@query("similar_titles", f"""WITH n AS {NAMES_SQL}, {_token_sql('a', 'n', 'p_partkey')},
sets AS (SELECT id, list_sort(list(t)) AS s, max(n) AS n FROM a JOIN an USING (id) GROUP BY id), u AS (SELECT s, any_value(id) AS id, count(*) AS w, max(n) AS n FROM sets GROUP BY s),
i AS (SELECT x.id AS l, y.id AS r, count(*) AS c FROM a x JOIN a y USING (t) WHERE x.id IN (SELECT id FROM u) AND y.id IN (SELECT id FROM u) GROUP BY ALL),
k AS (SELECT p.s, sum(q.w) AS "similar" FROM i JOIN u p ON p.id = l JOIN u q ON q.id = r WHERE c * 1.0 / (p.n + q.n - c) >= 0.72 GROUP BY p.s)
SELECT sets.id AS left_id, CAST(k."similar" AS BIGINT) AS "similar" FROM sets JOIN k USING (s)""")
def similar_titles(spark, sf_dir):
    """J21 on short texts: per product how many products have a similar name and kind."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return B.similar_counts(names, names, B.TITLE_LIMIT)


@query("similar_sequences", f"""WITH n AS (SELECT p_partkey AS id, {SIM.format("(p_name || ' ' || lower(p_type))")} AS t FROM part), u AS (SELECT t, count(*) AS w FROM n GROUP BY t),
k AS (SELECT a.t, sum(b.w) AS "similar" FROM u a JOIN u b ON levenshtein(a.t, b.t) <= floor(0.2 * greatest(length(a.t), length(b.t)) + 1e-9) GROUP BY a.t)
SELECT id AS left_id, CAST("similar" AS BIGINT) AS "similar" FROM n JOIN k USING (t)""")
def similar_sequences(spark, sf_dir):
    """J21, order of characters: per product how many products have a name and kind spelt alike."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return B.similar_sequences(names, names)


PC = r"replace({0}, ' ', '')"


@query("product_cooldown", f"""{oracle_with('v_drafts', 'v_board')}, d AS (SELECT id, {PC.format(SIM.format('product'))} AS k, string_split({SIM.format('product')}, ' ') AS ws FROM v_drafts),
p AS (SELECT pos, {PC.format(SIM.format("(title || ' ' || body)"))} AS k FROM v_board WHERE created_at >= {T0} - INTERVAL 120 DAY)
SELECT d.id AS draft_id, min(p.pos) AS post_pos FROM d JOIN p ON contains(p.k, d.k) OR contains(d.k, p.k) OR len(list_filter(d.ws, lambda w: length(w) >= 2 AND contains(p.k, w))) > 0 WHERE length(d.k) >= 2 GROUP BY 1""")
def product_cooldown(spark, sf_dir):
    """Drafts whose product a post of the last 120 days names, anywhere in its title or whole text."""
    return B.product_cooldown_join(view(spark, sf_dir, "v_drafts"), view(spark, sf_dir, "v_board"), NOW, looked_at=("title", "body")).select("draft_id", "post_pos")


@query("source_reuse", f"""{oracle_with('v_drafts', 'v_board')} SELECT id FROM v_drafts WHERE regexp_extract(source_url, 'video[0-9]+', 0) NOT IN
  (SELECT regexp_extract(img, 'video[0-9]+', 0) FROM v_board WHERE img <> '')""")
def source_reuse(spark, sf_dir):
    """J23."""
    return B.source_reuse(view(spark, sf_dir, "v_drafts"), view(spark, sf_dir, "v_board"), "source_url").select("id")


def _gate(spark, sf_dir):
    drafts = view(spark, sf_dir, "v_drafts")
    trusted = drafts.where("id % 3 <> 0").select(F.col("source_url").alias("url"))
    return B.draft_gate(drafts, view(spark, sf_dir, "v_board"), trusted, NOW, body_limit=0.5)


# Texts hold neither markers nor reference sections, so a plain body is the trimmed text.
GATE_SQL = f"""{oracle_with('v_drafts', 'v_board')},
d AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS ti, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS bo, {PC.format(SIM.format('product'))} AS k, string_split({SIM.format('product')}, ' ') AS ws FROM v_drafts),
b AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS ti, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS bo, {PC.format(SIM.format('title'))} AS k FROM v_board),
dt AS (SELECT id, ti AS text FROM d), bt AS (SELECT pos AS id, title AS text FROM b), db AS (SELECT id, bo AS text FROM d), bb AS (SELECT pos AS id, bo AS text FROM b WHERE length(bo) >= 100),
{_token_sql('dtt', 'dt', 'id')}, {_token_sql('btt', 'bt', 'id')}, {_token_sql('dbt', 'db', 'id')}, {_token_sql('bbt', 'bb', 'id')},
st AS (SELECT l AS id, min(r) AS pos FROM (SELECT x.id AS l, y.id AS r, count(*) AS c FROM dtt x JOIN btt y USING (t) GROUP BY ALL) JOIN dttn p ON p.id = l JOIN bttn q ON q.id = r WHERE c * 1.0 / (p.n + q.n - c) >= 0.72 GROUP BY l),
sb AS (SELECT l AS id, min(r) AS pos FROM (SELECT x.id AS l, y.id AS r, count(*) AS c FROM dbt x JOIN bbt y USING (t) GROUP BY ALL) JOIN dbtn p ON p.id = l JOIN bbtn q ON q.id = r WHERE c * 1.0 / (p.n + q.n - c) >= 0.5 GROUP BY l),
pc AS (SELECT d.id, min(b.pos) AS pos FROM d JOIN b ON b.created_at >= {T0} - INTERVAL 120 DAY AND (contains(b.k, d.k) OR contains(d.k, b.k) OR len(list_filter(d.ws, lambda w: length(w) >= 2 AND contains(b.k, w))) > 0) WHERE length(d.k) >= 2 GROUP BY 1),
gate AS (SELECT d.id, d.pos, d.source_url, array_to_string(list_filter([
  CASE WHEN length(d.ti) NOT BETWEEN 10 AND 70 THEN 'title_length' END, CASE WHEN length(d.bo) NOT BETWEEN 450 AND 1300 THEN 'body_length' END,
  CASE WHEN d.id % 3 = 0 THEN 'untrusted_source' END,
  CASE WHEN regexp_extract(d.source_url, 'video[0-9]+', 0) IN (SELECT regexp_extract(img, 'video[0-9]+', 0) FROM v_board WHERE img <> '') THEN 'source_already_used' END,
  'similar_title:' || left(x.ti, 60), 'similar_body:' || left(y.ti, 60), 'product_cooldown:' || z.ti,
  CASE WHEN length(d.k) < 2 THEN 'product_cooldown:invalid_product' END], lambda r: r IS NOT NULL), '|') AS reasons
  FROM d LEFT JOIN st USING (id) LEFT JOIN sb USING (id) LEFT JOIN pc USING (id)
  LEFT JOIN b x ON x.pos = st.pos LEFT JOIN b y ON y.pos = sb.pos LEFT JOIN b z ON z.pos = pc.pos)"""


@query("draft_gate", f"{GATE_SQL} SELECT id, reasons FROM gate")
def draft_gate(spark, sf_dir):
    """Reasons of every draft."""
    return _gate(spark, sf_dir).select("id", F.array_join("reasons", "|").alias("reasons"))


@query("first_valid", f"{GATE_SQL} SELECT id FROM gate WHERE reasons = '' ORDER BY pos LIMIT 1")
def first_valid(spark, sf_dir):
    """X13."""
    return B.first_valid(_gate(spark, sf_dir)).select("id")


@query("posted_today", f"{oracle_with('v_board')} SELECT bool_or(author IN ('src1', 'src2') AND CAST(created_at + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-28') AS posted_today FROM v_board")
def posted_today(spark, sf_dir):
    """X14."""
    return B.posted_today(view(spark, sf_dir, "v_board"), ["src1", "src2"], "2024-01-28 03:00:00")


# --- files and tables ----------------------------------------------------------------------------

def _folder(spark, name):
    return work_path(spark, name)


def _feed_files(spark, sf_dir):
    """Feed files written from the deals: one JSON document per source and half-hour, as a collector run writes it."""
    d = view(spark, sf_dir, "v_deals")
    item = F.struct(
        F.col("id").cast("string").alias("id"), "title", "price", "img", F.col("views").cast("int").alias("views"), F.col("comments").cast("int").alias("comments"),
        F.col("source_link").alias("sourceLink"), "source", F.date_format("registered_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("registeredAt"))
    run = bucket_30min(F.col("registered_at")).alias("run")
    doc = d.groupBy("source", run).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        F.col("source").alias("sourceKey"), (F.dayofmonth("run") == 3).alias("staleFallback"), F.expr("CASE WHEN source = 'view' THEN true END").alias("partialSnapshot"), "items")
    path = _folder(spark, "feeds")
    doc.write.json(path)
    return path


@query("read_feed_files", f"{oracle_with('v_deals')} SELECT CAST(id AS VARCHAR) AS id, source, title, views, {sql_ts(chr(39).join(['date_trunc(', 'second', ', registered_at)']))} AS registered_at FROM v_deals")
def read_feed_files(spark, sf_dir):
    """Feed documents written as JSON, read back with the explicit schema."""
    files = spark.read.schema(feeds.FEED_FILE).json(_feed_files(spark, sf_dir)).withColumn("file", F.col("_metadata.file_path"))
    items = feeds.feed_items(files)
    return items.select("id", "source", "title", "views", ts_text(feeds.parse_iso(F.col("registeredAt"))).alias("registered_at"))


@query("feed_protection_flags", f"{oracle_with('v_deals')} SELECT source, bool_or(day(registered_at) = 3 OR source = 'view') AS delete_protected, bool_or(day(registered_at) = 3) AS stale FROM v_deals GROUP BY source")
def feed_protection_flags(spark, sf_dir):
    """S2."""
    return feeds.feed_protection_flags(spark.read.schema(feeds.FEED_FILE).json(_feed_files(spark, sf_dir)))


@query("write_feed_snapshot", f"""{oracle_with('v_deals')} SELECT source AS source_key, CASE CAST(registered_at + INTERVAL 9 HOUR AS DATE) WHEN DATE '2024-01-30' THEN 'today' WHEN DATE '2024-01-29' THEN 'yesterday' ELSE 'older' END AS feed_day,
  count(*) AS items, sum(views)::BIGINT AS views FROM v_deals WHERE registered_at >= TIMESTAMP '2024-01-28' GROUP BY ALL""")
def write_feed_snapshot(spark, sf_dir):
    """Written by source, read back and counted."""
    path = _folder(spark, "snapshot")
    d = view(spark, sf_dir, "v_deals").where(F.col("registered_at") >= F.lit("2024-01-28 00:00:00").cast("timestamp"))
    feeds.write_feed_snapshot(d, path, "2024-01-30 06:00:00")
    back = spark.read.schema("id BIGINT, views BIGINT, feed_day STRING, source_key STRING").json(path)
    return back.groupBy("source_key", "feed_day").agg(F.count(F.lit(1)).alias("items"), F.sum("views").alias("views"))


@query("feed_metadata", f"""{oracle_with('v_deals')}, d AS (SELECT *, CAST(registered_at + INTERVAL 9 HOUR AS DATE) AS day FROM v_deals WHERE registered_at >= TIMESTAMP '2024-01-28')
SELECT source AS source_key, 48 AS range_hours, '2024-01-28 06:00:00.000000' AS since, '2024-01-30' AS today, '2024-01-29' AS yesterday, count(*) FILTER (day = DATE '2024-01-30') AS today_count,
  count(*) FILTER (day = DATE '2024-01-29') AS yesterday_count, count(*) AS total_count,
  coalesce(string_agg(source_post_id, '|' ORDER BY source_post_id) FILTER (views = 7), '') AS expired_post_ids FROM d GROUP BY source""")
def feed_metadata(spark, sf_dir):
    """The envelope written beside the items and read back."""
    path = _folder(spark, "snapshot")
    d = view(spark, sf_dir, "v_deals").where(F.col("registered_at") >= F.lit("2024-01-28 00:00:00").cast("timestamp"))
    feeds.write_feed_snapshot(d, path, "2024-01-30 06:00:00", d.where("views = 7").select("source", "source_post_id"))
    back = spark.read.schema(
        "range_hours INT, since TIMESTAMP, today STRING, yesterday STRING, today_count BIGINT, yesterday_count BIGINT, total_count BIGINT, "
        "expired_post_ids ARRAY<STRING>, source_key STRING").json(f"{path}_meta")
    return back.withColumns({"since": ts_text("since"), "expired_post_ids": F.array_join("expired_post_ids", "|")})


@query("stored_deals_scan", f"{oracle_with('v_deals')} SELECT id, views FROM v_deals WHERE source = 'click' AND registered_at >= TIMESTAMP '2024-01-20'")
def stored_deals_scan(spark, sf_dir):
    """Partitioned, clustered table; source prunes partitions, time reaches the reader."""
    path = _folder(spark, "deals")
    tables.write_deals(view(spark, sf_dir, "v_deals").select("id", "source", "views", "registered_at"), path)
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return tables.read_deals(spark, path, ["id", "views"], (F.col("source") == "click") & (F.col("registered_at") >= at))


@query("published_versions", f"{oracle_with('v_existing')} SELECT count(*) AS rows_now, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM v_existing WHERE deleted_at IS NULL")
def published_versions(spark, sf_dir):
    """A version is published, purged into the next one, and the newest is read."""
    root = _folder(spark, "table")
    tables.publish(view(spark, sf_dir, "v_existing"), root)
    tables.publish(Y.purge_soft_deleted(tables.read_current(spark, root)), root)
    return tables.read_current(spark, root).agg(F.count(F.lit(1)).alias("rows_now"), F.count("deleted_at").alias("deleted"))


@query("partition_upsert", f"""{oracle_with('v_existing', 'v_incoming')}, gone AS (SELECT id FROM v_existing WHERE registered_at < TIMESTAMP '2024-01-04'),
n AS (SELECT * FROM v_incoming WHERE registered_at >= TIMESTAMP '2024-01-28')
SELECT coalesce(n.id, o.id) AS id, coalesce(n.source, o.source) AS source, coalesce(n.views, o.views) AS views, {sql_ts('coalesce(n.registered_at, o.registered_at)')} AS registered_at
FROM (SELECT * FROM v_existing WHERE id NOT IN (SELECT id FROM gone)) o FULL OUTER JOIN n ON n.id = o.id""")
def partition_upsert(spark, sf_dir):
    """Rows of the window replace or join the stored ones, those older than it go; the days between are carried over."""
    root, by = _folder(spark, "days"), ["source", "unix_seconds(registered_at) div 86400"]
    columns = ["id", "source", "views", "registered_at"]
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    tables.publish(view(spark, sf_dir, "v_existing").select(*columns), root, by)
    fresh = view(spark, sf_dir, "v_incoming").select(*columns).where(F.col("registered_at") >= at("28"))
    tables.update(
        spark, root, lambda stored: Y.upsert(stored.where(F.col("registered_at") >= at("04")), fresh, ["id"]), by,
        touches=lambda stored: stored.join(fresh.select("id"), "id", "left_semi").unionByName(stored.where(F.col("registered_at") < at("04"))))
    tables.expire_versions(spark, root, 1)
    return tables.read_current(spark, root).withColumn("registered_at", ts_text("registered_at"))


LAST_EVENT = "SELECT user_id, event_type, max(event_id) AS last_event FROM events GROUP BY ALL"


@query("upsert_stream", LAST_EVENT)
def upsert_stream(spark, sf_dir):
    """Every micro-batch merges into a new table version."""
    return _upsert_stream(spark, sf_dir, False)


@query("upsert_stream_partitions", LAST_EVENT)
def upsert_stream_partitions(spark, sf_dir):
    """The table lies in hashed partitions of its key, and a batch reads and writes those its keys belong to."""
    return _upsert_stream(spark, sf_dir, True, ["pmod(user_id, 16)"])


@query("upsert_stream_shared", LAST_EVENT)
def upsert_stream_shared(spark, sf_dir):
    """Two streams with checkpoints of their own, each over half of the events, and a foreign version after each."""
    return _upsert_stream(spark, sf_dir, True)


def _upsert_stream(spark, sf_dir, shared, partition_by=()):
    root = _folder(spark, "merged")
    schema = "user_id BIGINT, event_type STRING, last_event BIGINT"
    tables.publish(spark.createDataFrame([], schema), root, partition_by)
    keys = ["user_id", "event_type"]
    touches = (lambda stored, batch: batch) if partition_by else None

    def merge(stored, batch):
        new = batch.groupBy(*keys).agg(F.max("event_id").alias("last_event"))
        old = stored.withColumnRenamed("last_event", "_old")
        return new.join(old, keys, "full_outer").select(*keys, F.greatest("last_event", "_old").alias("last_event"))

    events = table(spark, sf_dir, "events")
    for run in range(2 if shared else 1):
        checkpoint = _folder(spark, "merged-ckpt")
        stream = tables.read_documents_stream(spark, f"{sf_dir}/events*.parquet", events.schema)
        half = stream.where(F.col("event_id") % 2 == run) if shared else stream
        half.writeStream.foreachBatch(J.upsert_sink(root, merge, checkpoint, partition_by, touches)).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if shared:  # another writer of the table between the two streams
            tables.publish(tables.read_current(spark, root), root, partition_by)
    return tables.read_current(spark, root)


@query("ledger_stream", "SELECT DISTINCT event_type AS deal_id, user_id AS uid FROM events")
def ledger_stream(spark, sf_dir):
    """R3, exact: the streamed pairs the ledger lacks, once each."""
    root, checkpoint = _folder(spark, "ledger"), _folder(spark, "ledger-ckpt")
    stream = tables.read_documents_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    pairs = stream.select(F.col("event_type").alias("deal_id"), F.col("user_id").alias("uid"))
    q = pairs.writeStream.foreachBatch(J.ledger_sink(root, checkpoint)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(root).select("deal_id", "uid")
