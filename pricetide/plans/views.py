"""Deal-feed views over the driver tables.

The same SELECT text runs in Spark and in the checking engine, so each view is stated once. ``{name}``
is replaced by a table (or an earlier view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.operators.scale import shuffled

NOW = "2024-01-31 00:00:00"
SOURCES = ["click", "error", "purchase", "signup", "view"]

VIEW_SQL = {
    "v_deals": """
SELECT event_id AS id, event_type AS source,
       CAST(event_id AS STRING) AS source_post_id,
       'https://board.example/' || event_type || '/views/' || CAST(event_id AS STRING) AS source_link,
       'deal ' || CAST(event_id % 400 AS STRING) AS title,
       CASE WHEN event_id % 23 = 0 THEN '무료' ELSE CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING) || '원' END AS price,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://img.example/' || CAST(event_id AS STRING) || '.webp' END AS img,
       CAST(FLOOR(value * 10) AS BIGINT) AS views,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS comments,
       user_id % 11 AS likes,
       CASE WHEN event_id % 37 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS dislikes,
       (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 - 3) * 2 AS comment_signal_score,
       CASE WHEN event_id % 41 = 0 THEN 4 ELSE 0 END AS negative_comment_signals,
       ts AS registered_at
FROM events""",
    "v_existing": """
SELECT id, source, source_post_id, source_link, title, price, img,
       CASE WHEN id % 8 = 0 THEN views + 1 ELSE views END AS views,
       comments, likes, registered_at,
       registered_at + CAST(id % 5 AS INT) * INTERVAL '1' HOUR AS updated_at,
       CASE WHEN id % 29 = 0 THEN registered_at END AS deleted_at
FROM v_deals WHERE id % 3 <> 0""",
    "v_incoming": """
SELECT id, source, source_post_id, source_link, title, price, img, views, comments, likes, registered_at, id AS pos
FROM v_deals WHERE id % 5 <> 0 AND NOT (source = 'error' AND id % 4 <> 1)""",
    "v_posts": """
SELECT p_partkey AS id, p_brand AS source,
       p_name || ' m' || CAST(p_partkey AS STRING) || ' ' || lower(p_type) || ' (' || CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING) || '원/무료)' AS title
FROM part""",
    "v_subscriptions": """
SELECT c.c_custkey AS uid, p.p_name || ' m' || CAST(p.p_partkey AS STRING) AS term, c.c_custkey % 5 <> 0 AS enabled
FROM customer c JOIN part p ON p.p_partkey = c.c_custkey""",
    "v_devices": """
SELECT event_id AS id, user_id AS uid, event_id % 7 <> 0 AS enabled,
       CASE WHEN event_id % 3 = 0 THEN 'standalone' ELSE 'browser' END AS display_mode,
       CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'installation_' || CAST(1000 + event_id % 12 AS STRING) ELSE '' END AS installation_id,
       'agent-' || CAST(event_id % 4 AS STRING) AS user_agent,
       CASE WHEN event_id % 5 <> 0 THEN 'ep' || CAST(event_id % 300 AS STRING) ELSE '' END AS endpoint,
       CASE WHEN event_id % 5 = 0 THEN 'fcm' || CAST(event_id % 50 AS STRING) ELSE '' END AS fcm_token,
       ts AS last_seen_at
FROM events""",
    "v_comments": """
SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS id,
       'conv-' || CAST(conv_id AS STRING) AS deal_key,
       CASE WHEN turn > 0 THEN CAST(conv_id AS STRING) || ':' || CAST(turn - 1 AS STRING) ELSE '' END AS parent_id,
       role AS nickname, text AS body, turn
FROM conversations""",
    "v_reports": """
SELECT doc_id AS id, doc_id % 4 AS target_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'pending' ELSE 'done' END AS status
FROM labels""",
    "v_objects": """
SELECT 'pages/' || CAST(page_id AS STRING) || '.html' AS path, length(html) AS size,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(page_id % 10 AS INT) * INTERVAL '1' DAY AS updated_at
FROM pages""",
    "v_pages": """
SELECT page_id, url, replace(replace(replace(html, '</head>',
         CASE WHEN page_id % 3 = 0 THEN '<meta property="og:title" content="Deal ' || CAST(page_id AS STRING) || ' &amp; more">'
              WHEN page_id % 3 = 1 THEN '<meta content="Offer ' || CAST(page_id AS STRING) || '" name="twitter:title">' ELSE '' END
         || CASE WHEN page_id % 2 = 0 THEN '<meta name="description" content="About ' || CAST(page_id AS STRING) || '">' ELSE '' END
         || CASE WHEN page_id % 5 = 0 THEN '<meta property="og:image" content="/og/' || CAST(page_id AS STRING) || '.png">' ELSE '' END
         || CASE WHEN page_id % 4 = 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"DiscussionForumPosting","datePublished":"2024-'
              || CASE WHEN page_id % 8 = 0 THEN '12-' ELSE '01-' END || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')
              || 'T10:00:00+09:00"},{"@type":"Product","offers":[{"url":"https://shop.example/item/' || CAST(page_id AS STRING) || '"}]}]}</script>'
              ELSE '' END || '</head>'),
         '</article>',
         CASE WHEN page_id % 7 = 0 THEN '<img src="/icons/logo.svg">' ELSE '' END
         || '<img src="/cache/thumb/' || CAST(page_id AS STRING) || '.webp"><img data-src="/img/' || CAST(page_id AS STRING)
         || CASE WHEN page_id % 11 = 0 THEN '_90x90' ELSE '_640x480' END || '.webp"><p>2024.01.' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')
         || ' 09:30</p><a href="' || url || '">self</a><a href="https://shop.example/item/' || CAST(page_id AS STRING) || '?from=feed">buy</a></article>'),
         '<footer>',
         '<div class="comment-count">2</div><div class="comment-list"><ul><li>' || CASE WHEN page_id % 3 = 0 THEN '역대급 감사합니다' ELSE '그냥' END
         || '</li><li>' || CASE WHEN page_id % 4 = 1 THEN '바이럴업체' ELSE '안 사요' END || '</li></ul></div><footer>') AS html
FROM pages""",
    "v_links": """
SELECT event_id AS id, ts AS registered_at,
       CASE event_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'delta' ELSE 'gamma' END AS source,
       CASE event_id % 5
         WHEN 0 THEN 'https://m.alpha.example/board/view?id=deals&page=2&no=' || CAST(user_id AS STRING) || '#reply'
         WHEN 1 THEN 'http://beta.example/board/sale/views/' || CAST(user_id AS STRING) || '?page=3'
         WHEN 2 THEN 'https://www.delta.example/board/20/read/' || CAST(user_id AS STRING)
         WHEN 3 THEN 'https://www.gamma.example/view?board=deals&doc=' || CAST(user_id AS STRING)
         ELSE CASE WHEN event_id % 2 = 0 THEN 'https://www.gamma.example/' || CAST(user_id AS STRING) ELSE 'https://www.gamma.example/best' END END AS link
FROM events""",
    "v_drafts": """
SELECT item_id AS id, item_id AS pos, p_name || ' ' || lower(p_type) AS title, text || ' ' || text || ' ' || text AS body,
       CASE WHEN item_id % 2 = 0 THEN p_name WHEN item_id % 3 = 0 THEN regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1) ELSE 'sku' || lpad(CAST(item_id AS STRING), 6, '0') END AS product,
       'https://youtu.be/video' || lpad(CAST(item_id AS STRING), 6, '0') AS source_url
FROM benchmark JOIN part ON p_partkey = item_id""",
    "v_board": """
SELECT doc_id AS id, doc_id AS pos, coalesce(p_name || ' ' || lower(p_type), '') AS title, text AS body, source AS author,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id % 200 AS INT) * INTERVAL '1' DAY - INTERVAL '170' DAY AS created_at,
       CASE WHEN doc_id % 50 = 0 THEN 'https://i.ytimg.com/vi/video' || lpad(CAST(CAST(FLOOR(doc_id / 50) AS BIGINT) AS STRING), 6, '0') || '/hq.jpg' ELSE '' END AS img
FROM documents LEFT JOIN part ON p_partkey = doc_id""",
    "v_refs": """
SELECT DISTINCT 'pages/' || CAST(doc_id AS STRING) || '.html' AS path FROM documents WHERE doc_id % 4 <> 1""",
}

VIEW_INPUTS = {
    "v_deals": ["events"], "v_existing": ["v_deals"], "v_incoming": ["v_deals"], "v_posts": ["part"],
    "v_subscriptions": ["customer", "part"], "v_devices": ["events"], "v_comments": ["conversations"],
    "v_reports": ["labels"], "v_objects": ["pages"], "v_refs": ["documents"],
    "v_pages": ["pages"], "v_links": ["events"], "v_drafts": ["benchmark", "part"], "v_board": ["documents", "part"],
}
# Views whose inputs all grow: none of them is broadcast.
GROWING_JOINS = {"v_subscriptions", "v_board"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Zone-less timestamps are read as instants (session zone UTC) by the reader itself,
    not by a cast, so time filters still reach Parquet."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema):
        return df
    instants = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in df.schema
    ]
    return spark.read.schema(T.StructType(instants)).parquet(path)


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for work that is heavy per row: when the scan has fewer tasks than the session has
    cores, or one of them holds over twice its share of the rows, its rows are dealt out first.

    A Parquet file is cut by bytes but read by row group, so few large groups leave most of its tasks empty. Counting the
    rows of each task reads no column."""
    df = table(spark, sf_dir, name)
    cores, tasks = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks < cores:
        return df.repartition(cores)
    held = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = held.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(tasks) if (most or 0) * cores > 2 * (rows or 0) else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; its inputs are passed by reference, so no temp view name can clash."""
    if name not in VIEW_SQL:
        return table(spark, sf_dir, name)
    inputs = {i: view(spark, sf_dir, i) for i in VIEW_INPUTS[name]}
    if name in GROWING_JOINS:
        inputs = {i: shuffled(df) for i, df in inputs.items()}
    text = VIEW_SQL[name].replace("{", "{{").replace("}", "}}")
    for i in inputs:
        for word in ("FROM ", "JOIN "):
            text = text.replace(f"{word}{i}", f"{word}{{{i}}}")
    return spark.sql(text, **inputs)


def oracle_with(*names: str) -> str:
    """``WITH`` prefix that defines the named views (and what they need) for the checking engine."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEW_SQL and name not in wanted:
            for i in VIEW_INPUTS[name]:
                add(i)
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in wanted)
