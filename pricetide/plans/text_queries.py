"""Keys, prices, times, links, pages and comment quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import keys as K
from pricetide.functions import prices as P
from pricetide.functions import text as X
from pricetide.functions import times as Z
from pricetide.functions import urls as U
from pricetide.operators import pages as G
from pricetide.operators import quality as Q
from pricetide.plans.registry import query, r, sql_ts, ts_text
from pricetide.plans.views import NOW, oracle_with, table, text_table, view
from pricetide.sources import feeds

T0 = f"TIMESTAMP '{NOW}'"
LINKS = f"""{oracle_with('v_links')}, pid AS (SELECT *, CASE source WHEN 'alpha' THEN regexp_extract(link, '[?&]no=([^&#]+)', 1) WHEN 'beta' THEN regexp_extract(link, '/views/([0-9]+)', 1)
  WHEN 'delta' THEN regexp_extract(link, '/read/([0-9]+)', 1)
  ELSE coalesce(nullif(regexp_extract(link, '[?&]doc=([^&#]+)', 1), ''), regexp_extract(link, 'gamma\\.example/(?:view/)?([0-9]+)', 1)) END AS p FROM v_links),
can AS (SELECT *, CASE WHEN p = '' THEN link WHEN source = 'alpha' THEN regexp_replace(link, '[?#].*$', '') || '?id=' || regexp_extract(link, '[?&]id=([^&#]+)', 1) || '&no=' || p
  WHEN source = 'beta' THEN 'https://beta.example/board/sale/views/' || p WHEN source = 'delta' THEN 'https://m.delta.example/board/20/read/' || p
  ELSE 'https://m.gamma.example/?board=deals&doc=' || p END AS canon,
  CASE WHEN p <> '' THEN p ELSE 'link:' || left(sha1(link), 12) END AS pf FROM pid)"""


@query("post_ids", f"{LINKS} SELECT id, p AS post_id, pf AS post_id_or_digest FROM can")
def post_ids(spark, sf_dir):
    """F1, F2."""
    src, link = F.col("source"), F.col("link")
    return view(spark, sf_dir, "v_links").select(
        "id", K.extract_post_id(src, link).alias("post_id"), K.post_id_or_fallback(src, link).alias("post_id_or_digest"))


@query("canonical_links", f"{LINKS} SELECT id, canon AS canonical FROM can")
def canonical_links(spark, sf_dir):
    """F3."""
    return view(spark, sf_dir, "v_links").select("id", K.canonical_link(F.col("source"), F.col("link")).alias("canonical"))


@query("deal_keys", f"""{LINKS} SELECT id, source || '::post::' || pf AS sync_key, source || '::' || link AS legacy_key,
  CASE WHEN source = 'alpha' THEN source || '::no:' || p WHEN source = 'beta' THEN source || '::view:' || p WHEN source = 'delta' THEN source || '::read:' || p
       WHEN p <> '' THEN source || '::doc:' || p ELSE source || '::' || link END AS feed_key,
  CASE WHEN id % 3 = 0 THEN 'id:' || CAST(id AS VARCHAR) || ':' || strftime(registered_at, '%Y-%m-%d') WHEN id % 3 = 1 THEN link ELSE 'title:t' || CAST(id AS VARCHAR) || ':' || strftime(registered_at, '%Y-%m-%d') END AS deal_key FROM can""")
def deal_keys(spark, sf_dir):
    """all four identities."""
    d = view(spark, sf_dir, "v_links")
    src, link, none = F.col("source"), F.col("link"), F.lit("")
    day = F.date_format("registered_at", "yyyy-MM-dd")
    return d.select(
        "id", K.sync_key(src, none, link).alias("sync_key"), K.legacy_key(src, link).alias("legacy_key"),
        K.canonical_feed_key(src, none, link).alias("feed_key"),
        K.deal_key(F.expr("CASE WHEN id % 3 = 1 THEN link END"), F.expr("CASE WHEN id % 3 = 0 THEN id END"),
                   F.expr("'t' || CAST(id AS STRING)"), day).alias("deal_key"))


@query("deal_ids", f"{oracle_with('v_deals')} SELECT id, sha1(source || '::' || source_link) AS deal_id FROM v_deals")
def deal_ids(spark, sf_dir):
    """F21."""
    d = view(spark, sf_dir, "v_deals")
    return d.select("id", K.deal_id(F.col("source"), F.col("source_link"), F.struct("id", "title")).alias("deal_id"))


@query("normalize_items", f"""{LINKS} SELECT id, source, canon AS source_link, pf AS source_post_id, canon AS buy_link,
  CASE WHEN id % 6 = 0 THEN '제목 없음' ELSE 'deal ' || CAST(id % 400 AS VARCHAR) END AS title, CASE WHEN id % 4 = 0 THEN '기타' ELSE 'food' END AS category,
  CASE WHEN id % 7 = 0 THEN 0 ELSE id % 50 END AS views, {sql_ts('registered_at')} AS registered_at FROM can""")
def normalize_items(spark, sf_dir):
    """feed items with gaps to stored rows."""
    n = F.lit(None)
    items = view(spark, sf_dir, "v_links").select(
        F.col("id").alias("pos"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("source"), F.col("link").alias("sourceLink"), F.lit("").alias("buyLink"),
        F.expr("CASE WHEN id % 6 = 0 THEN '  ' ELSE 'deal ' || CAST(id % 400 AS STRING) END").alias("title"),
        F.expr("CASE WHEN id % 4 = 0 THEN '' ELSE 'food' END").alias("category"), F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 50 END").alias("views"),
        F.date_format("registered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("registeredAt"),
        *[n.cast("string").alias(c) for c in ("area", "dist", "desc", "price", "img", "detailImg", "date", "time")],
        *[n.cast("int").alias(c) for c in ("likes", "dislikes", "comments", "commentSignalScore", "positiveCommentSignals", "negativeCommentSignals")])
    out = feeds.normalize_item(items)
    return out.select(F.col("pos").alias("id"), "source", "source_link", "source_post_id", "buy_link", "title", "category", "views",
                      ts_text("registered_at").alias("registered_at"))


# --- prices --------------------------------------------------------------------------------------

PRICE = """pt AS (SELECT event_id AS id, CASE event_id % 8
    WHEN 0 THEN CAST(n AS VARCHAR) || '원' WHEN 1 THEN CAST(n AS VARCHAR) || '만원대' WHEN 2 THEN '₩ ' || c || '!' WHEN 3 THEN c || ' shipped'
    WHEN 4 THEN CAST(n % 900 + 1 AS VARCHAR) || ' ' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || ' 원 set' WHEN 5 THEN '무료' WHEN 6 THEN CAST(n AS VARCHAR) || ' 천원' ELSE 'ask' END AS txt, n, c
  FROM (SELECT event_id, n, CAST(CAST(FLOOR(n / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') AS c
        FROM (SELECT event_id, CAST(FLOOR(value * 100) AS BIGINT) + 1000 AS n FROM events) a) b)"""


def _prices(spark, sf_dir):
    return spark.sql("WITH " + PRICE.replace("FROM events", "FROM {ev}").replace("VARCHAR", "STRING") + " SELECT * FROM pt", ev=table(spark, sf_dir, "events"))


@query("price_parse", f"""WITH {PRICE} SELECT id, coalesce(TRY_CAST(regexp_replace(regexp_extract(regexp_replace(txt, '\\s+', '', 'g'), '([0-9][0-9,]*)', 1), ',', '', 'g') AS BIGINT), 0)
  * CASE WHEN regexp_replace(txt, '\\s+', '', 'g') LIKE '%만원%' THEN 10000 WHEN regexp_replace(txt, '\\s+', '', 'g') LIKE '%천원%' THEN 1000 ELSE 1 END AS won FROM pt""")
def price_parse(spark, sf_dir):
    """F9."""
    return _prices(spark, sf_dir).select("id", P.parse_price_won(F.col("txt")).alias("won"))


@query("best_price", f"""WITH {PRICE} SELECT id, CASE id % 8 WHEN 0 THEN CAST(n AS VARCHAR) || '원' WHEN 1 THEN CAST(n AS VARCHAR) || '만원대' WHEN 2 THEN c || '원' WHEN 3 THEN c || '원'
  WHEN 4 THEN CAST(n % 900 + 1 AS VARCHAR) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || '원' WHEN 6 THEN CAST(n AS VARCHAR) || '천원' ELSE '' END AS price FROM pt""")
def best_price(spark, sf_dir):
    """the expected text follows from how each sample was written."""
    return _prices(spark, sf_dir).select("id", P.best_price(F.col("txt")).alias("price"))


@query("infer_price", f"""WITH {PRICE}, g AS (SELECT *, CASE id % 8 WHEN 0 THEN CAST(n AS VARCHAR) || '원' WHEN 1 THEN CAST(n AS VARCHAR) || '만원대' WHEN 2 THEN c || '원' WHEN 3 THEN c || '원'
  WHEN 4 THEN CAST(n % 900 + 1 AS VARCHAR) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || '원' WHEN 6 THEN CAST(n AS VARCHAR) || '천원' ELSE '' END AS bp FROM pt)
SELECT id, CASE WHEN id % 3 = 0 AND bp <> '' THEN bp WHEN id % 5 = 0 THEN '12,000원' WHEN id % 3 <> 0 AND bp <> '' THEN bp WHEN txt = '무료' THEN '무료' WHEN id % 3 = 1 THEN '다양'
  WHEN id % 2 = 0 THEN '가격 정보 확인' ELSE '' END AS price FROM g""")
def infer_price(spark, sf_dir):
    """the sample is the title for every third row, the text otherwise."""
    d = _prices(spark, sf_dir)
    title = F.expr("CASE WHEN id % 3 = 0 THEN txt WHEN id % 3 = 1 THEN '가격 다양' ELSE '' END")
    given = F.expr("CASE WHEN id % 5 = 0 THEN '12,000원' WHEN id % 2 = 0 THEN '가격 정보 확인' ELSE '' END")
    return d.select("id", P.infer_price(title, F.expr("CASE WHEN id % 3 = 0 THEN '' ELSE txt END"), given).alias("price"))


@query("clean_price", """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) || '원' WHEN 1 THEN CAST(user_id AS VARCHAR) || '원' ELSE CAST(user_id AS VARCHAR) || '원' END AS price FROM events""")
def clean_price(spark, sf_dir):
    """three spellings of the same amount."""
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN '￦ ' || CAST(user_id AS STRING) || '  (KRW)' WHEN 1 THEN '₩' || CAST(user_id AS STRING) || '원 원' ELSE CAST(user_id AS STRING) || '(KRW)' END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.clean_price(raw).alias("price"))


@query("count_suffix_parse", """SELECT event_id AS id, CAST(CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id * 1000 + 234 WHEN 2 THEN floor((user_id + 0.5) * 1000) WHEN 3 THEN user_id * 10000
  WHEN 4 THEN floor((user_id + 0.25) * 1000) ELSE 0 END AS BIGINT) AS n FROM events""")
def count_suffix_parse(spark, sf_dir):
    """F12."""
    u = "CAST(user_id AS STRING)"
    raw = F.expr(f"CASE event_id % 6 WHEN 0 THEN {u} WHEN 1 THEN ' ' || {u} || ',234' WHEN 2 THEN {u} || '.5천' WHEN 3 THEN {u} || ' 만' WHEN 4 THEN {u} || '.25K' ELSE 'views ' || {u} END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.parse_count(raw).alias("n"))


# --- times ---------------------------------------------------------------------------------------

REL = "CASE event_id % 9 WHEN 0 THEN CAST(user_id AS {S}) || '분 전' WHEN 1 THEN CAST(user_id AS {S}) || ' 시간 전' WHEN 2 THEN CAST(user_id % 9 AS {S}) || '일 전' WHEN 3 THEN '방금' WHEN 4 THEN '어제' " \
      "WHEN 5 THEN lpad(CAST(event_id % 24 AS {S}), 2, '0') || ':' || lpad(CAST(event_id % 60 AS {S}), 2, '0') WHEN 6 THEN '2023.' || lpad(CAST(event_id % 12 + 1 AS {S}), 2, '0') || '.' || lpad(CAST(event_id % 28 + 1 AS {S}), 2, '0') " \
      "WHEN 7 THEN lpad(CAST(event_id % 12 + 1 AS {S}), 2, '0') || '.' || lpad(CAST(event_id % 28 + 1 AS {S}), 2, '0') ELSE 'soon' END"


@query("relative_time_parse", f"""WITH x AS (SELECT event_id AS id, user_id AS u, event_id % 12 + 1 AS mo, event_id % 28 + 1 AS da, TIMESTAMP '2024-01-31 09:00:00' + CAST(event_id % 24 AS INT) * INTERVAL 1 HOUR + CAST(event_id % 60 AS INT) * INTERVAL 1 MINUTE
  - INTERVAL 9 HOUR - INTERVAL 9 HOUR AS ck FROM events)
SELECT id, strftime(CASE id % 9 WHEN 0 THEN {T0} - CAST(u AS INT) * INTERVAL 1 MINUTE WHEN 1 THEN {T0} - CAST(u AS INT) * INTERVAL 1 HOUR WHEN 2 THEN {T0} - CAST(u % 9 AS INT) * INTERVAL 1 DAY WHEN 3 THEN {T0} WHEN 4 THEN {T0} - INTERVAL 1 DAY
  WHEN 5 THEN CASE WHEN ck > {T0} + INTERVAL 5 MINUTE THEN ck - INTERVAL 1 DAY ELSE ck END
  WHEN 6 THEN make_timestamp(2023, mo, da, 0, 0, 0) - INTERVAL 9 HOUR
  WHEN 7 THEN CASE WHEN make_timestamp(2024, mo, da, 0, 0, 0) - INTERVAL 9 HOUR > {T0} + INTERVAL 10 MINUTE THEN make_timestamp(2023, mo, da, 0, 0, 0) ELSE make_timestamp(2024, mo, da, 0, 0, 0) END - INTERVAL 9 HOUR END, '%Y-%m-%d %H:%M:%S.%f') AS at FROM x""")
def relative_time_parse(spark, sf_dir):
    """F13, read in Seoul (now is 09:00 there)."""
    at = Z.parse_relative_time(F.expr(REL.format(S="STRING")), Z.as_ts(NOW))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ts_text(at).alias("at"))


@query("iso_parse", f"""SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE {sql_ts("date_trunc('second', ts)")} END AS at FROM events""")
def iso_parse(spark, sf_dir):
    """Z, offset, naive, and nonsense."""
    e = table(spark, sf_dir, "events")
    utc, seoul = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.from_utc_timestamp("ts", "Asia/Seoul"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(utc, F.lit("Z"))).when(k == 1, F.concat(seoul, F.lit("+09:00"))).when(k == 4, F.lit("2024-13-45T99")).otherwise(utc)
    return e.select(F.col("event_id").alias("id"), ts_text(Z.parse_iso(text)).alias("at"))


@query("buckets_and_ages", f"""SELECT event_id AS id, {sql_ts('time_bucket(INTERVAL 30 MINUTE, ts)')} AS bucket, round(greatest(0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3.6e9), 5) AS age,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS kst FROM events""")
def buckets_and_ages(spark, sf_dir):
    """F16, F17, F36."""
    t = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), ts_text(Z.bucket_30min(t)).alias("bucket"), r(Z.age_hours(t, "2024-01-20 00:00:00"), 5).alias("age"), Z.kst_label(t).alias("kst"))


# --- links ---------------------------------------------------------------------------------------

PREFIX = "https://store.example/public/deal-images/"


@query("storage_paths", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pages/' || CAST(page_id AS VARCHAR) || '.webp' WHEN 1 THEN 'pages/' || CAST(page_id AS VARCHAR) || '.webp' WHEN 2 THEN 'a b/' || CAST(page_id AS VARCHAR) || '.webp' ELSE '' END AS path FROM pages""")
def storage_paths(spark, sf_dir):
    """direct, with query and fragment, behind the image proxy, foreign."""
    i = "CAST(page_id AS STRING)"
    url = F.expr(f"""CASE page_id % 4 WHEN 0 THEN '{PREFIX}pages/' || {i} || '.webp?v=1#x' WHEN 1 THEN '{PREFIX}/pages/' || {i} || '.webp'
      WHEN 2 THEN 'https://wsrv.nl/?url=store.example%2Fpublic%2Fdeal-images%2Fa%20b%2F' || {i} || '.webp&w=640' ELSE url END""")
    return table(spark, sf_dir, "pages").select("page_id", U.storage_path(url, PREFIX).alias("path"))


@query("default_images", f"""SELECT event_id AS id, CASE WHEN event_id % 2 = 1 THEN 'kept.webp' WHEN event_id % 10 = 0 THEN 'p/defaults/naver-thumb-v1.webp' WHEN event_id % 10 = 2 THEN 'p/defaults/gmarket-thumb-v1.webp'
  WHEN event_id % 10 = 4 THEN 'p/defaults/ali-thumb-v1.webp' ELSE '' END AS img FROM events""")
def default_images(spark, sf_dir):
    """F20."""
    title = F.expr("CASE event_id % 10 WHEN 0 THEN '[네이버 페이] x' WHEN 2 THEN ' [G마켓] y' WHEN 4 THEN '[ 알리 ]z' ELSE 'plain [알리]' END")
    img = F.expr("CASE WHEN event_id % 2 = 1 THEN 'kept.webp' ELSE ' ' END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), U.default_image(title, img, "p/").alias("img"))


@query("outbound_links", """SELECT page_id, 'https://shop.example/p?a=' || CAST(page_id AS VARCHAR) AS target FROM pages WHERE page_id % 3 <> 2 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 3 = 2""")
def outbound_links(spark, sf_dir):
    """redirector with url=, with base64 target= (padding cut off), and none."""
    p = table(spark, sf_dir, "pages")
    target = F.concat(F.lit("https://shop.example/p?a="), F.col("page_id").cast("string"))
    k = F.col("page_id") % 3
    link = (
        F.when(k == 0, F.concat(F.lit("https://link.gamma.example/link.php?url="), F.url_encode(target)))
        .when(k == 1, F.concat(F.lit("https://s.alpha.example?target="), F.regexp_replace(F.base64(target.cast("binary")), "=+$", "")))
        .otherwise(F.col("url")))
    return p.select("page_id", U.outbound_link(link).alias("target"))


@query("video_keys", """SELECT event_id AS id, CASE WHEN event_id % 6 = 5 THEN '' ELSE 'youtube:vid_' || lpad(CAST(event_id AS VARCHAR), 7, '0') END AS key FROM events""")
def video_keys(spark, sf_dir):
    """watch, short link, shorts, embed, thumbnail, other host."""
    v = "'vid_' || lpad(CAST(event_id AS STRING), 7, '0')"
    url = F.expr(f"""CASE event_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?t=3&v=' || {v} WHEN 1 THEN 'https://youtu.be/' || {v} || '?si=a' WHEN 2 THEN 'https://m.youtube.com/shorts/' || {v}
      WHEN 3 THEN 'https://youtube.com/embed/' || {v} || '/' WHEN 4 THEN 'https://i3.ytimg.com/vi/' || {v} || '/hqdefault.jpg' ELSE 'https://vimeo.example/' || {v} END""")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), U.video_key(url).alias("key"))


# --- texts of the tables --------------------------------------------------------------------------

@query("count_texts", """WITH w AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \t\n\r]+')) AS w FROM documents),
c AS (SELECT doc_id, regexp_extract(lower(replace(w, ',', '')), '^([0-9]+([.][0-9]+)?)(k|천|만|백만)?$', 1) AS n, regexp_extract(lower(replace(w, ',', '')), '^([0-9]+([.][0-9]+)?)(k|천|만|백만)?$', 3) AS u FROM w),
v AS (SELECT doc_id, CASE WHEN n = '' THEN 0 ELSE coalesce(TRY_CAST(floor(CAST(n AS DOUBLE) * CASE u WHEN 'k' THEN 1000 WHEN '천' THEN 1000 WHEN '만' THEN 10000 WHEN '백만' THEN 1000000 ELSE 1 END) AS BIGINT), 9223372036854775807) END AS c FROM c)
SELECT doc_id, count(*) FILTER (c > 0) AS n_counts, max(c) AS largest FROM v GROUP BY doc_id""")
def count_texts(spark, sf_dir):
    """every word of every whole text; how many read as a count, and the largest of them."""
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w.rlike("^[0-9,]"))  # a count starts with a digit once commas are gone
    counts = text_table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(words).alias("word")).select(
        "doc_id", P.parse_count(F.col("word")).alias("n"))
    return counts.groupBy("doc_id").agg(F.count_if(F.col("n") > 0).alias("n_counts"), F.max("n").alias("largest"))


@query("price_texts", "SELECT o_orderkey AS id, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '원' AS price FROM orders")
def price_texts(spark, sf_dir):
    """order totals written in three ways."""
    n, k = F.format_number(F.floor("o_totalprice"), 0), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("￦ "), n, F.lit("  (KRW)"))).when(k == 1, F.concat(F.lit(" ₩"), n, F.lit("원 원"))).otherwise(F.concat(n, F.lit("(KRW)")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.clean_price(raw).alias("price"))


@query("board_time_labels", f"""WITH x AS (SELECT event_id AS id, ts, date_trunc('minute', ts + INTERVAL 9 HOUR) AS m FROM events)
SELECT id, {sql_ts(f'''CASE id % 4 WHEN 0 THEN m - INTERVAL 9 HOUR WHEN 1 THEN date_trunc('day', m) - INTERVAL 9 HOUR
  WHEN 2 THEN CASE WHEN ts <= {T0} THEN {T0} - to_minutes(CAST((epoch_us({T0}) - epoch_us(ts)) // 60000000 AS INT)) END
  ELSE m - INTERVAL 9 HOUR - CASE WHEN m - INTERVAL 9 HOUR > {T0} + INTERVAL 10 MINUTE THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END END''')} AS at FROM x""")
def board_time_labels(spark, sf_dir):
    """instants of the events as a board prints them in Seoul: full, day only, minutes ago, without a year (all of this year)."""
    local, k = F.from_utc_timestamp("ts", "Asia/Seoul"), F.col("event_id") % 4
    ago = F.expr(f"(unix_micros(TIMESTAMP '{NOW}') - unix_micros(ts)) div 60000000")
    label = (
        F.when(k == 0, F.date_format(local, "yyyy.MM.dd HH:mm")).when(k == 1, F.date_format(local, "yy-MM-dd"))
        .when((k == 2) & (F.col("ts") <= Z.as_ts(NOW)), F.concat(ago.cast("string"), F.lit("분 전"))).when(k == 3, F.date_format(local, "MM.dd HH:mm")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ts_text(Z.parse_relative_time(label, Z.as_ts(NOW))).alias("at"))


URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("page_storage_paths", f"SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' ELSE 'pages' || {URL_PATH} END AS path FROM pages")
def page_storage_paths(spark, sf_dir):
    """objects named after the paths of the pages: direct, behind the image proxy, foreign."""
    k, name = F.col("page_id") % 3, F.concat(F.lit("pages"), U.url_path(F.col("url")))
    url = (
        F.when(k == 0, F.concat(F.lit(PREFIX), name, F.lit("?v=2#top")))
        .when(k == 1, F.concat(F.lit("https://wsrv.nl/?w=640&url="), F.url_encode(F.concat(F.lit(PREFIX.removeprefix("https://")), name))))
        .otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", U.storage_path(url, PREFIX).alias("path"))


@query("page_outbound_links", "SELECT page_id, url AS target FROM pages")
def page_outbound_links(spark, sf_dir):
    """the addresses of the pages, with their queries and fragments, behind both redirectors and bare."""
    k = F.col("page_id") % 3
    link = (
        F.when(k == 0, F.concat(F.lit("https://link.gamma.example/link.php?n=1&url="), F.url_encode("url")))
        .when(k == 1, F.concat(F.lit("https://s.alpha.example?target="), F.url_encode(F.regexp_replace(F.base64(F.col("url").cast("binary")), r"[\r\n]", ""))))
        .otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", U.outbound_link(link).alias("target"))


PAGE_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query("page_default_images", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p/defaults/naver-thumb-v1.webp' WHEN 1 THEN 'p/defaults/ali-thumb-v1.webp' WHEN 2 THEN url ELSE
  CASE WHEN regexp_matches({PAGE_TITLE}, '^\\[ *알리 *\\]') THEN 'p/defaults/ali-thumb-v1.webp' ELSE '' END END AS img FROM pages""")
def page_default_images(spark, sf_dir):
    """titles of the pages behind a store's mark, a page with a picture, a title as it is."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    title = F.concat(F.when(k == 0, "[네이버 페이] ").when(k == 1, " [ 알리 ]").otherwise(""), F.expr(PAGE_TITLE))
    return pages.select("page_id", U.default_image(title, F.when(k == 2, F.col("url")), "p/").alias("img"))


@query("page_video_keys", "SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '' ELSE 'youtube:' || substr(md5(html), 1, 11) END AS key FROM pages")
def page_video_keys(spark, sf_dir):
    """a video id drawn from each page's text, in four kinds of links; the page's own address has none."""
    v, k = F.substring(F.md5("html"), 1, 11), F.col("page_id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), v)).when(k == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=9")))
        .when(k == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).when(k == 3, F.concat(F.lit("https://i.ytimg.com/vi_webp/"), v, F.lit("/0.webp")))
        .otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", U.video_key(url).alias("key"))


# --- markers, names ------------------------------------------------------------------------------

@query("reply_markers", r"""SELECT conv_id, turn, CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) ELSE '' END AS parent_id, text AS body FROM conversations""")
def reply_markers(spark, sf_dir):
    """marker written, then lifted again."""
    from pricetide.operators.serving import lift_reply_marker
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).otherwise(F.lit(""))
    marked = c.select("conv_id", "turn", X.with_reply_marker(F.col("text"), parent).alias("body"))
    return lift_reply_marker(marked).select("conv_id", "turn", "parent_id", "body")


@query("board_categories", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'mydeals' ELSE 'tips' END AS category, md5(regexp_replace(text, '^\n+', '')) AS body FROM documents""")
def board_categories(spark, sf_dir):
    """an unknown category becomes the default one; marking twice leaves one marker."""
    d = table(spark, sf_dir, "documents")
    cat = F.expr("CASE doc_id % 3 WHEN 0 THEN 'tips' WHEN 1 THEN ' mydeals ' ELSE 'other' END")
    once = X.with_board_marker(F.col("text"), cat)
    marked = d.select("doc_id", X.with_board_marker(once, cat).alias("b"))
    return marked.select("doc_id", X.board_category(F.col("b")).alias("category"), F.md5(X.board_body(F.col("b"))).alias("body"))


@query("names_and_modes", r"""SELECT c_custkey, left(regexp_replace(trim(replace(c_name, '#', '   ')), '\s+', ' ', 'g'), 24) AS nickname,
  CASE c_custkey % 3 WHEN 0 THEN 'google:' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'email:a' || CAST(c_custkey AS VARCHAR) || '@x.example' ELSE '' END AS user_key,
  CASE c_custkey % 4 WHEN 0 THEN 'standalone' WHEN 1 THEN 'webview' ELSE 'browser' END AS mode,
  CASE WHEN c_custkey % 2 = 0 THEN 'installation_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE '' END AS installation, left(trim(c_mktsegment), 5) AS cut FROM customer""")
def names_and_modes(spark, sf_dir):
    """F25, F31, F32."""
    k = "c_custkey"
    n = "CAST(c_custkey AS STRING)"
    return table(spark, sf_dir, "customer").select(
        k, K.normalize_nickname(F.replace("c_name", F.lit("#"), F.lit("   "))).alias("nickname"),
        K.user_key(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'google' END"), F.col(k).cast("string"), F.expr(f"CASE WHEN c_custkey % 3 = 1 THEN 'A' || {n} || '@X.example' END")).alias("user_key"),
        K.normalize_display_mode(F.expr("CASE c_custkey % 4 WHEN 0 THEN ' Fullscreen' WHEN 1 THEN 'WebView' WHEN 2 THEN 'tab' END")).alias("mode"),
        K.normalize_installation_id(F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN 'installation_' || lpad({n}, 6, '0') ELSE 'short' END")).alias("installation"),
        K.clean_string(F.col("c_mktsegment"), 5).alias("cut"))


@query("similarity_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text, E' \n\t\r')), '\s*[\[(]?(?:20\d{6}|20\d{2}[./-]\d{1,2}[./-]\d{1,2})[\])]?$', ''), 'https?://[^\s)]+', ' ', 'gi'),
  '[#*_`~>|\[\](){},.!?:;''"/\\+-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def similarity_text(spark, sf_dir):
    """F28 over whole documents."""
    return text_table(spark, sf_dir, "documents").select("doc_id", X.similarity_text(F.col("text")).alias("norm"))


# --- pages ---------------------------------------------------------------------------------------

META = r"""mm AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Deal ' || CAST(page_id AS VARCHAR) || ' & more' WHEN page_id % 3 = 1 THEN 'Offer ' || CAST(page_id AS VARCHAR)
  ELSE trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' ')) END AS title,
  CASE WHEN page_id % 2 = 0 THEN 'About ' || CAST(page_id AS VARCHAR) ELSE '' END AS description,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN page_id % 5 = 0 THEN '/og/' || CAST(page_id AS VARCHAR) || '.png' ELSE '/cache/thumb/' || CAST(page_id AS VARCHAR) || '.webp' END AS image FROM pages)"""


def _pages(spark, sf_dir):
    p = view(spark, sf_dir, "v_pages")
    cores = spark.sparkContext.defaultParallelism
    return p.repartition(cores) if p.rdd.getNumPartitions() < cores else p


@query("page_meta", f"WITH {META} SELECT page_id, title, description, image FROM mm")
def page_meta(spark, sf_dir):
    """X1."""
    return G.extract_meta(_pages(spark, sf_dir)).select("page_id", "title", "description", "image")


@query("useful_meta", f"WITH {META} SELECT page_id, page_id % 7 <> 0 AS useful FROM mm")
def useful_meta(spark, sf_dir):
    """Every seventh page answered with a challenge."""
    m = G.extract_meta(_pages(spark, sf_dir))
    title = F.when(F.col("page_id") % 7 == 0, F.lit("Just a  moment...")).otherwise(F.col("title"))
    return m.select("page_id", G.is_useful_meta(title, F.col("description"), F.col("image")).alias("useful"))


GONE = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "noscript", "iframe", "object", "svg", "canvas"))
LINE_TAGS = r"<br\s*/?>|</?(?:p|div|section|article|h[1-6]|li|blockquote|tr|table)\b[^>]*>"
TEXT = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)" + GONE.replace("{", "{{").replace("}", "}}")
    + "', ' ', 'gi'), '" + LINE_TAGS + "', chr(10), 'gi'), '<[^>]+>', ' ', 'g')")

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def decoded_sql(expr: str) -> str:
    for entity, char in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


@query("page_text", rf"SELECT page_id, trim(regexp_replace({decoded_sql(TEXT.format('html'))}, '\s+', ' ', 'g')) AS body FROM pages")
def page_text(spark, sf_dir):
    """X3 with all entities decoded."""
    return text_table(spark, sf_dir, "pages").select("page_id", G.html_to_text(F.col("html")).alias("body"))


@query("page_text_tags", r"SELECT page_id, md5(" + TEXT.format("html") + ") AS body FROM pages")
def page_text_tags(spark, sf_dir):
    """X3 up to the entities, expressions only."""
    return text_table(spark, sf_dir, "pages").select("page_id", F.md5(G.strip_tags(F.col("html"))).alias("body"))


COMM = "CASE WHEN page_id % 3 = 0 THEN '역대급 감사합니다' ELSE '그냥' END || ' ' || CASE WHEN page_id % 4 = 1 THEN '바이럴업체' ELSE '안 사요' END"


@query("comment_sections", f"SELECT page_id, {COMM} AS comments FROM pages")
def comment_sections(spark, sf_dir):
    """X4."""
    return _pages(spark, sf_dir).select("page_id", G.comment_section_text(F.col("html")).alias("comments"))


@query("page_comment_quality", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS positive_count, CASE WHEN page_id % 4 = 1 THEN 3 ELSE 1 END AS negative_count,
  greatest(-60, least(16, CASE WHEN page_id % 3 = 0 THEN 4 ELSE 0 END - CASE WHEN page_id % 4 = 1 THEN 24 ELSE 8 END)) AS score FROM pages""")
def page_comment_quality(spark, sf_dir):
    """X4 then M6 with the stored keyword lists; nested keywords count on their own."""
    t = _pages(spark, sf_dir).select("page_id", G.comment_section_text(F.col("html")).alias("t"))
    return Q.comment_quality(t, "t").select("page_id", "positive_count", "negative_count", "score")


@query("content_chunks", "SELECT page_id, regexp_extract(html, '<div class=\"ad\">(?s:.*?)</div>', 0) AS chunk FROM pages")
def content_chunks(spark, sf_dir):
    """X5 on the marked block of every page."""
    return text_table(spark, sf_dir, "pages").select("page_id", G.content_chunk(F.col("html"), "ad").alias("chunk"))


JLD = "'2024-' || CASE WHEN page_id % 8 = 0 THEN '12-' ELSE '01-' END || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00+09:00'"


@query("json_ld_nodes", f"""SELECT page_id, NULL AS node_type, NULL AS date_published, NULL AS offer_url FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 'DiscussionForumPosting', {JLD}, NULL FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 'Product', NULL, 'https://shop.example/item/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 4 = 0""")
def json_ld_nodes(spark, sf_dir):
    """The envelope node and its two graph nodes."""
    return G.json_ld_nodes(_pages(spark, sf_dir)).drop("url")


@query("published_at", f"""SELECT page_id, {sql_ts('''CASE WHEN page_id % 8 = 4 THEN make_timestamp(2024, 1, page_id % 28 + 1, 1, 0, 0)
  WHEN page_id % 28 + 1 = 15 THEN TIMESTAMP '2024-01-15 00:30:00' ELSE TIMESTAMP '2024-01-14 15:00:00' END''')} AS at FROM pages""")
def published_at(spark, sf_dir):
    """Structured dates that lie ahead are passed over; written ones must fall on the list date."""
    at = G.published_at(F.col("html"), F.lit("2024-01-15").cast("date"), Z.as_ts(NOW))
    return _pages(spark, sf_dir).select("page_id", ts_text(at).alias("at"))


@query("outbound_page_links", "SELECT page_id, 'https://shop.example/item/' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 4 = 0 THEN '' ELSE '?from=feed' END AS link FROM pages")
def outbound_page_links(spark, sf_dir):
    """Structured offer, else the first link to another host."""
    return _pages(spark, sf_dir).select("page_id", G.first_outbound_link(F.col("html"), U.url_host(F.col("url"))).alias("link"))


@query("page_images", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN page_id % 11 = 0 THEN '/cache/thumb/' || CAST(page_id AS VARCHAR) ELSE '/img/' || CAST(page_id AS VARCHAR) || '_640x480' END || '.webp' AS image FROM pages")
def page_images(spark, sf_dir):
    """The small picture is refused, the low-quality one is the last resort."""
    return G.first_content_image(_pages(spark, sf_dir))


@query("canonical_url_dedup", r"""SELECT canonical, min(page_id) AS first_page_id, count(*) AS copies FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http://', 'https://'), '/+$', '') AS canonical FROM pages) GROUP BY 1""")
def canonical_url_dedup(spark, sf_dir):
    """F3, generic form, with its dedup."""
    return G.canonical_url_dedup(table(spark, sf_dir, "pages"), K.canonical_url(F.col("url")))


# --- quality -------------------------------------------------------------------------------------

POS, NEG = ["the", "der", "la"], ["worthless", "thing", "thin"]


@query("comment_quality", f"""WITH c AS (SELECT doc_id, {' + '.join(f"len(regexp_extract_all(lower(text), '{k}'))" for k in POS)} AS p, {' + '.join(f"len(regexp_extract_all(lower(text), '{k}'))" for k in NEG)} AS n FROM documents)
SELECT doc_id, p AS positive_count, n AS negative_count, greatest(-60, least(16, p * 2 - n * 8)) AS score FROM c""")
def comment_quality(spark, sf_dir):
    """M6 over whole documents with word lists of the test languages; 'thin' lies inside 'thing'."""
    out = Q.comment_quality(text_table(spark, sf_dir, "documents"), "text", POS, NEG)
    return out.select("doc_id", "positive_count", "negative_count", "score")


@query("comment_quality_turns", f"""WITH c AS (SELECT conv_id, turn, {' + '.join(f"len(regexp_extract_all(lower(text), '{k}'))" for k in POS)} AS p, {' + '.join(f"len(regexp_extract_all(lower(text), '{k}'))" for k in NEG)} AS n FROM conversations)
SELECT conv_id, turn, greatest(-60, least(16, p * 2 - n * 8)) AS score FROM c""")
def comment_quality_turns(spark, sf_dir):
    """M6 on conversation turns."""
    return Q.comment_quality(text_table(spark, sf_dir, "conversations"), "text", POS, NEG).select("conv_id", "turn", "score")


@query("parser_version_gate", "SELECT doc_id, 2 AS version, CASE WHEN doc_id % 3 = 2 THEN toxic * 3 + quality ELSE 0 END AS score FROM labels")
def parser_version_gate(spark, sf_dir):
    """X11: only rows of the current parser keep their signals."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("version"), (F.col("toxic") * 3 + F.col("quality")).alias("score"))
    return Q.parser_version_gate(rows, "version", ["score"])


@query("detail_reusable", r"""SELECT doc_id, doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR length(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_replace(text, '<!--[\s\S]*?-->|<[^>]*>', ' ', 'g') END, '[^\p{L}\p{N}]', '', 'g')) >= 2) AND trim(text) <> '' AS reusable FROM documents""")
def detail_reusable(spark, sf_dir):
    """Every third text is only a link."""
    d = text_table(spark, sf_dir, "documents")
    desc = F.when(F.col("doc_id") % 3 == 0, F.lit("<a>https://x.example/only</a>")).otherwise(F.col("text"))
    buy = F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://shop.example' END")
    return d.select("doc_id", Q.detail_reusable(desc, buy, F.expr("CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END")).alias("reusable"))
