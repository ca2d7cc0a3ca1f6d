"""Column functions on literal values."""

import pytest
from pyspark.sql import functions as F

from pricetide.functions import keys as K
from pricetide.functions import prices as P
from pricetide.functions import scoring as S
from pricetide.functions import text as X
from pricetide.functions import times as Z
from pricetide.functions import urls as U
from pricetide.operators import alerts as A
from pricetide.operators import pages as G
from pricetide.operators import quality as Q


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_post_ids(spark):
    rows = [
        ("alpha", "https://m.alpha.example/board/view?id=alpha&page=1&no=710000", "710000"),
        ("beta", "https://beta.example/board/sale/views/12?page=2", "12"),
        ("gamma", "https://m.gamma.example/?board=deals&doc=99", "99"),
        ("gamma", "https://www.gamma.example/view/77", "77"),
        ("delta", "https://m.delta.example/board/20/read/5", "5"),
        ("other", "https://x.example/9", ""),
        ("alpha", None, ""),
    ]
    df = spark.createDataFrame(rows, "s string, l string, want string")
    for r in df.select("want", K.extract_post_id(F.col("s"), F.col("l")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_sync_key_ignores_paging(spark):
    links = ["https://m.alpha.example/board/view?id=alpha&no=710000&page=2", "https://m.alpha.example/board/view?no=710000&id=alpha"]
    got = values(spark, lambda c: K.sync_key(F.lit("alpha"), F.lit(""), c), links)
    assert got == ["alpha::post::710000"] * 2


def test_fallback_digest(spark):
    got = values(spark, lambda c: K.post_id_or_fallback(F.lit("x"), c), ["https://a.example", ""])
    assert got[0].startswith("link:") and len(got[0]) == 17 and got[1] == ""


def test_best_price(spark):
    cases = {
        "모니터 919 000원 특가": "919,000원", "쿠폰 3만원대 / 2,500원": "2,500원", "￦68,400!": "68,400원", "about 68,400 total": "68,400원",
        "5원 30원": "30원", "no price": "", "100원짜리": "", "11,000원 12,000원": "12,000원",
    }
    assert values(spark, P.best_price, cases) == list(cases.values())


def test_infer_price(spark):
    df = spark.createDataFrame([
        ("[G] 12,000원", "9,000원", "", "12,000원"), ("t", "9,000원", "가격 정보 확인", "9,000원"), ("무료 나눔", "", "", "무료"),
        ("가격 다양", "", "", "다양"), ("t", "9,000원", "1,000원", "1,000원")], "t string, d string, p string, w string")
    for r in df.select("w", P.infer_price(F.col("t"), F.col("d"), F.col("p")).alias("g")).collect():
        assert r["g"] == r["w"]


def test_price_won_and_free(spark):
    assert values(spark, P.parse_price_won, ["27,920원", "3만원대", "2천원", "무료", None]) == [27920, 30000, 2000, 0, 0]
    assert values(spark, P.is_free_deal, ["무료", "100원", "101원", "다양", "0원"]) == [True, True, False, False, True]


def test_counts(spark):
    assert values(spark, P.parse_count, ["159", "1,234", "2.9천", "1만", "1.25K", "2백만", "x", None]) == [159, 1234, 2900, 10000, 1250, 2000000, 0, 0]


def test_relative_times(spark):
    now = Z.as_ts("2026-01-08 18:50:00")  # 03:50 on the 9th in Seoul
    cases = {
        "3분 전": "2026-01-08 18:47:00", "2 시간 전": "2026-01-08 16:50:00", "1일 전": "2026-01-07 18:50:00", "방금 전": "2026-01-08 18:50:00",
        "23:37": "2026-01-08 14:37:00", "03:10": "2026-01-08 18:10:00", "01.05": "2026-01-04 15:00:00", "12-31": "2025-12-30 15:00:00",
        "26.01.02": "2026-01-01 15:00:00", "2026-01-02": "2026-01-01 15:00:00", "2026.01.02 11:55": "2026-01-02 02:55:00", "어제": "2026-01-07 18:50:00",
        "02.30": None, "25:00": None, "unknown": None,
    }
    got = values(spark, lambda c: F.date_format(Z.parse_relative_time(c, now), "yyyy-MM-dd HH:mm:ss"), cases)
    assert got == list(cases.values())


def test_iso_and_buckets(spark):
    got = values(spark, lambda c: F.date_format(Z.bucket_30min(Z.parse_iso(c)), "HH:mm"), ["2026-05-29T09:47:00Z", "2026-05-29T18:29:59+09:00", "bad", ""])
    assert got == ["09:30", "09:00", None, None]


def test_normalize_text_and_terms(spark):
    assert values(spark, lambda c: X.normalize_text(c), ["<b>Sony</b> WH-1000 <!-- x -->특가!"]) == ["sony wh 1000 특가"]
    assert values(spark, X.normalize_term, [" Nintendo  Switch "]) == ["nintendo switch"]
    got = values(spark, lambda c: F.array_sort(X.candidate_terms(c)), ["a bc def", "", "x", None])
    assert got == [["a bc", "a bc def", "bc", "bc def", "def"], [], [], None]


def test_markers(spark):
    body = "<!--reply-to:ab!c:1-->\nhello"
    assert values(spark, X.reply_parent, [body, "plain"]) == ["abc:1", ""]
    assert values(spark, X.reply_body, [body, "plain"]) == ["hello", "plain"]
    assert values(spark, lambda c: X.board_category(X.with_board_marker(c, F.lit("mydeals"))), ["x"]) == ["mydeals"]


def test_similarity_text_drops_date_suffix(spark):
    a, b = values(spark, X.similarity_text, ["모니터는 거리부터 정해야 한다", "모니터는 거리부터 정해야 한다 (20260816)"])
    assert a == b


def test_video_keys(spark):
    urls = ["https://youtu.be/abcdef12345", "https://i.ytimg.com/vi/abcdef12345/hq.jpg", "https://www.youtube.com/watch?v=abcdef12345&t=1", "https://x.example/abcdef"]
    assert values(spark, U.video_key, urls) == ["youtube:abcdef12345"] * 3 + [""]


def test_storage_path(spark):
    p = "https://s.example/public/deal-images/"
    urls = [p + "a/1.webp?x=1", "https://wsrv.nl/?url=s.example%2Fpublic%2Fdeal-images%2Fa%2F1.webp&w=1", "https://other.example/a.webp", None]
    assert values(spark, lambda c: U.storage_path(c, p), urls) == ["a/1.webp", "a/1.webp", "", ""]


def test_outbound_links_with_coded_padding_and_plus(spark):
    base = "https://s.alpha.example?target="
    packed = "aHR0cHM6Ly9hLmV4YW1wbGUvP3E9fn4+"  # https://a.example/?q=~~>
    cases = {
        base + packed: "https://a.example/?q=~~>", base + packed.replace("+", "%2B"): "https://a.example/?q=~~>",
        base + "aHR0cHM6Ly9iLmV4%3D%3D": "https://b.ex", base + "aHR0cHM6Ly9iLmV4": "https://b.ex",
        "https://link.gamma.example/link.php?url=https%3A%2F%2Fc.example%2F%3Fa%3D1%26b%3D2": "https://c.example/?a=1&b=2",
        base + "%zz": base + "%zz", "https://d.example/": "https://d.example/",
    }
    assert values(spark, U.outbound_link, cases) == list(cases.values())


def test_normal_cdf(spark):
    got = values(spark, lambda c: S.normal_cdf(c.cast("double")), ["0", "1", "-1", "9"])
    assert got == pytest.approx([0.5, 0.8413447, 0.1586553, 0.9986501], abs=2e-7)


def test_manual_temperature(spark):
    assert values(spark, lambda c: S.manual_temperature(c.cast("double")), ["0", "55", "140", "-3", None]) == [100.0, 55.0, 100.0, 0.0, 100.0]
    assert values(spark, lambda c: S.manual_temperature(c.cast("double"), zero_is_full=False), ["0"]) == [0.0]


def test_limited_append(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "d"), (["a", "b"], "a"), (None, "x"), (["a"], " ")], "l array<string>, v string")
    got = [r[0] for r in df.select(A.limited_unique_append(F.col("l"), F.col("v"), 3)).collect()]
    assert got == [["b", "c", "d"], ["a", "b"], ["x"], ["a"]]


def test_comment_quality_counts_nested_keywords(spark):
    df = spark.createDataFrame([("바이럴업체 바이럴업체",), ("감사합니다 역대급",), (None,)], "t string")
    got = [(r["positive_count"], r["negative_count"], r["score"]) for r in Q.comment_quality(df, "t").collect()]
    assert got == [(0, 6, -48), (2, 0, 4), (0, 0, 0)]


def test_comment_section_only(spark):
    pages = [
        '<article>업체</article><div class="comment-list"><p>좋아요<script>x</script></p> 굿</div><p>밖</p>', "<article>업체</article>",
        '<div class="comment-count">3</div><ul id="reply"><li>a</li><li>b</li></ul>', None,
    ]
    assert values(spark, G.comment_section_text, pages) == ["좋아요 굿", "", "a b", ""]


def test_content_chunk_is_balanced(spark):
    page = '<div class="side">no</div><div class="xe_content a"><div>in<div>deep</div></div></div><div>after</div>'
    got = values(spark, lambda c: G.content_chunk(c, "xe_content"), [page, "<p>none</p>"])
    assert got == ['<div class="xe_content a"><div>in<div>deep</div></div></div>', ""]


def test_content_chunk_prefers_the_article_and_the_longest(spark):
    pages = [
        '<div class="x body">short</div><section class="body"><section>much longer</section> text</section>',
        '<div class="body">long long long text outside</div><ARTICLE><p>a</p><div class="body">in<section class="body">deep</section></div></article>',
        '<div class="body">open <b>end', '<div class="body"/><div class="somebody">no</div>', None,
        "<div class='body'>" + "<div>" * 20_000 + "x"]
    got = values(spark, lambda c: G.content_chunk(c, "body"), pages)
    assert got == [
        '<section class="body"><section>much longer</section> text</section>', '<div class="body">in<section class="body">deep</section></div>',
        '<div class="body">open <b>end', "", "", pages[5]]


def test_body_text_drops_what_is_not_read(spark):
    page = "a<!-- <p>no</p> --><noscript>no</noscript><svg><g>no</g></svg><li>b</li><h2>c</h2><iframe src='x'>no</iframe>d"
    assert values(spark, lambda c: G.html_to_text(c), [page]) == ["a b c d"]


def test_published_at_skips_future(spark):
    html = "sale 2026.12.31 10:00 posted 2026.06.01 08:15"
    got = values(spark, lambda c: F.date_format(G.published_at(c, F.lit("2026-06-01").cast("date"), Z.as_ts("2026-06-02 00:00:00")), "yyyy-MM-dd HH:mm"), [html, "none"])
    assert got == ["2026-05-31 23:15", "2026-05-31 15:00"]


def test_detail_reusable(spark):
    df = spark.createDataFrame([("text here", "b", 1), ("https://x.example/a", "b", 1), ("https://x.example/a", "b", 2), ("text", "", 2), ("쇼핑몰: A / 배송: 무료", "b", 1)], "d string, b string, v int")
    got = [r[0] for r in df.select(Q.detail_reusable(F.col("d"), F.col("b"), F.col("v"))).collect()]
    assert got == [True, False, True, False, False]


def test_comment_text_ends_with_its_container(spark):
    pages = {
        '<div class="comment-list">a<br>b<img></div><p>after</p>': "a b",
        '<ul id="reply"><li>one<li>two &amp; <input type=x>three</ul>tail': "one two & three",
        '<div class="memo"><p>open<span>inner</div>gone</span><div class="memo">more</div>': "openinner more",
        '<div class="comment"><script>if (a<b) x</script><style>p</style>seen<template>no<b>ne</b></template> too</div>': "seen too",
        '<div class="comment-count">3</div><DIV CLASS=comments>Loud</DIV>': "Loud",
        '<div class="comment">a<!-- <div> no -->b</div>c': "a b", '<br class="comment"/>x': "", '<div class="comment">never closed <b>x': "never closed x"}
    assert [t.replace(" ", "") for t in values(spark, G.comment_section_text, list(pages))] == [t.replace(" ", "") for t in pages.values()]


def test_structured_data_is_parsed_once(spark):
    pages = {
        1: '<script type="application/ld+json">{"@type":"Product","offers":[{"url":"https://a.example/1"}]}</script>',
        2: """<SCRIPT type='application/ld+json'> [{"@type":"A","datePublished":"2024-01-01T00:00:00Z"},{"@graph":[{"@type":"B","offers":{"url":"ftp://x"}},{"@type":7}]}] </SCRIPT>""",
        3: '<script type="application/ld+json">{"@type": oops</script><script type="application/ld+json">{"name":"é😀"}</script>', 4: "<p>none</p>", 5: None}
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    nodes = G.json_ld_nodes(df)
    got = sorted(tuple(x if x is not None else "" for x in r) for r in nodes.collect())
    assert got == sorted([(1, "Product", "", "https://a.example/1"), (2, "A", "2024-01-01T00:00:00Z", ""), (2, "", "", ""), (2, "B", "", ""), (2, "7", "", ""), (3, "", "", "")])
    assert nodes._jdf.queryExecution().executedPlan().toString().count("parseJson") <= 1
