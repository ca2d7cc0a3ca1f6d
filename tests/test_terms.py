"""Terms found in texts, against plain search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide.functions import text as X
from pricetide.operators import alerts as A
from pricetide.operators import similarity as B
from pricetide.operators import terms as R

NOW = "2026-08-16 12:00:00"
AT = dt.datetime(2026, 8, 16, 12, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = "ab c가나\U0001F600\n\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(200)} | {"ab", "abc", "abca", "bcab"})
    return texts + [None, "", "ab" * 50], terms


@pytest.mark.parametrize("block", [1, 64, R.BLOCK])
def test_terms_are_found_wherever_they_lie(spark, rows, block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    texts, terms = rows
    finder = R.term_finder(spark.createDataFrame([(t,) for t in terms] * 2 + [("",), (None,)], "term string"))
    found = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", finder("text").alias("held")).collect()
    assert {r["id"]: sorted(r["held"]) for r in found} == {i: [t for t in terms if t in (x or "")] for i, x in enumerate(texts)}


def test_no_terms_and_too_many(spark, monkeypatch):
    none = R.term_finder(spark.createDataFrame([], "term string"))
    assert spark.createDataFrame([("ab",)], "text string").select(none("text").alias("held")).first()["held"] == []
    monkeypatch.setattr(R, "TERM_ROWS", 1)
    assert R.term_finder(spark.createDataFrame([("a",), ("b",)], "term string")) is None


def cooldown(spark):
    drafts = spark.createDataFrame([(1, "blue ring"), (2, "sku000001"), (3, "old plate"), (4, "zz")], "id int, product string")
    filler = "long prose that names nothing of the kind " * 200
    posts = spark.createDataFrame([
        (1, "t", filler + "(2026.08.01)", AT), (2, "t", filler + "the old-plate " + filler, AT), (3, "t", filler + "a Ring", AT), (4, "", "late", AT)],
        "pos int, title string, body string, created_at timestamp")
    return {r["draft_id"]: r["post_pos"] for r in B.product_cooldown_join(drafts, posts, NOW, looked_at=("title", "body")).collect()}


def test_product_cooldown_keeps_no_long_text(spark, monkeypatch):
    """Same posts by either way; with few products no text longer than a product's name is written."""
    staged, plain = [], B.scale.cut_lineage
    monkeypatch.setattr(B.scale, "cut_lineage", lambda df: staged.append(out := plain(df)) or out)
    want = {1: 3, 3: 2}
    assert cooldown(spark) == want
    assert max(df.agg(F.max(F.char_length("key"))).first()[0] or 0 for df in staged if "key" in df.columns) <= len("sku000001")
    monkeypatch.setattr(R, "TERM_ROWS", 0)
    assert cooldown(spark) == want


def test_texts_in_one_pass_are_as_in_many(spark):
    rng = random.Random(3)
    bits = [" ", "\n", "\r\n", "\x0b", "\u0085", " ", "\u00a0", "a", "B", "é", "가", "(2024.1.2)", "2024/12/31)", "20240101", "http://x.y/z)", "HTTPS://Q",
            "<!--category:tips-->\n", "<!--x-->", "<b>", "<", "\n## 참고 자료\n", "#", "_", "'", "\\", "½", "\U0001F600", "word"]
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))),) for _ in range(4000)] + [(None,)], "t string")
    t = F.col("t")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    plain = trim(F.regexp_replace(trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"^<!--category:(?:tips|mydeals)-->\n*", "")), r"(?s)\n## 참고 자료\s*\n.*$", ""))
    bare = F.regexp_replace(F.regexp_replace(F.lower(plain), X.DATE_SUFFIX, ""), X.URL_PATTERN, " ")
    similar = X.collapse(F.regexp_replace(bare, r"[#*_`~>|\[\](){},.!?:;'\"/\\+-]", " "))
    marked = F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", " "))
    normal = F.trim(F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    pairs = {"plain": (plain, X.plain_body(t)), "similar": (similar, X.similarity_text(t)), "normal": (normal, X.normalize_text(t)),
             "compact": (F.replace(similar, F.lit(" "), F.lit("")), X.compact_text(t))}
    for name, (many, one) in pairs.items():
        assert df.where(~many.eqNullSafe(one)).collect() == [], name


def test_keyword_match_makes_no_phrase_that_nobody_wants(spark, monkeypatch):
    """Same matches by either way; with few subscriptions the phrases of a text are not listed."""
    deals = spark.createDataFrame([
        (1, "Big <b>RED</b> lamp, cheap"), (2, "red-lamp"), (3, "reds lamp"), (4, None), (5, "red   lamp red lamp x"), (6, "c++ и Ёлка"), (None, "lamp")], "id int, t string")
    subs = spark.createDataFrame([
        (1, " Red  Lamp ", True), (2, "lamp", True), (2, "lamp", True), (3, "big red lamp cheap", True), (4, "c++", True), (5, "x", True), (6, "ёлка", True),
        (7, "lamp", False), (None, "lamp", True), (8, "", True), (9, None, True), (10, "big red lamp", True), (11, "red\u00a0lamp", True)], "uid int, term string, enabled boolean")
    def matches(strict):
        return sorted(tuple(r) for r in A.keyword_match(deals.where("id IS NOT NULL"), subs, ["t"], strict=strict).collect())
    found = [matches(True), matches(False)]
    with monkeypatch.context() as m:
        m.setattr(R, "TERM_ROWS", 0)
        assert [matches(True), matches(False)] == found
    monkeypatch.setattr(A, "deal_terms", lambda *a: pytest.fail("phrases were listed"))
    want = sorted(
        [(i, 1, "red lamp") for i in (1, 2, 5)] + [(i, 2, "lamp") for i in (1, 2, 3, 5)] + [(6, 6, "ёлка"), (1, 10, "big red lamp")])
    assert found[0] == want and matches(True) == want
    assert A.keyword_match(deals, subs, ["t"]).where("deal_id IS NULL").count() == 1
