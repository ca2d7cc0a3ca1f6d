"""Similarity joins against brute force."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pricetide.functions.text import similarity_text, similarity_tokens, similarity_words
from pricetide.functions.urls import video_key
from pricetide.operators import similarity as B

NOW = "2026-08-16 12:00:00"
AT = dt.datetime(2026, 8, 16, 12, tzinfo=dt.timezone.utc)


def normalized(s):
    s = re.sub(r"\s*[\[(]?(?:20\d{6}|20\d{2}[./-]\d{1,2}[./-]\d{1,2})[\])]?$", "", s.strip().lower())
    s = re.sub(r"(?i)https?://[^\s)]+", " ", s)
    return re.sub(r"\s+", " ", re.sub(r"[#*_`~>|\[\](){},.!?:;'\"/\\+-]", " ", s)).strip()


def words(s):
    return set(re.findall(r"[0-9a-z가-힣]{2,}", s))


def jaccard(a, b):
    union = words(a) | words(b)
    return len(words(a) & words(b)) / len(union) if union else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh가나다") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    def noisy(s):
        w = s.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w) + rng.choice(["", "!", " (20260816)"])
    posts = [noisy(rng.choice(base)) for _ in range(60)] + [base[0]] * 5 + ["", "."]
    return list(enumerate(base)), list(enumerate(posts))


def frames(spark, texts):
    return [spark.createDataFrame(t, "id int, text string") for t in texts]


@pytest.mark.parametrize("limit", [0.3, 0.72])
def test_first_similar_and_counts(spark, texts, limit):
    left, right = frames(spark, texts)
    alike = {i: [j for j, y in texts[1] if words(normalized(x)) and jaccard(normalized(x), normalized(y)) >= limit] for i, x in texts[0]}
    posts = right.selectExpr("id as pos", "concat('t', id) as title", "text")
    first = {r["draft_id"]: (r["post_pos"], r["post_title"]) for r in B.first_similar(left, posts, limit).collect()}
    assert first == {i: (min(j), f"t{min(j)}") for i, j in alike.items() if j}
    counts = {r["left_id"]: r["similar"] for r in B.similar_counts(left, right, limit).collect()}
    assert counts == {i: len(j) for i, j in alike.items() if j}


def test_a_table_against_itself_is_staged_once(spark, texts, monkeypatch):
    """Same counts as against a second frame of the same rows, with half of the parsing."""
    _, right = frames(spark, texts)
    staged, plain = [], B.scale.cut_lineage
    monkeypatch.setattr(B.scale, "cut_lineage", lambda df: staged.append(df.columns) or plain(df))
    own = {r["left_id"]: r["similar"] for r in B.similar_counts(right, right, 0.3).collect()}
    assert staged.count(["member", "tokens", "sig"]) == 1
    other = {r["left_id"]: r["similar"] for r in B.similar_counts(right, right.select("*"), 0.3).collect()}
    assert own == other and len(own) > 50


@pytest.mark.parametrize("limit", [0.3, 0.8, 1.0])
def test_token_jaccard(spark, texts, limit):
    left, right = frames(spark, texts)
    got = {(r["left_id"], r["right_id"]): round(r["jaccard"], 9) for r in B.token_jaccard_pairs(left, right, limit).collect()}
    want = {}
    for i, x in texts[0]:
        for j, y in texts[1]:
            s = jaccard(normalized(x), normalized(y))
            if s >= limit:
                want[(i, j)] = round(s, 9)
    assert got == want


def test_product_cooldown(spark):
    drafts = spark.createDataFrame([(1, "무선 선풍기"), (2, "공기청정기"), (3, "a"), (4, "abc"), (5, "robot arm")], "id int, product string")
    posts = spark.createDataFrame([
        (1, "선풍기, 예쁜 디자인보다 먼저 봐야 할 3가지", AT - dt.timedelta(days=77)), (2, "공기청정기 고르기", AT - dt.timedelta(days=121)),
        (3, "b", AT), (4, "my ROBOT", None)], "pos int, title string, created_at timestamp")
    got = {r["draft_id"]: r["post_pos"] for r in B.product_cooldown_join(drafts, posts, NOW).collect()}
    assert got == {1: 1, 4: 3, 5: 3}  # the title "b" lies inside "abc" and "robotarm"


def test_empty_title_conflicts_with_everything(spark):
    drafts = spark.createDataFrame([(1, "zzz")], "id int, product string")
    posts = spark.createDataFrame([(7, "  ", AT)], "pos int, title string, created_at timestamp")
    assert [r["post_pos"] for r in B.product_cooldown_join(drafts, posts, NOW).collect()] == [7]


DRAFT = "id int, pos int, title string, body string, product string, source_url string"
POST = "id int, pos int, title string, body string, img string, author string, created_at timestamp"
TITLE, BODY = "충전기는 출력보다 포트 구성을 먼저 본다", "충전기를 고를 때는 기기 수와 동시에 쓰는 습관을 봐야 한다. " * 16


def test_draft_gate_accepts_original(spark):
    drafts = spark.createDataFrame([(1, 0, TITLE, BODY, "충전기", "https://youtu.be/abcdef12345"), (2, 1, TITLE, BODY, "충전기", "https://youtu.be/abcdef12345")], DRAFT)
    trusted = spark.createDataFrame([("https://youtu.be/abcdef12345",)], "url string")
    gated = B.draft_gate(drafts, spark.createDataFrame([], POST), trusted, NOW)
    assert {r["id"]: r["reasons"] for r in gated.collect()} == {1: [], 2: []}
    assert [r["id"] for r in B.first_valid(gated, 5).collect()] == [1]


def test_draft_gate_rejects_reuse(spark):
    drafts = spark.createDataFrame([(1, 0, TITLE, BODY, "충전기", "https://youtu.be/abcdef12345"), (2, 1, "짧다", "x https://a.example", "a", "https://y.example")], DRAFT)
    posts = spark.createDataFrame([(9, 0, TITLE, BODY + "\n\n## 참고 자료\n- (https://youtu.be/abcdef12345)", "", "me", AT - dt.timedelta(days=3))], POST)
    trusted = spark.createDataFrame([("https://youtu.be/abcdef12345",)], "url string")
    got = {r["id"]: [x.split(":")[0] for x in r["reasons"]] for r in B.draft_gate(drafts, posts, trusted, NOW).collect()}
    assert got[1] == ["source_already_used", "similar_title", "similar_body", "product_cooldown"]
    assert got[2] == ["title_length", "body_length", "unexpected_body_url", "untrusted_source", "product_cooldown"]


def test_posted_today_uses_seoul_date(spark):
    posts = spark.createDataFrame([(1, 0, "t", "b", "", "me", dt.datetime(2026, 8, 16, 15, 30, tzinfo=dt.timezone.utc))], POST)
    assert B.posted_today(posts, ["me"], "2026-08-16 20:00:00").first()[0] is True
    assert B.posted_today(posts, ["me"], "2026-08-16 12:00:00").first()[0] is False


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [0.7, 0.8, 0.9])
def test_sequences_against_all_pairs(spark, limit):
    rng = random.Random(3)
    base = ["good day to you", "goodday toyou", "a", "ab", "b", "aaaaaaaa", "aaaaaaab", "무선 청소기 세트", "무선청소기세트", "x" * 40]
    def bent(s):
        s = list(s)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "b", " ", "선"])
        return "".join(s)
    left = [(i, bent(rng.choice(base))) for i in range(60)] + [(98, ""), (99, None)]
    right = [(i, bent(rng.choice(base))) for i in range(80)] + [(200 + i, base[0]) for i in range(20)] + [(300, None)]
    schema = "id int, text string"
    got = {r.left_id: r.similar for r in B.similar_sequences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), limit).collect()}
    alike = lambda a, b: bool(a and b) and edit_distance(a, b) <= int((1 - limit) * max(len(a), len(b)) + 1e-9)
    want = {i: sum(alike(normalized(a or ""), normalized(b or "")) for _, b in right) for i, a in left}
    assert got == {i: n for i, n in want.items() if n}


def test_terms_are_found_anywhere_in_whole_texts(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(500, "sku0001" + text(30)), (501, text(20) + "sku0002")]
    terms = [text(rng.randrange(2, 7)) for _ in range(60)] + ["sku0002", "sku0009", "zz"]
    p = spark.createDataFrame(texts, "post int, key string")
    got = {r.term: r.post for r in B._first_holding(p, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {t: min((i for i, s in texts if t in s), default=None) for t in terms}
    assert got == {t: i for t, i in want.items() if i is not None} and got["sku0002"] == 501


@pytest.mark.parametrize("known", [B.KNOWN_WORDS, 0])
@pytest.mark.parametrize("limit", [0.5, 1.0])
def test_unlike_texts_are_left_out_where_they_are_parsed(spark, monkeypatch, limit, known):
    """of the right texts only those that size and words allow are kept, and no pair is lost."""
    monkeypatch.setattr(B, "KNOWN_WORDS", known)
    rng = random.Random(int(limit * 100))
    words = [f"w{i}" for i in range(14)]
    text = lambda pool, n: ", ".join(rng.choice(pool) for _ in range(n))
    left = [(i, text(words, rng.randrange(3, 9))) for i in range(30)] + [(90, ""), (91, None), (92, "x y z")]
    near = [(i, text(words, rng.randrange(1, 30))) for i in range(60)] + [(100, ""), (101, None), (102, "WORD w1 w2 https://a.example/w3"), (103, left[0][1].upper())]
    far = [(1000 + i, text([f"v{j}" for j in range(200)], 6)) for i in range(40)] + [(2000 + i, " ".join(f"{w}{i}" for w in words * 40 for i in range(9))) for i in range(3)]
    schema = "id int, text string"
    lf, rf = spark.createDataFrame(left, schema), spark.createDataFrame(near + far, schema)
    members, _ = B._alike(lf, rf, limit)
    kept = {r.right_id for r in members["right"].collect()}
    assert kept.isdisjoint(range(2000, 2003)) and (known == 0 or kept.isdisjoint(range(1000, 1040)))
    sets = lambda rows: {i: set(re.findall(r"[0-9a-z가-힣]{2,}", re.sub(r"https?://\S+", " ", (t or "").lower()))) for i, t in rows}
    want = {(i, j): len(a & b) / len(a | b) for i, a in sets(left).items() for j, b in sets(near + far).items() if a and b and len(a & b) / len(a | b) >= limit}
    got = {(r.left_id, r.right_id): r.jaccard for r in B.token_jaccard_pairs(lf, rf, limit).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("left", [[], [(1, ""), (2, None)]])
def test_nothing_is_alike_to_texts_without_words(spark, left):
    schema = "id int, text string"
    rights = spark.createDataFrame([(1, "red tv"), (2, ""), (3, None)], schema)
    assert B.token_jaccard_pairs(spark.createDataFrame(left, schema), rights, 0.5).isEmpty()


def test_words_are_those_of_the_normalised_text(spark):
    rows = [("A-b cd/ef.gh_ij 2024.01.02",), ("x http://a.b/c y2 무선-청소기 [20240102]",), ("<!--category:tips-->\nab\n## 참고 자료\nhidden",), ("it's `code` é1aé",), ("",), (None,), ("ab\u2028cd",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(similarity_words(F.col("t")).alias("a"), similarity_tokens(similarity_text(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].a == ["cd", "ef", "gh", "ij"]


def test_links_of_any_case_are_used_sources(spark):
    posts = spark.createDataFrame(
        [("see HTTPS://youtu.be/abcdef12345.", None), (None, "https://youtu.be/imgimgimg12"), ("a://b http:/x", ""), (None, None)], "body string, img string")
    assert sorted(r.source_key for r in B.source_keys(posts).collect()) == sorted(
        r.k for r in spark.createDataFrame([("HTTPS://youtu.be/abcdef12345",), ("https://youtu.be/imgimgimg12",)], "u string").select(video_key(F.col("u")).alias("k")).where("k <> ''").collect())


def _staged_rows(monkeypatch):
    """Rows of what is staged from now on, by columns."""
    rows, plain = {}, B.scale.cut_lineage
    def counted(df):
        held = plain(df)
        rows[tuple(held.columns)] = held.count()
        return held
    monkeypatch.setattr(B.scale, "cut_lineage", counted)
    return rows


@pytest.mark.parametrize("tile", [1 << 18, 100])
def test_sets_are_not_sent_with_each_pair(spark, monkeypatch, tile):
    """near copies are compared where they lie together; each set of a family is sent to a tile once, not with each of its pairs."""
    monkeypatch.setattr(B, "TILE_PAIRS", tile, raising=False)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    base = [word() for _ in range(300)]
    def near():
        own = list(base)
        for _ in range(12):
            own[rng.randrange(len(own))] = word()
        return " ".join(own)
    rows = [(i, near()) for i in range(80)] + [(500 + i, " ".join(word() for _ in range(300))) for i in range(20)]
    rows += [(1000 + i, rows[i][1].upper()) for i in range(5)] + [(2000, ""), (2001, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    staged = _staged_rows(monkeypatch)
    got = {r.left_id: r.similar for r in B.similar_counts(df, df, 0.8).collect()}
    sets = {i: words((t or "").lower()) for i, t in rows}
    assert got == {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets.values()) for i, a in sets.items() if a} and got[0] == 85
    assert staged["tile", "sig"] <= (100 if tile > 100 else 80 * 2 * 6)  # 3,160 pairs: one tile, or six by six


def test_a_single_word_in_common_makes_no_pair_to_compare(spark, monkeypatch):
    """long texts of which any two neighbours share a rare word and nothing more are not compared, only the two that are alike."""
    rng = random.Random(6)
    own = [rng.sample(range(2000), 90) for _ in range(200)]
    texts = [" ".join([f"c{w}" for w in own[i]] + [f"r{i - k}n{k}" for k in range(5)] + [f"r{i}n{k}" for k in range(5)]) for i in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (900, texts[7] + " more")], "id int, text string")
    staged = _staged_rows(monkeypatch)
    got = {r.left_id: r.similar for r in B.similar_counts(df, df, 0.8).collect()}
    assert got == {i: 1 + (i in (7, 900)) for i in [*range(200), 900]}
    assert 1 <= sum(n for columns, n in staged.items() if {"left_sig", "right_sig"} <= {*columns} and "jaccard" not in columns) <= 50


def test_few_shared_words_are_enough_for_short_sets(spark):
    """sets about the sizes at which more prefix words are asked for, against all pairs."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for n in (1, 2, 3, 4, 5, 6, 15, 16, 17, 19, 20, 21, 31, 32, 33, 40, 47, 48, 127, 128, 129, 160):
        base = rng.sample(pool, n)
        for k in {0, 1, n // 9, n // 8, n // 5}:
            rows += [(len(rows), " ".join(base[: n - k])), (len(rows) + 1, " ".join(base[: n - k] + [f"x{len(rows)}y{j}" for j in range(k)]))]
    df = spark.createDataFrame(rows, "id int, text string")
    sets = {i: words(t) for i, t in rows}
    for limit in (0.5, 0.8):
        got = {(r.left_id, r.right_id) for r in B.token_jaccard_pairs(df, df, limit).collect()}
        assert got == {(i, j) for i, a in sets.items() for j, b in sets.items() if a and b and len(a & b) / len(a | b) >= limit}
