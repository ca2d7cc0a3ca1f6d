"""Line dedup against all pairs of lines."""

import random

from pricetide.llm import linededup


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """rows: (doc_id, text), doc_ids distinct -> {doc_id: text}"""
    places = [(d is None, d, i, line.strip(" \t\r")) for d, t in rows for i, line in enumerate((t or "").split("\n"))]
    places.sort(key=lambda p: (p[0], p[1] or 0, p[2]))
    seen, gone = [], set()
    for _, d, i, line in places:
        if not line:
            continue
        words = line.split(" ")
        units = words if len(words) >= 5 else list(line) if len(line) >= 20 else None
        kind = len(words) >= 5
        hit = any(line == other or (units and w and kind == k and abs(len(w) - len(units)) < 2 and edits(units, w) <= 1) for other, w, k in seen)
        if hit:
            gone.add((d, i))
        seen.append((line, units, kind))
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for i, x in enumerate(lines) if (d, i) not in gone]
        if len(stay) == len(lines):
            out[d] = t
        elif any(x.strip(" \t\r") for x in stay):
            out[d] = "\n".join(stay)
    return out


def found(df):
    return {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}


def test_all_pairs(spark, make_docs):
    draw = random.Random(11)
    words = "a b c d e f g".split()
    pool = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    rows = []
    for d in range(70):
        lines = []
        for _ in range(draw.randint(1, 6)):
            line = draw.choice(pool).split(" ")
            act = draw.random()
            at = draw.randrange(len(line))
            if act < 0.3:
                line[at] = draw.choice(words)
            elif act < 0.5:
                line.insert(at, draw.choice(words))
            elif act < 0.6 and len(line) > 1:
                del line[at]
            lines.append(draw.choice(["", " ", "\t"]) + " ".join(line) + draw.choice(["", "\r"]))
        rows.append((d, "\n".join(lines)))
    assert found(make_docs(rows)) == brute(rows)


def test_edges(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "x y\n\nx y\n \nend"), (2, None), (3, ""), (4, "\n \n"), (5, "x y"), (None, "end\nlast words of a row"), (6, long),
            (7, long.replace("w77 ", "other ")), (8, long.replace("w9 ", "") + "\nnew"), (9, "a a a a a a"), (10, "a a a a a"), (11, "one two three four"), (12, "one two three five")]
    got = found(make_docs(rows))
    assert got == brute(rows)
    assert got[2] is None and 5 not in got and 7 not in got and got[8] == "new" and 10 not in got and 12 in got


def test_repeated_rows_are_one_record(spark, make_docs):
    docs = make_docs([(1, "same line here", "b"), (1, "same line here", "a"), (1, "another text", "c"), (2, "same line here", "a")])
    rows = sorted((r.doc_id, r.text, r.source) for r in linededup.dedup_lines(docs).collect())
    assert rows == [(1, "another text", "c"), (1, "same line here", "a")]


def test_hot_lines_and_hot_variants(spark, make_docs):
    rows = [(d, f"notice\nPage {d} of this long document here\nown{d}") for d in range(400)]
    got = found(make_docs(rows))
    assert got == {0: rows[0][1], **{d: f"own{d}" for d in range(1, 400)}}


def test_columns_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "a\na")]).withColumnRenamed("n", "n_lines").withColumnRenamed("spans", "first")
    out = linededup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"} and tuple(out.select("text", "n_lines", "n_dropped").first()) == ("a", 2, 1)
    assert linededup.dedup_lines(make_docs([])).count() == 0


def test_only_two_columns(spark):
    assert linededup.dedup_lines(spark.createDataFrame([(1, "a\nb\na")], "doc_id long, text string")).first().text == "a\nb"


def test_lines_without_spaces_are_compared_by_characters(spark, make_docs):
    chinese = "今天天气很好我们一起去公园散步看见许多美丽的花朵和小鸟"
    rows = [
        (1, chinese), (2, chinese[:9] + "坏" + chinese[10:]), (3, chinese[:9] + chinese[10:]), (4, chinese + "😀"), (5, chinese[:5] + "坏" + chinese[6:15] + "坏" + chinese[16:]),
        (6, "short line one"), (7, "short line two"), (8, "a\tb\tc\td\te\tf\tg\th\ti\tj\tk"), (9, "a\tb\tc\td\te\tX\tg\th\ti\tj\tk"),
        (10, "abcdefghijklmnopqrst"), (11, "a b c d e f g h i j k l m n o p q r s t"), (12, "abcdefghijklmnopqrsX and"), (13, "x" * 3000), (14, "x" * 2999), (15, "x" * 2997)]
    got = found(make_docs(rows))
    assert got == brute(rows) and set(got) == {1, 5, 6, 7, 8, 10, 11, 12, 13, 15}


def test_many_lines_of_one_template(spark, make_docs):
    rows = [(d, "\n".join(f"page {d * 500 + i} of the long report that nobody reads" for i in range(500))) for d in range(200)]
    got = found(make_docs(rows))
    assert got == {0: "page 0 of the long report that nobody reads"}
