"""Near-duplicates against all pairs."""

import random
import re

import pytest

from pricetide.llm import minhash, shingles

SF = "/root/testdata/sf0.001"


def shingle(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [shingle(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            met = len(a & sets[j])
            if a and sets[j] and 100 * met >= percent * (len(a) + len(sets[j]) - met):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)}


def found(df, **options):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **options).collect()}


def corpus(seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        text = [draw.choice(words) for _ in range(120)]
        for _ in range(draw.randint(1, 9)):  # a chain of edits: neighbours are alike, the ends are not
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(3):
                text[draw.randrange(len(text))] = draw.choice(words)
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n\v\f\r "), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE two"), (907, "one two three"),
         (907, "one two three"), (None, "one two three"), (908, "É a b"), (909, "é a b"), (910, "x " * 40_000)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_all_pairs(spark, make_docs, k, percent):
    rows = corpus() + EDGES
    assert found(make_docs(rows), words=k, threshold=percent / 100) == brute(rows, k, percent)


def test_star_of_near_copies_whose_ends_differ(spark, make_docs):
    """Copies reach each other only through the middle, which has the largest id."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for n in range(60):
        text = list(base)
        for at in draw.sample(range(200), 5):
            text[at] = f"e{n}-{at}"
        rows.append((n, " ".join(text)))
    rows.append((500, " ".join(base)))
    want = brute(rows, 3, 85)
    assert {x[2] for x in want} == {0}
    assert found(make_docs(rows), words=3, threshold=0.85) == want


def test_collections_are_large_enough():
    for percent in (80, 85, 90, 100):
        size = minhash.collection_size(percent / 100)
        assert 2 * (1 - (percent / 100) ** minhash.ROWS) ** size <= minhash.MISS


def test_extra_columns_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "a b c d e f")]).withColumnRenamed("shard", "kept")
    out = minhash.near_duplicates(docs)
    assert set(out.columns) == set(docs.columns) | {"n_shingles", "component_id"} and out.first().kept is True
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    text = "aa bb aa  cc\tbb"
    h = shingles.word_hashes(text)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    long = " ".join(["word"] * 300_000)
    assert len(set(shingles.word_hashes(long).tolist())) == 1


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    from pricetide.llm.queries import op3_tensored_minhash
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op3_tensored_minhash(spark, SF).collect()}
    assert got == brute(rows, 3, 85)
