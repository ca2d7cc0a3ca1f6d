"""Vector searches against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm import bitsliced, hnsw
from pricetide.llm.queries import op1_hnsw_search, op9_bit_sliced_top_k

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, shard int")


def clusters(n, dim=16, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(12, dim))
    return [(i, [float(x) for x in (centre[i % 12] + draw.normal(size=dim) * 0.6).astype(np.float32)]) for i in range(n)]


def cosines(vectors, k, queries):
    ids = np.array([i for i, _ in vectors])
    raw = np.array([np.float32(v) for _, v in vectors], np.float64)
    norm = np.linalg.norm(raw, axis=1)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = raw @ raw[at] / norm / norm[at]
        score[ids == q] = -9
        order = np.lexsort((ids, -score))[:k]
        out[q] = [(int(ids[i]), score[i]) for i in order if ids[i] != q]
    return out


def test_recall_over_several_shards(spark):
    rows = clusters(2500)
    df = table(spark, rows)
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0"), k=5, shard_rows=700).collect()
    truth = cosines(rows, 5, [i for i, _ in rows if i % 50 == 0])
    hits = sum((r.vec_id in {v for v, _ in truth[r.query_id]}) for r in got)
    assert len(got) == 250 and hits / 250 >= 0.95
    for r in got:
        a, b = (np.array(np.float32(rows[i][1]), float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_query_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    truth = cosines(rows, 5, [i for i, _ in rows if i % 50 == 0])
    got = op1_hnsw_search(spark, SF).collect()
    assert {(r.query_id, r.rank) for r in got} == {(q, n) for q in truth for n in range(1, 6)}
    assert sum(r.vec_id in {v for v, _ in truth[r.query_id]} for r in got) / len(got) >= 0.9


def test_equal_vectors_ties_and_unusable_ones(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 400)] + [
        (1000, None), (1001, []), (1002, [0.0, 0.0, 0.0]), (1003, [1.0, NAN, 0.0]), (1004, [INF, 0.0, 1.0]), (1005, [1.0, None, 2.0]), (None, same),
        (1050, [1.0, 2.0]), (1100, [1.0, 2.0]), (1100, [1.0, 2.0])]
    df = table(spark, rows)
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[350] == [0, 1, 2, 3, 4]
    assert got[1050] == [1100] and got[1100] == [1050] and set(got) == {*range(0, 400, 50), 1050, 1100}


def test_empty_tables(spark):
    none, one = table(spark, []), table(spark, [(0, [1.0, 2.0])])
    assert hnsw.nearest(none, none).count() == 0 and bitsliced.top_k(none, none).count() == 0
    assert hnsw.nearest(one, one).count() == 0 and bitsliced.top_k(one, one).count() == 0


def products(rows, k, queries):
    ids = np.array([i for i, _ in rows])
    whole = np.floor(1024 * np.array([np.float32(v) for _, v in rows], np.float64)).astype(np.int64)
    out = set()
    for q in queries:
        score = whole @ whole[int(np.flatnonzero(ids == q)[0])]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out |= {(q, n + 1, int(ids[i]), int(score[i])) for n, i in enumerate(order)}
    return out


def test_exact_top_k_over_several_blocks(spark):
    rows = clusters(1500, dim=8, seed=4)
    df = table(spark, rows)
    queries = [i for i, _ in rows if i % 100 == 0]
    got = {tuple(r) for r in bitsliced.top_k(df, df.where("vec_id % 100 = 0"), k=10, block_rows=400).collect()}
    assert got == products(rows, 10, queries)


def test_exact_ties_zero_and_unusable_vectors(spark):
    good = [(i, [float(i % 3 - 1), 0.5]) for i in range(300)] + [(600, [0.0, 0.0])]
    bad = [(700, None), (800, []), (900, [NAN, 1.0]), (1000, [None, 1.0]), (1100, [INF, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.5])]
    df = table(spark, good + bad)
    got = {tuple(r) for r in bitsliced.top_k(df, df.where("vec_id % 100 = 0"), k=10).collect()}
    assert got == products(good, 10, [0, 100, 200, 600])


def test_scores_beyond_a_long_are_reported_as_the_nearest_long(spark):
    df = table(spark, [(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [3e38, 0.0])])
    rows = bitsliced.top_k(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 2**63 - 1), (1, -(2**63))]


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in op9_bit_sliced_top_k(spark, SF).collect()}
    assert got == products(rows, 10, [i for i, _ in rows if i % 100 == 0])


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.integers(1, 12), st.randoms(use_true_random=False))
def test_bitmap_sums_pick_the_largest(rows, dim, k, draw):
    values = np.array([[draw.randint(-40, 40) for _ in range(dim)] for _ in range(rows)])
    query = np.array([draw.randint(-40, 40) for _ in range(dim)])
    low, bits, maps = bitsliced.slice_block(values)
    sure, tied = bitsliced.search_block(low, bits, maps, rows, query, k)
    score = values @ query
    want = np.sort(score)[::-1][: min(k, rows)]
    left = min(k, rows) - len(sure)
    assert left <= len(tied) and len(set(score[tied])) <= 1
    assert sorted([*score[sure], *score[tied][:left]], reverse=True) == want.tolist()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(2**(i % 7)) * x for x in (1.0, 2.0, 3.0)]) for i in range(30)]  # parallel, so all cosines are equal
    df = table(spark, rows)
    got = hnsw.nearest(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1


def whole_products(rows, k, queries):
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    out = set()
    for q in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, whole[q])), i) for i, v in whole.items() if i != q))[:k]
        out |= {(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(scored)}
    return out


def test_large_components_keep_their_integers(spark):
    draw = np.random.default_rng(3)
    one = [0.0] * 63
    rows = [(0, [400_000.0, *one]), (1, [400_000.0, *one]), (2, [3.0, *one]), (3, [-9e8, *one])] + [
        (i, [float(x) for x in draw.normal(size=64) * 10.0 ** draw.integers(0, 11)]) for i in range(4, 60)]
    df = table(spark, rows)
    got = {tuple(r) for r in bitsliced.top_k(df, df.where("vec_id % 20 = 0"), k=10, block_rows=16).collect()}
    assert got == whole_products(rows, 10, [0, 20, 40]) and (0, 167772160000000000) in {(q, s) for q, _, _, s in got}
