"""Length buckets: least padding against all choices; batches."""

from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_pad_least(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]
    got = packing.optimal_bounds(np.array(lengths), np.array(counts), buckets)
    assert got[-1] == lengths[-1] and len(got) <= buckets
    best = min(padding(lengths, counts, [*some, lengths[-1]]) for r in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], r))
    assert padding(lengths, counts, got) == best


def test_batches_fill_without_gaps_and_hold_the_budget(spark, make_docs):
    rows = [(i, "w " * (i * 7 % 400)) for i in range(900)] + [(5000, "w " * 3000)]
    out = packing.pack(make_docs(rows), buckets=4, budget=1000)
    batches = defaultdict(list)
    for r in out.collect():
        assert r.n_tokens <= packing.EXACT_LENGTH and r.n_tokens <= r.bound or r.doc_id == 5000
        batches[r.bucket, r.batch].append(r)
    last = {b: max(n for x, n in batches if x == b) for b, _ in batches}
    for (bucket, number), members in batches.items():
        room = max(1, 1000 // max(1, members[0].bound))
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert len(members) == room or (number == last[bucket] and len(members) < room)
    assert sum(map(len, batches.values())) == 901


def test_grid(spark):
    lengths = [0, 1, 1024, 1025, 1028, 2047, 2048, 2049, 100_001, 2**31]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    got = [r[0] for r in df.select(packing.grid_length(F.col("n"))).collect()]
    assert got[:3] == lengths[:3] and all(g >= n and g - n <= n / 256 for g, n in zip(got, lengths)) and got == sorted(got)


def test_nulls_repeats_and_clashing_columns(spark, make_docs):
    docs = make_docs([(1, None), (None, ""), (2, "a b"), (2, "a b"), (2, "a b")]).withColumnRenamed("n", "bucket").withColumnRenamed("spans", "place")
    out = packing.pack(docs, buckets=2, budget=4)
    assert set(out.columns) == set(docs.columns) | {"n_tokens", "bound", "batch"} and out.count() == 5
    assert out.select("bucket", "batch", "place").distinct().count() == 5


def test_empty_table(spark, make_docs):
    assert packing.pack(make_docs([])).count() == 0
