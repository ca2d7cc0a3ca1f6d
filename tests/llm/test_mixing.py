"""Poisson replication against the same inversion in Python."""

import hashlib
import math
from collections import Counter

from pricetide.llm import mixing


def count(key, rate, seed="mix-1"):
    parts, total = max(1, math.ceil(rate / mixing.RATE_PART)), 0
    for part in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}|{key}|{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate / parts)
        n = 0
        while c < u and n < 400:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


def test_counts_are_the_inverted_draws(spark, make_docs):
    docs = make_docs([(i, f"text {i}", "big" if i % 3 else "small") for i in range(300)])
    weights = {"big": 1.0, "small": 3.0}
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    got = Counter(r.doc_id for r in mixing.replicate(docs, weights).collect())
    assert {i: got.get(i, 0) for i in range(300)} == {i: count(i, rates["big" if i % 3 else "small"]) for i in range(300)}


def test_large_rates_split_into_parts(spark, make_docs):
    docs = make_docs([(0, "x", "rare")] + [(i, "y" * 100, "common") for i in range(1, 60)])
    weights = {"rare": 0.9, "common": 0.1}
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    assert rates["rare"] > 1000
    got = Counter(r.doc_id for r in mixing.replicate(docs, weights).collect())
    assert got[0] == count(0, rates["rare"]) and abs(got[0] - rates["rare"]) < 6 * math.sqrt(rates["rare"])


def test_means_meet_the_targets(spark, make_docs):
    docs = make_docs([(i, "z" * 50, f"s{i % 4 if i % 2 else 0}") for i in range(4000)])
    rates = mixing.source_rates(docs, alpha=0.5).collect()
    got = Counter(r.source for r in mixing.replicate(docs, alpha=0.5).collect())
    assert abs(sum(r.share for r in rates) - 1) < 1e-9
    for r in rates:
        mean = r.rate * r.bytes / 51
        assert abs(got[r.source] - mean) < 5 * math.sqrt(mean)


def test_rerun_nulls_repeats_and_clashing_columns(spark, make_docs):
    rows = [(1, "a", None), (1, "a", None), (None, "b", None), (None, None, "s"), (2, "", "s")] * 5
    docs = make_docs(rows).withColumnRenamed("n", "copies")
    first, second = (sorted(map(str, mixing.replicate(docs, epochs=3.0).collect())) for _ in range(2))
    assert first == second and first
    assert set(mixing.replicate(docs).columns) == set(docs.columns) | {"copy", "mix_key"}
    same = Counter((r.doc_id, r.text, r.copy) for r in mixing.replicate(docs, epochs=3.0).collect())
    assert set(same.values()) <= {5, 10}


def test_unnamed_sources_get_nothing_and_empty_tables_stay(spark, make_docs):
    docs = make_docs([(i, "t", "in" if i % 2 else "out") for i in range(50)])
    assert {r.source for r in mixing.replicate(docs, {"in": 1.0}).collect()} == {"in"}
    assert mixing.replicate(docs, {"none": 1.0}).count() == 0
    assert mixing.replicate(make_docs([])).count() == 0


def test_order_is_by_the_mix_key(spark, make_docs):
    docs = make_docs([(i, "t") for i in range(200)])
    out = mixing.replicate(docs, epochs=2.0)
    from pyspark.sql import functions as F
    for part in out.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("mix_key").alias("k")).collect():
        assert part.k == sorted(part.k)
