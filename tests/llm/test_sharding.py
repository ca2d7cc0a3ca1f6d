"""Rendezvous shards against the same draws in Python."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from pricetide.llm import sharding


def drawn(key, weights):
    def wait(s):
        u = (int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[s]
    return min((wait(s), s) for s in range(len(weights)) if weights[s] > 0)[1]


def test_shards_are_the_winning_draws(spark, make_docs):
    weights = [1.0, 2.0, 0.0, 1.5]
    rows = sharding.shard_documents(make_docs([(i, f"t{i}") for i in range(400)]), weights).collect()
    assert {r.doc_id: r.shard for r in rows} == {i: drawn(i, weights) for i in range(400)}
    share = Counter(r.shard for r in rows)
    assert 2 not in share and share[1] > share[0]


def test_one_more_shard_takes_only_into_itself(spark, make_docs):
    rows = sharding.shard_documents(make_docs([(i, "same") for i in range(500)]), [1.0] * 8, new_weight=1.0).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert 0 < len(moved) < 120 and {r.grown_shard for r in moved} == {8}


def test_nulls_copies_and_clashing_columns(spark, make_docs):
    docs = make_docs([(None, "a"), (None, "a"), (None, None), (1, ""), (1, "")])
    placed = sharding.shard_documents(docs, [1.0] * 3)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.count() == 5
    slots = sharding.with_slots(placed.select("doc_id", "text", "shard"), "shard", F.concat_ws("|", "doc_id", "text"), ["doc_id"]).collect()
    by = {}
    for r in slots:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 5


def test_slots_have_no_gaps_with_a_hot_key(spark, make_docs):
    docs = make_docs([(7, "copy")] * 600 + [(i, f"t{i}") for i in range(300)])
    placed = sharding.shard_documents(docs, [1.0] * 4).select("doc_id", "shard")
    slots = sharding.with_slots(placed, "shard", F.col("doc_id").cast("string"), ["doc_id"])
    for r in slots.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r.n == r.d == r.m + 1


def test_empty_table(spark, make_docs):
    placed = sharding.shard_documents(make_docs([]), [1.0] * 3, new_weight=1.0)
    assert placed.count() == 0 and {"shard", "grown_shard"} <= set(placed.columns)
