"""MinHash near-dedup with tensored banding: table keys combine pairs from two small collections of hashes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common
from pricetide.llm.graph import connected_components
from pricetide.llm.shingles import mix, shingle_set
from pricetide.session import stage

# Minhashes in one member of a collection; a table key joins two members, so it agrees on twice as many.
ROWS = 3
# A pair exactly at the threshold misses every table with at most this probability.
MISS = 1e-4
SEED = 20_240_229
# Shingles hashed at a time.
BLOCK = 1 << 14
# Nodes and shingles of a block in the comparison across components; a shingle of COMMON nodes is counted by matrix
# products, COLUMNS such shingles at a time.
BLOCK_NODES, BLOCK_SHINGLES, COMMON, COLUMNS = 512, 1 << 20, 16, 2048


def collection_size(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Members per collection: a pair must agree on one member of either, which fails with (1 - t^rows)^size each."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**rows)) if threshold < 1 else 1


def _sketcher(words: int, size: int, rows: int):
    """Arrow batches of (text, ...) to (..., n_shingles, node, keys): ``2 * size`` member hashes from ``2 * size * rows`` minhashes."""
    def run(batches):
        draw = np.random.default_rng(SEED)
        masks = draw.integers(1, 2**63, 2 * size * rows, np.uint64)[:, None]
        odd = (draw.integers(1, 2**62, 2 * size * rows, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        member = np.arange(2 * size, dtype=np.uint64)
        for batch in batches:
            counts, nodes, keys = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), words)
                counts.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append(None)
                    continue
                low = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(found), BLOCK):
                    value = (found[None, at : at + BLOCK] ^ masks) * odd
                    value ^= value >> np.uint64(32)
                    np.minimum(low, value.min(axis=1), out=low)
                joined = member.copy()
                for row in low.reshape(2 * size, rows).T:
                    joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + row)
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(joined.view(np.int64))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*rest, "n_shingles", "node", "keys"])
    return run


def _set_maker(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text.as_py(), words) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
    return run


def _buckets(nodes: DataFrame, size: int) -> DataFrame:
    """``key, node, weight``: the tensored tables' rows that can have a partner.

    A pair shares table (i, j) only if it shares member i of the first collection and member j of the second, so
    members that occur once in the corpus are dropped before pairs of members are formed. ``weight`` adds up how
    common a node's members are: the middle of a group of near copies weighs most.
    """
    members = nodes.select("node", F.posexplode("keys").alias("i", "member"))
    shared = members.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = (
        members.join(shared, "member").groupBy("node")
        .agg(F.collect_list(F.when(F.col("i") < size, F.col("member"))).alias("first"),
             F.collect_list(F.when(F.col("i") >= size, F.col("member"))).alias("second"), F.sum("n").alias("weight"))
    )
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    return kept.select("node", "weight", F.explode(pairs).alias("key"))


def _verified(pairs: DataFrame, sets: DataFrame, alike: Column) -> DataFrame:
    """Of the candidate pairs ``a, b``, those whose full sets are alike."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    met = both.select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return met.where(alike).select("a", "b")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: matrix products for common shingles, counted pairs for rare ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    _, number, times = np.unique(token, return_inverse=True, return_counts=True)
    met = np.zeros((len(sets), len(sets)), np.float32)
    often = times >= COMMON
    column = np.cumsum(often) - 1
    for at in range(0, int(often.sum()), COLUMNS):
        some = often[number] & (column[number] >= at) & (column[number] < at + COLUMNS)
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[some], column[number[some]] - at] = 1
        met += holds @ holds.T
    rare = (times[number] > 1) & ~often[number]
    owner, number = owner[rare], number[rare]
    for step in range(1, COMMON - 1):
        same = np.flatnonzero(number[step:] == number[:-step]) if step < len(number) else np.zeros(0, int)
        both = np.bincount(owner[same] * len(sets) + owner[same + step], minlength=met.size).reshape(met.shape) if len(same) else 0
        met += both + np.transpose(both)
    return met


def _block_links(percent: int):
    """One link per pair of components that two blocks of a hub's members hold."""
    def run(pdf):
        sets = [np.asarray(s, np.int64) for s in pdf["shingles"]]
        size = np.array([len(s) for s in sets])
        component = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        block = pdf["block"].to_numpy()
        met = _intersections(sets)
        linked = 100 * met >= percent * (size[:, None] + size[None, :] - met)
        linked &= component[:, None] < component[None, :]
        if pdf["low"].iloc[0] != pdf["high"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        first = np.unique(component[a] * len(sets) + component[b], return_index=True)[1]
        return pd.DataFrame({"a": pdf["node"].to_numpy()[a[first]], "b": pdf["node"].to_numpy()[b[first]]})
    return run


def _across_components(stars: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different components among the members of each hub's buckets.

    A hub's members are dealt into blocks of bounded count and bounded shingles; every two blocks meet in one task.
    """
    members = stars.select("b", F.col("a").alias("node")).unionByName(stars.select("b", F.col("b").alias("node")).distinct())
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sizes, "node")
    hubs = placed.groupBy("b").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("least <> most")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (
        placed.join(hubs.select("b", "blocks"), "b").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("b", "node", "component", "block", other)
        .select("b", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(sets, "node"))
    return dealt.groupBy("b", "low", "high").applyInPandas(_block_links(percent), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, rows: int = ROWS, percent: int | None = None, first: str | None = None) -> DataFrame:
    """Adds ``n_shingles``, ``component_id`` and ``kept`` to every row.

    Two texts are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of ``words``-word shingles (``percent``
    is the threshold in hundredths). ``component_id`` is the least doc_id reachable over links, ``kept`` marks the rows
    that carry it. Texts are whole, lower-cased in A-Z, split at ASCII white space; one with fewer words is a single
    shingle; null, empty and blank texts have no set, are linked with nothing and stay. Texts with equal sets are one
    node, whatever their number. A row with a null id takes part by its text: it is kept only if its group has no id at
    all, and then with a null component_id. Other columns are carried along; input columns of the output names are
    replaced; an empty table stays empty. A column named ``first`` marks one (doc_id, text) of every group, whether ids
    are null or shared: the first by doc_id, nulls last, then by ``row_key``; texts without a set are marked as well.

    Steps: (1) sketch every text; (2) tensored buckets of what can have a partner; (3) every bucket member is verified
    against the bucket's heaviest node, its hub, and components are formed; (4) where the members of a hub's buckets are
    still of several components, they are compared in blocks inside tasks, and one link per pair of components comes out.
    So no pair is listed but those of (3) and the links found, and no candidate pair is left untested.
    """
    percent = round(100 * threshold) if percent is None else percent
    docs = common.without(docs, "n_shingles", "component_id", "kept", *([first] if first else []))
    size = collection_size(percent / 100, rows)
    row_key = F.xxhash64("doc_id", "text").alias("row_key")
    # doc_id may be of any type: the tasks only pass it on
    sketched = stage(docs.select("doc_id", row_key, "text").mapInArrow(
        _sketcher(words, size, rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, n_shingles long, node binary, keys array<long>"))
    nodes = sketched.where("n_shingles > 0").groupBy("node").agg(
        F.first("keys").alias("keys"), F.first("n_shingles").alias("n"), F.min("row_key").alias("row_key"))
    buckets = stage(_buckets(nodes, size))

    heaviest = buckets.groupBy("key").agg(
        F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("top.node").alias("b"))
    stars = stage(buckets.join(heaviest, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    involved = buckets.join(heaviest, "key", "left_semi").select("node").distinct()
    wanted = nodes.join(involved, "node", "left_semi").select("row_key").distinct()
    sets = stage(
        docs.select(row_key, "text").join(wanted, "row_key", "left_semi").select("text")
        .mapInArrow(_set_maker(words), "node binary, shingles array<long>").dropDuplicates(["node"]))

    alike = F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared"))
    links = stage(_verified(stars, sets, alike))
    labels = connected_components(links)

    more = stage(_across_components(stars, labels, nodes.select("node", "n"), sets, percent))
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))
    labels = stage(labels)

    known = sketched.select("doc_id", "row_key", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("component", "node").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    least = known.where("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("least"), *([F.min(order)["row_key"].alias("first_key")] if first else []))
    decided = known.join(least, "component", "left").select(
        "row_key", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        *([(F.col("component").isNull() | (F.col("row_key") == F.col("first_key"))).alias(first)] if first else [])
    ).dropDuplicates(["row_key"])
    return (
        docs.withColumn("_row_key", row_key).join(decided.withColumnRenamed("row_key", "_row_key"), "_row_key", "left")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("_row_key")
    )
