"""Rendezvous hashing of stable record keys over weighted shards (built-in functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm import common

# Hex digits of the key's digest that cut a shard into bins; the slots of a bin are counted by one task.
BIN_DIGITS = 3


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a text key among ``len(weights)`` shards.

    Each shard draws an exponential waiting time ``-ln(u) / weight`` from the digest of (key, shard) and the
    shortest wins, so a shard gets its weight's share of the keys. The draws of the other shards do not depend on
    how many shards there are: one more shard takes keys only into itself, a removed one hands out only its own.
    Shards of weight 0 get nothing; ties, which need equal 52-bit draws, go to the lower number.
    """
    waits = [
        F.struct((-F.log(common.unit(F.concat(key, F.lit(f"|{shard}")))) / F.lit(float(weight))).alias("wait"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights) if weight > 0
    ]
    if not waits:
        raise ValueError("at least one shard needs a positive weight")
    return (F.least(*waits) if len(waits) > 1 else waits[0])["shard"]


def shard_documents(
    docs: DataFrame, weights: Sequence[float], key: Column | None = None, new_weight: float | None = None,
) -> DataFrame:
    """Adds ``shard`` and, given ``new_weight``, ``grown_shard``: the shard once one more shard of that weight exists.

    The key is ``doc_id``; rows with a null id are keyed by their text. Repeated rows share a shard. Empty texts and
    nulls in other columns change nothing; input columns named like the outputs are replaced; an empty table stays
    empty. No row moves between tasks.
    """
    key = common.record_key(F.col("doc_id"), F.col("text")) if key is None else key
    out = {"shard": rendezvous(key, weights)}
    if new_weight is not None:
        out["grown_shard"] = rendezvous(key, [*weights, new_weight])
    return common.without(docs, *out).select("*", *[c.alias(n) for n, c in out.items()])


def with_slots(rows: DataFrame, shard: str, key: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``slot``, numbering the rows of every shard from 0 without gaps.

    Equal rows are counted before the shuffle. A shard is cut into ``16 ** BIN_DIGITS`` bins by the key's digest; a
    task numbers one bin, the bins' offsets come from their counts, so neither a large shard nor a group of copies
    is ever sorted by one task. ``order`` breaks ties inside a bin; rows equal in every column are interchangeable.
    """
    rows = common.without(rows, "slot")
    counted = (
        rows.withColumn("_bin", F.substring(F.md5(key), 1, BIN_DIGITS))
        .groupBy(*rows.columns, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    )
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_bin = earlier.partitionBy(shard, "_bin").orderBy(*order, *[c for c in rows.columns if c not in order])
    in_shard = earlier.partitionBy(shard).orderBy("_bin")
    offsets = (
        counted.groupBy(shard, "_bin").agg(F.sum("_n").alias("_c"))
        .select(shard, "_bin", F.coalesce(F.sum("_c").over(in_shard), F.lit(0)).alias("_offset"))
    )
    first = F.col("_offset") + F.coalesce(F.sum("_n").over(in_bin), F.lit(0))
    return (
        counted.join(offsets, [shard, "_bin"]).withColumn("_first", first)
        .select(*rows.columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"))
    )
