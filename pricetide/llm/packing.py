"""Packing into optimal length buckets: boundaries by dynamic programming, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common, sharding

# Lengths up to here are exact; above, they are rounded up to a grid of 2^GRID_BITS steps per doubling. So the
# histogram has some ten thousand rows at most, whatever the corpus.
EXACT_LENGTH = 1024
GRID_BITS = 8


def word_tokens(text: Column) -> Column:
    """Default length of a document: its white-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def grid_length(length: Column) -> Column:
    """The length, rounded up to the grid where it is longer than EXACT_LENGTH."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(length)) - 1 - GRID_BITS, F.lit(0))).cast("bigint")
    return F.when(length <= EXACT_LENGTH, length.cast("bigint")).otherwise((F.ceil(length / step) * step).cast("bigint"))


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in all.

    ``lengths`` ascend. A bucket over (i, j] pads everything to length j. The cost meets the quadrangle inequality, so
    the best cut moves monotonely and each layer of the recursion is solved by divide and conquer. Ties take the
    earlier cut.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts.astype(np.float64))))
    size = np.concatenate(([0], np.cumsum(counts.astype(np.float64) * lengths)))

    def cost(cuts, j):
        return lengths[j - 1] * (rows[j] - rows[cuts]) - (size[j] - size[cuts])

    best = np.concatenate(([0.0], [cost(np.array([0]), j)[0] for j in range(1, n + 1)]))
    cut_of = [np.zeros(n + 1, int)]
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), cut_of[-1] * 0
        spans = [(1, n, 0, n - 1)]
        while spans:
            low, high, first, last = spans.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            cuts = np.arange(first, min(last, mid - 1) + 1)
            total = best[cuts] + cost(cuts, mid)
            at = int(total.argmin())
            now[mid], cut[mid] = total[at], cuts[at]
            spans += [(low, mid - 1, first, cuts[at]), (mid + 1, high, cuts[at], last)]
        best = now
        cut_of.append(cut)
    bounds, j = [], n
    for cut in reversed(cut_of):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = cut[j]
    return bounds[::-1]


def bucket_bounds(docs: DataFrame, length: Column, buckets: int) -> list[int]:
    """Optimal bounds over the global length histogram, which alone comes to the driver."""
    histogram = docs.groupBy(grid_length(length).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()
    return optimal_bounds(histogram.column("length").to_numpy(), histogram.column("n").to_numpy(), buckets)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 32_768, length: Column | None = None) -> DataFrame:
    """Adds ``n_tokens, bucket, bound, batch, place`` to every row.

    A document falls into the bucket of the least bound that is not below its length (on the grid). A batch holds
    ``budget // bound`` documents of one bucket, padded to the bound; a document longer than the budget has a batch of
    its own. Batches are numbered per bucket and filled without gaps, the last one of a bucket may be short; documents
    stand in them in the order of a hash of the row. Null and empty texts have length 0 and share the first bucket;
    repeated rows are packed each; rows equal in every column are interchangeable; columns named like the outputs are
    replaced; an empty table stays empty. No task ranks a whole bucket (see ``sharding.with_slots``).
    """
    docs = common.without(docs, "n_tokens", "bucket", "bound", "batch", "place")
    names = docs.columns
    length = word_tokens(F.col("text")) if length is None else length
    bounds = bucket_bounds(docs, length, buckets)
    if not bounds:
        bounds = [0]
    keyed = docs.withColumns({
        "n_tokens": length.cast("bigint"), "_k1": F.xxhash64(*names), "_k2": F.xxhash64(F.lit(1), *names)})
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < grid_length(F.col("n_tokens")))).alias("bucket")
    slots = sharding.with_slots(
        keyed.select("_k1", "_k2", "n_tokens", bucket), "bucket", F.concat_ws("|", F.col("_k1"), F.col("_k2")), ["_k1", "_k2"],
    ).withColumnRenamed("slot", "_slot")
    bound = limits[F.col("bucket")]
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))))
    bodies = keyed.drop("n_tokens").dropDuplicates(["_k1", "_k2"])
    return slots.join(bodies, ["_k1", "_k2"]).select(
        *names, "n_tokens", "bucket", bound.alias("bound"), F.floor(F.col("_slot") / room).alias("batch"), (F.col("_slot") % room).alias("place"))
