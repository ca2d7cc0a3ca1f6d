"""Vector tables: which rows count, and equal vectors as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def with_digest(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64(vector), "h2": F.xxhash64(F.lit(1), vector)})


def equal_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """``h1, h2, vector, dim, ids``: each distinct vector with its ``ids`` least ids, ascending.

    A search for the nearest k never needs more than the k least ids of equal vectors besides the query's own, so with
    ``ids = k + 1`` nothing is lost. The rank limit works map-side: a vector shared by a third of the rows sends a few
    rows per task.
    """
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    return (
        rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= ids)
        .groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dim", F.size("vector"))
    )


def in_blocks(index: DataFrame, queries: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (dim, shard, block): every block of queries meets every shard once."""
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumns({
        "block": F.pmod(F.xxhash64("h2", "h1"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    return left, right


def top_ranks(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` from candidates ``q1, q2, score, vec_id`` and queries ``q1, q2, query_id``.

    Candidates are cut to k + 1 per distinct query vector before they meet the queries that share it.
    """
    best = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "vec_id")
    short = found.distinct().withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k + 1).drop("_rn")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        queries.join(short, ["q1", "q2"]).where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
