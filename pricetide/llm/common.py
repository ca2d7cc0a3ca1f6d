"""Helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table is broadcast only after its rows were counted against this bound; the callers keep a few hundred bytes a row.
SMALL_ROWS = 10_000


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that an operator is about to add: its output replaces input columns of the same name."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def record_key(doc_id: Column, text: Column) -> Column:
    """A stable text key of a record: its id, or a digest of its text where the id is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def unit(seed: Column) -> Column:
    """A number in (0, 1) that the text ``seed`` alone decides: 52 bits of its MD5 digest."""
    return (F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins a table that is normally tiny: broadcast when its rows, counted first, are within ``SMALL_ROWS``.

    A larger one is joined by a shuffle, whose skewed partitions adaptive execution splits.
    """
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)
