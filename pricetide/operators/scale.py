"""Building blocks that keep grouping, ranking and joining safe when one key holds much of the data.

Nothing here gathers a group in one task: dedup keeps one row per key and map task before the
shuffle, quantiles and ranks work on ``(key, value) -> count`` histograms cut into value buckets,
and joins spread hot keys over as many salts as their row count asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import cut_lineage

# A table is broadcast only after its rows, and the bytes they hold, were checked against these bounds.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
# Rows with a null key match nothing; they are spread this wide.
NULL_SALTS = 4096
# Value buckets per unit of log1p(|value|): a bucket spans about 0.1 % of its values.
BUCKETS_PER_LOG = 1000


def keep_one(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """First row per key in ``order``.

    ``row_number() = 1`` lets Catalyst add a WindowGroupLimit before the shuffle, so every map task
    sends at most one row per key and a key with a third of all rows stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def keep_top(df: DataFrame, keys: Sequence[str | Column], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows per key (top-k report); trimmed map-side the same way."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``max_rows`` rows that hold at most ``max_bytes``.

    Rows are weighed where they lie (as JSON text for the parts of variable width); one row of two numbers comes back.
    """
    wide = [f.name for f in df.schema if not f.dataType.typeName() in ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp")]
    weight = F.lit(16 * len(df.columns))
    if wide:
        weight = weight + F.octet_length(F.to_json(F.struct(*wide)))
    rows, weight = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(weight)).first()
    return rows <= max_rows and (weight or 0) <= max_bytes


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Evaluate a (normally tiny) table once; broadcast it only if its size proved small, else it shuffles."""
    held = cut_lineage(df)
    return F.broadcast(held) if is_small(held, max_rows, max_bytes) else held


def join_small_or_salted(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Map-side join when the right table proved small, else the shuffle join that splits skew."""
    held = cut_lineage(right)
    if is_small(held, max_rows):
        return left.join(F.broadcast(held), list(on), how)
    return salted_join(left, shuffled(held), on, spread, how)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join neither side of which is to be broadcast.

    Spark guesses sizes from the compressed files, before any explode: rows it takes for a few MB may fill a driver.
    """
    return df.hint("merge")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join whose left side may be dominated by a few keys, for ``how`` inner, left, left_semi or left_anti.

    Neither side is counted first: adaptive execution splits whatever partition of the left proves large, for any number
    of hot keys. What it cannot help is null keys, which match nothing and would all meet in one task: a salt from a hash
    of ``spread`` deals them out.
    """
    on = list(on)
    present = F.lit(True)
    for key in on:
        present = present & F.col(key).isNotNull()
    salt = F.when(present, F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(NULL_SALTS))).cast("int")
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0)), [*on, "_salt"], how).drop("_salt")


def beside(*one_row: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row aggregates: unioned, then the non-null values taken."""
    rows = one_row[0]
    for other in one_row[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a numeric value, at most some 90 000 buckets over all doubles that occur."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BUCKETS_PER_LOG)).cast("int")


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value -> n``; combined map-side, so repeated values collapse before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantiles(
    hist: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per key from a histogram (position ``(n-1)*p``).

    Pass 1 counts rows per value bucket and finds the buckets that hold a wanted rank; pass 2 ranks
    the distinct values of those buckets only. No task sees more than one bucket of one key.
    """
    keys = list(keys)
    hist = hist.withColumn("_b", value_bucket(F.col(value)))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        hist.groupBy(*keys, "_b").agg(F.sum("n").alias("_c"))
        .withColumn("_total", F.sum("_c").over(by_key))
        .withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    )
    ranks = []
    for p in probs.values():
        position = (F.col("_total") - 1) * F.lit(float(p))
        ranks += [F.floor(position), F.ceil(position)]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c")))
    targets = buckets.where(wanted).select(*keys, "_b", "_before", "_total")
    in_bucket = (
        Window.partitionBy(*keys, "_b").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        hist.join(targets, [*keys, "_b"])
        .withColumn("_hi", F.col("_before") + F.sum("n").over(in_bucket))
        .withColumn("_lo", F.col("_hi") - F.col("n"))
    )
    aggs = [F.max("_total").alias("_total")]
    for i, rank in enumerate(ranks):
        hit = (rank >= F.col("_lo")) & (rank < F.col("_hi"))
        aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_v{i}"))
    found = ranked.groupBy(*keys).agg(*aggs)
    columns = []
    for i, (name, p) in enumerate(probs.items()):
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *columns)


def histogram_ranks(hist: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``below`` (rows with a smaller value), ``n`` (ties) and ``total`` to every histogram row.

    A running sum per bucket plus the sum of the earlier buckets; a window never spans more than the
    bucket list of a key or the distinct values of one bucket.
    """
    keys = list(keys)
    hist = hist.withColumn("_b", value_bucket(F.col(value)))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        hist.groupBy(*keys, "_b").agg(F.sum("n").alias("_c"))
        .withColumn("total", F.sum("_c").over(by_key))
        .withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        .drop("_c")
    )
    in_bucket = (
        Window.partitionBy(*keys, "_b").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        hist.join(buckets, [*keys, "_b"])
        .withColumn("below", F.col("_before") + F.sum("n").over(in_bucket) - F.col("n"))
        .drop("_b", "_before")
    )
