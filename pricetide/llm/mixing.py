"""Mixing sources to target weights by Poisson replication (built-in functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common

# A larger rate is split into equal parts, whose counts are drawn one by one and added: sums of Poisson draws.
RATE_PART = 16.0
SEED = "mix-1"


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0,
) -> DataFrame:
    """One row per source: ``source``, ``bytes``, ``share`` (target share) and ``rate`` (mean copies of a document).

    The size of a source is the UTF-8 bytes of its texts plus one per document. Without ``weights`` a source's target
    weight is ``size ** alpha``. Sources that ``weights`` does not name get weight 0. The mixture is ``epochs`` times as
    large as the input on average.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == name, F.lit(float(w))) for name, w in weights.items()], F.lit(0.0))
    sized = sizes.withColumn("_w", weight)
    weight_sum, byte_sum = (sized.agg(F.sum(c)).scalar() for c in ("_w", "bytes"))
    share = F.when(weight_sum > 0, F.col("_w") / weight_sum).otherwise(0.0)
    return sized.select("source", "bytes", share.alias("share")).withColumn(
        "rate", F.col("share") * byte_sum * F.lit(float(epochs)) / F.col("bytes"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """``_parts`` and ``_cdf``: the cumulative Poisson probabilities of rate / _parts, as far as 52 bits tell them from 1."""
    step = F.col("_r")
    terms = F.ceil(step + F.lit(12.0) * F.sqrt(step) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-step).alias("p"), F.array(F.exp(-step)).alias("cdf"))

    def add(acc, k):
        p = acc["p"] * step / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return (
        rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(RATE_PART))).cast("int"))
        .withColumn("_r", F.col("rate") / F.col("_parts"))
        .withColumn("_cdf", F.aggregate(F.sequence(F.lit(1), terms), start, add, lambda acc: acc["cdf"]))
        .drop("_r")
    )


def replicate(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: str = SEED,
) -> DataFrame:
    """Every document repeated by a Poisson count of its source's rate, in a global random order.

    The count inverts the Poisson distribution at a number hashed from (seed, doc_id), so a rerun, a retried task or
    another partitioning gives the same rows. Returns the input columns plus ``copies`` (the document's count), ``copy``
    (from 0) and ``mix_key`` (the random order; ties fall between equal rows only); columns of these names are replaced.
    Documents with a null source form a source of their own, null ids are keyed by their text, repeated rows get equal
    counts, null and empty texts are replicated like others, an empty table stays empty. A hot source costs nothing
    extra: the rates are joined by a checked broadcast and the shuffle follows the hash of (document, copy).
    """
    docs = common.without(docs, "copies", "copy", "mix_key")
    rates = _with_distribution(source_rates(docs, weights, alpha, epochs)).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"), "_parts", "_cdf")
    key = common.record_key(F.col("doc_id"), F.col("text"))

    def draw(part):
        u = common.unit(F.concat(F.lit(seed + "|"), F.col("_key"), F.lit("|"), part.cast("string")))
        return F.size(F.filter(F.col("_cdf"), lambda c: c < u))

    counted = common.join_small(
        docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("_key", key),
        rates, ["_source"], "inner",
    ).withColumn("copies", F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + draw(part)))
    copies = counted.where("copies > 0").select(
        *docs.columns, "copies", "_key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    mixed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(seed + "|order|"), F.col("_key"), F.lit("|"), F.col("copy").cast("string"))))
    return mixed.drop("_key").repartition("mix_key").sortWithinPartitions("mix_key")
