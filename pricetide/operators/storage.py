"""Stored objects against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.times import as_ts
from pricetide.functions.urls import storage_path


def referenced_paths(deals: DataFrame, prefix: str, defaults: DataFrame | None = None,
                     objects: DataFrame | None = None) -> DataFrame:
    """Object paths in either picture column, plus the default objects that exist."""
    paths = deals.select(F.explode(F.array(
        storage_path(F.col("img"), prefix), storage_path(F.col("detail_img"), prefix))).alias("path"))
    paths = paths.where("path <> ''")
    if defaults is not None and objects is not None:
        paths = paths.unionByName(defaults.select("path").intersect(objects.select("path")))
    return paths.distinct()


def orphan_objects(objects: DataFrame, refs: DataFrame, cutoff: str | Column) -> DataFrame:
    """Unreferenced objects older than the grace cutoff; an object without a time stays."""
    return objects.where(F.col("updated_at") < as_ts(cutoff)).join(refs.select("path").distinct(), "path", "left_anti")


def missing_references(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References without an object; any row here must stop a clean-up."""
    return refs.select("path").distinct().join(objects.select("path").distinct(), "path", "left_anti")


def require_no_missing(refs: DataFrame, objects: DataFrame) -> None:
    """J14 as a gate."""
    sample = [r["path"] for r in missing_references(refs, objects).orderBy("path").limit(5).collect()]
    if sample:
        raise RuntimeError(f"storage references without objects, for example {', '.join(sample)}")


def storage_usage(objects: DataFrame, refs: DataFrame, cutoff: str | Column) -> DataFrame:
    """Object count and bytes, referenced paths, orphan count and bytes; one scan of the objects."""
    wanted = refs.select("path").distinct().withColumn("_ref", F.lit(True))
    stored = F.col("_stored")
    orphan = stored & F.col("_ref").isNull() & (F.col("updated_at") < as_ts(cutoff))
    marked = objects.withColumn("_stored", F.lit(True)).join(wanted, "path", "full_outer").withColumn(
        "_stored", F.coalesce("_stored", F.lit(False)))
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0))
    return marked.agg(
        F.count_if(stored).alias("objects"), F.coalesce(F.sum(F.when(stored, size)), F.lit(0)).alias("storage_bytes"),
        F.count("_ref").alias("referenced"), F.count_if(F.coalesce(orphan, F.lit(False))).alias("orphans"),
        F.coalesce(F.sum(F.when(orphan, size)), F.lit(0)).alias("orphan_bytes"))
