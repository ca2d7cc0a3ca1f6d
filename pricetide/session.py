"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# Options a job of this library wants; a cluster profile may override any of them.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_STAGED: list[str] = []

STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "pricetide", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in ``spark.checkpoint.dir``, else one below the warehouse.

    On a cluster a warehouse on the driver's own disk is no such folder, and an error says so.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if configured:
        return configured.rstrip("/") + "/pricetide"
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    if warehouse.startswith("file:") and not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse.rstrip("/") + "/_pricetide"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``drop_staged`` or at the end of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_at_exit, spark)
    _STAGED.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """The table written once as Parquet in the shared folder and read back.

    Later stages, and tasks repeated after a lost executor, read those files instead of computing the table again.
    ``drop_staged`` removes what a session has written.
    """
    spark = df.sparkSession
    path = work_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Removes the tables ``stage`` has written in this process; call it once their readers are done."""
    dropped = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        dropped += 1
    return dropped


def _drop_at_exit(spark: SparkSession) -> None:
    """Best effort: a session stopped earlier may have taken its file system along."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            drop_staged(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table staged in the shared folder: later stages re-read files instead of recomputing the scan."""
    return stage(df)
