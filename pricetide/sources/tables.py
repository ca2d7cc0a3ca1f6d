"""Stored tables as Parquet versions."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import Counter
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_deals(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Projection and filter stated on the scan, so Parquet reads only what is asked."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def write_deals(df: DataFrame, path: str) -> None:
    """Deals partitioned by source and sorted by time inside the files, for pruning and min-max skipping.

    Rows are dealt by source, day and ``FILE_SALTS`` salts of the instant, so neither a source nor one of its days lands in
    one task; adaptive execution joins what is small.
    """
    day, salt = F.floor(F.unix_seconds("registered_at") / 86_400), F.pmod(F.xxhash64("registered_at"), F.lit(FILE_SALTS))
    (
        df.withColumns({"_day": day, "_salt": salt}).repartition("source", "_day", "_salt").drop("_day", "_salt")
        .sortWithinPartitions("source", "registered_at").write.mode("overwrite").partitionBy("source").parquet(path)
    )


# Tasks a day of one source is spread over when it is written.
FILE_SALTS = 8
# A version's folder: its number, the attempt that wrote it, and the stream and batch if a micro-batch did.
VERSION = re.compile(r"v(\d+)-([0-9a-f]{8})(?:-([0-9a-f]+)-(\d+))?")
CLAIMS = "_claims"
# Name of the folders a partitioned version is written in, and the file that lists the ones it is made of.
PART, PARTS = "_version_part", "_parts"
# Folders of one partition beyond which the next writer puts them together.
MAX_PIECES = 8
# Seconds another writer's claim may stay without its folder's name before it counts as abandoned.
CLAIM_WAIT = 60
ATTEMPTS = 20


class VersionConflict(RuntimeError):
    """Another writer has published a version since this one's base was read."""


class Version(NamedTuple):
    """A finished version; ``stream`` and ``batch`` name the micro-batch that wrote it, if one did."""

    number: int
    stream: str | None
    batch: int | None
    path: str


def _hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claims(spark: SparkSession, root: str) -> dict[int, str]:
    """Claimed numbers and the names of the folders that hold them; '' where the claimant has not said yet."""
    path, fs = _hadoop(spark, f"{root}/{CLAIMS}")
    if not fs.exists(path):
        return {}
    names = {}
    for status in fs.listStatus(path):
        stream = fs.open(status.getPath())
        try:
            names[int(status.getPath().getName())] = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    return names


def versions(spark: SparkSession, root: str) -> list[Version]:
    """The published versions below ``root``, oldest first."""
    found = []
    for number, name in sorted(_claims(spark, root).items()):
        parts = VERSION.fullmatch(name)
        if parts:
            found.append(Version(number, parts[3], int(parts[4]) if parts[4] else None, f"{root}/{name}"))
    return found


def folders(spark: SparkSession, root: str) -> int:
    """Number of entries below ``root``; 0 when it does not exist."""
    path, fs = _hadoop(spark, root)
    return len(fs.listStatus(path)) if fs.exists(path) else 0


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest finished version below ``root``; 0 when there is none."""
    found = versions(spark, root)
    return found[-1].number if found else 0


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, versions(spark, root)[-1])


def _read(spark: SparkSession, root: str, version: Version) -> DataFrame:
    listed = _listed(spark, version)
    return _read_parts(spark, root, listed, listed["parts"]) if listed else spark.read.parquet(version.path)


def _read_parts(spark: SparkSession, root: str, listed: dict, parts: list[str]) -> DataFrame:
    """One scan over folders of any versions: partition columns are stored in the files, so no path has to be parsed."""
    schema = T.StructType.fromJson(listed["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in parts])


def _listed(spark: SparkSession, version: Version) -> dict | None:
    """What a partitioned version is made of (``by``, ``schema``, ``parts``); None for one that is a single folder."""
    path, fs = _hadoop(spark, f"{version.path}/{PARTS}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _parts_in(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _hadoop(spark, folder)
    names = [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if n.startswith(f"{PART}="))


def _label(partition_by: list[str]) -> Column:
    """The partition of a row as text; it is never empty, so every row has a folder of a plain name."""
    return F.concat_ws("~", F.lit("p"), *[F.coalesce(F.expr(e).cast("string"), F.lit("-")) for e in partition_by])


def _label_of(part: str) -> str:
    return unquote(part.rsplit(f"{PART}=", 1)[1])


def split(spark: SparkSession, root: str, number: int, partition_by: list[str] = (), touches=None) -> tuple[DataFrame, list[str]]:
    """Version ``number`` in two: the rows of the partitions a writer may change, and the folders of all others.

    ``touches(stored)`` returns rows in whose partitions changed rows lie: stored rows, or new ones where the key decides the
    partition. Rows a writer only adds need not be among them: they may land in a folder beside the carried ones. Only the
    names of the touched partitions come to the driver. A version without partitions or with others (``partition_by``), or no
    ``touches``, is handed over whole.
    """
    version = next(v for v in versions(spark, root) if v.number == number)
    listed = _listed(spark, version)
    if touches is None or listed is None or listed["by"] != list(partition_by):
        return _read(spark, root, version), []
    pieces = Counter(map(_label_of, listed["parts"]))
    rows = touches(_read(spark, root, version)).select(_label(partition_by).alias(PART)).distinct()
    labels = {r[0] for r in rows.collect()} | {label for label, n in pieces.items() if n > MAX_PIECES}
    touched = [p for p in listed["parts"] if _label_of(p) in labels]
    return _read_parts(spark, root, listed, touched), [p for p in listed["parts"] if _label_of(p) not in labels]


def publish(
    df: DataFrame, root: str, partition_by: list[str] = (), stream: str | None = None, batch: int | None = None, base: int | None = None,
    carried: list[str] = (),
) -> int:
    """Writes the version after ``base`` (the newest one where it is not given) and returns its number.

    ``partition_by`` are SQL expressions of few and short values that no session option changes. Such a version is the
    folders its own file lists: those ``df`` is written to, and the ``carried`` ones of ``base`` (see ``split``), which stay
    as they are. ``df`` then has the columns of ``base``; other columns need a whole version.

    ``base`` is the version ``df`` was planned from. The data is written into a folder of its own; then the number is
    claimed by creating a file that must not exist yet, so of several writers that planned from one version a single one
    wins, and the others get a ``VersionConflict`` and leave nothing: see ``update``. Readers see a version once its claim
    names its folder. A micro-batch's mark is part of the folder's name, so data and mark appear in one step.
    """
    spark = df.sparkSession
    number = (_newest(spark, root) if base is None else base) + 1
    name = f"v{number:09d}-{uuid.uuid4().hex[:8]}" + (f"-{stream}-{batch}" if stream else "")
    if carried:
        before = T.StructType.fromJson(_listed(spark, next(v for v in versions(spark, root) if v.number == base))["schema"])
        if [(f.name, f.dataType) for f in before] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"the carried partitions of {root} have other columns: publish the whole table")
    # Static overwrite: a dynamic one commits through a staging folder.
    if partition_by:
        # Adaptive execution splits a large partition over tasks and joins small ones.
        rows = df.withColumn(PART, _label(partition_by)).hint("rebalance", F.col(PART))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(f"{root}/{name}")
        own = [f"{name}/{p}" for p in _parts_in(spark, f"{root}/{name}")]
        listed = {"by": list(partition_by), "schema": df.schema.jsonValue(), "parts": [*carried, *own]}
        path, fs = _hadoop(spark, f"{root}/{name}/{PARTS}")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/{name}")
    claim, fs = _hadoop(spark, f"{root}/{CLAIMS}/{number:09d}")
    try:
        out = fs.create(claim, False)
    except Exception as error:
        folder, _ = _hadoop(spark, f"{root}/{name}")
        fs.delete(folder, True)
        if not fs.exists(claim):
            raise
        raise VersionConflict(f"version {number} of {root} was published meanwhile") from error
    out.write(bytearray(name.encode()))
    out.close()
    return number


def _newest(spark: SparkSession, root: str) -> int:
    """The newest published number; waits for a writer that has claimed a later one and not named its folder yet."""
    for _ in range(CLAIM_WAIT):
        claims = _claims(spark, root)
        if all(claims.values()):
            return max(claims, default=0)
        time.sleep(1)
    raise RuntimeError(f"a writer died between claiming and naming a version: remove the empty file in {root}/{CLAIMS}")


def update(
    spark: SparkSession, root: str, plan, partition_by: list[str] = (), stream: str | None = None, batch: int | None = None, touches=None,
) -> int:
    """Publishes ``plan(newest version)``; planned again from the newer version where another writer comes first.

    With ``touches`` (see ``split``) ``plan`` gets and returns the touched partitions only, and the others are carried over.
    A micro-batch (``stream``, ``batch``) that has been published is left alone; the result is 0 then.
    """
    for _ in range(ATTEMPTS):
        base = _newest(spark, root)
        if stream and has_batch(spark, root, stream, batch):
            return 0
        stored, carried = split(spark, root, base, partition_by, touches)
        try:
            return publish(plan(stored), root, partition_by, stream, batch, base, carried)
        except VersionConflict:
            continue
    raise VersionConflict(f"{ATTEMPTS} attempts on {root} came too late")


def has_batch(spark: SparkSession, root: str, stream: str, batch: int) -> bool:
    """Whether the stream's micro-batch has been published."""
    return any((v.stream, v.batch) == (stream, batch) for v in versions(spark, root))


def expire_versions(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Removes all but the ``keep`` newest versions and, of each stream, the newest: it tells which batch came last.

    Folders that a version which stays has carried over from a removed one stay as well.
    """
    found = versions(spark, root)
    last = {v.stream: v.path for v in found if v.stream}
    old = [v for v in found[: max(0, len(found) - keep)] if v.path not in last.values()]
    parts = {v.number: (_listed(spark, v) or {"parts": [v.path.rsplit("/", 1)[1]]})["parts"] for v in found}
    gone = {v.number for v in old}
    held = {p for number, names in parts.items() if number not in gone for p in names}
    kept = {v.path for v in found if v.number not in gone}
    for v in old:
        _remove(spark, f"{root}/{CLAIMS}/{v.number:09d}")
    for part in sorted({p for number in gone for p in parts[number]} - held):
        _remove(spark, f"{root}/{part}")
    for folder in sorted({f"{root}/{p.split('/')[0]}" for number in gone for p in parts[number]} | {v.path for v in old}):
        if folder not in kept and not _parts_in(spark, folder):
            _remove(spark, folder)
    return len(old)


def _remove(spark: SparkSession, target: str) -> None:
    path, fs = _hadoop(spark, target)
    fs.delete(path, True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the stream that keeps its progress in ``checkpoint``; a fresh checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"].replace("-", "")


def read_documents_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """New rows as they arrive in a directory."""
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)
