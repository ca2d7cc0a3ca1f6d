"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricetide.functions.times import bucket_30min
from pricetide.operators import alerts as A
from pricetide.operators import snapshots as N
from pricetide.session import cut_lineage
from pricetide.sources import tables

ALERT_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("deal_id", T.StringType()), T.StructField("at", T.LongType()),
    T.StructField("action", T.StringType()), T.StructField("pending_count", T.LongType()),
    T.StructField("digest_count", T.LongType()), T.StructField("digest_titles", T.StringType()), T.StructField("digest_ids", T.StringType()),
])
# What leaves the processor: the alerts of a key beside it, so that a key is one row between Python and the JVM, not one per alert.
KEYED_SCHEMA = T.StructType([*ALERT_SCHEMA.fields[:2], T.StructField("alerts", T.ArrayType(T.StructType(ALERT_SCHEMA.fields[2:])))])
KEYED = Row(*KEYED_SCHEMA.names)
# Most alerts in such a row.
ALERT_CHUNK = 10_000
STATE_SCHEMA = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("pending", T.LongType()),
    T.StructField("titles", T.ArrayType(T.StringType())), T.StructField("deal_ids", T.ArrayType(T.StringType())),
    T.StructField("reachable", T.BooleanType()),
])


def _kept(values: list[str], value: str, n: int) -> list[str]:
    grown = values if not value or value in values else [*values, value]
    return grown[-n:]


class AlertThrottle(StatefulProcessor):
    """Per (uid, term) the open window's start, pending count and last titles and ids.

    The first match sends and opens a window; later ones queue; the first one after the window has run
    out sends and carries the digest. When event time passes the window's end, a timer flushes pending
    matches as a digest and opens a new window, or drops the state when there are none. A row that is not
    ``subscribed`` closes the window; a digest of a user who was not ``reachable`` at the last match is emptied
    (``no_tokens``) and opens none.
    """

    def __init__(self, window_minutes: int = A.WINDOW_MINUTES, flush: bool = True):
        self.width = window_minutes * 60 * 1_000_000
        self.flush = flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", STATE_SCHEMA)

    def _timer(self, start: int) -> int:
        return (start + self.width) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uid, term = key
        before, pending, titles, ids, reachable = self.window.get() or (None, 0, [], [], True)
        start, moved = before, False
        # Each call to the state is a message to the executor's JVM, so the state is read and written once per key and batch.
        given, out = (r.asDict() for r in rows), []
        batch = sorted(
            ((g["at"], g["deal_id"] is None, g["deal_id"], g.get("title", ""), g.get("subscribed", True), g.get("reachable", True)) for g in given),
            key=lambda r: r[:3])
        for at, _, deal_id, title, subscribed, reachable in batch:
            deal_id = str(deal_id)
            if len(out) >= ALERT_CHUNK:
                yield KEYED(uid, term, out)
                out = []
            if not subscribed:
                out.append((deal_id, at, "skip", 0, 0, "", ""))
                start, pending, titles, ids, moved = None, 0, [], [], True
            elif start is None or at - start >= self.width:
                out.append((deal_id, at, "send", 0, pending, "|".join(titles), "|".join(ids)))
                start, pending, titles, ids, moved = at, 0, [], [], True
            else:
                pending += 1
                titles = _kept(list(titles), str(title or "").strip(), A.MAX_PENDING_TITLES)
                ids = _kept(list(ids), deal_id, A.MAX_PENDING_IDS)
                out.append((deal_id, at, "queue", pending, 0, "", ""))
        if start is None:
            self.window.clear()
        else:
            self.window.update((start, pending, list(titles), list(ids), bool(reachable)))
        if self.flush and moved:  # a window has the one timer that its start gives
            if before is not None and before != start:
                self.handle.deleteTimer(self._timer(before))
            if start is not None:
                self.handle.registerTimer(self._timer(start))
        yield KEYED(uid, term, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        uid, term = key
        state = self.window.get()
        if state is None:
            return
        start, pending, titles, ids, reachable = state
        due = start + self.width
        if pending <= 0:
            self.window.clear()
        elif not reachable:
            self.window.update((start, 0, [], [], False))
            yield KEYED(uid, term, [("", due, "no_tokens", 0, pending, "", "")])
        else:
            self.window.update((due, 0, [], [], True))
            self.handle.registerTimer(self._timer(due))
            yield KEYED(uid, term, [("", due, "digest", 0, pending, "|".join(titles), "|".join(ids))])

    def close(self) -> None:
        pass


def alert_throttle_stream(
    matches: DataFrame, window_minutes: int = A.WINDOW_MINUTES, flush: bool = True, delay: str = "10 minutes"
) -> DataFrame:
    """R1, R2 over a stream of (uid, term, deal_id, title, ts); needs the RocksDB state store.

    State instants are plain microsecond numbers. Rows of one instant go in ``deal_id`` order, as in the
    batch form. Columns ``title``, ``subscribed`` and ``reachable`` may be absent: empty, true and true.
    """
    defaults = {"title": "", "subscribed": True, "reachable": True}
    rows = matches.withWatermark("ts", delay) if flush else matches
    rows = rows.select(
        F.col("uid").cast("string").alias("uid"), F.col("term").cast("string").alias("term"),
        "deal_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items() if c in matches.columns],
        F.unix_micros("ts").alias("at"), *(["ts"] if flush else []))
    alerts = rows.groupBy("uid", "term").transformWithState(
        statefulProcessor=AlertThrottle(window_minutes, flush), outputStructType=KEYED_SCHEMA,
        outputMode="append", timeMode="eventTime" if flush else "none")
    return alerts.select("uid", "term", F.inline("alerts"))


def alert_dedup_stream(matches: DataFrame, delay: str = "48 hours") -> DataFrame:
    """R3, bounded: one row per (deal, user) within the watermark. Use the ledger anti-join in
    ``ledger_sink`` where a pair must never repeat."""
    return matches.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["deal_id", "uid"])


def late_and_future_filter(deals: DataFrame, now_col: str | None = None, late: str = "48 hours", skew_minutes: int = 10) -> DataFrame:
    """Rows ahead of the clock by more than the skew, or behind it by more than ``late``, dropped.

    ``now_col`` names an ingest-time column for replays; without it the batch's own clock is used. The watermark is set for
    what follows; by itself it drops nothing.
    """
    clock = F.col(now_col) if now_col else F.current_timestamp()
    at = F.col("registered_at")
    kept = deals.where((at <= clock + F.expr(f"INTERVAL {skew_minutes} MINUTES")) & (at >= clock - F.expr(f"INTERVAL {late}")))
    return kept.withWatermark("registered_at", late)


def value_counts_stream(deals: DataFrame, metrics: list[str], late: str = "48 hours") -> DataFrame:
    """``captured_at, source, metric, value, n``, the histogram of every half hour, in append mode.

    State is one small row per value of a metric in a half hour, dealt by value: a source with a third of all deals is
    spread over the tasks, and no row grows. A half hour's counts leave together, when the watermark has passed its end.
    """
    long = deals.withWatermark("registered_at", late).select(
        "source", "registered_at",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"))
            for m in metrics
        ])).alias("m")).select("source", "registered_at", "m.metric", (F.col("m.value") + F.lit(0.0)).alias("value"))
    return long.groupBy(F.window("registered_at", "30 minutes"), "source", "metric", "value").agg(
        F.count(F.lit(1)).alias("n")).select(bucket_30min(F.col("window.start")).alias("captured_at"), "source", "metric", "value", "n")


def snapshot_sink(root: str, checkpoint: str):
    """Writes the statistics (exact percentiles included) of the half hours a batch of ``value_counts_stream`` closes.

    The histograms are merged by ``snapshots.summarize_counts``, which gathers no source in one task. A batch's folder is
    named by stream and batch, so a replay replaces what it has written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = cut_lineage(batch)
        stats = N.summarize_counts(held, ["captured_at", "source", "metric"])
        mark = f"{tables.stream_id(batch.sparkSession, checkpoint)}-{batch_id}"
        stats.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/batch={mark}")
    return write


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The histograms of the half hours that a finished run of ``value_counts_stream`` has not closed yet, read from its
    state: ``captured_at, source, metric, value, n``."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(bucket_30min(F.col("key.window.start")).alias("captured_at"), "key.source", "key.metric", "key.value", F.col("value.count").alias("n"))


def keyword_match_stream(deals: DataFrame, subscriptions: DataFrame, text_cols: list[str], delay: str = "10 minutes", salts: int = 8) -> DataFrame:
    """Matches of new deals against the subscriptions (J8): (deal_id, uid, term, ts).

    A static table of subscriptions is read as it is when the stream starts. A stream of them (``uid, term, enabled,
    since``) is state instead: a term matches the deals registered at or after its ``since``, in whatever batch either
    comes; what is stored when the stream starts is its first batch. Rows meet by term and one of ``salts`` salts, so a term
    in very many deals is dealt over tasks and each subscription is kept that many times. Terms stay for good; a deal
    waits until the watermark of the subscriptions has passed it (a quiet source needs a row now and then, an empty term will do).
    A term given up later is left out by ``alerts.validate_subscription``.
    """
    terms = deals.withWatermark("ts", delay) if subscriptions.isStreaming else deals
    terms = terms.select(
        F.col("id").alias("deal_id"), F.col("ts"),
        F.explode_outer(A.X.candidate_terms(A.X.normalize_text(*[F.col(c) for c in text_cols]))).alias("term")
    ).where("term IS NOT NULL")
    if not subscriptions.isStreaming:
        wanted = subscriptions.where("enabled").select("uid", A.X.normalize_term(F.col("term")).alias("term")).distinct()
        return terms.join(wanted, "term")
    wanted = subscriptions.withWatermark("since", delay).where("enabled").select(
        "uid", A.X.normalize_term(F.col("term")).alias("_term"), "since").dropDuplicates(["uid", "_term"])
    wanted = wanted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = terms.withColumn("_salt", F.pmod(F.xxhash64("deal_id"), F.lit(salts)).cast("int"))
    return dealt.join(wanted, F.expr("term = _term AND _salt = _part AND since <= ts")).select("term", "deal_id", "ts", "uid")


def subscription_classes(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions of one term from one instant on match the same deals; as ``uid, term, enabled, since`` with the
    instant (micros) in place of the user they go through ``keyword_match_stream`` once instead of once per user."""
    return subscriptions.select(F.unix_micros("since").alias("uid"), "term", "enabled", "since")


def class_members_stream(subscriptions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``uid, term, class``, the class of ``subscription_classes`` every enabled (uid, term) belongs to."""
    return subscriptions.withWatermark("since", delay).where("enabled").select(
        "uid", A.X.normalize_term(F.col("term")).alias("term"), F.unix_micros("since").alias("class"), "since"
    ).dropDuplicates(["uid", "term"]).drop("since")


def expiry_stream(deals: DataFrame, hours: int = 48, delay: str = "10 minutes") -> DataFrame:
    """``id, registered_at, expired_at``, one row when a deal's time is up: ``hours`` after it was registered last.

    Event time decides, so a replay gives the same rows: a deal's state is one session that every registration prolongs, and
    leaves the store when the watermark passes its end.
    """
    lasting = f"{hours} hours"
    ended = deals.withWatermark("registered_at", delay).groupBy(F.session_window("registered_at", lasting).alias("_s"), "id").agg(
        F.max("registered_at").alias("registered_at"))
    return ended.select("id", "registered_at", F.col("_s.end").alias("expired_at"))


def without_expired(stored: DataFrame, expired: DataFrame) -> DataFrame:
    """The active set after a batch of ``expiry_stream``; a deal registered again meanwhile stays."""
    gone = expired.groupBy(F.col("id").alias("_id")).agg(F.max("registered_at").alias("_last"))
    return stored.join(gone, (F.col("id") == F.col("_id")) & (F.col("registered_at") <= F.col("_last")), "left_anti")


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """R2: the windows a finished run of ``alert_throttle_stream`` keeps in its state, read as a table:
    ``uid, term, window_started_at, due_at, pending_count, titles, deal_ids``."""
    state = spark.read.format("statestore").option("stateVarName", "window").load(checkpoint)
    started = F.timestamp_micros("value.start")
    return state.select(
        "key.uid", "key.term", started.alias("window_started_at"), (started + F.expr(f"INTERVAL {A.WINDOW_MINUTES} MINUTES")).alias("due_at"),
        F.col("value.pending").alias("pending_count"), "value.titles", "value.deal_ids")


def upsert_sink(root: str, plan_batch, checkpoint: str, partition_by: list[str] = (), touches=None):
    """``foreachBatch`` writer. ``plan_batch(stored, batch) -> new table``.

    With ``touches(stored, batch)`` (see ``tables.split``) a batch reads and writes only the partitions it touches.

    Each version carries the stream and batch that wrote it; a batch is skipped only if that very pair is published, so a
    replay changes nothing, and a fresh ``checkpoint`` costs no batch. Where another writer publishes first, the batch is
    planned again from that version, so writers at the same time lose nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = tables.stream_id(spark, checkpoint)
        touched = None if touches is None else lambda stored: touches(stored, batch)
        tables.update(spark, root, lambda stored: plan_batch(stored, batch), partition_by, stream, batch_id, touched)
    return write


# Slices of a batch of the ledger, bits of a bitmap, and how many pairs a bitmap is meant for.
LEDGER_SLICES, BITMAP_BITS, BITMAP_PAIRS = 64, 32_768, 2_048


def _index_of(root: str) -> str:
    return f"{root.rstrip('/')}-index"


def _sliced(pairs: DataFrame) -> DataFrame:
    """Adds the pair's ``slice`` and ``h``, the number that picks its bit."""
    return pairs.withColumns({
        "slice": F.pmod(F.xxhash64("deal_id", "uid"), F.lit(LEDGER_SLICES)).cast("int"),
        "h": F.pmod(F.xxhash64(F.lit(1), "deal_id", "uid"), F.lit(1 << 40))})


def ledger_candidates(spark: SparkSession, root: str, pairs: DataFrame) -> list[tuple[str, int]]:
    """The ledger's (batch, slice) folders that may hold one of the ``pairs``, by the bitmaps kept beside them.

    What comes back is bounded by the number of folders.
    """
    index = spark.read.parquet(_index_of(root))
    asked = _sliced(pairs.select("deal_id", "uid"))
    spot = F.pmod("h", F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = asked.join(index, "slice").where(F.col("bucket") == F.pmod(F.floor(F.col("h") / BITMAP_BITS), F.col("buckets")))
    marked = met.where(F.getbit(byte, F.pmod(spot, F.lit(8))) == 1).select("batch", "slice").distinct()
    return [(str(r["batch"]), r["slice"]) for r in marked.collect()]


def ledger_sink(root: str, checkpoint: str):
    """R3, exact: writes the batch's (deal, user) pairs the ledger lacks, once each.

    A batch's pairs lie in slices, and beside them, below ``<root>-index``, a bitmap of each slice's pairs. A batch first
    asks the bitmaps which older slices may hold one of its pairs and reads those only: none for pairs never seen, but for
    chance hits. The bitmaps are written before the pairs, so a pair is never without its bit. A batch's folders are named
    by stream and batch: a replay replaces them, a fresh ``checkpoint`` starts folders of its own.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = f"{tables.stream_id(spark, checkpoint)}-{batch_id}"
        pairs = cut_lineage(_sliced(batch.select("deal_id", "uid").distinct()))
        if tables.folders(spark, root):
            likely = [x for x in ledger_candidates(spark, root, pairs) if x[0] != mark]
            paths = [path for m, n in likely if tables.folders(spark, path := f"{root}/batch={m}/slice={n}")]  # a batch that died has bits only
            if paths:
                pairs = pairs.join(spark.read.parquet(*paths).select("deal_id", "uid"), ["deal_id", "uid"], "left_anti")
        pairs = cut_lineage(pairs)
        buckets = max(1, 1 << ((pairs.count() - 1) // (LEDGER_SLICES * BITMAP_PAIRS)).bit_length())
        bucket = F.pmod(F.floor(F.col("h") / BITMAP_BITS), F.lit(buckets)).alias("bucket")
        bits = pairs.groupBy("slice", F.lit(buckets).cast("bigint").alias("buckets"), bucket).agg(
            F.bitmap_construct_agg(F.pmod("h", F.lit(BITMAP_BITS)).cast("bigint")).alias("bitmap"))
        bits.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{_index_of(root)}/batch={mark}")
        pairs.drop("h").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slice").parquet(f"{root}/batch={mark}")
    return write


def ttl_prune(stored: DataFrame, now, hours: int = 48) -> DataFrame:
    """R8, batch form: rows leave the active set after their window; ``expiry_stream`` is the streaming form."""
    return stored.where(F.col("registered_at").isNull() | (
        F.col("registered_at") >= now - F.expr(f"INTERVAL {hours} HOURS")))


def read_all(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything its source holds now into Parquet and returns the written rows."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
