"""Change planning against the stored table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.keys import text_or_empty
from pricetide.functions.times import as_ts, is_future_dated, is_older_than
from pricetide.operators import scale

# Fields whose change makes an update, and the delete guard.
TRACKED_FIELDS = [
    "source_post_id", "buy_link", "title", "desc", "price", "category", "img", "detail_img", "area", "dist", "time",
    "likes", "dislikes", "views", "comments", "comment_signal_score", "positive_comment_signals",
    "negative_comment_signals", "date", "registered_at",
]
GUARD_MIN_ROWS = 10
GUARD_RATIO = 0.5
PRUNE_HOURS = 48
FUTURE_SKEW_MINUTES = 10

NUMBER_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def is_changed(df: DataFrame, new: str, old: str, tracked: list[str]) -> Column:
    """Any tracked field differs; null, '' and 0 are the same; timestamps compare as instants.

    ``new`` and ``old`` are column-name prefixes.
    """
    types = dict(df.dtypes)
    tests = []
    for c in tracked:
        a, b = F.col(f"{new}{c}"), F.col(f"{old}{c}")
        if types[f"{new}{c}"] in NUMBER_TYPES:
            tests.append(F.coalesce(a, F.lit(0)) != F.coalesce(b, F.lit(0)))
        elif types[f"{new}{c}"] == "string":
            tests.append(F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
        else:
            tests.append(~a.eqNullSafe(b))
    return reduce(lambda x, y: x | y, tests)


def sync_match(incoming: DataFrame, existing: DataFrame, cols: list[str]) -> DataFrame:
    """Stored row for every incoming row, by ``key``, else by ``legacy_key``; its columns come back
    as ``prev_<col>`` with ``prev_key`` null when there is none.

    ``existing`` holds one row per key. Both joins are on unique keys, so no group is gathered.
    """
    stored = existing.select(F.col("key").alias("_k"), F.struct("key", *cols).alias("_row"))
    by_key = stored.withColumnRenamed("_k", "key").withColumnRenamed("_row", "_a")
    by_legacy = stored.withColumnRenamed("_k", "legacy_key").withColumnRenamed("_row", "_b")
    found = incoming.join(by_key, "key", "left").join(by_legacy, "legacy_key", "left")
    prev = F.coalesce(F.col("_a"), F.col("_b"))
    return found.select(
        *[F.col(c) for c in incoming.columns],
        prev["key"].alias("prev_key"), *[prev[c].alias(f"prev_{c}") for c in cols])


def active_count_by_source(existing: DataFrame, sources: list[str]) -> DataFrame:
    """Distinct active rows per expected source, by id, else by source and link."""
    row_id = F.coalesce(F.col("id").cast("string"), F.concat_ws(":", "source", "source_link"))
    return (
        existing.where(F.col("deleted_at").isNull() & F.col("source").isin(sources))
        .select("source", row_id.alias("_id")).distinct()
        .groupBy("source").agg(F.count(F.lit(1)).alias("existing_rows"))
    )


def eligible_incoming(matched: DataFrame, prune_before: Column | None) -> DataFrame:
    """Incoming rows that take part: neither they nor their stored row lies before the prune cutoff."""
    if prune_before is None:
        return matched
    none = F.lit(None).cast("timestamp")
    return matched.where(
        ~is_older_than(F.col("registered_at"), none, prune_before)
        & ~(F.col("prev_key").isNotNull() & is_older_than(F.col("prev_registered_at"), none, prune_before)))


def eligible_count_by_source(eligible: DataFrame) -> DataFrame:
    """Participating incoming rows per source."""
    return eligible.where(text_or_empty(F.col("source")) != "").groupBy("source").agg(
        F.count(F.lit(1)).alias("incoming_rows"))


def expected_minus_current(spark, expected: list[str], incoming: DataFrame, stale: list[str]) -> DataFrame:
    """Expected sources the input lacks, and the stale ones."""
    listed = spark.createDataFrame([(s,) for s in expected], "source string")
    missing = listed.join(incoming.select("source").distinct(), "source", "left_anti")
    if stale:
        missing = missing.unionByName(spark.createDataFrame([(s,) for s in stale], "source string"))
    return missing.distinct()


def delete_guard(
    existing: DataFrame, incoming: DataFrame, eligible: DataFrame, sources: list[str], stale: list[str] = (),
    min_rows: int = GUARD_MIN_ROWS, ratio: float = GUARD_RATIO,
) -> DataFrame:
    """Per expected source (plus stale ones) the row counts and whether deletes are withheld:
    absent from the input, stale, or enough stored rows with fewer than ``ratio`` of them present.

    One row per listed source, so its size is that of the list.
    """
    spark = existing.sparkSession
    listed = spark.createDataFrame([(s, s in stale) for s in sorted({*sources, *stale})], "source string, stale boolean")
    seen = incoming.select("source").distinct().withColumn("_seen", F.lit(True))
    out = (
        listed.join(active_count_by_source(existing, sources), "source", "left")
        .join(eligible_count_by_source(eligible), "source", "left").join(seen, "source", "left")
        .fillna({"existing_rows": 0, "incoming_rows": 0, "_seen": False})
    )
    sparse = (F.col("existing_rows") >= min_rows) & (F.col("incoming_rows") < F.col("existing_rows") * ratio)
    absent = ~F.col("_seen") & F.col("source").isin(sources)
    return out.withColumn("guarded", F.col("stale") | absent | sparse).drop("_seen")


def sync_missing(existing: DataFrame, eligible: DataFrame) -> DataFrame:
    """Stored rows whose key no participating incoming row carries (either of its two keys)."""
    keys = eligible.select(F.explode(F.array("key", "legacy_key")).alias("key")).distinct()
    return existing.join(keys, "key", "left_anti")


def plan_sync(
    incoming: DataFrame, existing: DataFrame, now: str | Column, sources: list[str],
    stale: list[str] = (), tracked: list[str] | None = None, prune: bool = True,
    min_rows: int = GUARD_MIN_ROWS, ratio: float = GUARD_RATIO,
) -> DataFrame:
    """One row per affected key: insert, reactivate, update, unchanged, skip_expired, delete_missing,
    delete_expired or keep_guarded.

    ``incoming`` needs ``key`` and ``legacy_key``, ``existing`` one row per ``key`` (W2). Expired stored
    rows go even where deletes are withheld. Expected sources are a short list, so the guard table
    has a known size and is broadcast.
    """
    tracked = [c for c in (tracked or TRACKED_FIELDS) if c in incoming.columns and c in existing.columns]
    cutoff = as_ts(now) - F.expr(f"INTERVAL {PRUNE_HOURS} HOURS") if prune else None
    cols = list(dict.fromkeys([*tracked, "id", "source", "source_link", "registered_at", "deleted_at"]))
    matched = sync_match(incoming, existing, [c for c in cols if c in existing.columns])
    none = F.lit(None).cast("timestamp")
    expired_in = F.lit(False)
    if cutoff is not None:
        expired_in = is_older_than(F.col("registered_at"), none, cutoff) | (
            F.col("prev_key").isNotNull() & is_older_than(F.col("prev_registered_at"), none, cutoff))
    action = (
        F.when(expired_in, "skip_expired")
        .when(F.col("prev_key").isNull(), "insert")
        .when(F.col("prev_deleted_at").isNotNull(), "reactivate")
        .when(is_changed(matched, "", "prev_", tracked), "update")
        .otherwise("unchanged")
    )
    # Classified once and stored: the change list, the guard counts and the missing test all read it.
    classified = scale.cut_lineage(matched.select(
        action.alias("action"), "key", "legacy_key", "prev_key", F.col("prev_id").alias("id"), "source", "source_link"))
    changes = classified.drop("legacy_key")
    eligible = classified.where("action <> 'skip_expired'")
    guard = delete_guard(existing, incoming, eligible, sources, stale, min_rows, ratio)
    active = existing.where(
        F.col("deleted_at").isNull() & F.col("source").isin(sources)
        & (text_or_empty(F.col("source_link")) != ""))
    old = is_older_than(F.col("registered_at"), none, cutoff) if cutoff is not None else F.lit(False)
    active = active.withColumn("prev_key", F.col("key"))
    expired = active.where(old).withColumn("action", F.lit("delete_expired"))
    missing = (
        sync_missing(active.where(~old), eligible)
        .join(F.broadcast(guard.select("source", "guarded")), "source", "left")
        .withColumn("action", F.when(F.col("guarded"), "keep_guarded").otherwise("delete_missing"))
    )
    names = ["action", "key", "prev_key", "id", "source", "source_link"]
    return changes.unionByName(expired.select(*names)).unionByName(missing.select(*names))


def prune_deletes(existing: DataFrame, now: str | Column, sources: list[str], hours: int = PRUNE_HOURS) -> DataFrame:
    """Active rows of expected sources older than the window."""
    cutoff = as_ts(now) - F.expr(f"INTERVAL {hours} HOURS")
    return _deletable(existing, sources).where(
        is_older_than(F.col("registered_at"), F.lit(None).cast("timestamp"), cutoff))


def future_deletes(
    existing: DataFrame, now: str | Column, sources: list[str], minutes: int = FUTURE_SKEW_MINUTES
) -> DataFrame:
    """Active rows of expected sources dated ahead of now."""
    cutoff = as_ts(now) + F.expr(f"INTERVAL {minutes} MINUTES")
    return _deletable(existing, sources).where(
        is_future_dated(F.col("registered_at"), F.lit(None).cast("timestamp"), cutoff))


def _deletable(existing: DataFrame, sources: list[str]) -> DataFrame:
    return existing.where(
        F.col("deleted_at").isNull() & F.col("source").isin(sources)
        & (text_or_empty(F.col("source_link")) != ""))


def append_id_deletes(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Base rows, then candidates whose id is not listed yet; rows without id always stay."""
    both = base.withColumn("_gen", F.lit(0)).unionByName(candidates.withColumn("_gen", F.lit(1)))
    with_id = both.where(F.col("id").isNotNull())
    listed = base.where(F.col("id").isNotNull()).withColumn("_gen", F.lit(0))
    fresh = scale.keep_one(with_id.where("_gen = 1"), ["id"], F.col("reason").asc()).join(
        listed.select("id").distinct(), "id", "left_anti")
    return both.where(F.col("id").isNull()).unionByName(listed).unionByName(fresh).drop("_gen")


def delete_plan_union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Every delete reason in priority order; a row id is listed once, under its first reason."""
    tagged = [
        df.select("id", "source", "source_link").withColumn("reason", F.lit(name)).withColumn("_prio", F.lit(i))
        for i, (name, df) in enumerate(parts)
    ]
    both = reduce(DataFrame.unionByName, tagged)
    named = scale.keep_one(both.where(F.col("id").isNotNull()), ["id"], F.col("_prio").asc())
    return named.unionByName(both.where(F.col("id").isNull())).drop("_prio")


def push_candidates(plan: DataFrame) -> DataFrame:
    """New or reactivated keys, once each."""
    return plan.where(F.col("action").isin("insert", "reactivate")).select("key", "source", "source_link").distinct()


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """A change replaces the stored row of its key; ``keep`` columns survive from the stored row.

    One full-outer join on the key; ``changes`` holds one row per key. Columns a change lacks keep
    their stored value.
    """
    mark = changes.select(*keys, F.struct(*[c for c in changes.columns if c not in keys]).alias("_new"),
                          F.lit(True).alias("_hit"))
    new_cols = set(changes.columns)
    joined = base.join(mark, keys, "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = [F.col(k) for k in keys]
    for c in base.columns:
        if c in keys:
            continue
        if c not in new_cols:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.coalesce(F.col(c), F.col(f"_new.{c}")).alias(c))
        else:
            out.append(F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def soft_delete(base: DataFrame, deletes: DataFrame, now: str | Column) -> DataFrame:
    """Stamp deleted_at and updated_at on listed rows, by id, else by (source, source_link)."""
    by_id = deletes.where(F.col("id").isNotNull()).select("id").distinct().withColumn("_d1", F.lit(True))
    by_link = deletes.where(F.col("id").isNull()).select("source", "source_link").distinct().withColumn(
        "_d2", F.lit(True))
    hit = F.coalesce(F.col("_d1"), F.col("_d2"), F.lit(False)) & F.col("deleted_at").isNull()
    stamp = as_ts(now)
    return (
        base.join(by_id, "id", "left").join(by_link, ["source", "source_link"], "left")
        .withColumn("updated_at", F.when(hit, stamp).otherwise(F.col("updated_at")))
        .withColumn("deleted_at", F.when(hit, stamp).otherwise(F.col("deleted_at")))
        .select(*base.columns)
    )


def purge_soft_deleted(base: DataFrame) -> DataFrame:
    """User rows and rows that are not deleted."""
    return base.where((F.col("source") == "user") | F.col("deleted_at").isNull())


WRITING_ACTIONS = ["insert", "reactivate", "update", "delete_missing", "delete_expired"]


def affected_rows(stored: DataFrame, plan: DataFrame, deletes: DataFrame) -> DataFrame:
    """Stored rows that ``apply_plan``, ``soft_delete`` and ``purge_soft_deleted`` may change; a row may come more than once."""
    acted = plan.where(F.col("action").isin(WRITING_ACTIONS))
    keys = acted.select("key").union(acted.select("prev_key")).where("key IS NOT NULL").distinct()
    by_id = deletes.where("id IS NOT NULL").select("id").distinct()
    by_link = deletes.where("id IS NULL").select("source", "source_link").distinct()
    return (
        stored.join(keys, "key", "left_semi").unionByName(stored.join(by_id, "id", "left_semi"))
        .unionByName(stored.join(by_link, ["source", "source_link"], "left_semi"))
        .unionByName(stored.where(F.col("deleted_at").isNotNull() & ~F.col("source").eqNullSafe("user")))
    )


def apply_plan(
    existing: DataFrame, incoming: DataFrame, plan: DataFrame, now: str | Column, payload: list[str]
) -> DataFrame:
    """The stored table after a plan: changed rows written and revived, deletes stamped.

    A change goes to the stored row the plan matched (``prev_key``), which then takes the new key; so a row found by its
    legacy key is rewritten in place. Should two changes have matched one stored row, the one of the same key gets it
    and the other is inserted.
    """
    plan = scale.cut_lineage(plan.select("action", "key", "prev_key"))
    changed = plan.where(F.col("action").isin("insert", "reactivate", "update"))
    claims = changed.where("prev_key IS NOT NULL")
    owners = scale.keep_one(claims, ["prev_key"], (F.col("key") != F.col("prev_key")).asc(), F.col("key").asc()).select(
        "key", F.col("prev_key").alias("_at"))
    placed = changed.select("key").join(owners, "key", "left").select("key", F.coalesce("_at", "key").alias("_at"))
    changes = (
        incoming.join(placed, "key").select("_at", "key", "id", *payload)
        .withColumn("updated_at", as_ts(now)).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    )
    deletes = plan.where(F.col("action").isin("delete_missing", "delete_expired")).select("key").withColumn(
        "_gone", F.lit(True))
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & F.col("deleted_at").isNull()
    stamped = (
        existing.join(deletes, "key", "left")
        .withColumn("updated_at", F.when(hit, as_ts(now)).otherwise(F.col("updated_at")))
        .withColumn("deleted_at", F.when(hit, as_ts(now)).otherwise(F.col("deleted_at")))
        .drop("_gone").withColumn("_at", F.col("key"))
    )
    return upsert(stamped, changes, ["_at"], keep=["id"]).select(*existing.columns)


def cached_detail_enrich(rows: DataFrame, previous: DataFrame, cols: list[str]) -> DataFrame:
    """Details parsed earlier, by id, else by link; only filled fields replace the row's own.

    ``previous`` needs ``id``, ``link`` and ``cols``; the newest ``pos`` wins per look-up key.
    """
    packed = previous.select("id", "link", "pos", F.struct(*cols).alias("_c"))
    by_id = scale.keep_one(
        packed.where(text_or_empty(F.col("id")) != ""), ["id"], F.col("pos").desc()).select("id", F.col("_c").alias("_a"))
    by_link = scale.keep_one(
        packed.where(text_or_empty(F.col("link")) != ""), ["link"], F.col("pos").desc()
    ).select("link", F.col("_c").alias("_b"))
    # Blank look-up keys match nothing; as nulls they are spread instead of meeting in one task.
    spread = [c for c in rows.columns if c not in ("id", "link")]
    keyed = rows.withColumn("id", F.nullif("id", F.lit(""))).withColumn("link", F.nullif("link", F.lit("")))
    found = scale.salted_join(
        scale.salted_join(keyed, by_id, ["id"], spread, "left"), by_link, ["link"], spread, "left")
    hit = F.coalesce(F.col("_a"), F.col("_b"))
    out = found.withColumn("_hit", hit)
    for c in cols:
        cached = F.when(text_or_empty(F.col("_hit")[c]) != "", F.col("_hit")[c])
        out = out.withColumn(c, F.coalesce(cached, F.col(c)))
    return out.withColumn("detail_cached", F.col("_hit").isNotNull()).drop("_a", "_b", "_hit")


def preserve_unseen(previous: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """Collected rows plus earlier rows none of whose keys was collected.

    ``keys`` name alternative identities (post number, link); null or '' never matches.
    """
    kept = previous
    present = F.lit(False)
    for k in keys:
        present = present | (text_or_empty(F.col(k)) != "")
        seen = collected.where(text_or_empty(F.col(k)) != "").select(k).distinct()
        kept = kept.join(seen, k, "left_anti")
    return collected.unionByName(kept.where(present), allowMissingColumns=True)


def hidden_anti_join(items: DataFrame, hidden_links: DataFrame, hidden_nos: DataFrame) -> DataFrame:
    """Rows neither whose link nor whose post number is hidden; the two lists are broadcast only
    after a size check."""
    return items.join(scale.broadcast_checked(hidden_links.distinct()), "source_link", "left_anti").join(
        scale.broadcast_checked(hidden_nos.distinct()), "source_post_id", "left_anti")


def page_tail_seen(rows: DataFrame, previous_keys: DataFrame, n: int = 3) -> DataFrame:
    """Per page whether any of its last n rows was known before (batch overlap check)."""
    tail = scale.keep_top(rows, ["page"], n, F.col("pos").desc())
    known = previous_keys.select("key").distinct().withColumn("_known", F.lit(1))
    return tail.join(known, "key", "left").groupBy("page").agg(
        (F.count("_known") > 0).alias("tail_seen"))
