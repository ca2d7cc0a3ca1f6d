"""Push-device clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.keys import normalize_display_mode, normalize_installation_id, text_or_empty
from pricetide.operators import scale

# Clean-up reasons in the order they claim a device.
REASONS = [
    "standalone_pwa_registered",
    "duplicate_web_push_endpoint",
    "duplicate_web_push_installation",
    "duplicate_legacy_pwa_user_agent",
    "duplicate_fcm_token",
]


def device_recency(df: DataFrame) -> Column:
    """Newest of the last-seen, updated and created times the table has; 0 when none is set."""
    times = [c for c in ("last_seen_at", "updated_at", "created_at") if c in df.columns]
    micros = [F.coalesce(F.unix_micros(F.col(c)), F.lit(0).cast("bigint")) for c in times]
    return micros[0] if len(micros) == 1 else F.greatest(*micros)


def device_cleanup(devices: DataFrame) -> DataFrame:
    """(id, uid, reason, superseded_by) for every device a better registration of its user replaces.

    Each device is exploded into the rules it takes part in (rule, group key, rank as keeper, whether it
    can lose). Keepers are one ``max_by`` row per group, combined map-side; the join back is salted, so
    a user with very many devices is spread. The lowest rule wins per device.
    """
    web = text_or_empty(F.col("endpoint")) != ""
    pwa = F.lit(False)
    if "client_kind" in devices.columns:
        pwa = F.lower(text_or_empty(F.col("client_kind"))) == "pwa"
    mode = normalize_display_mode(F.col("display_mode"))
    standalone = web & (pwa | (mode == "standalone"))
    install = normalize_installation_id(F.col("installation_id"))
    agent = F.lower(text_or_empty(F.col("user_agent")))
    token = text_or_empty(F.col("fcm_token"))

    def rule(number: int, when: Column, key: Column, keeper: Column, loses: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(number).alias("rule"), key.alias("key"), keeper.cast("int").alias("keeper"), loses.alias("loses")))

    yes = F.lit(True)
    legacy = install == ""
    rules = F.array_compact(F.array(
        rule(0, web, F.lit(""), F.when(standalone, 1).otherwise(0), ~standalone),
        rule(1, web, F.trim("endpoint"), F.lit(1), yes),
        rule(2, standalone & ~legacy, F.concat_ws(":", mode, install), F.lit(1), yes),
        rule(3, standalone & (agent != ""), agent, F.when(legacy, 1).otherwise(2), legacy),
        rule(4, token != "", token, F.lit(1), yes),
    ))
    rows = devices.where("enabled").select(
        "id", "uid", device_recency(devices).alias("_seen"), F.explode(rules).alias("r")
    ).select("id", "uid", "_seen", "r.rule", "r.key", "r.keeper", "r.loses")
    group = ["uid", "rule", "key"]
    keepers = (
        rows.where("keeper > 0").groupBy(*group)
        .agg(F.max_by("id", F.struct("keeper", "_seen", "id")).alias("superseded_by"))
    )
    losers = scale.salted_join(rows.where("loses"), keepers, group, ["id"]).where(
        F.col("id") != F.col("superseded_by"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return losers.groupBy("id", "uid").agg(F.min(F.struct("rule", "superseded_by")).alias("_first")).select(
        "id", "uid", F.element_at(names, F.col("_first.rule") + 1).alias("reason"),
        F.col("_first.superseded_by").alias("superseded_by"))


def cleanup_reason_counts(actions: DataFrame) -> DataFrame:
    """Planned actions per reason."""
    return actions.groupBy("reason").agg(F.count(F.lit(1)).alias("planned"))


def cleanup_summary(devices: DataFrame, actions: DataFrame) -> DataFrame:
    """Scanned devices, distinct users, enabled devices and planned actions in one row."""
    scanned = devices.agg(
        F.count(F.lit(1)).alias("scanned_devices"), F.countDistinct("uid").alias("scanned_users"),
        F.count_if("enabled").alias("enabled_devices"))
    return scale.beside(scanned, actions.agg(F.count(F.lit(1)).alias("planned")))
