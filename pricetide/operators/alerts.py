"""Keyword alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import text as X
from pricetide.functions.keys import normalize_display_mode, subscription_id, text_or_empty, user_keyword_id
from pricetide.functions.times import as_ts
from pricetide.operators import scale
from pricetide.operators.terms import term_finder
from pricetide.session import cut_lineage

# Throttle window and digest limits.
WINDOW_MINUTES = 30
MAX_PENDING_TITLES = 5
MAX_PENDING_IDS = 30
PUSH_CAP = 50
DIGESTS_PER_CYCLE = 50

# Wording of notifications where the caller gives none.
ALERT_TITLE = "Keyword alert"
MATCH_BODY = ": a new deal is in."
DIGEST_BODY = ": {n} new deals are in."


def deal_terms(deals: DataFrame, text_cols: list[str], deal_id: str = "id") -> DataFrame:
    """Distinct (deal, term) pairs; duplicates vanish inside the row, before any shuffle.

    An inner explode would make the optimizer test the array's size first, parsing every text twice.
    """
    normalized = X.normalize_text(*[F.col(c) for c in text_cols])
    return deals.select(
        F.col(deal_id).alias("deal_id"), F.explode_outer(X.candidate_terms(normalized)).alias("term")
    ).where("term IS NOT NULL")


def keyword_match(
    deals: DataFrame, subscriptions: DataFrame, text_cols: list[str], deal_id: str = "id", strict: bool = True,
) -> DataFrame:
    """(deal_id, uid, term) for every enabled subscription whose term occurs as a 1-3 word phrase.

    Deal text loses punctuation while a stored term keeps it, so ``strict`` (the stored behaviour)
    can never match a term such as ``c++``; ``strict=False`` normalises both sides. While the subscribed terms are few
    enough to lie beside the texts, these are searched for them and their other phrases are never made. Subscriptions
    are broadcast while their checked number allows; beyond it a term in very many deals is salted by deal.
    """
    term = X.normalize_term(F.col("term"))
    if not strict:
        term = X.normalize_text(term)
    wanted = (
        subscriptions.where("enabled")
        .select(F.col("uid"), term.alias("term")).where("term <> '' AND uid IS NOT NULL").distinct()
    )
    words = F.size(F.split("term", " "))
    phrase = words.between(1, X.PHRASE_WORDS) & F.char_length("term").between(X.PHRASE_MIN, X.PHRASE_MAX)
    padded = F.concat(F.lit(" "), F.col("term"), F.lit(" "))
    wanted = scale.cut_lineage(wanted)
    finder = term_finder(wanted.where(phrase).select(padded.alias("term")))
    if finder is None:
        terms = deal_terms(deals, text_cols, deal_id)
    else:  # a phrase of a normalised text is what lies in it between spaces
        spaced = F.concat(F.lit(" "), X.normalize_text(*[F.col(c) for c in text_cols]), F.lit(" "))
        held = deals.select(F.col(deal_id).alias("deal_id"), F.explode_outer(finder(spaced)).alias("term"))
        terms = held.select("deal_id", F.trim("term").alias("term")).where("term IS NOT NULL")
    return scale.join_small_or_salted(terms, wanted, ["term"], ["deal_id"]).select("deal_id", "uid", "term")


def validate_subscription(matches: DataFrame, index: DataFrame, user_keywords: DataFrame) -> DataFrame:
    """Matches whose (uid, term) is enabled in the index and in the user's own list."""
    keys = ["uid", "term"]
    pairs = index.where("enabled").select(*keys).distinct().join(
        scale.shuffled(user_keywords.where("enabled").select(*keys).distinct()), keys, "left_semi")
    return scale.join_small_or_salted(matches, pairs, keys, ["deal_id"], "left_semi")


def suppress_already_matched(matches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs (deal, user) the ledger does not hold yet."""
    return matches.join(scale.shuffled(ledger.select("deal_id", "uid").distinct()), ["deal_id", "uid"], "left_anti")


def collect_terms(matches: DataFrame) -> DataFrame:
    """Matched terms per (deal, user), longest first then alphabetical; the first is the primary.

    A deal has a bounded number of phrases per word, so the array grows with the deal's own text only.
    """
    keyed = F.struct((-F.char_length("term")).alias("len"), F.col("term").alias("term"))
    ordered = F.array_sort(F.collect_set(keyed))
    return matches.groupBy("deal_id", "uid").agg(ordered.alias("_t")).select(
        "deal_id", "uid", F.transform("_t", lambda t: t["term"]).alias("terms"),
        F.element_at("_t", 1)["term"].alias("primary_term"))


def first_alerts(matches: DataFrame, at: str, order: str) -> DataFrame:
    """First match per (uid, term): the alert that is sent at once."""
    return scale.keep_one(matches, ["uid", "term"], F.col(at).asc(), F.col(order).asc())


def attach_enabled_devices(matches: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per match and enabled device of its user. A user with very many matches is salted."""
    enabled = devices.where("enabled").drop("enabled").withColumnRenamed("id", "device_id")
    return scale.salted_join(matches, enabled, ["uid"], ["deal_id"])


def split_devices(devices: DataFrame) -> DataFrame:
    """Per user the distinct messaging tokens, the web endpoints that stay, and how many browser
    endpoints a stand-alone app suppresses. Only enabled devices count.

    Counting is done on distinct (uid, token) rows, so nothing is gathered per user.
    """
    mode = normalize_display_mode(F.col("display_mode"))
    web = text_or_empty(F.col("endpoint")) != ""
    pwa = (F.lower(F.coalesce(F.col("client_kind"), F.lit(""))) == "pwa") if "client_kind" in devices.columns else F.lit(False)
    flagged = devices.where("enabled").select(
        "uid", text_or_empty(F.col("fcm_token")).alias("token"), web.alias("web"),
        (web & (pwa | (mode == "standalone"))).alias("standalone"), (web & ~pwa & (mode == "browser")).alias("browser"))
    counts = flagged.groupBy("uid").agg(
        F.bool_or("standalone").alias("has_standalone"), F.count_if("web").alias("_web"),
        F.count_if("browser").alias("_browser"))
    tokens = flagged.where("token <> ''").select("uid", "token").distinct().groupBy("uid").agg(
        F.count(F.lit(1)).alias("tokens"))
    suppressed = F.when(F.col("has_standalone"), F.col("_browser")).otherwise(F.lit(0))
    return counts.join(tokens, "uid", "left").select(
        "uid", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("_web") - suppressed).alias("web_devices"),
        suppressed.cast("bigint").alias("suppressed"))


def send_targets(devices: DataFrame) -> DataFrame:
    """Where a user's alerts go, one row each: ``uid, kind, target``.

    ``token`` rows are the distinct messaging tokens, ``web`` rows the ids of devices with a web endpoint; browsers are left
    out for users who have a stand-alone app. Only enabled devices count.
    """
    mode = normalize_display_mode(F.col("display_mode"))
    pwa = (F.lower(F.coalesce(F.col("client_kind"), F.lit(""))) == "pwa") if "client_kind" in devices.columns else F.lit(False)
    flagged = devices.where("enabled").select(
        "uid", "id", text_or_empty(F.col("fcm_token")).alias("token"), (text_or_empty(F.col("endpoint")) != "").alias("web"),
        (pwa | (mode == "standalone")).alias("app"), (~pwa & (mode == "browser")).alias("browser"))
    tokens = flagged.where("token <> ''").select("uid", F.lit("token").alias("kind"), F.col("token").alias("target")).distinct()
    apps = flagged.where("web AND app").select("uid").distinct().withColumn("_app", F.lit(True))
    web = scale.salted_join(flagged.where("web"), apps, ["uid"], ["id"], "left").where("_app IS NULL OR NOT browser")
    return tokens.unionByName(web.select("uid", F.lit("web").alias("kind"), F.col("id").cast("string").alias("target")))


def drop_no_device(alerts: DataFrame, targets: DataFrame) -> DataFrame:
    """Ledger status per alert: ready, or skipped for want of any token or endpoint."""
    reachable = targets.where("tokens + web_devices > 0").select("uid").withColumn("_ok", F.lit(True))
    return scale.salted_join(alerts, reachable, ["uid"], ["deal_id"], "left").withColumn(
        "status", F.when(F.col("_ok"), "ready").otherwise("skipped")
    ).withColumn("reason", F.when(F.col("_ok"), "").otherwise("no_tokens")).drop("_ok")


def alert_dedup(matches: DataFrame, ledger: DataFrame, order: Column) -> DataFrame:
    """R3, batch form: one row per (deal, user) ever."""
    fresh = suppress_already_matched(matches, ledger)
    return scale.keep_one(fresh, ["deal_id", "uid"], order)


def _sessions(instants: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per key and slot (one window wide): its first instant ``_lo``, its ``_session``, the session's ``_slots``, and
    ``_later``, the first instant of the session behind the next slot.

    A silence of a whole window always ends a session, as no silence hides inside a slot. One row per key and slot.
    """
    slots = instants.groupBy(*keys, "slot").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    by_key = Window.partitionBy(*keys).orderBy("slot")
    previous = F.lag("_hi").over(by_key)
    opens = F.when(previous.isNull() | (F.col("_lo") - previous >= width), F.col("slot"))
    slots = slots.withColumn("_open", opens).withColumn(
        "_session", F.last("_open", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy(*keys, "_session")
    inside = session.orderBy("slot")
    later = F.when(F.lead("slot").over(inside) > F.col("slot") + 1, F.lead("_lo").over(inside)).otherwise(F.lead("_lo", 2).over(inside))
    return slots.withColumn("_later", later).withColumn("_slots", F.max("slot").over(session) - F.col("_session") + 1).drop("_hi", "_open")


def _jumps(instants: DataFrame, slots: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``_session, at, _first, _slots, next`` of the instants of sessions longer than a slot: ``next`` is the first instant
    a window or more later, null at the session's end; ``_first`` tells the first of its slot.

    An instant looks its next one up in the slot behind its own, where both sides are sorted together; a slot of a key is
    the largest group.
    """
    nodes = instants.select(*keys, "slot", "at").join(slots.where("_slots > 1"), [*keys, "slot"])
    there = nodes.select(*keys, "_session", "slot", F.col("at").alias("_pos"), F.col("at").alias("_there"))
    asking = nodes.select(
        *keys, (F.col("slot") + 1).alias("slot"), (F.col("at") + width).alias("_pos"), F.lit(None).cast("bigint").alias("_there"),
        "at", "_session", "_slots", "_later", (F.col("at") == F.col("_lo")).alias("_first"))
    from_behind = Window.partitionBy(*keys, "_session", "slot").orderBy(F.col("_pos").desc(), F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = there.unionByName(asking, allowMissingColumns=True).withColumn("_found", F.min("_there").over(from_behind))
    return found.where("at IS NOT NULL").select(*keys, "_session", "at", "_first", "_slots", F.coalesce("_found", "_later").alias("next"))


def _chain_starts(instants: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, at``: the instants that open windows, found without walking a key.

    Each block of slots is a jump function: from where a chain enters it to where the chain leaves it. A chain enters a
    block in its first slot, or at the first instant of a later one, so these entries say all. Two neighbour blocks are
    composed into one by one join, which leaves half of the entries: after log2(slots of the longest session) rounds
    each session is one block, entered at its first instant. The way back down places the entries of the halves.
    """
    slots = cut_lineage(_sessions(instants, keys, width))
    longest = slots.agg(F.max("_slots")).first()[0] or 1
    block = lambda at, level: F.shiftright(F.floor(F.col(at) / width).cast("bigint") - F.col("_session"), level)
    links, level = [], 0
    jumps = cut_lineage(_jumps(instants, slots, keys, width)) if longest > 1 else None
    while 1 << level < longest:
        inner = F.coalesce(block("next", level + 1) == block("at", level + 1), F.lit(False))
        links.append(jumps.where(inner).select(*keys, "at", "next"))
        level += 1
        if 1 << level < longest:
            tall = jumps.where((F.col("_slots") > 1 << level) & ((F.pmod(block("at", level - 1), F.lit(2)) == 0) | F.col("_first")))
            over = jumps.select(*keys, F.col("at").alias("next"), F.col("next").alias("_over"))
            composed = tall.where(inner).join(over, [*keys, "next"]).drop("next").withColumnRenamed("_over", "next")
            jumps = cut_lineage(tall.where(~inner).unionByName(composed))
    starts = slots.where("slot = _session").select(*keys, F.col("_lo").alias("at"))
    for link in reversed(links):
        both = F.array_compact(F.array("at", "next"))
        starts = starts.join(link, [*keys, "at"], "left").select(*keys, F.explode(both).alias("at"))
    return starts


def alert_windows(matches: DataFrame, keys: list[str], window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """The windows sent alerts open: ``keys, start`` (micros), ``n`` (matches inside, the sent one counted).

    Each sent alert is the first instant at least a window after the one before. Only distinct instants with their
    counts take part; chains restart at silences of a window or more, and are followed by composed jumps
    (``_chain_starts``), so a key whose matches never pause is shared by many tasks.
    """
    width = window_minutes * 60 * 1_000_000
    at = F.unix_micros("ts")
    instants = cut_lineage(matches.select(*keys, at.alias("at"), F.floor(at / width).cast("bigint").alias("slot")).groupBy(
        *keys, "at", "slot").agg(F.count(F.lit(1)).alias("c")))
    starts = cut_lineage(_chain_starts(instants, keys, width))
    inside = instants.join(_reached(starts.select(*keys, F.col("at").alias("start")), width), [*keys, "slot"]).where(
        (F.col("start") <= F.col("at")) & (F.col("at") - F.col("start") < width))
    return inside.groupBy(*keys, "start").agg(F.sum("c").alias("n"))


def _reached(windows: DataFrame, width: int) -> DataFrame:
    """A window lies in its start's slot and the one behind."""
    slot = F.floor(F.col("start") / width).cast("bigint")
    return windows.withColumn("slot", F.explode(F.array(slot, slot + 1)))


def alert_throttle(matches: DataFrame, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Send / queue per (uid, term): a sent alert opens a window anchored at itself; until it has
    run out further matches queue; the next one after that is sent and carries the digest.

    ``matches`` has (uid, term, deal_id, ts). Every match finds its window by (key, half-hour slot): the
    window's start lies in the match's own slot or the one before.
    """
    keys = ["uid", "term"]
    width = window_minutes * 60 * 1_000_000
    # At most one window per key and half hour, so the lag below is over a short list.
    pending = F.lag("n").over(Window.partitionBy(*keys).orderBy("start")) - 1
    windows = alert_windows(matches, keys, window_minutes).withColumn("_digest", F.coalesce(pending, F.lit(0)))
    reach = _reached(windows.select(*keys, "start", "_digest"), width)
    at = F.unix_micros("ts")
    rows = matches.select(*keys, "deal_id", "ts", at.alias("_at"), F.floor(at / width).cast("bigint").alias("slot"))
    found = rows.join(reach, [*keys, "slot"]).where(
        (F.col("start") <= F.col("_at")) & (F.col("_at") - F.col("start") < width))
    ranked = found.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, "start").orderBy("_at", "deal_id")))
    sent = F.col("_rank") == 1
    return ranked.select(
        *keys, "deal_id", "ts",
        F.when(sent, "send").otherwise("queue").alias("action"),
        F.when(sent, F.lit(0)).otherwise(F.col("_rank") - 1).cast("bigint").alias("pending_count"),
        F.when(sent, F.col("_digest")).otherwise(F.lit(0)).cast("bigint").alias("digest_count"),
    )


def due_digests(matches: DataFrame, now: str | Column, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """R2, batch form: state per (uid, term) after all matches: a due window with pending matches is
    flushed as a digest, a due window without any is dropped, the others stay open."""
    windows = alert_windows(matches, ["uid", "term"], window_minutes)
    last = windows.groupBy("uid", "term").agg(F.max(F.struct("start", "n")).alias("w"))
    started = F.timestamp_micros(F.col("w.start"))
    due_at = started + F.expr(f"INTERVAL {window_minutes} MINUTES")
    pending = F.col("w.n") - 1
    state = F.when(due_at > as_ts(now), "open").when(pending > 0, "digest").otherwise("dropped")
    return last.select("uid", "term", started.alias("window_started_at"), due_at.alias("due_at"),
                       pending.alias("pending_count"), state.alias("state"))


def digest_contents(
    matches: DataFrame, now: str | Column, subscriptions: DataFrame, targets: DataFrame, window_minutes: int = WINDOW_MINUTES,
) -> DataFrame:
    """``due_digests`` with what the digests hold: adds ``titles`` and ``deal_ids`` and settles the state.

    The lists are the last ``MAX_PENDING_TITLES`` titles and ``MAX_PENDING_IDS`` ids queued in the window, each once, in the
    order of their first match. A term no longer subscribed (``subscriptions``: uid, term) closes its window
    (``keyword_deleted``); a due digest of a user without targets (``split_devices``) is emptied and opens no new window
    (``no_tokens``). Lists are cut map-side, so a dense window is not gathered.
    """
    keys = ["uid", "term"]
    due = due_digests(matches, now, window_minutes)
    at = F.unix_micros("ts")
    queued = (
        matches.join(due.select(*keys, F.unix_micros("window_started_at").alias("_start")), keys).where(at >= F.col("_start"))
        .withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(at, "deal_id"))).where("_place > 1")
    )

    def last_values(name: str, most: int) -> DataFrame:
        value = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        once = queued.select(*keys, value.alias("_v"), "_place").where("_v <> ''").groupBy(*keys, "_v").agg(F.min("_place").alias("_place"))
        kept = scale.keep_top(once, keys, most, F.col("_place").desc())
        return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_l")).select(
            *keys, F.transform("_l", lambda x: x["_v"]).alias(f"_{name}"))

    wanted = subscriptions.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    reached = targets.where("tokens + web_devices > 0").select("uid").withColumn("_reached", F.lit(True))
    state = (
        F.when(F.col("_wanted").isNull(), "keyword_deleted")
        .when((F.col("state") == "digest") & F.col("_reached").isNull(), "no_tokens").otherwise(F.col("state")))
    none = F.array().cast("array<string>")
    return (
        due.join(last_values("title", MAX_PENDING_TITLES), keys, "left").join(last_values("deal_id", MAX_PENDING_IDS), keys, "left")
        .join(wanted, keys, "left").join(reached, "uid", "left")
        .select(*keys, "window_started_at", "due_at", "pending_count", F.coalesce("_title", none).alias("titles"),
                F.coalesce("_deal_id", none).alias("deal_ids"), state.alias("state"))
    )


def digest_cycle(windows: DataFrame, now: str | Column, subscriptions: DataFrame, targets: DataFrame, most: int = DIGESTS_PER_CYCLE) -> DataFrame:
    """R2, one cycle over the stored windows ``uid, term, window_started_at, due_at, pending_count``: adds ``outcome``.

    Of the due windows the ``most`` longest due are taken, ties by uid and term; the rest is ``deferred`` to the next
    cycle, windows not due are ``open``. A taken window without pending matches is ``dropped``, one whose term is no longer
    subscribed ``keyword_deleted``; with a user no device of whom can be reached it is emptied (``no_tokens``); the others
    leave as a ``digest``. Only the taken rows, ``most`` at most, meet in one task.
    """
    keys = ["uid", "term"]
    due = windows.where(F.col("due_at") <= as_ts(now))
    taken = F.broadcast(due.orderBy("due_at", *keys).limit(most).select(*keys, F.lit(True).alias("_taken")))  # ``most`` rows at most
    wanted = subscriptions.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    reached = targets.where("tokens + web_devices > 0").select("uid").distinct().withColumn("_reached", F.lit(True))
    outcome = (
        F.when(F.col("due_at") > as_ts(now), "open").when(F.col("_taken").isNull(), "deferred").when(F.col("pending_count") <= 0, "dropped")
        .when(F.col("_wanted").isNull(), "keyword_deleted").when(F.col("_reached").isNull(), "no_tokens").otherwise("digest"))
    return windows.join(taken, keys, "left").join(wanted, keys, "left").join(reached, "uid", "left").select(*windows.columns, outcome.alias("outcome"))


def after_cycle(cycle: DataFrame, now: str | Column, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """R2: the stored windows after a ``digest_cycle``: a digest opens a new window now, deferred ones stay due."""
    sent, emptied = F.col("outcome") == "digest", F.col("outcome").isin("digest", "no_tokens")
    stays = cycle.where(~F.col("outcome").isin("dropped", "keyword_deleted"))
    return stays.withColumns({
        "window_started_at": F.when(sent, as_ts(now)).otherwise(F.col("window_started_at")),
        "due_at": F.when(sent, as_ts(now) + F.expr(f"INTERVAL {window_minutes} MINUTES")).otherwise(F.col("due_at")),
        "pending_count": F.when(emptied, F.lit(0)).otherwise(F.col("pending_count"))}).drop("outcome")


def limited_unique_append(values: Column, value: Column, n: int) -> Column:
    """Append when absent, keep the last n."""
    clean = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    text = F.trim(F.coalesce(value, F.lit("")))
    grown = F.when((text == "") | F.array_contains(clean, text), clean).otherwise(F.array_append(clean, text))
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - n + 1), F.lit(n))


def notification_rows(alerts: DataFrame, alert_title: str = ALERT_TITLE, match_body: str = MATCH_BODY, digest_body: str = DIGEST_BODY) -> DataFrame:
    """Title, body, target and tag per alert; a digest (``kind = 'digest'``) counts its deals.

    The wording is the caller's: the term stands behind the title and before a body; ``{n}`` in ``digest_body`` is the count.
    """
    term = F.trim(F.coalesce("primary_term", F.lit("")))
    titled = F.when(term != "", F.concat(F.lit(f"{alert_title}: "), term)).otherwise(F.lit(alert_title))
    before, after = digest_body.split("{n}")
    count = F.greatest(F.lit(1), F.coalesce(F.col("digest_count"), F.lit(0))).cast("string")
    digest_text = F.concat(term, F.lit(before), count, F.lit(after))
    plain = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(term, F.lit(match_body)))
    digest = F.col("kind") == "digest"
    digest_id = F.substring(F.sha1(F.concat(F.lit("digest::"), term)), 1, 16)
    target = F.when(digest, F.concat(F.lit("keyword-digest-"), digest_id)).otherwise(F.col("deal_id").cast("string"))
    return alerts.select(
        "uid", "kind", titled.alias("title"), F.when(digest, digest_text).otherwise(plain).alias("body"),
        target.alias("target_id"), F.concat(F.lit("deal-"), target).alias("tag"))


def backfill_subscription_index(user_keywords: DataFrame) -> DataFrame:
    """Global index from the users' enabled, non-empty terms, one row per (uid, term)."""
    term = text_or_empty(F.col("term_normalized"))
    rows = user_keywords.where(F.col("enabled")).select(
        "uid", F.coalesce(F.nullif(text_or_empty(F.col("term")), F.lit("")), term).alias("term"),
        term.alias("term_normalized"),
    ).where("term_normalized <> ''")
    keyed = rows.withColumn("id", subscription_id(F.col("uid"), F.col("term_normalized"))).withColumn(
        "user_keyword_id", user_keyword_id(F.col("term_normalized")))
    return scale.keep_one(keyed, ["id"], F.col("term").asc())


def cap_rows(df: DataFrame, n: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first n rows in order, and one row telling how many were left for the next run."""
    dropped = df.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("dropped"))
    return df.orderBy(*order).limit(n), dropped
