"""Chat formatting in budgeted, turn-aligned windows with a loss mask (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template; every control string begins with "<|", which no escaped text holds.
START, END = "<|im_start|>", "<|im_end|>"
# Consecutive turn numbers whose token sums one task adds up.
TURN_BLOCK = 256
NO_BLOCK = -(2**60)


def escape(text: Column) -> Column:
    """One backslash more between "<" and "|", whatever number stands there: no "<|" is left, and nothing is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def turn_tokens(text: Column) -> Column:
    """Default measure of a turn: its white-space separated words and four tokens of template."""
    return F.regexp_count(text, F.lit(r"\S+")) + F.lit(4)


def _positions(turns: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1), ``before`` (tokens of earlier turns) and ``n_turns`` per conversation.

    Sums inside blocks of turn numbers plus offsets from the blocks' sums, so a conversation of any length is
    added up by many tasks.
    """
    turns = turns.withColumn("_b", F.coalesce(F.floor(F.col("turn") / F.lit(TURN_BLOCK)), F.lit(NO_BLOCK)))
    blocks = turns.groupBy("_c", "_b").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_c", "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.sum("_n").over(Window.partitionBy("_c")).alias("n_turns"))
    in_block = Window.partitionBy("_c", "_b").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        turns.withColumn("_rn", F.row_number().over(in_block))
        .withColumn("_t", F.coalesce(F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(offsets, ["_c", "_b"])
        .select("_c", "conv_id", "role", "text", "tokens", (F.col("_n0") + F.col("_rn")).alias("pos"), (F.col("_t0") + F.col("_t")).alias("before"), "n_turns")
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=turn_tokens) -> DataFrame:
    """One row per window: ``conv_id, window_start, n_repeated, n_tokens, over_budget, text, loss_spans``.

    The running token sum of a conversation cuts it at turn boundaries: a window takes the turns that start in one cell
    of half the room which budget, system turn and history leave, so they fit in that room; a turn larger than the cell
    has a window of its own, with ``over_budget`` set where even that does not fit. Every window begins with the system
    turn (a leading turn of role ``system``) and the last turns before it within ``history`` tokens. ``n_repeated`` turns
    at its head were in an earlier window already; the loss mask, ``loss_spans`` (array<struct<start, end>>, code points,
    end exclusive), covers the texts of the other assistant turns, so each is a target exactly once.

    Rows are ordered by turn (null first), then role and text, so repeated turns are kept and ties are settled. Null role
    and text count as empty; rows with a null conv_id form one conversation; other columns are not used; an empty table
    gives no window. Turn texts are escaped, so they cannot forge control strings, and roles are URL-encoded.
    """
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), tokens(text).cast("bigint").alias("tokens"))
    placed = _positions(turns)
    leads = (F.col("pos") == 1) & (F.col("role") == "system") & (F.col("n_turns") > 1)
    lead = placed.where(leads).select("_c", F.col("text").alias("_sys"), F.col("tokens").alias("_sys_tokens"))
    sys_tokens = F.coalesce("_sys_tokens", F.lit(0))
    room = F.greatest(F.lit(budget - history) - sys_tokens, F.lit(max(1, budget // 4)))
    body = (
        placed.where(~leads).join(lead.select("_c", "_sys_tokens"), "_c", "left")
        .withColumn("_half", F.greatest(F.floor(room / 2), F.lit(1)))
        .withColumn("before", F.col("before") - sys_tokens)
        .withColumn("_cell", F.floor(F.col("before") / F.col("_half")))
        .withColumn("_big", F.col("tokens") > F.col("_half"))
    )
    key = ["_c", "conv_id", "_cell", "_big"]
    windows = body.groupBy(*key).agg(F.min("before").alias("_start"))
    own = body.select(*key, F.lit(2).alias("kind"), "pos", "role", "text", "tokens", F.col("before").alias("_start"))
    system = windows.join(lead, "_c").select(
        *key, F.lit(0).alias("kind"), F.lit(1).alias("pos"), F.lit("system").alias("role"), F.col("_sys").alias("text"),
        F.col("_sys_tokens").alias("tokens"), "_start")
    parts = own.unionByName(system)
    if history > 0:
        end = F.col("before") + F.col("tokens")
        reach = lambda c: F.floor(c / F.lit(history))
        past = body.where(F.col("tokens") <= history).select(
            "_c", "pos", "role", "text", "tokens", "before", end.alias("_end"),
            F.explode(F.sequence(reach(end), reach(F.col("before") + history))).alias("_h"))
        parts = parts.unionByName(
            windows.withColumn("_h", reach(F.col("_start"))).join(past, ["_c", "_h"])
            .where((F.col("_start") >= F.col("_end")) & (F.col("_start") - F.col("before") <= history))
            .select(*key, F.lit(1).alias("kind"), "pos", "role", "text", "tokens", "_start"))
    bundle = parts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "role", "text", "tokens"))).alias("parts"),
        F.min(F.when(F.col("kind") == 2, F.col("_start"))).alias("window_start"))
    first = F.col("window_start") == 0
    piece = F.transform("parts", lambda p: F.struct(
        F.concat(F.lit(START), F.url_encode(p["role"]), F.lit("\n")).alias("head"), escape(p["text"]).alias("body"),
        ((p["kind"] == 2) & (p["role"] == "assistant")).alias("target")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def place(acc, p):
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        out = F.when(p["target"], F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.struct((end + F.lit(len(END) + 1)).alias("at"), out.alias("out"))

    n_tokens = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"])
    repeated = F.size(F.filter("parts", lambda p: (p["kind"] == 1) | ((p["kind"] == 0) & ~F.col("_first"))))
    return (
        bundle.withColumn("_first", first).withColumn("_pieces", piece)
        .select(
            "conv_id", "window_start", repeated.alias("n_repeated"), n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"),
            F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("text"),
            F.aggregate("_pieces", empty, place, lambda acc: acc["out"]).alias("loss_spans"))
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The turns of each window read back from its text: adds ``turns`` (array<struct<role, text>>, repeated ones left
    out) and ``loss`` (the unescaped texts under the mask)."""
    turn = lambda piece: F.struct(
        F.url_decode(F.substring_index(piece, "\n", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(piece, r"^[^\n]*\n", ""), r"<\|im_end\|>\n$", "")).alias("text"))
    pieces = F.split("text", r"<\|im_start\|>", -1)
    new = F.slice(pieces, F.col("n_repeated") + 2, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    under = lambda s: unescape(F.substr("text", s["start"] + 1, s["end"] - s["start"]))
    return windows.withColumns({"turns": F.transform(new, turn), "loss": F.transform("loss_spans", under)})


def conversation_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: turn count, digests of turns and targets, and sizes."""
    read = read_windows(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    row = F.struct(
        "window_start", said.alias("said"), F.array_join("loss", "").alias("loss"), F.size("turns").alias("n"),
        F.char_length("text").cast("bigint").alias("chars"))
    joined = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    total = lambda field: F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + r[field])
    return (
        read.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select(
            "conv_id", total("n").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
            F.char_length(joined("loss")).cast("bigint").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
            total("chars").alias("formatted_chars"))
    )
