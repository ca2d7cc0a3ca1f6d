"""Reads: paging, top-k, favourites, comments, moderation, dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.keys import text_or_empty
from pricetide.functions.text import clean_comment_id, reply_body, reply_parent
from pricetide.functions.times import as_ts
from pricetide.operators import scale

# Paging and listing limits.
PAGE_DEFAULT, PAGE_MAX = 100, 600
# Microseconds of a day, a minute, a millisecond and one; a page is read once so many rows at most lie before it.
PAGE_WIDTHS, PAGE_ROWS = (86_400_000_000, 60_000_000, 1_000, 1), 10_000
API_PAGE_DEFAULT = 400
COMMENTS_PER_KEY = 100
REPORT_THRESHOLD = 5


def _present(df: DataFrame, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(c) for c in names if c in df.columns])


def sort_deals(items: DataFrame, pos: str = "pos") -> DataFrame:
    """Newest registration first; input order decides equal times."""
    return items.orderBy(_present(items, ("registered_at", "updated_at", "date")).desc(), F.col(pos).asc())


def clamp_limit(limit: int | None, default: int = PAGE_DEFAULT, top: int = PAGE_MAX) -> int:
    return max(1, min(int(limit or default), top))


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page with ``has_more`` and ``next_offset`` on every row.

    Catalyst turns order, offset and limit into a bounded top-k. The probe row beyond the page tells
    whether more follow.
    """
    size, start = clamp_limit(limit), max(0, int(offset))
    probe = scale.cut_lineage(df.orderBy(*order).offset(start).limit(size + 1))
    rows = probe.count()
    taken = min(rows, size)
    return probe.orderBy(*order).limit(size).withColumn("has_more", F.lit(rows > size)).withColumn(
        "next_offset", F.lit(start + taken).cast("bigint"))


def page_at(df: DataFrame, limit: int, offset: int, ts: str, row_id: str) -> DataFrame:
    """T2 at any depth: the rows of ``page`` ordered by ``ts``, then ``row_id``, both descending, null times last.

    Order statistics replace the skipping: rows are counted by day, the counts tell which days hold the page, and only
    those are counted by minute, and so on, until few rows lie before the page. Each round sends counts only, and its
    bounds are filters on the stored column, which reach the scan. Rows of one instant beyond ``PAGE_ROWS`` are the one
    case in which more of them meet.
    """
    size, rest = clamp_limit(limit), max(0, int(offset))
    start, at = rest, F.unix_micros(ts)
    inside, nulls = df.where(F.col(ts).isNotNull()), df.where(F.col(ts).isNull())
    for width in PAGE_WIDTHS:
        if rest <= PAGE_ROWS:
            break
        counts = inside.groupBy(F.floor(at / width).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0))  # at most a day's minutes, or a minute's milliseconds
        found = counts.withColumn("c", upto).agg(
            F.max(F.when(F.col("c") > rest, F.struct("b", (F.col("c") - F.col("n")).alias("before")))).alias("first"),
            F.max(F.when(F.col("c") > rest + size, F.col("b"))).alias("last"), F.min("b").alias("least"), F.max("c").alias("all")).first()
        if found["last"] is not None:  # the page ends before the rows without a time
            nulls = df.limit(0)
        if found["first"] is None:  # behind all rows with a time
            inside, rest = inside.limit(0), rest - (found["all"] or 0)
            break
        low = found["least"] if found["last"] is None else found["last"]
        inside = inside.where((F.col(ts) >= F.timestamp_micros(F.lit(low * width))) & (F.col(ts) < F.timestamp_micros(F.lit((found["first"]["b"] + 1) * width))))
        rest -= found["first"]["before"]
    order = [F.col(ts).desc_nulls_last(), F.col(row_id).desc()]
    probe = scale.cut_lineage(inside.unionByName(nulls).orderBy(*order).offset(rest).limit(size + 1))
    rows = probe.count()
    return probe.orderBy(*order).limit(size).withColumn("has_more", F.lit(rows > size)).withColumn("next_offset", F.lit(start + min(rows, size)).cast("bigint"))


def page_after(df: DataFrame, limit: int, ts: str, row_id: str, last_ts=None, last_id=None) -> DataFrame:
    """T2 for deep paging: rows after the last one seen, newest first, so no offset is skipped over."""
    if last_ts is not None:
        at = as_ts(last_ts)
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(row_id) < last_id)))
    return df.orderBy(F.col(ts).desc(), F.col(row_id).desc()).limit(clamp_limit(limit))


def filter_by_since(items: DataFrame, since: str | None) -> DataFrame:
    """Rows updated (else registered, else dated) after ``since``; no or a bad ``since`` keeps all."""
    if not since:
        return items
    at = F.lit(since).try_cast("timestamp")
    return items.where(at.isNull() | (_present(items, ("updated_at", "registered_at", "date")) > at))


def delta_page(df: DataFrame, since: str | None, limit: int, offset: int = 0, row_id: str = "id") -> DataFrame:
    """With ``since`` only later updates, newest update first; otherwise newest registration first."""
    if since:
        rows = df.where(F.col("updated_at") > F.lit(since).cast("timestamp"))
        return page(rows, limit, offset, F.col("updated_at").desc(), F.col(row_id).desc())
    return page(df, limit, offset, F.col("registered_at").desc(), F.col(row_id).desc())


def top_hot(deals: DataFrame, k: int = 10, row_id: str = "id") -> DataFrame:
    """T4: hottest deals; without a temperature the views count."""
    heat = F.coalesce(F.nullif(F.col("temperature"), F.lit(0)), F.col("views"), F.lit(0))
    return deals.withColumn("heat", heat).orderBy(F.col("heat").desc(), F.col(row_id).asc()).limit(k)


def recent(df: DataFrame, k: int = 8, created: str = "created_at", row_id: str = "id") -> DataFrame:
    """T5: the k newest rows."""
    return df.orderBy(F.col(created).desc(), F.col(row_id).desc()).limit(k)


def popular_order(deals: DataFrame) -> DataFrame:
    """Temperature first, then newest."""
    return deals.orderBy(F.col("temperature").desc(), F.col("registered_at").desc(), F.col("id").asc())


def search_filter(df: DataFrame, q: str, fields: list[str]) -> DataFrame:
    """Case-insensitive substring in any field; an empty query keeps all."""
    needle = (q or "").strip().lower()
    if not needle:
        return df
    hits = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(needle) for f in fields]
    return df.where(reduce(lambda a, b: a | b, hits))


def active_notices(notices: DataFrame) -> DataFrame:
    """Everything not explicitly unpublished."""
    return notices.where(F.coalesce(F.col("published"), F.lit(True)))


def favorites_join(deals: DataFrame, favorites: DataFrame, user_id=None) -> DataFrame:
    """Deals a user keeps; for all users the deal repeats per user. Pairs are unique first.

    A deal key kept by very many users is salted by user.
    """
    pairs = favorites.select("user_id", "deal_key").distinct()
    if user_id is not None:
        keys = pairs.where(F.col("user_id") == user_id).select("deal_key")
        return deals.join(keys, "deal_key", "left_semi")
    return scale.salted_join(pairs, deals, ["deal_key"], ["user_id"])


def comment_thread(comments: DataFrame) -> DataFrame:
    """Each comment beside its parent; an unknown parent leaves the comment at the top level."""
    parents = comments.select(F.col("id").alias("parent_id"), F.col("nickname").alias("parent_nickname"),
                              F.lit(True).alias("_known"))
    rows = comments.withColumn("parent_id", F.nullif(F.trim("parent_id"), F.lit("")))
    return scale.salted_join(rows, parents, ["parent_id"], ["id"], "left").withColumn(
        "is_reply", F.coalesce("_known", F.lit(False))).drop("_known")


def comment_depths(comments: DataFrame) -> DataFrame:
    """J16, full depth: (id, root_id, depth) by pointer doubling.

    Every round replaces a comment's ancestor by that ancestor's ancestor, so a thread of depth d takes
    log2(d) joins on the unique comment id instead of d steps of recursion. Comments whose parents form a cycle have the
    least id of the cycle as root: its parent is disregarded.
    """
    named = comments.select("id", F.nullif(F.trim("parent_id"), F.lit("")).alias("_parent"))
    known = named.select(F.col("id").alias("_parent"), F.lit(True).alias("_ok"))
    parents = scale.cut_lineage(
        scale.salted_join(named, known, ["_parent"], ["id"], "left").select("id", F.when(F.col("_ok"), F.col("_parent")).alias("_parent")))
    state = _climb(parents)
    endless = state.where("NOT done")
    if endless.limit(1).count():
        on_cycle = endless.select(F.col("root_id").alias("id")).distinct()
        heads = state.join(on_cycle, "id", "left_semi").select(F.col("least").alias("id")).distinct().withColumn("_head", F.lit(True))
        state = _climb(scale.cut_lineage(
            parents.join(heads, "id", "left").select("id", F.when(F.col("_head").isNull(), F.col("_parent")).alias("_parent"))))
    return state.select("id", "root_id", "depth")


def _climb(parents: DataFrame) -> DataFrame:
    """``id, root_id, depth, least, done`` once every comment has reached its root, or has climbed as many steps as there are
    comments: then it goes round a cycle, ``root_id`` is one of the cycle and ``least`` the least id on the way."""
    state = scale.cut_lineage(parents.select(
        "id", F.coalesce("_parent", "id").alias("root_id"), F.when(F.col("_parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.least("id", F.coalesce("_parent", "id")).alias("least"), F.col("_parent").isNull().alias("done")))
    steps, rows = 1, state.count()
    while steps <= rows and state.where("NOT done").limit(1).count():
        up = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        open_rows = state.where("NOT done").withColumn("_id", F.col("root_id"))
        climbed = scale.salted_join(open_rows, up, ["_id"], ["id"]).select(
            "id", F.col("_root_id").alias("root_id"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        state = scale.cut_lineage(state.where("done").unionByName(climbed))
        steps *= 2
    return state


def comments_for_keys(comments: DataFrame, keys: DataFrame, n: int = COMMENTS_PER_KEY, order: str = "created_at") -> DataFrame:
    """The n newest comments of each asked deal key, once per comment id (F23 markers lifted)."""
    asked = comments.join(keys.select("deal_key").distinct(), "deal_key", "left_semi")
    top = scale.keep_top(asked, ["deal_key"], n, F.col(order).desc(), F.col("id").desc())
    return scale.keep_one(top, ["id"], F.col(order).desc())


def lift_reply_marker(comments: DataFrame) -> DataFrame:
    """F23 on a table: ``parent_id`` column wins over the marker in the body."""
    given = clean_comment_id(F.col("parent_id")) if "parent_id" in comments.columns else F.lit("")
    return comments.withColumn(
        "parent_id", F.coalesce(F.nullif(given, F.lit("")), reply_parent(F.col("body")))
    ).withColumn("body", reply_body(F.col("body")))


def author_nickname(posts: DataFrame, profiles: DataFrame, default: str = "익명") -> DataFrame:
    """Profile nickname, else session name, else the given author, else the default."""
    named = profiles.select("user_key", "nickname").dropDuplicates(["user_key"])
    joined = scale.salted_join(posts, named, ["user_key"], ["id"], "left")
    parts = [F.when(text_or_empty(F.col(c)) != "", F.trim(c)) for c in ("nickname", "session_name", "author")]
    return joined.withColumn("author", F.coalesce(*parts, F.lit(default))).drop("nickname")


def report_threshold(reports: DataFrame, n: int = REPORT_THRESHOLD) -> DataFrame:
    """Pending reports per target and whether they are enough to hide it."""
    return reports.groupBy("target_id").agg(F.count_if(F.col("status") == "pending").alias("pending")).withColumn(
        "hidden", F.col("pending") >= n)


def dashboard_summary(
    deals: DataFrame, comments: DataFrame, users: DataFrame, posts: DataFrame, reports: DataFrame,
    notices: DataFrame, now: str | Column,
) -> DataFrame:
    """Exact totals in one row. Each table is aggregated to one row first; those are put together."""
    today = F.to_date(as_ts(now))
    one = [
        deals.agg(F.count(F.lit(1)).alias("total_deals"),
                  F.count_if(F.to_date("registered_at") == today).alias("today_deals")),
        comments.agg(F.count(F.lit(1)).alias("comments")),
        users.agg(F.count(F.lit(1)).alias("users")),
        posts.agg(F.count(F.lit(1)).alias("board_posts")),
        reports.agg(F.count_if(F.coalesce("status", F.lit("pending")) == "pending").alias("pending_reports")),
        active_notices(notices).agg(F.count(F.lit(1)).alias("active_notices")),
    ]
    return scale.beside(*one)


def top_candidates(rows: DataFrame, used: DataFrame, n: int = 10) -> DataFrame:
    """First n entries per channel, reused source keys dropped, one row per url, newest first."""
    first = scale.keep_top(rows, ["channel"], n, F.col("pos").asc())
    fresh = first.join(used.select("source_key").where("source_key <> ''").distinct(), "source_key", "left_anti")
    return scale.keep_one(fresh, ["url"], F.col("published_at").desc(), F.col("pos").asc()).orderBy(
        F.col("published_at").desc(), F.col("url").asc())
