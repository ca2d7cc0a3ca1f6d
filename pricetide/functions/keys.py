"""Identity of a deal: post ids, canonical links and the key families."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoardRule:
    """How one board's links carry the post id, and the link form every variant folds into."""

    query_key: str = ""
    path_pattern: str = ""
    canonical: str = ""
    read_tag: str = ""
    read_query_key: str = ""
    read_path_pattern: str = ""


# Example boards, one for each way a link can carry the post id; a caller passes rules of its own.
BOARD_RULES = {
    "alpha": BoardRule(query_key="no", read_tag="no", read_query_key="no"),
    "beta": BoardRule(
        path_pattern=r"/views/([0-9]+)", canonical="https://beta.example/board/sale/views/{id}",
        read_tag="view", read_path_pattern=r"/views/([0-9]+)"),
    "gamma": BoardRule(
        query_key="doc", path_pattern=r"gamma\.example/(?:view/)?([0-9]+)",
        canonical="https://m.gamma.example/?board=deals&doc={id}",
        read_tag="doc", read_query_key="doc", read_path_pattern=r"gamma\.example/([0-9]+)"),
    "delta": BoardRule(
        path_pattern=r"/read/([0-9]+)", canonical="https://m.delta.example/board/20/read/{id}",
        read_tag="read", read_path_pattern=r"/read/([0-9]+)"),
}
FEED_SOURCES = ["alpha", "beta", "gamma", "delta"]


def text_or_empty(col: Column) -> Column:
    """Null and blank are the same everywhere in the feed model."""
    return F.coalesce(F.trim(col.cast("string")), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.when(text_or_empty(c) != "", F.trim(c.cast("string"))) for c in cols], F.lit(""))


def query_param(url: Column, key: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{key}=([^&#]+)", 1)


def _digits_only(col: Column) -> Column:
    return F.regexp_extract(col, r"^([0-9]+)", 1)


def extract_post_id(source: Column, link: Column, rules: dict[str, BoardRule] = BOARD_RULES) -> Column:
    """post id by board rule; '' when the link carries none."""
    out = F.lit("")
    for name, rule in rules.items():
        found = []
        if rule.query_key:
            found.append(F.trim(query_param(F.trim(link), rule.query_key)))
        if rule.path_pattern:
            found.append(F.regexp_extract(F.trim(link), rule.path_pattern, 1))
        out = F.when(F.trim(source) == name, first_non_blank(*found)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def post_id_or_fallback(source: Column, link: Column, rules: dict[str, BoardRule] = BOARD_RULES) -> Column:
    """post id, else a short digest of the link."""
    post_id = extract_post_id(source, link, rules)
    clean = text_or_empty(link)
    digest = F.concat(F.lit("link:"), F.substring(F.sha1(clean), 1, 12))
    return F.when(post_id != "", post_id).when(clean != "", digest).otherwise(F.lit(""))


def canonical_link(
    source: Column, link: Column, rules: dict[str, BoardRule] = BOARD_RULES, post_id: Column | None = None
) -> Column:
    """one link per post. Boards without a template keep scheme, host, path and the two id parameters.

    A caller that has the post id as a column already passes it, which keeps the expression small.
    """
    clean = text_or_empty(link)
    post_id = extract_post_id(source, clean, rules) if post_id is None else post_id
    out = clean
    for name, rule in rules.items():
        if rule.canonical:
            before, after = rule.canonical.split("{id}")
            rebuilt = F.concat(F.lit(before), post_id, F.lit(after))
        else:
            board = F.coalesce(F.nullif(query_param(clean, "id"), F.lit("")), F.lit(name))
            rebuilt = F.concat(
                F.regexp_replace(clean, r"[?#].*$", ""), F.lit("?id="), board,
                F.lit(f"&{rule.query_key}="), post_id)
        out = F.when((F.trim(source) == name) & (post_id != ""), rebuilt).otherwise(out)
    return out


def canonical_url(url: Column, keep: tuple[str, ...] = ()) -> Column:
    """F3, generic form: https, no fragment, no paging or tracking parameters, no trailing slash."""
    base = F.regexp_replace(F.regexp_replace(text_or_empty(url), r"[?#].*$", ""), r"^http://", "https://")
    base = F.regexp_replace(base, r"/+$", "")
    kept = [
        F.when(query_param(url, k) != "", F.concat(F.lit(f"{k}="), query_param(url, k))) for k in keep
    ]
    if not kept:
        return base
    tail = F.concat_ws("&", *kept)
    return F.when(tail != "", F.concat(base, F.lit("?"), tail)).otherwise(base)


def sync_key(
    source: Column, post_id: Column, link: Column, rules: dict[str, BoardRule] = BOARD_RULES
) -> Column:
    """write-side identity ``source::post::id`` else ``source::link::url``."""
    src = text_or_empty(source)
    pid = F.coalesce(F.nullif(text_or_empty(post_id), F.lit("")), post_id_or_fallback(src, link, rules))
    return F.when((src != "") & (pid != ""), F.concat_ws("::", src, F.lit("post"), pid)).otherwise(
        F.concat_ws("::", src, F.lit("link"), F.coalesce(link, F.lit("")))
    )


def legacy_key(source: Column, link: Column) -> Column:
    """second look-up key ``source::url``."""
    return F.concat_ws("::", F.coalesce(source, F.lit("")), F.coalesce(link, F.lit("")))


def canonical_feed_key(
    source: Column, post_id: Column, link: Column, rules: dict[str, BoardRule] = BOARD_RULES
) -> Column:
    """read-side identity ``source::post:id`` / ``::no:`` / ``::doc:`` / ``::view:`` / ``::read:``."""
    src = F.coalesce(F.nullif(text_or_empty(source), F.lit("")), F.lit("feed"))
    url = F.coalesce(link, F.lit(""))
    out = F.concat_ws("::", src, url)
    for name, rule in rules.items():
        if not rule.read_tag:
            continue
        found = []
        if rule.read_query_key:
            found.append(F.regexp_extract(url, rf"[?&]{rule.read_query_key}=([0-9]+)", 1))
        if rule.read_path_pattern:
            found.append(F.regexp_extract(url, rule.read_path_pattern, 1))
        read_id = first_non_blank(*found)
        out = F.when(
            (src == name) & (read_id != ""),
            F.concat(src, F.lit(f"::{rule.read_tag}:"), read_id),
        ).otherwise(out)
    pid = text_or_empty(post_id)
    return F.when(pid != "", F.concat(src, F.lit("::post:"), pid)).otherwise(out)


def deal_key(link: Column, deal_id: Column, title: Column, date: Column) -> Column:
    """favourites key: the link, else ``id:<id>:<date>``, else ``title:<title>:<date>``."""
    day = text_or_empty(date)
    return (
        F.when(text_or_empty(link) != "", F.trim(link))
        .when(text_or_empty(deal_id) != "", F.concat_ws(":", F.lit("id"), text_or_empty(deal_id), day))
        .otherwise(F.concat_ws(":", F.lit("title"), text_or_empty(title), day))
    )


def deal_id(source: Column, link: Column, row: Column) -> Column:
    """digest of ``source::link``, else of the row as JSON. ``row`` is a struct column."""
    src, url = text_or_empty(source), text_or_empty(link)
    return F.when((src != "") & (url != ""), F.sha1(F.concat_ws("::", src, url))).otherwise(F.sha1(F.to_json(row)))


def subscription_id(uid: Column, term: Column) -> Column:
    """index key of one user's term."""
    return F.sha1(F.concat_ws("::", uid.cast("string"), term))


def user_keyword_id(term: Column) -> Column:
    """key of a term below its user."""
    return F.substring(F.sha1(term), 1, 24)


def clean_string(col: Column, max_len: int) -> Column:
    """trim and cut to a field's declared length."""
    return F.substring(text_or_empty(col), 1, max_len)


def normalize_nickname(col: Column) -> Column:
    """single spaces, at most 24 characters."""
    return F.substring(F.regexp_replace(text_or_empty(col), r"\s+", " "), 1, 24)


def user_key(provider: Column, provider_id: Column, email: Column) -> Column:
    """``provider:id``, else ``email:<lower>``, else ''."""
    named = (text_or_empty(provider) != "") & (text_or_empty(provider_id) != "")
    return (
        F.when(named, F.concat_ws(":", provider, provider_id))
        .when(text_or_empty(email) != "", F.concat(F.lit("email:"), F.lower(email)))
        .otherwise(F.lit(""))
    )


def normalize_display_mode(col: Column) -> Column:
    """F32: standalone / webview / browser."""
    mode = F.lower(text_or_empty(col))
    return (
        F.when(mode.isin("standalone", "fullscreen", "minimal-ui"), F.lit("standalone"))
        .when(mode == "webview", F.lit("webview"))
        .otherwise(F.lit("browser"))
    )


def normalize_installation_id(col: Column) -> Column:
    """F32: well-formed installation ids only."""
    clean = text_or_empty(col)
    return F.when(clean.rlike(r"^[a-zA-Z0-9_-]{16,120}$"), clean).otherwise(F.lit(""))
