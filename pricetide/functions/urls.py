"""Links: storage paths, redirectors, default images, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.keys import query_param, text_or_empty

# Image proxy host, redirector hosts, placeholder tokens.
IMAGE_PROXY_HOST = "wsrv.nl"
REDIRECT_URL_HOST = "link.gamma.example"
REDIRECT_BASE64_HOST = "s.alpha.example"
BLOCKED_IMAGE_TOKENS = ["transparent.", "blank.", "noimage", "no_image", "spacer."]
BLOCKED_IMAGE_BY_SOURCE = {"delta": r"board_logo\.png", "gamma": r"/cache/thumb/"}
# Title prefixes of stores with a curated picture, in rule order.
DEFAULT_IMAGE_RULES = [
    ("naver", r"(?i)^\[\s*네이버(?:\s*페이)?\s*\]", "defaults/naver-thumb-v1.webp", "defaults/naver-detail640-v1.webp"),
    ("gmarket", r"(?i)^\[\s*(?:지마켓|g마켓)\s*\]", "defaults/gmarket-thumb-v1.webp",
     "defaults/gmarket-detail640-v1.webp"),
    ("ali", r"(?i)^\[\s*알리\s*\]", "defaults/ali-thumb-v1.webp", "defaults/ali-detail640-v1.webp"),
    ("stove", r"(?i)^\[\s*스토브\s*\]", "defaults/stove-thumb-v1.webp", "defaults/stove-detail640-v1.webp"),
]


def url_host(url: Column) -> Column:
    """Lower-case host without port; '' when the text is no absolute URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def storage_path(url: Column, prefix: str) -> Column:
    """object path below the public prefix; image-proxy links are unwrapped first; else ''."""
    clean = text_or_empty(url)
    inner = F.coalesce(F.try_url_decode(query_param(clean, "url")), F.lit(""))
    inner = F.when((inner == "") | inner.rlike(r"^https?://"), inner).otherwise(F.concat(F.lit("https://"), inner))
    target = F.when(url_host(clean) == IMAGE_PROXY_HOST, inner).otherwise(clean)
    rest = F.substring(target, len(prefix) + 1, 1 << 30)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(target.startswith(prefix), F.regexp_replace(rest, r"^/+", "")).otherwise(F.lit(""))


def default_image_key(title: Column, img: Column, rules=DEFAULT_IMAGE_RULES) -> Column:
    """first store rule whose prefix opens the title of a row without picture; else ''."""
    out = F.lit("")
    for name, pattern, _, _ in reversed(rules):
        out = F.when(F.trim(F.coalesce(title, F.lit(""))).rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(text_or_empty(img) == "", out).otherwise(F.lit(""))


def default_image(title: Column, img: Column, prefix: str, detail: bool = False, rules=DEFAULT_IMAGE_RULES) -> Column:
    """picture link, filled from the store rules where it is missing."""
    key = default_image_key(title, img, rules)
    out = text_or_empty(img)
    for name, _, thumb, full in rules:
        out = F.when(key == name, F.lit(prefix + (full if detail else thumb))).otherwise(out)
    return out


def outbound_link(url: Column) -> Column:
    """target behind a redirector (``url=`` parameter or base64 ``target=``); other links as they are."""
    clean = text_or_empty(url)
    plain = F.coalesce(F.try_url_decode(query_param(clean, "url")), F.lit(""))
    # A plus sign is a base64 digit here, not a blank; padding and other digits may be percent-coded.
    coded = F.try_url_decode(F.replace(query_param(clean, "target"), F.lit("+"), F.lit("%2B")))
    packed = F.regexp_replace(F.coalesce(coded, F.lit("")), r"=+$", "")
    missing = F.pmod(F.lit(4) - F.pmod(F.length(packed), F.lit(4)), F.lit(4))
    padded = F.concat(packed, F.repeat(F.lit("="), missing))
    decoded = F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), F.lit(""))
    return (
        F.when((url_host(clean) == REDIRECT_URL_HOST) & url_path(clean).startswith("/link.php") & (plain != ""), plain)
        .when((url_host(clean) == REDIRECT_BASE64_HOST) & (decoded != ""), decoded)
        .otherwise(clean)
    )


def video_key(url: Column) -> Column:
    """``youtube:<id>`` from watch, embed/shorts, short-link and thumbnail hosts; else ''."""
    host, path = url_host(F.trim(url)), url_path(F.trim(url))
    watch = F.when(path == "/watch", query_param(url, "v")).otherwise(
        F.regexp_extract(path, r"^/(?:embed|shorts)/([0-9A-Za-z_-]{6,})", 1))
    found = (
        F.when(host.isin("youtube.com", "www.youtube.com", "m.youtube.com"), watch)
        .when(host == "youtu.be", F.regexp_extract(path, r"^/*([^/]*)", 1))
        .when(host.isin("img.youtube.com", "i.ytimg.com") | host.rlike(r"^i\d+\.ytimg\.com$"),
              F.regexp_extract(path, r"^/vi(?:_webp)?/([0-9A-Za-z_-]{6,})/", 1))
        .otherwise(F.lit(""))
    )
    return F.when(found.rlike(r"^[0-9A-Za-z_-]{6,}$"), F.concat(F.lit("youtube:"), found)).otherwise(F.lit(""))


def blocked_image_candidate(source: Column, url: Column) -> Column:
    """Not a web link, a board's own placeholder, or a placeholder token."""
    low = F.lower(text_or_empty(url))
    out = ~low.startswith("http")
    for name, pattern in BLOCKED_IMAGE_BY_SOURCE.items():
        out = out | ((source == name) & low.rlike(pattern))
    for token in BLOCKED_IMAGE_TOKENS:
        out = out | low.contains(token)
    return F.coalesce(out, F.lit(True))


# Parts of links of pictures that do not show a post's content, for two boards.
BODY_IMAGE_TOKENS = {
    "beta": [
        "thumb_no_image", "no_image", "/assets/images/", "/level/", "/store/", "/homepage/real/themes/", "util_bt_", "emoticon",
        "avatar", "profile", "blank.", "transparent.",
    ],
    "alpha": [
        "logo", "blank.", "transparent.", "noimage", "no_image", "btn_", "icon", "emoticon", "avatar", "profile",
        "/images/main/", "/images/menu/", "/images/common/",
    ],
}


def blocked_body_image(source: Column, url: Column, tokens: dict[str, list[str]] = BODY_IMAGE_TOKENS) -> Column:
    """P15, pictures inside a post: not a web link, or a part its board's list names. Boards without a list block nothing more."""
    low = F.lower(text_or_empty(url))
    out = ~low.startswith("http")
    for name, parts in tokens.items():
        for part in parts:
            out = out | ((source == name) & low.contains(part))
    return F.coalesce(out, F.lit(True))


# The size notations found in picture links (width group, height group).
URL_SIZE_PATTERNS = [
    (r"(?i)(?<!\d)(\d{2,4})x(\d{2,4})(?!\d)", 1, 2),
    (r"(?<!\d)(\d{2,4})_(\d{2,4})(?!\d)", 1, 2),
    (r"(?i)[?&](?:w|width)=(\d{2,4}).*?[?&](?:h|height)=(\d{2,4})", 1, 2),
    (r"(?i)[?&](?:h|height)=(\d{2,4}).*?[?&](?:w|width)=(\d{2,4})", 1, 2),
]


def image_size_from_url(url: Column) -> tuple[Column, Column]:
    """(width, height) written into a link, first notation that fits; nulls when none does."""
    def pick(group: int) -> Column:
        return F.coalesce(*[
            F.nullif(F.regexp_extract(url, p, g[group]), F.lit("")).cast("int")
            for p, *g in URL_SIZE_PATTERNS
        ])
    return pick(0), pick(1)


def too_small_image(width: Column, height: Column, url: Column, limit: int = 100) -> Column:
    """Either side at most 100 px; the tag's size counts first, then the link's."""
    url_w, url_h = image_size_from_url(url)
    w = F.coalesce(F.nullif(width, F.lit(0)), url_w)
    h = F.coalesce(F.nullif(height, F.lit(0)), url_h)
    return F.coalesce((w > 0) & (w <= limit), F.lit(False)) | F.coalesce((h > 0) & (h <= limit), F.lit(False))
