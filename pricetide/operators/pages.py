"""Extraction over a table of raw pages.

Everything is a column expression except entity decoding and the two nesting-aware walks, which are
Arrow pandas UDFs over single page texts.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.keys import text_or_empty
from pricetide.functions.times import parse_iso
from pricetide.functions.urls import too_small_image, url_host

# Challenge-page phrases, comment container marks, low-quality picture mark.
BLOCKED_PHRASES = ["just a moment", "forbidden", "access denied", "봇 확인", "확인 안내"]
COMMENT_ROOT = r"(?i)(?:^|[\s_-])(?:comment|comments|reply|replies|memo|fdb|fdb-lst|fdb_lst)(?:$|[\s_-])"
COMMENT_NON_BODY = r"(?i)(?:count|counter|button|form|write|input|pagination|paging|more|header|title|toggle)"
LOW_QUALITY_IMAGE = r"(?i)/cache/thumb/"
BASIC_ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def decode_basic(col: Column) -> Column:
    for entity, char in BASIC_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return F.trim(col)


def meta_content(html: Column, key: str, attr: str = "property") -> Column:
    """Content of one meta tag, with the attributes in either order; '' when absent."""
    keyed, content = rf"""{attr}=["']{key}["']""", r"""content=["']([^"']+)["']"""
    first = F.regexp_extract(html, rf"(?i)<meta[^>]*{keyed}[^>]*{content}[^>]*>", 1)
    other = F.regexp_extract(html, rf"(?i)<meta[^>]*{content}[^>]*{keyed}[^>]*>", 1)
    return decode_basic(F.when(first != "", first).otherwise(other))


def _first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def absolute_url(link: Column, base: Column) -> Column:
    """Link resolved against its page; '' for a blank link."""
    clean = text_or_empty(link)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(clean == "", F.lit(""))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), clean)
        .when(clean.startswith("//"), F.concat(scheme, clean))
        .when(clean.startswith("/"), F.concat(root, clean))
        .otherwise(F.concat(folder, clean))
    )


def extract_meta(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, description and picture link of every page."""
    h = F.col(html)
    title = _first_filled(
        meta_content(h, "og:title"), meta_content(h, "twitter:title", "name"),
        decode_basic(F.regexp_extract(h, r"(?i)<title[^>]*>([^<]+)</title>", 1)))
    description = _first_filled(
        meta_content(h, "og:description"), meta_content(h, "twitter:description", "name"),
        meta_content(h, "description", "name"))
    tagged = _first_filled(meta_content(h, "og:image"), meta_content(h, "twitter:image", "name"))
    plain = F.filter(
        F.regexp_extract_all(h, F.lit(r"""(?i)<img[^>]*\bsrc=["']([^"']+)["'][^>]*>"""), 1),
        lambda s: (F.trim(s) != "") & ~s.rlike(r"(?i)\.svg($|\?)"))
    picture = F.coalesce(F.nullif(tagged, F.lit("")), F.get(plain, F.lit(0)), F.lit(""))
    return (
        pages.withColumn("title", title).withColumn("description", description)
        .withColumn("image", absolute_url(picture, F.col(url)))
    )


def is_useful_meta(title: Column, description: Column, image: Column) -> Column:
    """No challenge phrase in title or description, and at least one of the three filled."""
    out = F.lit(False)
    for c in (title, description, image):
        out = out | (text_or_empty(c) != "")
    for phrase in BLOCKED_PHRASES:
        for c in (title, description):
            out = out & ~F.lower(F.regexp_replace(text_or_empty(c), r"\s+", " ")).contains(phrase)
    return out


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All named and numeric character references."""
    return text.map(html_lib.unescape, na_action="ignore")


# Elements that hold no readable text, and those that begin and end a line.
EMBEDDED = "script|style|noscript|iframe|object|svg|canvas"
BLOCKS = "p|div|section|article|h[1-6]|li|blockquote|tr|table"


def strip_tags(html: Column) -> Column:
    """X3 up to the entities: comments and embedded parts dropped, breaks and the tags of blocks as new lines."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, rf"(?is)<({EMBEDDED})\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)<br\s*/?>|</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def html_to_text(html: Column, keep_lines: bool = False) -> Column:
    """Readable text; only texts that hold a character reference go through the Python decoder."""
    stripped = strip_tags(html)
    text = F.when(stripped.contains("&"), unescape(F.when(stripped.contains("&"), stripped))).otherwise(stripped)
    if not keep_lines:
        return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n\n"), r"[ \t]+", " ")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# A comment, a script or style with its content, or a tag with its name and attributes.
_MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)>", re.I | re.S)
_MARKS = re.compile(r"""\b(?:id|class)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINER, _OTHER = re.compile(COMMENT_ROOT), re.compile(COMMENT_NON_BODY)
# Elements that have no content and no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _comment_parts(page: str) -> list[str]:
    """Pieces of text inside comment containers.

    ``path`` names the open elements from the container inwards. An end tag closes the innermost element of its name and
    whatever was left open inside it; one without an element is ignored.
    """
    found, path, at = [], [], 0
    for tag in _MARKUP.finditer(page):
        if path and "template" not in path and tag.start() > at:
            found.append(html_lib.unescape(page[at : tag.start()]))
        at = tag.end()
        name = (tag["name"] or "").lower()
        if tag["close"]:
            if name in path:
                del path[len(path) - 1 - path[::-1].index(name) :]
        elif name and name not in VOID and not tag["attrs"].endswith("/"):
            marks = "" if path else " ".join("".join(m) for m in _MARKS.findall(tag["attrs"])).lower()
            if path or (not _OTHER.search(marks) and _CONTAINER.search(marks.replace("__", "_"))):
                path.append(name)
    if path and "template" not in path:
        found.append(html_lib.unescape(page[at:]))
    return found


@F.pandas_udf(T.StringType())
def comment_section_text(html: pd.Series) -> pd.Series:
    """Text inside containers whose id or class marks comments; '' when a page has none."""
    return html.map(lambda page: " ".join(" ".join(_comment_parts(page or "")).split()))


class _Container:
    """A container met on the way: where it starts and ends, and the visible characters before either place."""

    def __init__(self, name: str, start: int, seen: int, marked: bool):
        self.name, self.start, self.marked = name, start, marked
        self.before, self.end, self.after = seen, None, None


CONTAINER = re.compile(r"(?is)<(/?)(div|section|article)\b([^>]*)>")
ANY_TAG = re.compile(r"<[^>]*>")


def _containers(page: str, marked) -> list[_Container]:
    """Divs, sections and articles of a page in the order they start, from one pass with a stack per tag name.

    An end tag closes the innermost open container of its name; what stays open reaches to the end of the page.
    """
    met, at, seen = [], 0, 0
    stacks: dict[str, list[_Container]] = {"div": [], "section": [], "article": []}
    for token in CONTAINER.finditer(page):
        seen += len("".join(ANY_TAG.sub(" ", page[at : token.start()]).split()))
        at = token.end()
        stack = stacks[token.group(2).lower()]
        if token.group(1):
            if stack:
                closed = stack.pop()
                closed.end, closed.after = token.end(), seen
        elif not token.group(3).endswith("/"):
            met.append(_Container(token.group(2).lower(), token.start(), seen, marked(token.group(3))))
            stack.append(met[-1])
    seen += len("".join(ANY_TAG.sub(" ", page[at:]).split()))
    for left in met:
        if left.end is None:
            left.end, left.after = len(page), seen
    return met


def content_chunk(html: Column, marker: str, scope: str = "article") -> Column:
    """The balanced div or section whose class has the marker word: the first one inside the first ``scope`` container,
    else the one with the most visible characters (the first of equals). '' when there is none.

    A page is read once, whatever its nesting.
    """
    class_mark = re.compile(rf"""(?i)\bclass\s*=\s*["'][^"']*\b{marker}\b""")

    @F.pandas_udf(T.StringType())
    def walk(pages: pd.Series) -> pd.Series:
        def one(page):
            page = page or ""
            met = _containers(page, lambda attributes: class_mark.search(attributes) is not None)
            found = [c for c in met if c.marked and c.name != "article"]
            around = next((c for c in met if c.name == scope), None)
            inside = [c for c in found if around and around.start < c.start < around.end]
            if inside:
                return page[inside[0].start : min(inside[0].end, around.end)]
            best = max(found, key=lambda c: c.after - c.before, default=None)
            return page[best.start : best.end] if best else ""

        return pages.map(one)

    return walk(html)


LD_JSON = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _ld_nodes(html: Column) -> Column:
    """The page's structured-data nodes as array<variant>, in order, lists and ``@graph`` flattened.

    Every script is parsed once; what is read from a node afterwards is a look-up in its binary form. A script that is no
    JSON has no nodes.
    """
    none = F.array().cast("array<variant>")
    parsed = F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD_JSON), 1), lambda s: F.try_parse_json(F.trim(s))), lambda v: v.isNotNull())
    listed = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.flatten(F.transform(listed, lambda n: F.concat(F.array(n), F.coalesce(F.try_variant_get(n, "$['@graph']", "array<variant>"), none))))


def _text_of(node: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(node, path, "string") for path in paths])


def _offer_of(node: Column) -> Column:
    offer = _text_of(node, "$.offers.url", "$.offers[0].url")
    return F.when(offer.rlike(r"^https?://"), offer)


def json_ld_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per structured-data node (lists and ``@graph`` flattened): type, date, offer link.

    Rows keep the page's columns except the html; malformed scripts give no rows.
    """
    rows = pages.withColumn("_n", F.explode_outer(_ld_nodes(F.col(html)))).drop(html).where("_n IS NOT NULL")
    node = F.col("_n")
    return rows.select(
        *[c for c in rows.columns if c != "_n"], _text_of(node, "$['@type']").alias("node_type"),
        _text_of(node, "$.datePublished").alias("date_published"), _offer_of(node).alias("offer_url"))


def _ld_first(html: Column, node_type: str, pick) -> Column:
    """First non-null ``pick(node)`` over the page's structured nodes of one type, as an expression."""
    typed = F.filter(_ld_nodes(html), lambda n: _text_of(n, "$['@type']") == node_type)
    return F.get(F.array_compact(F.transform(typed, pick)), F.lit(0))


def published_at(html: Column, list_date: Column, now: Column, fallback: Column | None = None) -> Column:
    """Post time: structured date with an offset, else the first written timestamp on the list date
    (Seoul clock), neither more than five minutes ahead of now; else the fallback, else the list date."""
    limit = now + F.expr("INTERVAL 5 MINUTES")

    def structured(node: Column) -> Column:
        text = _text_of(node, "$.datePublished")
        ts = F.when(text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), parse_iso(text))
        return F.when(ts <= limit, ts)

    stamps = F.regexp_extract_all(
        html, F.lit(r"(20[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}\s+[0-9]{2}:[0-9]{2})"), 1)
    iso = F.transform(stamps, lambda s: F.regexp_replace(
        F.regexp_replace(s, r"^(\d{4}).(\d{2}).(\d{2})\s+", "$1-$2-$3 "), r"$", ":00+09:00"))
    times = F.filter(
        F.transform(iso, lambda s: parse_iso(s)),
        lambda t: (t <= limit) & (list_date.isNull() | (
            F.to_date(F.from_utc_timestamp(t, "Asia/Seoul")) == list_date)))
    midnight = F.to_utc_timestamp(list_date.cast("timestamp"), "Asia/Seoul")
    last = midnight if fallback is None else F.coalesce(fallback, midnight)
    return F.coalesce(_ld_first(html, "DiscussionForumPosting", structured), F.get(times, F.lit(0)), last)


def first_outbound_link(html: Column, own_host: Column) -> Column:
    """Product offer in the structured data, else a labelled source link, else the first link to
    another host; '' when there is none."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    labelled = F.regexp_replace(F.regexp_extract(text, r"출처\s*[:：]\s*(https?://[^\s\"'<>]+)", 1), r"[).,;!?:]+$", "")
    links = F.regexp_extract_all(html, F.lit(r"""(?i)href=["'](https?://[^"']+)["']"""), 1)
    other = F.filter(links, lambda u: ~(
        (url_host(u) == own_host) | url_host(u).endswith(F.concat(F.lit("."), own_host))))
    return F.coalesce(
        _ld_first(html, "Product", _offer_of), F.nullif(labelled, F.lit("")),
        F.get(F.transform(other, lambda u: decode_basic(u)), F.lit(0)), F.lit(""))


def first_content_image(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """First acceptable picture of a page by position; a low-quality one only when no better exists."""
    tags = F.regexp_extract_all(
        F.col(html), F.lit(r"""(?i)<img[^>]+?(?:data-src|data-original|src)=["']([^"']+)["']"""), 1)
    found = pages.select(page_id, url, F.posexplode_outer(tags).alias("at", "src")).where("src IS NOT NULL")
    none = F.lit(None).cast("int")
    usable = (
        ~F.col("src").startswith("data:") & ~F.col("src").rlike(r"(?i)\.svg($|\?)|transparent\.|blank\.")
        & ~too_small_image(none, none, F.col("src")))
    low = F.col("src").rlike(LOW_QUALITY_IMAGE)
    best = found.where(usable).groupBy(page_id).agg(
        F.min_by(F.struct("src", url), F.struct(low.cast("int").alias("low"), F.col("at"))).alias("_b"))
    return best.select(page_id, absolute_url(F.col("_b.src"), F.col(f"_b.{url}")).alias("image"))


def image_size_from_tag(tag: Column) -> tuple[Column, Column]:
    """Width and height attributes (or style) of an img tag; null when not given."""
    def side(name: str) -> Column:
        attr = F.regexp_extract(tag, rf"""(?i)\b(?:data-)?{name}=["']?([0-9]{{1,5}})""", 1)
        style = F.regexp_extract(tag, rf"""(?i)\bstyle=["'][^"']*\b{name}\s*:\s*([0-9]{{1,5}})""", 1)
        return F.coalesce(F.nullif(attr, F.lit("")), F.nullif(style, F.lit(""))).cast("int")
    return side("width"), side("height")


def canonical_url_dedup(pages: DataFrame, canonical: Column, page_id: str = "page_id") -> DataFrame:
    """F3 and W-style dedup: first page per canonical link, with the number of its copies."""
    keyed = pages.withColumn("canonical", canonical)
    return keyed.groupBy("canonical").agg(
        F.min(page_id).alias("first_page_id"), F.count(F.lit(1)).alias("copies"))
