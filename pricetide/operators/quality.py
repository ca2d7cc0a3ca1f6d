"""Comment quality signals."""

from __future__ import annotations

from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.keys import text_or_empty

# Comment keywords, weights and limits, parser version.
POSITIVE_KEYWORDS = ["역대가", "역대급", "대박급", "삽니다", "사야겠네요", "감사합니다", "고맙습니다"]
NEGATIVE_KEYWORDS = [
    "바이럴업체", "바이럴", "업체", "업자", "비싸다", "비싸네요", "비싸네", "비쌈", "안사요", "안 사요", "응 안사", "응 안 사",
]
POSITIVE_WEIGHT, NEGATIVE_WEIGHT = 2, 8
SCORE_MIN, SCORE_MAX = -60, 16
PARSER_VERSION = 2


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Hits of every keyword counted on its own, so a keyword inside another counts for both."""
    # Letters, digits, blanks and Hangul only ever occur in keywords; escape anything else a caller adds.
    counts = [F.regexp_count(text, F.lit("(?i)" + re.sub(r"([^\w\s])", r"\\\1", k))) for k in keywords]
    return reduce(lambda a, b: a + b, counts)


def comment_quality(
    df: DataFrame, text: str, positive: list[str] = POSITIVE_KEYWORDS, negative: list[str] = NEGATIVE_KEYWORDS
) -> DataFrame:
    """M6: positive and negative keyword counts and the clamped score of a plain text column."""
    plain = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("positive_count", keyword_hits(plain, positive)).withColumn(
        "negative_count", keyword_hits(plain, negative))
    score = F.col("positive_count") * POSITIVE_WEIGHT - F.col("negative_count") * NEGATIVE_WEIGHT
    return out.withColumn("score", F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), score)))


def parser_version_gate(df: DataFrame, version_col: str, signals: list[str], version: int = PARSER_VERSION) -> DataFrame:
    """X11: signals written by an older parser count as 0; the row is stamped with the current version."""
    current = F.coalesce(F.col(version_col), F.lit(0)) >= version
    for c in signals:
        df = df.withColumn(c, F.when(current, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)))
    return df.withColumn(version_col, F.lit(version))


def detail_reusable(desc: Column, buy_link: Column, parser_version: Column, version: int = PARSER_VERSION) -> Column:
    """A cached parse can be kept: link and text present, and either the current parser wrote it
    or the text holds at least two word characters beyond links and the shop line."""
    plain = F.regexp_replace(F.coalesce(desc, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    shop_line = plain.rlike(r"(?i)^쇼핑몰\s*:.*?/\s*배송\s*:.*$")
    words = F.regexp_replace(F.regexp_replace(plain, r"(?i)https?://[^\s<]+", " "), r"(?U)[\W_]+", "")
    filled = (text_or_empty(buy_link) != "") & (text_or_empty(desc) != "")
    current = F.coalesce(parser_version, F.lit(0)) >= version
    return filled & (current | (~shop_line & (F.char_length(words) >= 2)))


def detail_dated(registered_at: Column, title: Column) -> Column:
    """X10, board without a text field: title and registration time present."""
    return (text_or_empty(title) != "") & registered_at.isNotNull()
