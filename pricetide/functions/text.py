"""Text normalisation and embedded markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too broad for a keyword alert.
BROAD_KEYWORDS = [
    "무료", "배송", "쿠폰", "특가", "할인", "행사", "이벤트", "카드", "포인트", "세일", "핫딜", "딜", "원", "가격",
    "구매", "예약", "정가", "오늘", "추천",
]
# Board categories.
BOARD_CATEGORIES = ["tips", "mydeals"]

# A date closing a title, and a link.
DATE_SUFFIX = r"\s*[\[(]?(?:20\d{6}|20\d{2}[./-]\d{1,2}[./-]\d{1,2})[\])]?$"
URL_PATTERN = r"(?i)https?://[^\s)]+"

# The markers are written by this library itself, so the tag names are parameters.
REPLY_TAG = "reply-to"
CATEGORY_TAG = "category"

# Words of a phrase that may be a keyword, and its length.
PHRASE_WORDS, PHRASE_MIN, PHRASE_MAX = 3, 2, 20

# What a pattern's \s is, and what parts words besides; one class is one pass over a text.
SPACES = " \t\n\x0b\f\r"
WORD_BREAK = r"[ \t\n\x0B\f\r#*_`~>|\[\](){},.!?:;'\"/\\+-]+"
# The longest that a date can be with its brackets and the line end behind it.
DATE_REACH = 14


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: inside a higher-order function an outer
    expression would be evaluated again for every element."""
    return F.transform(F.array(value), use)[0]


def _replaced_if(may, text: Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` for the texts that ``may`` match; a pattern is tried at every character, ``may`` is cheap."""
    return bind(text, lambda t: F.when(may(t), F.regexp_replace(t, pattern, by)).otherwise(t))


def stripped(text: Column) -> Column:
    """Without the white space at both ends. Before a last line end that is no white space a pattern's ``$`` holds as well."""
    def of(t: Column) -> Column:
        odd = F.right(t, F.lit(1)).isin("\u0085", "\u2028", "\u2029")
        return F.when(odd, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.trim(t, F.lit(SPACES)))
    return bind(text, of)


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def title_key(col: Column) -> Column:
    """Lower-case title with single spaces."""
    return F.lower(collapse(col))


def normalize_text(*cols: Column) -> Column:
    """mark-up dropped, lower case, letters and digits of any script kept, single spaces."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    parts = [F.lower(_replaced_if(lambda x: x.contains("<"), t, r"(?s)<!--.*?-->|<[^>]*>", " ")) for t in texts]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"[^\p{L}\p{N}]+", " "))


def normalize_term(col: Column) -> Column:
    """keyword form; punctuation stays."""
    return F.lower(collapse(col))


def candidate_terms(normalized: Column, max_n: int = PHRASE_WORDS, min_len: int = PHRASE_MIN, max_len: int = PHRASE_MAX) -> Column:
    """F8: distinct 1..n-word phrases of a normalised text, 2 to 20 characters long."""
    def phrases(words: Column) -> Column:
        # words is a bound value here, so a long text is split once and not once per position.
        def of_length(n: int) -> Column:
            heads = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
            return F.transform(
                heads, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))

        grams = F.flatten(F.array(words, *[of_length(n) for n in range(2, max_n + 1)]))
        kept = F.filter(grams, lambda p: F.char_length(p).between(min_len, max_len))
        return F.array_distinct(kept)

    return bind(F.filter(F.split(normalized, " "), lambda w: w != ""), phrases)


def broad_keyword(term: Column, stop: list[str] = BROAD_KEYWORDS) -> Column:
    """On the stop list or at most two characters."""
    clean = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    return clean.isin(stop) | (F.char_length(clean) <= 2)


def valid_keyword_length(term: Column, low: int = 2, high: int = 20) -> Column:
    """Length bounds after normalisation."""
    return F.char_length(normalize_term(term)).between(low, high)


def clean_comment_id(col: Column) -> Column:
    """identifier characters only, at most 120."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), r"[^a-zA-Z0-9:_-]", ""), 1, 120)


def reply_parent(body: Column, tag: str = REPLY_TAG) -> Column:
    """parent id from a leading ``<!--tag:id-->`` marker; '' when there is none."""
    return clean_comment_id(F.regexp_extract(F.coalesce(body, F.lit("")), rf"^<!--{tag}:([^>]+)-->", 1))


def reply_body(body: Column, tag: str = REPLY_TAG) -> Column:
    """comment text without its marker."""
    return F.regexp_replace(F.coalesce(body, F.lit("")), rf"^<!--{tag}:[^>]+-->\n?", "")


def with_reply_marker(body: Column, parent_id: Column, tag: str = REPLY_TAG) -> Column:
    parent = clean_comment_id(parent_id)
    return F.when(parent != "", F.concat(F.lit(f"<!--{tag}:"), parent, F.lit("-->\n"), body)).otherwise(body)


def board_category(body: Column, tag: str = CATEGORY_TAG) -> Column:
    """category from the leading marker; the first category when absent."""
    pattern = rf"^<!--{tag}:({'|'.join(BOARD_CATEGORIES)})-->"
    found = F.regexp_extract(F.coalesce(body, F.lit("")), pattern, 1)
    return F.when(found != "", found).otherwise(F.lit(BOARD_CATEGORIES[0]))


def board_body(body: Column, tag: str = CATEGORY_TAG) -> Column:
    """text without the category marker and the line breaks after it."""
    return _replaced_if(lambda t: t.startswith("<!--"), F.coalesce(body, F.lit("")), rf"^<!--{tag}:(?:{'|'.join(BOARD_CATEGORIES)})-->\n*", "")


def with_board_marker(body: Column, category: Column, tag: str = CATEGORY_TAG) -> Column:
    """body with exactly one marker; unknown categories become the default."""
    clean = F.trim(F.coalesce(category, F.lit("")))
    known = F.when(clean.isin(BOARD_CATEGORIES), clean).otherwise(F.lit(BOARD_CATEGORIES[0]))
    return F.concat(F.lit(f"<!--{tag}:"), known, F.lit("-->\n"), board_body(body, tag))


def plain_body(col: Column) -> Column:
    """Board body without the category marker and the reference section."""
    text = _replaced_if(lambda t: t.contains("\n## 참고 자료"), stripped(board_body(col)), r"(?s)\n## 참고 자료\s*\n.*$", "")
    return stripped(text)


def _unlinked(col: Column) -> Column:
    """F28 up to the words: marker, reference section, trailing date and links removed; lower."""
    text = _replaced_if(lambda t: F.right(t, F.lit(DATE_REACH)).rlike(DATE_SUFFIX), F.lower(plain_body(col)), DATE_SUFFIX, "")
    return _replaced_if(lambda t: t.contains("http"), text, URL_PATTERN, " ")


def similarity_text(col: Column) -> Column:
    """marker, reference section, trailing date, links and punctuation removed; lower; single spaces."""
    return F.trim(F.regexp_replace(_unlinked(col), WORD_BREAK, " "))


def compact_text(col: Column) -> Column:
    """``similarity_text`` without its spaces."""
    return F.regexp_replace(_unlinked(col), WORD_BREAK, "")


def similarity_tokens(normalized: Column) -> Column:
    """Distinct words of two or more ASCII letters, digits or Hangul syllables."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"([0-9a-z가-힣]{2,})"), 1))


def similarity_words(col: Column) -> Column:
    """``similarity_tokens`` of ``similarity_text``: what that turns into spaces is no part of a word, so it stays as it is."""
    return similarity_tokens(_unlinked(col))
