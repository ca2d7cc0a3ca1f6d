"""Free-text prices and counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price vocabulary and number shapes.
UNKNOWN_PRICE = "가격 정보 확인"
FREE = "무료"
VARIES = "다양"
SPLIT_THOUSANDS = r"(?<!\d)(\d{1,3})\s{1,2}(\d{3})(\s*원)"
WON_AMOUNT = r"([0-9][0-9,]*\s*(?:만원대|천원대|원대|만원|천원|원))(?![가-힣A-Za-z])"
SYMBOL_AMOUNT = r"[₩￦]\s*([0-9][0-9,]{2,})(?![0-9])"
COMMA_AMOUNT = r"(?:^|[^0-9])([0-9]{1,3}(?:,[0-9]{3})+)(?![0-9])"
TRAILING_MARKS = r"[.,;:!?]+$"
COUNT_UNITS = {"k": 1_000, "천": 1_000, "만": 10_000, "백만": 1_000_000}


def parse_price_won(col: Column) -> Column:
    """first digit group in won; 만원 counts ten thousands, 천원 thousands; 0 when absent."""
    compact = F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", "")
    digits = F.regexp_replace(F.regexp_extract(compact, r"([0-9][0-9,]*)", 1), ",", "")
    amount = F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
    unit = F.when(compact.contains("만원"), 10_000).when(compact.contains("천원"), 1_000).otherwise(1)
    return amount * unit.cast("bigint")


def best_price(col: Column) -> Column:
    """the most price-like amount of a text, as written without spaces; '' when there is none.

    Amounts of 1000 won and more beat smaller ones; among those a thousands comma, then the value,
    then the longer spelling, then the earlier candidate win.
    """
    text = F.regexp_replace(F.coalesce(col, F.lit("")), SPLIT_THOUSANDS, "$1,$2$3")
    with_unit = F.regexp_extract_all(text, F.lit(WON_AMOUNT), 1)
    with_symbol = F.regexp_extract_all(text, F.lit(SYMBOL_AMOUNT), 1)
    bare = F.regexp_extract_all(text, F.lit(COMMA_AMOUNT), 1)

    def won(amounts: Column) -> Column:
        return F.transform(amounts, lambda a: F.concat(F.regexp_replace(a, TRAILING_MARKS, ""), F.lit("원")))

    raw = F.transform(
        F.concat(with_unit, won(with_symbol), won(bare)),
        lambda a: F.regexp_replace(F.regexp_replace(a, r"\s+", ""), TRAILING_MARKS, ""),
    )
    scored = F.transform(
        raw,
        lambda a, i: F.struct(
            (parse_price_won(a) >= 1000).alias("big"),
            a.contains(",").alias("comma"),
            parse_price_won(a).alias("won"),
            F.char_length(a).alias("chars"),
            (-i).alias("order"),
            a.alias("raw"),
        ),
    )
    return F.coalesce(F.array_max(F.filter(scored, lambda s: s["raw"] != ""))["raw"], F.lit(""))


def infer_price(title: Column, desc: Column, price: Column) -> Column:
    """price in the title, else (price unknown) in the text, else free / varies, else as given."""
    title, desc = F.coalesce(title, F.lit("")), F.coalesce(desc, F.lit(""))
    given = F.trim(F.coalesce(price, F.lit("")))
    unknown = given.isin("", UNKNOWN_PRICE)
    from_title, from_desc = best_price(title), best_price(desc)
    return (
        F.when(from_title != "", from_title)
        .when(unknown & (from_desc != ""), from_desc)
        .when(unknown & (title.contains(FREE) | desc.contains(FREE)), F.lit(FREE))
        .when(unknown & (title.contains(VARIES) | desc.contains(VARIES)), F.lit(VARIES))
        .otherwise(given)
    )


def is_free_deal(price: Column) -> Column:
    """0 to 100 won, or spelled free; a price without any digits that is not free is not."""
    clean = F.trim(F.coalesce(price, F.lit("")))
    return (clean == FREE) | (clean.rlike(r"[0-9]") & parse_price_won(clean).between(0, 100))


def parse_count(col: Column) -> Column:
    """``1,234``, ``1.2k``, ``3천``, ``5만``, ``2백만``; anything else is 0."""
    clean = F.lower(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), ",", ""))
    shape = r"^([0-9]+(?:\.[0-9]+)?)\s*(k|천|만|백만)?$"
    number = F.regexp_extract(clean, shape, 1).try_cast("double")
    unit = F.regexp_extract(clean, shape, 2)
    factor = F.lit(1)
    for name, value in COUNT_UNITS.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return F.coalesce(F.floor(number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def clean_price(col: Column) -> Column:
    """``12,000 (KRW)`` and ``₩12,000`` forms become plain won text."""
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    amount = F.regexp_extract(text, r"([0-9][0-9,]*)\s*\(KRW\)", 1)
    plain = F.regexp_replace(F.regexp_replace(text, r"\(KRW\)", "원"), " KRW", "원")
    text = F.when(
        text.contains("(KRW)"), F.when(amount != "", F.concat(amount, F.lit("원"))).otherwise(plain)
    ).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"[￦₩]", ""))
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*원\s*원$", "원")
