"""Secret scan with multipart credential linking (built-in functions only)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common

# Patterns of the base scan; fixed values, with the least length of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
# Parts that say little alone: an account name given to a key, a mixed token, an address of a service.
ACCOUNT = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}+"""
TOKEN = r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+=_-]{20,}+(?![A-Za-z0-9/+=_-])"
# Letters without which ACCOUNT cannot match; looked for first, in lower case.
ACCOUNT_HINTS = ("clientid", "client_id", "keyid", "key_id", "accountid", "account_id", "username", "user_name", "login")
ENDPOINT = r"""(?i:https?|s3|jdbc:[a-z]+|amqps?|rediss?|postgres(?:ql)?|mysql|mongodb)://[^\s"'<>]++"""
# Parts belong to one credential when at most so many code points lie between them.
SCOPE = 400
KINDS = ("assign", "access", "hex", "account", "secret", "endpoint")


def find_spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>> in code points, end exclusive.

    ``split`` gives the pieces between the same matches that ``regexp_extract_all`` returns, so their lengths place
    every match. ``keep`` tells by the matched string whether a match counts.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["hit"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        out = F.when(keep(pair["hit"]), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), out.alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _longer(least: int):
    return lambda hit: F.char_length(hit) >= least


def _mixed(hit):
    return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]") & ~hit.rlike("^" + ACCESS + "$")


def _holds(text: Column, *words: str) -> Column:
    return F.exists(F.array(F.lower(text)), lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in words]))


def base_spans(text: Column) -> Column:
    """The base scan's spans; texts without a kind's fixed letters skip its pattern."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    value = lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE
    named = _holds(text, "password", "passwd", "secret", "token", "apikey", "api_key")
    return F.concat(
        F.when(named, find_spans(text, ASSIGN, "assign", value)).otherwise(empty),
        F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, "access", _longer(ACCESS_LENGTH))).otherwise(empty),
        F.when(text.rlike("[0-9a-f]{%d}" % HEX_LENGTH), find_spans(text, HEX, "hex", _longer(HEX_LENGTH))).otherwise(empty))


def weak_spans(text: Column) -> Column:
    """Parts that are reported only beside complementary ones."""
    always = lambda hit: hit.isNotNull()
    return F.concat(
        find_spans(text, ACCOUNT, "account", always), find_spans(text, TOKEN, "secret", _mixed), find_spans(text, ENDPOINT, "endpoint", always))


def _near(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of ``parts`` with a row of ``others`` in the same text at most ``scope`` code points away.

    Both sides are put into cells of ``scope`` code points, the other side into every cell its widened interval
    touches; equal (text, cell) then meet, and the gap decides. A cell holds a bounded number of parts.
    """
    cell = lambda c: F.floor(c / F.lit(scope)).cast("int")
    wide = others.select(
        "k1", "k2", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))).alias("cell"),
        F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    own = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    return own.join(wide, ["k1", "k2", "cell"]).where(gap <= scope).select("k1", "k2", "start", "kind", "end").distinct()


def linked_parts(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Parts reported because complementary parts lie in scope: ``k1, k2`` (the text), ``start, kind, end``.

    ``texts`` has ``k1, k2, text`` and ``base``, the base spans. Identifiers are access keys and account names;
    secrets are assigned values, hex runs and mixed tokens. A mixed token counts beside an identifier, an account
    name beside a secret, an endpoint beside an identifier that has a secret itself.
    """
    kind = {k: i for i, k in enumerate(KINDS)}
    hinted = F.exists("base", lambda s: s["kind"] == kind["access"]) | (_holds(F.col("text"), *ACCOUNT_HINTS) & F.col("text").rlike(ACCOUNT))
    parts = (
        texts.where(hinted).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("base").alias("base"))
        .select("k1", "k2", F.explode(F.concat("base", weak_spans(F.col("text")))).alias("s")).select("k1", "k2", "s.*")
    )
    parts = parts.repartition("k1", "k2")
    of = lambda *names: parts.where(F.col("kind").isin([kind[n] for n in names]))
    identified = _near(of("access", "account"), of("assign", "hex", "secret"), scope)
    secrets = _near(of("secret"), of("access", "account"), scope)
    endpoints = _near(of("endpoint"), identified, scope)
    accounts = identified.where(F.col("kind") == kind["account"])
    return secrets.unionByName(endpoints).unionByName(accounts)


def scan_credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Adds ``spans`` to every row: array<struct<start, kind, end>> by start, then kind as in ``KINDS``.

    Null texts count as empty and have no spans. Whole texts are scanned, whatever their length. Equal (doc_id, text)
    rows share one evaluation of their weak parts and each gets the result; other columns are kept, a column named
    ``spans`` is replaced; an empty table stays empty.
    """
    docs = common.without(docs, "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({
        "_k1": F.xxhash64(F.col("doc_id"), text), "_k2": F.hash(text, F.lit(7)), "_base": base_spans(text)})
    linked = linked_parts(keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), text.alias("text"), F.col("_base").alias("base")), scope)
    found = linked.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_linked"))
    both = F.concat("_base", F.coalesce("_linked", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return (
        keyed.join(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_linked"), ["_k1", "_k2"], "left")
        .select(*docs.columns, F.array_sort(both).alias("spans"))
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
