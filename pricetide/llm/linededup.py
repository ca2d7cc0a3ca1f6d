"""Line dedup by a deletion-neighbourhood join (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm import common
from pricetide.session import stage

# A line's units are its words, or its characters where it has fewer words than this (scripts without spaces, tabs): one
# word of five and one character of twenty are the loosest near matches. Lines with fewer of both are matched exactly.
MIN_WORDS, MIN_CHARS = 5, 20
# Marks on documents up to this size are broadcast, larger ones joined by a shuffle.
SMALL_BYTES = 32 << 20
# Low bits of a unit's hash that are added up; 2^26 units fit a long.
BITS = 36


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _units(line: Column) -> tuple[Column, Column]:
    """A line's kind (0: words, 1: characters, null: too short for near matches) and its units."""
    words = F.split(line, " ", -1)
    kind = F.when(F.size(words) >= MIN_WORDS, 0).when(F.char_length(line) >= MIN_CHARS, 1)
    return kind, F.when(kind == 0, words).when(kind == 1, F.split(line, ""))


def _halves(words: Column, kind: Column) -> Column:
    """Keys of which lines of a kind within one edit of a unit share at least one.

    For the shorter line's length n and h = n // 2, an edit leaves either the first h or the last n - h units alone.
    A line takes both parts once for its own length and once for one unit less; two of the four are the same.
    """
    def keys(n: Column) -> list[Column]:
        h = F.floor(n / 2).cast("int")
        return [F.xxhash64(kind * 2, F.slice(words, F.lit(1), h)), F.xxhash64(kind * 2 + 1, F.slice(words, F.size(words) - (n - h) + 1, n - h))]

    n = F.size(words)
    return F.array_distinct(F.array(*keys(n), *keys(n - 1)))


def _lines(rows: DataFrame) -> DataFrame:
    """``first`` (the line's place in the order of dedup), its digest ``h1, h2`` and the half keys of near candidates."""
    line = rows.select("doc_id", "_row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = line.select("doc_id", "_row", "pos", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    kind, units = _units(F.col("line"))
    near = F.transform(F.array(F.struct(kind.alias("kind"), units.alias("units"))), lambda u: F.when(u["kind"].isNotNull(), _halves(u["units"], u["kind"])))[0]
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "pos")
    return line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), first.alias("first"), near.alias("halves"))


def _by_document(places: DataFrame, *more: str) -> DataFrame:
    return places.groupBy("first.doc_id", "first._row").agg(F.collect_list(F.struct("first.pos", *more)).alias("_at"))


def _beside_documents(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Joins ``doc_id, _row, _at`` to the documents they belong to.

    Marks are broadcast if what they hold, added up first, is within ``SMALL_BYTES``; else both sides are shuffled.
    """
    row = F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)).cast("bigint") + F.lit(64)
    each = F.lit(8) if marks.schema["_at"].dataType.elementType.typeName() == "integer" else row  # a place alone, or with its document's id
    held = marks.agg(F.sum(F.size("_at") * each + row).alias("b")).first()["b"] or 0
    marks = marks.select(F.col("doc_id").alias("_mark_id"), F.col("_row").alias("_mark_row"), "_at")
    marks = F.broadcast(marks) if held <= SMALL_BYTES else marks
    return docs.join(marks, (docs["_row"] == marks["_mark_row"]) & docs["doc_id"].eqNullSafe(marks["_mark_id"]), how).drop("_mark_id", "_mark_row")


def _variants(candidates: DataFrame) -> DataFrame:
    """Every candidate line's deletion neighbourhood: ``v``, the hash of the variant, and ``i``, the deleted word's
    position (0: the line itself).

    The hash of a word sequence adds up hashes of (word, position), so running sums give all variants of a line in one
    pass: what stands before the deleted word keeps its position, what stands behind moves up by one.
    """
    word = candidates.repartition("h1").select("h1", "kind", F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
    low = lambda *cols: F.xxhash64(*cols).bitwiseAND(F.lit(2**BITS - 1))
    for k in (1, 2):
        word = word.withColumn(f"a{k}", low(F.lit(k), "word", F.col("j"))).withColumn(f"b{k}", low(F.lit(k), "word", F.col("j") - 1))
    word = word.drop("word")
    line = Window.partitionBy("h1")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in (1, 2):
        before = F.sum(f"a{k}").over(upto) - F.col(f"a{k}")
        behind = F.sum(f"b{k}").over(line) - F.sum(f"b{k}").over(upto)
        word = word.withColumn(f"v{k}", before + behind).withColumn(f"t{k}", F.sum(f"a{k}").over(line))
    deleted = F.struct((F.col("j") + 1).alias("i"), F.xxhash64("v1", "v2", F.col("n") - 1, "kind").alias("v"))
    itself = F.struct(F.lit(0).alias("i"), F.xxhash64("t1", "t2", "n", "kind").alias("v"))
    both = F.when(F.col("j") == 0, F.array(deleted, itself)).otherwise(F.array(deleted))
    return word.select("h1", F.explode(both).alias("v")).select("h1", "v.*")


def _earlier_neighbours(variants: DataFrame, firsts: DataFrame) -> DataFrame:
    """``first, earlier``: for each line the earliest line before it whose variant makes them neighbours.

    Variants that no other line has go before places are looked at. Equal variants with the same position are one
    substitution apart; a variant equal to a whole line is one deletion away. The least place per (variant, position)
    says it all, so no pairs inside a bucket are formed.
    """
    variants = stage(variants)
    shared = variants.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")  # counted before rows move
    placed = stage(variants.join(shared, "v").join(firsts, "h1").select("v", "i", "first"))
    per_position = placed.groupBy("v", "i").agg(F.min("first").alias("same"))
    per_key = per_position.groupBy("v").agg(
        F.min(F.when(F.col("i") == 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("same"))).alias("cut"))
    met = placed.join(per_key, "v").join(per_position, ["v", "i"])
    before = F.when(F.col("i") == 0, F.least("cut", "same")).otherwise(F.least("whole", "same"))
    return met.withColumn("earlier", before).where("earlier < first").groupBy("first").agg(F.min("earlier").alias("earlier"))


def _one_edit(a: Column, b: Column) -> Column:
    """Word edit distance of at most one: common prefix and suffix leave at most one word of the longer line."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def common_run(x, y):
        differs = F.array_position(F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda p, q: p != q), True)
        return F.when(differs == 0, short).otherwise(differs - 1)

    prefix, suffix = common_run(a, b), common_run(F.reverse(a), F.reverse(b))
    return prefix + F.least(suffix, short - prefix) >= long - 1


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every line kept once over all documents: adds ``n_lines`` and ``n_dropped``, rewrites ``text``.

    Lines (split at ``\\n``, trimmed) are in order by doc_id (null last), then by place. A line goes if an equal line
    comes earlier, or, for lines of ``MIN_WORDS`` words and more, one within a word edit distance of 1 (a word replaced,
    added or left out; words are what single spaces separate) - whether or not that earlier line itself stays. Lines of
    fewer words but ``MIN_CHARS`` characters or more are compared with each other in the same way by characters. Blank lines
    always stay. A document none of whose lines stay is left out; rows with null, empty or blank text stay as they are.
    Rows that repeat both doc_id and text are one record: the one with the least other columns is taken. Other columns
    are kept, input columns of the output names replaced; an empty table stays empty. Lines and texts of any length are
    used whole.

    Method: lines that could have a near partner share half of their words with another line (``_halves``); those emit
    all variants with one word deleted as hashed keys, equal keys meet, the edit distance to the earliest line met is
    verified, and the earliest line stays. Hot lines and hot variants are reduced to their least place before a shuffle.
    """
    docs = common.without(docs, "n_lines", "n_dropped")
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = _single_records(docs.withColumn("_row", F.xxhash64(F.lit(7), text)))

    lines = stage(_lines(rows).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("halves").alias("halves")))
    halves = lines.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hopeful = halves.join(shared, "half").select("h1").distinct()
    firsts = stage(lines.join(hopeful, "h1").select("h1", "first"))
    candidates = stage(
        _beside_documents(rows.select("doc_id", "_row", "text"), stage(_by_document(firsts, "first", "h1")), "inner")
        .select("_at", F.split("text", "\n", -1).alias("all"))
        .select(F.explode(F.transform("_at", lambda a: F.struct(a["h1"].alias("h1"), a["first"].alias("first"), F.col("all")[a["pos"]].alias("line")))).alias("x"))
        .select("x.h1", "x.first", _trimmed(F.col("x.line")).alias("line"))
        .select("h1", "first", *[c.alias(n) for c, n in zip(_units(F.col("line")), ("kind", "words"))]))

    met = _earlier_neighbours(_variants(candidates), firsts)
    side = lambda name: candidates.select(F.col("first").alias(name), F.col("words").alias(f"w_{name}"))
    near = met.join(side("first"), "first").join(side("earlier"), "earlier").where(_one_edit(F.col("w_first"), F.col("w_earlier"))).select("first")

    stay = _by_document(lines.select("first").join(near, "first", "left_anti"))
    said = F.size(F.filter(F.split("text", "\n", -1), lambda x: _trimmed(x) != ""))
    spoken = rows.select("doc_id", "_row", said.alias("said")).where("said > 0")
    kept_of = stay.select(F.col("doc_id").alias("d"), F.col("_row").alias("r"), F.col("_at.pos").alias("_at"))
    changed = stage(
        spoken.join(kept_of, (F.col("_row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
        .select("doc_id", "_row", F.coalesce("_at", F.array().cast("array<int>")).alias("_at"), "said").where("size(_at) < said").drop("said"))

    done = (
        _beside_documents(rows, changed, "left").where("_at is null or size(_at) > 0")
        .withColumn("_all", F.split(text, "\n", -1))
        .withColumn("_blank", F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: _trimmed(F.col("_all")[i]) == ""))
        .withColumn("_new", F.array_join(F.transform(F.array_sort(F.concat("_at", "_blank")), lambda i: F.col("_all")[i]), "\n"))
        .withColumn("n_dropped", F.coalesce(F.size("_all") - F.size("_blank") - F.size("_at"), F.lit(0)))
    )
    new_text = F.coalesce("_new", "text").alias("text")
    return done.select(*[new_text if c == "text" else F.col(c) for c in names], F.size("_all").alias("n_lines"), "n_dropped")


def _single_records(rows: DataFrame) -> DataFrame:
    """Of rows that repeat doc_id and text, the one with the least other columns; the rest of the table does not move."""
    repeated = rows.groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "doc_id", "_row", F.array(F.lit(0)).alias("_at"))
    repeated = stage(repeated)
    if not repeated.limit(1).count():
        return rows
    marked = stage(_beside_documents(rows, repeated, "left"))
    others = F.to_json(F.struct(*[c for c in rows.columns if c not in ("text", "_row")]))
    first = Window.partitionBy("doc_id", "_row").orderBy(others, F.col("text").isNull())
    single = marked.where("_at is not null").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_at")
    return marked.where("_at is null").drop("_at").unionByName(single)
