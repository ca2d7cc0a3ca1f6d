"""Near-copy checks of drafts against posts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.keys import text_or_empty
from pricetide.functions.text import DATE_SUFFIX, URL_PATTERN, bind, collapse, compact_text, plain_body, similarity_text, similarity_tokens, similarity_words
from pricetide.functions.times import as_ts, kst_date
from pricetide.functions.urls import video_key
from pricetide.operators import scale
from pricetide.operators.terms import term_finder

# Limits of the draft gate and words that do not name a product.
TITLE_LIMIT, BODY_LIMIT = 0.72, 0.70
TITLE_LENGTH, BODY_LENGTH = (10, 70), (450, 1300)
MIN_COMPARED_BODY = 100
COOLDOWN_DAYS = 120
GRAM = 4
# Buckets of words whose rows are counted to put words in order.
LABEL_BUCKETS = 1 << 18
# Words of one side that a task keeps beside the rows of the other.
KNOWN_WORDS = 1 << 20
# Pairs of word sets that a task compares at once, and rows of two numbers that are broadcast.
TILE_PAIRS, HELD_NUMBERS = 1 << 18, 1 << 19
SEQUENCE_LIMIT = 0.8
GENERIC_TERMS = [
    "가정용", "기기", "미니", "무선", "생활", "세트", "스마트", "용품", "유선", "제품", "핸디", "휴대용",
]


def _rarest_first(labels: DataFrame, column: str):
    """A function of (labels, k): the ``k`` rarest labels of a row, rarest first, by one order for all rows.

    Rarity is counted by ``LABEL_BUCKETS`` buckets of labels, a table of fixed size for any vocabulary; labels that share a
    bucket go by their number, so rows are ordered where they lie, and any such order is right for a prefix.
    """
    bucket = F.pmod("label", F.lit(LABEL_BUCKETS)).cast("int")
    counted = labels.select(F.explode(column).alias("label")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    often = np.zeros(LABEL_BUCKETS, dtype="int64")  # at most LABEL_BUCKETS rows came back
    often[counted["b"].to_numpy()] = counted["n"].to_numpy()

    @F.pandas_udf("array<bigint>")
    def rarest(rows: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([x[np.lexsort((x, often[x % LABEL_BUCKETS]))[:n]] for x, n in zip(rows, k)])

    return rarest


def _may_be_alike(sets: DataFrame, threshold: float):
    """A function of (rows, tokens): ``member, tokens`` of the rows whose word set may have a Jaccard >= threshold with one of ``sets``.

    Two such sets share at least that part of the larger one. So the sizes of ``sets`` bound the size of what is alike, and
    where their words are few enough to be kept beside the rows, that part of a row's words must be among them. The other
    rows are left out where they are parsed. Words are looked up by number; a chance hit only keeps a row more.
    """
    size = F.size("tokens")
    words, least, most = sets.where(size > 0).agg(F.sum(size), F.min(size), F.max(size)).first()
    low, high = (least or 0) * threshold - 1e-9, (most or 0) / threshold + 1e-9
    numbers = F.transform("tokens", lambda t: F.xxhash64(t))
    held = None
    if words and words <= KNOWN_WORDS:
        known = np.sort(sets.select(F.explode(numbers).alias("label")).distinct().toPandas()["label"].to_numpy())

        @F.pandas_udf("int")
        def held(rows: pd.Series) -> pd.Series:
            flat, ends = np.concatenate([np.zeros(0, dtype="int64"), *rows]), np.cumsum([0, *map(len, rows)])
            hits = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
            return pd.Series(np.diff(np.concatenate([[0], np.cumsum(hits)])[ends]))

    def likely(rows: DataFrame, tokens: Column) -> DataFrame:
        fitting = F.filter(F.array(tokens), lambda t: F.size(t).between(low, high))
        rows = rows.select("member", F.explode_outer(fitting).alias("tokens")).where("tokens IS NOT NULL")
        return rows if held is None else rows.where(held(numbers) >= size * threshold - 1e-9)

    return likely


def _listed(tokens: str) -> Column:
    """The words of a staged set, which holds them as one text."""
    return F.filter(F.split(tokens, " "), lambda w: w != "")


def _meetings(size: Column) -> Column:
    """Words that two sets must share in their prefixes, by the size of the smaller one.

    A short set has no words to spare: its prefix would reach frequent ones. Long prefixes meet by chance more often.
    """
    return F.least(1 + F.floor(size / 16), 3 + F.floor(size / 128))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``right_sig, least, left_sig`` with the neighbours of one right set as one row."""
    for batch in batches:
        right = batch["right_sig"].to_numpy()
        if len(right):
            starts = np.flatnonzero(np.concatenate([[True], right[1:] != right[:-1]]))
            ends = pa.array(np.append(starts, len(right)), pa.int32())
            rows = batch.take(pa.array(starts))
            lists = pa.ListArray.from_arrays(ends, batch["left_sig"])
            yield pa.RecordBatch.from_arrays([rows["right_sig"], rows["least"], lists], ["right_sig", "least", "left_sigs"])


def _compared(threshold: float):
    """A function of batches of ``tile, other, sig, tokens``, by tile the sets (no ``other``) before the pairs (no ``tokens``):
    ``left_sig, right_sig, jaccard`` of the pairs with Jaccard >= threshold. It holds the sets and the pairs of one tile."""
    def compared(sets: dict[int, np.ndarray], words: int, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        marked, shared = np.zeros(words, dtype="int64"), np.zeros(len(left), dtype="int64")
        cuts = np.flatnonzero(left[1:] != left[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(left)]):
            own, others = sets[left[start]], [sets[x] for x in right[start:end]]
            marked[own] = 1
            shared[start:end] = np.add.reduceat(marked[np.concatenate(others)], np.cumsum([0, *map(len, others[:-1])]))
            marked[own] = 0
        jaccard = shared / (np.array([len(sets[x]) for x in left]) + np.array([len(sets[x]) for x in right]) - shared)
        good = jaccard >= threshold
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (left, right, jaccard)], ["left_sig", "right_sig", "jaccard"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, numbers, pairs = None, {}, {}, []
        for batch in batches:
            tiles = batch["tile"].to_numpy()
            cuts = (np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(tiles)]):
                if start == end:
                    continue
                if tiles[start] != at:
                    if pairs:
                        yield from compared(sets, len(numbers), *map(np.concatenate, zip(*pairs)))
                    at, sets, numbers, pairs = tiles[start], {}, {}, []
                rows = batch.slice(start, end - start)
                n = rows["other"].null_count
                for sig, tokens in zip(rows["sig"][:n].to_pylist(), rows["tokens"][:n].to_pylist()):
                    sets[sig] = np.array([numbers.setdefault(w, len(numbers)) for w in tokens.split(" ")])
                if n < len(rows):
                    pairs.append((rows["other"][n:].to_numpy(), rows["sig"][n:].to_numpy()))
        if pairs:
            yield from compared(sets, len(numbers), *map(np.concatenate, zip(*pairs)))

    return of


def _alike(left: DataFrame, right: DataFrame, threshold: float, row_id: str = "id", text: str = "text") -> tuple[dict[str, DataFrame], DataFrame]:
    """J21, exact: rows by word set (``left_id, left_sig`` and ``right_id, right_sig``) and the pairs of word sets
    ``left_sig, right_sig, jaccard`` with Jaccard >= threshold.

    Texts with the same word set go by the first of them, so copies cost nothing. Word sets meet on prefix tokens: words
    sorted rarest first, of which the first ``n - ceil(t*n) + k`` must share ``k`` in any qualifying pair (``_meetings``), at
    places behind which enough words are left. Frequent words hardly ever lie in a prefix. Words meet by their 64-bit
    number; the sets themselves decide. A table against itself is parsed once, and each of its pairs is weighed in one
    direction. Of two tables the left one is parsed first, and right rows that are alike to nothing there by size and words
    are not kept.

    A set is not sent along with each of its pairs: those that met go to tiles, and a tile gets each of its sets once. The
    pairs of a right set lie in the tile of the first left set it met, as those of its near copies mostly do. Where more
    than ``TILE_PAIRS`` would meet, both sides are dealt over a square of tiles.
    """
    itself = left is right
    members, reps = {}, {}
    for name, df in (("left", left), ("right", right))[:1 if itself else 2]:
        tokens = F.sort_array(similarity_words(F.col("text")))
        rows = df.select(F.col(row_id).alias("member"), F.col(text).alias("text"))
        if name == "left":
            rows = rows.select("member", tokens.alias("tokens"))
        else:
            rows = _may_be_alike(sets.select(_listed("tokens").alias("tokens")), threshold)(rows, tokens)
        number = F.monotonically_increasing_id() * 2 + F.lit(int(name == "right"))  # no number on both sides
        sets = scale.cut_lineage(rows.select("member", F.array_join("tokens", " ").alias("tokens"), number.alias("sig")))  # a text is parsed once
        keyed = sets.select("sig", F.unhex(F.md5("tokens")).alias("words"))
        several = keyed.groupBy("words").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = scale.cut_lineage(scale.salted_join(keyed, scale.shuffled(several), ["words"], ["sig"]).where("sig <> first").select("sig", "first"))
        few = scale.is_small(copies, HELD_NUMBERS)
        copies = F.broadcast(copies) if few else scale.shuffled(copies)
        reps[name] = sets.where("tokens <> ''").select("sig", "tokens").join(copies, "sig", "left_anti")
        reps[name] = reps[name] if few else scale.cut_lineage(reps[name])
        numbered = sets.select("member", "sig").join(copies, "sig", "left").select("member", F.coalesce("first", "sig").alias("sig"))
        for side in ("left", "right") if itself else (name,):
            members[side] = numbered.select(F.col("member").alias(f"{side}_id"), F.col("sig").alias(f"{side}_sig"))
    every = reps["left"] if itself else reps["left"].unionByName(reps["right"])
    size = F.size("labels")
    labelled = every.select("sig", F.transform(_listed("tokens"), lambda t: F.xxhash64(t)).alias("labels"))
    rarest = _rarest_first(labelled, "labels")
    k = (size - F.ceil(size * threshold - F.lit(1e-9)) + _meetings(size)).cast("int")
    heads = labelled.select("sig", size.alias("n"), rarest("labels", k).alias("head"))
    prefix = heads.select("sig", "n", F.posexplode("head").alias("at", "token"))

    def side(name: str) -> DataFrame:
        own = prefix if itself else prefix.where(F.col("sig") % 2 == int(name == "right"))
        return own.select("token", F.col("sig").alias(f"{name}_sig"), F.col("n").alias(f"{name}_n"), F.col("at").alias(f"{name}_at"))

    small, big = F.least("left_n", "right_n"), F.greatest("left_n", "right_n")
    once = F.col("left_sig") < F.col("right_sig") if itself else F.lit(True)
    # Words are ordered alike in both sets, so what lies behind a common prefix word bounds the rest.
    most = _meetings(small) + F.least(F.col("left_n") - 1 - F.col("left_at"), F.col("right_n") - 1 - F.col("right_at"))
    needed = (F.col("left_n") + F.col("right_n")) * F.lit(threshold / (1 + threshold))
    if itself:  # both sides read one shuffle
        joined = scale.shuffled(side("right")).join(side("left"), "token")
    else:
        joined = scale.join_small_or_salted(side("right"), side("left"), ["token"], ["right_sig"])
    met = joined.where((small >= big * threshold - F.lit(1e-9)) & once & (most >= needed - F.lit(1e-9)))
    shared = F.ceil(F.col("right_n") * threshold - F.lit(1e-9))  # at least, with a set that is alike and so has as many words
    least = F.least(_meetings(shared), shared).cast("int").alias("least")
    pairs = scale.cut_lineage(
        met.select("right_sig", least, "left_sig").mapInArrow(_packed, "right_sig long, least int, left_sigs array<long>")
        .repartition("right_sig").select("right_sig", "least", F.explode("left_sigs").alias("left_sig"))
        .groupBy("right_sig", "least", "left_sig").agg(F.count(F.lit(1)).alias("n")).where("n >= least")
        .select("left_sig", "right_sig", F.min("left_sig").over(Window.partitionBy("right_sig")).alias("home")))

    wide = pairs.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_PAIRS).select(
        "home", F.ceil(F.sqrt(F.col("n") / TILE_PAIRS)).alias("wide"))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("wide", F.lit(1)))
    tiled = scale.join_small_or_salted(pairs, wide, ["home"], ["right_sig"], "left").select(
        F.xxhash64("home", part("left_sig"), part("right_sig")).alias("tile"), "left_sig", "right_sig")
    wanted = scale.cut_lineage(tiled.select("tile", F.explode(F.array("left_sig", "right_sig")).alias("sig")).distinct())
    sent = every.join(F.broadcast(wanted) if scale.is_small(wanted, HELD_NUMBERS) else scale.shuffled(wanted), "sig")
    rows = sent.select("tile", F.lit(None).cast("long").alias("other"), "sig", "tokens").unionByName(
        tiled.select("tile", F.col("left_sig").alias("other"), F.col("right_sig").alias("sig"), F.lit(None).cast("string").alias("tokens")))
    good = scale.cut_lineage(rows.repartition("tile").sortWithinPartitions("tile", "other").mapInArrow(
        _compared(threshold), "left_sig long, right_sig long, jaccard double"))
    if itself:
        mirrored = good.select(F.col("right_sig").alias("left_sig"), F.col("left_sig").alias("right_sig"), "jaccard")
        own = every.select(F.col("sig").alias("left_sig"), F.col("sig").alias("right_sig"), F.lit(1.0).alias("jaccard"))
        good = good.unionByName(mirrored).unionByName(own)
    return members, good


def token_jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float, row_id: str = "id", text: str = "text") -> DataFrame:
    """(left_id, right_id, jaccard), for callers that want every pair of rows; see ``similar_counts`` and
    ``first_similar`` for results that grow with the rows only."""
    members, good = _alike(left, right, threshold, row_id, text)
    wide = scale.join_small_or_salted(members["right"], good, ["right_sig"], ["right_id"])
    return scale.join_small_or_salted(wide, members["left"], ["left_sig"], ["right_id"]).select(
        "left_id", "right_id", "jaccard")


def similar_counts(left: DataFrame, right: DataFrame, threshold: float, row_id: str = "id", text: str = "text") -> DataFrame:
    """(left_id, similar), the number of right rows alike; copies count by weight and are never expanded."""
    members, good = _alike(left, right, threshold, row_id, text)
    weights = members["right"].groupBy("right_sig").agg(F.count(F.lit(1)).alias("_n"))
    counts = good.join(weights, "right_sig").groupBy("left_sig").agg(F.sum("_n").alias("similar"))
    return scale.salted_join(members["left"], counts, ["left_sig"], ["left_id"]).select("left_id", "similar")


def first_similar(drafts: DataFrame, posts: DataFrame, threshold: float) -> DataFrame:
    """(draft_id, post_pos, post_title), per draft the first post (by ``pos``) with a similar text.

    ``drafts`` has id and text, ``posts`` has pos, title and text. Word sets keep only their first post.
    """
    keyed = posts.select(F.struct("pos", "title").alias("id"), "text")
    members, good = _alike(drafts, keyed, threshold)
    firsts = members["right"].groupBy("right_sig").agg(F.min("right_id").alias("_first"))
    found = good.join(firsts, "right_sig").groupBy("left_sig").agg(F.min("_first").alias("_first"))
    return scale.salted_join(members["left"], found, ["left_sig"], ["left_id"]).select(
        F.col("left_id").alias("draft_id"), F.col("_first.pos").alias("post_pos"), F.col("_first.title").alias("post_title"))


def similar_sequences(left: DataFrame, right: DataFrame, threshold: float = SEQUENCE_LIMIT, row_id: str = "id", text: str = "text") -> DataFrame:
    """J21, the sequence half: (left_id, similar), the number of right rows alike in their order of characters.

    Alike are two normalised texts (``similarity_text``, not empty) with 1 - edit distance / longer length >= ``threshold``,
    which must be over 2/3; this is the definition of this library. Meant for titles: words that were split, joined or
    misspelt. Equal texts are one and count by weight.

    An edit leaves all but two of a text's pairs of neighbouring characters alone, so two texts that are d edits apart
    share one of the 2 d + 1 pairs of either that are rarest over all texts, at most d places apart. For those that meet
    so the distance is computed as far as d.
    """
    if threshold <= 2 / 3:
        raise ValueError("threshold must be over 2/3")
    slack = F.lit(1 - threshold)
    rows = {
        name: df.select(F.col(row_id).alias(f"{name}_id"), similarity_text(F.col(text)).alias("t")).where("t <> ''")
        for name, df in (("left", left), ("right", right))
    }
    rows["left"] = scale.cut_lineage(rows["left"])
    weights = scale.cut_lineage(rows["right"].groupBy("t").agg(F.count(F.lit(1)).alias("weight")))
    every = rows["left"].select("t", F.lit("left").alias("side")).distinct().unionByName(weights.select("t", F.lit("right").alias("side")))
    chars = F.split(F.concat(F.lit("\u0001"), F.col("t")), "")
    pairs = bind(chars, lambda c: F.filter(F.transform(c, lambda x, i: F.concat(x, F.get(c, i + 1))), lambda g: g.isNotNull()))
    texts = scale.cut_lineage(every.select("side", "t", F.char_length("t").alias("n"), pairs.alias("grams")))
    placed = texts.select("side", "t", "n", F.posexplode("grams").alias("at", "gram"))
    common = texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("side", "t").orderBy("often", "gram", "at")
    most = F.floor(slack * F.col("n") / F.lit(threshold) + F.lit(1e-9)).cast("int")  # edits that the longest partner allows
    heads = scale.cut_lineage(
        scale.join_small_or_salted(placed, common, ["gram"], ["t"]).withColumn("rank", F.row_number().over(rarest))
        .where(F.col("rank") <= 2 * most + 1).select("side", "t", "n", "at", "gram"))
    side = lambda name: heads.where(F.col("side") == name).select("gram", *[F.col(c).alias(f"{name[0]}_{c}") for c in ("t", "n", "at")])
    edits = F.floor(slack * F.greatest("l_n", "r_n") + F.lit(1e-9)).cast("int")
    met = scale.salted_join(side("right"), side("left"), ["gram"], ["r_t"]).withColumn("edits", edits).where(
        (F.abs(F.col("l_n") - F.col("r_n")) <= F.col("edits")) & (F.abs(F.col("l_at") - F.col("r_at")) <= F.col("edits")))
    alike = met.select("l_t", "r_t", "edits").distinct().where(F.expr("levenshtein(l_t, r_t, edits)") >= 0)
    counts = alike.join(weights.withColumnRenamed("t", "r_t"), "r_t").groupBy(F.col("l_t").alias("t")).agg(F.sum("weight").alias("similar"))
    return scale.salted_join(rows["left"], counts, ["t"], ["left_id"]).select("left_id", "similar")


def source_keys(posts: DataFrame) -> DataFrame:
    """Video keys already used by the posts, from their picture and every link in the body."""
    links = F.transform(
        F.when(F.contains("body", F.lit("://")), F.regexp_extract_all("body", F.lit(f"({URL_PATTERN})"), 1)).otherwise(F.array()),
        lambda u: F.regexp_replace(u, r"[.,]+$", ""))
    every = posts.select(F.explode(F.concat(F.array(text_or_empty(F.col("img"))), links)).alias("u"))
    return every.select(video_key(F.col("u")).alias("source_key")).where("source_key <> ''").distinct()


def source_reuse(urls: DataFrame, posts: DataFrame, url: str = "url") -> DataFrame:
    """Candidate links whose source key no post uses yet."""
    keyed = urls.withColumn("source_key", video_key(F.col(url)))
    return keyed.join(source_keys(posts), "source_key", "left_anti")


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given lengths. Characters are split once; substrings by position would rescan the text."""
    def of(chars: Column, q: int) -> Column:
        return F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, q)]))
    return bind(F.split(text, ""), lambda chars: F.array_distinct(F.array_compact(F.flatten(F.array(*[of(chars, q) for q in sizes])))))


def _first_holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, post``: of each distinct term (two characters or more) the first of the ``texts`` (``key, post``) that holds it.

    A term is looked up by the rarest of its grams (of up to four characters), counted over all texts, so a common beginning
    meets nothing; a term one of whose grams no text has is done. Of a text's grams only those of some term are kept.
    """
    size = F.least(F.char_length("term"), F.lit(GRAM))
    sizes = sorted(r[0] for r in terms.select(size).distinct().collect())  # 2 to GRAM: a few numbers
    if not sizes:
        return terms.select("term", F.lit(None).cast(texts.schema["post"].dataType).alias("post")).limit(0)
    own = F.coalesce(*[F.when(size == q, _grams(F.col("term"), [q])) for q in sizes])
    wanted = scale.cut_lineage(terms.select("term").distinct().select("term", F.explode(own).alias("gram")))
    texts = texts.withColumn("at", F.xxhash64("key"))
    met = texts.select("at", F.explode(_grams(F.col("key"), sizes)).alias("gram"))
    met = scale.cut_lineage(scale.join_small_or_salted(met, wanted.select("gram").distinct(), ["gram"], ["at"]))
    common = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    lookup = wanted.join(common, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).where("rarest.n > 0").select("term", F.col("rarest.gram").alias("gram"))
    likely = scale.join_small_or_salted(met, lookup, ["gram"], ["at"]).select("at", "term")
    return likely.join(texts, "at").where(F.col("key").contains(F.col("term"))).groupBy("term").agg(F.min("post").alias("post"))


def product_cooldown_join(
    drafts: DataFrame, posts: DataFrame, now: str | Column, days: int = COOLDOWN_DAYS, generic: list[str] = GENERIC_TERMS, looked_at: tuple[str, ...] = ("title",),
) -> DataFrame:
    """Per draft the first recent post (by ``pos``) about the same product: (draft_id, post_pos, post_title).

    Same product: the compact product name inside the compact text of the post, the text inside the name, or one of the
    name's own words inside the text. ``looked_at`` names the columns that make a post's text; they count whole. Texts
    inside a name are no longer than the longest name; their first characters must be among the name's grams.
    """
    norm = similarity_text(F.col("product"))
    compact = F.replace(norm, F.lit(" "), F.lit(""))
    words = F.filter(similarity_tokens(norm), lambda w: ~w.isin(generic))
    stripped = F.array_compact(F.array(*[
        F.when(compact.startswith(g) & (F.char_length(compact) - len(g) >= 2), F.substring(compact, len(g) + 1, 1 << 30))
        for g in generic
    ]))
    d = drafts.select(
        F.col("id").alias("draft_id"), compact.alias("name"), F.array_distinct(F.concat(words, stripped, F.array(compact))).alias("terms")
    ).where(F.char_length("name") >= 2)
    cutoff = as_ts(now) - F.expr(f"INTERVAL {days} DAYS")
    text = compact_text(F.concat_ws(" ", *looked_at))
    p = posts.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff)).select(
        F.struct(F.col("pos").alias("post_pos"), collapse(F.col("title")).alias("post_title")).alias("post"), text.alias("key"))
    d = scale.cut_lineage(d)
    terms = d.select("draft_id", F.explode("terms").alias("term")).where(F.char_length("term") >= 2)
    longest = d.agg(F.max(F.char_length("name"))).first()[0] or 0
    finder = term_finder(terms)
    if finder is not None:  # a text is read where it lies; only one that fits into a name is kept
        p = scale.cut_lineage(p.select(
            "post", F.when(F.char_length("key") <= longest, F.col("key")).alias("key"), finder("key").alias("held")))
        firsts = p.select("post", F.explode("held").alias("term")).groupBy("term").agg(F.min("post").alias("post"))
        p = p.where("key IS NOT NULL")
    # Equal texts conflict alike; only the earliest matters.
    p = scale.cut_lineage(p.groupBy("key").agg(F.min("post").alias("post")))
    if finder is None:
        firsts = _first_holding(p, terms)
    inside_text = terms.join(firsts, "term").select("draft_id", "post")
    names = d.select("draft_id", "name", F.explode(_grams(F.col("name"), [1, 2, 3, 4])).alias("gram"))
    heads = p.where((F.col("key") != "") & (F.char_length("key") <= longest)).withColumn("gram", F.substring("key", 1, GRAM))
    inside_name = scale.join_small_or_salted(heads, names, ["gram"], ["key"]).where(
        F.col("name").contains(F.col("key"))).select("draft_id", "post")
    blank = d.select("draft_id", p.where("key = ''").select(F.min("post")).scalar().alias("post")).where("post IS NOT NULL")
    return inside_text.unionByName(inside_name).unionByName(blank).groupBy("draft_id").agg(
        F.min("post").alias("post")).select("draft_id", "post.post_pos", "post.post_title")


def draft_gate(
    drafts: DataFrame, posts: DataFrame, trusted: DataFrame, now: str | Column,
    title_limit: float = TITLE_LIMIT, body_limit: float = BODY_LIMIT,
) -> DataFrame:
    """(id, pos, source_url, reasons) with every rule a draft breaks; an empty list passes.

    ``drafts``: id, pos, title, body, product, source_url. ``posts``: id, pos, title, body, img,
    created_at. ``trusted``: url. Similar means a Jaccard of the word sets at the limit or above.
    """
    # Both sides are read once; a body is written once, as it is.
    d = scale.cut_lineage(drafts.withColumn("_title", collapse(F.col("title"))).withColumn("_body", plain_body(F.col("body"))))
    posts = scale.cut_lineage(posts.select("pos", "title", "body", "img", "created_at", collapse(F.col("title")).alias("_shown")))
    shown = F.col("_shown").alias("title")
    titles = first_similar(d.select("id", F.col("_title").alias("text")), posts.select("pos", shown, F.col("title").alias("text")), title_limit)
    plain = bind(plain_body(F.col("body")), lambda t: F.when(F.char_length(t) >= MIN_COMPARED_BODY, t))  # a short one has no words
    compared = posts.select("pos", shown, plain.alias("text"))
    bodies = first_similar(d.select("id", F.col("_body").alias("text")), compared, body_limit)

    def first(hits: DataFrame, name: str) -> DataFrame:
        return hits.select(F.col("draft_id").alias("id"), F.substring("post_title", 1, 60).alias(name))

    cooled = product_cooldown_join(d, posts, now).select(
        F.col("draft_id").alias("id"), F.col("post_title").alias("_product"))
    used = source_keys(posts).withColumn("_used", F.lit(True))
    known = trusted.select(F.trim("url").alias("_url")).distinct().withColumn("_trusted", F.lit(True))
    joined = (
        d.withColumn("_url", text_or_empty(F.col("source_url")))
        .withColumn("source_key", video_key(F.col("source_url")))
        .join(first(titles, "_similar_title"), "id", "left").join(first(bodies, "_similar_body"), "id", "left")
        .join(cooled, "id", "left").join(used, "source_key", "left").join(known, "_url", "left")
    )

    def outside(col: str, bounds: tuple[int, int]) -> Column:
        return ~F.char_length(col).between(*bounds)

    reasons = F.array_compact(F.array(
        F.when(outside("_title", TITLE_LENGTH), F.lit("title_length")),
        F.when(F.col("_title").rlike(DATE_SUFFIX), F.lit("date_suffix")),
        F.when(outside("_body", BODY_LENGTH), F.lit("body_length")),
        F.when(F.col("_body").rlike(URL_PATTERN), F.lit("unexpected_body_url")),
        F.when(F.col("_trusted").isNull(), F.lit("untrusted_source")),
        F.when(F.col("_used"), F.lit("source_already_used")),
        F.concat(F.lit("similar_title:"), F.col("_similar_title")),
        F.concat(F.lit("similar_body:"), F.col("_similar_body")),
        F.concat(F.lit("product_cooldown:"), F.col("_product")),
    ))
    short = F.char_length(F.replace(similarity_text(F.col("product")), F.lit(" "), F.lit(""))) < 2
    reasons = F.when(F.coalesce(short, F.lit(True)), F.concat(
        reasons, F.array(F.lit("product_cooldown:invalid_product")))).otherwise(reasons)
    return joined.select("id", "pos", "source_url", reasons.alias("reasons"))


def first_valid(gated: DataFrame, k: int = 1) -> DataFrame:
    """The first draft without reasons; later drafts of a source already chosen do not count."""
    valid = gated.where(F.size("reasons") == 0)
    return scale.keep_one(valid, ["source_url"], F.col("pos").asc()).orderBy("pos").limit(k)


def posted_today(posts: DataFrame, authors: list[str], now: str | Column) -> DataFrame:
    """Whether one of the authors has posted on now's Seoul date."""
    today = kst_date(as_ts(now))
    hit = F.trim(F.coalesce("author", F.lit(""))).isin(authors) & (kst_date(F.col("created_at")) == today)
    return posts.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("posted_today"))
