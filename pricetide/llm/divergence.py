"""Source divergence audit: term frequencies by single-pass in-memory indexing, then exact divergences of sources."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import stage

LEAST_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
# A task's postings are spilled as a run once they hold this many (document, term) pairs or terms.
BLOCK_POSTINGS, BLOCK_TERMS = 4_000_000, 600_000
ROW_TERMS = 4_096  # terms of a run in one row
PIECE = 1 << 20  # bytes of a text split together
# Groups looked up in the tasks; each takes about a hundred bytes there. More are joined to the terms.
SMALL_GROUPS = 20_000
PAIRS = 1 << 20  # pairs of sources corrected together

# ASCII letters are lower-cased, other ASCII bytes end a term, bytes above ASCII belong to it.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

RUNS = "shard int, lang string, first binary, terms array<binary>, docs array<bigint>, sizes array<int>, names array<string>, sources array<int>, counts array<bigint>"
FREQUENCIES = "lang string, term binary, n_docs bigint, sources array<string>, counts array<bigint>"


class Block:
    """Postings of the documents read so far: numbers of terms, their occurrences, and the document's group."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.groups: dict[tuple[str, str], int] = {}
        self.terms, self.counts, self.group, self.size = [], [], [], 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        found, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, at = text.translate(_TERM), 0
        while at < len(data):
            stop = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
            stop = len(data) if stop < 0 else stop
            words = data[at:stop].split()
            numbers, n = np.unique(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), return_counts=True)
            if len(found):
                numbers, where = np.unique(np.concatenate([found, numbers]), return_inverse=True)
                n = np.bincount(where, np.concatenate([times, n])).astype(np.int64)  # below 2^53
            found, times, at = numbers, n, stop
        if len(found):
            self.terms.append(found)
            self.counts.append(times)
            self.group.append(group)
            self.size += len(found)

    def full(self) -> bool:
        return self.size >= BLOCK_POSTINGS or len(self.number) >= BLOCK_TERMS

    def run(self, shards: int) -> Iterator[dict]:
        """The block as rows sorted by (shard, language, term)."""
        if not self.terms:
            return
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[t] for t in names]] = np.arange(len(names))
        shard = np.array([zlib.crc32(t) % shards for t in names], np.int64)
        langs = sorted({lang for lang, _ in self.groups})
        sources = [source for _, source in self.groups]
        lang_of = np.array([langs.index(lang) for lang, _ in self.groups], np.int64)
        sizes = [len(t) for t in self.terms]
        group = np.repeat(np.array(self.group, np.int64), sizes)
        term = rank[np.concatenate(self.terms)]
        place = (shard[term] * len(langs) + lang_of[group]) * len(names) + term
        order = np.argsort(place * len(sources) + group, kind="stable")
        place, group, times = place[order], group[order], np.concatenate(self.counts)[order]
        entry = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (group[1:] != group[:-1]))))
        count = np.add.reduceat(times, entry)
        n_docs = np.diff(np.append(entry, len(place)))
        place, group = place[entry], group[entry]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(np.append(first, len(place)))
        n_docs, place = np.add.reduceat(n_docs, first), place[first]
        part, term = place // len(names), place % len(names)
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        ends = np.append(first, len(group))
        for low, high in zip(bounds, bounds[1:]):
            for at in range(low, high, ROW_TERMS):
                stop = min(high, at + ROW_TERMS)
                own = slice(ends[at], ends[stop])
                used, local = np.unique(group[own], return_inverse=True)
                yield {
                    "shard": int(part[at]) // len(langs), "lang": langs[int(part[at]) % len(langs)], "first": names[term[at]], "terms": [names[t] for t in term[at:stop]],
                    "docs": n_docs[at:stop], "sizes": size[at:stop].astype(np.int32), "names": [sources[g] for g in used],
                    "sources": local.astype(np.int32), "counts": count[own]}


def _indexer(shards: int):
    schema = pa.schema([
        ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def spilled(block: Block) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in block.run(shards):
            rows.append(row)
            held += len(row["counts"])
            if held >= 200_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            langs, sources, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                block.add(langs[i].as_py(), sources[i].as_py(), texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"")
                if block.full():
                    yield from spilled(block)
                    block = Block()
        yield from spilled(block)
    return run


class Cursor:
    """Where the merge stands in one row of a run."""

    __slots__ = ("at", "counts", "docs", "ends", "names", "sources", "terms")

    def __init__(self, row: dict):
        self.at, self.terms, self.docs, self.names = 0, row["terms"], row["docs"], row["names"]
        self.sources, self.counts = row["sources"], row["counts"]
        self.ends = [0, *np.cumsum(row["sizes"]).tolist()]


def merge(rows: Iterator[dict], least_docs: int) -> Iterator[tuple]:
    """Frequencies ``lang, term, n_docs, sources, counts`` from rows sorted by (shard, language, first term).

    A heap holds the rows that reach over the current term, at most one or two of each run.
    """
    heap, part, serial = [], None, 0

    def drained(limit: bytes | None) -> Iterator[tuple]:
        while heap and (limit is None or heap[0][0] < limit):
            term, total, found = heap[0][0], 0, {}
            while heap and heap[0][0] == term:
                _, number, cursor = heap[0]
                at = cursor.at
                total += cursor.docs[at]
                for i in range(cursor.ends[at], cursor.ends[at + 1]):
                    name = cursor.names[cursor.sources[i]]
                    found[name] = found.get(name, 0) + cursor.counts[i]
                cursor.at = at + 1
                if at + 1 < len(cursor.terms):
                    heapq.heapreplace(heap, (cursor.terms[at + 1], number, cursor))
                else:
                    heapq.heappop(heap)
            if total >= least_docs:
                yield part[1], term, total, list(found), list(found.values())

    for row in rows:
        if part != (row["shard"], row["lang"]):
            yield from drained(None)
            part = row["shard"], row["lang"]
        yield from drained(row["first"])
        serial += 1
        heapq.heappush(heap, (row["first"], serial, Cursor(row)))
    yield from drained(None)


def _merger(least_docs: int):
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n_docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        held = []
        for found in merge(rows, least_docs):
            held.append(found)
            if len(held) == 8_192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    return run


def _grouped(docs: DataFrame) -> DataFrame:
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return docs.select(empty("lang"), empty("source"), "text")


def term_frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, n_docs, sources, counts``: the terms in at least ``least_docs`` documents of a language, and how often
    each source of the language holds them. Terms, null values and repeated rows as ``source_divergence`` says.

    Every task indexes its documents in memory and, when the block is full, puts it out as a run sorted by hash shard,
    language and term. The runs are shuffled by shard; one merge per shard with a heap over its runs adds them up,
    reading rows in the order of Spark's own sort. A term of every document is one entry per run and source there.
    """
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _grouped(docs).mapInArrow(_indexer(shards), RUNS)
    dealt = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(_merger(least_docs), FREQUENCIES).withColumn("term", F.col("term").cast("string"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (n + v)) by long division, three digits at a time: exact up to n + v = 9 * 10^15."""
    div = lambda a, b: F.call_function("div", a, b)
    total, rest, out = n + v, count + 1, F.lit(0).cast("bigint")
    whole, rest = div(rest, total), F.pmod(rest, total)
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, total), F.pmod(rest * 1000, total)
    return whole * SCALE + out + 1


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _share_np(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    rest, out = count + 1, np.zeros(len(count), np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole * SCALE + out + 1


class Corrections:
    """Sums over terms that two sources of a language both hold: what their shares together change in the divergence."""

    def __init__(self):
        self.number: dict[tuple[str, str], int] = {}
        self.sums: dict[int, int] = defaultdict(int)

    def add(self, a: np.ndarray, b: np.ndarray, p: list[np.ndarray]) -> None:
        pa_, pb, a0, b0 = p
        f = lambda x, y: (x - y) ** 2 // y
        code = np.concatenate([a << 32 | b, b << 32 | a])
        change = np.concatenate([f(pa_, pb) - f(pa_, b0) - f(a0, pb) + f(a0, b0), f(pb, pa_) - f(pb, a0) - f(b0, pa_) + f(b0, a0)])
        distinct, where = np.unique(code, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, change)
        for c, t in zip(distinct.tolist(), total.tolist()):
            self.sums[c] += t

    def rows(self) -> list[tuple[str, str, str, int]]:
        name = list(self.number)
        return [(*name[c >> 32], name[c & 0xFFFFFFFF][1], t) for c, t in self.sums.items()]


def _corrector(known: dict[tuple[str, str], tuple[int, int]] | None):
    """``known``: (language, source) -> (n, v); None where the rows bring ``ns`` and ``v`` along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Corrections()
        for batch in batches:
            langs, sizes = batch.column("lang").to_pylist(), np.diff(batch.column("sources").offsets.to_numpy())
            names, counts = batch.column("sources").flatten().to_pylist(), batch.column("counts").flatten().to_numpy()
            own = list(zip(np.repeat(np.array(langs, object), sizes).tolist(), names))
            number = np.array([sums.number.setdefault(g, len(sums.number)) for g in own], np.int64)
            if known is None:
                total = batch.column("ns").flatten().to_numpy() + np.repeat(batch.column("v").to_numpy(), sizes)
            else:
                total = np.array([sum(known[g]) for g in sums.number], np.int64)[number]
            share, zero = _share_np(counts, total), _share_np(np.zeros_like(counts), total)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for k in np.unique(sizes[sizes > 1]):
                first = starts[sizes == k]
                rows = max(1, PAIRS // int(k))
                for i in range(int(k) - 1):  # the i-th source of each term with all later ones
                    for at in range(0, len(first), rows):
                        a = np.repeat(first[at : at + rows] + i, k - 1 - i)
                        b = (first[at : at + rows, None] + np.arange(i + 1, k)[None, :]).ravel()
                        sums.add(number[a], number[b], [share[a], share[b], zero[a], zero[b]])
            if len(sums.sums) > PAIRS:
                yield _as_batch(sums.rows())
                sums = Corrections()
        yield _as_batch(sums.rows())
    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("change", pa.int64())]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _corrections(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, change`` in parts to be summed. Groups are looked up in the tasks if they are few."""
    terms = kept.where(F.size("sources") > 1)
    few = groups.select("lang", "source", "n", "v").limit(SMALL_GROUPS + 1).collect()
    if len(few) <= SMALL_GROUPS:
        known = {(r.lang, r.source): (r.n, r.v) for r in few}
        return terms.select("lang", "sources", "counts").mapInArrow(_corrector(known), "lang string, source string, item string, change bigint")
    entries = terms.select("lang", "term", F.inline(F.arrays_zip("sources", "counts"))).withColumnRenamed("sources", "source").join(groups, ["lang", "source"])
    rows = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "counts", "n")).alias("e"), F.first("v").alias("v"))
    return rows.select("lang", F.col("e.source").alias("sources"), F.col("e.counts").alias("counts"), F.col("e.n").alias("ns"), "v").mapInArrow(
        _corrector(None), "lang string, source string, item string, change bigint")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's word use lies from others and from its language's.

    A null text, language or source counts as ''. Terms are runs of ASCII letters (lower-cased) and characters above
    ASCII; a language keeps the terms in at least ``least_docs`` of its rows, so repeated rows count each. A group's
    share of a kept term is p = 1 + floor(10^9 (count + 1) / (N + V)), with its occurrences N of all V kept terms; the
    divergence of p from q is floor((p - q)^2 / q). Part ``pair`` has one row for each other source of the language,
    with the divergence from it summed over all kept terms (0 without any); part ``term`` the ``term_ranks`` terms the
    source holds whose share exceeds the language's by most. Ties go to the smaller item. Integers throughout; other
    columns are not used; an empty table gives no rows.

    A pair's sum starts from the value of terms neither source holds, adds what each source's own counts change
    against a zero count of the other (by a histogram of its counts), and streams the kept terms once for corrections
    of those that both hold. Its work grows with the pairs of sources a term has, as its result does with pairs.
    """
    kept = stage(term_frequencies(docs, least_docs))
    entries = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("in_lang"), F.inline(F.arrays_zip("sources", "counts"))).withColumnsRenamed({"sources": "source", "counts": "n_here"})
    occurring = _grouped(docs).select("lang", "source").distinct()
    here = entries.groupBy("lang", "source").agg(F.sum("n_here").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = occurring.join(here, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v"])
    groups = stage(groups.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang"))))

    zero = F.lit(0).cast("bigint")
    own = groups.select("lang", "source", "v", F.when(F.col("v") > 0, _share(zero, F.col("n"), F.col("v"))).alias("p0"))
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    value = lambda c: c.cast("decimal(38,0)")
    pairs = own.join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(value(F.col("v")) * _divergence(F.col("p0"), F.col("q0")), value(F.lit(0))).cast("decimal(38,0)").alias("change"))
    counted = entries.groupBy("lang", "source", "n_here").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
    held = counted.select("lang", F.col("source").alias("a"), "times", _share(F.col("n_here"), F.col("n"), F.col("v")).alias("p"), _share(zero, F.col("n"), F.col("v")).alias("a0"))
    single = held.join(other.withColumnsRenamed({"item": "b", "q0": "b0"}), "lang").where("a <> b")
    unmet = lambda changed, plain: (value(F.col("times")) * (changed - plain)).cast("decimal(38,0)")
    p, a0, b0 = F.col("p"), F.col("a0"), F.col("b0")
    both_ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), unmet(_divergence(p, b0), _divergence(a0, b0)).alias("change")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), unmet(_divergence(b0, p), _divergence(b0, a0)).alias("change")))
    singles = single.select("lang", F.inline(both_ways))
    met = _corrections(kept, groups).select("lang", "source", "item", value(F.col("change")).alias("change"))
    summed = base.unionByName(singles).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("change").cast("bigint").alias("value"))

    q = _share(F.col("in_lang"), F.col("n_lang"), F.col("v"))
    above = entries.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n_here"), F.col("n"), F.col("v")).alias("p"), q.alias("q")).where("p > q")
    excess = above.select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    whole = ranked(summed).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return whole.unionByName(ranked(excess).where(F.col("rank") <= term_ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
