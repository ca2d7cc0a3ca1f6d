"""Exact top-k search by a bit-sliced index: slices added with bitmap arithmetic, best rows picked from the top slice down."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm import vectors
from pricetide.session import stage

BLOCK_ROWS = 16_384  # distinct vectors per block of the index
QUERY_BLOCK = 512  # distinct query vectors that meet a block together
SCALE = 1024
WIDE = 2.0**31  # vectors with a component of this size or more stand in blocks of their own
LARGEST = 2.0**1000  # components beyond it count as it
LONG = 2**63


def quantised(vector: Column) -> Column:
    """floor(1024 * x) per component, as a double that holds the integer exactly (from 2^53 on every double is one)."""
    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size; numpy's own while a component is below 2^31."""
    if np.abs(values).max(initial=0) < WIDE:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and bit count per attribute, and the bitmaps: one per bit of (value - least), attributes in order."""
    low = values.min(axis=0)
    above = values - low
    bits = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
    words = -(-len(values) // 64)
    maps = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for column, n in zip(above.T, bits):
        for bit in range(n):
            packed = np.packbits(((column >> bit) & 1).astype(bool), bitorder="little")
            maps[at, : len(packed)] = packed
            at += 1
    return low, bits, maps.view(np.uint64)


def add_slices(columns: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """The sum of bitmaps, each standing for 2^weight in every row it marks: one bitmap per weight, from 0 up.

    Full adders take three bitmaps of a weight to one and a carry, all triples of a weight at once.
    """
    total, weight = [], 0
    while columns:
        maps = columns.pop(weight, np.zeros((0, words), np.uint64))
        carries = []
        while len(maps) > 1:
            third = len(maps) // 3 * 3
            if third:
                a, b, c = maps[0:third:3], maps[1:third:3], maps[2:third:3]
                half = a ^ b
                carries.append((a & b) | (half & c))
                maps = np.concatenate([half ^ c, maps[third:]])
            else:  # two are left
                carries.append(maps[:1] & maps[1:])
                maps = maps[:1] ^ maps[1:]
        total.append(maps[0] if len(maps) else np.zeros(words, np.uint64))
        if carries:
            columns[weight + 1] = np.concatenate([*carries, columns[weight + 1]] if weight + 1 in columns else carries)
        weight += 1
    return total


def top_rows(total: list[np.ndarray], rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows surely among the k largest sums, and the boundary rows that tie for the places left."""
    words = -(-rows // 64)
    tied = np.full(words, np.iinfo(np.uint64).max, np.uint64)
    if rows % 64:
        tied[-1] = np.uint64((1 << rows % 64) - 1)
    sure = np.zeros(words, np.uint64)
    for bitmap in reversed(total):
        ones = tied & bitmap
        if int(np.bitwise_count(sure | ones).sum()) >= k:
            tied = ones
        else:
            sure |= ones
            tied = tied & ~bitmap
    numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return numbers(sure), numbers(tied)


def search_block(low, bits, maps, rows: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sure and boundary rows of one query: |q_d| times the attribute's slices, complemented where q_d is negative."""
    ends = np.cumsum(bits)
    columns: dict[int, list[int]] = {}
    flipped: dict[int, list[bool]] = {}
    for d, q in enumerate(query):
        size, bit = abs(int(q)), 0
        while size:
            if size & 1:
                for j in range(int(bits[d])):
                    columns.setdefault(bit + j, []).append(int(ends[d] - bits[d] + j))
                    flipped.setdefault(bit + j, []).append(q < 0)
            size >>= 1
            bit += 1
    turn = lambda w: np.where(flipped[w], np.iinfo(np.uint64).max, 0).astype(np.uint64)[:, None]
    stacks = {w: maps[index] ^ turn(w) for w, index in columns.items()}
    return top_rows(add_slices(stacks, maps.shape[1] if len(maps) else -(-rows // 64)), rows, k)


INDEX = "dim int, shard int, low binary, bits binary, maps binary, vectors binary, ids binary, id_ends binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("first_id")
    whole = np.stack(pdf["vector"].to_list()).astype(np.float64)
    low, bits, maps = slice_block(exact(whole))
    ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
    return pd.DataFrame({
        "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "low": [low.astype(np.float64).tobytes()], "bits": [bits.tobytes()],
        "maps": [maps.tobytes()], "vectors": [whole.tobytes()], "ids": [np.concatenate(ids).tobytes()],
        "id_ends": [np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes()]})


def _search(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q1": [], "q2": [], "high": [], "low": [], "vec_id": []}
        if len(index) and len(queries):
            row, dim = index.iloc[0], int(queries["dim"].iloc[0])
            values = exact(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim))
            low, bits = np.frombuffer(row["low"], np.float64), np.frombuffer(row["bits"], np.int64)
            most = max(1, int(np.abs(values).max(initial=0)))
            maps = np.frombuffer(row["maps"], np.uint64).reshape(int(bits.sum()), -(-len(values) // 64))
            ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
            for vector, q1, q2 in zip(queries["vector"], queries["h1"], queries["h2"]):
                query = exact(np.asarray(vector, np.float64)[None, :])[0]
                fits = dim * most * int(np.abs(query).max()) < LONG
                sure, tied = search_block(low, bits, maps, len(values), query, k)
                # rows stand by least id, and a tie needs the smallest ids only
                rows = np.concatenate([sure, tied[: max(0, k - len(sure))]])
                scored = values[rows] @ query if fits else values[rows].astype(object) @ query.astype(object)
                for node, score in zip(rows, scored):
                    for vec_id in ids[ends[node - 1] if node else 0 : ends[node]]:
                        out["q1"].append(q1)
                        out["q2"].append(q2)
                        out["high"].append(min(max(int(score) // LONG, -LONG), LONG - 1))
                        out["low"].append(int(score) % LONG)
                        out["vec_id"].append(vec_id)
        return pd.DataFrame(out).astype({c: "int64" for c in out})
    return run


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: exactly the k largest integer inner products of every query row.

    Both tables have ``vec_id, embedding``; a query's own id is no candidate; ties go to the smaller id. Rows with a null
    id, and vectors that are null, empty or hold a null or non-finite component, take no part; vectors meet those of their
    own length only; repeated rows count once; other columns are not used; an empty table gives no rows. Zero vectors
    take part. Components and sums are integers of any size: order is exact up to 2^126, and a score that leaves a long is
    reported as the nearest long. Vectors with a component of 2^31 or more have blocks of their own.

    Vectors equal after quantisation are one row of the index. A block of the index keeps a bitmap per attribute and bit;
    a query's inner product is the sum of such bitmaps, and its best rows are those that remain from the highest slice of
    the sum down; rows that tie there are settled by id.
    """
    def usable(df):
        real = df.where(F.col("vec_id").isNotNull() & vectors.finite(F.col("embedding")))
        return vectors.with_digest(real.select("vec_id", quantised(F.col("embedding")).alias("vector")).distinct(), "vector")

    groups = stage(vectors.equal_vectors(usable(embeddings), k + 1))
    wide = F.exists("vector", lambda x: F.abs(x) >= WIDE)
    size = groups.agg(F.count_if(~wide).alias("plain"), F.count_if(wide).alias("wide")).first()
    plain, beyond = (math.ceil(size[c] / block_rows) for c in ("plain", "wide"))
    place = lambda n: F.pmod(F.xxhash64("h1", "h2"), F.lit(max(1, n))).cast("int")
    index = stage(
        groups.withColumn("shard", F.when(wide, F.lit(plain) + place(beyond)).otherwise(place(plain))).withColumn("first_id", F.col("ids")[0])
        .groupBy("dim", "shard").applyInPandas(_build, INDEX))
    asked = stage(usable(queries))
    asked_groups = stage(asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).withColumn("dim", F.size("vector")))
    left, right = vectors.in_blocks(index, asked_groups, max(1, plain + beyond), max(1, math.ceil(asked_groups.count() / QUERY_BLOCK)))
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k + 1), "q1 long, q2 long, high long, low long, vec_id long")
    found = found.select("q1", "q2", F.struct("high", "low").alias("score"), "vec_id")
    asking = asked.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("vec_id").alias("query_id"))
    high, low = F.col("score.high"), F.col("score.low")
    score = F.when(high == 0, low).when(high == -1, low + F.lit(-LONG)).when(high > 0, F.lit(LONG - 1)).otherwise(F.lit(-LONG))
    return vectors.top_ranks(found, asking, k).select("query_id", "rank", "vec_id", score.alias("score"))
