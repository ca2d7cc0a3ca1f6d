"""Which of many terms a text holds, all looked for in one reading of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import scale

# Terms a task keeps beside its texts; more of them, or longer ones, are looked up by a join.
TERM_ROWS, TERM_BYTES = scale.BROADCAST_ROWS, 4 << 20
# Characters read at a time, those that choose where a term may begin, and the bits of that choice.
BLOCK, HEAD, MARK_BITS = 1 << 18, 4, 20
# Stands between two texts; no character has this number.
BETWEEN, POINT_BITS = 0x110000, 21


def _trie(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves by (node, character), sorted, the nodes they lead to, and the term that ends at a node (-1: none)."""
    moves, ends = {}, [-1]
    for number, term in enumerate(terms):
        node = 0
        for c in term:
            move = node << POINT_BITS | ord(c)
            if move not in moves:
                moves[move] = len(ends)
                ends.append(-1)
            node = moves[move]
        ends[node] = number
    sorted_moves = sorted(moves)
    return np.array(sorted_moves, dtype="int64"), np.array([moves[m] for m in sorted_moves], dtype="int64"), np.array(ends, dtype="int64")


def _heads(points: np.ndarray) -> Iterator[np.ndarray]:
    """For 1 to HEAD characters the spot of what begins at each place; what would leave ``points`` has none."""
    mixed = np.zeros(len(points) + 1, dtype="uint32")
    for n in range(HEAD):
        mixed = (mixed[:-1] + points[n:]) * np.uint32(2654435761)
        yield mixed >> np.uint32(32 - MARK_BITS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def term_finder(terms: DataFrame):
    """A function of a text column: the distinct terms (column ``term``, none empty) that lie anywhere in it, as an array.

    None where the terms are too many to be kept beside the texts. A text is read once for any number of terms: places whose
    first characters begin some term are found for a whole block of texts, and those walk the terms' trie together.
    """
    wanted = scale.cut_lineage(terms.select("term").where("term <> ''").distinct())
    if not scale.is_small(wanted, TERM_ROWS, TERM_BYTES):
        return None
    words = [r["term"] for r in wanted.collect()]  # checked above
    moves, nodes, ends = _trie(words)
    sizes = {min(len(w), HEAD) for w in words}
    marks = np.zeros((HEAD + 1, 1 << MARK_BITS if words else 1), dtype=bool)
    for w in words:
        *_, spot = (s[0] for s in _heads(_points(w[:HEAD])) if len(s))
        marks[min(len(w), HEAD), spot] = True
    names = np.array(words, dtype=object)

    def held(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and term numbers of a block, by text, each pair once."""
        behind = np.cumsum([len(t) + 1 for t in block])
        points = _points("\n".join([*block, ""])).copy()
        points[behind - 1] = BETWEEN
        may = np.zeros(len(points), dtype=bool)
        for n, spots in enumerate(_heads(points), 1):
            if n in sizes:
                may[:len(spots)] |= marks[n][spots]
        start = np.flatnonzero(may)
        at, node, found = start, np.zeros(len(start), dtype="int64"), []
        while len(at):
            move = node << POINT_BITS | points[at]
            place = np.minimum(np.searchsorted(moves, move), len(moves) - 1)
            goes = moves[place] == move
            start, at, node = start[goes], at[goes] + 1, nodes[place[goes]]
            over = ends[node] >= 0
            found.append(np.searchsorted(behind, start[over], side="right") * len(words) + ends[node[over]])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype="int64")
        return pairs // max(len(words), 1), pairs % max(len(words), 1)

    @F.pandas_udf("array<string>")
    def finder(texts: pd.Series) -> pd.Series:
        out, block, size = [], [], 0
        rows = texts.fillna("").tolist()
        for i, text in enumerate(rows, 1):
            block.append(text)
            size += len(text) + 1
            if size >= BLOCK or i == len(rows):
                text_of, term_of = held(block)
                out += np.split(names[term_of], np.searchsorted(text_of, np.arange(1, len(block))))
                block, size = [], 0
        result = pd.Series([None] * len(out), dtype=object)
        result[:] = out
        return result

    return finder
