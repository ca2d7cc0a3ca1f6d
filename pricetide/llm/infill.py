"""Fill-in-middle: documents as piece tables, cut at token bounds, arranged anew and restored by the inverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1
TEXT, MARKS = 0, 1  # the buffers: the document, and the sentinels one after the other
PIECE = 1 << 20  # bytes of a text looked at together
# What stands where in the natural order: prefix sentinel, prefix, middle sentinel, middle, suffix sentinel, suffix.
ARRANGEMENTS = {"psm": (0, 1, 4, 5, 2, 3), "spm": (4, 5, 0, 1, 2, 3)}
# The sentinels as they follow one another in an arranged text: numbers into the natural order.
FOUND = {form: tuple(place for place in order if place % 2 == 0) for form, order in ARRANGEMENTS.items()}

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


class Table:
    """A piece table: descriptors ``(buffer, start, end)`` in bytes over buffers that never change."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    def split(self, piece: int, *ends: int) -> None:
        """Cuts one descriptor at places of its buffer."""
        buffer, start, end = self.pieces[piece]
        bounds = [start, *ends, end]
        self.pieces[piece : piece + 1] = [(buffer, a, b) for a, b in zip(bounds, bounds[1:])]

    def permuted(self, order: tuple[int, ...]) -> Table:
        return Table(self.buffers, [self.pieces[place] for place in order])

    def inverse(self, order: tuple[int, ...]) -> Table:
        back = [(0, 0, 0)] * len(order)
        for at, place in enumerate(order):
            back[place] = self.pieces[at]
        return Table(self.buffers, back)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield memoryview(self.buffers[buffer])[start:end]

    def digest(self) -> str:
        """SHA-256 of the text the descriptors spell, which is not put together for it."""
        sha = hashlib.sha256()
        for part in self.stream():
            sha.update(part)
        return sha.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


class Tokens:
    """The tokens ``[A-Za-z]+|[^A-Za-z]`` of UTF-8 text, found in pieces of bounded size: their number and their bounds."""

    def __init__(self, text: bytes):
        self.view = np.frombuffer(text, np.uint8)
        self.ends = np.cumsum([len(self._starts(at)) for at in range(0, len(self.view), PIECE)])
        self.n = int(self.ends[-1]) if len(self.ends) else 0

    def _starts(self, at: int) -> np.ndarray:
        piece = self.view[at : at + PIECE]
        letter = _LETTER[piece]
        after = np.concatenate(([at > 0 and bool(_LETTER[self.view[at - 1]])], letter[:-1]))
        return np.flatnonzero(_HEAD[piece] & ~(letter & after)) + at

    def offset(self, k: int) -> int:
        """The byte after which the first k tokens end."""
        if k >= self.n:
            return len(self.view)
        piece = int(np.searchsorted(self.ends, k, "right"))
        return int(self._starts(piece * PIECE)[k - (int(self.ends[piece - 1]) if piece else 0)])

    def characters(self, start: int, end: int) -> int:
        return sum(int(np.count_nonzero(_HEAD[self.view[at : min(end, at + PIECE)]])) for at in range(start, end, PIECE))


def _marks(sentinels: tuple[str, ...]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The sentinel buffer, and a descriptor for each sentinel.

    A sentinel must start with a character that stands nowhere else in any of them, so a text that holds none of them
    cannot make one together with its neighbour.
    """
    coded = [s.encode() for s in sentinels]
    if len(coded) != 3 or len(set(coded)) != 3 or any(not s or {x[0] for x in sentinels} & set(s[1:]) for s in sentinels):
        raise ValueError("three different sentinels, each starting with a character that stands nowhere else in them")
    ends = np.cumsum([0, *map(len, coded)])
    return b"".join(coded), [(MARKS, int(a), int(b)) for a, b in zip(ends, ends[1:])]


def natural(text: bytes, sentinels: tuple[str, ...], prefix_end: int, middle_end: int) -> Table:
    """The document cut into prefix, middle and suffix, each behind its sentinel."""
    buffer, (before_prefix, before_suffix, before_middle) = _marks(sentinels)
    table = Table((text, buffer), [(TEXT, 0, len(text))])
    table.split(0, prefix_end, middle_end)
    prefix, middle, suffix = table.pieces
    table.pieces = [before_prefix, prefix, before_middle, middle, before_suffix, suffix]
    return table


def restored(output: bytes, form: str, sentinels: tuple[str, ...]) -> Table:
    """The document as descriptors over an arranged text: sentinels found, parts split off, the permutation undone."""
    table = Table((output,), [(0, 0, len(output))])
    if form not in ARRANGEMENTS:
        return table
    coded = dict(zip((0, 4, 2), (s.encode() for s in sentinels)))
    cuts, at = [], 0
    for place in FOUND[form]:
        start = output.index(coded[place], at)
        at = start + len(coded[place])
        cuts += [start, at]
    table.split(0, *cuts)
    back = Table(table.buffers, table.pieces[1:]).inverse(ARRANGEMENTS[form])
    return Table(back.buffers, back.pieces[1::2])


def _utf8(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


_ARRANGED = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, text: string, sha256: string, pieces: array<struct<buffer: int, start: bigint, end: bigint>>>"


def _arranger(sentinels, fim_percent: int, spm_percent: int):
    marks = [s.encode() for s in sentinels]

    def one(text: bytes, h: list[int]) -> tuple:
        tokens = Tokens(text)
        n = tokens.n
        if not text or any(m in text for m in marks) or h[2] % 100 >= fim_percent:
            form, table, chars = "plain", Table((text,), [(TEXT, 0, len(text))]), (None, None)
        else:
            form = "spm" if h[3] % 100 < spm_percent else "psm"
            first, second = (tokens.offset(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
            table = natural(text, sentinels, first, second).permuted(ARRANGEMENTS[form])
            chars = tokens.characters(0, first), tokens.characters(first, second)
        return n, form, *chars, table.bytes(), table.digest(), [{"buffer": b, "start": s, "end": e} for b, s, e in table.pieces]

    @F.arrow_udf(_ARRANGED)
    def arrange(texts: pa.Array, draws: pa.Array) -> pa.Array:
        rows = [one(_utf8(t), h.as_py()) for t, h in zip(texts, draws)]
        columns = list(zip(*rows)) if rows else [()] * 7
        piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), piece]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, names=["n", "form", "prefix_chars", "middle_chars", "text", "sha256", "pieces"])
    return arrange


def _restorer(sentinels):
    @F.arrow_udf("struct<text: string, sha256: string>")
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        tables = [restored(_utf8(o), f.as_py(), sentinels) for o, f in zip(outputs, forms)]
        return pa.StructArray.from_arrays(
            [pa.array([t.bytes() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.digest() for t in tables], pa.string())], names=["text", "sha256"])
    return restore


def fill_in_middle(
    docs: DataFrame, sentinels: tuple[str, ...] = SENTINELS, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED,
) -> DataFrame:
    """Adds ``n_tokens, form, prefix_chars, middle_chars, fim_text, fim_sha256, fim_pieces`` to every row.

    The first four 8-digit groups of the SHA-256 of ``seed:doc_id`` draw, in order, the two cuts (between any two of
    the n tokens, or at an end), whether the document is rearranged, and which of the two forms it takes: ``psm`` is
    prefix, suffix, middle; ``spm`` is suffix, prefix, middle; each part follows its sentinel. A text that is empty or
    holds a sentinel stays ``plain``. A null text counts as empty; a null id is replaced by the text's digest, so rows
    of null id and equal text agree, as do repeated rows. ``fim_pieces`` are the descriptors in their order: buffer 0
    is the document, buffer 1 the sentinels joined. Whole texts of any length are cut, in pieces of bounded size. Other
    columns are kept, columns of the output names replaced; an empty table stays empty. One row is one piece of work,
    nothing is shuffled.
    """
    _marks(sentinels)
    docs = common.without(docs, "n_tokens", "form", "prefix_chars", "middle_chars", "fim_text", "fim_sha256", "fim_pieces")
    names = docs.columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), common.record_key(F.col("doc_id"), F.col("text"))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])
    arranged = docs.withColumn("_fim", _arranger(sentinels, fim_percent, spm_percent)("text", draws))
    return arranged.select(
        *names, F.col("_fim.n").alias("n_tokens"), "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", F.col("_fim.text").alias("fim_text"),
        F.col("_fim.sha256").alias("fim_sha256"), F.col("_fim.pieces").alias("fim_pieces"))


def restore(arranged: DataFrame, text: str = "fim_text", form: str = "form", sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Adds ``restored_text, restored_sha256``, from the arranged text and its form alone.

    The inverse of ``fill_in_middle`` with the same sentinels: an empty document comes back as empty text.
    """
    arranged = common.without(arranged, "restored_text", "restored_sha256")
    names = arranged.columns
    return arranged.withColumn("_back", _restorer(sentinels)(text, form)).select(
        *names, F.col("_back.text").alias("restored_text"), F.col("_back.sha256").alias("restored_sha256"))
