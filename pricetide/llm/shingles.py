"""Word shingle sets of single texts as sorted 64-bit hashes; numpy inside tasks."""

from __future__ import annotations

import numpy as np

# Words are runs of bytes other than these (space and the five ASCII controls from tab to carriage return).
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A text is hashed in pieces of about this many bytes, cut between words.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(factors)
    return have


def _piece_words(piece: np.ndarray) -> np.ndarray:
    inside = ~WHITE[piece]
    edges = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers("up", BASE, len(piece))[: len(piece)], out=sums[1:])
    value = (sums[end] - sums[start]) * _powers("down", INVERSE, len(piece) + 1)[start]
    return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word of the whole text, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    parts, at = [], 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and not WHITE[data[stop]]:
            stop += 1
        parts.append(_piece_words(data[at:stop]))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``words`` words; a shorter text is one run, none without words."""
    hashes = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes
    span = min(words, len(hashes))
    out = np.zeros(len(hashes) - span + 1, np.uint64)
    factor = int(BASE)
    for offset in range(span):
        out += hashes[offset : offset + len(out)] * np.uint64(factor)
        factor = factor * int(BASE) % (1 << 64)
    return np.unique(mix(out))
