"""Words of many texts as numpy arrays of hashes, without a Python step a word."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the rolling hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Stands for a text's end among its words: a byte that UTF-8 doesn't have.
END_WORD = b"\xff"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), STEP)]), dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * STEP ^ (h >> np.uint64(17))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are what isn't ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    inside = ~SPACE[b]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (b[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[place]
    return mixed(np.add.reduceat(value, np.cumsum(lengths) - lengths))


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair."""
    return mixed(a * MIX + b)


def lowered(text: str | None) -> bytes:
    """The bytes of a text with A to Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower()


def cut(data: bytes, size: int = 1 << 22):
    """Pieces of about a size that end between words."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


#: The hash of the end token.
END = word_hashes(END_WORD)[0]
