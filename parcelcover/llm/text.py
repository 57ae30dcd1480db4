"""Words and n-gram hashes of whole texts, vectorised with numpy.

A word is a run of characters other than space and U+0009 to U+000D. In UTF-8 these six are single
bytes, and ``bytes.split()`` splits at exactly them, so words are taken from the encoded text.
"""

from __future__ import annotations

import numpy as np

#: The same words in Spark's and Java's regular expressions, and what stands between them.
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"

_MULT = 0x9E3779B97F4A7C15
_SEED = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words in order; lower: A-Z become a-z, other letters stay."""
    b = encode(text)
    return (b.lower() if lower else b).split()


def _power(n: int) -> np.ndarray:
    """The first n powers; up to 65536 are kept for the next word."""
    global _powers
    if len(_powers) >= n:
        return _powers[:n]
    with np.errstate(over="ignore"):
        found = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _MULT, np.uint64))])
    if n <= 1 << 16:
        _powers = found
    return found[:n]


def free(df, name: str) -> str:
    """name, with as many underscores in front as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Each byte's random value times a power of its place in the word, summed."""
    if not ws:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(ws), np.uint8)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_SEED[data] * _power(int(lengths.max()) + 1)[place], starts)
        return mix(h + lengths.astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes; none if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(_MULT) + h[j : len(h) - n + 1 + j]
    return mix(out)


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does it occur twice or more; does it occur earlier."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(h), bool)
    later[1:] = same
    twice = later.copy()
    twice[:-1] |= same
    a, b = np.empty(len(h), bool), np.empty(len(h), bool)
    a[order], b[order] = twice, later
    return a, b


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in one of the windows of n words at starts."""
    edge = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(edge)[:total] > 0
