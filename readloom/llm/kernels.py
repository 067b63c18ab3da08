"""Vectorised byte kernels (NumPy) that run inside Arrow-batched Python functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
MULT = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte windows of a uint8 array, by binary doubling of window lengths."""
    if len(data) < k:
        return np.empty(0, U)
    block = mix64(data.astype(U) + U(1))
    done, power = 1, MULT
    whole, whole_len = None, 0
    while True:
        if k & done:
            if whole is None:
                whole, whole_len = block, done
            else:
                # the window so far, then this block after it
                shift = U(pow(MULT, done, 1 << 64))
                whole = whole[: len(whole) - done] * shift + block[whole_len : whole_len + len(whole) - done]
                whole_len += done
        if done * 2 > k:
            break
        block = block[:-done] * U(power) + block[done:]
        power = power * power & MASK64
        done *= 2
    return mix64(whole[: len(data) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    length = 1
    while length * 2 <= w:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = w - length
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space), in order."""
    if not text:
        return np.empty(0, U)
    if len(text) > CHUNK:
        # Long texts are cut at white space, so the tables of powers stay small (unless one word is longer still).
        cut = next((i for i in range(CHUNK, len(text)) if SPACE[text[i]]), len(text))
        if cut < len(text):
            parts = []
            while len(text) > cut:
                parts.append(word_hashes(text[:cut]))
                text = text[cut:]
                cut = next((i for i in range(CHUNK, len(text)) if SPACE[text[i]]), len(text))
            return np.concatenate([*parts, word_hashes(text)])
    data = np.frombuffer(text, np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U)
    # A word's sum of byte * MULT^i; dividing by MULT^start makes it independent of the place.
    powers, inverses = _powers(len(data))
    total = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * powers[: len(data)])])
    return mix64((total[ends] - total[starts]) * inverses[starts] ^ mix64((ends - starts).astype(U)))


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (MULT, pow(MULT, -1, 1 << 64)):
        x = np.full(size, U(base))
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


_cached = lru_cache(1)(_make_powers)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT and its inverse to the powers 0 to n - 1 at least; only tables of ordinary size are kept."""
    return _cached(2 * CHUNK) if n <= 2 * CHUNK else _make_powers(n)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle; none has none."""
    if not len(words):
        return np.empty(0, U)
    m = min(n, len(words))
    h = words[: len(words) - m + 1].copy()
    for i in range(1, m):
        h = h * U(MULT) + words[i : len(words) - m + 1 + i]
    return np.unique(mix64(h + U(m)))
