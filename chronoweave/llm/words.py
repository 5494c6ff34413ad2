"""Words of many texts as 64-bit hashes, all in numpy.

A word is a run of letters, digits and marks of the lower-cased text; ASCII punctuation, white
space, the Latin-1 signs (U+0080 to U+00BF) and general punctuation (U+2000 to U+207F) separate.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_WORD[0xC2] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {}
CHUNK_BYTES = 1 << 19
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", -1) < n:
        size = max(n, CHUNK_BYTES) + 1
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
        _POWERS["n"] = size - 1
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's words); null is empty."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    is_word = _WORD[data]
    lead = np.flatnonzero(data[:-1] == 0xC2)
    is_word[lead + 1] = False
    lead = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else lead[:0]
    for k in range(3):
        is_word[lead + k] = False
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the last byte is a separator
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def chunks(texts: list[str | None], size: int = CHUNK_BYTES):
    """Slices (from, to) of whole texts of about `size` characters each."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of n words, offsets of each text's runs). A text of 1 to n-1 words has one
    run, of all its words; a text without words has none."""
    count = np.diff(offsets)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(runs)])
    x = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        x = x * GOLD + words[k : len(words) - n + 1 + k] if len(x) else x
    at = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], runs) + np.repeat(offsets[:-1], runs)
    short = np.repeat((count < n) & (count > 0), runs)
    out = np.zeros(len(at), np.uint64)
    out[~short] = x[at[~short]]
    for i in np.flatnonzero((count < n) & (count > 0)):
        h = np.array([count[i]], np.uint64)
        for w in words[offsets[i] : offsets[i + 1]]:
            h = h * GOLD + w
        out[out_offsets[i]] = h[0]
    return mix(out), out_offsets
