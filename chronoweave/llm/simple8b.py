"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A 64-bit word has a selector in its top four bits. Selectors 1..14 pack COUNTS[s] values of
BITS[s] bits each, lowest bits first; selector 15 is an escape: the next word is one raw value
of over 60 bits. Values are coded in blocks of BLOCK; each block starts on a word of its own
whose offset the file holds, so blocks decode alone or all at once. The last word of a block
is filled with zeros, which a reader drops as it knows the number of values.

File: magic, then as little-endian 64-bit integers: values, blocks, documents; block offsets in
words (blocks + 1); document ids; values per document; then the words.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE, BLOCK, MAGIC = 15, 1024, b"S8BIDS01"
NO_ID = np.iinfo(np.int64).min
_SMALL = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    if not len(v) or int(v.max()) < 1 << 16:
        return _SMALL[v]
    out = np.zeros(len(v), np.uint8)
    for shift in (0, 16, 32, 48):
        part = (v >> np.uint64(shift)).astype(np.uint64) & np.uint64(0xFFFF)
        out = np.where(part > 0, _SMALL[part] + np.uint8(shift), out)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and block offsets in words (blocks + 1)."""
    v = np.ascontiguousarray(values).astype(np.uint64)
    n = len(v)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    full = np.zeros(blocks * block, np.uint64)
    full[:n] = v
    # the greatest width of the next COUNTS[s] values of a block, from that of fewer; the largest count that fits wins
    most = np.zeros((blocks, block + 64), np.uint8)
    most[:, :block] = _widths(full).reshape(blocks, block)
    choice = np.full((blocks, block), ESCAPE, np.uint8)
    for s in range(14, 0, -1):
        more = COUNTS[s] - COUNTS[s + 1]
        if more:
            most = np.maximum(most[:, : most.shape[1] - more], most[:, more:])
        fits = most[:, :block] <= BITS[s]
        if s < 14 and not fits.any():
            break
        np.copyto(choice, s, where=fits)
    flat = choice.ravel()
    # all blocks step from word to word together
    base, pos = np.arange(blocks, dtype=np.int64) * block, np.zeros(blocks, np.int64)
    is_start = np.zeros(blocks * block, bool)
    live = np.arange(blocks)
    while len(live):
        p = base[live] + pos[live]
        is_start[p] = True
        pos[live] += COUNTS[flat[p]]
        live = live[pos[live] < block]
    start = np.flatnonzero(is_start)
    owner, sel = start // block, flat[start].astype(np.int64)
    size = 1 + (sel == ESCAPE)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([full, np.zeros(64, np.uint64)])
    limit = (owner + 1) * block
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[where[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[own] + 1] = padded[start[own]]
            continue
        w = np.full(len(own), np.uint64(s) << np.uint64(60))
        for j in range(COUNTS[s]):
            x = start[own] + j
            w |= np.where(x < limit[own], padded[x], np.uint64(0)) << np.uint64(BITS[s] * j)
        words[where[own]] = w
    offsets = np.concatenate([np.searchsorted(owner, np.arange(blocks)), [len(owner)]])
    return words, np.concatenate([where, [len(words)]])[offsets].astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """All n values of the given blocks (uint64)."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a raw word follows an escape and has no selector
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(sel == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
    else:
        raw = np.zeros(len(words), bool)
    heads = np.flatnonzero(~raw)
    s = sel[heads]
    count = COUNTS[s]
    owner = np.searchsorted(offsets, heads, side="right") - 1
    end = np.cumsum(count)
    first = np.concatenate([[0], end])[np.searchsorted(heads, offsets[:-1])]
    to = end - count - first[owner] + owner * block
    out = np.zeros((len(offsets) - 1) * block + 64, np.uint64)
    limit = (owner + 1) * block
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[to[own]] = words[heads[own] + 1]
            continue
        w, mask = words[heads[own]], np.uint64((1 << int(BITS[k])) - 1)
        for j in range(COUNTS[k]):
            x = to[own] + j
            ok = x < limit[own]
            out[x[ok]] = ((w >> np.uint64(BITS[k] * j)) & mask)[ok]
    return out[:n]


def pack_file(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    head = np.array([len(ids), len(offsets) - 1, len(doc_ids)], "<i8")
    return MAGIC + b"".join(np.ascontiguousarray(x).astype(t).tobytes() for x, t in ((head, "<i8"), (offsets, "<i8"), (doc_ids, "<i8"), (counts, "<i8"), (words, "<u8")))


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document ids, values per document)."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b id file")
    n, blocks, docs = np.frombuffer(data, "<i8", 3, 8)
    at = 32
    offsets = np.frombuffer(data, "<i8", blocks + 1, at)
    at += 8 * (blocks + 1)
    doc_ids, counts = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<i8", docs, at + 8 * docs)
    return decode(np.frombuffer(data, "<u8", -1, at + 16 * docs), offsets, int(n)), doc_ids, counts


def block_values(data: bytes, k: int) -> np.ndarray:
    """The values of block k alone, by its offset."""
    n, blocks, docs = np.frombuffer(data, "<i8", 3, 8)
    offsets = np.frombuffer(data, "<i8", blocks + 1, 32)
    words = np.frombuffer(data, "<u8", offsets[k + 1] - offsets[k], 32 + 8 * (blocks + 1) + 16 * docs + 8 * offsets[k])
    return decode(words, np.array([0, len(words)]), int(min(BLOCK, n - k * BLOCK)))
