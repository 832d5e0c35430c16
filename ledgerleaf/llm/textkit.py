"""Vectorised word hashing over Arrow string buffers.

Texts of a batch are hashed where Arrow holds them, without building Python strings.  A word's
hash goes over its bytes in blocks of eight, all words at once, with a non-linear bit mixer between
blocks; so words of up to eight bytes and equal length never collide, and no algebraic structure of
longer ones carries over.  Words of over LONG bytes go through keyed BLAKE2 one by one.  Work
proceeds in segments of about SEGMENT bytes, cut at document ends or between words, so memory does
not follow the length of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
LONG = 64
_KEY = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, is_word: np.ndarray) -> int:
    """The first place from ``at`` on that lies in no word."""
    end = int(offsets[np.searchsorted(offsets, at)])
    while at < end:
        stop = min(at + 65536, end)
        free = np.flatnonzero(~is_word[data[at:stop]])
        if len(free):
            return at + int(free[0])
        at = stop
    return end


def _word_hashes(part: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    folded = np.zeros(len(part) + 8, np.uint8)
    folded[:-8] = FOLD[part]
    block_at = np.ndarray(len(part) + 1, "<u8", folded.data, 0, (1,))
    size = last - first
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * _KEY + _KEY)
    own, at, left = None, first, np.minimum(size, LONG)
    while len(at):
        block = block_at[at] & _MASKS[np.minimum(left, 8)]
        if own is None:
            h = mix(h ^ block)
        else:
            h[own] = mix(h[own] ^ block)
        on = np.flatnonzero(left > 8)
        own, at, left = (on if own is None else own[on]), at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        held = hashlib.blake2b(folded[first[i] : last[i]].data, digest_size=8, key=b"ledgerleaf")
        h[i] = int.from_bytes(held.digest(), "little")
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of every word, and for each text the index of its first word
    (with one more entry at the end).  Hashes ignore the case of A-Z."""
    hashes, starts, ends, pos, total = [], [], [], 0, len(data)
    while pos < total:
        stop = total if pos + SEGMENT >= total else _cut(data, offsets, pos + SEGMENT, is_word)
        part = data[pos:stop]
        word = is_word[part]
        inner = offsets[np.searchsorted(offsets, pos, "right") : np.searchsorted(offsets, stop, "left")] - pos
        flag = np.zeros(len(part) + 1, bool)
        flag[0], flag[1:-1] = word[0], word[1:] & ~word[:-1]
        flag[inner] |= word[inner]
        first = np.flatnonzero(flag[:-1])
        flag[:] = False
        flag[-1], flag[1:-1] = word[-1], word[:-1] & ~word[1:]
        flag[inner] |= word[inner - 1] if len(inner) else False
        last = np.flatnonzero(flag)
        hashes.append(_word_hashes(part, first, last))
        starts.append(first + pos)
        ends.append(last + pos)
        pos = stop
    join = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words has its whole sequence as one."""
    every = windows(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            got = np.sort(every[a : b - size + 1])
            keep = np.ones(len(got), bool)
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code point offsets of the byte offsets ``at`` (ascending) of one text."""
    at = np.asarray(at, np.int64)
    if not len(at):
        return at
    lead = (data[: at[-1]] & 0xC0) != 0x80
    counts = np.add.reduceat(lead, np.r_[0, at[:-1]], dtype=np.int64) if len(lead) else np.zeros(len(at), np.int64)
    if len(lead):
        empty = np.diff(np.r_[0, at]) == 0
        counts[empty] = 0
    return np.cumsum(counts)
