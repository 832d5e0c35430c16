"""Baseline JPEG, with Huffman codes made for the image at hand; NumPy only."""

from __future__ import annotations

import struct

import numpy as np

from .pixels import limit_side, to_bgr

# The quantisation tables of the JPEG standard's annex K, row by row.
LUMINANCE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""

#: Positions of a block by antidiagonals, their direction alternating.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_COSINES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.where(np.arange(8) > 0, 0.5, np.sqrt(0.125))[:, None]
_TO_YCC = np.array([[0.114, 0.587, 0.299], [0.5, -0.331264, -0.168736], [-0.081312, -0.418688, 0.5]])
#: A symbol that is never sent; it takes the code of ones only, which JPEG keeps free.
_SPARE = 256


def quantisers(quality: int) -> np.ndarray:
    """(2, 64) divisors, row by row, scaled as is common: 50 leaves the tables as they are."""
    quality = min(100, max(1, quality))
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = np.array([t.split() for t in (LUMINANCE, CHROMINANCE)], np.int64)
    return np.clip((tables * percent + 50) // 100, 1, 255)


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of the best prefix code with none above ``most``, by package-merge."""
    leaves = sorted(((n, (s,)) for s, n in counts.items()), key=lambda x: x[0])
    packed: list[tuple[int, tuple]] = []
    for _ in range(most):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packed[::2], packed[1::2])]
        packed = sorted(leaves + pairs, key=lambda x: x[0])
    lengths = dict.fromkeys(counts, 0)
    for _, symbols in packed[: 2 * len(leaves) - 2]:
        for s in symbols:
            lengths[s] += 1
    return lengths


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code, length) by symbol, and the table as JPEG writes it."""
    counts = np.bincount(symbols, minlength=_SPARE)
    lengths = code_lengths({_SPARE: 0} | {int(s): int(counts[s]) for s in np.flatnonzero(counts)})
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, before = np.zeros(_SPARE + 1, np.int64), np.zeros(_SPARE + 1, np.int64), 0
    value = 0
    for s in order:
        value <<= lengths[s] - before
        before = lengths[s]
        code[s], size[s] = value, before
        value += 1
    sent = [s for s in order if s != _SPARE]
    per_length = [sum(lengths[s] == n for s in sent) for n in range(1, 17)]
    return code, size, bytes(per_length) + bytes(sent)


def _blocks(image: np.ndarray, divisors: np.ndarray) -> np.ndarray:
    """(blocks, 3, 64) quantised coefficients in zigzag order."""
    height, width = image.shape[:2]
    padded = np.pad(image, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge").astype(np.float64)
    planes = padded @ _TO_YCC.T - np.array([128.0, 0.0, 0.0])
    rows, columns = planes.shape[0] // 8, planes.shape[1] // 8
    cut = planes.reshape(rows, 8, columns, 8, 3).transpose(0, 2, 4, 1, 3)
    waves = (_COSINES @ cut @ _COSINES.T).reshape(rows * columns, 3, 64)
    return np.rint(waves / divisors[[0, 1, 1]]).astype(np.int64)[:, :, ZIGZAG]


def _tokens(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, extra, number of extra bits) in the order of the stream; tables are 0 and 1
    for first coefficients, 2 and 3 for the others, of brightness and of colour."""
    first = blocks[:, :, 0]
    first = np.diff(first, axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    rest = blocks.reshape(-1, 64)[:, 1:]
    own, at = np.nonzero(rest)
    values = rest[own, at]
    starts = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    zeros = at - np.where(starts, -1, np.roll(at, 1)) - 1

    def bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
        return size, np.where(v < 0, v + (1 << size) - 1, v)

    n = len(first)
    first_size, first_extra = bits(first)
    size, extra = bits(values)
    # Sixteen zeros have a symbol of their own; so has the rest of a block without a value.
    long = np.repeat(np.arange(len(own)), zeros // 16)
    last = np.full(n, -1)
    last[own] = at
    ended = np.flatnonzero(last < 62)
    block = np.concatenate([np.arange(n), own[long], own, ended])
    place = np.concatenate([np.zeros(n, np.int64), 2 * at[long] + 1, 2 * at + 2, np.full(len(ended), 200)])
    symbol = np.concatenate([first_size, np.full(len(long), 0xF0), (zeros % 16) * 16 + size, np.zeros(len(ended), np.int64)])
    bare = lambda x, y: np.concatenate([x, np.zeros(len(long), np.int64), y, np.zeros(len(ended), np.int64)])
    table = (block % 3 > 0) + np.where(np.arange(len(block)) < n, 0, 2)
    order = np.lexsort((place, block))
    return table[order], symbol[order], bare(first_extra, extra)[order], bare(first_size, size)[order]


def _packed(words: np.ndarray, sizes: np.ndarray) -> bytes:
    """The lowest ``sizes`` bits of the words, one after another, filled up with ones."""
    out = []
    # In parts, as every bit takes a few words while it is moved.
    left = np.zeros(0, np.uint8)
    for i in range(0, len(words), 1 << 17):
        w, s = words[i : i + (1 << 17)], sizes[i : i + (1 << 17)]
        down = np.repeat(np.cumsum(s), s) - np.arange(int(s.sum())) - 1
        bits = np.r_[left, ((np.repeat(w, s) >> down) & 1).astype(np.uint8)]
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        left = bits[whole:]
    if len(left):
        out.append(np.packbits(np.r_[left, np.ones(8 - len(left), np.uint8)]).tobytes())
    return b"".join(out)


def encode_jpeg(image: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG of an image in blue, green, red order (or gray), colour at full resolution."""
    bgr = to_bgr(image)
    height, width = bgr.shape[:2]
    if not height or not width or max(height, width) > 65535:
        raise ValueError("a JPEG has 1 to 65535 pixels a side")
    divisors = quantisers(quality)
    table, symbol, extra, extra_bits = _tokens(_blocks(bgr, divisors))
    code, size = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    tables = []
    for k in range(4):
        own = table == k
        codes, sizes, written = _codes(symbol[own])
        code[own], size[own] = codes[symbol[own]], sizes[symbol[own]]
        tables.append(bytes([(k >> 1) << 4 | k & 1]) + written)
    stream = _packed(code << extra_bits | extra, size + extra_bits).replace(b"\xff", b"\xff\x00")
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    return b"".join([
        b"\xff\xd8",
        part(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0)),
        *[part(0xDB, bytes([k]) + bytes(divisors[k][ZIGZAG].tolist())) for k in (0, 1)],
        part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])),
        *[part(0xC4, t) for t in tables],
        part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])),
        stream,
        b"\xff\xd9",
    ])


def wire_jpeg(image: np.ndarray, longest: int = 1800, quality: int = 90) -> bytes:
    """A page as it is sent to a model."""
    return encode_jpeg(limit_side(image, longest), quality)
