"""Operator 9: harmonic packing of tokenised documents into fixed-length sequences.

A document's ids are cut at reciprocals of the capacity: full sequences first, then pieces of
exactly ``capacity // k`` ids, until a rest of at most ``fine`` ids is left.  Class k holds the
pieces of between capacity/(k+1) and capacity/k ids, and k of them fill a sequence.  Workers fill
their classes independently of each other; the pieces that a worker's last, incomplete sequences
would hold (fewer than k a class, whatever the input's size) it packs first-fit, longest first.

Nulls and empty texts are the end id alone.  Repeated rows are packed as separate documents.
A null doc_id stays null.  A very long text is cut like any other, its pieces spread over workers.
Pieces of equal length keep the order of ids.  Other columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

CAPACITY = 4096
#: A rest of at most so many ids is not cut further; it wastes under fine / capacity of a sequence.
FINE = 64
#: Documents, and bytes of their texts, that one worker packs; they set the number of workers.
DOCS_PER_WORKER, BYTES_PER_WORKER = 50_000, 1 << 30
#: Pieces of text, and chunks of it, whose ids a Python worker remembers, and the longest that is
#: kept: together under some 120 MB.
REMEMBERED, LONGEST = 300_000, 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


#: Texts whose tokens end with every run of letters, digit and run of marks: no apostrophe (which
#: starts tokens like 's), no special token, and of other letters only those of Latin-1.
_NOT_PLAIN = re.compile("[^\x00-&(-~À-ÖØ-öø-ÿ]|<\\|")
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+", re.A)


class ChunkEncoder:
    """Encodes texts by the tokenizer's file, remembering the ids of the parts of texts.

    White space is dropped by the tokenizer and no token crosses it, so a text's ids are those of
    its chunks in order; in plain texts they are those of even smaller pieces, of which far fewer
    are distinct.  What is remembered is bounded; a full memory starts anew.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.long: list[str] = []  # parts not to be kept beyond one call
        self.end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_each(self, texts: list[str], into: dict[str, bytes]) -> None:
        for text, ids in zip(texts, self._ids(texts)):
            into[text] = np.array(ids, "<u4").tobytes()

    def _encode_pieces(self, new: list[str]) -> None:
        """Each piece is one word to the tokenizer, so many are encoded as one text and told apart
        by the tokens that end a word."""
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            got = np.array(ids, "<u4")
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) != len(group) or last[-1] != len(got):
                self._encode_each(group, self.pieces)
                continue
            flat, at = got.tobytes(), 0
            for piece, to in zip(group, (4 * last).tolist()):
                self.pieces[piece] = flat[at:to]
                at = to

    def _new(self, parts: list[list[str]], known: dict[str, bytes]) -> list[str]:
        wanted = set().union(*parts)
        new = list(wanted.difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(wanted)
        self.long += [x for x in new if len(x) > LONGEST]
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        plain = [not _NOT_PLAIN.search(t) for t in texts]
        parts = [_PIECE.findall(t.lower()) if p else t.encode("utf-8", "surrogatepass").split() for t, p in zip(texts, plain)]
        parts = [x if p else [c.decode("utf-8", "surrogatepass") for c in x] for x, p in zip(parts, plain)]
        self._encode_pieces(self._new([x for x, p in zip(parts, plain) if p], self.pieces))
        self._encode_each(self._new([x for x, p in zip(parts, plain) if not p], self.chunks), self.chunks)
        of_piece, of_chunk = self.pieces.__getitem__, self.chunks.__getitem__
        out = [b"".join(map(of_piece if p else of_chunk, x)) + self.end for x, p in zip(parts, plain)]
        for known in (self.pieces, self.chunks):
            for part in [x for x in self.long if x in known]:
                del known[part]
        self.long.clear()
        return out


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int | None) -> ChunkEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ChunkEncoder(path, end_id)
    return _encoders[path, end_id]


def cuts(n: int, capacity: int, fine: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > fine:
        piece = capacity // math.ceil(capacity / n)
        out.append(piece)
        n -= piece
    return out + [n] * (n > 0)


def _pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, fine: int) -> DataFrame:
    """``pieces`` with a row_key that tells rows of one id apart."""
    if capacity < 1 or fine < 1:
        raise ValueError("capacity and fine must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).fill_null("").to_pylist()
            for i in range(0, len(ids), 500):
                rows: list[tuple] = []
                for doc, key, got in zip(ids[i : i + 500], keys[i : i + 500], enc.encode(texts[i : i + 500])):
                    n, at, view = len(got) // 4, 0, memoryview(got)
                    for length in cuts(n, capacity, fine):
                        rows.append((doc, at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), n, key))
                        at += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"])

    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row_key"))
    return keyed.mapInArrow(run, PIECES + ", row_key long")


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = CAPACITY, fine: int = FINE) -> DataFrame:
    """One row per piece of each document of (doc_id, text)."""
    return _pieces(docs, tokenizer, end_id, capacity, fine).drop("row_key")


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: k to a bin in class k, then first-fit for the incomplete bins."""
    count = len(lengths)
    bins, offsets = np.zeros(count, np.int64), np.zeros(count, np.int64)
    kind = capacity // np.maximum(lengths, 1)
    order = np.argsort(kind, kind="stable")
    sorted_kind = kind[order]
    first = np.flatnonzero(np.r_[True, sorted_kind[1:] != sorted_kind[:-1]]) if count else np.zeros(0, np.int64)
    used, rest = 0, []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), count]):
        k, own = int(sorted_kind[a]), order[a:b]
        whole = len(own) // k
        full = own[: whole * k]
        if whole:
            grid = lengths[full].reshape(whole, k)
            bins[full] = used + np.repeat(np.arange(whole), k)
            offsets[full] = (np.cumsum(grid, axis=1) - grid).ravel()
            used += whole
        rest.append(own[whole * k :])
    left = np.concatenate(rest) if rest else np.zeros(0, np.int64)
    left = left[np.argsort(-lengths[left], kind="stable")]
    # Bins by free room, so that a piece finds the fullest bin that takes it at once.
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: dict[int, int] = {}
    free_mask = 0
    for i in left.tolist():
        n = int(lengths[i])
        fitting = free_mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free_mask &= ~(1 << r)
        else:
            b, r, used = used, capacity, used + 1
            held[b] = 0
        bins[i], offsets[i] = b, held[b]
        held[b] += n
        if r - n:
            room[r - n].append(b)
            free_mask |= 1 << (r - n)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = CAPACITY, fine: int = FINE, docs_per_worker: int = DOCS_PER_WORKER) -> DataFrame:
    """Pieces with their sequence and their offset in it; sequence ids are unique, not dense."""
    held = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    workers = max(1, math.ceil(held[0] / docs_per_worker), math.ceil((held[1] or 0) / BYTES_PER_WORKER))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "row_key"], kind="stable")
        bins, pdf["offset"] = fill(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins * workers + int(key[0])
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    cut = _pieces(docs, tokenizer, end_id, capacity, fine)
    # By row and place: rows of one id, and the pieces of one huge document, spread over the workers.
    worker = F.pmod(F.xxhash64("row_key", "start"), F.lit(workers)).alias("worker")
    return cut.withColumn("worker", worker).groupBy("worker").applyInPandas(run, PACKED)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
