"""Operator 7: benchmark decontamination by a broadcast hash set of test n-grams.

The windows of ``size`` consecutive words of every test item (all its words, if they are fewer) go
into a hash set of distinct (window, item) rows, counted first; a set beyond ``limit`` rows is cut
into blocks, fetched, broadcast and freed one after another.  Each block scans the texts as they
came, what it finds is written, and the findings of all blocks are brought together by row before
anything is cut or dropped: results do not depend on ``limit``.  Documents are hashed where Arrow
holds them; a bit table turns away nearly all windows, binary search most others, and what is left
is compared word by word with the item's own text.

Null and empty texts have no words.  Repeated rows and null ids are reported row by row; of a null
item_id only its windows count.  Items with the same window all count as found.  Very long texts
take time in proportion to their length.  Empty tables: no documents give no rows, and an empty
benchmark contaminates nothing.  Other columns are ignored, and kept by ``remove_contamination``,
where n_chars, if there, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialise, release, table
from .textkit import ALNUM, FOLD, text_buffer, windows, words_of

SIZE = 10
#: (window, item) rows that one broadcast set may hold: about 100 MB at 10 words of 6 letters.
LIMIT = 1_000_000

_BITS = 22


class NgramSet:
    """Windows of test items by length, in flat arrays: hashes in order, the words of each, its items."""

    def __init__(self, grams: pa.Table):
        """grams: (n words, the words joined by a space, item) rows, distinct."""
        names = grams.column("item").combine_chunks().dictionary_encode()
        self.items: list[str | None] = [*names.dictionary.to_pylist(), None]
        item = names.indices.fill_null(len(self.items) - 1).to_numpy(zero_copy_only=False)
        lengths, spelled = grams.column("n").to_numpy(), grams.column("words").combine_chunks()
        self.sets = {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            data, offsets = text_buffer(spelled.take(pa.array(own)).cast(pa.string()))
            h, _, _, first = words_of(data, offsets, ALNUM)
            every = windows(h, n)[first[:-1]]
            order = np.argsort(every, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[every & np.uint64((1 << _BITS) - 1)] = True
            self.sets[n] = every[order], data.copy(), offsets[order], offsets[order + 1], item[own][order], bits

    def hits(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each window of the texts that is in the set."""
        for n, (known, spelled, low, high, item, bits) in self.sets.items():
            got = windows(h, n)
            at = np.flatnonzero(bits[got & np.uint64((1 << _BITS) - 1)])
            place = np.searchsorted(known, got[at])
            found = place < len(known)
            found[found] = known[place[found]] == got[at[found]]
            at, place = at[found], place[found]
            # A window lies in one text.
            text = np.searchsorted(first, at, "right")
            inside = at + n <= first[np.minimum(text, len(first) - 1)]
            for i, k in zip(at[inside].tolist(), place[inside].tolist()):
                words = b" ".join(FOLD[data[a:b]].tobytes() for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist()))
                items, same = [], None
                while k < len(known) and known[k] == got[i]:
                    if spelled[low[k] : high[k]].tobytes() == words:
                        same = True
                        items.append(self.items[item[k]])
                    k += 1
                if same:
                    yield i, n, items


def benchmark_grams(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(n, words, item) of each window of each item of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            _, start, end, first = words_of(data, offsets, ALNUM)
            rows = []
            for item, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                words = [FOLD[data[s:e]].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
                n = min(size, len(words))
                rows += [(n, b" ".join(words[i : i + n]), item) for i in range(len(words) - n + 1) if n]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())], names=["n", "words", "item"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "n int, words binary, item string")


HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(items: DataFrame, size: int, limit: int) -> Iterator[tuple[int, Broadcast]]:
    """(number of blocks, block) one after another; the driver and the executors hold one at a time."""
    spark = items.sparkSession
    grams = materialise(benchmark_grams(items, size).distinct())
    parts = -(-grams.count() // limit) or 1
    block = F.pmod(F.xxhash64("words", "item"), F.lit(parts))
    for i in range(parts):
        yield parts, spark.sparkContext.broadcast(NgramSet(grams.filter(block == i).toArrow()))
    release(grams)


def _covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs of words, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(batch: pa.RecordBatch, grams: NgramSet):
    """(bytes, offsets, word starts, word ends, first words, runs by row, items by row)."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
    h, start, end, first = words_of(data, offsets, ALNUM)
    runs: dict[int, list] = {}
    items: dict[int, set] = {}
    for i, n, found in grams.hits(data, h, start, end, first):
        row = int(np.searchsorted(first, i, "right")) - 1
        runs.setdefault(row, []).append((i, i + n))
        items.setdefault(row, set()).update(x for x in found if x is not None)
    return data, offsets, start, end, first, runs, items


def _report(batch: pa.RecordBatch, grams: NgramSet) -> list[pa.Array]:
    """n_words, items and spans of each row."""
    _, _, _, _, first, runs, got = _scan(batch, grams)
    base = first[:-1].tolist()
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.array([sorted(got.get(i, ())) for i in range(len(batch))], pa.list_(pa.string())),
        pa.array([[{"start": a - f, "end": b - f} for a, b in _covered(runs.get(i, []))] for i, f in enumerate(base)], _SPANS),
    ]


def _found_by_blocks(keyed: DataFrame, key: str, blocks: Iterator[Broadcast]) -> DataFrame:
    """(key, items, spans) of the rows of ``keyed`` (a written table of key and text) that any block
    hits, brought together; spans are disjoint and in order."""
    parts = None

    def found(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, items, spans = _report(batch, held.value)
                hit = pa.array([len(x) > 0 for x in spans.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), items, spans], names=[key, "items", "spans"]).filter(hit)

        return keyed.mapInArrow(run, f"{key} long, items array<string>, spans array<struct<start:long,end:long>>")

    for held in blocks:
        part = materialise(found(held))
        held.destroy()
        parts = part if parts is None else parts.unionAll(part)
    lists = parts.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _covered([(x["start"], x["end"]) for x in own])] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], names=[key, "items", "spans"])

    return lists.mapInArrow(joined, f"{key} long, items array<string>, spans array<struct<start:long,end:long>>")


def find_contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """Per row of (doc_id, text): words, hit words, items that occur, and the runs of hit words."""
    bounded_batches(docs.sparkSession)
    blocks = _blocks(items, size, limit)
    parts, held = next(blocks)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("n_hit")
    if parts == 1:
        next(blocks, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_report(batch, held.value)], names=["doc_id", "n_words", "items", "spans"])

        found = source.mapInArrow(run, "doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>")
        return found.select("doc_id", "n_words", hit, "items", "spans")

    keyed = materialise(source.withColumn("row_key", F.monotonically_increasing_id()))
    found = _found_by_blocks(keyed.select("row_key", "text"), "row_key", _rest(held, blocks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = words_of(*text_buffer(batch.column(1)), ALNUM)[3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), batch.column(2)], names=["doc_id", "n_words", "row_key"])

    rows = keyed.mapInArrow(count, "doc_id long, n_words long, row_key long").join(found, "row_key", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.select("doc_id", "n_words", none("items", "array<string>"), none("spans", "array<struct<start:long,end:long>>")).select("doc_id", "n_words", hit, "items", "spans")


def _rest(held: Broadcast, blocks: Iterator[tuple[int, Broadcast]]) -> Iterator[Broadcast]:
    yield held
    for _, more in blocks:
        yield more


def remove_contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, limit: int = LIMIT, drop_from: float = 0.5) -> DataFrame:
    """``docs`` without the hit passages; a document of which ``drop_from`` of the words or more are
    hit, goes whole.  Rows without a hit come back as they are."""
    bounded_batches(docs.sparkSession)
    blocks = _blocks(items, size, limit)
    parts, held = next(blocks)
    if parts > 1:
        return _cut_merged(docs, _rest(held, blocks), drop_from)
    next(blocks, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, start, end, first, runs, _ = _scan(batch, held.value)
            yield _cut(batch, data, offsets, start, end, first, {row: _covered(own) for row, own in runs.items()}, drop_from)

    return docs.mapInArrow(run, docs.schema)


def _cut(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, runs: dict[int, list[tuple[int, int]]], drop_from: float) -> pa.RecordBatch:
    """The batch without the disjoint ``runs`` of words of its rows."""
    if not runs:
        return batch
    keep, new = np.ones(len(batch), bool), {}
    for row, spans in runs.items():
        if sum(b - a for a, b in spans) >= drop_from * (first[row + 1] - first[row]):
            keep[row] = False
            continue
        at, parts = int(offsets[row]), []
        for a, b in spans:
            parts.append(data[at : start[a]].tobytes())
            at = int(end[b - 1])
        new[row] = b"".join([*parts, data[at : int(offsets[row + 1])].tobytes()]).decode("utf-8", "replace")
    i = batch.schema.get_field_index("text")
    texts = batch.column(i).to_pylist()
    for row, t in new.items():
        texts[row] = t
    columns = list(batch.columns)
    columns[i] = pa.array(texts, batch.schema.field(i).type)
    k = batch.schema.get_field_index("n_chars")
    if k >= 0 and pa.types.is_integer(batch.schema.field(k).type):
        sizes = batch.column(k).to_pylist()
        for row, t in new.items():
            sizes[row] = len(t)
        columns[k] = pa.array(sizes, batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))


def _cut_merged(docs: DataFrame, blocks: Iterator[Broadcast], drop_from: float) -> DataFrame:
    """Each block scans the texts as they came; a row's runs of all blocks are cut at once."""
    key, spans = fresh(docs, "row_key"), fresh(docs, "hit_spans")
    source = materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    found = materialise(_found_by_blocks(source.select(key, F.col("text").cast("string").alias("text")), key, blocks).select(key, F.col("spans").alias(spans)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(batch.schema) - 1).to_pylist()
            batch = batch.select(list(range(len(batch.schema) - 1)))
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            _, start, end, first = words_of(data, offsets, ALNUM)
            runs = {row: [(x["start"] + int(first[row]), x["end"] + int(first[row])) for x in s] for row, s in enumerate(own) if s}
            yield _cut(batch, data, offsets, start, end, first, runs, drop_from)

    return source.join(found, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(spans)).mapInArrow(run, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_N = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_N}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_N}') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {SIZE}) AS n, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g),
win AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, win.n, p, item_id FROM win JOIN g USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
