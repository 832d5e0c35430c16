"""Operator 5: line dedup by winnowing over line hashes.

A document is its sequence of lines that have a word; a line's hash is that of its words, without
regard to the case of A-Z or to spacing.  A gram is the shortest run of lines from a given one on
with at least ``gram_words`` words.  From the grams that end within ``window_words`` words of a
line (at least the line's own), the one of least hash is selected: so two documents that share a
run of at least ``window_words`` words have a selected gram of that run in common.

The earliest holder of each gram (by doc_id, then line) is its origin.  Every later occurrence is
matched with the origin, one pair an occurrence, and extended over equal lines in both
directions; what the pair has in common is a later repeated run and is deleted.  A deleted line
always has an equal one at an earlier place, so the first of them stays.

Others may share more with an occurrence than its origin does: they end beside the same line of the
origin and go on with the same next line.  The occurrences of such an edge are matched with the
earliest of them in the same way, and so on until no two occurrences share an edge.  So whatever
any earlier document shares around a gram is deleted, still at one pair an occurrence and round.

Null and empty texts come back as they are; rows of a null doc_id are neither matched nor changed.
Rows that repeat a doc_id and its text count as one document and are changed alike; rows that
repeat a doc_id with other texts are documents of their own, in an order given by the texts' hashes.
Very long texts cost their length.  Of equal hashes in a window the first line's is selected.  An
empty table gives an empty result.  Other columns are kept by ``drop_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialise, release, sized, table
from .textkit import NOT_SPACE, mix, text_buffer, words_of

GRAM_WORDS = 25
WINDOW_WORDS = 50

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, words, line number) of every line with a word, and the first such line of each text."""
    h, start, _, first = words_of(data, offsets, NOT_SPACE)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, start)
    text = np.searchsorted(first, np.arange(len(h)), "right") - 1
    heads = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[heads, len(h)])
    place = (np.arange(len(h)) - np.repeat(heads, count)).astype(np.uint64)
    with np.errstate(over="ignore"):
        lines = mix(np.add.reduceat(mix(h + place * _ODD), heads) + count.astype(np.uint64))
    before = np.searchsorted(breaks, offsets[:-1])
    return lines, count, number[heads] - before[text[heads]], np.searchsorted(heads, first)


def winnow(lines: np.ndarray, words: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, hash) of the selected grams of one text."""
    n = len(lines)
    total = np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(total, total[:n] + gram_words)  # a gram is lines i .. ends[i] - 1
    full = int(np.searchsorted(ends, n, "right"))
    if not full:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.empty(full, np.uint64)
    size = ends[:full] - np.arange(full)
    with np.errstate(over="ignore"):
        # All grams at once, by how many lines they have.
        for k in range(int(size.max())):
            own = np.flatnonzero(size > k)
            grams[own] = mix((grams[own] if k else np.uint64(0)) * _ODD + lines[own + k])
    # The last gram of each window: the last that ends within window_words, the line's own at least.
    reach = np.searchsorted(total, total[:full] + window_words, "right") - 1
    last = np.maximum(np.arange(full), np.searchsorted(ends[:full], reach, "right") - 1)
    picked = {int(i + np.argmin(grams[i : j + 1])) for i, j in enumerate(last.tolist())}
    at = np.array(sorted(picked), np.int64)
    return at, grams[at]


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text) of the rows that have an id; a version is a hash of the text."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).filter("doc_id IS NOT NULL")


def fingerprints(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(gram, doc_id, version, line) of the selected grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, _, first = line_hashes(*text_buffer(batch.column(2)))
            count, at, grams = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                where, h = winnow(lines[a:b], words[a:b], gram_words, window_words)
                count.append(len(where))
                at.append(where)
                grams.append(h)
            if count:
                keys = [pa.array(np.repeat(batch.column(k).to_numpy(), count)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), *keys, pa.array(np.concatenate(at))], names=["gram", "doc_id", "version", "line"])

    return _source(docs).mapInArrow(run, "gram long, doc_id long, version long, line long")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, version, hashes, words, numbers): each document's lines, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, numbers, first = line_hashes(*text_buffer(batch.column(2)))
            cut = pa.array(first.astype(np.int32))
            columns = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (lines.view(np.int64), words.astype(np.int32), numbers.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "version", "hashes", "words", "numbers"])

    return _source(docs).mapInArrow(run, "doc_id long, version long, hashes array<long>, words array<int>, numbers array<int>")


_RUNS = "doc_id long, version long, first int, last int, right boolean, origin long, origin_version long, beside long, next long, line long"


_DOC, _ORIGIN = ["doc_id", "version"], ["origin", "origin_version"]


def _extend(pairs: DataFrame, gram_words: int) -> DataFrame:
    """(doc_id, version, first, last): the runs (as lines of the text) around the seeds of each pair; and in
    rows without those, their edges: (right, origin, the origin's line beside it, hash of the next
    line, that line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731,B023
            own, other, words, numbers, seeds = (column(k) for k in ("hashes", "other", "words", "numbers", "seeds"))
            documents, origins = (list(zip(*(column(k).to_pylist() for k in x))) for x in (_DOC, _ORIGIN))
            sides = column("right").to_pylist()
            for i, (doc, shift) in enumerate(zip(documents, column("shift").to_pylist())):
                a, b = own[i].values.to_numpy(), other[i].values.to_numpy()
                # Lines of the document that lie beside a line of the origin.
                low, high = max(0, shift), min(len(a), len(b) + shift)
                differ = np.flatnonzero(a[low:high] != b[low - shift : high - shift]) + low
                at = np.unique(np.searchsorted(differ, seeds[i].values.to_numpy()))
                bounds = np.r_[low - 1, differ, high]
                for start, stop in zip(bounds[at] + 1, bounds[at + 1]):
                    if int(words[i].values.to_numpy()[start:stop].sum()) >= gram_words:
                        n = numbers[i].values.to_numpy()
                        rows.append((*doc, int(n[start]), int(n[stop - 1]), None, None, None, None, None, None))
                        for right, line in ((False, int(start) - 1), (True, int(stop))):
                            if 0 <= line < len(a) and sides[i] in (None, right):
                                rows.append((*doc, None, None, right, *origins[i], line - shift, int(a[line]), line))
            columns = list(zip(*rows)) or [()] * 10
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _RUNS.split(", ")])

    return pairs.mapInArrow(run, _RUNS)


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, version, gone): the later repeated runs of each document as (first, last) line
    numbers, written."""
    if not 0 < gram_words <= window_words:
        raise ValueError("a window must hold a gram")
    marks, key = materialise(fingerprints(docs, gram_words, window_words)).withColumn("right", F.lit(None).cast("boolean")), ["gram"]
    lines, runs, edges_of, used = None, [], [], []
    while True:
        # One pair for each later occurrence, never pairs among the occurrences.
        place = [*_DOC, "line"]
        origins = marks.groupBy(*key).agg(F.min(F.struct(*place)).alias("o"), F.count("*").alias("held")).filter("held > 1").select(*key, "o")
        later = marks.join(origins, key).filter(F.struct(*place) != F.col("o"))
        shift = (F.col("line") - F.col("o.line")).alias("shift")
        pairs = materialise(later.groupBy(*_DOC, F.col("o.doc_id").alias("origin"), F.col("o.version").alias("origin_version"), shift, "right").agg(F.collect_set("line").alias("seeds")))
        used.append(pairs)
        if lines is None:
            # Whatever is matched later on has been matched, or been an origin, at first.
            both = materialise(pairs.select(*_DOC).unionAll(pairs.select(*_ORIGIN)).distinct())
            lines = materialise(line_table(docs).join(both, _DOC, "left_semi").dropDuplicates(_DOC))
            used += [both, lines]
        elif pairs.isEmpty():
            break
        other = lines.select(*[F.col(k).alias(o) for k, o in zip(_DOC, _ORIGIN)], F.col("hashes").alias("other"))
        got = materialise(_extend(pairs.join(lines, _DOC).join(other, _ORIGIN), gram_words))
        runs.append(got)
        key = ["right", *_ORIGIN, "beside", "next"]
        edges = got.filter("first IS NULL").select(*key, *_DOC, "line").distinct()
        # Each edge is followed once, with all that share it; so rounds end for text of one repeated line too.
        for seen in edges_of:
            edges = edges.join(seen, [*key, *_DOC, "line"], "left_anti")
        new = materialise(edges)
        edges_of.append(new)
        if new.isEmpty():
            break
        marks = edges_of[0]
        for more in edges_of[1:]:
            marks = marks.unionAll(more)
        if len(edges_of) > 1:
            marks = marks.join(new.select(*key).distinct(), key, "left_semi")
    found = runs[0]
    for more in runs[1:]:
        found = found.unionAll(more)
    out = materialise(found.filter("first IS NOT NULL").groupBy(*_DOC).agg(F.collect_set(F.struct("first", "last")).alias("gone")))
    release(*used, *runs, *edges_of)
    return out


def _kept_lines(text: Column, gone: Column) -> Column:
    inside = lambda i: F.exists(gone, lambda r: (i >= r["first"]) & (i <= r["last"]))
    return F.filter(F.split(text, "\n"), lambda x, i: ~inside(i))


def _with_runs(docs: DataFrame, gram_words: int, window_words: int) -> tuple[DataFrame, str]:
    """``docs`` with the runs that go from each row, and the name of that column."""
    key, version, gone = fresh(docs, "repeats_of"), fresh(docs, "repeats_version"), fresh(docs, "repeated_runs")
    runs = repeated_runs(docs, gram_words, window_words).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("gone").alias(gone))
    runs = sized(runs, 1 + F.size(gone))
    return docs.join(runs, (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version)), "left"), gone


def drop_repeats(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without later repeated runs.  n_chars, if there, follows the text.  A document that
    loses lines and has no word left goes, unless ``drop_emptied`` is false."""
    joined, gone = _with_runs(docs, gram_words, window_words)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col("text"), F.col(gone)), "\n"))
    out = joined.withColumn("text", text)
    if drop_emptied:
        out = out.filter(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = [f for f in docs.schema.fields if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")]
    if size:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(size[0].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many of them are deleted, and what is left of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, gone = _with_runs(docs, GRAM_WORDS, WINDOW_WORDS)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    left = F.when(F.col(gone).isNull() | F.col("text").isNull(), lines).otherwise(F.size(_kept_lines(F.col("text"), F.col(gone))))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col("text"), F.col(gone)), "\n"))
    return joined.select("doc_id", lines.cast("long").alias("n_lines"), (lines - left).cast("long").alias("n_deleted"), kept.alias("text"))
