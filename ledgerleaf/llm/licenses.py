"""Operator 4: license scans by sparse TF-IDF cosine, with inheritance from directories.

Texts are cut into passages (lines, and sentences within them).  A passage's weights are term
counts times inverse document frequencies over the whole corpus; it carries the license whose
template has the greatest cosine with it, if that reaches ``least``.  Only words of the templates
need frequencies, so what is gathered has the size of the templates' vocabulary; a word that none of the
templates compared with has (notices or whole texts) weighs as much as one of a single document.  Passages without a rare word of a template
cannot reach ``least`` (this is checked when the weights are fitted) and are passed over.

Whole documents are compared with whole license texts in the same way, by logarithms of term counts
(else common words would make any English text resemble a long one), and blocks of several lines,
joined, with the notices.  A document that reaches ``least`` as a whole is a license file, and so is
one whose licensed passages hold at least ``file_share`` of its words; its license holds for its
directory.  A document without a license of its own inherits that of its
nearest ancestor directory, found by a join on the paths of directories.

Null and empty texts have no license of their own.  A null path is in no directory.  Repeated rows
are judged row by row, very long texts as a whole, and an empty table gives no rows.  Of equal
cosines (to nine places) passages come before blocks, then the earlier one and the first template.
Other columns are ignored.  Of several license files in one directory the one of the least path counts.
"""

from __future__ import annotations

import math
import pkgutil
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table
from .textkit import ALNUM, text_buffer, words_of

#: Notices by which works declare their licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
#: Licenses whose whole texts are at hand, in license_texts/.
WHOLE = ("Apache-2.0", "MIT", "GPL-3.0", "BSD-3-Clause", "MPL-2.0")
LEAST = 0.7
FILE_SHARE = 0.5
#: A template word that under this share of the documents has, is rare.
RARE = 0.05


def _hashes(texts: list[str]) -> list[list[int]]:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    h, _, _, first = words_of(data, offsets, ALNUM)
    return [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def whole_texts() -> dict[str, tuple[str, ...]]:
    return {name: (pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode(),) for name in WHOLE}


class Weights:
    """Template vectors under the corpus's inverse document frequencies."""

    def __init__(self, documents: int, found: dict[int, int], templates: dict[str, tuple[str, ...]], least: float, damped: bool = False):
        idf = lambda n: math.log((1 + documents) / (1 + n)) + 1
        self.other = idf(1)
        forms = [(name, words) for name, texts in templates.items() for words in _hashes(list(texts))]
        self.idf = {w: idf(found.get(w, 0)) for _, words in forms for w in words}
        self.least, self.damped = least, damped
        self.vectors: list[tuple[str, dict[int, float]]] = []
        self.postings: dict[int, list[tuple[int, float]]] = {}
        common = 0.0
        rare = {w for w in self.idf if found.get(w, 0) < RARE * documents}
        for k, (name, words) in enumerate(forms):
            raw = {w: n * self.idf[w] for w, n in self._counts(words).items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((name, {w: x / norm for w, x in raw.items()}))
            for w, x in self.vectors[-1][1].items():
                self.postings.setdefault(w, []).append((k, x))
            # The greatest cosine of a passage that has none of the rare words.
            common = max(common, math.sqrt(sum(x * x for w, x in self.vectors[-1][1].items() if w not in rare)))
        self.triggers = np.sort(np.array(list(rare if common + 1e-9 < least else self.idf), np.uint64))

    def _counts(self, words: list[int]) -> dict[int, float]:
        return {w: 1 + math.log(n) if self.damped else n for w, n in Counter(words).items()}

    def likely(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The texts that can reach ``least``: they have words of one template of enough weight."""
        vocabulary = np.sort(np.array(list(self.idf), np.uint64))
        own = np.flatnonzero(_members(h, vocabulary))
        pairs = np.unique((np.searchsorted(first, own, "right") - 1) * len(vocabulary) + np.searchsorted(vocabulary, h[own]))
        text, word = pairs // len(vocabulary), pairs % len(vocabulary)
        found = np.zeros(len(first) - 1, bool)
        for _, vector in self.vectors:
            weight = np.array([vector.get(w, 0.0) ** 2 for w in vocabulary.tolist()])
            found |= np.bincount(text, weight[word], len(first) - 1) >= self.least**2 - 1e-9
        return np.flatnonzero(found)

    def best(self, words: list[int]) -> tuple[str, float] | None:
        counts = self._counts(words)
        norm = math.sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in counts.items()))
        dots: dict[int, float] = {}
        for w, n in counts.items():
            for k, x in self.postings.get(w, ()):
                dots[k] = dots.get(k, 0.0) + n * self.idf[w] * x
        if not dots:
            return None
        # Rounded, so that ties don't hang on the order of sums.
        k = max(dots, key=lambda k: (round(dots[k] / norm, 9), -k))
        cosine = round(dots[k] / norm, 9)
        return (self.vectors[k][0], cosine) if cosine >= self.least else None


def _members(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(of, h), len(of) - 1)
    return of[at] == h


def term_counts(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[int, dict[int, int]]:
    """Documents, and how many of them have each word of the templates."""
    vocabulary = np.unique(np.array([w for texts in templates.values() for words in _hashes(list(texts)) for w in words], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            h, _, _, first = words_of(*text_buffer(batch.column(0)), ALNUM)
            own = np.flatnonzero(_members(h, vocabulary))
            text = np.searchsorted(first, own, "right")
            pairs = np.unique(text * len(vocabulary) + np.searchsorted(vocabulary, h[own]))
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            rows += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int64()), pa.array([rows, *total.tolist()], pa.int64())], names=["word", "n"])

    # One row a word of the templates reaches the driver.
    sums = {r.word: r.n for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), {int(w): sums.get(i, 0) for i, w in enumerate(vocabulary)}


OWN = "doc_id long, path string, own string, cosine double, licensed_words long, n_words long"


def own_licenses(docs: DataFrame, weights: Weights, whole: Weights) -> DataFrame:
    """Each row's whole text or best passage, and the words of all that is licensed in it."""
    held = docs.sparkSession.sparkContext.broadcast((weights, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            h, start, end, first = words_of(data, offsets, ALNUM)
            names: list = [None] * len(batch)
            cosines, covered = [0.0] * len(batch), np.zeros(len(h), bool)
            weights, whole = held.value
            hits = np.flatnonzero(_members(h, weights.triggers))
            # Passages, and blocks of lines up to an empty one.
            for parted in (_parted, _apart):
                done = -1
                for i in hits.tolist():
                    if i < done:
                        continue
                    row = int(np.searchsorted(first, i, "right")) - 1
                    low, high = int(first[row]), int(first[row + 1])
                    a, b = i, i + 1
                    while a > low and not parted(data, int(end[a - 1]), int(start[a])):
                        a -= 1
                    while b < high and not parted(data, int(end[b - 1]), int(start[b])):
                        b += 1
                    done = b
                    if (got := weights.best(h[a:b].tolist())) is not None:
                        covered[a:b] = True
                        if got[1] > cosines[row]:
                            names[row], cosines[row] = got
            for row in whole.likely(h, first).tolist():
                if (got := whole.best(h[first[row] : first[row + 1]].tolist())) is not None:
                    covered[first[row] : first[row + 1]] = True
                    names[row], cosines[row] = got
            total = np.r_[0, np.cumsum(covered)]
            covered = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array([round(c, 6) if n else None for c, n in zip(cosines, names)], pa.float64()), pa.array(covered, pa.int64()), pa.array(np.diff(first), pa.int64())],
                names=["doc_id", "path", "own", "cosine", "licensed_words", "n_words"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, OWN)


def _parted(data: np.ndarray, end: int, start: int) -> bool:
    """Whether a passage ends between two words: at a line's end, or at a full stop and a space."""
    gap = data[end:start].tobytes()
    return b"\n" in gap or (gap[:1] in (b".", b"!", b"?") and gap[1:2] in (b" ", b"\t", b"\r"))


def _apart(data: np.ndarray, end: int, start: int) -> bool:
    """Whether an empty line lies between two words, signs of a comment aside."""
    return data[end:start].tobytes().count(b"\n") > 1


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """(doc_id, path, license, cosine, basis, license_dir) of each row of (doc_id, path, text); basis:
    'own', 'directory' or null."""
    bounded_batches(docs.sparkSession)
    texts = whole_texts()
    counted = term_counts(docs, {k: (*templates.get(k, ()), *texts.get(k, ())) for k in {**templates, **texts}})
    scanned = own_licenses(docs, Weights(*counted, templates, least), Weights(*counted, texts, least, damped=True))
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    # Texts are scanned once; what follows reads the findings.
    own = materialise(scanned.withColumn("dir", parent(F.col("path"))))
    files = own.filter(F.col("own").isNotNull() & F.col("dir").isNotNull() & (F.col("licensed_words") >= file_share * F.col("n_words")))
    holders = files.groupBy("dir").agg(F.min(F.struct("path", "own")).alias("f")).select(F.col("dir").alias("holder"), F.col("f.own").alias("inherited"))
    # Directories, not documents, are joined with their ancestors ("" is the root).
    dirs = own.select("dir").distinct().filter("dir IS NOT NULL")
    parts = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    up = dirs.select("dir", F.explode(F.array_distinct(ancestors)).alias("holder"))
    nearest = up.join(holders, "holder").groupBy("dir").agg(F.max_by(F.struct("holder", "inherited"), F.length("holder")).alias("near"))
    found = own.join(materialise(nearest), "dir", "left")
    return found.select(
        "doc_id", "path",
        F.coalesce("own", "near.inherited").alias("license"),
        "cosine",
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "directory").alias("basis"),
        F.when(F.col("own").isNull(), F.col("near.holder")).alias("license_dir"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
