"""Recognised text of page images, by recognisers that are plugged in.

A recogniser is made once a partition (so it may load its models first) and answers a page's pixels
with a payload; ``readings`` takes the payloads of the common ones apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text_layer
from ..operators import layout

Reading = tuple[str, float | None, list[float] | None]
BLOCK = "path string, page int, seq long, text string, confidence double, bbox array<double>, note string"

#: Three-letter codes of languages whose recognition data bear those.
LANGUAGE_DATA = {"ar": "ara", "en": "eng", "fr": "fra", "de": "deu", "es": "spa", "tr": "tur", "ur": "urd", "fa": "fas"}


def joined_languages(languages: list[str]) -> str:
    """Languages for a recogniser that takes several, each once and in order; English if none."""
    return "+".join(dict.fromkeys(LANGUAGE_DATA.get(x, x) for x in languages if x)) or "eng"


def single_language(languages: list[str]) -> str:
    """For one that takes a single language: the Arabic models read Latin script too."""
    return "arabic" if "ar" in languages else "en"


def share(score: Any) -> float | None:
    """A score as a share; percentages are scaled, what is no number is None."""
    try:
        value = float(score)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(value) else value / 100 if value > 1 else value


def outline_box(outline: Any) -> list[float] | None:
    """[x0, y0, x1, y1] of two or more points, or of a flat box whose corners may be swapped."""
    try:
        points = np.asarray(outline, dtype=float)
    except (TypeError, ValueError):
        return None
    if points.shape == (4,):
        points = points.reshape(2, 2)
    if points.ndim != 2 or min(points.shape) < 2:
        return None
    return [*points[:, :2].min(axis=0).tolist(), *points[:, :2].max(axis=0).tolist()]


def _line(x: Any) -> Reading | None:
    """``[outline, (text, score)]`` or ``[outline, text, score]``; scores may be left out."""
    if not isinstance(x, (list, tuple)) or len(x) < 2:
        return None
    said = x[1] if isinstance(x[1], (list, tuple)) else x[1:]
    if not said or not isinstance(said[0], str):
        return None
    return said[0], share(said[1]) if len(said) > 1 else None, outline_box(x[0])


def readings(payload: Any) -> Iterator[Reading]:
    """Text, score and box of each line: payloads are lines, lists of them at any depth (None for a
    page without text), or dicts of parallel lists."""
    if isinstance(payload, dict):
        outlines = payload.get("rec_polys")
        outlines = payload.get("dt_polys") if outlines is None else outlines
        at = lambda values, i: values[i] if values is not None and i < len(values) else None
        for i, text in enumerate(payload.get("rec_texts") or ()):
            yield str(text), share(at(payload.get("rec_scores"), i)), outline_box(at(outlines, i))
    elif (line := _line(payload)) is not None:
        yield line
    elif isinstance(payload, (list, tuple)):
        for part in payload:
            yield from readings(part)


def recognise(pages: DataFrame, make: Callable[[], Callable[[np.ndarray], Any]], floor: float = layout.CONFIDENCE_FLOOR) -> DataFrame:
    """The blocks (``BLOCK``) of rows (path, page, height, width, data), data in blue, green, red
    order.  Blank blocks and those under the floor go.  A page that cannot be read, and one whose
    recogniser fails, give a single row without text and a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for batch in batches:
            rows = []
            for path, page, height, width, data in batch.itertuples(index=False, name=None):
                if data is None:
                    rows.append((path, page, 0, None, None, None, "undecodable"))
                    continue
                try:
                    read = read or make()
                    image = np.frombuffer(data, np.uint8).reshape(int(height), int(width), -1)
                    rows += [(path, page, i, *found, None) for i, found in enumerate(readings(read(image)))]
                except Exception as why:  # noqa: BLE001 - a plug-in's failure is a row
                    rows.append((path, page, 0, None, None, None, f"recogniser failed: {why}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "page", "seq", "text", "confidence", "bbox", "note"]).astype({"confidence": "float64"})

    found = pages.select("path", "page", "height", "width", "data").mapInPandas(run, BLOCK)
    # Frames carry a missing score as NaN.
    found = found.withColumn("confidence", F.nullif(F.col("confidence"), F.lit(float("nan"))))
    return found.filter(F.col("note").isNotNull() | layout.confident(F.col("text"), F.col("confidence"), floor))


def texts_of_blocks(blocks: DataFrame) -> DataFrame:
    """(path, text, confidence): each document in reading order; without text, null and null."""
    read = blocks.filter("text IS NOT NULL")
    ordered = layout.reading_order(read.withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    sure = read.groupBy("path").agg(layout.overall_confidence(F.col("text"), F.col("confidence")).alias("confidence"))
    return blocks.select("path").distinct().join(ordered, "path", "left").join(sure, "path", "left")


def prefer_text_layer(layers: DataFrame, recognised: DataFrame) -> DataFrame:
    """(path, text, confidence) of documents (path, texts), texts by page: the text layer where it
    is one, with no confidence; else what was recognised."""
    layer = F.when(has_text_layer(F.col("texts")), F.array_join("texts", "\n\n"))
    both = layers.select("path", layer.alias("layer")).join(recognised.select("path", "text", "confidence"), "path", "left")
    return both.select("path", F.coalesce("layer", "text").alias("text"), F.when(F.col("layer").isNull(), F.col("confidence")).alias("confidence"))
