"""Extraction engines as plug-ins, and the flow from uploads to gated results.

An engine is a callable on an iterator of pandas frames (path, text, pages, doc_type) that yields
frames (path, json, raw_text, confidence, error); it runs once a partition, so it may load a model
first, and reports failures in ``error`` rather than raising.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import structure
from .operators import paths
from .operators.coerce import coerce
from .operators.rules import needs_review, validate
from .settings import Settings, load
from .types import schema_for

Extract = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
EXTRACTED = "path string, json string, raw_text string, confidence double, error string"
_TIMED = f"{EXTRACTED}, duration_ms double"

_ENGINES: dict[str, tuple[Extract | None, str]] = {"traditional": (None, "patterns over the text layer; no Python")}


def register(key: str, extract: Extract, note: str = "") -> None:
    _ENGINES[key.strip().lower()] = (extract, note)


def available() -> list[tuple[str, str]]:
    return [(k, note) for k, (_, note) in _ENGINES.items()]


def get(key: str | None) -> Extract | None:
    name = (key or "traditional").strip().lower()
    if name not in _ENGINES:
        raise ValueError(f"unknown engine {key!r}; available: {', '.join(_ENGINES)}")
    return _ENGINES[name][0]


def timed(extract: Extract) -> Extract:
    """``extract`` with a column duration_ms: the time since its last frame (or since it was given
    the next batch), shared evenly by a frame's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.perf_counter()

        def fed() -> Iterator[pd.DataFrame]:
            nonlocal began
            for batch in batches:
                began = time.perf_counter()
                yield batch

        for frame in extract(fed()):
            took = 1000 * (time.perf_counter() - began)
            yield frame.assign(duration_ms=took / max(1, len(frame)))
            began = time.perf_counter()

    return run


def process(texts: DataFrame, doc_type: str, engine: str | None = None, as_of: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """(path, doc_type, engine, doc, issues, raw_text, confidence, needs_review, status, error,
    duration_ms) of each (path, text), with ``pages`` (an array of encoded images) for engines that
    read those.  The patterns run inside the plan and have no duration; settings are those of the
    session.
    Failures are rows that need a review; nothing is shuffled."""
    settings = settings or load(texts.sparkSession)
    name = (engine or settings.default_engine).strip().lower()
    schema, extract, kind = schema_for(doc_type), get(name), doc_type.strip().lower()
    if extract is None:
        rows = texts.select("path", F.to_json(structure(kind, F.col("text"))).alias("json"), F.col("text").alias("raw_text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("duration_ms"))
    else:
        pages = F.col("pages") if "pages" in texts.columns else F.lit(None)
        rows = texts.select("path", "text", pages.cast("array<binary>").alias("pages"), F.lit(kind).alias("doc_type")).mapInPandas(timed(extract), _TIMED)
    made = rows.withColumn("c", F.when(F.col("json").isNotNull() & F.col("error").isNull(), coerce(F.col("json"), schema))).withColumn("doc", F.col("c.doc"))
    found = made.withColumn("issues", validate(F.col("doc"), kind, schema, as_of, settings.amount_tolerance))
    review = F.col("error").isNotNull() | needs_review(F.col("issues"), F.col("confidence"), threshold=settings.review_confidence_threshold)
    return found.select("path", F.lit(kind).alias("doc_type"), F.lit(name).alias("engine"), "doc", "issues", "raw_text", "confidence", review.alias("needs_review"), F.when(F.col("error").isNotNull(), "failed").otherwise("ok").alias("status"), "error", "duration_ms")


def compare(texts: DataFrame, doc_type: str, keys: list[str], out: str, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, rows, agreement) of two or more engines on the same documents.

    ``results`` are those of ``process`` with the engine's place among ``keys``; they are written to
    ``out`` first, so that an engine that answers differently each time is asked once.  ``rows`` are
    (source, path, values, agree), a row a field; ``agreement`` is their share by document.  An
    engine named twice is asked twice, and its later column is called ``engine#2`` and so on.
    """
    if len(keys) < 2:
        raise ValueError(f"a comparison needs two engines or more, not {len(keys)}")
    for key in keys:
        get(key)
    for k, key in enumerate(keys):
        made = process(texts, doc_type, key, as_of)
        name = key.strip().lower() if key.strip().lower() not in [x.strip().lower() for x in keys[:k]] else f"{key.strip().lower()}#{k + 1}"
        made.withColumn("engine", F.lit(name)).write.mode("overwrite").parquet(f"{out}/ordinal={k}")
    results = texts.sparkSession.read.parquet(out)
    rows = paths.compare(results.withColumnRenamed("path", "source"), "source")
    return results, rows, paths.agreement(rows, "source")
