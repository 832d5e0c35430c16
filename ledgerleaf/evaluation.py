"""Engines against a folder of labelled documents.

``python -m ledgerleaf.evaluation FOLDER --doc-type receipt`` scores engines on documents that have a
JSON object of the same stem beside them.  Texts come from a reader, a function (spark, samples)
that gives (path, text) and, for engines that look at images, pages; the one here takes the text
file of the same stem.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engines
from .functions.replies import flatten_json
from .operators.paths import as_json, flat_rows
from .operators.score import engine_summary, field_key, normal, weakest_fields, write_results_csv
from .sources.files import file_name, labelled, stem
from .types import DOC_TYPES

Reader = Callable[[SparkSession, DataFrame], DataFrame]


def text_files(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """(path, text) of samples (stem, path): the file ``<stem>.txt`` beside the document."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    places = samples.select(folder.alias("folder")).distinct()
    # One folder: discovery does not descend.
    found = [r.folder for r in places.limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"samples of one folder are wanted, not of {len(found)}")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(found[0])
    texts = texts.select(stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("text"))
    return samples.select("stem", "path").join(texts, "stem", "left").select("path", "text")


def _shown(leaf: Column) -> Column:
    return F.when(leaf["kind"] == "str", leaf["str"]).otherwise(as_json(leaf))


def evaluate(samples: DataFrame, texts: DataFrame, keys: list[str], doc_type: str, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, summary, weakest) of engines on samples (path, label: a JSON object as text).

    Each engine is asked once a document; its answers are written to ``out`` first and nothing is
    stored.  ``rows`` has a row for every path that the label or the answer has: (path, document,
    engine, field, expected, extracted, correct), the values as text.  A document without an answer
    counts as failed, and its labelled fields as wrong unless they are blank.
    """
    for k, key in enumerate(keys):
        engines.process(texts.join(samples.select("path"), "path", "left_semi"), doc_type, key).write.mode("overwrite").parquet(f"{out}/ordinal={k}")
    answers = samples.sparkSession.read.parquet(out).withColumn("latency_ms", F.col("duration_ms"))
    expected = samples.select(F.col("path").alias("document_path"), F.inline(flatten_json(F.col("label"))))
    # Every engine owes every sample an answer; engines are few.
    names = F.explode(F.array(*[F.lit(k.strip().lower()) for k in keys])).alias("engine")
    wanted = expected.select("document_path", names, F.col("path").alias("field"), F.col("leaf").alias("e"))
    got = flat_rows(answers.select(F.struct("path", "engine").alias("k"), "doc"), "k", "doc")
    got = got.select(F.col("k.path").alias("document_path"), "k.engine", F.col("path").alias("field"), F.col("leaf").alias("x"))
    both = wanted.join(got, ["document_path", "engine", "field"], "full_outer")
    correct = normal(F.col("e")).eqNullSafe(normal(F.col("x")))
    rows = both.select(F.col("document_path").alias("path"), file_name(F.col("document_path")).alias("document"), "engine", "field", _shown(F.col("e")).alias("expected"), _shown(F.col("x")).alias("extracted"), correct.alias("correct"))
    scored = rows.select("engine", field_key(F.col("field")).alias("field"), "correct")
    return rows, engine_summary(scored, answers), weakest_fields(scored)


def report(summary: DataFrame, weakest: DataFrame) -> list[str]:
    """Lines to print; both tables have a few rows an engine."""
    weak: dict[str, list[str]] = {}
    for r in weakest.orderBy("engine", "rank").collect():
        weak.setdefault(r.engine, []).append(f"{r.field} ({r.accuracy:.0%}, n={r.total})")
    lines = []
    for r in summary.orderBy("engine").collect():
        accuracy = "n/a" if r.accuracy is None else f"{r.accuracy:.1%}"
        latency = "n/a" if r.median_latency_ms is None else f"{r.median_latency_ms:.0f} ms"
        lines.append(f"{r.engine}: accuracy {accuracy} ({r.correct_count} of {r.field_count} fields), median latency {latency}, failed {r.failed_count} of {r.document_count}")
        if r.engine in weak:
            lines.append(f"{r.engine}: weakest {', '.join(weak[r.engine])}")
    return lines


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Score extraction engines on labelled documents.")
    parser.add_argument("folder", help="documents, each beside the JSON object of its right fields")
    parser.add_argument("--doc-type", required=True, choices=sorted(DOC_TYPES))
    parser.add_argument("--engines", default="", help="comma-separated; all that are registered if left out")
    parser.add_argument("--reader", default="ledgerleaf.evaluation:text_files", help="module:function that gives texts")
    parser.add_argument("--out", default="eval_results", help="folder for the CSV and the engines' answers")
    given = parser.parse_args(arguments)

    fail = lambda why: print(why, file=sys.stderr) or 1
    if "://" not in given.folder and not Path(given.folder).is_dir():
        return fail(f"{given.folder} is not a folder")
    known = [k for k, _ in engines.available()]
    keys = [k.strip().lower() for k in given.engines.split(",") if k.strip()] or known
    if unknown := [k for k in keys if k not in known]:
        return fail(f"unknown engines {', '.join(unknown)}; available: {', '.join(known)}")
    spark = spark or SparkSession.builder.getOrCreate()
    samples, unlabelled = labelled(spark, given.folder)
    count = samples.count()
    if not count:
        return fail(f"{given.folder} has no labelled documents: scores need JSON objects of checked fields beside them")
    module, _, name = given.reader.partition(":")
    reader: Reader = getattr(importlib.import_module(module), name)
    rows, summary, weakest = evaluate(samples, reader(spark, samples), list(dict.fromkeys(keys)), given.doc_type, f"{given.out}/answers")
    write_results_csv(rows, f"{given.out}/fields")
    print(f"{count} documents, {unlabelled.count()} without a label")
    if count < 100:
        print("under 100 documents: this tries the harness, not the engines")
    print(*report(summary, weakest), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
