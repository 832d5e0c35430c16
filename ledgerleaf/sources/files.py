"""File sources: uploads, their triage, labelled folders, decoded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_PAGES = 20


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_pdf(path: Column, content: Column) -> Column:
    """By content or by name."""
    return (F.substring(content, 1, 4) == F.lit(b"%PDF")) | (suffix(path) == "pdf")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, content, content_hash, kind, error): files with an accepted suffix;
    oversized ones carry an error.  Spark's file sources skip files without a byte."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    kept = raw.filter(suffix(F.col("path")).isin(*SUFFIXES))
    error = F.when(F.col("length") > MAX_UPLOAD_BYTES, "file_too_large")
    kind = F.when(is_pdf(F.col("path"), F.col("content")), "pdf").otherwise("image")
    return kept.select("path", file_name(F.col("path")).alias("name"), "length", "content", F.sha2("content", 256).alias("content_hash"), kind.alias("kind"), error.alias("error"))


def labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(samples, unlabelled): documents with the JSON object of the same stem, and those without
    one that can be read; both by path."""
    files = spark.read.format("binaryFile").load(folder)
    docs = files.filter(suffix(F.col("path")).isin(*SUFFIXES)).select(stem(F.col("path")).alias("stem"), "path", "length")
    texts = files.filter(suffix(F.col("path")) == "json").select(stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("label"))
    good = texts.filter(F.coalesce(F.schema_of_variant(F.try_parse_json("label")).startswith("OBJECT"), F.lit(False)))
    samples, unlabelled = paired(docs, good, "stem")
    return samples.orderBy("path"), unlabelled.orderBy("path")


def paired(docs: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents with a label, documents without one)."""
    return docs.join(labels, key), docs.join(labels, key, "left_anti")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images, pixels in blue, green, red order; height -1 where decoding failed."""
    return spark.read.format("image").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.mode", "image.data")


def cap_pages(pages: Column, limit: int = MAX_PAGES) -> Column:
    return F.slice(pages, 1, max(1, limit))
