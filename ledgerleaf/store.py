"""The review store: documents, an append-only log of reviews, and the tables read from them.

Parquet has no transactions, so a review is one row that holds its corrections: both are there or
neither.  The current state of a document is its latest review, or what was stored at first.
Without a path the store is off: reads are None and writes do nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.replies import flatten_json
from .operators.paths import as_json, diff
from .operators.rules import needs_review
from .operators.score import field_key

DOCUMENTS = (
    "id string, source string, content_hash string, doc_type string, engine string, model string, status string, fields string, raw_extraction string, "
    "raw_text string, issues string, confidence double, page_count int, duration_ms double, created_at timestamp"
)
REVIEWS = "id string, seq long, fields string, reviewed_by string, reviewed_at timestamp, doc_type string, engine string, model string, corrections array<struct<path:string,old:string,new:string>>"
#: Columns of a listing: not the texts and extractions, which are large.
LISTED = ("id", "source", "content_hash", "doc_type", "engine", "model", "status", "issues", "confidence", "page_count", "duration_ms", "created_at", "reviewed_at", "reviewed_by")
STATUSES = ("pending_review", "approved", "rejected")


def latest(reviews: DataFrame, key: str, seq: str, *columns: str) -> DataFrame:
    """(key, seq, columns, versions): the review of the highest seq of each document, and how many
    there are.  An aggregate, which combines before the shuffle; a window would not."""
    last = F.max_by(F.struct(*columns), seq).alias("r")
    return reviews.groupBy(key).agg(F.max(seq).alias(seq), last, F.count("*").alias("versions")).select(key, seq, "r.*", "versions")


def listing(rows: DataFrame, status: str | None = None, doc_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents, the newest first: a top-k, which sorts no more than it returns."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 1..200 and offset not be negative")
    if status:
        rows = rows.filter(F.col("status") == status)
    if doc_type:
        rows = rows.filter(F.col("doc_type") == doc_type)
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def with_corrections(docs: DataFrame, corrections: DataFrame, key: str, *columns: str) -> DataFrame:
    """Documents with their corrections nested, in the order of ``columns``; null if there are none."""
    made = corrections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("corrections"))
    return docs.join(made, key, "left")


def copies(rows: DataFrame, key: str, content_hash: str = "content_hash") -> DataFrame:
    """Documents (key, content_hash, copies) whose content is there more than once.  Counts combine
    before their shuffle; a very common content costs a skewed join, which AQE splits."""
    hashed = rows.select(key, content_hash)
    return hashed.join(hashed.groupBy(content_hash).agg(F.count("*").alias("copies")).filter("copies > 1"), content_hash)


def containing(rows: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """Keys of rows (key, path, leaf) that have the JSON ``value`` at ``path``."""
    return rows.filter((F.col("path") == path) & (as_json(F.col("leaf")) == value)).select(key).distinct()


def correction_rates(corrections: DataFrame, key: str) -> DataFrame:
    """Corrections and corrected documents by engine and field, items of a list as one field."""
    return corrections.groupBy("engine", field_key(F.col("path")).alias("field")).agg(F.count("*").alias("corrections"), F.count_distinct(key).alias("documents"))


class Store:
    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path.rstrip("/") if path else None

    @property
    def enabled(self) -> bool:
        return self.path is not None

    def init_schema(self) -> bool:
        """Make what is missing; False if the store is off."""
        if not self.enabled:
            return False
        for name, schema in (("documents", DOCUMENTS), ("reviews", REVIEWS)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        return True

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def save(self, results: DataFrame) -> DataFrame | None:
        """Append results (doc_type, fields, issues array, confidence and other columns of DOCUMENTS)
        and return this batch as stored.  Rows without a doc_type are refused."""
        if not self.enabled:
            return None
        if results.filter("doc_type IS NULL").limit(1).count():
            raise ValueError("a result without doc_type cannot be saved")
        have = {c.lower() for c in results.columns}
        review = needs_review(F.col("issues"), F.col("confidence") if "confidence" in have else None)
        own = {"id": F.expr("uuid()"), "status": F.when(review, "pending_review").otherwise("approved"), "issues": F.to_json("issues"), "fields": F.coalesce("fields", F.lit("{}")), "created_at": F.current_timestamp()}
        names = self.spark.createDataFrame([], DOCUMENTS).schema
        rows = results.select(*[(own[f.name] if f.name in own else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in names])
        # Ids are random: the batch is written first and read back, never computed twice.
        batch = f"{self.path}/documents/batch={uuid.uuid4().hex}"
        rows.write.parquet(batch)
        return self.spark.read.schema(DOCUMENTS).parquet(batch)

    def reviews(self) -> DataFrame:
        return self._read("reviews", REVIEWS)

    def current(self) -> DataFrame:
        """Documents as they stand after their reviews."""
        last = latest(self.reviews(), "id", "seq", "fields", "reviewed_at", "reviewed_by").select("id", F.struct("fields", "reviewed_at", "reviewed_by").alias("r"))
        docs = self._read("documents", DOCUMENTS).join(last, "id", "left")
        approved = F.when(F.col("r").isNotNull(), "approved").otherwise(F.col("status"))
        return docs.withColumns({"status": approved, "fields": F.coalesce("r.fields", "fields"), "reviewed_at": F.col("r.reviewed_at"), "reviewed_by": F.col("r.reviewed_by")}).drop("r")

    def approve(self, reviews: DataFrame) -> DataFrame | None:
        """Apply (id, seq, fields, reviewed_by), several of one document in order of seq; fields null:
        as stored.  Returns the ids that are unknown.  A review without changes approves as well."""
        if not self.enabled:
            return None
        docs = self.current().select("id", F.col("fields").alias("stored"), "doc_type", "engine", "model")
        known = reviews.join(docs, "id")
        # What a review is compared with: the one before it in the batch, else the stored state.
        order = Window.partitionBy("id").orderBy("seq")
        filled = known.withColumn("f", F.coalesce(F.last("fields", ignorenulls=True).over(order), "stored"))
        chained = filled.withColumn("before", F.coalesce(F.lag("f").over(order), "stored")).withColumn("key", F.struct("id", "seq"))
        flat = lambda c: chained.select("key", F.inline(flatten_json(F.col(c))))
        changes = diff(flat("before"), flat("f"), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "old", "new"))).alias("corrections"))
        empty = F.array().cast("array<struct<path:string,old:string,new:string>>")
        rows = chained.join(changes, "key", "left").select("id", "seq", F.col("f").alias("fields"), "reviewed_by", F.current_timestamp().alias("reviewed_at"), "doc_type", "engine", "model", F.coalesce("corrections", empty).alias("corrections"))
        rows.write.mode("append").parquet(f"{self.path}/reviews")
        return reviews.select("id").join(docs, "id", "left_anti").distinct()

    def corrections(self) -> DataFrame:
        """One row a corrected field, with the document's type and engine at the time of the review."""
        return self.reviews().select("id", "seq", "doc_type", "engine", "model", "reviewed_by", "reviewed_at", F.inline("corrections"))

    def list(self, status: str | None = None, doc_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame | None:
        if not self.enabled:
            return None
        return listing(self.current(), status, doc_type, limit, offset).select(*LISTED)

    def get(self, document_id: str) -> DataFrame | None:
        """One document with its corrections, oldest first."""
        if not self.enabled:
            return None
        of = F.col("id") == document_id
        return with_corrections(self.current().filter(of), self.corrections().filter(of), "id", "seq", "path", "old", "new", "reviewed_by")

    def duplicates(self) -> DataFrame:
        """Documents whose content was stored more than once."""
        return copies(self._read("documents", DOCUMENTS), "id")

    def containing(self, path: str, value: str) -> DataFrame:
        """Current documents whose field at ``path`` has the JSON ``value``."""
        return containing(self.current().select("id", F.inline(flatten_json(F.col("fields")))), "id", path, value)

    def correction_rates(self) -> DataFrame:
        return correction_rates(self.corrections(), "id")
