"""What a service offers its callers: checked requests, answered by plans.

Errors carry a code and, where one of several values was expected, these.  Answers are DataFrames;
a transport (HTTP, a queue) is the caller's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engines
from .sources.files import MAX_UPLOAD_BYTES
from .store import STATUSES, Store
from .types import DOC_TYPES, schema_for

_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


class ServiceError(ValueError):
    def __init__(self, status: int, code: str, message: str, valid: list[str] | None = None):
        super().__init__(message)
        self.status, self.code, self.valid = status, code, valid


class Service:
    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store or Store(spark, None)

    def health(self) -> dict:
        return {"status": "ok", "database": self.store.enabled, "engines": [k for k, _ in engines.available()], "doc_types": list(DOC_TYPES)}

    def _doc_type(self, name: str) -> str:
        try:
            schema_for(name)
        except ValueError as why:
            raise ServiceError(400, "unknown_doc_type", str(why), list(DOC_TYPES)) from why
        return name.strip().lower()

    def _engine(self, key: str | None) -> str | None:
        try:
            engines.get(key)
        except ValueError as why:
            raise ServiceError(400, "unknown_engine", str(why), [k for k, _ in engines.available()]) from why
        return key

    def _stored(self) -> Store:
        if not self.store.enabled:
            raise ServiceError(503, "database_disabled", "no store is configured")
        return self.store

    def _id(self, document_id: str) -> str:
        if not _UUID.fullmatch(document_id or ""):
            raise ServiceError(400, "bad_document_id", f"{document_id!r} is no document id")
        return document_id.lower()

    @staticmethod
    def rejected(files: DataFrame) -> DataFrame:
        """(path, code) of the files (path, length) that are not taken."""
        code = F.when(F.coalesce("length", F.lit(0)) == 0, "empty_file").when(F.col("length") > MAX_UPLOAD_BYTES, "file_too_large")
        return files.select("path", code.alias("code")).filter("code IS NOT NULL")

    def extract(self, texts: DataFrame, doc_type: str = "receipt", engine: str | None = None, persist: bool = True, as_of: Column | None = None) -> DataFrame:
        """Results of one engine; what was stored (with ids) if they are persisted and a store is set."""
        kind = self._doc_type(doc_type)
        made = engines.process(texts, kind, self._engine(engine), as_of)
        if not persist or not self.store.enabled:
            return made
        return self.store.save(made.withColumns({"source": F.col("path"), "fields": F.to_json("doc"), "content_hash": F.sha2(F.coalesce("raw_text", F.lit("")), 256)}))

    def compare(self, texts: DataFrame, doc_type: str, keys: str, out: str, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Comma-separated engines on the same documents; nothing is stored."""
        asked = [k.strip() for k in keys.split(",") if k.strip()]
        if len(asked) < 2:
            raise ServiceError(400, "too_few_engines", f"a comparison needs two engines or more, not {len(asked)}", [k for k, _ in engines.available()])
        kind = self._doc_type(doc_type)
        for key in asked:
            self._engine(key)
        return engines.compare(texts, kind, asked, out, as_of)

    def documents(self, status: str | None = None, doc_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        if status and status not in STATUSES:
            raise ServiceError(400, "unknown_status", f"unknown status {status!r}", list(STATUSES))
        kind = self._doc_type(doc_type) if doc_type else None
        try:
            return self._stored().list(status, kind, limit, offset)
        except ServiceError:
            raise
        except ValueError as why:
            raise ServiceError(422, "bad_page", str(why)) from why

    def document(self, document_id: str) -> DataFrame:
        """The document with its corrections."""
        found = self._stored().get(self._id(document_id))
        if found.isEmpty():
            raise ServiceError(404, "not_found", f"there is no document {document_id}")
        return found

    def approve(self, document_id: str, fields: str | None, reviewed_by: str) -> int:
        """Approve, with corrected fields (a JSON object) or as stored; how many fields changed."""
        who = (reviewed_by or "").strip()
        if not who:
            raise ServiceError(422, "no_reviewer", "a review needs a reviewer")
        store, known = self._stored(), self._id(document_id)
        self.document(known)
        seq = (store.reviews().filter(F.col("id") == known).agg(F.max("seq").alias("n")).first().n or 0) + 1
        store.approve(self.spark.createDataFrame([(known, seq, fields, who)], "id string, seq long, fields string, reviewed_by string"))
        return store.corrections().filter((F.col("id") == known) & (F.col("seq") == seq)).count()
