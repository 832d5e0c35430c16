"""Model engines, their schemas and prompts, comparison of engines, the service, result files."""

import csv
import json
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerleaf import engines, models
from ledgerleaf.operators import score
from ledgerleaf.service import Service, ServiceError
from ledgerleaf.store import Store
from ledgerleaf.types import RECEIPT, json_schema

SCHEMA = {
    "title": "R", "type": "object", "$defs": {"Item": {"title": "Item", "type": "object", "properties": {"title": {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}, "sub": {"$ref": "#/$defs/Item"}}}},
    "properties": {"items": {"anyOf": [{"type": "array", "items": {"$ref": "#/$defs/Item", "description": "a line"}}, {"type": "null"}]}, "kind": {"const": "r"}, "x": {"anyOf": [{"type": "integer"}, {"type": "string"}]}},
}


def test_prompt_schema():
    got = models.prompt_schema(SCHEMA)
    item = got["properties"]["items"]["items"]
    assert list(got) == ["type", "properties"] and got["properties"]["items"]["type"] == ["array", "null"]
    assert item["description"] == "a line" and item["properties"] == {"title": {"type": ["string", "null"]}, "sub": {"type": "object"}}
    assert got["properties"]["x"] == {"anyOf": [{"type": "integer"}, {"type": "string"}]}
    assert '"type": ["array", "null"]' in models.shown(got) and json.loads(models.shown(got)) == got
    with pytest.raises(ValueError):
        models.prompt_schema({"$ref": "#/$defs/None"})


def test_narrow_schema():
    got = models.narrow_schema(SCHEMA)["properties"]
    assert got["items"]["type"] == "array" and got["items"]["nullable"] and got["kind"] == {"enum": ["r"]} and got["x"] == {"type": "integer"}
    assert got["items"]["items"]["properties"]["title"] == {"type": "string", "nullable": True}
    assert models.narrow_schema(json_schema(RECEIPT))["properties"]["total"]["nullable"] is True
    assert "anyOf" not in json.dumps(got) and "$ref" not in json.dumps(got)


def test_prompt_and_transcript():
    prompt = models.build_prompt(" Receipt ", "Shop")
    assert "receipt" in prompt and '"merchant_name"' in prompt and prompt.endswith("Shop")
    assert models.TRANSCRIPT in models.with_transcript(json_schema(RECEIPT))["properties"]
    answer = {"_transcript": ["a ", "", "b"], "total": 1}
    assert models.take_transcript(answer) == "a\n\nb" and answer == {"total": 1}
    assert [models.take_transcript(x) for x in ({}, {"_transcript": " "}, {"_transcript": 5})] == [None] * 3


def test_ask_repeats_what_may_pass():
    waits, replies = [], iter(["junk", '{"a": 1}'])
    assert models.ask(lambda *_: next(replies), "p", "s", {}, [], wait=waits.append) == {"a": 1} and waits == [1.0]
    with pytest.raises(models.ModelError):
        models.ask(lambda *_: "junk", "p", "s", {}, [], attempts=2, wait=waits.append)
    calls = []

    def broken(*_):
        calls.append(1)
        raise KeyError("key")

    with pytest.raises(KeyError):
        models.ask(broken, "p", "s", {}, [])
    assert len(calls) == 1


def test_compare_and_service(spark, tmp_path):
    def shop(prompt, system, schema, images):
        if images == [b"bad"]:
            return "no object"
        return json.dumps({"merchant_name": "Shop", "total": "5.00", "full_text": "Shop\nTotal 5", "title": "T", "_transcript": f"{len(images)} pages", "other": 1})

    as_of = F.lit("2024-06-01").cast("date")
    engines.register("model:shop", models.model_engine(shop, wait=lambda s: None))
    texts = spark.createDataFrame([("a", "Shop\nTotal $5\n2024-01-02", [b"1", b"2"]), ("b", "Shop\nTotal 5", [b"bad"]), ("c", None, None)], "path string, text string, pages array<binary>")
    got = {r.path: r for r in engines.process(texts, "receipt", "model:shop", as_of).collect()}
    assert got["a"].doc.total == 5.0 and got["a"].raw_text == "2 pages" and got["a"].status == "ok"
    assert got["b"].error.startswith("ModelError") and got["c"].error == "no_pages" and got["b"].needs_review

    service = Service(spark, Store(spark, str(tmp_path / "store")))
    service.store.init_schema()
    results, rows, shares = service.compare(texts, "document", "traditional, model:shop,model:shop", str(tmp_path / "cmp"), as_of)
    assert {r.engine for r in results.select("engine").distinct().collect()} == {"traditional", "model:shop", "model:shop#3"}
    met = {(r.source, r.path): r.agree for r in rows.collect()}
    assert met[("a", "summary")] and not met[("a", "title")] and not met[("b", "full_text")]
    assert {r.source: r.agreement for r in shares.collect()}["b"] == 0.0

    saved = {r.source: r for r in service.extract(texts, "receipt", as_of=as_of).collect()}
    assert saved["a"].status == "approved" and saved["c"].status == "pending_review"
    assert service.documents(status="pending_review").count() == 1 and service.health()["database"]
    one = saved["c"].id
    # The third change: the empty list of items is gone.
    assert service.approve(one, '{"total": 3, "merchant_name": "X"}', "me") == 3 and service.approve(one, None, "me") == 0
    assert service.document(one).first().status == "approved"
    for call, code in (
        (lambda: service.document("x"), "bad_document_id"), (lambda: service.document(str(uuid.uuid4())), "not_found"), (lambda: service.extract(texts, "memo"), "unknown_doc_type"),
        (lambda: service.extract(texts, engine="none"), "unknown_engine"), (lambda: service.compare(texts, "receipt", "traditional,", "x"), "too_few_engines"),
        (lambda: service.approve(one, None, " "), "no_reviewer"), (lambda: service.documents(limit=0), "bad_page"), (lambda: service.documents(status="x"), "unknown_status"), (lambda: Service(spark).documents(), "database_disabled"),
    ):
        with pytest.raises(ServiceError) as caught:
            call()
        assert caught.value.code == code
    assert Service.rejected(spark.createDataFrame([("a", 0), ("b", 1), ("c", 26 << 20)], "path string, length long")).count() == 2


def test_results_csv(spark, tmp_path):
    rows = spark.createDataFrame([("d", "e", "total", '5,"x"', None, False)], "document string, engine string, field string, expected string, extracted string, correct boolean")
    score.write_results_csv(rows.coalesce(1), str(tmp_path / "csv"))
    (file,) = [f for f in (tmp_path / "csv").glob("*.csv") if f.stat().st_size]
    assert list(csv.reader(file.open())) == [["document", "engine", "field", "expected", "extracted", "correct"], ["d", "e", "total", '5,"x"', "", "False"]]
