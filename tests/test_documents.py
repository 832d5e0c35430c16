import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf import engines
from ledgerleaf.functions import replies, text
from ledgerleaf.operators import coerce, layout, paths, rules
from ledgerleaf.sources import files
from ledgerleaf.store import Store
from ledgerleaf.streaming.ingest import hashed, watch
from ledgerleaf.types import DOC_TYPES, INVOICE, RECEIPT, json_schema, schema_for

GOOD = {
    "merchant_name": "Corner Shop", "receipt_number": "R-7", "date": "2024-03-14", "currency": "SAR", "subtotal": 100.0, "tax_amount": 15.0, "total": 115.0,
    "items": [{"description": "a", "quantity": 4, "unit_price": 2.5, "total": 10}, {"quantity": 1, "unit_price": 62, "total": 62}, {"quantity": 2, "unit_price": 14, "total": 28}],
}


def checked(spark, changes, doc_type="receipt", base=GOOD):
    docs = [json.dumps(base | c) if c is not None else None for c in changes]
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, raw string")
    schema = DOC_TYPES[doc_type]
    made = frame.select("i", F.when(F.col("raw").isNotNull(), coerce.coerce(F.col("raw"), schema)["doc"]).alias("doc"))
    found = made.select("i", rules.validate(F.col("doc"), doc_type, schema, F.lit("2024-06-01").cast("date")).alias("x")).orderBy("i")
    return [[(i.code, i.field) for i in r.x] for r in found.collect()]


RULE_CASES = [
    ({}, []), ({"total": 130}, ["total_mismatch"]), ({"total": 115.02}, []), ({"total": 115.03}, ["total_mismatch"]), ({"discount_total": 5, "total": 110}, []),
    ({"service_charge": 10, "tip": 5, "total": 130}, []), ({"total": None}, ["missing_required_field"]), ({"subtotal": None}, []), ({"total": 0, "subtotal": None}, []),
    ({"date": "14/03/2024"}, ["date_format"]), ({"date": "2024-02-31"}, ["date_invalid"]), ({"date": "1974-03-14"}, ["date_out_of_range"]), ({"date": "2024-07-01"}, ["date_in_future"]),
    ({"date": "2024-06-02"}, []), ({"date": "٢٠٢٤-٠٣-١٤"}, ["date_invalid"]), ({"currency": "SR"}, ["currency_format"]), ({"currency": "sar"}, ["currency_format"]), ({"merchant_name": "  "}, ["missing_required_field"]),
    ({"merchant_name": None, "merchant_name_ar": "متجر"}, []), ({"items": [{"quantity": 4, "unit_price": 2.5, "total": 4}, *GOOD["items"][1:]]}, ["lines_do_not_sum", "line_total_mismatch"]),
    ({"items": [{"quantity": None, "unit_price": 2.5, "total": 10}, *GOOD["items"][1:]]}, []), ({"items": [{"quantity": 4, "unit_price": 2.5, "total": None}, *GOOD["items"][1:]]}, []), ({"items": []}, []), (None, ["no_document"]),
]


def test_rules(spark):
    got = checked(spark, [c for c, _ in RULE_CASES])
    assert [[code for code, _ in x] for x in got] == [codes for _, codes in RULE_CASES]


def test_invoice_rules(spark):
    base = {"invoice_number": "1", "vendor_name": "v", "issue_date": "2024-01-10", "due_date": "2024-02-10", "subtotal": 2000, "tax_amount": 100, "shipping": 50, "total": 2150}
    got = checked(spark, [{}, {"due_date": "2024-01-09"}, {"due_date": "soon"}, {"due_date": "2030-01-01"}], "invoice", base)
    assert got == [[], [("due_before_issue", "due_date")], [("date_format", "due_date")], []]


def test_gate(spark):
    rows = spark.createDataFrame([(0, None), (0, 0.8), (0, 0.79), (1, 0.99)], "n int, c double")
    issues = F.array_repeat(F.lit("x"), F.col("n"))
    assert [r[0] for r in rows.select(rules.needs_review(issues, F.col("c"))).collect()] == [False, False, True, True]


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "value", "invalid"),
    [("SAR 1,234.50", 1234.5, False), ("(12.00)", -12.0, False), ("5-", -5.0, False), ("١٢٣٫٥", 123.5, False), ("1e5", 15.0, False), ("1.234,50", 1.2345, False), ("5%", 5.0, False), ("two", None, False), ("1.2.3", None, True), ("12-05", None, True), ("-", None, False), ("", None, False), ("(-5)", -5.0, False), (None, None, False)],
)
def test_to_number(spark, raw, value, invalid):
    assert tuple(one(spark, raw, text.to_number)) == (value, invalid)


@pytest.mark.parametrize(("raw", "value"), [(" a \n b ", "a b"), ("N/A", None), ("--", None), ("Not  Available", None), ("", None), ("nil s", "nil s")])
def test_to_text(spark, raw, value):
    assert one(spark, raw, text.to_text) == value


PRINTED = "Corner Shop\nSubtotal 10.00\nTax 1\nTotal 11.00\nthe end 5"


@pytest.mark.parametrize(
    ("raw", "make", "value"),
    [
        (PRINTED, text.find_amount, "11.00"), ("Grand Total\nGrand total 1,234.50\nTotal 9", text.find_amount, "1,234.50"), ("Subtotal 5", text.find_amount, None), ("الإجمالي ١٢٫٥", text.find_amount, "12.5"), ("Total 3 of 7", text.find_amount, "7"),
        ("x\nInvoice No: INV-778", text.find_label_value, "INV-778"), ("Invoice No:\nInvoice #: 5.", text.find_label_value, "5"), ("none", text.find_label_value, None),
        ("on 2024-3-5", text.find_date, "2024-03-05"), ("14/03/24", text.find_date, "2024-03-14"), ("14.03.1999", text.find_date, "1999-03-14"), ("99/99/9999", text.find_date, None), ("2024-13-40 and 1/2/71", text.find_date, "1971-02-01"), ("٢٠٢٤/٠٣/١٤", text.find_date, "2024-03-14"),
        ("total usd 5", text.find_currency, "USD"), ("$5", text.find_currency, "USD"), ("€ and $", text.find_currency, "USD"), ("XUSDX", text.find_currency, None), ("abc", text.script, "en"), ("متجر", text.script, "ar"), ("متجر a", text.script, "mixed"), ("12", text.script, None),
    ],
)
def test_text_functions(spark, raw, make, value):
    assert one(spark, raw, make) == value


def test_text_layer_and_trigrams(spark):
    pages = lambda *p: one(spark, list(p), text.has_text_layer, "array<string>")
    assert [pages("x" * 39), pages("x" * 40), pages("x" * 80, " \n"), pages("x" * 79, None), pages()] == [False, True, True, False, False]
    assert one(spark, "متجر", text.trigrams) == ["متج", "تجر"] and one(spark, "ab", text.trigrams) == []


def test_coercion_reports_and_salvages(spark):
    raw = '{"receipt_number": 12, "total": "1.2.3", "tip": true, "date": ["x"], "items": ["x", {"total": "5", "quantity": {}}, null], "extra": 1}'
    got = one(spark, raw, lambda c: coerce.coerce(c, RECEIPT))
    assert got.doc.receipt_number is None and got.doc.tip == 1.0 and [i.total for i in got.doc["items"]] == [5.0]
    assert {(i.field, i.expected) for i in got.issues} == {("date", "string_type"), ("receipt_number", "string_type"), ("total", "float_parsing"), ("items.0", "model_type"), ("items.1.quantity", "float_type"), ("items.2", "model_type")}
    for bad in ("[1]", "null", "no", ""):
        got = one(spark, bad, lambda c: coerce.coerce(c, INVOICE))
        assert got.doc is None and [i.code for i in got.issues] == ["not_an_object"]


def test_diff_classes(spark):
    cases = [(12, 12.0, True), (None, "", True), (" ", None, True), ("a", "", False), (True, 1, False), (False, None, False), ("a b", "a  b", False), (12, "12", False), ([], None, False), (0, None, False)]
    for i, (a, b, equal) in enumerate(cases):
        rows = spark.createDataFrame([(i, json.dumps({"x": a}), json.dumps({"x": b}))], "id int, a string, b string")
        flat = lambda c: rows.select("id", F.inline(replies.flatten_json(F.col(c))))  # noqa: B023,E731
        assert paths.diff(flat("a"), flat("b"), "id").isEmpty() == equal, (a, b)


def test_natural_order(spark):
    given = ["items.10.total", "items.2.total", "items", "date", "items.2"]
    rows = spark.createDataFrame([(p,) for p in given], "p string")
    assert [r.p for r in rows.orderBy(paths.natural(F.col("p"))).collect()] == ["date", "items", "items.2", "items.2.total", "items.10.total"]


def test_reading_order(spark):
    schema = "doc_id int, seq int, text string, bbox array<double>, page int"
    box = lambda x, y: [float(x), y - 5.0, x + 10.0, y + 5.0]
    drift = [(1, i, str(i), box(0, y), 1) for i, y in enumerate((10, 20, 30, 40))]
    rows = [*drift, (2, 0, "second", box(0, 10), 2), (2, 1, "first", box(0, 10), 1), (2, 2, "loose", None, 1), (3, 0, "b", box(50, 10), None), (3, 1, "a", box(5, 22), None), (4, 0, " ", box(1, 1), 1)]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r.text for r in layout.reading_order(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "0 1\n2 3", 2: "first\nloose\n\nsecond", 3: "a b"}
    narrow = layout.reading_order(spark.createDataFrame(rows, schema).filter("doc_id = 3"), 11.0).first().text
    assert narrow == "b\na"


def test_words_to_lines(spark):
    rows = [(1, 1, 1, 2, "Store", "96", 60.0, 10.0, 110.0, 30.0), (1, 1, 1, 1, "ACME", "98", 10.0, 12.0, 55.0, 28.0), (1, 1, 1, 3, "x", "-1", 0.0, 0.0, 1.0, 1.0), (1, 1, 1, 4, " ", "90", 0.0, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows, "block int, par int, line int, word int, text string, conf string, x0 double, y0 double, x1 double, y1 double").withColumn("conf", F.col("conf").cast("double"))
    r = layout.regroup_words(words).first()
    assert (r.text, round(r.conf, 6), r.x0, r.y0, r.x1, r.y1) == ("ACME Store", 0.97, 10.0, 10.0, 110.0, 30.0)


@pytest.mark.parametrize(
    ("reply", "found"),
    [('```json\n{"a": 1}\n```', {"a": 1}), ('So: {"a": "}{"} ok', {"a": "}{"}), ("[1,2,3]", None), ("null", None), ('{"a": 1', None), ("", None), (None, None), ('{"a": "متجر"}', {"a": "متجر"}), ('{x} {"b": 2}', {"b": 2}), ('```\n[1]\n``` {"c": 3}', {"c": 3})],
)
def test_replies(reply, found):
    assert replies.find_object(reply) == found


def test_comparison_of_engines(spark):
    rows = [(1, 0, "a", {"total": "5"}), (1, 1, "b", {"total": "5"}), (2, 0, "a", {"total": "5"}), (2, 1, "b", None), (3, 0, "a", {"total": "5"}), (3, 1, "b", {"total": "6"}), (4, 0, "a", {"total": "5"}), (4, 1, "b", {"total": None})]
    frame = spark.createDataFrame([(k, o, e, None if d is None else (d["total"],)) for k, o, e, d in rows], "k int, ordinal int, engine string, doc struct<total:string>")
    got = {r.k: (r.agree, r["values"]) for r in paths.compare(frame, "k").collect()}
    assert got == {1: (True, {"a": '"5"', "b": '"5"'}), 2: (False, {"a": '"5"'}), 3: (False, {"a": '"5"', "b": '"6"'}), 4: (False, {"a": '"5"', "b": None})}


def test_store(spark, tmp_path):
    off = Store(spark, None)
    assert off.init_schema() is False and off.list() is None and off.get("x") is None and off.save(spark.range(0)) is None
    store = Store(spark, str(tmp_path / "store"))
    assert store.init_schema() and store.init_schema()
    none = F.array().cast("array<struct<code:string>>")
    results = spark.createDataFrame([("receipt", '{"total": 5, "x": {"y": [1, 2]}}', "h1", 0.9), ("invoice", '{"total": 6}', "h1", 0.5)], "doc_type string, fields string, content_hash string, confidence double").withColumn("issues", none)
    saved = {r.doc_type: r for r in store.save(results).collect()}
    assert saved["receipt"].status == "approved" and saved["invoice"].status == "pending_review"
    assert store.duplicates().count() == 2 and store.list(status="pending_review").count() == 1 and store.containing("total", "6.0").count() == 1
    a = saved["receipt"].id
    reviews = spark.createDataFrame([(a, 1, '{"total": 7, "x": {"y": [1, 2]}}', "me"), (a, 2, '{"total": 7, "x": {"y": [1, 3]}}', "you"), ("nobody", 1, "{}", "me"), (saved["invoice"].id, 1, None, "me")], "id string, seq long, fields string, reviewed_by string")
    assert [r.id for r in store.approve(reviews).collect()] == ["nobody"]
    made = {(r.seq, r.path, r.old, r.new, r.doc_type) for r in store.corrections().collect()}
    assert made == {(1, "total", "5.0", "7.0", "receipt"), (2, "x.y.1", "2.0", "3.0", "receipt")}
    got = store.get(a).first()
    assert json.loads(got.fields)["x"]["y"] == [1, 3] and len(got.corrections) == 2 and got.reviewed_by == "you"
    assert store.list(status="pending_review").count() == 0
    with pytest.raises(ValueError):
        store.save(results.withColumn("doc_type", F.lit(None).cast("string")))


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in {"a.PDF": b"x", "b.png": b"%PDF-1", "c.jpg": b"", "d.txt": b"no", "e.tif": b"II"}.items():
        (folder / name).write_bytes(data)
    got = {r.name: (r.kind, r.error) for r in files.uploads(spark, str(folder)).collect()}
    assert got == {"a.PDF": ("pdf", None), "b.png": ("pdf", None), "e.tif": ("image", None)}
    (folder / "a.json").write_text('{"total": 1}')
    (folder / "b.json").write_text("[1]")
    samples, rest = files.labelled(spark, str(folder))
    assert [r.stem for r in samples.collect()] == ["a"] and sorted(r.stem for r in rest.collect()) == ["b", "e"]
    out = str(tmp_path / "out")
    for n in (6, 7):
        watch(spark, str(folder), hashed, out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == n
        (folder / "new.bin").write_bytes(b"1")


def test_process(spark):
    texts = spark.createDataFrame([("a", "Shop\nTotal $5\n2024-01-02"), ("b", ""), ("c", None)], "path string, text string")
    got = {r.path: r for r in engines.process(texts, " Receipt ", as_of=F.lit("2024-06-01").cast("date")).collect()}
    assert got["a"].doc.merchant_name == "Shop" and got["a"].doc.total == 5.0 and not got["a"].needs_review
    assert got["b"].needs_review and got["c"].needs_review

    def failing(batches):
        for pdf in batches:
            yield pdf.assign(json=None, raw_text=None, confidence=None, error="engine_failed")[["path", "json", "raw_text", "confidence", "error"]]

    engines.register("failing", failing)
    assert {(r.status, r.needs_review) for r in engines.process(texts, "invoice", "failing").collect()} == {("failed", True)}
    for bad in (lambda: engines.get("nope"), lambda: schema_for("memo")):
        with pytest.raises(ValueError):
            bad()
    assert json_schema(RECEIPT)["properties"]["items"]["items"]["properties"]["total"]["type"] == ["number", "null"]


def test_replies_nested_too_deeply_hold_no_object():
    from ledgerleaf.functions.replies import find_object, flat_object

    assert find_object('{"a":' * 200_000) is None
    assert flat_object('{"a":' * 200_000) == []
    deep = '{"a":' * 1500 + "1" + "}" * 1500
    assert [x["path"] for x in flat_object(deep)] in ([], [".".join("a" * 1500)])
    assert [x["path"] for x in flat_object('{"a": [1, {"b": null}], "c": {}}')] == ["a.0", "a.1.b", "c"]


def test_lines_follow_the_running_mean(spark):
    """The fold over line starts against a plain loop, on generated pages; loose blocks come last."""
    draw = random.Random(3)
    rows, want = [], {}
    for doc in range(30):
        blocks = [(doc, i, draw.choice(["a", "b", " c "]) + str(i), None if draw.random() < 0.1 else [float(draw.randint(0, 50)), y := float(draw.randint(0, 90)), 60.0, y + 4.0], 1) for i in range(draw.randint(0, 25))]
        placed = sorted((((b[3][1] + b[3][3]) / 2, b[3][0], b[1], b[2].strip()) for b in blocks if b[3]))
        lines, mean = [], 0.0
        for b in placed:
            if lines and abs(b[0] - mean) <= 12.0:
                mean = (mean * len(lines[-1]) + b[0]) / (len(lines[-1]) + 1)
                lines[-1].append(b[1:])
            else:
                lines.append([b[1:]])
                mean = b[0]
        if blocks:
            want[doc] = "\n".join([" ".join(t for _, _, t in sorted(x)) for x in lines] + [b[2].strip() for b in blocks if not b[3]])
        rows += blocks
    got = layout.reading_order(spark.createDataFrame(rows, "doc_id long, seq long, text string, bbox array<double>, page int"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_scores_and_boxes_of_odd_values(spark):
    scores = spark.createDataFrame([("0.5",), ("93",), ("nan",), ("x",), (None,)], "s string").select(layout.score(F.col("s")).alias("v"))
    assert [r.v for r in scores.collect()] == [0.5, 0.93, None, None, None]
    boxes = spark.createDataFrame([([[3.0, 1.0], [0.0, 7.0]],), ([],), (None,)], "p array<array<double>>").select(layout.bounding_box(F.col("p")).alias("b"))
    assert [r.b for r in boxes.collect()] == [[0.0, 1.0, 3.0, 7.0], None, None]


def test_document_diff_is_the_diff_of_rows(spark):
    kind = "k long, a struct<x:string,n:double,items:array<struct<q:double>>>, b struct<x:string,n:double,items:array<struct<q:double>>>"
    rows = [(1, ("p", 1.0, [(1.0,)]), ("p", 2.0, [(1.0,), (None,)])), (2, ("", None, []), (None, None, None)), (3, ("p", 1.0, []), None), (4, None, None)]
    docs = spark.createDataFrame(rows, kind)
    whole = paths.diff(paths.flat_rows(docs, "k", "a"), paths.flat_rows(docs, "k", "b"), "k")
    got = paths.document_diff(docs, "k", "a", "b")
    assert sorted(got.collect()) == sorted(whole.collect()) and got.count() > 0
