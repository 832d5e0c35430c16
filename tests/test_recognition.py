"""Settings, recognisers, JPEG, what reviewers see, and scoring of a labelled folder."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf import engines, evaluation, settings
from ledgerleaf.functions import jpeg
from ledgerleaf.operators import pages, review
from ledgerleaf.sources import recognition as R
from ledgerleaf.sources.files import images


def test_settings(spark):
    got = settings.load(None, {"DEFAULT_ENGINE": " Other ", "DESKEW": "off", "OCR_LANGUAGES": "EN, ,ar", "LLM_API_KEY": "k", "UNKNOWN": "1", "AMOUNT_TOLERANCE": "0.5"})
    assert (got.default_engine, got.deskew, got.languages, got.amount_tolerance) == ("other", False, ["en", "ar"], 0.5)
    assert got.models_enabled and got.api_key("openai") == "k" and "'k'" not in repr(got) and not got.persistence_enabled
    assert settings.load(None, {}) == settings.Settings() and not settings.Settings().models_enabled
    for bad in ({"DESKEW": "maybe"}, {"PDF_DPI": "x"}):
        with pytest.raises(ValueError):
            settings.load(None, bad)
    spark.conf.set("ledgerleaf.pdf_dpi", "150")
    try:
        assert settings.load(spark, {"PDF_DPI": "200"}).pdf_dpi == 150
    finally:
        spark.conf.unset("ledgerleaf.pdf_dpi")


QUAD = [[10, 20], [50, 20], [50, 40], [10, 40]]
SHOP = ("Shop", 0.9, [10.0, 20.0, 50.0, 40.0])


@pytest.mark.parametrize(
    "payload, found",
    [
        ([[[QUAD, ("Shop", 0.9)]]], [SHOP]),
        ([[QUAD, ("Shop", 90)], [QUAD, ("B", None)]], [SHOP, ("B", None, SHOP[2])]),
        ([{"rec_texts": ["Shop", "B"], "rec_scores": [0.9], "rec_polys": np.array([QUAD])}], [SHOP, ("B", None, None)]),
        ({"rec_texts": ["Shop"], "rec_scores": [0.9], "dt_polys": [[50, 40, 10, 20]]}, [SHOP]),
        ([[QUAD, "Shop", 0.9]], [SHOP]),
        ([None], []), (None, []), ([], []), ({}, []), ("text", []), ([[QUAD]], []),
    ],
)
def test_readings(payload, found):
    assert list(R.readings(payload)) == found


def test_scores_and_languages():
    assert [R.share(x) for x in ("95", 1, 1.5, "nan", "x", None)] == [0.95, 1.0, 0.015, None, None, None]
    assert R.joined_languages(["ar", "en", "ar", "tha"]) == "ara+eng+tha" and R.joined_languages([]) == "eng"
    assert R.single_language(["en", "ar"]) == "arabic" and R.single_language(["fr"]) == "en"
    assert R.outline_box("ab") is None and R.outline_box([[1, 2]]) is None and R.outline_box(None) is None


def page_rows(spark, *rows):
    return spark.createDataFrame(rows, pages.PAGE)


def test_recognise_reads_in_order(spark):
    blank = bytes(4 * 4 * 3)

    def make():
        def read(image):
            assert image.shape == (4, 4, 3)
            if image[0, 0, 0] == 9:
                raise RuntimeError("broken")
            box = lambda x, y: [[x, y], [x + 5, y + 5]]
            return [[[box(20, 10), ("B", 0.8)], [box(0, 10), ("A", 0.9)], [box(0, 50), ("low", 0.2)], [box(0, 30), ("C", None)], [box(0, 70), (" ", 1.0)]]]

        return read

    given = page_rows(spark, ("a", 1, 2, 4, 4, blank, None), ("a", 2, 2, 4, 4, blank, None), ("b", 1, 1, 4, 4, b"\x09" * 48, None), ("c", 1, 1, None, None, None, None))
    blocks = R.recognise(given, make)
    got = {(r.path, r.page, r.text, r.confidence) for r in blocks.filter("note IS NULL").collect()}
    assert got == {("a", p, t, c) for p in (1, 2) for t, c in (("A", 0.9), ("B", 0.8), ("C", None))}
    assert {(r.path, r.note) for r in blocks.filter("note IS NOT NULL").collect()} == {("b", "recogniser failed: broken"), ("c", "undecodable")}
    texts = R.texts_of_blocks(blocks)
    assert {tuple(r) for r in texts.collect()} == {("a", "A B\nC\n\nA B\nC", 0.85), ("b", None, None), ("c", None, None)}
    layers = spark.createDataFrame([("a", ["x" * 50]), ("b", [" "]), ("d", None)], "path string, texts array<string>")
    chosen = {tuple(r) for r in R.prefer_text_layer(layers, spark.createDataFrame([("a", "r", 0.5), ("b", "q", 0.7)], "path string, text string, confidence double")).collect()}
    assert chosen == {("a", "x" * 50, None), ("b", "q", 0.7), ("d", None, None)}


def test_prefix_codes():
    counts = {s: 2**s for s in range(24)}
    lengths = jpeg.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) == 1
    assert jpeg.code_lengths({0: 5, 1: 1, 2: 1}) == {0: 1, 1: 2, 2: 2}
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_jpeg_is_read_back(spark, tmp_path):
    y, x = np.mgrid[0:45, 0:61]
    smooth = np.stack([128 + 100 * np.sin(x / 30), 128 + 100 * np.cos(y / 20), (x + y) * 2], -1).clip(0, 255).astype(np.uint8)
    noise = np.random.default_rng(3).integers(0, 256, (24, 17, 3)).astype(np.uint8)
    made = {"smooth": (smooth, 95, 3), "noise": (noise, 100, 2), "white": (np.full((9, 7, 3), 255, np.uint8), 90, 0.01), "dot": (np.zeros((1, 1, 3), np.uint8), 50, 0.01)}
    for name, (image, quality, _) in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode_jpeg(image, quality))
    for r in images(spark, f"file://{tmp_path}").collect():
        image, _, most = made[r.origin.rsplit("/", 1)[1][:-4]]
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3)
        assert got.shape == image.shape and np.abs(got.astype(int) - image).mean() < most
    with pytest.raises(ValueError):
        jpeg.encode_jpeg(np.zeros((0, 4, 3), np.uint8))
    sent = pages.wire_pages(page_rows(spark, ("a", 1, 1, 45, 61, smooth.tobytes(), None), ("b", 1, 1, None, None, None, "undecodable")), longest=30)
    assert [(r.path, bytes(r.jpeg[:2])) for r in sent.collect()] == [("a", b"\xff\xd8")]


def test_review_helpers(spark):
    item = T.StructType([T.StructField("description", T.StringType()), T.StructField("total", T.DoubleType())])
    rows = spark.createDataFrame([([("a", 0.0), ("", 0.0), (None, None), (None, 2.0)],), ([],), (None,)], T.StructType([T.StructField("items", T.ArrayType(item))]))
    got = [None if r.x is None else [tuple(i) for i in r.x] for r in rows.select(review.drop_blank_items(F.col("items"), item).alias("x")).collect()]
    assert got == [[("a", None), (None, 2.0)], [], None]
    blocks = spark.createDataFrame([("a", None), ("b", 0.9), ("c", 0.1)], "text string, confidence double")
    assert [r.text for r in review.doubtful_first(blocks).collect()] == ["c", "b", "a"]


def test_evaluation(spark, tmp_path, capsys):
    docs = {"r1": {"merchant_name": "Corner Shop", "total": "115.00", "currency": "sar", "extra": 1}, "r2": {"total": 9}}
    for name, label in docs.items():
        (tmp_path / f"{name}.png").write_bytes(b"png")
        (tmp_path / f"{name}.json").write_text(json.dumps(label))
    (tmp_path / "r3.png").write_bytes(b"png")
    (tmp_path / "r1.txt").write_text("Corner Shop\nTotal 115.00 SAR\n")

    def broken(batches):
        for b in batches:
            yield b[["path"]].assign(json=None, raw_text=None, confidence=0.5, error="down")

    engines.register("broken", broken)
    try:
        out = tmp_path / "out"
        assert evaluation.main([str(tmp_path), "--doc-type", "receipt", "--engines", "traditional,broken", "--out", str(out)], spark) == 0
        said = capsys.readouterr().out
        assert "2 documents, 1 without a label" in said and "failed 2 of 2" in said and "broken: accuracy 0.0%" in said
        written = [r for f in (out / "fields").glob("*.csv") for r in csv.DictReader(f.open())]
        mine = {(r["document"], r["engine"], r["field"]): r for r in written}
        right = mine["r1.png", "traditional", "total"]
        assert (right["expected"], right["extracted"], right["correct"]) == ("115.00", "115.0", "True")
        assert mine["r1.png", "traditional", "extra"]["correct"] == "False" and mine["r1.png", "traditional", "currency"]["correct"] == "True"
        assert mine["r2.png", "traditional", "total"]["correct"] == "False" and mine["r2.png", "broken", "total"]["extracted"] == ""
        assert len([r for r in written if r["engine"] == "broken"]) == 5
        timed = engines.process(spark.createDataFrame([("a", "x")], "path string, text string"), "receipt", "broken").first()
        assert timed.duration_ms > 0 and timed.status == "failed"
    finally:
        engines._ENGINES.pop("broken")
    assert evaluation.main([str(tmp_path), "--doc-type", "receipt", "--engines", "none"], spark) == 1
    assert evaluation.main([str(tmp_path / "absent"), "--doc-type", "receipt"], spark) == 1
