"""Page images: geometry, lighting, encoding, TIFF frames, and the operators on tables of pages."""

import struct
import zlib

import numpy as np
import pytest

from ledgerleaf.functions import pixels
from ledgerleaf.operators import pages
from ledgerleaf.sources import files


def printed(height=600, width=440, margin=60) -> np.ndarray:
    page = np.full((height, width, 3), 245, np.uint8)
    for y in range(margin, height - margin, 24):
        page[y : y + 10, margin : width - margin] = 20
    return page


def tiff(frames: list[np.ndarray], packing: int = 1) -> bytes:
    """A little-endian TIFF of RGB frames in one strip each."""
    out = bytearray(b"II*\0" + struct.pack("<I", 0))
    link = 4
    for f in frames:
        body = f[..., ::-1].tobytes()
        body = zlib.compress(body) if packing == 8 else body
        strip = len(out)
        out += body
        bits = len(out)
        out += struct.pack("<3H", 8, 8, 8)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, 1, f.shape[1]), (257, 4, 1, f.shape[0]), (258, 3, 3, bits), (259, 3, 1, packing), (262, 3, 1, 2), (273, 4, 1, strip), (277, 3, 1, 3), (278, 4, 1, f.shape[0]), (279, 4, 1, len(body))]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


@pytest.mark.parametrize("lean", [-9.0, -3.0, 2.0, 8.0])
def test_deskew_undoes_a_rotation(lean):
    turned = pixels.rotate(printed(), lean)
    assert pixels.ink_angle(turned) == pytest.approx(-lean, abs=0.6)
    assert abs(pixels.ink_angle(pixels.deskew(turned))) < 0.6


def test_deskew_declines():
    straight, blank = printed(), np.full((200, 200, 3), 255, np.uint8)
    assert pixels.deskew(straight) is straight
    assert pixels.deskew(blank) is blank
    steep = pixels.rotate(printed(), 25)
    assert pixels.deskew(steep) is steep


def test_rotation_grows_the_canvas_and_fills_with_paper():
    page = printed()
    turned = pixels.rotate(page, 10)
    assert turned.shape[0] > page.shape[0] and turned.shape[1] > page.shape[1]
    assert all(np.array_equal(turned[y, x], [245, 245, 245]) for y in (0, -1) for x in (0, -1))
    assert np.array_equal(pixels.rotate(page, 0), page)


def test_crop_finds_a_sheet_on_a_desk():
    desk = np.full((700, 560, 3), 60, np.uint8)
    desk[60:640, 70:490] = 240
    desk[200:210, 120:400] = 10
    got = pixels.crop_to_document(desk)
    assert got.shape[0] == pytest.approx(580, abs=12) and got.shape[1] == pytest.approx(420, abs=12)
    assert np.median(got) == 240


def test_crop_declines():
    frame = printed()
    frame[20:580, 20:24] = frame[20:580, 416:420] = frame[20:24, 20:420] = frame[576:580, 20:420] = 0
    small_sheet = np.full((400, 400, 3), 40, np.uint8)
    small_sheet[150:230, 150:230] = 250
    for image in (frame, printed(), small_sheet, np.full((300, 300, 3), 9, np.uint8), np.zeros((20, 90, 3), np.uint8)):
        assert pixels.crop_to_document(image) is image


def test_four_point_orders_corners_and_declines_lines():
    image = np.arange(100 * 100 * 3, dtype=np.uint32).reshape(100, 100, 3).astype(np.uint8)
    quad = np.array([[60, 70], [20, 10], [60, 10], [20, 70]])
    assert pixels.order_corners(quad).tolist() == [[20, 10], [60, 10], [60, 70], [20, 70]]
    assert pixels.four_point(image, quad).shape[:2] == (60, 40)
    assert pixels.four_point(image, np.array([[1, 1], [1, 1], [1, 1], [1, 1]])) is image


def test_limit_side():
    page = printed()
    assert pixels.limit_side(page, 600) is page and pixels.limit_side(page, 0) is page
    assert pixels.limit_side(page, 300).shape == (300, 220, 3)
    checks = np.tile(np.array([[0, 200], [200, 0]], np.uint8), (50, 50))
    assert set(np.unique(pixels.limit_side(checks, 50))) == {100}


def test_lighting_flattens_a_shadow_and_keeps_gray():
    page = printed(240, 200, 30).astype(np.float64)
    shaded = (page * np.linspace(0.45, 1, 200)[None, :, None]).astype(np.uint8)
    got = pixels.normalise_lighting(shaded, search=5)
    paper = lambda im: float(np.median(im[5:25, 5:25])) - float(np.median(im[5:25, -25:-5]))
    assert got.shape == shaded.shape and abs(paper(got)) < 25 < abs(paper(shaded))
    assert len(np.unique(got)) > 2
    tiny = np.zeros((4, 4, 3), np.uint8)
    assert pixels.normalise_lighting(tiny) is tiny


def test_denoise_averages_noise():
    noisy = np.clip(128 + np.random.default_rng(3).normal(0, 6, (60, 60)), 0, 255).astype(np.uint8)
    assert pixels.denoise(noisy).std() < 0.5 * noisy.std()


def test_tiff_frames():
    frames = [printed(60, 50, 9), 255 - printed(40, 30, 5), printed(20, 20, 4)]
    for packing in (1, 8):
        got, count = pixels.tiff_frames(tiff(frames, packing), 2)
        assert count == 3 and len(got) == 2 and all(np.array_equal(a, b) for a, b in zip(got, frames))
    for bad in (b"", b"junk", tiff(frames)[:200], tiff(frames, 5)):
        with pytest.raises(ValueError):
            pixels.tiff_frames(bad)
    assert pixels._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])


def test_pages_are_cleaned_and_rendered(spark, tmp_path):
    page = printed(300, 220, 30)
    (tmp_path / "a.png").write_bytes(pixels.encode_png(pixels.rotate(page, 5)))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    found = pages.pages_of_images(files.images(spark, str(tmp_path)))
    cleaned = pages.clean_pages(found, search=3).cache()
    rows = {r.path.rpartition("/")[2]: r for r in cleaned.collect()}
    assert rows["bad.png"].note == "undecodable" and rows["bad.png"].data is None
    image = np.frombuffer(rows["a.png"].data, np.uint8).reshape(rows["a.png"].height, rows["a.png"].width, 3)
    assert rows["a.png"].note is None and abs(pixels.ink_angle(image)) < 1
    (out,) = pages.render_pages(cleaned).collect()
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "a.png").write_bytes(out.png)
    (again,) = files.images(spark, str(tmp_path / "again")).collect()
    assert np.frombuffer(again.data, np.uint8).reshape(image.shape).tolist() == image.tolist()


def test_pages_of_tiffs(spark):
    frames = [printed(60, 50, 9)] * 3
    rows = spark.createDataFrame([("x.tif", tiff(frames)), ("y.tif", b"junk"), ("z.tif", None)], "path string, content binary")
    got = sorted((r.path, r.page, r.pages, r.height, r.note) for r in pages.pages_of_tiffs(rows, 2).collect())
    assert got == [("x.tif", 1, 3, 60, "pages_truncated"), ("x.tif", 2, 3, 60, "pages_truncated"), ("y.tif", 1, 1, None, "not a TIFF"), ("z.tif", 1, 1, None, "not a TIFF")]
