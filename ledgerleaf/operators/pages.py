"""Pages of image files: decoding, cleaning and rendering, a page at a time and without a shuffle.

Formats that the JVM decodes come through Spark's image reader; frames of TIFF files are read here,
as that reader sees only the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import jpeg, pixels

PAGE = "path string, page int, pages int, height int, width int, data binary, note string"


def pages_of_images(decoded: DataFrame) -> DataFrame:
    """Rows of ``sources.files.images`` as pages (``PAGE``); one that could not be decoded has no
    data and the note ``undecodable``."""
    ok = F.col("height") > 0
    return decoded.select(
        F.col("origin").alias("path"), F.lit(1).alias("page"), F.lit(1).alias("pages"),
        F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("width")).alias("width"),
        F.when(ok, F.col("data")).alias("data"), F.when(~ok, F.lit("undecodable")).alias("note"),
    )


def pages_of_tiffs(files: DataFrame, limit: int = 20) -> DataFrame:
    """A row a frame (``PAGE``) of (path, content), the first ``limit``; ``pages`` is their true
    number.  A file that cannot be read gives one row without data and a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    frames, count = pixels.tiff_frames(bytes(content or b""), limit)
                    rows = [(path, k, count, f.shape[0], f.shape[1], f.tobytes(), "pages_truncated" if count > len(frames) else None) for k, f in enumerate(frames, 1)]
                except ValueError as why:
                    rows = [(path, 1, 1, None, None, None, str(why))]
                yield _frame(rows)

    return files.select("path", "content").mapInPandas(run, PAGE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "page", "pages", "height", "width", "data", "note"])
    return out.astype({"page": "Int32", "pages": "Int32", "height": "Int32", "width": "Int32"})


def _image(row) -> np.ndarray:
    flat = np.frombuffer(row.data, np.uint8)
    return pixels.to_bgr(flat.reshape(int(row.height), int(row.width), -1))


def clean_pages(pages: DataFrame, crop: bool = True, straighten: bool = True, lighting: bool = True, longest: int = 2500, search: int = 21) -> DataFrame:
    """Each page cropped, straightened, limited and evenly lit.  A page on which that fails stays
    as it is, with the note ``page_not_cleaned``; one without data stays without."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.data is None:
                    yield _frame([tuple(row)])
                    continue
                try:
                    made = pixels.clean_page(_image(row), crop, straighten, lighting, longest, search)
                    yield _frame([(row.path, row.page, row.pages, made.shape[0], made.shape[1], made.tobytes(), row.note)])
                except (ValueError, IndexError, FloatingPointError):
                    yield _frame([(*tuple(row)[:6], "page_not_cleaned")])

    return pages.mapInPandas(run, PAGE)


def _encoded(pages: DataFrame, name: str, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, page, <name>): those that cannot be encoded are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    made = encode(_image(row)) if row.data is not None else None
                except ValueError:
                    made = None
                if made is not None:
                    yield pd.DataFrame({"path": [row.path], "page": [int(row.page)], name: [made]})

    return pages.mapInPandas(run, f"path string, page int, {name} binary")


def render_pages(pages: DataFrame) -> DataFrame:
    """(path, page, png): each page as an engine sees it, without loss."""
    return _encoded(pages, "png", pixels.encode_png)


def wire_pages(pages: DataFrame, longest: int = 1800, quality: int = 90) -> DataFrame:
    """(path, page, jpeg): each page as it is sent to a model."""
    return _encoded(pages, "jpeg", lambda image: jpeg.wire_jpeg(image, longest, quality))
