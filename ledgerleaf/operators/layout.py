"""Reading order of recognised blocks, and measures of recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

LINE_TOLERANCE = 12.0
CONFIDENCE_FLOOR = 0.50


def confident(text: Column, confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    """Blocks with text whose confidence is unknown or not under the floor."""
    return (strip(text) != "") & (confidence.isNull() | (confidence >= floor))


def score(c: Column) -> Column:
    """A recogniser's score as a share: percentages are scaled, what is no number is null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), F.when(value > 1.0, value / 100.0).otherwise(value))


def bounding_box(polygon: Column) -> Column:
    """[x0, y0, x1, y1] of an array of points."""
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(polygon) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def _lines(blocks: Column, tolerance: float) -> Column:
    """Blocks (sorted by centre, then left edge) cut into lines: a block joins the last line if its
    centre lies within the tolerance of that line's running mean."""
    # The fold keeps line starts only (one small append a line); the blocks are cut once afterwards.
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("mean"))

    def step(acc: Column, centre: Column) -> Column:
        joins = F.coalesce(F.abs(centre - acc["mean"]) <= tolerance, F.lit(False))
        return F.struct(
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
            (acc["i"] + 1).alias("i"),
            F.when(joins, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(joins, (acc["mean"] * acc["n"] + centre) / (acc["n"] + 1)).otherwise(centre).alias("mean"),
        )

    starts = F.aggregate(F.transform(blocks, lambda b: b["centre"]), zero, step, lambda acc: acc["starts"])
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(blocks)))
    line = lambda span: F.slice(blocks, span["start"] + 1, span["end"] - span["start"])
    words = lambda span: F.array_join(F.transform(F.array_sort(F.transform(line(span), lambda b: F.struct(b["x"].alias("x"), b["seq"].alias("seq"), b["text"].alias("text")))), lambda b: b["text"]), " ")
    spans = F.arrays_zip(starts.alias("start"), F.when(F.size(starts) > 0, ends).alias("end"))
    return F.when(F.size(blocks) > 0, F.transform(spans, words)).otherwise(F.array().cast("array<string>"))


def reading_order(blocks: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(doc_id, text) from (doc_id, seq, text, bbox, page): pages in order, lines from top to
    bottom, blocks from left to right; blocks without a box at their page's end."""
    centre = F.when(F.size("bbox") >= 4, (F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))) / 2.0)
    left = F.when(F.size("bbox") >= 4, F.get("bbox", F.lit(0))).otherwise(0.0)
    rows = blocks.select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.col("seq").cast("long").alias("seq"), strip(F.col("text")).alias("text"), centre.cast("double").alias("centre"), left.cast("double").alias("x")).filter("text <> ''")
    placed = F.array_sort(F.collect_list(F.when(F.col("centre").isNotNull(), F.struct("centre", "x", "seq", "text"))))
    loose = F.array_sort(F.collect_list(F.when(F.col("centre").isNull(), F.struct("seq", "text"))))
    pages = rows.groupBy("doc_id", "page").agg(placed.alias("placed"), loose.alias("loose"))
    text = F.array_join(F.concat(_lines(F.col("placed"), tolerance), F.transform("loose", lambda b: b["text"])), "\n")
    whole = F.array_sort(F.collect_list(F.struct("page", text.alias("t"))))
    return pages.groupBy("doc_id").agg(whole.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def regroup_words(words: DataFrame, *key: str) -> DataFrame:
    """Words of a recogniser (block, par, line, word, text, conf, x0, y0, x1, y1) as lines: text in
    order of word number, mean score, and the union of the boxes."""
    kept = words.filter((strip(F.col("text")) != "") & (F.col("conf").isNull() | (F.col("conf") >= 0)))
    ordered = F.array_sort(F.collect_list(F.struct("word", F.col("text").alias("t"))))
    return kept.groupBy(*key, "block", "par", "line").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"),
        F.avg(score(F.col("conf"))).alias("conf"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def overall_confidence(text: Column, confidence: Column) -> Column:
    """Aggregate: mean confidence by length of text, over blocks that have one."""
    weight = F.when(confidence.isNotNull(), F.length(strip(text)))
    # Decimals, so that the sum does not depend on the order in which tasks finish.
    weighted = F.sum((confidence * weight).cast("decimal(28,8)"))
    return F.round(F.try_divide(weighted, F.sum(weight).cast("decimal(18,0)")), 4).cast("double")
