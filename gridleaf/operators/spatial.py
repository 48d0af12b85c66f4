"""Spatial joins of boxes with recognised words.

A word belongs to a box if its centre lies inside, edges included.  Plain, that
condition is a nested loop; here boxes are laid on a square grid, every grid field they
touch, and words look in the one field of their centre, so the join is an equality of
(page, field) with the exact condition on top.  A word has one field: no duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridleaf.functions import geometry as g

#: Pixels of a grid field's side.
FIELD = 128.0


def _field(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _fields(boxes: DataFrame, box: str, size: float) -> DataFrame:
    """``boxes`` once for each field they touch, as gx and gy; boxes turned inside out touch none."""
    b = F.col(box)
    right = (b["x_min"] <= b["x_max"]) & (b["y_min"] <= b["y_max"])
    spread = boxes.where(right).withColumn("gx", F.explode(F.sequence(_field(b["x_min"], size), _field(b["x_max"], size))))
    return spread.withColumn("gy", F.explode(F.sequence(_field(b["y_min"], size), _field(b["y_max"], size))))


def words_in_boxes(boxes: DataFrame, words: DataFrame, keys: list[str], box: str = "bbox", word_box: str = "word_bbox", size: float = FIELD) -> DataFrame:
    """Inner join of boxes and words of the same page (``keys``) whose centre lies inside."""
    w = F.col(word_box)
    placed = words.withColumn("gx", _field(g.center_x(w), size)).withColumn("gy", _field(g.center_y(w), size))
    joined = _fields(boxes, box, size).join(placed, [*keys, "gx", "gy"])
    return joined.where(g.contains_center(F.col(box), w)).drop("gx", "gy")


def box_contents(boxes: DataFrame, words: DataFrame, page: list[str], size: float = FIELD) -> DataFrame:
    """page, bbox, n, value and blobs of every distinct box that has words: their number, each text with a line break after it, in word order, and their boxes.

    Boxes that lie alike on a page have the same words, so each place is looked up once, however many boxes are there.  Texts and boxes of words
    are gathered apart, so that a plan that asks for one does not carry the other.
    """
    w = words.select(*page, F.col("ord").alias("word_ord"), "text", F.col("bbox").alias("word_bbox"))
    hit = words_in_boxes(boxes.select(*page, "bbox").distinct(), w, page, size=size)
    gathered = hit.groupBy(*page, "bbox").agg(F.count("*").alias("n"), F.collect_list(F.struct("word_ord", "text")).alias("t"), F.collect_list(F.struct("word_ord", "text", "word_bbox")).alias("b"))
    value = F.array_join(F.transform(F.sort_array("t"), lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"))), "")
    return gathered.select(*page, "bbox", "n", value.alias("value"), F.sort_array("b")["word_bbox"].alias("blobs"))


def fill_cells(cells: DataFrame, words: DataFrame, page: list[str], size: float = FIELD) -> DataFrame:
    """Every cell with its words as value and blobs.

    A word on an edge that two cells share is in both; a cell without words has an empty
    value and no blobs.
    """
    filled = box_contents(cells, words, page, size).drop("n")
    left = cells.drop("value", "blobs").join(filled, [*page, "bbox"], "left")
    return left.withColumn("value", F.coalesce("value", F.lit(""))).withColumn("blobs", F.coalesce("blobs", F.array().cast(filled.schema["blobs"].dataType)))


def leftover_words(words: DataFrame, tables: DataFrame, page: list[str], padding: float = 5.0, size: float = FIELD) -> DataFrame:
    """Words whose centre is in no table of their page, tables padded."""
    padded = tables.select(*page, g.padding(F.col("bbox"), F.lit(padding)).alias("__box"))
    spread = _fields(padded, "__box", size)
    w = F.col("bbox")
    placed = words.withColumn("gx", _field(g.center_x(w), size)).withColumn("gy", _field(g.center_y(w), size))
    left, right = placed.alias("w"), spread.alias("t")
    same = F.lit(True)
    for k in [*page, "gx", "gy"]:
        same = same & (F.col(f"w.{k}") == F.col(f"t.{k}"))
    return left.join(right, same & g.contains_center(F.col("t.__box"), F.col("w.bbox")), "left_anti").drop("gx", "gy")


def confident(words: DataFrame, least: float = 0.7) -> DataFrame:
    """Words with at least this confidence; NaN stays."""
    return words.where(F.col("confidence") >= least)


def zip_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per region from the parallel arrays rec_boxes, rec_texts and rec_scores; the shortest array ends it."""
    n = F.least(*(F.coalesce(F.size(c), F.lit(0)) for c in ("rec_boxes", "rec_texts", "rec_scores")))
    zipped = F.slice(F.arrays_zip("rec_boxes", "rec_texts", "rec_scores"), F.lit(1), F.greatest(n, F.lit(0)))
    rows = results.select(*keys, F.posexplode(zipped).alias("ord", "r"))
    box = g.bbox(*(F.get(F.col("r.rec_boxes"), F.lit(i)) for i in range(4)))
    return rows.select(*keys, "ord", F.col("r.rec_texts").alias("text"), F.col("r.rec_scores").alias("confidence"), box.alias("bbox"))
