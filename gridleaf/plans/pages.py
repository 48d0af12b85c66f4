"""A whole page: tables with filled cells and the remaining text as paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.config import Settings
from gridleaf.functions.entities import classify
from gridleaf.operators import detect, spatial
from gridleaf.plans.store import kept
from gridleaf.schema import CELL, PARAGRAPH, TABLE, TEXT


def paragraphs_of(words: DataFrame, tables: DataFrame, heights: DataFrame, page: list[str]) -> DataFrame:
    """One paragraph per word outside tables: page, ord, paragraph; header and footer by position."""
    left = spatial.leftover_words(words, tables, page).join(heights, page)
    kind = classify(F.lit(TEXT), F.col("bbox"), F.col("page_height"))
    paragraph = F.struct(F.concat(F.lit("p"), F.col("ord")).alias("id"), "text", kind.alias("type"), "bbox", F.array("bbox").alias("blobs"))
    return left.select(*page, "ord", paragraph.cast(PARAGRAPH).alias("paragraph"))


def analyze(pages: DataFrame, words: DataFrame, page: list[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """page, tables, paragraphs, metadata of every page image.

    ``pages``: page columns and image; ``words``: page columns, ord, text, confidence, bbox.
    Detection and recognition are costly and each is used more than once, so what they give
    (boxes, texts and sizes, no images) is written to a shared folder and read back.
    """
    tables = kept(detect.page_tables(pages, page, settings), "tables")
    words, sizes = kept(words, "words"), kept(pages.select(*page, "image.height", "image.width"), "sizes")
    boxes = tables.select(*page, F.col("table.id").alias("table_id"), F.col("table.bbox").alias("bbox"))
    sure = spatial.confident(words)
    filled = spatial.fill_cells(detect.table_cells(tables, page), sure, page)
    cell = F.struct("row", "col", "colspan", "rowspan", "value", "bbox", "blobs").cast(CELL)
    cells = filled.groupBy(*page, "table_id").agg(F.array_sort(F.collect_list(F.struct("ord", cell.alias("cell")))).alias("c"))
    whole = tables.withColumn("table_id", F.col("table.id")).join(cells, [*page, "table_id"], "left").withColumn("table", F.col("table").withField("cells", F.col("c.cell")))
    by_page = whole.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"table.bbox.{s}").alias(s) for s in ("y_min", "x_min")), F.col("table").cast(TABLE).alias("table")))).alias("t"))
    heights = sizes.select(*page, F.col("height").cast("double").alias("page_height"))
    texts = paragraphs_of(sure, boxes, heights, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("ord", "paragraph"))).alias("p"))
    joined = sizes.join(by_page, page, "left").join(texts, page, "left")
    metadata = F.create_map(F.lit("height"), F.col("height").cast("string"), F.lit("width"), F.col("width").cast("string"))
    return joined.select(
        *page,
        F.coalesce(F.col("t.table"), F.array().cast(f"array<{TABLE}>")).alias("tables"),
        F.coalesce(F.col("p.paragraph"), F.array().cast(f"array<{PARAGRAPH}>")).alias("paragraphs"),
        metadata.alias("metadata"),
    )


