"""Operators over tables and their cells in normalized form: cells keyed by table, one row each.

``cells`` has the key columns of its table, row, col, rowspan, colspan, and what else it
likes; ``ord`` gives the order in which cells were found, where order is observable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.functions import entities as e
from gridleaf.functions import geometry as g

Keys = list[str]


def covered(cells: DataFrame, axis: str, include_merged: bool, size: str) -> DataFrame:
    """One row per cell and line of ``axis`` ("row" or "col") it is listed under, as ``line``.

    With merged cells a cell is listed under every line it covers, as far as the table
    goes (column ``size``); else under its first.
    """
    if not include_merged:
        return cells.withColumn("line", F.col(axis))
    last = F.least(F.col(axis) + F.col(f"{axis}span"), F.col(size)) - 1
    return cells.where(F.col(axis) <= last).withColumn("line", F.explode(F.sequence(F.col(axis), last)))


def lines(cells: DataFrame, tables: DataFrame, keys: Keys, axis: str = "row", include_merged: bool = False, order: str = "ord", strict: bool = False) -> DataFrame:
    """keys, line, cells: for every line of a table, empty ones too, the cells listed there in order.

    A cell that begins outside its table is in no line; ``strict`` makes it an error that ends the job.
    """
    size = "num_rows" if axis == "row" else "num_cols"
    every = tables.where(F.col(size) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("line"))
    sized = cells.join(tables.select(*keys, size), keys)
    if strict:
        outside = (F.col(axis) < 0) | (F.col(axis) >= F.col(size))
        sized = sized.withColumn(axis, F.when(outside, F.raise_error(F.concat(F.lit(f"{axis} "), F.col(axis).cast("string"), F.lit(" is out of range")))).otherwise(F.col(axis)))
    listed = covered(sized, axis, include_merged, size).groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct(order, "row", "col"))).alias("cells"))
    return every.join(listed, [*keys, "line"], "left").withColumn("cells", F.coalesce("cells", F.array().cast(listed.schema["cells"].dataType)))


def get_cell(cells: DataFrame, keys: Keys, order: str = "ord") -> DataFrame:
    """One row per (table, row, col): of several cells there the last one."""
    others = [c for c in cells.columns if c not in (*keys, "row", "col")]
    last = cells.groupBy(*keys, "row", "col").agg(F.max_by(F.struct(*others), order).alias("cell"))
    return last.select(*keys, "row", "col", *(F.col(f"cell.{c}").alias(c) for c in others))


def median_blob_height(cells: DataFrame, tables: DataFrame, keys: Keys) -> DataFrame:
    """keys, median: of the mean blob heights of cells that have blobs; 0 for tables without."""
    mean = F.expr("aggregate(blobs, 0D, (a, b) -> a + greatest(0D, b.y_max - b.y_min)) / nullif(size(blobs), 0)")
    found = cells.where(F.size("blobs") > 0).select(*keys, mean.alias("h")).groupBy(*keys).agg(F.median("h").alias("median"))
    return tables.select(*keys).join(found, keys, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))


def summarize(cells: DataFrame, keys: Keys) -> DataFrame:
    """keys, num_rows, num_cols, num_cells and valid of tables known by their cells only."""
    sized = cells.groupBy(*keys).agg(
        F.max(F.col("row") + F.col("rowspan")).alias("num_rows"), F.max(F.col("col") + F.col("colspan")).alias("num_cols"), F.count("*").alias("num_cells")
    )
    return sized.withColumn("valid", e.table_valid(F.col("num_rows"), F.col("num_cols"), F.col("num_cells")))


def structure(cells: DataFrame, tables: DataFrame, keys: Keys) -> DataFrame:
    """keys, structure_ok: whether every cell lies inside its table; tables without cells are in order."""
    inside = e.cell_inside(F.col("row"), F.col("col"), F.col("rowspan"), F.col("colspan"), F.col("num_rows"), F.col("num_cols"))
    found = cells.join(tables.select(*keys, "num_rows", "num_cols"), keys).groupBy(*keys).agg(F.bool_and(inside).alias("structure_ok"))
    return tables.select(*keys).join(found, keys, "left").withColumn("structure_ok", F.coalesce("structure_ok", F.lit(True)))


def merge_paragraphs(paragraphs: DataFrame, keys: Keys, order: str = "ord") -> DataFrame:
    """One paragraph per key of all in order: what merging two at a time gives."""
    parts = F.array_sort(F.collect_list(F.struct(order, "id", "text", "type", "bbox", "blobs")))
    gathered = paragraphs.groupBy(*keys).agg(
        parts.alias("p"),
        *(f(f"bbox.{s}").alias(s) for s, f in (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max))),
    )
    return gathered.select(
        *keys,
        F.array_join("p.id", "+").alias("id"),
        e.strip(F.array_join("p.text", " ")).alias("text"),
        F.get("p.type", F.lit(0)).alias("type"),
        g.bbox(*(F.col(s) for s in g.SIDES)).alias("bbox"),
        F.flatten("p.blobs").alias("blobs"),
    )
