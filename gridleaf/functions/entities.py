"""Cells, tables and paragraphs as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridleaf.functions import geometry as g
from gridleaf.schema import FOOTER, HEADER, TEXT

BLANK = r"(?U)^\s*$"
EDGE_BLANKS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, EDGE_BLANKS, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def pad_all(boxes: Column, pixel) -> Column:
    return F.transform(boxes, lambda b: g.padding(b, pixel))


# Cells.  Sizes are multiplied by the spans although the box covers them already; results depend on it.


def cell_area(cell: Column) -> Column:
    return g.area(cell["bbox"]) * cell["colspan"] * cell["rowspan"]


def cell_width(cell: Column) -> Column:
    return g.width(cell["bbox"]) * cell["colspan"]


def cell_height(cell: Column) -> Column:
    return g.height(cell["bbox"]) * cell["rowspan"]


def is_merged(cell: Column) -> Column:
    return (cell["colspan"] > 1) | (cell["rowspan"] > 1)


def is_empty(cell: Column) -> Column:
    """Without text; boxes of recognised words do not count."""
    return is_blank(cell["value"])


def cell_padding(cell: Column, pixel) -> Column:
    return cell.withField("bbox", g.padding(cell["bbox"], pixel)).withField("blobs", pad_all(cell["blobs"], pixel))


def largest_free_space(box: Column, blobs: Column, padding: float = 1.0) -> Column:
    """The largest strip beside any one blob, over the whole height or width of the box.

    Each blob offers up to four strips (right, left, below, above); another blob may lie in
    them.  Of equal areas the first counts.  No blobs: the box; no strip: null.
    """

    def strips(b: Column) -> Column:
        right, left, below, above = b["x_max"] + padding, b["x_min"] - padding, b["y_max"] + padding, b["y_min"] - padding
        return F.array(
            F.when(right < box["x_max"], g.bbox(right, box["y_min"], box["x_max"], box["y_max"])),
            F.when(left > box["x_min"], g.bbox(box["x_min"], box["y_min"], left, box["y_max"])),
            F.when(below < box["y_max"], g.bbox(box["x_min"], below, box["x_max"], box["y_max"])),
            F.when(above > box["y_min"], g.bbox(box["x_min"], box["y_min"], box["x_max"], above)),
        )

    found = F.filter(F.flatten(F.transform(blobs, strips)), lambda b: b.isNotNull())
    best = F.aggregate(found, F.get(found, F.lit(0)), lambda kept, b: F.when(g.area(b) > g.area(kept), b).otherwise(kept))
    return F.when(blobs.isNull() | (F.size(blobs) == 0), box).otherwise(best)


def cell_text(cell: Column) -> Column:
    return F.format_string("Cell(row=%d, col=%d, colspan=%d, rowspan=%d, value=%s)", cell["row"], cell["col"], cell["colspan"], cell["rowspan"], F.coalesce(cell["value"], F.lit("None")))


# Tables.


def table_padding(table: Column, pixel) -> Column:
    return table.withField("bbox", g.padding(table["bbox"], pixel)).withField("cells", F.transform(table["cells"], lambda c: cell_padding(c, pixel)))


def table_valid(num_rows: Column, num_cols: Column, num_cells: Column) -> Column:
    return (num_rows > 1) & (num_cols > 1) & (num_cells > 1)


def cell_inside(row: Column, col: Column, rowspan: Column, colspan: Column, num_rows: Column, num_cols: Column) -> Column:
    return (row < num_rows) & (col < num_cols) & (row + rowspan <= num_rows) & (col + colspan <= num_cols)


def structure_ok(table: Column) -> Column:
    """Whether every cell lies inside the table; a table without cells is in order."""
    return F.forall(table["cells"], lambda c: cell_inside(c["row"], c["col"], c["rowspan"], c["colspan"], table["num_rows"], table["num_cols"]))


# Paragraphs.


def is_at_top(box: Column, page_height, threshold: float = 0.15) -> Column:
    return box["y_min"] < page_height * threshold


def is_at_bottom(box: Column, page_height, threshold: float = 0.15) -> Column:
    return box["y_max"] > page_height * (1 - threshold)


def classify(kind: Column, box: Column, page_height: Column, threshold: float = 0.15) -> Column:
    return F.when(is_at_top(box, page_height, threshold), HEADER).when(is_at_bottom(box, page_height, threshold), FOOTER).otherwise(kind)


def paragraph_padding(paragraph: Column, pixel) -> Column:
    """Padded box and blobs; the type falls back to text."""
    return paragraph.withField("bbox", g.padding(paragraph["bbox"], pixel)).withField("blobs", pad_all(paragraph["blobs"], pixel)).withField("type", F.lit(TEXT))


def merge_paragraphs(a: Column, b: Column) -> Column:
    """One paragraph of two: ids joined by a plus, the left one's type."""
    both = a.withField("id", F.concat(a["id"], F.lit("+"), b["id"])).withField("text", strip(F.concat_ws(" ", a["text"], b["text"])))
    return both.withField("bbox", g.union_box(a["bbox"], b["bbox"])).withField("blobs", F.concat(a["blobs"], b["blobs"]))
