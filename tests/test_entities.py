"""Golden values of boxes, cells, tables and paragraphs."""

import pytest
from pyspark.sql import functions as F

from gridleaf.functions import entities as e
from gridleaf.functions import geometry as g
from gridleaf.operators import tables
from gridleaf.schema import BBOX, FOOTER, HEADER, TEXT


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("a", "b", "iou", "iom"),
    [
        ((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175, 0.25),
        ((0, 0, 10, 10), (10, 0, 20, 10), 0, 0),
        ((0, 0, 10, 10), (0, 0, 10, 10), 1, 1),
        ((3, 3, 3, 3), (3, 3, 3, 3), 1, 1),
        ((3, 3, 3, 3), (4, 3, 4, 3), 0, 0),
        ((0, 0, 100, 100), (10, 10, 20, 20), 0.01, 1),
    ],
)
def test_overlap(spark, a, b, iou, iom):
    row = one(spark, g.iou(g.bbox(*a), g.bbox(*b)), g.intersection_over_min(g.bbox(*a), g.bbox(*b)))
    assert row[0] == pytest.approx(iou) and row[1] == pytest.approx(iom)


def test_contains(spark):
    row = one(spark, g.contains(g.bbox(0, 0, 100, 100), g.bbox(10, 10, 20, 20)), g.contains_center(g.bbox(0, 0, 100, 100), g.bbox(90, 0, 110, 0)), g.contains_center(g.bbox(0, 0, 100, 100), g.bbox(91, 0, 110, 0)))
    assert tuple(row) == (True, True, False)


def cell(box, colspan=1, rowspan=1, value=None, blobs=()):
    return F.struct(
        F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(colspan).alias("colspan"), F.lit(rowspan).alias("rowspan"),
        F.lit(value).cast("string").alias("value"), g.bbox(*box).alias("bbox"), F.array(*(g.bbox(*b) for b in blobs)).cast(f"array<{BBOX}>").alias("blobs"),
    )


def test_cell_sizes(spark):
    plain, merged = cell((0, 0, 100, 50)), cell((0, 0, 200, 100), 2, 2)
    row = one(spark, e.cell_area(plain), e.is_merged(plain), e.cell_area(merged), e.cell_width(merged), e.cell_height(merged), e.is_merged(merged))
    assert tuple(row) == (5000, False, 80000, 400, 200, True)


@pytest.mark.parametrize(("value", "empty"), [(None, True), ("   ", True), (" \n", True), ("x", False)])
def test_cell_empty(spark, value, empty):
    assert one(spark, e.is_empty(cell((0, 0, 1, 1), value=value)))[0] is empty


@pytest.mark.parametrize(
    ("box", "blobs", "free"),
    [
        ((0, 0, 200, 100), [], (0, 0, 200, 100)),
        ((0, 0, 200, 100), [(10, 10, 80, 90)], (82, 0, 200, 100)),
        ((0, 0, 100, 200), [(10, 10, 90, 80)], (0, 82, 100, 200)),
        ((0, 0, 100, 100), [(0, 0, 100, 100)], None),
    ],
)
def test_free_space(spark, box, blobs, free):
    found = one(spark, e.largest_free_space(cell(box, blobs=blobs)["bbox"], cell(box, blobs=blobs)["blobs"], 2.0))[0]
    assert (None if found is None else tuple(found)) == free


def test_padding_covers_blobs(spark):
    row = one(spark, e.cell_padding(cell((0, 0, 100, 50), blobs=[(10, 10, 20, 20)]), 5))[0]
    assert tuple(row["bbox"]) == (-5, -5, 105, 55) and row["blobs"][0]["x_min"] == 5


def test_merged_rows(spark):
    cells = spark.createDataFrame([(0, 0, 2, 2, 0), (0, 2, 1, 1, 1), (1, 2, 1, 1, 2), (2, 0, 1, 1, 3), (2, 1, 1, 1, 4), (2, 2, 1, 1, 5)], "row int, col int, rowspan int, colspan int, ord int").withColumn("t", F.lit(1))
    sizes = spark.createDataFrame([(1, 3, 3)], "t int, num_rows int, num_cols int")
    for merged, want in ((False, [2, 1, 3]), (True, [2, 2, 3])):
        for axis in ("row", "col"):
            found = tables.lines(cells, sizes, ["t"], axis, merged).orderBy("line").collect()
            assert [len(r["cells"]) for r in found] == want
    assert tables.structure(cells, sizes, ["t"]).first()["structure_ok"]
    outside = cells.withColumn("row", F.col("row") + 5)
    assert not tables.structure(outside, sizes, ["t"]).first()["structure_ok"]


def test_median_blob_height(spark):
    cells = spark.createDataFrame(
        [(1, [(0.0, 0.0, 1.0, 10.0), (0.0, 0.0, 1.0, 10.0)]), (1, [(0.0, 0.0, 1.0, 15.0)]), (1, []), (1, [(0.0, 0.0, 1.0, 20.0)])], f"t int, blobs array<{BBOX}>"
    )
    every = spark.createDataFrame([(1,), (2,)], "t int")
    assert {r["t"]: r["median"] for r in tables.median_blob_height(cells, every, ["t"]).collect()} == {1: 15.0, 2: 0.0}


@pytest.mark.parametrize(("y0", "y1", "kind"), [(20, 60, HEADER), (740, 780, FOOTER), (200, 250, TEXT)])
def test_paragraph_position(spark, y0, y1, kind):
    assert one(spark, e.classify(F.lit(TEXT), g.bbox(50, y0, 550, y1), F.lit(800.0)))[0] == kind


def test_paragraph_thresholds(spark):
    at = g.bbox(0, 150, 1, 650)
    assert tuple(one(spark, *(f(at, F.lit(800.0), t) for f in (e.is_at_top, e.is_at_bottom) for t in (0.15, 0.25)))) == (False, True, False, True)


def paragraph(name, text, box, kind=TEXT):
    return F.struct(F.lit(name).alias("id"), F.lit(text).alias("text"), F.lit(kind).alias("type"), g.bbox(*box).alias("bbox"), F.array(g.bbox(*box)).alias("blobs"))


def test_paragraph_merge(spark):
    both = one(spark, e.merge_paragraphs(paragraph("p1", "First", (50, 100, 300, 150), HEADER), paragraph("p2", "Second", (50, 160, 300, 210))))[0]
    assert (both["id"], both["text"], both["type"], tuple(both["bbox"]), len(both["blobs"])) == ("p1+p2", "First Second", HEADER, (50, 100, 300, 210), 2)
    assert one(spark, e.merge_paragraphs(paragraph("a", "", (0, 0, 1, 1)), paragraph("b", "Second", (0, 0, 1, 1))))[0]["text"] == "Second"
    assert one(spark, e.paragraph_padding(paragraph("a", "x", (0, 0, 1, 1), HEADER), 1))[0]["type"] == TEXT
