"""Boxes erased by marks, amounts as written, cells out of range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridleaf.operators import raster, tables
from gridleaf.plans import acts


def test_erase_boxes_against_brute_force(spark):
    rng = np.random.default_rng(7)
    px = [(p, y, x, 9) for p in range(3) for y in range(2, 14) for x in range(17) if (p, y) != (1, 6)]
    boxes = [(int(rng.integers(4)), tuple(float(v) for v in sorted(rng.uniform(-20, 30, 2))), tuple(float(v) for v in sorted(rng.uniform(-20, 30, 2)))) for _ in range(9)]
    boxes += [(2, (4.0, 6.0), (5.0, 5.0)), (2, (4.0, 6.0), (5.0, 5.0)), (0, (-1e6, 1e6), (7.0, 7.0)), (1, (9.0, 3.0), (3.0, 9.0))]
    frame = spark.createDataFrame([(p, (x[0], y[0], x[1], y[1])) for p, x, y in boxes], "page int, bbox struct<x_min: double, y_min: double, x_max: double, y_max: double>")
    for padding in (0, 2):
        found = raster.erase_boxes(spark.createDataFrame(px, "page int, y int, x int, v int").repartition(3), frame, ["page"], padding)
        assert found.columns == ["page", "y", "x", "v"]
        inside = lambda p, y, x: any(q == p and int(a[0] - padding) <= x <= int(a[1] + padding) and int(b[0] - padding) <= y <= int(b[1] + padding) for q, a, b in boxes)  # noqa: B023, E731
        assert sorted(map(tuple, found.collect())) == sorted((p, y, x, 0 if inside(p, y, x) else v) for p, y, x, v in px)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


AMOUNTS = {
    "1,234.56": 1234.56, "1.234,56": 1234.56, "1 234,56": 1234.56, "1\u00a0234\u202f567.8": 1234567.8, "12,345,678": 12345678.0, "12.345.678": 12345678.0, "1'234.50": 1234.5, "-5,5": -5.5, "0": 0.0, "10000.50": 10000.5,
    "1,234": 1.234, "1,23,456.7": None, "1.2.3": None, "12a": None, "": None, "heading": None, None: None,
}


def test_amounts_as_documents_write_them(spark):
    rows = spark.createDataFrame([(t,) for t in AMOUNTS], "t string").select("t", acts.number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == AMOUNTS


def test_unreadable_amounts_are_rows(spark):
    cells = [(1, "t", 0, 0, "Record 7"), (1, "t", 0, 1, "1,234.56"), (1, "t", 1, 0, "Record"), (1, "t", 1, 1, "12a"), (1, "t", 1, 2, "debit"), (1, "t", 2, 2, "1.2.3"), (1, "t", 3, 1, None)]
    df = spark.createDataFrame(cells, "ord int, table_id string, row int, col int, value string")
    assert sorted((r["row"], r["side"], r["value"]) for r in acts.unreadable_amounts(df, ["ord"]).collect()) == [(1, "debit", "12a"), (2, "credit", "1.2.3")]
    assert [(r["side"], r["value"]) for r in acts.ledger_from_cells(df, ["ord"]).collect()] == [("debit", 1234.56)]


def test_cells_out_of_range(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1, 1, 0), ("a", 5, 1, 1, 1, 1), ("a", -1, 1, 1, 1, 2)], "id string, row int, col int, rowspan int, colspan int, ord int")
    sized = spark.createDataFrame([("a", 2, 2)], "id string, num_rows int, num_cols int")
    assert [len(r["cells"]) for r in tables.lines(cells, sized, ["id"]).orderBy("line").collect()] == [1, 0]
    assert [len(r["cells"]) for r in tables.lines(cells.where("ord = 0"), sized, ["id"], strict=True).orderBy("line").collect()] == [1, 0]
    for ord_ in (1, 2):
        with pytest.raises(Exception, match="out of range"):
            tables.lines(cells.where(f"ord in (0, {ord_})"), sized, ["id"], strict=True).collect()
