"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Tables stand in for documents: embeddings are 8 by 8 rasters, events are recognised
words, orders give pairs of boxes, parts give cells, suppliers boxes on pages, line items
ledger entries, documents text layers.  Every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridleaf.functions import entities as e
from gridleaf.functions import geometry as g
from gridleaf.operators import detect, grid, ocr, raster, spatial, tables
from gridleaf.plans import acts, store
from gridleaf.schema import HEADER, IMAGE, TEXT, struct
from gridleaf.sources import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def sides(box: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{box}.{s}").alias(prefix + s) for s in g.SIDES]


# Pairs of boxes.


def box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    a = g.bbox(c % 50, k % 40, c % 50 + k % 23 - 2, k % 40 + c % 19)
    b = g.bbox(k % 50 + 0.5, c % 40, k % 50 + c % 17 + 0.5, c % 40 + k % 21 - 1)
    # Every seventh pair is a point with itself or with a point nearby.
    point = g.bbox(c % 50, k % 40, c % 50, k % 40)
    other = g.bbox(c % 50 + k % 2, k % 40, c % 50 + k % 2, k % 40)
    return o.select(k.alias("id"), F.when(k % 7 == 0, point).otherwise(a).alias("a"), F.when(k % 7 == 0, other).otherwise(b).alias("b"))


PAIRS = """WITH p AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey AS k, o_orderkey % 7 = 0 AS pt FROM orders),
q AS (SELECT id,
 CAST(c % 50 AS DOUBLE) AS ax0, CAST(k % 40 AS DOUBLE) AS ay0,
 CAST(CASE WHEN pt THEN c % 50 ELSE c % 50 + k % 23 - 2 END AS DOUBLE) AS ax1, CAST(CASE WHEN pt THEN k % 40 ELSE k % 40 + c % 19 END AS DOUBLE) AS ay1,
 CASE WHEN pt THEN CAST(c % 50 + k % 2 AS DOUBLE) ELSE k % 50 + 0.5::DOUBLE END AS bx0, CAST(CASE WHEN pt THEN k % 40 ELSE c % 40 END AS DOUBLE) AS by0,
 CASE WHEN pt THEN CAST(c % 50 + k % 2 AS DOUBLE) ELSE k % 50 + c % 17 + 0.5::DOUBLE END AS bx1, CAST(CASE WHEN pt THEN k % 40 ELSE c % 40 + k % 21 - 1 END AS DOUBLE) AS by1 FROM p),
m AS (SELECT *, greatest(0, ax1 - ax0) * greatest(0, ay1 - ay0) AS aa, greatest(0, bx1 - bx0) * greatest(0, by1 - by0) AS ba,
 greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS i,
 CASE WHEN abs(ax0 - bx0) <= 1e-9 AND abs(ay0 - by0) <= 1e-9 AND abs(ax1 - bx1) <= 1e-9 AND abs(ay1 - by1) <= 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM q)
"""
def _a() -> Column:
    return F.col("a")


def _b() -> Column:
    return F.col("b")


@query(PAIRS + "SELECT id, greatest(0, ax1 - ax0)::DOUBLE AS w, greatest(0, ay1 - ay0)::DOUBLE AS h, aa::DOUBLE AS area, (ax0 + ax1) / 2 AS cx, (ay0 + ay1) / 2 AS cy FROM m")
def bbox_dims(spark, sf):
    return box_pairs(spark, sf).select("id", g.width(_a()).alias("w"), g.height(_a()).alias("h"), g.area(_a()).alias("area"), g.center_x(_a()).alias("cx"), g.center_y(_a()).alias("cy"))


@query(PAIRS + "SELECT id, trunc(bx0 - 2.75)::INT AS x_min, trunc(by0)::INT AS y_min, trunc(bx1 - 2.75)::INT AS x_max, trunc(by1)::INT AS y_max FROM m")
def bbox_trunc(spark, sf):
    moved = g.bbox(_b()["x_min"] - 2.75, _b()["y_min"], _b()["x_max"] - 2.75, _b()["y_max"])
    return box_pairs(spark, sf).select("id", g.to_tuple(moved).alias("t")).select("id", "t.*")


@query(PAIRS + "SELECT id, ax0 - 5 AS px0, ay0 - 5 AS py0, ax1 + 5 AS px1, ay1 + 5 AS py1, ax0 + 1.5 AS mx0, ay0 + 1.5 AS my0, ax1 - 1.5 AS mx1, ay1 - 1.5 AS my1 FROM m")
def bbox_pad_margin(spark, sf):
    p, m = g.padding(_a(), 5), g.margin(_a(), 1.5)
    names = ("x0", "y0", "x1", "y1")
    return box_pairs(spark, sf).select("id", *(p[s].alias(f"p{n}") for s, n in zip(g.SIDES, names, strict=True)), *(m[s].alias(f"m{n}") for s, n in zip(g.SIDES, names, strict=True)))


@query(PAIRS + "SELECT id, i::DOUBLE AS shared FROM m")
def bbox_intersect(spark, sf):
    return box_pairs(spark, sf).select("id", g.intersect(_a(), _b()).alias("shared"))


@query(PAIRS + "SELECT id, round(CASE WHEN aa + ba - i > 0 THEN i / (aa + ba - i) ELSE same END, 9) AS iou FROM m")
def bbox_iou(spark, sf):
    return box_pairs(spark, sf).select("id", F.round(g.iou(_a(), _b()), 9).alias("iou"))


@query(PAIRS + "SELECT id, round(CASE WHEN least(aa, ba) > 0 THEN i / least(aa, ba) ELSE same END, 9) AS iom FROM m")
def bbox_iomin(spark, sf):
    return box_pairs(spark, sf).select("id", F.round(g.intersection_over_min(_a(), _b()), 9).alias("iom"))


@query(PAIRS + "SELECT id, ax0 - 1e-9 <= bx0 AND ay0 - 1e-9 <= by0 AND ax1 + 1e-9 >= bx1 AND ay1 + 1e-9 >= by1 AS inside FROM m")
def bbox_contains(spark, sf):
    return box_pairs(spark, sf).select("id", g.contains(_a(), _b()).alias("inside"))


@query(PAIRS + "SELECT id, (bx0 + bx1) / 2 BETWEEN ax0 AND ax1 AND (by0 + by1) / 2 BETWEEN ay0 AND ay1 AS inside FROM m")
def bbox_center_in(spark, sf):
    return box_pairs(spark, sf).select("id", g.contains_center(_a(), _b()).alias("inside"))


@query(PAIRS + "SELECT id, least(greatest(trunc(ax0 - 3)::INT, 0), 40) AS x_min, least(greatest(trunc(ay0 - 3)::INT, 0), 30) AS y_min, least(greatest(trunc(ax1)::INT, 0), 40) AS x_max, least(greatest(trunc(ay1)::INT, 0), 30) AS y_max FROM m")
def bbox_roi(spark, sf):
    moved = g.bbox(_a()["x_min"] - 3, _a()["y_min"] - 3, _a()["x_max"], _a()["y_max"])
    return box_pairs(spark, sf).select("id", g.roi(moved, 40, 30).alias("t")).select("id", "t.*")


@query(PAIRS + """, c AS (SELECT id, unnest([1, 2, 3, 4]) AS i, unnest([ax0, bx1, ax1, bx0]) AS x, unnest([ay0, by1, ay1, by0]) AS y FROM q)
SELECT id, arg_min(x, (x + y) * 10 + i) AS tl_x, arg_min(y, (x + y) * 10 + i) AS tl_y, arg_min(x, (y - x) * 10 + i) AS tr_x, arg_min(y, (y - x) * 10 + i) AS tr_y,
 arg_min(x, -(x + y) * 10 + i) AS br_x, arg_min(y, -(x + y) * 10 + i) AS br_y, arg_min(x, -(y - x) * 10 + i) AS bl_x, arg_min(y, -(y - x) * 10 + i) AS bl_y FROM c GROUP BY id""")
def order_points(spark, sf):
    """Corners of both boxes of a pair as four points, put in order."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = _a(), _b()
    points = F.array(point(a["x_min"], a["y_min"]), point(b["x_max"], b["y_max"]), point(a["x_max"], a["y_max"]), point(b["x_min"], b["y_min"]))
    found = box_pairs(spark, sf).select("id", g.order_points(points).alias("p"))
    return found.select("id", *(F.col("p")[i][c].alias(f"{n}_{c}") for i, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"))


# Cells and tables.


def part_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one table per brand."""
    p, k, z = read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size").cast("bigint")
    x, y = k % 5 * 40, k % 7 * 20
    box = g.bbox(x, y, x + 20 + z % 21, y + 20)
    blob = lambda n: g.bbox(x + n, y + 2, x + n + z % 9, y + 6 + z % 7 + n)
    blobs = F.when(k % 4 == 0, F.array()).when(k % 4 == 1, F.array(blob(1))).when(k % 4 == 2, F.array(blob(3), blob(11))).otherwise(F.array(g.bbox(x - 5, y - 5, x + 60, y + 40)))
    value = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "   \n").when(k % 5 == 2, "").otherwise(F.col("p_name"))
    return p.select(
        F.col("p_brand").alias("table_id"), k.alias("ord"), (k % 7).cast("int").alias("row"), (k % 5).cast("int").alias("col"),
        (1 + k % 2).cast("int").alias("rowspan"), (1 + z % 3).cast("int").alias("colspan"), value.alias("value"), box.alias("bbox"),
        blobs.cast(f"array<{'struct<x_min: double, y_min: double, x_max: double, y_max: double>'}>").alias("blobs"),
    )


CELLS = """WITH p AS (SELECT p_brand AS table_id, p_partkey AS k, p_size::BIGINT AS z, p_name FROM part),
c AS (SELECT table_id, k AS ord, (k % 7)::INT AS r, (k % 5)::INT AS c, (1 + k % 2)::INT AS rs, (1 + z % 3)::INT AS cs,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(160) || chr(10) WHEN 2 THEN '' ELSE p_name END AS value,
 (k % 5 * 40)::DOUBLE AS x0, (k % 7 * 20)::DOUBLE AS y0, (k % 5 * 40 + 20 + z % 21)::DOUBLE AS x1, (k % 7 * 20 + 20)::DOUBLE AS y1, z FROM p),
b AS (
 SELECT ord, 0 AS n, x0 + 1 AS x0, y0 + 2 AS y0, x0 + 1 + z % 9 AS x1, y0 + 6 + z % 7 + 1 AS y1 FROM c WHERE ord % 4 = 1
 UNION ALL SELECT ord, 0, x0 + 3, y0 + 2, x0 + 3 + z % 9, y0 + 6 + z % 7 + 3 FROM c WHERE ord % 4 = 2
 UNION ALL SELECT ord, 1, x0 + 11, y0 + 2, x0 + 11 + z % 9, y0 + 6 + z % 7 + 11 FROM c WHERE ord % 4 = 2
 UNION ALL SELECT ord, 0, x0 - 5, y0 - 5, x0 + 60, y0 + 40 FROM c WHERE ord % 4 = 3)
"""


def part_tables(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("table_id")).agg(F.lit(8).alias("num_rows"), F.lit(6).alias("num_cols"))


@query(CELLS + "SELECT ord, (greatest(0, x1 - x0) * (y1 - y0) * cs * rs)::DOUBLE AS area, ((x1 - x0) * cs)::DOUBLE AS w, ((y1 - y0) * rs)::DOUBLE AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, cs > 1 OR rs > 1 AS merged FROM c")
def cell_span_metrics(spark, sf):
    c = F.struct("row", "col", "colspan", "rowspan", "value", "bbox", "blobs")
    return part_cells(spark, sf).withColumn("c", c).select("ord", e.cell_area(F.col("c")).alias("area"), e.cell_width(F.col("c")).alias("w"), e.cell_height(F.col("c")).alias("h"), g.center_x(F.col("bbox")).alias("cx"), g.center_y(F.col("bbox")).alias("cy"), e.is_merged(F.col("c")).alias("merged"))


@query(CELLS + "SELECT ord, value IS NULL OR trim(replace(replace(value, chr(160), ' '), chr(10), ' ')) = '' AS empty FROM c")
def cell_empty(spark, sf):
    return part_cells(spark, sf).select("ord", e.is_blank(F.col("value")).alias("empty"))


@query(CELLS + "SELECT ord, 'Cell(row=' || r || ', col=' || c || ', colspan=' || cs || ', rowspan=' || rs || ', value=' || coalesce(value, 'None') || ')' AS shown FROM c")
def cell_text(spark, sf):
    return part_cells(spark, sf).select("ord", e.cell_text(F.struct("row", "col", "colspan", "rowspan", "value")).alias("shown"))


FREE = CELLS + """, s AS (
 SELECT c.ord, 4 * b.n + 0 AS o, b.x1 + 2 AS x0, c.y0, c.x1, c.y1 FROM c JOIN b USING (ord) WHERE b.x1 + 2 < c.x1
 UNION ALL SELECT c.ord, 4 * b.n + 1, c.x0, c.y0, b.x0 - 2, c.y1 FROM c JOIN b USING (ord) WHERE b.x0 - 2 > c.x0
 UNION ALL SELECT c.ord, 4 * b.n + 2, c.x0, b.y1 + 2, c.x1, c.y1 FROM c JOIN b USING (ord) WHERE b.y1 + 2 < c.y1
 UNION ALL SELECT c.ord, 4 * b.n + 3, c.x0, c.y0, c.x1, b.y0 - 2 FROM c JOIN b USING (ord) WHERE b.y0 - 2 > c.y0),
t AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY (x1 - x0) * (y1 - y0) DESC, o) AS n FROM s)
SELECT c.ord, CASE WHEN c.ord % 4 = 0 THEN c.x0 ELSE t.x0 END AS x_min, CASE WHEN c.ord % 4 = 0 THEN c.y0 ELSE t.y0 END AS y_min,
 CASE WHEN c.ord % 4 = 0 THEN c.x1 ELSE t.x1 END AS x_max, CASE WHEN c.ord % 4 = 0 THEN c.y1 ELSE t.y1 END AS y_max
FROM c LEFT JOIN t ON t.ord = c.ord AND t.n = 1"""


@query(FREE)
def cell_free_space(spark, sf):
    return part_cells(spark, sf).select("ord", e.largest_free_space(F.col("bbox"), F.col("blobs"), 2.0).alias("f")).select("ord", *sides("f"))


@query(CELLS + "SELECT c.ord, c.x0 - 5 AS x_min, c.y1 + 5 AS y_max, coalesce(sum(b.x0 - 5), 0)::DOUBLE AS blob_x FROM c LEFT JOIN b USING (ord) GROUP BY ALL")
def cell_padding(spark, sf):
    padded = e.cell_padding(F.struct("row", "col", "colspan", "rowspan", "value", "bbox", "blobs"), 5)
    total = F.aggregate("c.blobs", F.lit(0.0), lambda s, b: s + b["x_min"])
    return part_cells(spark, sf).select("ord", padded.alias("c")).select("ord", F.col("c.bbox.x_min").alias("x_min"), F.col("c.bbox.y_max").alias("y_max"), total.alias("blob_x"))


@query(CELLS + ", w AS (SELECT *, lead(x0) OVER o AS bx0, lead(y0) OVER o AS by0, lead(x1) OVER o AS bx1, lead(y1) OVER o AS by1 FROM c WINDOW o AS (PARTITION BY table_id ORDER BY ord)) SELECT ord, (greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0)))::DOUBLE AS shared FROM w WHERE bx0 IS NOT NULL")
def cell_intersect(spark, sf):
    """The area each cell shares with the next one of its table."""
    after = F.lead("bbox").over(Window.partitionBy("table_id").orderBy("ord"))
    return part_cells(spark, sf).withColumn("after", after).where("after is not null").select("ord", g.intersect(F.col("bbox"), F.col("after")).alias("shared"))


def nested_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One nested table per brand, its box around its cells."""
    cell = F.struct("row", "col", "colspan", "rowspan", "value", "bbox", "blobs")
    around = [f(f"bbox.{s}") for s, f in (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max))]
    found = part_cells(spark, sf).groupBy("table_id").agg(g.bbox(*around).alias("bbox"), F.array_sort(F.collect_list(F.struct("ord", cell.alias("c")))).alias("cells"))
    return found.select("table_id", F.struct("bbox", F.lit(8).alias("num_rows"), F.lit(6).alias("num_cols"), F.col("cells.c").alias("cells")).alias("t"))


@query(CELLS + "SELECT table_id, (max(x1) - min(x0))::DOUBLE AS w, (max(y1) - min(y0))::DOUBLE AS h, ((max(x1) - min(x0)) * (max(y1) - min(y0)))::DOUBLE AS area, (min(x0) + max(x1)) / 2 AS cx, (min(y0) + max(y1)) / 2 AS cy FROM c GROUP BY table_id")
def table_dims(spark, sf):
    box = F.col("t.bbox")
    return nested_tables(spark, sf).select("table_id", g.width(box).alias("w"), g.height(box).alias("h"), g.area(box).alias("area"), g.center_x(box).alias("cx"), g.center_y(box).alias("cy"))


@query(CELLS + "SELECT table_id, (greatest(0, least(max(x1), 120) - greatest(min(x0), 20)) * greatest(0, least(max(y1), 90) - greatest(min(y0), 15)))::DOUBLE AS shared FROM c GROUP BY table_id")
def table_intersect(spark, sf):
    """The area each table shares with a fixed box."""
    return nested_tables(spark, sf).select("table_id", g.intersect(F.col("t.bbox"), g.bbox(20, 15, 120, 90)).alias("shared"))


@query(CELLS + "SELECT table_id, min(x0) - 4 AS x_min, max(y1) + 4 AS y_max, (min_by(x0, ord) - 4)::DOUBLE AS first_x, bool_and(r < 8 AND c < 6 AND r + rs <= 8 AND c + cs <= 6) AS structure_ok FROM c GROUP BY table_id")
def table_padding(spark, sf):
    padded = e.table_padding(F.col("t"), 4)
    out = nested_tables(spark, sf).select("table_id", padded.alias("p"), e.structure_ok(F.col("t")).alias("structure_ok"))
    return out.select("table_id", F.col("p.bbox.x_min").alias("x_min"), F.col("p.bbox.y_max").alias("y_max"), F.get(F.col("p.cells"), F.lit(0))["bbox"]["x_min"].alias("first_x"), "structure_ok")


def _listed(axis: str, merged: bool) -> str:
    at, span, n = ("r", "rs", 8) if axis == "row" else ("c", "cs", 6)
    last = f"least({at} + {span}, {n}) - 1" if merged else at
    return CELLS + f""", l AS (SELECT table_id, unnest(range(0, {n})) AS line FROM (SELECT DISTINCT table_id FROM c)),
h AS (SELECT table_id, unnest(range({at}, {last} + 1)) AS line, ord FROM c)
SELECT l.table_id, l.line::BIGINT AS line, count(h.ord)::BIGINT AS n, coalesce(string_agg(h.ord::VARCHAR, ',' ORDER BY h.ord), '') AS cells
FROM l LEFT JOIN h ON h.table_id = l.table_id AND h.line = l.line GROUP BY ALL"""


def _lines(axis: str, merged: bool, spark, sf) -> DataFrame:
    found = tables.lines(part_cells(spark, sf), part_tables(spark, sf), ["table_id"], axis, merged)
    return found.select("table_id", *big("line"), F.size("cells").cast("bigint").alias("n"), F.array_join(F.transform("cells.ord", lambda o: o.cast("string")), ",").alias("cells"))


@query(_listed("row", False))
def table_rows(spark, sf):
    return _lines("row", False, spark, sf)


@query(_listed("row", True))
def table_rows_merged(spark, sf):
    return _lines("row", True, spark, sf)


@query(_listed("col", False))
def table_cols(spark, sf):
    return _lines("col", False, spark, sf)


@query(_listed("col", True))
def table_cols_merged(spark, sf):
    return _lines("col", True, spark, sf)


@query(CELLS + "SELECT table_id, r AS row, c AS col, max(ord) AS ord, arg_max(rs, ord) AS rowspan FROM c GROUP BY ALL")
def table_get_cell(spark, sf):
    return tables.get_cell(part_cells(spark, sf), ["table_id"]).select("table_id", "row", "col", "ord", "rowspan")


@query(CELLS + ", h AS (SELECT ord, avg(greatest(0, y1 - y0)) AS h FROM b GROUP BY ord) SELECT c.table_id, round(coalesce(median(h.h), 0), 9)::DOUBLE AS median FROM c LEFT JOIN h USING (ord) GROUP BY c.table_id")
def table_median_blob_height(spark, sf):
    found = tables.median_blob_height(part_cells(spark, sf), part_tables(spark, sf), ["table_id"])
    return found.select("table_id", F.round("median", 9).alias("median"))


@query(CELLS + ", s AS (SELECT table_id, r % 3 AS part, max(r + rs) AS nr, max(c + cs) AS nc, count(*) AS n FROM c GROUP BY ALL) SELECT table_id, part::BIGINT AS part, nr::BIGINT AS num_rows, nc::BIGINT AS num_cols, n::BIGINT AS num_cells, nr > 1 AND nc > 1 AND n > 1 AS valid FROM s")
def table_valid(spark, sf):
    found = tables.summarize(part_cells(spark, sf).withColumn("part", F.col("row") % 3), ["table_id", "part"])
    return found.select("table_id", *big("part", "num_rows", "num_cols", "num_cells"), "valid")


@query(CELLS + "SELECT table_id, bool_and(r < 8 AND c < 6 AND r + rs <= 8 AND c + cs <= 6) AS structure_ok FROM c GROUP BY table_id")
def table_structure_ok(spark, sf):
    return tables.structure(part_cells(spark, sf), part_tables(spark, sf), ["table_id"])


# Text layers and paragraphs.

LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, t, 20.0::DOUBLE * i AS y0, 20.0::DOUBLE * i + 16 AS y1, 8.0::DOUBLE * length(t) AS x1, 20.0::DOUBLE * count(*) OVER (PARTITION BY doc_id) AS h FROM l)
"""


def doc_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Line i of a document as a paragraph at height 20 i."""
    d = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rows = d.select("doc_id", (F.size("l") * 20.0).alias("page_height"), F.posexplode("l").alias("ord", "text"))
    box = g.bbox(0, F.col("ord") * 20.0, F.length("text") * 8.0, F.col("ord") * 20.0 + 16)
    return rows.select("doc_id", "ord", "page_height", F.concat(F.lit("p"), F.col("ord")).alias("id"), "text", F.lit(TEXT).alias("type"), box.alias("bbox"), F.array(box).alias("blobs"))


@query(LINES + "SELECT doc_id, i::BIGINT AS ord, CASE WHEN y0 < h * 0.15::DOUBLE THEN 0 WHEN y1 > h * (1 - 0.15::DOUBLE) THEN 1 ELSE 2 END::BIGINT AS type FROM p")
def paragraph_classify(spark, sf):
    p = doc_paragraphs(spark, sf)
    return p.select("doc_id", *big("ord"), e.classify(F.col("type"), F.col("bbox"), F.col("page_height")).cast("bigint").alias("type"))


@query(LINES + "SELECT doc_id, string_agg('p' || i, '+' ORDER BY i) AS id, md5(regexp_replace(string_agg(t, ' ' ORDER BY i), '^[\\s\\x{A0}\\x{85}\\p{Z}]+|[\\s\\x{A0}\\x{85}\\p{Z}]+$', '', 'g')) AS text_md5, max(x1) AS x_max, max(y1) AS y_max, count(*)::BIGINT AS blobs FROM p GROUP BY doc_id")
def paragraph_merge(spark, sf):
    m = tables.merge_paragraphs(doc_paragraphs(spark, sf), ["doc_id"])
    return m.select("doc_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("bbox.x_max").alias("x_max"), F.col("bbox.y_max").alias("y_max"), F.size("blobs").cast("bigint").alias("blobs"))


@query(LINES + "SELECT doc_id, i::BIGINT AS ord, (-3.0)::DOUBLE AS x_min, y1 + 3 AS y_max, 2::BIGINT AS type, trim(t) = '' AND length(regexp_replace(t, '[\\s\\x{A0}\\x{85}\\p{Z}]+', '', 'g')) = 0 AS empty FROM p")
def paragraph_padding(spark, sf):
    p = doc_paragraphs(spark, sf).withColumn("p", F.struct("id", "text", F.lit(HEADER).alias("type"), "bbox", "blobs"))
    out = p.select("doc_id", *big("ord"), e.paragraph_padding(F.col("p"), 3).alias("q"))
    return out.select("doc_id", "ord", F.col("q.bbox.x_min").alias("x_min"), F.col("q.bbox.y_max").alias("y_max"), F.col("q.type").cast("bigint").alias("type"), e.is_blank(F.col("q.text")).alias("empty"))


@query(LINES + "SELECT doc_id, i::BIGINT AS ord, x1 AS w, 16.0::DOUBLE AS h, 16 * x1 AS area, x1 / 2 AS cx, (y0 + y1) / 2 AS cy, (greatest(0, least(x1, 300) - 100) * greatest(0, least(y1 + 0.0, 210) - greatest(y0, 30)))::DOUBLE AS shared FROM p")
def paragraph_dims(spark, sf):
    """Width, height, area, centre, and the area shared with a fixed box."""
    p, box = doc_paragraphs(spark, sf), F.col("bbox")
    return p.select("doc_id", *big("ord"), g.width(box).alias("w"), g.height(box).alias("h"), g.area(box).alias("area"), g.center_x(box).alias("cx"), g.center_y(box).alias("cy"), g.intersect(box, g.bbox(100, 30, 300, 210)).alias("shared"))


@query("SELECT doc_id, (n_chars * 200 / 72.0)::DOUBLE AS pixels FROM documents")
def page_pixel_size(spark, sf):
    return read(spark, sf, "documents").select("doc_id", documents.pixel_size(F.col("n_chars").cast("double"), 200).alias("pixels"))


@query("SELECT doc_id, coalesce(doc_id, 0) % 2 = 0 AS accepted, CASE WHEN coalesce(doc_id, 0) % 2 = 0 THEN octet_length(encode('%PDF' || coalesce(text, '')))::BIGINT END AS size FROM documents")
def act_submit(spark, sf):
    raw = F.concat(F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, "%PDF").otherwise("GIF8"), F.coalesce("text", F.lit("")))
    asked = read(spark, sf, "documents").select("doc_id", documents.encode_base64(raw.cast("binary")).alias("document"))
    return acts.submit(asked).select("doc_id", "accepted", F.octet_length("pdf").cast("bigint").alias("size"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^[\\s\\x{A0}\\x{85}\\p{Z}]+|[\\s\\x{A0}\\x{85}\\p{Z}]+$', '', 'g')) > 10 AS has_text FROM documents")
def text_layer(spark, sf):
    return read(spark, sf, "documents").select("doc_id", documents.has_text_layer(F.col("text")).alias("has_text"))


# Recognised words on pages.

WORDS = """WITH w AS (SELECT event_id AS ord, user_id % 20 AS page, event_type AS text, CAST(json_extract(props, '$.k') AS INT) / 100.0::DOUBLE AS conf,
 (event_id % 211)::DOUBLE AS cx, (floor(value * 10)::BIGINT % 97)::DOUBLE AS cy FROM events),
b AS (SELECT s_suppkey AS id, s_suppkey % 20 AS page, (s_suppkey // 20 * 37 % 180)::DOUBLE AS x0, (s_suppkey // 20 * 53 % 80)::DOUBLE AS y0 FROM supplier),
c AS (SELECT id, page, x0, y0, x0 + 30 AS x1, y0 + 15 AS y1 FROM b)
"""


def page_words(spark: SparkSession, sf: str) -> DataFrame:
    w = read(spark, sf, "events")
    cx, cy = (F.col("event_id") % 211).cast("double"), (F.floor(F.col("value") * 10) % 97).cast("double")
    confidence = F.get_json_object("props", "$.k").cast("int") / 100.0
    return w.select((F.col("user_id") % 20).alias("page"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"), confidence.alias("confidence"), g.bbox(cx - 3, cy - 2, cx + 3, cy + 2).alias("bbox"))


def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    s, k = read(spark, sf, "supplier"), F.expr("s_suppkey div 20")
    x, y = k * 37 % 180, k * 53 % 80
    return s.select((F.col("s_suppkey") % 20).alias("page"), F.col("s_suppkey").alias("id"), g.bbox(x, y, x + 30, y + 15).alias("bbox"))


@query(WORDS + "SELECT c.id, count(w.ord)::BIGINT AS n, md5(coalesce(string_agg(w.text || chr(10), '' ORDER BY w.ord), '')) AS value_md5 FROM c LEFT JOIN w ON w.page = c.page AND w.cx BETWEEN c.x0 AND c.x1 AND w.cy BETWEEN c.y0 AND c.y1 GROUP BY c.id")
def word_to_cell(spark, sf):
    """Digests are taken of each place's words, before boxes that lie alike get them."""
    boxes = page_boxes(spark, sf)
    found = spatial.box_contents(boxes, page_words(spark, sf), ["page"]).select("page", "bbox", "n", F.md5(F.col("value").cast("binary")).alias("value_md5"))
    return boxes.join(found, ["page", "bbox"], "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("value_md5", F.md5(F.lit("").cast("binary"))).alias("value_md5"))


@query(WORDS + "SELECT page, count(*)::BIGINT AS n FROM w WHERE conf >= 0.7 GROUP BY page")
def word_confidence(spark, sf):
    return spatial.confident(page_words(spark, sf)).groupBy("page").agg(F.count("*").alias("n"))


@query(WORDS + "SELECT ord, page FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = w.page AND w.cx BETWEEN c.x0 - 5 AND c.x1 + 5 AND w.cy BETWEEN c.y0 - 5 AND c.y1 + 5)")
def leftover_paragraphs(spark, sf):
    return spatial.leftover_words(page_words(spark, sf), page_boxes(spark, sf), ["page"]).select("ord", "page")


@query("SELECT id, ord, (ord + 1)::VARCHAR AS text, round((ord + 1) / 10.0, 6)::DOUBLE AS score, (ord + 1)::DOUBLE AS x_min, (ord + 3)::DOUBLE AS y_max FROM (SELECT event_id AS id, unnest(range(0, least(event_id % 4, user_id % 5)))::BIGINT AS ord FROM events WHERE least(event_id % 4, user_id % 5) > 0)")
def ocr_zip(spark, sf):
    ev = read(spark, sf, "events")
    upto = lambda n, make: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), make)
    boxes = upto(F.col("event_id") % 4, lambda i: F.array(i, i, i + 1, i + 2))
    texts, scores = upto(F.col("user_id") % 5, lambda i: i.cast("string")), upto(F.col("user_id") % 5, lambda i: i / 10.0)
    found = spatial.zip_results(ev.select(F.col("event_id").alias("id"), boxes.alias("rec_boxes"), texts.alias("rec_texts"), scores.alias("rec_scores")), ["id"])
    return found.select("id", *big("ord"), "text", F.round("confidence", 6).alias("score"), F.col("bbox.x_min").alias("x_min"), F.col("bbox.y_max").alias("y_max"))


# Rasters.

P = ["page"]


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int"))
    return raster.explode_pixels(read(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), v.alias("v")), P, "v", 8)


PX = """WITH e AS (SELECT vec_id AS page, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT page, (i // 8)::INT AS y, (i % 8)::INT AS x, least(greatest(floor((f::DOUBLE + 0.6) * 200), 0), 255)::INT AS v FROM e)
"""
OTSU = PX + """, lv AS (SELECT page, v, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
cu AS (SELECT page, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY page) AS n, sum(n * v) OVER (PARTITION BY page) AS s FROM lv WINDOW u AS (PARTITION BY page ORDER BY v)),
bt AS (SELECT page, v, CASE WHEN n > w0 THEN w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) * (s0 / w0 - (s - s0) / (n - w0)) ELSE 0 END AS between FROM cu),
th AS (SELECT page, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY between DESC, v) AS k FROM bt) WHERE k = 1),
bin AS (SELECT px.page, y, x, CASE WHEN v > threshold THEN 0 ELSE 255 END AS v FROM px JOIN th USING (page))
"""


def ink(spark: SparkSession, sf: str) -> DataFrame:
    return raster.binarize(pixels(spark, sf), P)


@query(PX + "SELECT page, y, x, ((v * 1868 + (v + x) * 9617 + (v + y) * 4899 + 8192) >> 14)::INT AS gray FROM px")
def gray_px(spark, sf):
    v = F.col("v")
    return pixels(spark, sf).select("page", "y", "x", raster.gray(v, v + F.col("x"), v + F.col("y")).alias("gray"))


@query(PX + "SELECT page, round(CASE WHEN avg(v) = 0 THEN 0 ELSE least(1, stddev_pop(v) / avg(v)) END, 6)::DOUBLE AS contrast FROM px GROUP BY page")
def contrast(spark, sf):
    return raster.contrast(pixels(spark, sf), P).select("page", F.round("contrast", 6).alias("contrast"))


@query(PX + ", m AS (SELECT page, avg(v::DOUBLE) AS b, avg((v + 3 * x)::DOUBLE) AS g, avg((v + page % 11 * y)::DOUBLE) AS r FROM px GROUP BY page) SELECT page, round(greatest(abs(b - g), abs(b - r), abs(g - r)), 6) AS max_diff, greatest(abs(b - g), abs(b - r), abs(g - r)) > 15 AS has_colored_bg FROM m")
def colored_bg(spark, sf):
    v = F.col("v")
    px = pixels(spark, sf).select("page", v.alias("b"), (v + 3 * F.col("x")).alias("g"), (v + F.col("page") % 11 * F.col("y")).alias("r"))
    return raster.colored_background(px, P).select("page", F.round("max_diff", 6).alias("max_diff"), "has_colored_bg")


LAP = PX + """, n AS (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER d AS u, lead(v) OVER d AS w FROM px WINDOW h AS (PARTITION BY page, y ORDER BY x), d AS (PARTITION BY page, x ORDER BY y)),
lap AS (SELECT page, coalesce(l, r) + coalesce(r, l) + coalesce(u, w) + coalesce(w, u) - 4 * v AS lap FROM n)
"""


@query(LAP + "SELECT page, round(var_pop(lap) * 4096)::BIGINT AS sharpness FROM lap GROUP BY page")
def laplacian_sharpness(spark, sf):
    return raster.sharpness(pixels(spark, sf), P).select("page", F.round(F.col("sharpness") * 4096).cast("bigint").alias("sharpness"))


@query(PX + """, r AS (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS rr FROM px WINDOW h AS (PARTITION BY page, y ORDER BY x)),
s AS (SELECT page, y, x, v, coalesce(l, rr) + v + coalesce(rr, l) AS s FROM r),
t AS (SELECT *, lag(s) OVER d AS u, lead(s) OVER d AS w FROM s WINDOW d AS (PARTITION BY page, x ORDER BY y))
SELECT page, y, x, least(greatest(10 * v - (coalesce(u, w) + s + coalesce(w, u)), 0), 255)::INT AS sharp FROM t""")
def sharpen_px(spark, sf):
    return raster.sharpen(pixels(spark, sf), P).select("page", "y", "x", "sharp")


@query(OTSU + "SELECT page, threshold FROM th")
def otsu_threshold(spark, sf):
    return raster.otsu(pixels(spark, sf), P)


@query(PX + """, r AS (SELECT *, coalesce(lag(v) OVER h, v) AS l, coalesce(lead(v) OVER h, v) AS rr FROM px WINDOW h AS (PARTITION BY page, y ORDER BY x)),
nine AS (SELECT page, y, x, v, l, rr, lag([l, v, rr]) OVER d AS u, lead([l, v, rr]) OVER d AS w FROM r WINDOW d AS (PARTITION BY page, x ORDER BY y))
SELECT page, y, x, list_sort(list_concat(list_concat(coalesce(u, [l, v, rr]), [l, v, rr]), coalesce(w, [l, v, rr])))[5]::INT AS v FROM nine""")
def median_px(spark, sf):
    return raster.median3(pixels(spark, sf), P).select("page", "y", "x", "v")


def blur_sql(size: int, sigma: float) -> str:
    """``bl``: px blurred by a window of a size, down and then across; beyond an edge as ``raster.convolve`` says."""
    reach = size // 2
    place = (lambda e: f"least(({e}) % 14, 14 - ({e}) % 14)") if reach < 8 else (lambda e: f"least(({e}) % 16, 15 - ({e}) % 16)")
    turn = 14 * 8 if reach < 8 else 16 * 8
    return PX + f""", wt AS (SELECT i, exp(-((i - {reach}) * (i - {reach})) / (2 * {sigma}::DOUBLE * {sigma})) AS w FROM range({size}) r(i)), ws AS (SELECT i, w / (SELECT sum(w) FROM wt) AS w FROM wt),
mi AS (SELECT p.n AS p, i, w, ({place(f"p.n + i - {reach} + {turn}")})::INT AS q FROM range(8) p(n), ws),
dn AS (SELECT page, p::INT AS y, x, sum(w * v) AS v FROM px JOIN mi ON px.y = mi.q GROUP BY ALL),
bl AS (SELECT page, y, p::INT AS x, least(greatest(round_even(sum(w * v), 0), 0), 255)::INT AS m FROM dn JOIN mi ON dn.x = mi.q GROUP BY ALL)
"""


@query(blur_sql(35, 5.6) + "SELECT page, y, x, CASE WHEN v > m - 11 THEN 255 ELSE 0 END::INT AS v FROM px JOIN bl USING (page, y, x)")
def adaptive_threshold_px(spark, sf):
    return raster.adaptive_threshold(pixels(spark, sf), P).select("page", "y", "x", "v")


@query(blur_sql(7, 1.0) + "SELECT page, y, x, least(greatest(round_even(2.0::DOUBLE * v - m, 0), 0), 255)::INT AS v FROM px JOIN bl USING (page, y, x)")
def unsharp_px(spark, sf):
    return raster.unsharp(pixels(spark, sf), P).select("page", "y", "x", "v")


@query(blur_sql(7, 1.4) + "SELECT page, y, x, m AS v FROM bl")
def gaussian_px(spark, sf):
    """The blur of seven by seven."""
    return raster.gaussian(pixels(spark, sf), P, 7).select("page", "y", "x", "v")


TURNS = (-7.3, 2.5, 31.0)


@query(PX + """, a AS (SELECT unnest([-7.3::DOUBLE, 2.5, 31.0]) AS turn), f AS (SELECT page, turn, y, x, least(greatest(cos(radians(turn)) * (x - 4.0::DOUBLE) - sin(radians(turn)) * (y - 4.0::DOUBLE) + 4, 0), 7) AS fx,
  least(greatest(sin(radians(turn)) * (x - 4.0::DOUBLE) + cos(radians(turn)) * (y - 4.0::DOUBLE) + 4, 0), 7) AS fy FROM px, a),
g AS (SELECT *, floor(fx)::INT AS x0, floor(fy)::INT AS y0, fx - floor(fx) AS ax, fy - floor(fy) AS ay FROM f)
SELECT g.page, turn, g.y, g.x, round_even((a.v * (1 - ax) + b.v * ax) * (1 - ay) + (c.v * (1 - ax) + d.v * ax) * ay, 0)::INT AS v FROM g
JOIN px a ON a.page = g.page AND a.y = y0 AND a.x = x0 JOIN px b ON b.page = g.page AND b.y = y0 AND b.x = least(x0 + 1, 7)
JOIN px c ON c.page = g.page AND c.y = least(y0 + 1, 7) AND c.x = x0 JOIN px d ON d.page = g.page AND d.y = least(y0 + 1, 7) AND d.x = least(x0 + 1, 7)""")
def rotate_px(spark, sf):
    """Every raster at three angles."""
    px = pixels(spark, sf)
    turned = [raster.rotate(px, P, 8, 8, turn).select("page", F.lit(turn).alias("turn"), "y", "x", "v") for turn in TURNS]
    return turned[0].unionByName(turned[1]).unionByName(turned[2])


@query(PX + """, hs AS (SELECT page, y // 3 AS ty, x // 3 AS tx, v, count(*) AS n FROM (SELECT page, x, v, y FROM (SELECT page, x, v, unnest(CASE WHEN y = 6 THEN [6, 8] ELSE [y] END) AS y FROM (SELECT page, y, v, unnest(CASE WHEN x = 6 THEN [6, 8] ELSE [x] END) AS x FROM px))) GROUP BY ALL),
ov AS (SELECT page, ty, tx, sum(greatest(n - 1, 0)) AS over FROM hs GROUP BY ALL),
lw AS (SELECT o.page, o.ty, o.tx, u.n::INT AS v, least(coalesce(h.n, 0), 1) + over // 256 + CASE WHEN u.n < over % 256 THEN 1 ELSE 0 END AS n FROM ov o CROSS JOIN range(256) u(n) LEFT JOIN hs h ON h.page = o.page AND h.ty = o.ty AND h.tx = o.tx AND h.v = u.n),
cu AS (SELECT page, ty, tx, v, least(sum(n) OVER (PARTITION BY page, ty, tx ORDER BY v) * (255.0::DOUBLE / 9), 255) AS c FROM lw),
q AS (SELECT *, floor(y / 3.0::DOUBLE - 0.5)::INT AS y0, floor(x / 3.0::DOUBLE - 0.5)::INT AS x0 FROM px),
w AS (SELECT *, y / 3.0::DOUBLE - 0.5 - y0 AS ay, x / 3.0::DOUBLE - 0.5 - x0 AS ax FROM q)
SELECT w.page, w.y, w.x, least(greatest(round_even((a.c * (1 - ax) + b.c * ax) * (1 - ay) + (c.c * (1 - ax) + d.c * ax) * ay, 0), 0), 255)::INT AS v FROM w
JOIN cu a ON a.page = w.page AND a.v = w.v AND a.ty = greatest(y0, 0) AND a.tx = greatest(x0, 0) JOIN cu b ON b.page = w.page AND b.v = w.v AND b.ty = greatest(y0, 0) AND b.tx = least(x0 + 1, 2)
JOIN cu c ON c.page = w.page AND c.v = w.v AND c.ty = least(y0 + 1, 2) AND c.tx = greatest(x0, 0) JOIN cu d ON d.page = w.page AND d.v = w.v AND d.ty = least(y0 + 1, 2) AND d.tx = least(x0 + 1, 2)""")
def clahe_px(spark, sf):
    """Three by three tiles of three by three pixels, the last ones mirrored."""
    return raster.clahe(pixels(spark, sf), P, 8, 8, 2.0, 3).select("page", "y", "x", "v")


SKEW = OTSU + """, two AS (SELECT page FROM px GROUP BY page HAVING min(v) < max(v)),
ed AS (SELECT b.page, y, x FROM (SELECT *, lag(v) OVER (PARTITION BY page, x ORDER BY y) AS up FROM bin) b JOIN two USING (page) WHERE v = 255 AND coalesce(up, 0) = 0),
vo AS (SELECT page, a, round_even(y - x * tan(radians(a / 10.0::DOUBLE)), 0) AS at, count(*) AS n FROM ed, range(-100, 101) r(a) GROUP BY ALL),
su AS (SELECT page, a, sum(n * n) AS worth, sum(n) AS m FROM vo GROUP BY ALL),
be AS (SELECT page, a FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY worth DESC, abs(a), a) AS k FROM su WHERE m > 1) WHERE k = 1)
SELECT page, (coalesce(a, 0) / 10.0)::DOUBLE AS skew_angle, abs(coalesce(a, 0)) > 5 AS has_skew FROM (SELECT DISTINCT page FROM px) LEFT JOIN be USING (page)"""


@query(SKEW)
def skew_votes(spark, sf):
    """The skew of every raster by votes as rows."""
    return raster.skew(pixels(spark, sf), P).select("page", "skew_angle", (F.abs("skew_angle") > 0.5).alias("has_skew"))


@query(PX + "SELECT page, round(least(greatest(ln(0.5) / ln(least(greatest(avg(v::DOUBLE) / 255.0, 0.001), 0.999)), 0.6), 1.6), 6) AS gamma FROM px GROUP BY page")
def auto_gamma(spark, sf):
    return raster.auto_gamma(pixels(spark, sf), P).select("page", F.round("gamma", 6).alias("gamma"))


@query(LAP + ", s AS (SELECT page, var_pop(lap) AS s FROM lap GROUP BY page) SELECT page, s < 500 AS has_blur FROM s")
def quality_flags(spark, sf):
    return raster.sharpness(pixels(spark, sf), P).select("page", (F.col("sharpness") < 500).alias("has_blur"))


@query(OTSU + "SELECT page, y, x, min(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM bin")
def erode_row(spark, sf):
    return raster.erode(ink(spark, sf), P, "x", 3)


@query(OTSU + ", er AS (SELECT page, y, x, min(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM bin) SELECT page, y, x, max(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM er")
def open_row(spark, sf):
    return raster.opening(ink(spark, sf), P, "x", 3)


def _morph(of: str, f: str, axis: str, n: int) -> str:
    other = "y" if axis == "x" else "x"
    return f"(SELECT page, y, x, {f}(v) OVER (PARTITION BY page, {other} ORDER BY {axis} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS v FROM {of})"


@query(OTSU + "SELECT page, y, x, v FROM " + _morph(_morph(_morph(_morph("bin", "max", "x", 1), "max", "y", 2), "min", "x", 1), "min", "y", 2))
def close_rect(spark, sf):
    return raster.closing(ink(spark, sf), P, 3, 5)


@query(OTSU + "SELECT page, y, x, v FROM " + _morph(_morph(_morph("bin", "min", "x", 2), "max", "x", 2), "max", "x", 2))
def detect_lines(spark, sf):
    return raster.detect_lines(ink(spark, sf), P, "horizontal", 3)


@query(OTSU + "SELECT page, y, x, v FROM " + _morph(_morph(_morph("bin", "min", "y", 2), "max", "y", 2), "max", "y", 2))
def detect_lines_vertical(spark, sf):
    return raster.detect_lines(ink(spark, sf), P, "vertical", 3)


@query(OTSU + ", g AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS g FROM bin WHERE v > 0) SELECT page, y AS line, min(x) AS start, max(x) AS stop, (max(x) - min(x) + 1)::INT AS length FROM g GROUP BY page, y, g")
def line_runs(spark, sf):
    return raster.runs(ink(spark, sf), P).select("page", "line", "start", "stop", "length")


@query(OTSU + ", r AS (SELECT page, y, x, v AS va, max(v) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS vb FROM bin) SELECT page, y, x, (va & vb)::INT AS both, (va | vb)::INT AS either, least(va + vb, 255)::INT AS added FROM r")
def mask_and_or(spark, sf):
    mask = ink(spark, sf)
    return raster.combine_masks(mask, raster.dilate(mask, P, "y", 3), P)


@query(OTSU + "SELECT page, y, x, CASE WHEN x BETWEEN page % 5 - 1 AND page % 5 + 2 AND y BETWEEN 1 AND 4 THEN 0 ELSE v END AS v FROM bin")
def erase_boxes(spark, sf):
    mask = ink(spark, sf)
    boxes = read(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), g.bbox(F.col("vec_id") % 5, 2, F.col("vec_id") % 5 + 1, 3).alias("bbox"))
    return raster.erase_boxes(mask, boxes, P, 1).select("page", "y", "x", "v")


@query(OTSU + ", ln AS (SELECT page, y, x, v FROM bin WHERE false UNION ALL SELECT page, y, x, CASE WHEN y = 3 THEN v ELSE 0 END FROM bin), wd AS " + _morph(_morph("ln", "max", "x", 1), "max", "y", 1) + " SELECT px.page, px.y, px.x, CASE WHEN wd.v > 0 THEN 255 ELSE px.v END AS v FROM px JOIN wd USING (page, y, x)")
def remove_lines(spark, sf):
    lines = ink(spark, sf).withColumn("v", F.when(F.col("y") == 3, F.col("v")).otherwise(0))
    return raster.remove_lines(pixels(spark, sf), lines, P, 1)


# Grids.

PEAK = OTSU + """, pr AS (SELECT page, x AS pos, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM bin GROUP BY ALL),
pk AS (SELECT page, pos FROM (SELECT *, greatest(0.003::DOUBLE, 0.9::DOUBLE * max(share) OVER (PARTITION BY page)) AS t FROM pr) WHERE share >= t),
rc AS (SELECT page, ((min(pos) + max(pos)) // 2)::INT AS center FROM (SELECT page, pos, pos - row_number() OVER (PARTITION BY page ORDER BY pos) AS g FROM pk) GROUP BY page, g)
"""


@query(PEAK + "SELECT page, pos FROM pk")
def profile_peaks(spark, sf):
    return grid.peaks(grid.profile(ink(spark, sf), P, "x"), P, part=0.9).select("page", F.col("at").alias("pos"))


@query(PEAK + "SELECT page, center FROM rc")
def run_centers(spark, sf):
    return grid.run_centers(grid.peaks(grid.profile(ink(spark, sf), P, "x"), P, part=0.9), P)


FILTER = """WITH RECURSIVE w AS (SELECT user_id, array_agg(DISTINCT CAST(floor(value * 10) AS BIGINT) ORDER BY CAST(floor(value * 10) AS BIGINT)) AS c FROM events GROUP BY user_id),
f AS (SELECT user_id, c, 1 AS i, c[1] AS last, true AS kept FROM w
 UNION ALL SELECT user_id, c, i + 1, CASE WHEN c[i + 1] - last >= 25 THEN c[i + 1] ELSE last END, c[i + 1] - last >= 25 FROM f WHERE i < len(c))
SELECT user_id, string_agg(c[i]::VARCHAR, ',' ORDER BY i) AS coords FROM f WHERE kept GROUP BY user_id"""


@query(FILTER)
def filter_close(spark, sf):
    at = F.floor(F.col("value") * 10).cast("int")
    coords = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(at)).alias("c"))
    return coords.select("user_id", F.array_join(F.transform(grid.keep_apart(F.col("c"), 25), lambda x: x.cast("string")), ",").alias("coords"))


def _coords(axis: str) -> str:
    return f""", {axis}p AS (SELECT page, {axis} AS pos, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM bin GROUP BY ALL),
{axis}k AS (SELECT page, pos FROM (SELECT *, greatest(0.003::DOUBLE, 0.25::DOUBLE * max(share) OVER (PARTITION BY page)) AS t FROM {axis}p) WHERE share >= t),
{axis}r AS (SELECT page, ((min(pos) + max(pos)) // 2)::INT AS c FROM (SELECT page, pos, pos - row_number() OVER (PARTITION BY page ORDER BY pos) AS g FROM {axis}k) GROUP BY page, g
 UNION SELECT DISTINCT page, 0 FROM bin UNION SELECT DISTINCT page, 7 FROM bin),
{axis}l AS (SELECT page, array_agg(c ORDER BY c) AS l FROM {axis}r GROUP BY page),
{axis}f AS (SELECT page, l, 1 AS i, l[1] AS last, true AS kept FROM {axis}l UNION ALL SELECT page, l, i + 1, CASE WHEN l[i + 1] - last >= 2 THEN l[i + 1] ELSE last END, l[i + 1] - last >= 2 FROM {axis}f WHERE i < len(l)),
{axis}s AS (SELECT page, last AS lo, lead(last) OVER w AS hi, row_number() OVER w - 1 AS n FROM {axis}f WHERE kept WINDOW w AS (PARTITION BY page ORDER BY i))"""


GRID = OTSU.replace("WITH e", "WITH RECURSIVE e", 1) + _coords("x") + _coords("y")


@query(GRID + " SELECT ys.page, ys.n::BIGINT AS row, xs.n::BIGINT AS col, xs.lo::DOUBLE AS x_min, ys.lo::DOUBLE AS y_min, xs.hi::DOUBLE AS x_max, ys.hi::DOUBLE AS y_max FROM ys JOIN xs USING (page) WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL")
def grid_cells_flagship(spark, sf):
    """Rasters to table cells: threshold, profiles, line centres, greedy thinning, grid."""
    mask = ink(spark, sf)
    cells = grid.base_cells(grid.grid_coords(mask, P, "x", 2), grid.grid_coords(mask, P, "y", 2), P)
    return cells.select("page", *big("row", "col"), *sides("bbox"))


@query(GRID + " SELECT ys.page, count(*)::BIGINT AS cells FROM ys JOIN xs USING (page) WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL GROUP BY ys.page")
def cell_cross_grid(spark, sf):
    return grid_cells_flagship(spark, sf).groupBy("page").agg(F.count("*").alias("cells"))


@query(GRID + """, cl AS (SELECT ys.page, ys.n AS r, xs.n AS c, xs.hi AS pos, ys.lo AS y0, ys.hi AS y1, max(xs.n) OVER (PARTITION BY ys.page) AS m FROM ys JOIN xs USING (page) WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL),
ht AS (SELECT cl.page, r, c, count(DISTINCT bin.y) AS n FROM cl JOIN bin ON bin.page = cl.page AND bin.v > 0 AND abs(bin.x - pos) <= 1 AND bin.y >= y0 AND bin.y < y1 GROUP BY ALL)
SELECT cl.page, cl.r::BIGINT AS row, cl.c::BIGINT AS col, coalesce(ht.n, 0) / (y1 - y0)::DOUBLE >= 0.8 AS border FROM cl LEFT JOIN ht ON ht.page = cl.page AND ht.r = cl.r AND ht.c = cl.c WHERE cl.c < m""")
def gap_matrix(spark, sf):
    mask = ink(spark, sf)
    found = grid.borders_of(mask, grid.grid_lines(mask, P, 2), P, True, 1)
    return found.select("page", *big("row", "col"), "border")


@query(GRID + """, cl AS (SELECT ys.page, ys.n AS r, xs.n AS c, ys.hi AS pos, xs.lo AS x0, xs.hi AS x1, max(ys.n) OVER (PARTITION BY ys.page) AS m FROM ys JOIN xs USING (page) WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL),
ht AS (SELECT cl.page, r, c, count(DISTINCT bin.x) AS n FROM cl JOIN bin ON bin.page = cl.page AND bin.v > 0 AND abs(bin.y - pos) <= 1 AND bin.x >= x0 AND bin.x < x1 GROUP BY ALL)
SELECT cl.page, cl.r::BIGINT AS row, cl.c::BIGINT AS col, coalesce(ht.n, 0) / (x1 - x0)::DOUBLE >= 0.8 AS border FROM cl LEFT JOIN ht ON ht.page = cl.page AND ht.r = cl.r AND ht.c = cl.c WHERE cl.r < m""")
def gap_matrix_rows(spark, sf):
    mask = ink(spark, sf)
    found = grid.borders_of(mask, grid.grid_lines(mask, P, 2), P, False, 1)
    return found.select("page", *big("row", "col"), "border")


def full_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel as a cell of 10 by 10; a border follows where its value divides by 3."""
    px = pixels(spark, sf)
    x, y = F.col("x") * 10, F.col("y") * 10
    return px.select("page", F.col("y").alias("row"), F.col("x").alias("col"), g.bbox(x, y, x + 10, y + 10).alias("bbox"), (F.col("v") % 3 == 0).alias("border"))


def _spans(along: str, across: str) -> str:
    return f"""(SELECT page, {across} AS across, min({along}) AS first, count(*) AS n FROM (
 SELECT page, y, x, sum(s) OVER (PARTITION BY page, {across} ORDER BY {along}) AS g FROM (
  SELECT page, y, x, CASE WHEN coalesce(lag(v % 3 = 0) OVER (PARTITION BY page, {across} ORDER BY {along}), true) THEN 1 ELSE 0 END AS s FROM px)) GROUP BY page, {across}, g)"""


@query(PX + "SELECT page, across::BIGINT AS row, first::BIGINT AS col, n::BIGINT AS colspan, (first * 10)::DOUBLE AS x_min, ((first + n) * 10)::DOUBLE AS x_max FROM " + _spans("x", "y"))
def merge_cols(spark, sf):
    c = full_grid(spark, sf)
    return grid.merge_spans(c.drop("border"), c, P, "col").select("page", *big("row", "col", "colspan"), F.col("bbox.x_min").alias("x_min"), F.col("bbox.x_max").alias("x_max"))


@query(PX + "SELECT page, first::BIGINT AS row, across::BIGINT AS col, n::BIGINT AS rowspan, (first * 10)::DOUBLE AS y_min, ((first + n) * 10)::DOUBLE AS y_max FROM " + _spans("y", "x"))
def merge_rows(spark, sf):
    c = full_grid(spark, sf)
    return grid.merge_spans(c.drop("border"), c, P, "row").select("page", *big("row", "col", "rowspan"), F.col("bbox.y_min").alias("y_min"), F.col("bbox.y_max").alias("y_max"))


@query(PX + "SELECT c.page, c.across::BIGINT AS row, c.first::BIGINT AS col, r.n::BIGINT AS rowspan, c.n::BIGINT AS colspan FROM " + _spans("x", "y") + " c JOIN " + _spans("y", "x") + " r ON r.page = c.page AND r.first = c.across AND r.across = c.first")
def merge_all_join(spark, sf):
    c = full_grid(spark, sf)
    return grid.cells_by_mode(c.drop("border"), c, c, P, "all").select("page", *big("row", "col", "rowspan", "colspan"))


# Kernels on page images.


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters as image structs, threshold applied by the kernel."""
    v = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor((x.cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(v, "")).alias("data"))
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), image.alias("image"))


def _component_rows(a) -> list[dict]:
    from gridleaf.operators import kernels as k

    labels, n = k.components(k.binarize(a))
    return [dict(zip(("x", "y", "w", "h", "pixels"), row, strict=True)) for row in k.boxes_of(labels, n).tolist()]


@query(OTSU.replace("WITH e", "WITH RECURSIVE e", 1) + """, ik AS (SELECT page, y * 8 + x AS p, y, x FROM bin WHERE v > 0),
cc AS (SELECT page, p, p AS label FROM ik UNION SELECT n.page, n.p, cc.label FROM cc JOIN ik o ON o.page = cc.page AND o.p = cc.p JOIN ik n ON n.page = o.page AND abs(n.x - o.x) <= 1 AND abs(n.y - o.y) <= 1),
lb AS (SELECT page, p, min(label) AS label FROM cc GROUP BY page, p)
SELECT page, min(p % 8)::BIGINT AS x, min(p // 8)::BIGINT AS y, (max(p % 8) - min(p % 8) + 1)::BIGINT AS w, (max(p // 8) - min(p // 8) + 1)::BIGINT AS h, count(*)::BIGINT AS pixels FROM lb GROUP BY page, label""")
def components(spark, sf):
    return detect.map_pages(page_images(spark, sf), P, _component_rows, "x long, y long, w long, h long, pixels long")


def _region_rows(a) -> list[dict]:
    from gridleaf.config import Settings
    from gridleaf.operators import kernels as k

    return [dict(zip(("x", "y", "w", "h"), r, strict=True)) for r in detect.raw_regions(k.binarize(a), Settings())]


#: Components that reach the background outside: the outer ones.
OUTER = OTSU.replace("WITH e", "WITH RECURSIVE e", 1) + """, ik AS (SELECT page, y * 8 + x AS p, y, x FROM bin WHERE v > 0),
cc AS (SELECT page, p, p AS label FROM ik UNION SELECT n.page, n.p, cc.label FROM cc JOIN ik o ON o.page = cc.page AND o.p = cc.p JOIN ik n ON n.page = o.page AND abs(n.x - o.x) <= 1 AND abs(n.y - o.y) <= 1),
lb AS (SELECT page, p, p // 8 AS y, p % 8 AS x, min(label) AS label FROM cc GROUP BY page, p),
di AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx)),
ou AS (SELECT DISTINCT page, -1 AS y, -1 AS x FROM px UNION SELECT o.page, o.y + dy, o.x + dx FROM ou o JOIN di ON o.y + dy BETWEEN -1 AND 8 AND o.x + dx BETWEEN -1 AND 8
 LEFT JOIN ik ON ik.page = o.page AND ik.y = o.y + dy AND ik.x = o.x + dx WHERE ik.page IS NULL),
ex AS (SELECT DISTINCT lb.page, lb.label FROM lb JOIN ou ON ou.page = lb.page AND abs(ou.y - lb.y) + abs(ou.x - lb.x) = 1)
"""


@query(OUTER + """, bx AS (SELECT page, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM lb JOIN ex USING (page, label) GROUP BY ALL)
SELECT page, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h FROM bx WHERE w >= 0.5 * 8 AND h >= 0.05 * w""")
def raw_regions(spark, sf):
    return detect.map_pages(page_images(spark, sf), P, _region_rows, "x long, y long, w long, h long")


#: Area inside each outer contour: a square of four pixels within it counts 1, one of three 1/2.
AREAS = OUTER + """, fo AS (SELECT page, label, -1 AS y, -1 AS x FROM ex UNION SELECT f.page, f.label, f.y + dy, f.x + dx FROM fo f JOIN di ON f.y + dy BETWEEN -1 AND 8 AND f.x + dx BETWEEN -1 AND 8
 LEFT JOIN lb k ON k.page = f.page AND k.label = f.label AND k.y = f.y + dy AND k.x = f.x + dx WHERE k.page IS NULL),
fl AS (SELECT c.page, c.label, c.y, c.x FROM (SELECT page, label, y.n AS y, x.n AS x FROM ex, range(8) y(n), range(8) x(n)) c ANTI JOIN fo USING (page, label, y, x)),
sq AS (SELECT page, label, y - dy AS y, x - dx AS x, count(*) AS n FROM fl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx) GROUP BY ALL),
ar AS (SELECT page, label, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS area FROM sq GROUP BY ALL),
no AS (SELECT page, count(*) FILTER (area < 10) / count(*)::DOUBLE AS noise_ratio, coalesce(sum(area) FILTER (area >= 10), 0) / 64 AS text_density FROM ar GROUP BY page),
nq AS (SELECT page, coalesce(noise_ratio, 0) AS noise_ratio, coalesce(text_density, 0) AS text_density FROM (SELECT DISTINCT page FROM px) LEFT JOIN no USING (page))
"""


@query(AREAS + """, ln AS (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER d AS u, lead(v) OVER d AS w FROM px WINDOW h AS (PARTITION BY page, y ORDER BY x), d AS (PARTITION BY page, x ORDER BY y)),
lp AS (SELECT page, round(var_pop(coalesce(l, r) + coalesce(r, l) + coalesce(u, w) + coalesce(w, u) - 4 * v) * 4096)::BIGINT AS s FROM ln GROUP BY page),
ct AS (SELECT page, round(CASE WHEN avg(v) = 0 THEN 0 ELSE least(1, stddev_pop(v) / avg(v)) END, 6)::DOUBLE AS contrast_level FROM px GROUP BY page)
SELECT page, noise_ratio > 0.25 AS has_noise, s < 500 * 4096 AS has_blur, false AS has_colored_bg, contrast_level, round(text_density, 6) AS text_density, round(noise_ratio, 6) AS noise_ratio, s AS sharpness FROM nq JOIN lp USING (page) JOIN ct USING (page)""")
def page_quality(spark, sf):
    """All quality measures of every raster but its skew."""
    m = detect.page_metrics(page_images(spark, sf), P)
    rounded = [F.round(c, 6).alias(c) for c in ("contrast_level", "text_density", "noise_ratio")]
    return m.select("page", "has_noise", "has_blur", "has_colored_bg", *rounded, F.round(F.col("sharpness") * 4096).cast("bigint").alias("sharpness"))


@query(SKEW)
def page_skew(spark, sf):
    """The skew of every raster by the kernel's vote."""
    return detect.page_metrics(page_images(spark, sf), P).select("page", "skew_angle", "has_skew")


@query(AREAS + "SELECT page, round(noise_ratio, 6) AS noise_ratio, noise_ratio > 0.25 AS has_noise FROM nq")
def noise_ratio(spark, sf):
    return detect.page_metrics(page_images(spark, sf), P).select("page", F.round("noise_ratio", 6).alias("noise_ratio"), "has_noise")


def _clean_rows(a) -> list[dict]:
    from gridleaf.operators import kernels as k

    mask = k.binarize(a)
    h, v = detect.detect_lines(mask, 3, "horizontal"), detect.detect_lines(mask, 3, "vertical")
    return [{"pixels": int((detect.clean_lines(h, h & v, 9, 1, "horizontal") > 0).sum())}]


@query(OTSU.replace("WITH e", "WITH RECURSIVE e", 1) + ", hl AS " + _morph(_morph(_morph("bin", "min", "x", 2), "max", "x", 2), "max", "x", 2) + ", vl AS " + _morph(_morph(_morph("bin", "min", "y", 2), "max", "y", 2), "max", "y", 2) + """,
ik AS (SELECT page, y * 8 + x AS p, y, x FROM hl WHERE v > 0),
cc AS (SELECT page, p, p AS label FROM ik UNION SELECT n.page, n.p, cc.label FROM cc JOIN ik o ON o.page = cc.page AND o.p = cc.p JOIN ik n ON n.page = o.page AND abs(n.x - o.x) <= 1 AND abs(n.y - o.y) <= 1),
lb AS (SELECT page, p, min(label) AS label FROM cc GROUP BY page, p),
st AS (SELECT page, label, count(*) AS n, min(p % 8) AS x0, max(p % 8) - min(p % 8) + 1 AS w FROM lb GROUP BY ALL),
cr AS (SELECT lb.page, lb.label, bool_or(lb.p % 8 < x0 + w // 3) OR bool_or(lb.p % 8 > x0 + 2 * w // 3) AS crossed FROM lb JOIN st USING (page, label) JOIN vl ON vl.page = lb.page AND vl.y = lb.p // 8 AND vl.x = lb.p % 8 AND vl.v > 0 GROUP BY ALL),
ok AS (SELECT page, sum(n) AS n FROM st JOIN cr USING (page, label) WHERE n >= 9 AND crossed GROUP BY page)
SELECT page, coalesce(n, 0)::BIGINT AS pixels FROM (SELECT DISTINCT page FROM px) LEFT JOIN ok USING (page)""")
def clean_lines(spark, sf):
    return detect.map_pages(page_images(spark, sf), P, _clean_rows, "pixels long")


def _ruled_page(seed: int):
    """A page of 300 by 300 with one ruled table whose grid follows from a number."""
    import numpy as np

    rows, cols = 2 + seed % 3, 2 + seed % 4
    page = np.full((300, 300), 240, dtype=np.uint8)
    for r in range(rows + 1):
        page[20 + 60 * r : 22 + 60 * r, 30 : 32 + 50 * cols] = 10
    for c in range(cols + 1):
        page[20 : 22 + 60 * rows, 30 + 50 * c : 32 + 50 * c] = 10
    return page


#: Drawn pages of a task, which bounds its time and what Arrow hands to a worker at once (45 MB of them).
PAGES_A_TASK = 500


def ruled_pages(spark: SparkSession, sf: str, page_of: Callable = _ruled_page) -> DataFrame:
    """A drawn page for every supplier."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = struct(f"page long, image {IMAGE}")
    arrow = to_arrow_schema(out)

    def draw(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, detect.PAGES_AT_ONCE):
                keys = batch.column(0).slice(at, detect.PAGES_AT_ONCE).to_pylist()
                yield pa.RecordBatch.from_pylist([{"page": i, "image": detect.image_dict(page_of(i))} for i in keys], schema=arrow)

    # Few keys make many pixels: spread them over all cores before drawing, and over more tasks the more they are.
    keys = read(spark, sf, "supplier").select("s_suppkey")
    parts = max(spark.sparkContext.defaultParallelism, -(-keys.count() // PAGES_A_TASK))
    return keys.repartition(parts).mapInArrow(draw, out)


@query("SELECT s_suppkey AS page, 1::BIGINT AS n, (2 + s_suppkey % 3)::BIGINT AS num_rows, (2 + s_suppkey % 4)::BIGINT AS num_cols, ((2 + s_suppkey % 3) * (2 + s_suppkey % 4))::BIGINT AS num_cells FROM supplier WHERE 50 * (2 + s_suppkey % 4) + 4 >= 150")
def detect_tables(spark, sf):
    """Tables of drawn pages; those narrower than half the page are none."""
    found = detect.page_tables(ruled_pages(spark, sf), P)
    return found.groupBy("page").agg(F.count("*").alias("n"), F.sum(F.col("table.num_rows").cast("bigint")).alias("num_rows"), F.sum(F.col("table.num_cols").cast("bigint")).alias("num_cols"), F.sum(F.size("table.cells").cast("bigint")).alias("num_cells"))


@query("SELECT s_suppkey AS page, 28.0::DOUBLE AS x_min, 18.0::DOUBLE AS y_min, (33 + 50 * (2 + s_suppkey % 4))::DOUBLE AS x_max, (23 + 60 * (2 + s_suppkey % 3))::DOUBLE AS y_max FROM supplier WHERE 50 * (2 + s_suppkey % 4) + 4 >= 150")
def table_boxes(spark, sf):
    """Boxes of the tables of drawn pages: lines of two pixels, grown by two at their ends, up to the last pixel."""
    return detect.page_tables(ruled_pages(spark, sf), P).select("page", *sides("table.bbox"))


def _text_page(seed: int):
    """A page with two solid blocks; the first is as wide as a number says."""
    import numpy as np

    page = np.full((300, 300), 240, dtype=np.uint8)
    page[40:60, 30 : 60 + 40 * (seed % 5)] = 10
    page[200 : 230 + seed % 7, 100:250] = 10
    return page


@query("SELECT s_suppkey AS page, 30.0::DOUBLE AS x_min, 40.0::DOUBLE AS y_min, (60 + 40 * (s_suppkey % 5))::DOUBLE AS x_max, 60.0::DOUBLE AS y_max FROM supplier UNION ALL SELECT s_suppkey, 100, 200, 250, 230 + s_suppkey % 7 FROM supplier")
def paragraph_boxes(spark, sf):
    """Boxes of the text blocks of drawn pages, up to one past the last pixel."""
    return detect.page_paragraphs(ruled_pages(spark, sf, _text_page), P).select("page", *sides("bbox"))


def _fixed_words():
    return ocr.FixedEngine({(300, 300): [ocr.Word("in", 0.9, (40, 30, 60, 40)), ocr.Word("low", 0.5, (40, 60, 60, 70)), ocr.Word("out", 0.95, (5, 285, 25, 295))]})


@query("SELECT s_suppkey AS page, CASE WHEN 50 * (2 + s_suppkey % 4) + 4 >= 150 THEN 1 ELSE 0 END::BIGINT AS tables, CASE WHEN 50 * (2 + s_suppkey % 4) + 4 >= 150 THEN 'in' || chr(10) ELSE '' END AS first_cell, CASE WHEN 50 * (2 + s_suppkey % 4) + 4 >= 150 THEN 'out:1' ELSE 'in:0,out:1' END AS paragraphs FROM supplier")
def analyze_page(spark, sf):
    """Drawn pages through detection, recognition, the word join and the leftover paragraphs."""
    from gridleaf.plans.pages import analyze

    pages = ruled_pages(spark, sf)
    found = analyze(pages, ocr.recognise(pages, P, _fixed_words), P)
    first = F.coalesce(F.array_join(F.transform(F.filter(F.flatten("tables.cells"), lambda c: (c["row"] == 0) & (c["col"] == 0)), lambda c: c["value"]), ""), F.lit(""))
    texts = F.array_join(F.transform("paragraphs", lambda p: F.concat(p["text"], F.lit(":"), p["type"].cast("string"))), ",")
    return found.select("page", F.size("tables").cast("bigint").alias("tables"), first.alias("first_cell"), texts.alias("paragraphs"))


# Acts and the process store.


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", acts.CREDIT).otherwise(acts.DEBIT)
    row_id = F.struct(F.col("l_linestatus").alias("id_table"), F.col("l_linenumber").cast("string").alias("id_row"))
    return li.select(F.col("l_suppkey").alias("process_id"), side.alias("side"), row_id.alias("row_id"), F.col("l_linestatus").alias("record"), F.col("l_extendedprice").alias("value"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("date"))


ACTS = "WITH a AS (SELECT l_suppkey AS process_id, sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::DECIMAL(18,2) END) AS d, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) END) AS c, count(*) AS n FROM lineitem GROUP BY ALL)\n"


@query(ACTS + "SELECT process_id, coalesce(d, 0)::DOUBLE AS total_debit, coalesce(c, 0)::DOUBLE AS total_credit, n::BIGINT AS n_entries FROM a")
def act_totals(spark, sf):
    return acts.totals(ledger(spark, sf), ["process_id"]).select("process_id", "total_debit", "total_credit", "n_entries")


@query(ACTS + "SELECT process_id, (coalesce(d, 0) - coalesce(c, 0))::DOUBLE AS balance FROM a")
def act_balance(spark, sf):
    return acts.totals(ledger(spark, sf), ["process_id"]).select("process_id", "balance")


@query("SELECT doc_id, coalesce(doc_id, 0) % 3 = 0 AS valid FROM documents")
def validate_pdf(spark, sf):
    kind = F.coalesce("doc_id", F.lit(0)) % 3
    text = F.concat(F.when(kind == 0, "%PDF-1.7 ").when(kind == 1, "PDF").otherwise(""), F.coalesce("text", F.lit("")))
    sent = F.when(kind == 2, F.concat(F.lit("%%%"), F.col("doc_id").cast("string"))).otherwise(documents.encode_base64(text.cast("binary")))
    return read(spark, sf, "documents").select("doc_id", documents.valid_pdf(sent).alias("valid"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def base64_round_trip(spark, sf):
    back = documents.decode_base64(documents.encode_base64(F.coalesce("text", F.lit("")).cast("binary")))
    return read(spark, sf, "documents").select("doc_id", F.md5(back).alias("md5"))


def process_events(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and such create or replace a user's process, errors delete it; 24 hours to live."""
    ev = read(spark, sf, "events")
    return ev.select(F.col("user_id").cast("string").alias("process_id"), F.col("props").alias("structure"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("version"))


LATEST = "WITH l AS (SELECT user_id, props, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), n AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events)\n"


def _now(spark: SparkSession, sf: str) -> Column:
    return read(spark, sf, "events").agg(F.max("ts")).scalar() - F.expr("interval 1 hour")


@query(LATEST + "SELECT user_id::VARCHAR AS process_id, props AS structure FROM l, n WHERE k = 1 AND event_type <> 'error' AND ts + INTERVAL 24 HOUR > now")
def process_lookup(spark, sf):
    return store.live(process_events(spark, sf), _now(spark, sf)).select("process_id", "structure")


@query(LATEST + "SELECT count(*)::BIGINT AS gone FROM l, n WHERE k = 1 AND NOT (event_type <> 'error' AND ts + INTERVAL 24 HOUR > now)")
def process_expire(spark, sf):
    events = process_events(spark, sf)
    kept = store.live(events, _now(spark, sf)).select("process_id")
    return events.select("process_id").distinct().join(kept, "process_id", "left_anti").agg(F.count("*").alias("gone"))


@query("""WITH e AS (SELECT l_suppkey AS id, l_returnflag = 'R' AS cr, l_extendedprice FROM lineitem), s AS (SELECT id, sum(CASE WHEN cr THEN 0 ELSE 1 END) AS d, sum(CASE WHEN cr THEN 1 ELSE 0 END) AS c FROM e GROUP BY id)
SELECT k.id AS process_id, CASE WHEN s_suppkey IS NULL THEN 404 ELSE 200 END::BIGINT AS status, s_name AS seller, CASE WHEN s_suppkey IS NULL THEN 0 ELSE coalesce(d, 0) END::BIGINT AS debit, CASE WHEN s_suppkey IS NULL THEN 0 ELSE coalesce(c, 0) END::BIGINT AS credit
FROM (SELECT s_suppkey * 2 AS id FROM supplier) k LEFT JOIN supplier ON s_suppkey = k.id LEFT JOIN s ON s.id = k.id""")
def act_status(spark, sf):
    sup = read(spark, sf, "supplier")
    known = sup.select(F.col("s_suppkey").alias("process_id"), F.col("s_name").alias("seller"), F.lit("buyer").alias("buyer"), F.create_map(F.lit("start"), F.lit("01.01.2024")).alias("period"))
    found = acts.status(sup.select((F.col("s_suppkey") * 2).alias("process_id")), known, ledger(spark, sf))
    return found.select("process_id", *big("status"), "seller", F.size("debit").cast("bigint").alias("debit"), F.size("credit").cast("bigint").alias("credit"))


@query("SELECT p_partkey AS ord, p_brand AS table_id, CASE p_partkey % 3 WHEN 0 THEN 'debit' ELSE 'credit' END AS side, (p_retailprice::DECIMAL(18,2))::DOUBLE AS value FROM part WHERE p_partkey % 4 <> 0")
def act_ledger_from_cells(spark, sf):
    """Table rows of text (name, debit, credit) back to ledger entries."""
    k = F.col("p_partkey")
    money = F.when(k % 4 != 0, F.regexp_replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), r"\.", ",")).otherwise("heading")
    texts = F.posexplode(F.array(F.col("p_name"), F.when(k % 3 == 0, money), F.when(k % 3 != 0, money)))
    cells = read(spark, sf, "part").select(k.alias("ord"), F.col("p_brand").alias("table_id"), k.cast("int").alias("row"), texts.alias("col", "value"))
    return acts.ledger_from_cells(cells, ["ord"]).select("ord", F.col("row_id.id_table").alias("table_id"), "side", "value")


@query("SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 5 * 40)::DOUBLE END AS x_min FROM part WHERE p_retailprice >= 0")
def act_fill(spark, sf):
    """Each requested entry to the free space of its cell; every second one names no cell."""
    parts = part_cells(spark, sf).withColumn("process_id", F.lit(1)).withColumn("side", F.lit(acts.DEBIT))
    cells = parts.select("process_id", "side", "table_id", F.col("ord").cast("int").alias("row"), "bbox", F.array().cast("array<struct<x_min: double, y_min: double, x_max: double, y_max: double>>").alias("blobs"))
    k = F.col("p_partkey")
    row_id = F.struct(F.col("p_brand").alias("id_table"), F.when(k % 2 == 0, k.cast("string")).otherwise("none").alias("id_row"))
    asked = read(spark, sf, "part").select(k.alias("ord"), F.lit(1).alias("process_id"), F.lit(acts.DEBIT).alias("side"), row_id.alias("row_id"), F.col("p_name").alias("record"), F.col("p_retailprice").alias("value"), F.lit(None).cast("string").alias("date"))
    return acts.fill(asked, cells).select("ord", F.col("target.x_min").alias("x_min"))


def submitted(spark: SparkSession, sf: str) -> tuple[store.ProcessStore, DataFrame]:
    """A new store with every second document in it, and what submitting gave for each."""
    from gridleaf.plans.store import ProcessStore, kept, shared_folder

    raw = F.concat(F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, "%PDF").otherwise("GIF8"), F.coalesce("text", F.lit("")))
    asked = read(spark, sf, "documents").select("doc_id", documents.encode_base64(raw.cast("binary")).alias("document"))
    held = ProcessStore(spark, shared_folder(spark, "processes"))
    parse = lambda d: d.withColumn("structure", F.to_json(F.struct(F.concat(F.lit("seller "), F.col("doc_id")).alias("seller"), F.lit("buyer").alias("buyer"))))
    return held, kept(acts.submit_all(asked, held, parse), "submitted")


@query("SELECT doc_id, there AS accepted, CASE WHEN there THEN 36 END::BIGINT AS id_length, CASE WHEN there THEN md5('%PDF' || coalesce(text, '')) END AS pdf_md5 FROM (SELECT *, coalesce(doc_id, 0) % 2 = 0 AS there FROM documents)")
def process_create(spark, sf):
    """Documents submitted under new ids and read back from the store."""
    held, given = submitted(spark, sf)
    back = given.join(held.get(given.select("process_id").where("process_id is not null")), "process_id", "left")
    return back.select("doc_id", "accepted", F.length("process_id").cast("bigint").alias("id_length"), F.md5("pdf").alias("pdf_md5"))


@query("SELECT doc_id, coalesce(doc_id, 0) % 4 <> 0 AS found FROM documents WHERE coalesce(doc_id, 0) % 2 = 0")
def process_delete(spark, sf):
    """Every second process deleted, twice; the others are still found."""
    held, given = submitted(spark, sf)
    ids = given.where("process_id is not null")
    for _ in range(2):
        held.delete(ids.where("coalesce(doc_id, 0) % 4 = 0"))
    return ids.join(held.get(ids.select("process_id")), "process_id").select("doc_id", F.col("pdf").isNotNull().alias("found"))


@query("""WITH d AS (SELECT doc_id, text FROM documents), k AS (SELECT doc_id, coalesce(doc_id, 0) % 2 = 0 AS there, text FROM d)
SELECT doc_id, CASE WHEN there THEN 200 ELSE 404 END::BIGINT AS status, CASE WHEN there THEN 'seller ' || doc_id END AS seller, CASE WHEN there THEN octet_length(encode('%PDF' || coalesce(text, '')))::BIGINT END AS size FROM k""")
def act_flow(spark, sf):
    """Submit, ask for the status, and take the document back; documents that were not accepted ask for an unknown process."""
    held, given = submitted(spark, sf)
    asked = given.select("doc_id", F.coalesce("process_id", F.concat(F.lit("none "), F.col("doc_id"))).alias("process_id"))
    got = held.get(asked.select("process_id"))
    parsed = F.from_json("structure", "seller string, buyer string")
    known = got.where("structure is not null").select("process_id", parsed.alias("s")).select("process_id", "s.seller", "s.buyer", F.create_map(F.lit("start"), F.lit("")).alias("period"))
    answers = acts.status(asked, known, ledger(spark, sf).withColumn("process_id", F.col("process_id").cast("string")))
    sent = acts.answer(got).select("process_id", documents.decode_base64(F.col("document")).alias("back"))
    return asked.join(answers, "process_id").join(sent, "process_id").select("doc_id", *big("status"), "seller", F.octet_length("back").cast("bigint").alias("size"))
