"""From line masks to table cells: profiles, line centres, grids, borders, merged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridleaf.functions import geometry as g

Keys = list[str]


def profile(px: DataFrame, keys: Keys, axis: str) -> DataFrame:
    """keys, at, share: the fraction of ink in each column (axis x) or row (axis y)."""
    return px.groupBy(*keys, F.col(axis).alias("at")).agg(F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("share"))


def peaks(found: DataFrame, keys: Keys, floor: float = 0.003, part: float = 0.25) -> DataFrame:
    """The positions whose share reaches ``part`` of the page's greatest, ``floor`` at least."""
    top = F.max("share").over(Window.partitionBy(*keys))
    return found.withColumn("t", F.greatest(F.lit(floor), part * top)).where(F.col("share") >= F.col("t")).select(*keys, "at")


def run_centers(positions: DataFrame, keys: Keys) -> DataFrame:
    """keys, center: the middle, rounded down, of each run of consecutive positions."""
    island = positions.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
    return island.groupBy(*keys, "g").agg(F.expr("cast((min(at) + max(at)) div 2 as int)").alias("center")).select(*keys, "center")


def keep_apart(coords: Column, least: int) -> Column:
    """Of ascending coordinates those at least ``least`` from the last one kept; the first is kept."""
    keeps = lambda kept, c: (F.size(kept) == 0) | (c - F.element_at(kept, -1) >= least)
    # The sentinel keeps element_at in range on the first step; it is cut off at the end.
    start = F.array(F.lit(-(10**9)))
    folded = F.aggregate(coords, start, lambda kept, c: F.when(keeps(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    return F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0)))


def grid_coords(px: DataFrame, keys: Keys, axis: str, min_cell: int = 10) -> DataFrame:
    """keys, coords: line coordinates along an axis, both edges added, close ones thinned out."""
    every, found = Window.partitionBy(*keys), profile(px, keys, axis)
    high = F.col("share") >= F.greatest(F.lit(0.003), 0.25 * F.max("share").over(every))
    marked = found.select(*keys, "at", F.max("at").over(every).cast("int").alias("last"), high.alias("high"))
    # As peaks and run_centers do, but pages without a peak keep their edges and the profile is made once.
    island = marked.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy(*keys, "high").orderBy("at")))
    centers = island.groupBy(*keys, "last", "high", "g").agg(F.expr("cast((min(at) + max(at)) div 2 as int)").alias("center"))
    joined = centers.groupBy(*keys, "last").agg(F.collect_set(F.when(F.col("high"), F.col("center"))).alias("c"))
    ordered = F.array_sort(F.array_distinct(F.concat("c", F.array(F.lit(0), F.col("last")))))
    return joined.select(*keys, keep_apart(ordered, max(2, min_cell)).alias("coords"))


def grid_lines(px: DataFrame, keys: Keys, min_cell: int = 10) -> DataFrame:
    """keys, xs, ys: ``grid_coords`` along both axes, from one pass over the pixels; pages without a key are left out."""
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), F.col(n).alias("at")) for n in "xy"))).alias("s")
    coords = grid_coords(px.dropna(subset=keys).select(*keys, "v", sides).select(*keys, "v", "s.axis", "s.at"), [*keys, "axis"], "at", min_cell)
    return coords.groupBy(*keys).agg(*(F.first(F.when(F.col("axis") == n, F.col("coords")), ignorenulls=True).alias(f"{n}s") for n in "xy"))


def segments(coords: DataFrame, keys: Keys, name: str) -> DataFrame:
    """keys, name, lo, hi: neighbouring coordinates as numbered segments."""
    at = F.posexplode(F.arrays_zip(F.slice("coords", 1, F.greatest(F.size("coords") - 1, F.lit(0))).alias("lo"), F.slice("coords", 2, F.greatest(F.size("coords") - 1, F.lit(0))).alias("hi")))
    return coords.where(F.size("coords") > 1).select(*keys, at.alias(name, "s")).select(*keys, name, F.col("s.lo").alias(f"{name}_lo"), F.col("s.hi").alias(f"{name}_hi"))


def base_cells(xs: DataFrame, ys: DataFrame, keys: Keys, origin_x: Column | None = None, origin_y: Column | None = None) -> DataFrame:
    """One cell for every row and column segment of a page: a product within each page of a few lines each."""
    cells = segments(ys, keys, "row").join(segments(xs, keys, "col"), keys)
    ox, oy = (F.lit(0) if o is None else o for o in (origin_x, origin_y))
    box = g.bbox(F.col("col_lo") + ox, F.col("row_lo") + oy, F.col("col_hi") + ox, F.col("row_hi") + oy)
    return cells.select(*keys, "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), box.alias("bbox"))


def borders_of(px: DataFrame, lines: DataFrame, keys: Keys, vertical: bool, tolerance: int = 10, coverage: float = 0.8) -> DataFrame:
    """keys, row, col, border: whether a line separates a cell from the next column (or row, if not ``vertical``).

    ``px`` is the mask of lines of that direction, ``lines`` has the grid of each page (``grid_lines``).  A border is there if at least ``coverage``
    of the scan lines across the cell have ink within ``tolerance`` of the grid line.
    """
    along, across = ("x", "y") if vertical else ("y", "x")
    ink = px.where("v > 0").groupBy(*keys).agg(F.collect_list(F.struct(F.col(along).alias("at"), F.col(across).alias("other"))).alias("__ink"))
    # One row a page: its grid lines and its ink.  The hints: a plan would broadcast what it takes for small.
    pages = lines.where((F.size("xs") > 1) & (F.size("ys") > 1)).join(ink.hint("merge"), keys, "left")
    ahead, aside = F.col(f"{along}s"), F.col(f"{across}s")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ends, sides = upto(F.size(ahead) - 2), upto(F.size(aside) - 1)
    part = lambda i, k, size, other: F.struct(i.alias("i"), k.alias("k"), size.cast("int").alias("size"), other.cast("int").alias("other"))
    # Every cell but the last, and every ink pixel once for each of the few grid lines within reach.
    cells = F.flatten(F.transform(sides, lambda i: F.transform(ends, lambda k: part(i, k, F.get(aside, i + 1) - F.get(aside, i), F.lit(None)))))
    near = lambda p: F.filter(ends, lambda k: F.abs(p["at"] - F.get(ahead, k + 1)) <= tolerance)
    hits = F.flatten(F.transform(F.coalesce("__ink", F.array().cast("array<struct<at: int, other: int>>")), lambda p: F.transform(near(p), lambda k: part(F.size(F.filter(aside, lambda c: c <= p["other"])) - 1, k, F.lit(None), p["other"]))))
    found = pages.select(*keys, F.explode(F.concat(cells, hits)).alias("e")).select(*keys, "e.*")
    counted = found.groupBy(*keys, "i", "k", "other").agg(F.max("size").alias("size")).groupBy(*keys, "i", "k").agg(F.count("other").alias("n"), F.max("size").alias("size"))
    row, col = ("i", "k") if vertical else ("k", "i")
    return counted.where("size is not null").select(*keys, F.col(row).alias("row"), F.col(col).alias("col"), (F.col("n") / F.col("size") >= coverage).alias("border"))


def borders(px: DataFrame, xs: DataFrame, ys: DataFrame, keys: Keys, vertical: bool, tolerance: int = 10, coverage: float = 0.8) -> DataFrame:
    """``borders_of`` with the coordinates of each axis apart (``grid_coords``)."""
    lines = xs.select(*keys, F.col("coords").alias("xs")).join(ys.select(*keys, F.col("coords").alias("ys")).hint("merge"), keys)
    return borders_of(px, lines, keys, vertical, tolerance, coverage)


def merge_spans(cells: DataFrame, border: DataFrame, keys: Keys, along: str = "col") -> DataFrame:
    """Cells without a border between them become one, along columns (within a row) or rows (within a column)."""
    across = "row" if along == "col" else "col"
    joined = cells.join(border.select(*keys, "row", "col", "border"), [*keys, "row", "col"], "left")
    line = Window.partitionBy(*keys, across).orderBy(along)
    # A cell starts a span if it is the first or the one before has a border.
    start = F.coalesce(F.lag("border").over(line), F.lit(True)).cast("int")
    spans = joined.withColumn("__start", start).withColumn("__span", F.sum("__start").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    sides = [f(f"bbox.{s}") for s, f in (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max))]
    merged = spans.groupBy(*keys, across, "__span").agg(F.min(along).cast("int").alias(along), F.count("*").cast("int").alias("n"), g.bbox(*sides).alias("bbox"))
    one, n = F.lit(1), F.col("n")
    return merged.select(*keys, "row", "col", (n if along == "row" else one).alias("rowspan"), (n if along == "col" else one).alias("colspan"), "bbox")


def merge_all(by_cols: DataFrame, by_rows: DataFrame, keys: Keys) -> DataFrame:
    """Cells that start a span in both directions: width from the one, height from the other."""
    c, r = by_cols.select(*keys, "row", "col", "colspan", F.col("bbox").alias("cb")), by_rows.select(*keys, "row", "col", "rowspan", F.col("bbox").alias("rb"))
    joined = c.join(r, [*keys, "row", "col"])
    box = g.bbox(F.col("cb.x_min"), F.col("rb.y_min"), F.col("cb.x_max"), F.col("rb.y_max"))
    return joined.select(*keys, "row", "col", "rowspan", "colspan", box.alias("bbox"))


def cells_by_mode(cells: DataFrame, vertical: DataFrame, horizontal: DataFrame, keys: Keys, mode: str | None = "cols") -> DataFrame:
    """None: the grid's cells; cols, rows: merged along these; anything else: along both."""
    if mode is None:
        return cells
    if mode == "cols":
        return merge_spans(cells, vertical, keys, "col")
    if mode == "rows":
        return merge_spans(cells, horizontal, keys, "row")
    return merge_all(merge_spans(cells, vertical, keys, "col"), merge_spans(cells, horizontal, keys, "row"), keys)
