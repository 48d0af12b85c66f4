"""Detection on whole page images: line masks, tables with cells, paragraphs, quality.

The functions on arrays hold no state: a mask is handed on, not kept.  ``map_pages``
runs one of them over a DataFrame of page images, a few pages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridleaf.config import QualitySettings, Settings
from gridleaf.operators import kernels as k
from gridleaf.schema import BBOX, CELL, METRICS, TABLE, struct

Box = tuple[float, float, float, float]


def box_dict(box: Box) -> dict:
    return dict(zip(("x_min", "y_min", "x_max", "y_max"), map(float, box), strict=True))


def crop(image: np.ndarray, box: Box) -> np.ndarray:
    """What a box covers of an image, cut to whole pixels and to the image (a view)."""
    h, w = image.shape[:2]
    x0, y0, x1, y1 = (int(v) for v in box)
    x0, x1 = min(max(x0, 0), w), min(max(x1, 0), w)
    y0, y1 = min(max(y0, 0), h), min(max(y1, 0), h)
    return image[y0 : max(y0, y1), x0 : max(x0, x1)]


def detect_lines(binary: np.ndarray, size: int, orientation: str) -> np.ndarray:
    axis = {"horizontal": 1, "vertical": 0}.get(orientation)
    if axis is None:
        raise ValueError(f"orientation {orientation!r}: horizontal or vertical")
    return k.dilate_line(k.open_line(binary, axis, max(1, size), 2), axis, 3, 2)


def clean_lines(mask: np.ndarray, crossings: np.ndarray, min_length: int, min_crossings: int, orientation: str) -> np.ndarray:
    """Components of at least ``min_length`` pixels that cross other lines in enough of their outer thirds."""
    labels, n = k.components(mask)
    stats = k.boxes_of(labels, n)
    axis = 1 if orientation == "horizontal" else 0
    start, size = (stats[:, 0], stats[:, 2]) if axis else (stats[:, 1], stats[:, 3])
    at = np.nonzero((labels > 0) & (crossings > 0))
    name, place = labels[at] - 1, at[axis]
    low, high = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    low[name[place < (start + size // 3)[name]]] = True
    high[name[place > (start + 2 * size // 3)[name]]] = True
    keep = (stats[:, 4] >= min_length) & (low.astype(int) + high >= min_crossings)
    return np.where(np.r_[False, keep][labels], 255, 0).astype(np.uint8)


def raw_regions(mask: np.ndarray, settings: Settings) -> list[tuple[int, int, int, int]]:
    """x, y, width, height around outer contours that are wide and high enough for a table."""
    cfg, out = settings.table_preprocessor, []
    for contour in k.external_contours(mask):
        (x, y), (right, low) = contour.min(axis=0).tolist(), contour.max(axis=0).tolist()
        w, h = right - x + 1, low - y + 1
        if w >= cfg.min_table_width_ratio * mask.shape[1] and h >= cfg.min_table_height_ratio * w:
            out.append((x, y, w, h))
    return out


def table_mask(gray: np.ndarray, settings: Settings) -> np.ndarray:
    """The lines of tables.  The shortest horizontal line follows from the height, the shortest vertical one from the width."""
    cfg = settings.table_preprocessor
    binary = k.binarize(k.gaussian_blur(gray, cfg.gaussian_blur_kernel))
    least = max(1, int(gray.shape[0] * cfg.horizontal_length_ratio)), max(1, int(gray.shape[1] * cfg.vertical_length_ratio))
    h, v = detect_lines(binary, least[0], "horizontal"), detect_lines(binary, least[1], "vertical")
    both, either = h & v, h | v
    clean = np.zeros_like(h), np.zeros_like(v)
    for x, y, w, high in raw_regions(either, settings):
        at = np.s_[y : y + high, x : x + w]
        clean[0][at] = clean_lines(h[at], both[at], least[0], 1, "horizontal")
        clean[1][at] = clean_lines(v[at], both[at], least[1], 2, "vertical")
    return clean[0] | clean[1]


def order_points(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left; of equal candidates the first."""
    total, apart = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[int(total.argmin()), int(apart.argmin()), int(total.argmax()), int(apart.argmax())]]


def find_tables(mask: np.ndarray, settings: Settings) -> list[Box]:
    """Boxes of quadrangles that are large enough; their far sides are the last pixels."""
    cfg, out = settings.table_detector, []
    for contour in k.external_contours(mask):
        corners = k.simplify(contour, cfg.approx_poly_eps * k.perimeter(contour))
        if len(corners) == 4 and k.polygon_area(corners) >= cfg.min_table_area:
            four = order_points(corners)
            out.append((*map(float, four.min(axis=0)), *map(float, four.max(axis=0))))
    return out


def grid_coords(ink: np.ndarray, axis: int, min_cell: int) -> list[int]:
    """Line coordinates across an axis of a mask: profile peaks, both edges, close ones thinned out."""
    share = ink.mean(axis=axis)
    at = np.flatnonzero(share >= max(0.003, 0.25 * float(share.max())))
    pieces = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    found = {(int(p[0]) + int(p[-1])) // 2 for p in pieces} | {0, len(share) - 1}
    out: list[int] = []
    for c in sorted(found):
        if not out or c - out[-1] >= max(2, min_cell):
            out.append(c)
    return out


def _typical(coords: list[int], size: int) -> int:
    gaps = np.diff(coords)
    gaps = gaps[gaps > 0]
    return int(np.median(gaps)) if len(gaps) else max(10, size // 20)


def border_matrices(mask: np.ndarray, xs: list[int], ys: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line stands right of each cell (rows, cols - 1), and below it (rows - 1, cols)."""
    cfg, (h, w) = settings.cell_detector, mask.shape
    rows, cols = max(0, len(ys) - 1), max(0, len(xs) - 1)
    right, below = np.zeros((rows, max(0, cols - 1)), dtype=bool), np.zeros((max(0, rows - 1), cols), dtype=bool)
    if not rows or not cols:
        return right, below
    closed = k.close(mask, 3, 3)
    lines = [k.open_line(closed, axis, max(10, int(0.6 * _typical(c, n)))) for axis, c, n in ((1, xs, w), (0, ys, h))]
    reach = max(2, cfg.padding, cfg.threshold_line)
    for out, ink, along, across, size in ((right, lines[1], xs, ys, w), (below, lines[0].T, ys, xs, h)):
        for j, at in enumerate(along[1:-1]):
            hit = (ink[:, max(at - reach, 0) : min(at + reach + 1, size)] > 0).any(axis=1)
            for i, (a, b) in enumerate(zip(across, across[1:], strict=False)):
                if b > a and hit[a:b].mean() >= cfg.coverage_thr:
                    out[(i, j) if out is right else (j, i)] = True
    return right, below


def spans(line: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the pieces that borders (len - 1 of them) cut a line of cells into."""
    cuts = [0, *(np.flatnonzero(line) + 1).tolist(), len(line) + 1]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def extract_cells(mask: np.ndarray, box: Box, settings: Settings, mode: str | None) -> list[dict]:
    """Cells inside a table's part of the mask, placed on the page."""
    if not mask.size:
        return []
    ink = mask > 0
    xs, ys = grid_coords(ink, 0, settings.cell_detector.min_cell), grid_coords(ink, 1, settings.cell_detector.min_cell)
    ox, oy = int(box[0]), int(box[1])
    rows, cols = len(ys) - 1, len(xs) - 1

    def cell(row: int, col: int, rowspan: int, colspan: int) -> dict:
        sides = xs[col] + ox, ys[row] + oy, xs[col + colspan] + ox, ys[row + rowspan] + oy
        return {"row": row, "col": col, "rowspan": rowspan, "colspan": colspan, "value": None, "bbox": box_dict(sides), "blobs": []}

    if rows < 1 or cols < 1:
        return []
    if mode is None:
        return [cell(r, c, 1, 1) for r in range(rows) for c in range(cols)]
    right, below = border_matrices(mask, xs, ys, settings)
    wide = {(r, c): n for r in range(rows) for c, n in spans(right[r])}
    if mode == "cols":
        return [cell(r, c, 1, n) for (r, c), n in wide.items()]
    high = {(r, c): n for c in range(cols) for r, n in spans(below[:, c])}
    if mode == "rows":
        return [cell(r, c, n, 1) for (r, c), n in high.items()]
    return [cell(r, c, n, wide[r, c]) for (r, c), n in high.items() if (r, c) in wide]


def tables_in(mask: np.ndarray, settings: Settings) -> list[dict]:
    """Tables with at least two rows, columns and cells whose cells all lie inside; ids count all candidates."""
    out = []
    for i, box in enumerate(find_tables(mask, settings)):
        cells = extract_cells(crop(mask, box), box, settings, settings.table_detector.mode_merge_cells)
        rows, cols = max((c["row"] + c["rowspan"] for c in cells), default=0), max((c["col"] + c["colspan"] for c in cells), default=0)
        if rows > 1 and cols > 1 and len(cells) > 1:
            out.append({"id": f"table_{i}", "bbox": box_dict(box), "num_rows": rows, "num_cols": cols, "cells": cells, "start_page": None, "end_page": None})
    return out


def detect_tables(gray: np.ndarray, settings: Settings = Settings()) -> list[dict]:  # noqa: B008
    return tables_in(table_mask(k.to_gray(gray), settings), settings)


def table_line_mask(mask: np.ndarray, box: Box, padding: int = 0) -> np.ndarray:
    """A table's part of the line mask, padded if wished."""
    return crop(mask, (box[0] - padding, box[1] - padding, box[2] + padding, box[3] + padding))


def remove_table_lines(image: np.ndarray, mask: np.ndarray, box: Box, padding: int = 2, fill: int = 255) -> np.ndarray:
    """A copy of the image with a table's lines painted over."""
    out = image.copy()
    part, lines = crop(out, box), crop(mask, box)
    if not part.size:
        return out
    if part.shape[:2] != lines.shape:
        lines = lines[np.arange(part.shape[0]) * lines.shape[0] // part.shape[0]][:, np.arange(part.shape[1]) * lines.shape[1] // part.shape[1]]
    if padding > 0:
        lines = k.dilate(lines, 2 * padding + 1, 2 * padding + 1)
    part[lines > 0] = fill
    return out


def paragraph_mask(gray: np.ndarray, boxes: list[Box], padding: int = 5) -> np.ndarray:
    """Text grown together to blocks, without the padded boxes (corners included)."""
    mask = k.close(k.binarize(k.gaussian_blur(gray, 7)), 5, 15, 4)
    h, w = mask.shape
    for box in boxes:
        x0, y0, x1, y1 = int(box[0] - padding), int(box[1] - padding), int(box[2] + padding), int(box[3] + padding)
        mask[min(max(y0, 0), h) : max(y1 + 1, 0), min(max(x0, 0), w) : max(x1 + 1, 0)] = 0
    return mask


def find_paragraphs(mask: np.ndarray) -> list[Box]:
    """Boxes of blocks at least 10 pixels wide and high; their far sides are one past the last pixel."""
    out = []
    for contour in k.external_contours(mask):
        points = k.simplify(contour, 4.0)
        (x, y), (right, low) = points.min(axis=0).tolist(), points.max(axis=0).tolist()
        if right - x + 1 >= 10 and low - y + 1 >= 10:
            out.append((float(x), float(y), float(right + 1), float(low + 1)))
    return out


def quality(image: np.ndarray, settings: QualitySettings = QualitySettings()) -> dict:  # noqa: B008
    """The quality measures of a page image."""
    gray = k.to_gray(image)
    areas = [k.polygon_area(c) for c in k.external_contours(k.binarize(gray))]
    noise = sum(a < settings.noise_area for a in areas) / len(areas) if areas else 0.0
    density = sum(a for a in areas if a >= settings.noise_area) / gray.size
    means = [float(image[:, :, i].mean()) for i in range(3)] if image.ndim == 3 else [0.0] * 3
    sharp, angle = k.laplacian_variance(gray), k.skew_angle(gray)
    return {
        "has_noise": noise > settings.noise_above, "has_blur": sharp < settings.blur_below, "has_colored_bg": max(means) - min(means) > settings.colored_above,
        "has_skew": abs(angle) > settings.skew_above, "contrast_level": k.contrast(gray), "text_density": density, "noise_ratio": noise, "sharpness": sharp, "skew_angle": angle,
    }


def enhance(image: np.ndarray, measures: dict) -> np.ndarray:
    """Gray, and turned straight if the measures call for it."""
    gray = k.to_gray(image)
    return k.rotate(gray, measures["skew_angle"]) if measures["has_skew"] else gray


def preprocess(image: np.ndarray) -> tuple[dict, np.ndarray]:
    measures = quality(image)
    return measures, enhance(image, measures)


# Over DataFrames of pages.


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)[:, :, :3]


def image_dict(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else image.shape[2], "data": np.ascontiguousarray(image).tobytes()}


#: Pages that a Python worker holds as arrays at once.
PAGES_AT_ONCE = 4


def map_pages(pages: DataFrame, keys: list[str], function: Callable[[np.ndarray], list[dict]], ddl: str, image: str = "image") -> DataFrame:
    """keys and the rows (``ddl``) that ``function`` makes of each page image; null images make none."""
    out = T.StructType([*(pages.schema[c] for c in keys), *struct(ddl).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, new = to_arrow_schema(out), struct(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = []
                for page in batch.slice(at, PAGES_AT_ONCE).to_pylist():
                    if page[image] is not None:
                        i = page[image]
                        rows += [{**{c: page[c] for c in keys}, **{c: r[c] for c in new}} for r in function(to_array(i["height"], i["width"], i["channels"], i["data"]))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(*keys, image).mapInArrow(run, out)


def page_metrics(pages: DataFrame, keys: list[str]) -> DataFrame:
    return map_pages(pages, keys, lambda a: [quality(a)], METRICS[len("struct<") : -1].replace(": ", " "))


def page_tables(pages: DataFrame, keys: list[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """keys and ``table``, one row per table found."""
    return map_pages(pages, keys, lambda a: [{"table": t} for t in detect_tables(a, settings)], f"table {TABLE}")


def page_paragraphs(pages: DataFrame, keys: list[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """keys and ``bbox`` of text blocks outside tables."""

    def found(a: np.ndarray) -> list[dict]:
        gray = k.to_gray(a)
        boxes = [tuple(t["bbox"].values()) for t in detect_tables(gray, settings)]
        return [{"bbox": box_dict(b)} for b in find_paragraphs(paragraph_mask(gray, boxes))]

    return map_pages(pages, keys, found, f"bbox {BBOX}")


def table_cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Tables in normalized form: keys, table_id, ord, and the fields of each cell."""
    from pyspark.sql import functions as F

    return tables.select(*keys, F.col("table.id").alias("table_id"), F.posexplode("table.cells").alias("ord", "c")).select(*keys, "table_id", "ord", *(F.col(f"c.{n}").alias(n) for n in struct(CELL).names))
