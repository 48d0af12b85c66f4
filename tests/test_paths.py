"""Lines and areas of PDF pages against brute force, and a ruled table from path operators to cells."""

import math

import numpy as np
import pytest

from gridleaf.operators import detect
from gridleaf.sources import paths
from gridleaf.sources.documents import SimplePdf


def drawing(contents, box=(0, 0, 40, 30)):
    text = contents.encode()
    return b"%%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [%s] /Contents 2 0 R >> endobj\n2 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (" ".join(map(str, box)).encode(), len(text), text)


def render(contents, dpi=72, box=(0, 0, 40, 30)):
    page = SimplePdf()(drawing(contents, box))[0]
    return None if page.render is None else page.render(dpi)


def winding(polygons, x, y):
    """Turns around a point, by crossings of a ray to the left."""
    turns = crossings = 0
    for polygon in polygons:
        for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x:
                turns += 1 if y1 > y0 else -1
                crossings += 1
    return turns, crossings


@pytest.mark.parametrize("even_odd", [False, True])
def test_fill_against_points_in_polygons(even_odd):
    rng = np.random.default_rng(3 + even_odd)
    for _ in range(25):
        polygons = [[tuple(p) for p in rng.uniform(-8, 40, (rng.integers(3, 9), 2))] for _ in range(rng.integers(1, 4))]
        image = np.full((30, 33), 255, dtype=np.uint8)
        paths.fill(image, polygons, 7, even_odd)
        want = np.array([[(n % 2 if even_odd else t) != 0 for t, n in (winding(polygons, x + 0.5, y + 0.5) for x in range(33))] for y in range(30)])
        assert ((image == 7) == want).all()


def test_areas_that_share_an_edge_leave_no_gap_and_no_overlap():
    rng = np.random.default_rng(8)
    for _ in range(20):
        a, b, c, d = (tuple(p) for p in rng.uniform(0, 30, (4, 2)))
        count = np.zeros((30, 30), dtype=int)
        for polygon in ([a, b, (0.0, 30.0)], [b, a, (30.0, 0.0)]):
            one = np.zeros((30, 30), dtype=np.uint8)
            paths.fill(one, [polygon], 1)
            count += one
        inside = [winding([p], 15.5, 15.5)[0] for p in ([a, b, (0.0, 30.0)], [b, a, (30.0, 0.0)])]
        assert count[15, 15] == sum(map(bool, inside))


def test_curves_stray_little():
    rng = np.random.default_rng(5)
    for _ in range(30):
        points = [tuple(p) for p in rng.uniform(0, 200, (4, 2))]
        found = np.array([points[0], *paths.flat(*points)])
        t = np.linspace(0, 1, 400)[:, None]
        curve = (1 - t) ** 3 * points[0] + 3 * (1 - t) ** 2 * t * points[1] + 3 * (1 - t) * t**2 * points[2] + t**3 * points[3]
        a, b = found[:-1], found[1:]
        along = np.clip(((curve[:, None] - a) * (b - a)).sum(2) / ((b - a) ** 2).sum(1), 0, 1)
        assert np.linalg.norm(curve[:, None] - (a + along[:, :, None] * (b - a)), axis=2).min(axis=1).max() <= 0.11


def test_rectangles_colours_and_state():
    gray = render("0.5 g 10 5 20 10 re f")
    want = np.full((30, 40), 255, dtype=np.uint8)
    want[15:25, 10:30] = 128
    assert (gray == want).all()
    assert (render("0.5 g 10 5 20 10 re f", 144) == want.repeat(2, 0).repeat(2, 1)).all()
    colour = render("q 1 0 0 rg 2 0 0 2 4 6 cm 0 0 5 5 re f Q 0 0 3 3 re f")
    assert colour.shape == (30, 40, 3) and (colour[14:24, 4:14] == (0, 0, 255)).all() and (colour[27:, :3] == 0).all()
    assert (render("0 1 1 0 k 0 0 40 30 re f") == (0, 0, 255)).all()
    ring = render("0 0 30 30 re 10 10 10 10 re f*")
    assert ring[15, 15] == 255 and ring[5, 5] == 0 and render("0 0 30 30 re 10 10 10 10 re f")[15, 15] == 0


def test_strokes():
    line = render("2 w 5 10 m 25 10 l S")
    want = np.full((30, 40), 255, dtype=np.uint8)
    want[19:21, 5:25] = 0
    assert (line == want).all()
    assert (render("0 w 5 10.3 m 25 10.3 l S") < 255).sum() == 20  # a hair line is one dot
    assert (render("4 w 2 J 10 10 m 20 10 l S") < 255).sum() == 4 * 14
    dashed = render("2 w [4 2] 0 d 0 10 m 20 10 l S")[19]
    assert dashed.tolist()[:20] == ([0] * 4 + [255] * 2) * 3 + [0] * 2
    box = render("2 w 10 10 12 8 re S")
    assert (box[11:21, 9:23] < 255).sum() == 14 * 10 - 10 * 6
    disc = render("20 15 m 30 15 l 30 20.52 25.52 25 20 25 c 14.48 25 10 20.52 10 15 c 10 9.48 14.48 5 20 5 c 25.52 5 30 9.48 30 15 c f")
    assert abs((disc == 0).sum() - math.pi * 100) < 8


@pytest.mark.parametrize("contents", ["", "0 0 5 5 re n", "0 0 9 9 re W n 0 0 5 5 re f", "0 0 5 5 re f BT (seen) Tj ET", "/P sh", "/Pattern cs /P scn 0 0 5 5 re f", "/G gs 0 0 5 5 re f", "/X Do 0 0 5 5 re f"])
def test_other_pages_are_not_drawn(contents):
    assert render(contents) is None


def test_a_ruled_table_becomes_cells():
    """Three rows of four cells; the first row's last two are merged."""
    xs, ys = [40, 150, 260, 370, 480], [400, 460, 520, 580]
    parts = ["1.5 w"] + [f"{xs[0]} {y} m {xs[-1]} {y} l S" for y in ys]
    parts += [f"{x} {ys[0]} m {x} {ys[-1] if x != 370 else ys[-2]} l S" for x in xs]
    page = SimplePdf()(drawing("\n".join(parts) + " BT 3 Tr (ocr text) Tj ET", (0, 0, 520, 640)))[0]
    image = page.render(100)
    tables = detect.detect_tables(image)
    assert len(tables) == 1
    cells = tables[0]["cells"]
    assert sorted((c["row"], c["col"], c["rowspan"], c["colspan"]) for c in cells) == sorted([(r, c, 1, 1) for r in range(3) for c in range(4) if (r, c) not in ((0, 2), (0, 3))] + [(0, 2, 1, 2)])
    scale = 100 / 72
    box = tables[0]["bbox"]
    for side, want in (("x_min", 40 * scale), ("x_max", 480 * scale), ("y_min", 60 * scale), ("y_max", 240 * scale)):
        assert abs(box[side] - want) <= 6
    assert page.text == "ocr text"
