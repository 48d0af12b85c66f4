"""Drawn lines and filled areas of PDF pages: path flattening and a scan converter.

A page is such a drawing if it shows paths in shades of gray or colour and otherwise only invisible text: no images, forms, clipping, patterns or
shadings, and no other graphics that would be left out.  Such pages come from programs that draw tables.

Curves become lines to within a tenth of a dot, strokes become polygons (a thin line is one dot wide at least), and polygons
are filled row by row: the crossings of a row's middle with the edges that are active there, in order, by the nonzero or the even-odd rule.  A dot belongs to
an area if its middle does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from gridleaf.sources.pdf import Name, Pdf, Word, values

Point = tuple[float, float]
Matrix = tuple[float, float, float, float, float, float]
#: Operators after which a page holds something else than paths.
OTHER = frozenset("Do sh W W* BI gs".split())
_PAINT = {"S": (False, True, False), "s": (False, True, True), "f": (True, False, False), "F": (True, False, False), "f*": (True, False, False), "B": (True, True, False), "B*": (True, True, False), "b": (True, True, True), "b*": (True, True, True), "n": (False, False, False)}
_COLOURS = {"g": 1, "rg": 3, "k": 4}


def apply(m: Matrix, p: Point) -> Point:
    return m[0] * p[0] + m[2] * p[1] + m[4], m[1] * p[0] + m[3] * p[1] + m[5]


def times(m: Matrix, by: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = by
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def flat(p0: Point, p1: Point, p2: Point, p3: Point, within: float = 0.1) -> list[Point]:
    """Points of a cubic curve after its first, so close that lines between them stray ``within`` at most."""
    bend = max(math.hypot(a[0] - 2 * b[0] + c[0], a[1] - 2 * b[1] + c[1]) for a, b, c in ((p0, p1, p2), (p1, p2, p3)))
    n = max(1, min(200, math.ceil(math.sqrt(0.75 * bend / within))))
    out = []
    for i in range(1, n + 1):
        t, u = i / n, 1 - i / n
        out.append(tuple(u**3 * a + 3 * u * u * t * b + 3 * u * t * t * c + t**3 * d for a, b, c, d in zip(p0, p1, p2, p3, strict=True)))
    return out


@dataclass
class Line:
    """Points of a part of a path, in dots."""

    points: list[Point]
    closed: bool = False


def stroked(line: Line, width: float, cap: int = 0, dashes: tuple[list[float], float] = ([], 0.0)) -> list[list[Point]]:
    """Polygons that cover a line of a width: a rectangle for each stretch, and a round or square piece at corners and ends."""
    points = line.points + line.points[:1] if line.closed else line.points
    half = max(width, 1.0) / 2
    out: list[list[Point]] = []
    stretches = list(_dashed(points, *dashes)) if dashes[0] else [points]
    for own in stretches:
        own = [p for i, p in enumerate(own) if not i or math.dist(p, own[i - 1]) > 1e-9]
        if len(own) == 1 and cap and own:
            out.append(_disc(own[0], half) if cap == 1 else _square(own[0], half))
        for i, (a, b) in enumerate(zip(own, own[1:], strict=False)):
            length = math.dist(a, b)
            ux, uy = (b[0] - a[0]) / length * half, (b[1] - a[1]) / length * half
            first, last = i == 0 and not line.closed, i == len(own) - 2 and not line.closed
            s, e = (1.0 if cap == 2 and first else 0.0), (1.0 if cap == 2 and last else 0.0)
            a, b = (a[0] - s * ux, a[1] - s * uy), (b[0] + e * ux, b[1] + e * uy)
            out.append([(a[0] - uy, a[1] + ux), (b[0] - uy, b[1] + ux), (b[0] + uy, b[1] - ux), (a[0] + uy, a[1] - ux)])
        inner = own[1:-1] + (own[:1] if line.closed and not dashes[0] else [])
        if half > 0.75:  # corners; of thin lines the rectangles are enough
            out += [_square(p, half) for p in inner]
        if cap == 1 and not line.closed and len(own) > 1:
            out += [_disc(own[0], half), _disc(own[-1], half)]
    return out


def _disc(p: Point, r: float) -> list[Point]:
    n = max(8, math.ceil(4 * math.sqrt(r)) * 4)
    return [(p[0] + r * math.cos(2 * math.pi * i / n), p[1] + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def _square(p: Point, r: float) -> list[Point]:
    return [(p[0] - r, p[1] - r), (p[0] + r, p[1] - r), (p[0] + r, p[1] + r), (p[0] - r, p[1] + r)]


def _dashed(points: list[Point], pattern: list[float], phase: float) -> Iterator[list[Point]]:
    """The parts of a line that a pattern of dashes and gaps shows."""
    if sum(pattern) <= 0 or min(pattern) < 0:
        yield points
        return
    pattern = pattern * (1 + len(pattern) % 2)
    i, left = 0, phase % sum(pattern)
    while left >= pattern[i]:
        left -= pattern[i]
        i = (i + 1) % len(pattern)
    left, now = pattern[i] - left, [points[0]]
    for a, b in zip(points, points[1:], strict=False):
        length, at = math.dist(a, b), 0.0
        while length - at > left:
            at += left
            p = (a[0] + (b[0] - a[0]) * at / length, a[1] + (b[1] - a[1]) * at / length)
            if i % 2 == 0:
                yield [*now, p]
            now, i = [p], (i + 1) % len(pattern)
            left = pattern[i]
        left -= length - at
        now.append(b)
    if i % 2 == 0 and len(now) > 1:
        yield now


def fill(image: np.ndarray, polygons: list[list[Point]], colour: int | tuple[int, ...], even_odd: bool = False) -> None:
    """Paint the dots whose middle the polygons hold; ``image`` has rows from the top, points are (x, y) in dots from its upper left corner."""
    height, width = image.shape[:2]
    edges = []
    for polygon in polygons:
        for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            if y0 != y1:
                up = y0 < y1
                (xa, ya), (xb, yb) = ((x0, y0), (x1, y1)) if up else ((x1, y1), (x0, y0))
                # Rows whose middle lies in [ya, yb).
                first, stop = max(0, math.ceil(ya - 0.5)), min(height, math.ceil(yb - 0.5))
                if first < stop:
                    slope = (xb - xa) / (yb - ya)
                    edges.append([first, stop, xa + (first + 0.5 - ya) * slope, slope, 1 if up else -1])
    edges.sort(key=lambda e: e[0])
    active: list[list] = []
    at = 0
    for y in range(edges[0][0] if edges else 0, max((e[1] for e in edges), default=0)):
        active = [e for e in active if e[1] > y]
        while at < len(edges) and edges[at][0] <= y:
            active.append(edges[at])
            at += 1
        active.sort(key=lambda e: e[2])
        turn = 0
        for left, right in zip(active, active[1:], strict=False):
            turn += 1 if even_odd else left[4]
            if turn % 2 if even_odd else turn:
                a, b = max(0, math.ceil(left[2] - 0.5)), min(width, math.ceil(right[2] - 0.5))
                if a < b:
                    image[y, a:b] = colour
        for e in active:
            e[2] += e[3]


@dataclass
class State:
    matrix: Matrix
    fill: tuple[int, int, int] = (0, 0, 0)
    stroke: tuple[int, int, int] = (0, 0, 0)
    width: float = 1.0
    cap: int = 0
    dashes: tuple[tuple[float, ...], float] = ((), 0.0)
    mode: int = 0


def colour_of(parts: list[float]) -> tuple[int, int, int]:
    """Blue, green, red of gray, red-green-blue or cyan-magenta-yellow-black."""
    if len(parts) == 1:
        parts = parts * 3
    elif len(parts) == 4:
        parts = [1 - min(1.0, c + parts[3]) for c in parts[:3]]
    return tuple(round(255 * min(1.0, max(0.0, c))) for c in reversed(parts))


@dataclass
class Painted:
    """Polygons of one colour."""

    polygons: list[list[Point]]
    colour: tuple[int, int, int]
    even_odd: bool


def painted_paths(pdf: Pdf, page: dict, dpi: int) -> list[Painted] | None:
    """What the paths of a drawing paint, in order, in dots from the upper left corner; None for any other page."""
    if (pdf.inherited(page, "Rotate") or 0) or page.get("Annots") is not None:
        return None
    left, _, _, top = pdf.box(page)
    scale = dpi / 72
    now, kept, out = State((scale, 0.0, 0.0, -scale, -left * scale, top * scale)), [], []
    lines: list[Line] = []
    at: Point = (0.0, 0.0)
    held: list = []

    def number(n: int) -> list[float] | None:
        found = [x for x in held if isinstance(x, int | float) and not isinstance(x, bool)]
        return [float(x) for x in found[-n:]] if len(found) >= n else None

    for item in values(pdf.contents(page)):
        if not isinstance(item, Word):
            held.append(item)
            continue
        if item in OTHER or (item in ("Tj", "TJ", "'", '"') and now.mode != 3) or (item in ("cs", "CS") and held[-1:] not in ([Name("DeviceGray")], [Name("DeviceRGB")], [Name("DeviceCMYK")])):
            return None
        if item == "q":
            kept.append(now)
        elif item == "Q" and kept:
            now = kept.pop()
        elif item == "cm" and (n := number(6)):
            now = replace(now, matrix=times(tuple(n), now.matrix))
        elif item == "w" and (n := number(1)):
            now = replace(now, width=n[0])
        elif item == "J" and (n := number(1)):
            now = replace(now, cap=int(n[0]))
        elif item == "d" and len(held) >= 2 and isinstance(held[-2], list):
            now = replace(now, dashes=(tuple(float(x) for x in held[-2] if isinstance(x, int | float)), float(held[-1]) if isinstance(held[-1], int | float) else 0.0))
        elif item == "Tr" and (n := number(1)):
            now = replace(now, mode=int(n[0]))
        elif item.lower() in _COLOURS and (n := number(_COLOURS[item.lower()])):
            now = replace(now, **{"fill" if item.islower() else "stroke": colour_of(n)})
        elif item in ("sc", "scn", "SC", "SCN") and len(held) in (1, 3, 4) and (n := number(len(held))):
            now = replace(now, **{"fill" if item.islower() else "stroke": colour_of(n)})
        elif item in ("sc", "scn", "SC", "SCN"):
            return None
        elif item == "m" and (n := number(2)):
            at = (n[0], n[1])
            lines.append(Line([apply(now.matrix, at)]))
        elif item == "l" and lines and (n := number(2)):
            at = (n[0], n[1])
            lines[-1].points.append(apply(now.matrix, at))
        elif item in ("c", "v", "y") and lines and (n := number(6 if item == "c" else 4)):
            given = [(n[i], n[i + 1]) for i in range(0, len(n), 2)]
            control = given if item == "c" else [at, *given] if item == "v" else [given[0], given[1], given[1]]
            lines[-1].points += flat(apply(now.matrix, at), *(apply(now.matrix, p) for p in control))
            at = control[-1]
        elif item == "re" and (n := number(4)):
            x, y, w, h = n
            lines.append(Line([apply(now.matrix, p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))], True))
            at = (x, y)
        elif item == "h" and lines:
            lines[-1].closed = True
            lines.append(Line(lines[-1].points[:1]))
        elif item in _PAINT:
            filled, drawn, close = _PAINT[item]
            if close and lines:
                lines[-1].closed = True
            whole = [line for line in lines if len(line.points) > 1]
            if filled and whole:
                out.append(Painted([line.points for line in whole], now.fill, item.endswith("*")))
            if drawn and whole:
                grown = math.sqrt(abs(now.matrix[0] * now.matrix[3] - now.matrix[1] * now.matrix[2]))
                dashes = ([d * grown for d in now.dashes[0]], now.dashes[1] * grown)
                out += [Painted([p], now.stroke, False) for line in whole for p in stroked(line, now.width * grown, now.cap, dashes)]
            lines = []
        held = []
    return out or None


def draw(pdf: Pdf, page: dict, painted: list[Painted], dpi: int) -> np.ndarray:
    """The page on white: gray, or blue, green, red if any colour is not a gray."""
    width, height = (max(1, round(n * dpi / 72)) for n in pdf.size(page))
    coloured = any(len(set(p.colour)) > 1 for p in painted)
    out = np.full((height, width, 3) if coloured else (height, width), 255, dtype=np.uint8)
    for p in painted:
        fill(out, p.polygons, p.colour if coloured else p.colour[0], p.even_odd)
    return out
