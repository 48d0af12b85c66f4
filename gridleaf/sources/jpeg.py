"""Baseline and progressive JPEG images (8 bits, gray or three colours), as scanners write them into PDF files.

Entropy-coded data is walked bit by bit with a table of 16 bits for each Huffman code; what follows
is array work: all blocks of a component are put through the inverse cosine transform at once, brought to full size and turned into colours.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from gridleaf.sources.filters import Unreadable


def zigzag() -> list[int]:
    """Place (row * 8 + column) of each coefficient in the order of a block: along diagonals, to and fro."""
    return [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


def cosines() -> np.ndarray:
    """(frequency, place) of the transform."""
    u, x = np.mgrid[:8, :8]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


ZIGZAG = zigzag()
COSINES = cosines()


@dataclass
class Component:
    across: int
    down: int
    quantizer: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    #: Blocks that hold samples, and blocks with those that fill up the last units.
    size: tuple[int, int] = (0, 0)
    padded: tuple[int, int] = (0, 0)
    coefficients: list = field(default_factory=list)


class Window:
    """Bits of an entropy-coded segment, 24 of them at every byte."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(300), dtype=np.uint8).astype(np.int64)
        self.words = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist()
        self.end = 8 * (len(raw) - 300)


def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the length and symbol of the code they begin with (length * 256 + symbol); 0 for none."""
    table, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << (16 - length)
            if code >> length:
                raise Unreadable("codes that do not fit")
            table[first : first + (1 << (16 - length))] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return table.tolist()


def _baseline(window: Window, at: int, c: Component, block: int, dc: list[int], ac: list[int]) -> int:
    words, out = window.words, c.coefficients
    code = dc[(words[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
    size = code & 255
    at += code >> 8
    if not code or size > 15:
        raise Unreadable("no code")
    if size:
        bits = (words[at >> 3] >> (24 - (at & 7) - size)) & ((1 << size) - 1)
        at += size
        c.last += bits if bits >> (size - 1) else bits - (1 << size) + 1
    base = block * 64
    out[base] = c.last
    k = 1
    while k < 64:
        code = ac[(words[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
        if not code:
            raise Unreadable("no code")
        at += code >> 8
        size = code & 15
        if not size:
            if code & 240 != 240:
                break
            k += 16
            continue
        k += code >> 4 & 15
        if k > 63:
            raise Unreadable("too many coefficients")
        bits = (words[at >> 3] >> (24 - (at & 7) - size)) & ((1 << size) - 1)
        at += size
        out[base + ZIGZAG[k]] = bits if bits >> (size - 1) else bits - (1 << size) + 1
        k += 1
    return at


class Progressive:
    """The parts of a progressive scan that are not plain: spectral bands, bits added later, runs of ended blocks."""

    def __init__(self, first: int, last: int, high: int, low: int):
        self.first, self.last, self.high, self.low, self.ended = first, last, high, low, 0

    def block(self, window: Window, at: int, c: Component, block: int, dc: list[int], ac: list[int]) -> int:
        words, out, base, low = window.words, c.coefficients, block * 64, self.low

        def take(n: int) -> int:
            return (words[at >> 3] >> (24 - (at & 7) - n)) & ((1 << n) - 1)

        if not self.first:
            if self.high:
                out[base] |= take(1) << low
                return at + 1
            code = dc[take(16)]
            size = code & 255
            at += code >> 8
            if not code or size > 15:
                raise Unreadable("no code")
            if size:
                bits = take(size)
                at += size
                c.last += bits if bits >> (size - 1) else bits - (1 << size) + 1
            out[base] = c.last << low
            return at
        k = self.first
        if not self.high and self.ended:
            self.ended -= 1
            return at
        while k <= self.last and not self.ended:
            code = ac[take(16)]
            if not code:
                raise Unreadable("no code")
            at += code >> 8
            run, size = code >> 4 & 15, code & 15
            if not size and run < 15:
                self.ended = 1 << run
                if run:
                    self.ended += take(run)
                    at += run
                break
            if self.high:
                new = 0
                if size:
                    new = 1 << low if take(1) else -(1 << low)
                    at += 1
                while k <= self.last:
                    spot = base + ZIGZAG[k]
                    k += 1
                    if out[spot]:
                        at = self._more(out, spot, take(1), at)
                    elif run:
                        run -= 1
                    else:
                        if new:
                            out[spot] = new
                        break
                continue
            k += run
            if k > self.last and size:
                raise Unreadable("too many coefficients")
            if size:
                bits = take(size)
                at += size
                out[base + ZIGZAG[k]] = (bits if bits >> (size - 1) else bits - (1 << size) + 1) * (1 << low)
            k += 1
        if self.ended:
            self.ended -= 1
            if self.high:
                for k in range(k, self.last + 1):
                    if out[base + ZIGZAG[k]]:
                        at = self._more(out, base + ZIGZAG[k], take(1), at)
        return at

    def _more(self, out: list[int], spot: int, bit: int, at: int) -> int:
        if bit:
            out[spot] += 1 << self.low if out[spot] > 0 else -(1 << self.low)
        return at + 1


class Jpeg:
    """The parts of a file, and its samples."""

    def __init__(self, data: bytes):
        self.tables: dict[int, list[int]] = {}
        self.quantizers: dict[int, np.ndarray] = {}
        self.components: dict[int, Component] = {}
        self.width = self.height = self.restart = 0
        self.scans = 0
        self.progressive = False
        self.transform: int | None = None
        at = data.find(b"\xff\xd8") + 2
        if at < 2:
            raise Unreadable("not a JPEG")
        while True:
            found = re.compile(rb"\xff+([^\x00\xff])").search(data, at)
            if not found:
                break
            kind, at = found[1][0], found.end()
            if kind == 0xD9:
                break
            if 0xD0 <= kind <= 0xD8 or kind == 1:
                continue
            size = int.from_bytes(data[at : at + 2])
            part, at = data[at + 2 : at + size], at + size
            if len(part) < size - 2:
                raise Unreadable("a cut-off segment")
            if kind == 0xDA:
                at = self._scan(part, data, at)
            else:
                self._segment(kind, part)
        if not self.scans:
            raise Unreadable("no frame or no scan")

    def _segment(self, kind: int, part: bytes) -> None:
        if kind == 0xDB:
            while part:
                wide, n = part[0] >> 4, part[0] & 15
                values = np.frombuffer(part, dtype=">u2" if wide else np.uint8, count=64, offset=1)
                self.quantizers[n] = np.zeros(64)
                self.quantizers[n][ZIGZAG] = values
                part = part[129 if wide else 65 :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                self.tables[part[0]] = huffman(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif kind == 0xDD:
            self.restart = int.from_bytes(part[:2])
        elif kind == 0xEE and part[:5] == b"Adobe" and len(part) > 11:
            self.transform = part[11]
        elif kind in (0xC0, 0xC1, 0xC2):
            self._frame(part, kind == 0xC2)
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise Unreadable("a lossless, hierarchical or arithmetic image")

    def _frame(self, part: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = part[0], int.from_bytes(part[1:3]), int.from_bytes(part[3:5]), part[5]
        if bits != 8 or n not in (1, 3) or not self.width or not self.height or self.components:
            raise Unreadable("not one image of 8 bits in gray or three colours")
        self.progressive = progressive
        for i in range(n):
            number, factors, quantizer = part[6 + 3 * i : 9 + 3 * i]
            self.components[number] = Component(factors >> 4, factors & 15, quantizer)
        if not all(1 <= f <= 4 for c in self.components.values() for f in (c.across, c.down)):
            raise Unreadable("factors of a component")
        self.most = tuple(max(getattr(c, f) for c in self.components.values()) for f in ("across", "down"))
        self.units = tuple(-(-n // (8 * most)) for n, most in zip((self.width, self.height), self.most, strict=True))
        for c in self.components.values():
            c.size = tuple(-(-n * f // (8 * most)) for n, f, most in zip((self.width, self.height), (c.across, c.down), self.most, strict=True))
            c.padded = (self.units[0] * c.across, self.units[1] * c.down)
            c.coefficients = [0] * (64 * c.padded[0] * c.padded[1])

    def _scan(self, part: bytes, data: bytes, at: int) -> int:
        chosen = []
        self.scans += 1
        for i in range(part[0]):
            number, tables = part[1 + 2 * i : 3 + 2 * i]
            if number not in self.components:
                raise Unreadable("a scan of no component")
            c = self.components[number]
            c.dc, c.ac = tables >> 4, 16 + (tables & 15)
            chosen.append(c)
        first, last, bits = part[1 + 2 * part[0] : 4 + 2 * part[0]]
        found = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
        end = found.start() if found else len(data)
        segments = re.split(rb"\xff[\xd0-\xd7]", data[at:end])
        # One component alone goes by its own blocks, several by units of all.
        alone = len(chosen) == 1
        across, down = chosen[0].size if alone else self.units
        total = across * down
        per = self.restart or total
        for i, start in enumerate(range(0, total, per)):
            if i >= len(segments):
                raise Unreadable("a cut-off scan")
            window, spot = Window(segments[i]), 0
            step = Progressive(first, last, bits >> 4, bits & 15).block if self.progressive else _baseline
            for c in chosen:
                c.last = 0
            for unit in range(start, min(start + per, total)):
                y, x = divmod(unit, across)
                for c in chosen:
                    dc, ac = self.tables.get(c.dc, ()), self.tables.get(c.ac, ())
                    if (not dc and not first and not bits >> 4) or (not ac and last):
                        raise Unreadable("no table of codes")
                    blocks = ((y, x),) if alone else [(y * c.down + v, x * c.across + h) for v in range(c.down) for h in range(c.across)]
                    for row, column in blocks:
                        spot = step(window, spot, c, row * c.padded[0] + column, dc, ac)
                        if spot > window.end + 64:
                            raise Unreadable("a cut-off scan")
        return end

    def samples(self, c: Component) -> np.ndarray:
        if c.quantizer not in self.quantizers:
            raise Unreadable("no quantizer")
        blocks = (np.array(c.coefficients, dtype=np.float64).reshape(-1, 64) * self.quantizers[c.quantizer]).reshape(-1, 8, 8)
        plain = np.clip(np.rint(COSINES.T @ blocks @ COSINES + 128), 0, 255).astype(np.uint8)
        across, down = c.padded
        rows = plain.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
        y, x = np.arange(self.height) * c.down // self.most[1], np.arange(self.width) * c.across // self.most[0]
        return rows[y][:, x]

    def pixels(self, transform: int | None = None) -> np.ndarray:
        """Gray, or red, green and blue; ``transform`` 0 says that three colours are not stored as luminance and differences."""
        planes = [self.samples(c) for c in self.components.values()]
        if len(planes) == 1:
            return planes[0]
        own = self.transform if self.transform is not None else transform
        if own == 0:
            return np.stack(planes, axis=2)
        y, blue, red = (p.astype(np.float64) for p in planes)
        blue, red = blue - 128, red - 128
        return np.clip(np.rint(np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], axis=2)), 0, 255).astype(np.uint8)


def decode(data: bytes, transform: int | None = None) -> np.ndarray:
    try:
        return Jpeg(data).pixels(transform)
    except (IndexError, ValueError) as e:
        raise Unreadable(str(e) or "a broken JPEG") from e
