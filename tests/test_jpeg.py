"""JPEG images against a plain inverse transform, from a test encoder of baseline and progressive files."""

import numpy as np
import pytest

from gridleaf.sources import jpeg
from gridleaf.sources.documents import BadDocument, SimplePdf
from gridleaf.sources.filters import Unreadable
from tests.test_sources import scanned

DIAGONALS = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
#: Every symbol up to 254 has nine bits; a second table has codes of many lengths.
FLAT = (bytes([0] * 8 + [255] + [0] * 7), bytes(range(255)))
SLOPING = (bytes([0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 246]), bytes(range(254)))


def codes(table):
    out, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for symbol in table[1][at : at + n]:
            out[symbol] = format(code, f"0{length}b")
            code += 1
        at, code = at + n, code << 1
    return out


def number(v):
    size = abs(v).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00") if bits else b""


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2) + body


class Writer:
    """``planes``: for each component (across, down, blocks as (rows, columns, 64) in zigzag order)."""

    def __init__(self, width, height, planes, progressive=False, table=FLAT, restart=0, quantizer=None, adobe=None):
        self.planes, self.width, self.height, self.restart, self.code = planes, width, height, restart, codes(table)
        self.quantizer = quantizer or [1] * 64
        self.out = b"\xff\xd8" + (segment(0xEE, b"Adobe\0d\0\0\0\0" + bytes([adobe])) if adobe is not None else b"")
        self.out += segment(0xDB, b"\0" + bytes(self.quantizer)) + segment(0xC4, b"\0" + table[0] + table[1]) + segment(0xC4, b"\x10" + table[0] + table[1])
        frame = b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d, _) in enumerate(planes))
        self.out += segment(0xC2 if progressive else 0xC0, bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([len(planes)]) + frame)
        if restart:
            self.out += segment(0xDD, restart.to_bytes(2))

    def order(self, chosen):
        """Units of blocks: (plane, row, column)."""
        most = [max(p[k] for p in self.planes) for k in (0, 1)]
        if len(chosen) == 1:
            a, d, _ = self.planes[chosen[0]]
            return [[(chosen[0], y, x)] for y in range(-(-self.height * d // (8 * most[1]))) for x in range(-(-self.width * a // (8 * most[0])))]
        across, down = (-(-n // (8 * m)) for n, m in zip((self.width, self.height), most, strict=True))
        return [[(i, y * self.planes[i][1] + v, x * self.planes[i][0] + h) for i in chosen for v in range(self.planes[i][1]) for h in range(self.planes[i][0])] for y in range(down) for x in range(across)]

    def scan(self, chosen, first, last, high, low, block, flush=lambda: ""):
        self.out += segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([i + 1, 0]) for i in chosen) + bytes([first, last, high << 4 | low]))
        units = self.order(chosen)
        per = self.restart or len(units)
        for i, start in enumerate(range(0, len(units), per)):
            self.last = dict.fromkeys(chosen, 0)
            bits = "".join(block(p, self.planes[p][2][y, x]) for unit in units[start : start + per] for p, y, x in unit) + flush()
            self.out += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + packed(bits)

    def dc(self, p, value):
        size, bits = number(value - self.last[p])
        self.last[p] = value
        return self.code[size] + bits

    def baseline(self):
        def block(p, values):
            out, run = self.dc(p, int(values[0])), 0
            for v in values[1 : np.flatnonzero(values)[-1] + 1 if values.any() else 1].tolist():
                if not v:
                    run += 1
                    continue
                size, bits = number(v)
                out += self.code[240] * (run // 16) + self.code[(run % 16) << 4 | size] + bits
                run = 0
            return out + (self.code[0] if not values[63] else "")

        self.scan(range(len(self.planes)), 0, 63, 0, 0, block)
        return self.out + b"\xff\xd9"

    def progressive(self):
        every = range(len(self.planes))
        self.scan(every, 0, 0, 0, 1, lambda p, v: self.dc(p, int(v[0]) >> 1))
        for first, last in ((1, 5), (6, 63)):
            for p in every:
                self._ac_first([p], first, last, 2)
                for low in (1, 0):
                    self._ac_more([p], first, last, low)
        self.scan(every, 0, 0, 1, 0, lambda p, v: str(int(v[0]) & 1))
        return self.out + b"\xff\xd9"

    def _ended(self, n):
        """A run of n blocks that have ended."""
        out = ""
        while n:
            size = min(14, n.bit_length() - 1)
            take = min(n, (2 << size) - 1)
            out += self.code[size << 4] + (format(take - (1 << size), f"0{size}b") if size else "")
            n -= take
        return out

    def _ac_first(self, chosen, first, last, low):
        held = [0]

        def flush():
            out, held[0] = self._ended(held[0]), 0
            return out

        def block(p, values):
            cut = [abs(int(v)) >> low if v > 0 else -(abs(int(v)) >> low) for v in values[first : last + 1]]
            if not any(cut):
                held[0] += 1
                return ""
            out, run = flush(), 0
            for k, v in enumerate(cut):
                if not v:
                    run += 1
                    if not any(cut[k:]):
                        held[0] += 1
                        break
                    continue
                size, bits = number(v)
                out += self.code[240] * (run // 16) + self.code[(run % 16) << 4 | size] + bits
                run = 0
            return out

        self.scan(chosen, first, last, 0, low, block, flush)

    def _ac_more(self, chosen, first, last, low):
        def block(p, values):
            now = [abs(int(v)) >> low for v in values[first : last + 1]]
            fresh = [k for k, v in enumerate(now) if v == 1]
            out, run, bits = "", 0, ""
            for k, v in enumerate(now):
                if v > 1:
                    bits += str(v & 1)
                elif v == 1:
                    out += self.code[run << 4 | 1] + ("1" if values[first + k] > 0 else "0") + bits
                    run, bits = 0, ""
                else:
                    run += 1
                    if run == 16 and any(f > k for f in fresh):
                        out, run, bits = out + self.code[240] + bits, 0, ""
            return out + (self.code[0] + bits if not fresh or fresh[-1] < len(now) - 1 else "")

        self.scan(chosen, first, last, low + 1, low, block)


def random_planes(rng, width, height, factors, size=40):
    most = [max(f[k] for f in factors) for k in (0, 1)]
    out = []
    for a, d in factors:
        columns, rows = a * -(-width // (8 * most[0])), d * -(-height // (8 * most[1]))
        blocks = (rng.integers(-size, size + 1, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < 0.15)).astype(int)
        blocks[:, :, 0] = rng.integers(-300, 300, (rows, columns))
        blocks[rng.random((rows, columns)) < 0.3, 1:] = 0
        out.append((a, d, blocks))
    return out


def plain(width, height, planes, quantizer, transform):
    """By the definition of the transform, block by block."""
    most, found = [max(p[k] for p in planes) for k in (0, 1)], []
    scale = lambda u: np.sqrt(0.125) if u == 0 else 0.5
    basis = np.array([[scale(r) * scale(c) * np.outer(np.cos((2 * np.arange(8) + 1) * r * np.pi / 16), np.cos((2 * np.arange(8) + 1) * c * np.pi / 16)) for c in range(8)] for r in range(8)])
    for a, d, blocks in planes:
        rows, columns, _ = blocks.shape
        image = np.zeros((8 * rows, 8 * columns))
        for y in range(rows):
            for x in range(columns):
                image[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = 128 + sum(blocks[y, x, k] * quantizer[k] * basis[r, c] for k, (r, c) in enumerate(DIAGONALS))
        image = np.clip(image, 0, 255)
        found.append(image[[y * d // most[1] for y in range(height)]][:, [x * a // most[0] for x in range(width)]])
    if len(found) == 1:
        return found[0]
    if not transform:
        return np.stack(found, axis=2)
    y, cb, cr = found
    return np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2), 0, 255)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize(
    ("size", "factors", "how"),
    [((17, 9), [(1, 1)], {}), ((40, 33), [(1, 1)] * 3, {}), ((37, 30), [(2, 2), (1, 1), (1, 1)], {"restart": 2}), ((50, 20), [(2, 1), (1, 1), (1, 1)], {"table": SLOPING, "restart": 3}), ((24, 24), [(1, 1)] * 3, {"adobe": 0}), ((16, 40), [(1, 2), (1, 1), (1, 1)], {"quantizer": [2] * 10 + [3] * 54}), ((64, 64), [(2, 2)], {})],
)
def test_images_within_one_level_of_the_plain_transform(size, factors, how, progressive):
    rng = np.random.default_rng(sum(size) + progressive)
    planes = random_planes(rng, *size, factors, 12 if how.get("table") else 40)
    writer = Writer(*size, planes, progressive, **how)
    found = jpeg.decode(writer.progressive() if progressive else writer.baseline())
    want = plain(*size, planes, writer.quantizer, how.get("adobe") != 0)
    assert found.shape == want.shape and found.dtype == np.uint8
    assert np.abs(found - want).max() <= (1.0 if len(factors) == 1 or how.get("adobe") == 0 else 2.0)  # each of three planes is rounded first


def test_broken_images_are_errors():
    rng = np.random.default_rng(1)
    good = Writer(20, 20, random_planes(rng, 20, 20, [(1, 1)])).baseline()
    assert jpeg.decode(good).shape == (20, 20)
    for bad in (b"", b"no jpeg", good[:100], good[: len(good) // 2 + 150], good.replace(b"\xff\xc0", b"\xff\xc3"), good[:2] + good[-2:]):
        with pytest.raises(Unreadable):
            jpeg.decode(bad)
    for _ in range(60):  # whatever is harmed: an image or an error
        harmed = bytearray(good)
        harmed[rng.integers(len(good))] = rng.integers(256)
        try:
            assert jpeg.decode(bytes(harmed)).ndim in (2, 3)
        except Unreadable:
            pass


def test_scanned_pages_with_jpeg_images():
    rng = np.random.default_rng(9)
    planes = random_planes(rng, 24, 16, [(1, 1)] * 3, 10)
    data = Writer(24, 16, planes).baseline()
    body = scanned(np.zeros((16, 24, 3), dtype=np.uint8), data=data, contents="q 24 0 0 16 0 0 cm /I Do Q", extra="/MediaBox [0 0 24 16]").replace(b"/FlateDecode", b"/DCTDecode")
    assert (SimplePdf()(body)[0].render(72) == jpeg.decode(data)[:, :, ::-1]).all()
    wrong = scanned(np.zeros((8, 24, 3), dtype=np.uint8), data=data, contents="q 24 0 0 16 0 0 cm /I Do Q", extra="/MediaBox [0 0 24 16]").replace(b"/FlateDecode", b"/DCTDecode")
    for bad in (wrong, body.replace(b"\xff\xda", b"\xff\xdd")):
        with pytest.raises(BadDocument):
            SimplePdf()(bad)[0].render(72)
