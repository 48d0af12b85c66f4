"""Fax images by a round trip with a test encoder."""

import itertools

import numpy as np
import pytest

from gridleaf.sources import fax
from gridleaf.sources.documents import SimplePdf
from gridleaf.sources.filters import Unreadable
from tests.test_sources import scanned


def test_codes_have_no_prefix_in_common():
    for black in (False, True):
        codes = sorted([*fax.runs(black), fax.END_OF_LINE])
        assert len(codes) == len(set(codes)) == 64 + 27 + 13 + 1
        assert not any(b.startswith(a) for a, b in itertools.pairwise(codes))
    modes = sorted(fax.MODES)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(modes))


def run_code(n, black):
    codes = {v: c for c, v in fax.runs(black).items()}
    out = ""
    while n >= 2560 + 64:
        out, n = out + codes[2560], n - 2560
    if n >= 64:
        out, n = out + codes[n // 64 * 64], n % 64
    return out + codes[n]


def colour(row, at):
    return 0 if at < 0 else int(row[at])


def alone(row):
    out, black, at = "", 0, 0
    while at < len(row) or not out:
        n = 0
        while at + n < len(row) and row[at + n] == black:
            n += 1
        out, at, black = out + run_code(n, bool(black)), at + n, 1 - black
    return out


def below(row, above):
    """T.4, 4.2: a0, a1, a2 in the row, b1, b2 in the one above; pixels are 1 for black."""
    modes, out, a0, columns = {v: c for c, v in fax.MODES.items()}, "", -1, len(row)
    while a0 < columns:
        now = colour(row, a0)
        a1 = a0 + 1 if a0 >= 0 else 0
        while a1 < columns and row[a1] == now:
            a1 += 1
        b1 = a0 + 1
        while b1 < columns and not (above[b1] != now and (above[b1 - 1] if b1 else 0) == now):
            b1 += 1
        b2 = b1
        while b2 < columns and above[b2] != now:
            b2 += 1
        if b2 < a1:
            out, a0 = out + modes["pass"], b2
        elif abs(a1 - b1) <= 3:
            out, a0 = out + modes[a1 - b1], a1
        else:
            a2 = a1
            while a2 < columns and row[a2] != now:
                a2 += 1
            out += modes["horizontal"] + run_code(a1 - max(a0, 0), bool(now)) + run_code(a2 - a1, not now)
            a0 = a2
    return out


def encoded(image, k, aligned=False):
    """``image``: 1 for black."""
    parts, above = [], np.zeros(image.shape[1], dtype=int)
    for y, row in enumerate(image):
        if k < 0:
            part = below(row, above)
        elif k == 0:
            part = (fax.END_OF_LINE if not aligned else "") + alone(row)
        else:
            part = fax.END_OF_LINE + ("1" + alone(row) if y % k == 0 else "0" + below(row, above))
        parts.append(part + "0" * (-len(part) % 8) if aligned else part)
        above = row
    end = fax.END_OF_LINE * 2 if k < 0 else (fax.END_OF_LINE + ("1" if k > 0 else "")) * 6 if not aligned else ""
    text = "".join(parts) + end
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)


def images():
    rng = np.random.default_rng(4)
    yield (rng.random((12, 40)) < 0.5).astype(int)
    yield np.zeros((3, 17), dtype=int)
    yield np.ones((4, 3000), dtype=int)
    yield np.repeat(np.repeat((rng.random((15, 30)) < 0.3).astype(int), 7, axis=0), 90, axis=1)
    page = np.zeros((330, 255), dtype=int)
    page[40::30, 20:230] = page[40:300, 20::42] = 1
    yield page
    yield (rng.random((30, 1)) < 0.5).astype(int)


@pytest.mark.parametrize("k", [-1, 0, 4])
def test_round_trip(k):
    for image in images():
        data = encoded(image, k)
        assert (fax.decode(data, image.shape[1], image.shape[0], k) == 1 - image).all()
        assert (fax.decode(data, image.shape[1], 0, k, black_is_1=True) == image).all()
        if k <= 0:
            assert (fax.decode(encoded(image, k, True), image.shape[1], image.shape[0], k, aligned=True) == 1 - image).all()


def test_broken_off_and_harmed():
    image = next(itertools.islice(images(), 4, None))
    data = encoded(image, -1)
    part = fax.decode(data[: len(data) // 2], image.shape[1], image.shape[0], -1)
    whole = int((part == 1 - image).all(axis=1).argmin())
    assert whole > 20 and part[-1].all()
    for bad in (b"", b"\0" * 20, b"\0\x01" * 3):
        with pytest.raises(Unreadable):
            fax.decode(bad, 100, 10, -1)
    rng = np.random.default_rng(2)
    for k in (-1, 0, 4):
        good = encoded(image, k)
        for _ in range(60):
            harmed = bytearray(good)
            harmed[rng.integers(len(good))] = rng.integers(256)
            try:
                assert fax.decode(bytes(harmed), image.shape[1], image.shape[0], k).shape == image.shape
            except Unreadable:
                pass


def test_page_of_one_bit_at_300_dpi():
    """An A4 page is drawn pixel for pixel; colours by BlackIs1."""
    page = np.zeros((3508, 2480), dtype=int)
    page[200::150, 100:2400] = page[200:3400, 100::460] = 1
    for flag in (False, True):
        data = encoded(page[:400], -1) if flag else encoded(page[:350], -1)
        rows = 400 if flag else 350
        height = rows * 72 / 300
        body = scanned(np.zeros((rows, 2480), dtype=np.uint8), bits=1, data=data, contents=f"q 595.2 0 0 {height} 0 0 cm /I Do Q", extra=f"/MediaBox [0 0 595.2 {height}]", attributes=f"/DecodeParms << /K -1 /Columns 2480 /Rows {rows} /BlackIs1 {str(flag).lower()} >>").replace(b"/FlateDecode", b"/CCITTFaxDecode")
        found = SimplePdf()(body)[0].render(300)
        assert found.shape == (rows, 2480) and (found == 255 * (page[:rows] if flag else 1 - page[:rows])).all()
