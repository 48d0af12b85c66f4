"""Pages of scanned PDF files: a page that shows nothing but images is drawn from them.

A page is such a scan if it shows at least one image, upright, and otherwise only invisible text.
Images are gray or colour of 8 bits or black and white of 1 bit, packed by any of the plain filters, as JPEG or as fax.
Pages with lines, visible text, forms, clipping, masks, a turned page or any other image are no scans; they
are not drawn at all, so no image of a page ever lacks a part of it.  What no image covers is white.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridleaf.sources import fax, jpeg
from gridleaf.sources.filters import Unreadable
from gridleaf.sources.pdf import Name, Pdf, Stream, Word, values

#: Filters that give back the samples of an image.
PLAIN = frozenset(("FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"))
#: Filters of a kind of image each.
IMAGES = frozenset(("DCTDecode", "CCITTFaxDecode"))

#: Operators that paint or clip, other than by an image or by text.
_OTHER_MARKS = frozenset("S s f F f* B B* b b* sh W W* BI".split())
_INVISIBLE = 3
Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, by: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = by
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


@dataclass
class Placed:
    """An image of a page, and the box (points) that it fills; a box may run backwards."""

    stream: Stream
    channels: int
    bits: int
    #: The filter that makes it an image by itself, if there is one.
    kind: str | None
    inverted: bool
    box: tuple[float, float, float, float]

    def pixels(self, pdf: Pdf) -> np.ndarray:
        width, height = (pdf.of(self.stream.attributes[k]) for k in ("Width", "Height"))
        if self.kind == "DCTDecode":
            data, parameters = self.stream.before_last(pdf.of)
            image = jpeg.decode(data, parameters.get("ColorTransform"))
            if image.shape != ((height, width) if self.channels == 1 else (height, width, 3)):
                raise Unreadable("a JPEG of another size or number of colours")
            image = image if self.channels == 1 else image[:, :, ::-1]
            return 255 - image if self.inverted else image
        if self.kind == "CCITTFaxDecode":
            data, own = self.stream.before_last(pdf.of)
            rows = fax.decode(data, own.get("Columns", 1728), height, own.get("K", 0), bool(own.get("EncodedByteAlign")), bool(own.get("BlackIs1")), own.get("EndOfBlock") is not False)
            if rows.shape[1] != width:
                raise Unreadable("a fax of another width")
            image = rows * np.uint8(255)
            return 255 - image if self.inverted else image
        shape = {"Columns": width, "Colors": self.channels, "BitsPerComponent": self.bits}
        data, stride = self.stream.data(pdf.of, shape), (width * self.channels * self.bits + 7) // 8
        rows = np.frombuffer(data, dtype=np.uint8, count=height * stride).reshape(height, stride)
        if self.bits == 1:
            rows = np.unpackbits(rows, axis=1)[:, :width] * np.uint8(255)
        image = rows if self.channels == 1 else rows.reshape(height, width, 3)[:, :, ::-1]
        return 255 - image if self.inverted else image


def _channels(pdf: Pdf, space: object) -> int | None:
    space = pdf.of(space)
    if isinstance(space, list) and len(space) == 2 and pdf.of(space[0]) == "ICCBased":
        profile = pdf.of(space[1])
        n = pdf.of(profile.attributes.get("N")) if isinstance(profile, Stream) else None
        return n if n in (1, 3) else None
    return {"DeviceGray": 1, "DeviceRGB": 3}.get(space) if isinstance(space, str) else None


def _image(pdf: Pdf, item: object, m: Matrix) -> Placed | None:
    """The image that an operator shows; None if it cannot be drawn here."""
    if not isinstance(item, Stream) or pdf.of(item.attributes.get("Subtype")) != "Image":
        return None
    own = {k: pdf.of(v) for k, v in item.attributes.items()}
    channels, bits, (a, b, c, d, e, f) = _channels(pdf, own.get("ColorSpace")), own.get("BitsPerComponent"), m
    decode = [pdf.of(x) for x in own.get("Decode") or [0, 1] * (channels or 0)]
    kinds = item.kinds(pdf.of)
    kind = kinds.pop() if kinds and kinds[-1] in IMAGES else None
    plain = set(kinds) <= PLAIN and (kind is None or bits == (8 if kind == "DCTDecode" else 1))
    shown = channels is not None and (bits == 8 or (bits == 1 and channels == 1)) and decode in ([0, 1] * channels, [1, 0] * channels)
    sized = all(isinstance(own.get(k), int) and own[k] > 0 for k in ("Width", "Height"))
    masked = bool(own.get("ImageMask")) or own.get("SMask") is not None or own.get("Mask") is not None
    if not (plain and shown and sized) or masked or b or c or not a or not d:
        return None
    return Placed(item, channels, bits, kind, decode[0] == 1, (e, f, e + a, f + d))


def placed_images(pdf: Pdf, page: dict) -> list[Placed] | None:
    """The images of a scan in the order of drawing; None for any other page."""
    if (pdf.inherited(page, "Rotate") or 0) or page.get("Annots") is not None:
        return None
    resources = pdf.inherited(page, "Resources") or {}
    objects = pdf.of(resources.get("XObject")) or {}
    now, mode, kept = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0, []
    out, held = [], []
    for item in values(pdf.contents(page)):
        if not isinstance(item, Word):
            held.append(item)
            continue
        if item == "q":
            kept.append((now, mode))
        elif item == "Q" and kept:
            now, mode = kept.pop()
        elif item == "cm" and len(held) >= 6 and all(isinstance(x, int | float) for x in held[-6:]):
            now = _times(tuple(held[-6:]), now)
        elif item == "Tr" and held:
            mode = held[-1]
        elif item == "Do" and held and isinstance(held[-1], Name):
            image = _image(pdf, pdf.of(objects.get(held[-1])), now)
            if image is None:
                return None
            out.append(image)
        elif item in _OTHER_MARKS or (item in ("Tj", "TJ", "'", '"') and mode != _INVISIBLE):
            return None
        held = []
    return out or None


def draw(pdf: Pdf, page: dict, images: list[Placed], dpi: int) -> np.ndarray:
    """The page as gray or blue, green, red at so many dots to the inch, each the nearest pixel of the last image there."""
    left, low, right, top = pdf.box(page)
    width, height = (max(1, round(n * dpi / 72)) for n in (right - left, top - low))
    coloured = any(i.channels == 3 for i in images)
    out = np.full((height, width, 3) if coloured else (height, width), 255, dtype=np.uint8)
    x, y = left + (np.arange(width) + 0.5) * 72 / dpi, top - (np.arange(height) + 0.5) * 72 / dpi
    for image in images:
        x0, y0, x1, y1 = image.box
        across, down = (x - x0) / (x1 - x0), 1 - (y - y0) / (y1 - y0)
        columns, rows = (np.flatnonzero((at >= 0) & (at < 1)) for at in (across, down))
        pixels = image.pixels(pdf)
        found = pixels[(down[rows] * pixels.shape[0]).astype(int)][:, (across[columns] * pixels.shape[1]).astype(int)]
        out[np.ix_(rows, columns)] = found[:, :, None] if coloured and found.ndim == 2 else found
    return out
