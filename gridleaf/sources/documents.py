"""Documents, pages and images in, metrics and images out.

A decoder turns the bytes of one document into pages.  ``SimplePdf`` reads structure and
text of PDF files (see ``pdf``) and draws scanned pages, which show images alone (see ``scans``);
``Png`` reads one-page images.  Drawing other PDF pages needs an engine behind the same protocol.
"""

from __future__ import annotations

import struct as bits
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridleaf.functions.entities import strip
from gridleaf.operators.detect import enhance, image_dict, quality
from gridleaf.schema import IMAGE, METRICS, struct
from gridleaf.sources import paths, pdf, scans
from gridleaf.sources.filters import unfilter_rows

DEFAULT_DPI = 300


class BadDocument(ValueError):
    """Bytes that the decoder cannot read."""


@dataclass
class DecodedPage:
    width_pt: float
    height_pt: float
    text: str = ""
    render: Callable[[int], np.ndarray] | None = None


class Decoder(Protocol):
    def __call__(self, content: bytes) -> list[DecodedPage]:
        """The pages of a document; BadDocument if it is none."""


def read_png(content: bytes) -> np.ndarray:
    """An 8-bit, non-interlaced PNG as gray or blue, green, red (alpha dropped)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise BadDocument("not a PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        (size,), kind = bits.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        head = bits.unpack(">IIBBBBB", body) if kind == b"IHDR" and len(body) == 13 else head
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise BadDocument("only 8-bit gray and colour without interlacing")
    width, height, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        pixels = unfilter_rows(zlib.decompress(data), height, width * n, n).reshape(height, width, n)
    except (ValueError, zlib.error) as e:  # fewer or other bytes than the head says
        raise BadDocument(str(e)) from e
    return pixels[:, :, 0].copy() if n < 3 else pixels[:, :, 2::-1].copy()


def write_png(image: np.ndarray) -> bytes:
    """A PNG of a gray or blue, green, red image."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return bits.pack(">I", len(body)) + kind + body + bits.pack(">I", zlib.crc32(kind + body))

    h, w = image.shape[:2]
    rows = (image if image.ndim == 2 else image[:, :, ::-1]).reshape(h, -1)
    head = bits.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    body = zlib.compress(np.insert(rows, 0, 0, axis=1).astype(np.uint8).tobytes(), 6)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


class Png:
    """One page per image, scanned at so many dots to the inch; a page drawn at another resolution takes the nearest pixel."""

    def __init__(self, scanned_at: int = DEFAULT_DPI):
        self.scanned_at = scanned_at

    def __call__(self, content: bytes) -> list[DecodedPage]:
        image, own = read_png(content), self.scanned_at

        def draw(dpi: int) -> np.ndarray:
            if dpi == own:
                return image
            at = [np.minimum((np.arange(max(1, round(n * dpi / own))) * own / dpi).astype(int), n - 1) for n in image.shape[:2]]
            return image[at[0]][:, at[1]]

        return [DecodedPage(image.shape[1] * 72 / own, image.shape[0] * 72 / own, "", draw)]


class SimplePdf:
    """Pages, sizes and text of PDF files, images of scanned pages and of drawings."""

    def __call__(self, content: bytes) -> list[DecodedPage]:
        if b"%PDF" not in content[:1024]:
            raise BadDocument("not a PDF")
        try:
            found = pdf.Pdf(content)
            pages = found.pages()
            if not pages:
                raise BadDocument("no pages")
            return [DecodedPage(*found.size(p), found.text(p), self._render(found, p)) for p in pages]
        except BadDocument:
            raise
        except (ValueError, zlib.error, TypeError, AttributeError, LookupError, OverflowError) as e:  # objects of other kinds than the format has there
            raise BadDocument(str(e)) from e

    @staticmethod
    def _render(found: pdf.Pdf, page: dict) -> Callable[[int], np.ndarray] | None:
        images = scans.placed_images(found, page)
        if images is None and paths.painted_paths(found, page, 72) is None:
            return None

        def draw(dpi: int) -> np.ndarray:
            try:
                return scans.draw(found, page, images, dpi) if images else paths.draw(found, page, paths.painted_paths(found, page, dpi), dpi)
            except (ValueError, zlib.error, ArithmeticError) as e:  # fewer or other bytes than the image says, numbers out of range
                raise BadDocument(str(e)) from e

        return draw


PAGES = f"page_num int, num_pages int, width_pt double, height_pt double, text string, image {IMAGE}, error string"


def scan(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """document(path, content): the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def decode_pages(documents: DataFrame, keys: list[str], decoder: Decoder, dpi: int = DEFAULT_DPI, content: str = "content", draw: bool = True, prepare: bool = False) -> DataFrame:
    """One row per page.  Bytes that cannot be read give one row with ``error``; so no document is lost.

    A page that cannot be drawn keeps its row, without an image; one whose image is broken has ``error`` too.

    ``prepare`` adds the quality measures and makes the image gray and straight.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(documents.schema[c] for c in keys), *struct(PAGES + (f", metrics {METRICS}" if prepare else "")).fields])
    arrow = to_arrow_schema(out)

    def rows_of(row: dict) -> Iterator[dict]:
        key = {c: row[c] for c in keys}
        try:
            pages = decoder(row[content] or b"")
        except (BadDocument, zlib.error) as e:
            yield key | {"error": str(e)}
            return
        for i, page in enumerate(pages):
            made = {}
            try:
                image = page.render(dpi) if draw and page.render else None
            except BadDocument as e:
                image, made["error"] = None, str(e)
            if prepare and image is not None:
                made["metrics"] = quality(image)
                image = enhance(image, made["metrics"])
            yield key | {"page_num": i, "num_pages": len(pages), "width_pt": page.width_pt, "height_pt": page.height_pt, "text": page.text, "image": None if image is None else image_dict(image)} | made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for row in batch.slice(at, 1).to_pylist():
                    for page in rows_of(row):
                        yield pa.RecordBatch.from_pylist([page], schema=arrow)

    return documents.select(*keys, content).mapInArrow(run, out)


def pixel_size(points: Column, dpi: int) -> Column:
    return points * dpi / 72


def has_text_layer(text: Column) -> Column:
    """Whether more than 10 characters are left without the white space at either end."""
    return F.length(strip(F.coalesce(text, F.lit("")))) > 10


def decode_base64(text: Column) -> Column:
    """Bytes, or null if the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def encode_base64(content: Column) -> Column:
    return F.base64(content)


def valid_pdf(text: Column) -> Column:
    """Whether a base64 text holds bytes that start like a PDF."""
    return F.coalesce(F.substring(decode_base64(text), 1, 4) == F.lit(b"%PDF"), F.lit(False))


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def png_column(pages: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """keys and png (binary): page images for a debug sink."""
    from gridleaf.operators.detect import map_pages

    return map_pages(pages, keys, lambda a: [{"png": write_png(a)}], "png binary", image)
