"""Text written into a PDF file as an incremental update: new objects and a new cross-reference section after the old bytes.

The old bytes stay as they are, so every earlier version can still be read.  A page that gets text is written again with its
contents between ``q`` and ``Q``, a stream for the new text, and a font for it: Helvetica for text of Windows Latin, else one whose codes
are UTF-16 with a map to text (what it looks like is up to the reader's fonts).  The new section is a table after a
table and a stream after a stream.  Files without a sound index are refused, as are encrypted ones.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from gridleaf.sources.filters import Unreadable
from gridleaf.sources.pdf import Name, Pdf, Ref, Stream, Word

_CMAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Adobe-Identity-UCS def /CMapType 2 def
1 begincodespacerange <0000> <FFFF> endcodespacerange
%s
endcmap CMapName currentdict /CMap defineresource pop end end"""


@dataclass(frozen=True)
class Entry:
    """Text in a box (points from the lower left corner) of a page."""

    page: int
    x: float
    y: float
    width: float
    height: float
    text: str

    def size(self) -> float:
        """Of the font: seven tenths of the height, less if the text would be wider than its box, four points at least."""
        return max(4.0, min(0.7 * self.height, self.width / max(1.0, 0.55 * len(self.text))))


def dump(item: object, pdf: Pdf) -> bytes:
    """A value as it is written."""
    if isinstance(item, bool):
        return b"true" if item else b"false"
    if item is None:
        return b"null"
    if isinstance(item, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#/()<>[]{}%" else b"#%02X" % c for c in item.encode("latin-1"))
    if isinstance(item, Word):
        return item.encode("latin-1")
    if isinstance(item, int):
        return b"%d" % item
    if isinstance(item, float):
        if not math.isfinite(item):
            raise Unreadable("a number that is none")
        return f"{item:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(item, bytes):
        return b"<" + item.hex().encode() + b">"
    if isinstance(item, Ref):
        entry = pdf.index.entries.get(item.number)
        return b"%d %d R" % (item.number, entry.generation if entry else 0)
    if isinstance(item, list):
        return b"[" + b" ".join(dump(x, pdf) for x in item) + b"]"
    if isinstance(item, dict):
        return b"<< " + b" ".join(dump(Name(k), pdf) + b" " + dump(v, pdf) for k, v in item.items()) + b" >>"
    raise Unreadable(f"a value of no kind: {type(item).__name__}")


class Update:
    """New versions of objects, and new objects, after a file."""

    def __init__(self, content: bytes):
        self.pdf = Pdf(content)
        if self.pdf.index is None:
            raise Unreadable("no sound index to add to")
        known = [*self.pdf.index.entries, *[n - 1 for n in [self.pdf.index.trailer.get("Size")] if isinstance(n, int)]]
        self.free = max(known, default=0) + 1
        self.objects: dict[int, bytes] = {}
        self.fonts: dict[bool, Ref] = {}

    def add(self, body: bytes, number: int | None = None) -> Ref:
        if number is None:
            number, self.free = self.free, self.free + 1
        self.objects[number] = body
        return Ref(number)

    def stream(self, data: bytes, attributes: bytes = b"") -> Ref:
        packed = zlib.compress(data)
        return self.add(b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (attributes, len(packed), packed))

    def font(self, latin: bool) -> Ref:
        if latin not in self.fonts:
            if latin:
                self.fonts[latin] = self.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
            else:
                spans = [b"%d beginbfrange\n%s\nendbfrange" % (64, b"\n".join(b"<%02X00> <%02XFF> <%02X00>" % (h, h, h) for h in range(at, at + 64))) for at in range(0, 256, 64)]
                to_unicode = self.stream(_CMAP % b"\n".join(spans))
                below = self.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 550 >>")
                self.fonts[latin] = self.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below.number, to_unicode.number))
        return self.fonts[latin]

    def write(self, number: int, page: dict, entries: list[Entry]) -> None:
        """``page`` with the text of ``entries``."""
        pdf = self.pdf
        resources = dict(pdf.inherited(page, "Resources") or {})
        fonts = dict(pdf.of(resources.get("Font")) or {})
        names: dict[bool, str] = {}
        shown = [b"Q"]
        for e in entries:
            try:
                raw, latin = e.text.encode("cp1252"), True
            except UnicodeEncodeError:
                raw, latin = e.text.encode("utf-16-be"), False
            if latin not in names:
                names[latin] = next(n for i in range(len(fonts) + 1) if (n := f"Own{i}") not in fonts)
                fonts[names[latin]] = self.font(latin)
            size = e.size()
            shown.append(b"BT /%s %.2f Tf 0 g 1 0 0 1 %.2f %.2f Tm <%s> Tj ET" % (names[latin].encode(), size, e.x, e.y + (e.height - 0.7 * size) / 2, raw.hex().encode()))
        held = page.get("Contents")
        old = pdf.of(held)
        old = old if isinstance(old, list) else [held] if isinstance(old, Stream) else []
        changed = page | {"Resources": resources | {"Font": fonts}, "Contents": [self.stream(b"q"), *old, self.stream(b"\n".join(shown))]}
        self.add(dump(changed, pdf), number)

    def bytes(self) -> bytes:
        """The old bytes, and after them what is new."""
        pdf, index = self.pdf, self.pdf.index
        out = pdf.content if pdf.content.endswith((b"\n", b"\r")) else pdf.content + b"\n"
        places = {}
        for number, body in sorted(self.objects.items()):
            entry = index.entries.get(number)
            generation = entry.generation if entry and entry.offset is not None else 0
            places[number] = (len(out) - index.base, generation)
            out += b"%d %d obj\n%s\nendobj\n" % (number, generation, body)
        start = len(out) - index.base
        trailer = {k: v for k, v in index.trailer.items() if k in ("Root", "Info", "ID")} | {"Prev": index.last}
        if index.table:
            rows = b"".join(b"%d 1\n%010d %05d n \n" % (n, at, generation) for n, (at, generation) in sorted(places.items()))
            out += b"xref\n" + rows + b"trailer\n" + dump(trailer | {"Size": self.free}, pdf)
        else:
            own, size = self.free, self.free + 1
            places[own] = (start, 0)
            rows = b"".join(b"\x01" + at.to_bytes(8) + generation.to_bytes(2) for _, (at, generation) in sorted(places.items()))
            attributes = trailer | {"Type": Name("XRef"), "Size": size, "W": [1, 8, 2], "Index": [x for n in sorted(places) for x in (n, 1)], "Length": len(rows)}
            out += b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj" % (own, dump(attributes, pdf), rows)
        return out + b"\nstartxref\n%d\n%%%%EOF\n" % start


def write_text(content: bytes, entries: list[Entry]) -> bytes:
    """``content`` with text on its pages, as an incremental update; the same bytes if there is none."""
    if not entries:
        return content
    update = Update(content)
    pages = update.pdf.pages()
    for number in sorted({e.page for e in entries}):
        if not 0 <= number < len(pages):
            raise Unreadable(f"no page {number}")
        page = pages[number]
        if id(page) not in update.pdf.number_of:
            raise Unreadable("a page that is no object of its own")
        update.write(update.pdf.number_of[id(page)], page, [e for e in entries if e.page == number])
    return update.bytes()
