"""Structure, sizes and text of PDF files: values, versions of objects, object streams, fonts with ToUnicode maps.

Objects are found by the cross-reference sections, from the last update back to the first, so that each
has its last version and deleted ones are gone.  In a file whose sections are damaged objects are found by
scanning; then the last definition of a number counts.  Objects packed in object streams (PDF 1.5) are unpacked.
Nothing is drawn here (see ``scans``).  Encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from gridleaf.sources.filters import Unreadable, hexadecimal, unpacked


class Name(str):
    """A name such as /Type, without the slash."""


class Word(str):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    attributes: dict
    raw: bytes = field(repr=False)

    def kinds(self, resolve) -> list[str]:
        """The filters, the outermost first."""
        kinds = resolve(self.attributes.get("Filter")) or []
        return [resolve(k) for k in (kinds if isinstance(kinds, list) else [kinds])]

    def parameters(self, resolve) -> list[dict]:
        """For each filter its parameters."""
        held = resolve(self.attributes.get("DecodeParms")) or {}
        held = [resolve(h) or {} for h in (held if isinstance(held, list) else [held])]
        kinds = self.kinds(resolve)
        return [{k: resolve(v) for k, v in (held[i] if i < len(held) and isinstance(held[i], dict) else {}).items()} for i in range(len(kinds))]

    def before_last(self, resolve) -> tuple[bytes, dict]:
        """Bytes as the last filter takes them, and its parameters."""
        kinds, parameters, out = self.kinds(resolve), self.parameters(resolve), self.raw
        for kind, own in zip(kinds[:-1], parameters[:-1], strict=True):
            out = unpacked(kind, out, own)
        return out, parameters[-1]

    def data(self, resolve, shape: dict | None = None) -> bytes:
        """Bytes without filters; ``shape`` (Columns, Colors, BitsPerComponent) is that of an image, whatever its parameters say."""
        out = self.raw
        for kind, parameters in zip(self.kinds(resolve), self.parameters(resolve), strict=True):
            out = unpacked(kind, out, parameters | (shape or {}))
        return out


_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_PLAIN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![A-Za-z])")
_STRING_PART = re.compile(rb"[^\\()]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_END = object()


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = [], 1
    while found := _STRING_PART.match(data, at):
        part, at = found[0], found.end()
        if part == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
        depth += part == b"("
        if part[:1] == b"\\":
            rest = part[1:]
            part = bytes([int(rest, 8) & 255]) if rest[:1].isdigit() and rest[:1] < b"8" else _ESCAPES.get(rest, rest)
        out.append(part)
    raise Unreadable("a string without an end")


def value(data: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """The value or keyword at a place, and where it ends; ``_END`` after the last one."""
    if depth > 60:
        raise Unreadable("nested too deep")
    at = _BLANK.match(data, at).end()
    lead = data[at : at + 1]
    if not lead:
        return _END, at
    if found := _REF.match(data, at):
        return Ref(int(found[1])), found.end()
    if data[at : at + 2] == b"<<":
        held, at = _sequence(data, at + 2, b">>", depth)
        return {str(k): v for k, v in zip(held[::2], held[1::2], strict=False)}, at
    if lead == b"[":
        return _sequence(data, at + 1, b"]", depth)
    if lead == b"(":
        return _string(data, at + 1)
    if lead == b"<":
        end = data.find(b">", at)
        if end < 0:
            raise Unreadable("a string without an end")
        return hexadecimal(data[at + 1 : end]), end + 1
    if lead == b"/":
        found = _PLAIN.match(data, at + 1)
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), found[0]) if found else b""
        return Name(raw.decode("latin-1")), found.end() if found else at + 1
    found = _PLAIN.match(data, at)
    if not found:
        return Word(lead.decode("latin-1")), at + 1
    text = found[0].decode("latin-1")
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text), found.end()
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", text):
        return float(text), found.end()
    return {"true": True, "false": False, "null": None}.get(text, Word(text)), found.end()


def _sequence(data: bytes, at: int, end: bytes, depth: int) -> tuple[list, int]:
    out = []
    while True:
        at = _BLANK.match(data, at).end()
        if data.startswith(end, at):
            return out, at + len(end)
        item, at = value(data, at, depth + 1)
        if item is _END:
            raise Unreadable("a list without an end")
        out.append(item)


def values(data: bytes) -> Iterator[object]:
    at = 0
    while True:
        item, at = value(data, at)
        if item is _END:
            return
        yield item


class Cmap:
    """Codes of a font to text, as its ToUnicode stream says."""

    def __init__(self, data: bytes):
        self.text: dict[tuple[int, int], str] = {}
        self.ranges: dict[int, list[tuple[int, int, str]]] = {}
        self.widths: set[int] = set()
        held: list = []
        for item in values(data):
            if not isinstance(item, Word):
                held.append(item)
                continue
            strings = [x for x in held if isinstance(x, bytes | list)]
            if item == "endcodespacerange":
                self.widths |= {len(x) for x in strings}
            elif item == "endbfchar":
                for code, text in zip(strings[::2], strings[1::2], strict=False):
                    self._put(code, text)
            elif item == "endbfrange":
                for low, high, text in zip(strings[::3], strings[1::3], strings[2::3], strict=False):
                    first, last = int.from_bytes(low), int.from_bytes(high)
                    self.widths.add(len(low))
                    if isinstance(text, list):
                        for i, one in enumerate(text[: last - first + 1]):
                            self.text[len(low), first + i] = one.decode("utf-16-be", "replace")
                    else:
                        self.ranges.setdefault(len(low), []).append((first, last, text.decode("utf-16-be", "replace")))
            held = []

    def _put(self, code: bytes, text: bytes) -> None:
        self.widths.add(len(code))
        self.text[len(code), int.from_bytes(code)] = text.decode("utf-16-be", "replace")

    def _one(self, width: int, code: int) -> str | None:
        if (width, code) in self.text:
            return self.text[width, code]
        for first, last, text in self.ranges.get(width, ()):
            if first <= code <= last and text:
                return text[:-1] + chr(ord(text[-1]) + code - first)
        return None

    def decode(self, raw: bytes) -> str:
        out, at, widths = [], 0, sorted(self.widths) or [1]
        while at < len(raw):
            for width in widths:
                found = self._one(width, int.from_bytes(raw[at : at + width]))
                if found is not None:
                    break
            else:
                found, width = "�", widths[0]
            out.append(found)
            at += width
        return "".join(out)


_OBJECT = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj(?![A-Za-z])")
_STREAM = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)")
_END_STREAM = re.compile(rb"[\r\n ]*endstream")


def object_at(content: bytes, at: int, resolve: Callable[[object], object]) -> object:
    """The value or stream that stands after ``n g obj``."""
    item, at = value(content, at)
    start = _STREAM.match(content, at)
    if not start or not isinstance(item, dict):
        return item
    size = resolve(item.get("Length"))
    end = start.end() + size if isinstance(size, int) else -1
    if end < 0 or not _END_STREAM.match(content, end):
        end = content.find(b"endstream", start.end())
        end = len(content) if end < 0 else end
    return Stream(item, content[start.end() : end])


@dataclass(frozen=True)
class Entry:
    """Where a version of an object is: at an offset, or in an object stream at a place; nowhere if it is free."""

    offset: int | None = None
    stream: int | None = None
    place: int = 0
    generation: int = 0


class Index:
    """The cross-reference sections of a file from the last one back: of each object the newest entry counts.

    Sections are tables, streams, or tables with a stream beside them (hybrid files).  Any damage is an error; then the file can
    still be scanned.
    """

    def __init__(self, content: bytes):
        self.content, self.base = content, max(0, content.find(b"%PDF-"))
        self.entries: dict[int, Entry] = {}
        self.trailer: dict = {}
        last = None
        for last in re.finditer(rb"startxref[\0\t\n\f\r ]+(\d+)", content):
            pass
        if last is None:
            raise Unreadable("no startxref")
        #: The place of the last section, and whether it is a table.
        self.last = next_one = int(last[1])
        self.table = content.startswith(b"xref", _BLANK.match(content, self.base + next_one).end())
        seen: set[int] = set()
        while next_one is not None:
            if next_one in seen:
                raise Unreadable("sections in a circle")
            seen.add(next_one)
            entries, trailer = self._section(next_one)
            beside = trailer.get("XRefStm")
            if isinstance(beside, int):  # what it holds is free in the table
                entries = entries | {n: e for n, e in self._section(beside)[0].items() if entries.get(n, Entry()) == Entry()}
            self.entries = entries | self.entries
            self.trailer = trailer | self.trailer
            next_one = trailer.get("Prev")
            if not isinstance(next_one, int | None):
                raise Unreadable("no place of a section")
        for number, entry in self.entries.items():
            if entry.offset is not None:
                found = _OBJECT.match(content, self.base + entry.offset)
                if not found or int(found[1]) != number:
                    raise Unreadable(f"object {number} is not where it should be")

    def _section(self, at: int) -> tuple[dict[int, Entry], dict]:
        at = _BLANK.match(self.content, self.base + at).end()
        if self.content.startswith(b"xref", at):
            return self._table(at + 4)
        found = _OBJECT.match(self.content, at)
        stream = object_at(self.content, found.end(), lambda x: x) if found else None
        if not isinstance(stream, Stream) or stream.attributes.get("Type") != "XRef":
            raise Unreadable("no cross-reference section")
        return self._stream(stream), stream.attributes

    def _table(self, at: int) -> tuple[dict[int, Entry], dict]:
        entries: dict[int, Entry] = {}
        head = re.compile(rb"[\0\t\n\f\r ]*(\d+)[ \t]+(\d+)[ \t]*[\r\n]+")
        row = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
        while found := head.match(self.content, at):
            first, n, at = int(found[1]), int(found[2]), found.end()
            for number in range(first, first + n):
                if not (line := row.match(self.content, at)):
                    raise Unreadable("a cut-off cross-reference table")
                entries[number] = Entry(offset=int(line[1]), generation=int(line[2])) if line[3] == b"n" else Entry()
                at = line.end()
        at = _BLANK.match(self.content, at).end()
        trailer = value(self.content, at + 7)[0] if self.content.startswith(b"trailer", at) else None
        if not isinstance(trailer, dict):
            raise Unreadable("no trailer")
        return entries, trailer

    @staticmethod
    def _stream(stream: Stream) -> dict[int, Entry]:
        data, widths = stream.data(lambda x: x), stream.attributes.get("W")
        if not isinstance(widths, list) or len(widths) != 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
            raise Unreadable("no widths of a cross-reference stream")
        spans = stream.attributes.get("Index") or [0, stream.attributes.get("Size")]
        entries, at = {}, 0
        for first, n in zip(spans[::2], spans[1::2], strict=True):
            for number in range(first, first + n):
                fields = []
                for k, width in enumerate(widths):
                    fields.append(int.from_bytes(data[at : at + width]) if width else int(k == 0))
                    at += width
                if at > len(data):
                    raise Unreadable("a cut-off cross-reference stream")
                kind, a, b = fields
                entries[number] = Entry(offset=a, generation=b) if kind == 1 else Entry(stream=a, place=b) if kind == 2 else Entry()
        return entries


class Pdf:
    """The objects of a file, each in its last version, read when they are asked for."""

    def __init__(self, content: bytes):
        self.content = content
        self.objects: dict[int, object] = {}
        self.index: Index | None = None
        self._packed: dict[int, list[tuple[int, object]]] = {}
        #: Numbers of the dictionaries that are objects of their own, by identity.
        self.number_of: dict[int, int] = {}
        try:
            self.index = Index(content)
            if "Encrypt" not in self.index.trailer and not isinstance(self._root(), dict):
                raise Unreadable("no root of the pages")
        except (ValueError, TypeError, zlib.error, RecursionError):  # damaged: objects are found one by one
            self.index = None
            self.objects.clear()
            self._scan(content)
        encrypted = re.search(rb"/Encrypt[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R", content) if self.index is None else "Encrypt" in self.index.trailer
        if encrypted:
            raise Unreadable("encrypted")

    def _scan(self, content: bytes) -> None:
        """All objects by their looks; the last definition of a number counts, packed or not."""
        at_of: dict[int, int] = {}
        packed = []
        for found in re.finditer(rb"(?<!\d)" + _OBJECT.pattern, content):
            try:
                item = object_at(content, found.end(), lambda x: x)
            except Unreadable:
                continue
            if isinstance(item, Stream) and item.attributes.get("Type") == "ObjStm":
                packed.append((found.start(), item))
            self.objects[int(found[1])], at_of[int(found[1])] = item, found.start()
        for at, stream in packed:
            for number, item in self._unpack(stream):
                if at >= at_of.get(number, -1):
                    self.objects[number], at_of[number] = item, at

    def _unpack(self, stream: Stream) -> list[tuple[int, object]]:
        """Numbers and values of an object stream."""
        data = stream.data(self.of)
        first, n = self.of(stream.attributes.get("First")), self.of(stream.attributes.get("N"))
        if not isinstance(first, int) or not isinstance(n, int):
            raise Unreadable("an object stream without a head")
        head = [x for x in values(data[:first]) if isinstance(x, int)]
        return [(number, value(data, first + at)[0]) for number, at in zip(head[: 2 * n : 2], head[1 : 2 * n : 2], strict=False)]

    def _object(self, number: int) -> object:
        if number in self.objects or self.index is None:
            return self.objects.get(number)
        entry, found = self.index.entries.get(number, Entry()), None
        self.objects[number] = None  # what refers to itself is nothing
        if entry.offset is not None:
            start = _OBJECT.match(self.content, self.index.base + entry.offset)
            found = object_at(self.content, start.end(), self.of)
        elif entry.stream is not None:
            if entry.stream not in self._packed:
                stream = self.of(Ref(entry.stream))
                self._packed[entry.stream] = self._unpack(stream) if isinstance(stream, Stream) else []
            held = self._packed[entry.stream]
            found = held[entry.place][1] if entry.place < len(held) and held[entry.place][0] == number else dict(held).get(number)
        self.objects[number] = found
        if isinstance(found, dict):
            self.number_of[id(found)] = number
        return found

    def of(self, item: object) -> object:
        """What a reference stands for."""
        for _ in range(32):
            if not isinstance(item, Ref):
                return item
            item = self._object(item.number)
        return None

    def _root(self) -> object:
        root = self.of(self.index.trailer.get("Root"))
        return self.of(root.get("Pages")) if isinstance(root, dict) else None

    def pages(self) -> list[dict]:
        """Pages in reading order: down the tree from its root.

        In a file without a sound index all trees count, and pages that no tree holds come last.
        """
        if self.index is not None:
            roots, loose = [self._root()], []
        else:
            numbers = {n: o for n, o in self.objects.items() if isinstance(o, dict)}
            roots = [o for o in numbers.values() if o.get("Type") == "Pages" and "Parent" not in o]
            loose = [o for _, o in sorted(numbers.items()) if o.get("Type") == "Page"]
        out: list[dict] = []
        seen: set[int] = set()

        def walk(item: object, depth: int) -> None:
            item = self.of(item)
            if not isinstance(item, dict) or id(item) in seen or depth > 60:
                return
            seen.add(id(item))
            kids = self.of(item.get("Kids"))
            if self.of(item.get("Type")) == "Page" or (kids is None and self.index is not None):
                out.append(item)
            for kid in kids if isinstance(kids, list) else []:
                walk(kid, depth + 1)

        for root in roots:
            walk(root, 0)
        return out + [o for o in loose if id(o) not in seen]

    def inherited(self, page: dict, name: str) -> object:
        for _ in range(64):
            if name in page:
                return self.of(page[name])
            page = self.of(page.get("Parent"))
            if not isinstance(page, dict):
                return None
        return None

    def box(self, page: dict) -> tuple[float, float, float, float]:
        """Left, lower, right and upper edge in points."""
        box = self.inherited(page, "MediaBox")
        box = [self.of(x) for x in box] if isinstance(box, list) else []
        x0, y0, x1, y1 = map(float, box) if len(box) == 4 and all(isinstance(x, int | float) for x in box) else (0.0, 0.0, 612.0, 792.0)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def size(self, page: dict) -> tuple[float, float]:
        x0, y0, x1, y1 = self.box(page)
        return x1 - x0, y1 - y0

    def contents(self, page: dict) -> bytes:
        contents = self.of(page.get("Contents"))
        parts = [self.of(c) for c in (contents if isinstance(contents, list) else [contents])]
        return b"\n".join(p.data(self.of) for p in parts if isinstance(p, Stream))

    def _decoder(self, font: object):
        font = self.of(font)
        to_unicode = self.of(font.get("ToUnicode")) if isinstance(font, dict) else None
        if isinstance(to_unicode, Stream):
            return Cmap(to_unicode.data(self.of)).decode
        if isinstance(font, dict) and font.get("Subtype") == "Type0":
            return lambda raw: "�" * (len(raw) // 2)  # glyph numbers without a map to text
        encoding = "cp1252" if isinstance(font, dict) and self.of(font.get("Encoding")) == "WinAnsiEncoding" else "latin-1"
        return lambda raw: raw.decode(encoding, "replace")

    def text(self, page: dict) -> str:
        """What the page shows, a line for each showing operator."""
        resources = self.inherited(page, "Resources") or {}
        fonts = self.of(resources.get("Font")) or {}
        decoders: dict[str, object] = {}
        decode, out, held = self._decoder(None), [], []
        for item in values(self.contents(page)):
            if not isinstance(item, Word):
                held.append(item)
                continue
            if item == "Tf" and len(held) >= 2 and isinstance(held[-2], Name):
                name = held[-2]
                if name not in decoders:
                    decoders[name] = self._decoder(fonts.get(name))
                decode = decoders[name]
            elif item in ("Tj", "TJ", "'", '"') and held:
                shown = held[-1] if isinstance(held[-1], list) else [held[-1]]
                out.append("".join(decode(x) for x in shown if isinstance(x, bytes)))
            held = []
        return "\n".join(out)
