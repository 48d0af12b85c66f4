"""Which version of an object counts: cross-reference tables, streams, updates, and files where they are damaged."""

import base64
import zlib

import pytest

from gridleaf.sources import filters
from gridleaf.sources.documents import BadDocument, SimplePdf
from gridleaf.sources.pdf import Pdf


class File:
    """A PDF file that is written update by update."""

    def __init__(self):
        self.out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
        self.prev = None

    def _objects(self, objects):
        at = {}
        for number, body in objects.items():
            at[number] = len(self.out)
            self.out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        return at

    def table(self, objects, free=(), extra=b""):
        rows = {n: b"%010d 00000 n \n" % a for n, a in self._objects(objects).items()} | {n: b"0000000000 00001 f \n" for n in free}
        start = len(self.out)
        self.out += b"xref\n" + b"".join(b"%d 1\n%s" % (n, r) for n, r in sorted(rows.items()))
        self.out += b"trailer << /Size 99 /Root 1 0 R %s %s>>\nstartxref\n%d\n%%%%EOF\n" % (extra, b"/Prev %d " % self.prev if self.prev else b"", start)
        self.prev = start
        return self

    def stream(self, objects, packed=(), number=50, predictor=False, hidden=False):
        """A cross-reference stream; ``packed`` objects go into an object stream."""
        at = self._objects(objects)
        rows = {n: (1, a, 0) for n, a in at.items()}
        if packed:
            bodies, head, place = b"", [], 0
            for n, body in packed.items():
                head.append(b"%d %d" % (n, len(bodies)))
                rows[n] = (2, number + 1, place)
                bodies, place = bodies + body + b" ", place + 1
            text = b" ".join(head) + b" "
            data = zlib.compress(text + bodies)
            rows[number + 1] = (1, len(self.out), 0)
            self.out += b"%d 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (number + 1, len(head), len(text), len(data), data)
        start = len(self.out)
        rows[number] = (1, start, 0)
        lines = [bytes([k]) + a.to_bytes(4) + bytes([b]) for _, (k, a, b) in sorted(rows.items())]
        if predictor:
            lines = [b"\x02" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)) for line, above in zip(lines, [bytes(6), *lines], strict=False)]
        data = zlib.compress(b"".join(lines))
        index = b" ".join(b"%d 1" % n for n in sorted(rows))
        parameters = b"/DecodeParms << /Predictor 12 /Columns 6 >>" if predictor else b""
        self.out += b"%d 0 obj << /Type /XRef /W [1 4 1] /Index [%s] /Size 99 /Root 1 0 R %s /Filter /FlateDecode %s /Length %d >> stream\n%s\nendstream endobj\n" % (number, index, b"/Prev %d" % self.prev if self.prev else b"", parameters, len(data), data)
        if not hidden:
            self.out += b"startxref\n%d\n%%%%EOF\n" % start
            self.prev = start
        return start


def page(text, parent=2):
    return b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (parent, text)


def words(text):
    return b"<< /Length %d >> stream\nBT (%s) Tj ET\nendstream" % (len(text) + 11, text)


def tree(*kids):
    return b"<< /Type /Pages /MediaBox [0 0 100 200] /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))


ROOT = b"<< /Type /Catalog /Pages 2 0 R >>"
BASE = {1: ROOT, 2: tree(3, 5), 3: page(4), 4: words(b"one"), 5: page(6), 6: words(b"two")}


def texts(content):
    return [p.text for p in SimplePdf()(content)]


def test_plain_file_and_its_updates():
    file = File().table(BASE)
    assert texts(file.out) == ["one", "two"] and Pdf(file.out).index is not None
    file.table({4: words(b"changed")})
    assert texts(file.out) == ["changed", "two"]
    file.table({2: tree(5, 7, 3), 7: page(8), 8: words(b"new")})
    assert texts(file.out) == ["two", "new", "changed"]


def test_deleted_page_stays_away():
    file = File().table(BASE)
    file.table({2: tree(3)}, free=(5, 6))
    assert texts(file.out) == ["one"]
    kept = File().table(BASE)
    kept.table({2: tree(3)})  # not freed, but no tree holds it
    assert texts(kept.out) == ["one"]
    freed = File().table(BASE)
    freed.table({}, free=(5,))  # still a kid, but of nothing
    assert texts(freed.out) == ["one"]


@pytest.mark.parametrize("predictor", [False, True])
def test_packed_and_plain_versions_go_by_revision(predictor):
    first = {n: b for n, b in BASE.items() if n in (4, 6)}
    packed = {n: b for n, b in BASE.items() if n not in first}
    file = File()
    file.stream(first, packed, predictor=predictor)
    assert texts(file.out) == ["one", "two"]
    file.stream({2: tree(5)}, number=60, predictor=predictor)  # plain after packed
    assert texts(file.out) == ["two"]
    file.stream({}, {2: tree(5, 3, 5)}, number=70, predictor=predictor)  # packed after plain
    assert texts(file.out) == ["two", "one"]
    broken = file.out.replace(b"startxref", b"startxxxx")  # found by scanning: the last definition counts as well
    assert Pdf(broken).index is None and texts(broken) == ["two", "one"]


def test_hybrid_file():
    file = File()
    plain = {n: b for n, b in BASE.items() if n != 3}
    beside = file.stream({}, {3: BASE[3]}, hidden=True)
    file.table(plain, free=(3,), extra=b"/XRefStm %d" % beside)
    assert texts(file.out) == ["one", "two"]
    file.table({}, free=(3,))
    assert texts(file.out) == ["two"]


def test_bytes_before_the_head_and_length_by_reference():
    file = File().table(BASE | {4: b"<< /Length 9 0 R >> stream\nBT (endstream in) Tj ET\nendstream", 9: b"23"})
    assert texts(file.out) == ["endstream in", "two"]
    assert texts(b"mail header\r\n\r\n" + file.out) == ["endstream in", "two"]


@pytest.mark.parametrize("harm", ["offset", "circle", "cut", "no root", "number"])
def test_damaged_sections_fall_back_to_scanning(harm):
    file = File().table(BASE)
    out = file.out
    if harm == "offset":
        out = out.replace(b"00000 n", b"00007 n").replace(b"0000000015", b"0000000016")
    elif harm == "circle":
        file.table({})
        out = file.out.replace(b"/Prev %d " % (out.rindex(b"xref\n", 0, out.index(b"trailer"))), b"/Prev %d " % file.prev)
    elif harm == "cut":
        out = out[: out.index(b"trailer") - 30]
    elif harm == "no root":
        out = out.replace(b"/Root 1 0 R", b"/Roof 1 0 R")
    else:
        out = out.replace(b"startxref\n", b"startxref\n9")
    assert Pdf(out).index is None and texts(out) == ["one", "two"]


def test_encrypted_files_are_refused():
    with pytest.raises(BadDocument):
        SimplePdf()(File().table(BASE, extra=b"/Encrypt 9 0 R").out)


def test_filters():
    data = bytes(range(256)) * 3 + b"-----A---B" * 40
    assert filters.unpacked("ASCII85Decode", base64.a85encode(data) + b"~>", {}) == data
    assert filters.unpacked("ASCIIHexDecode", data.hex().encode() + b">", {}) == data
    assert filters.unpacked("RunLengthDecode", b"\x02abc\xfed\x00e\x80rest", {}) == b"abcddde"
    assert filters.unpacked("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), {}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    for early in (0, 1):
        assert filters.lzw(lzw_encoded(data * 30, early), early) == data * 30
    with pytest.raises(filters.Unreadable):
        filters.unpacked("JBIG2Decode", b"", {})


def lzw_encoded(data, early):
    out, table, width, code = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, 258
    held = b""
    for byte in data:
        now = held + bytes([byte])
        if now in table:
            held = now
            continue
        out.append((table[held], width))
        table[now], code = code, code + 1
        held = now[-1:]
        if code + early > 1 << width:
            width += 1
        if code + early >= 4095:
            out.append((256, min(width, 12)))
            table, width, code = {bytes([i]): i for i in range(256)}, 9, 258
    out += [(table[held], min(width, 12)), (257, min(width, 12))]
    bits = "".join(format(c, f"0{w}b") for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


def filled_file(kind):
    file = File()
    resources = BASE | {3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 6 0 R] /Resources << /Font << /F1 9 0 R /Own0 9 0 R >> >> >>", 9: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>"}
    return file.table(resources).out if kind == "table" else (file.stream({4: BASE[4], 6: BASE[6]}, {n: b for n, b in resources.items() if n not in (4, 6)}), file.out)[1]


@pytest.mark.parametrize("before", [b"", b"junk before\n"])
@pytest.mark.parametrize("kind", ["table", "stream"])
def test_text_is_appended_as_an_update(kind, before):
    from gridleaf.sources.pdf_update import Entry, write_text

    old = before + filled_file(kind)
    assert write_text(old, []) == old
    new = write_text(old, [Entry(0, 10, 20, 50, 12, "1 000,50 (net) \\"), Entry(0, 10, 40, 50, 12, "Акт № 7 漢"), Entry(1, 0, 0, 9, 9, "é")])
    assert new.startswith(old) and Pdf(new).index is not None
    assert texts(new) == ["one\ntwo\n1 000,50 (net) \\\nАкт № 7 漢", "two\né"]
    again = write_text(new, [Entry(1, 5, 5, 40, 10, "second update")])
    assert again.startswith(new) and texts(again) == [texts(new)[0], "two\né\nsecond update"]
    assert texts(again[: len(old)]) == ["one\ntwo", "two"]
    broken = again.replace(b"startxref", b"startxxxx")  # the last versions are found by scanning as well
    assert texts(broken) == texts(again) or kind == "stream"
    with pytest.raises(filters.Unreadable):
        write_text(old, [Entry(7, 0, 0, 9, 9, "no such page")])
    with pytest.raises(filters.Unreadable):
        write_text(broken, [Entry(0, 0, 0, 9, 9, "no index")])


def test_entries_of_acts_are_written(spark):
    from gridleaf.plans import acts

    good = filled_file("table")
    documents = spark.createDataFrame([("a", good), ("b", good), ("c", b"%PDF nothing"), ("d", None), ("e", good)], "process_id string, pdf binary")
    box = lambda y: (10.0, float(y), 200.0, y + 40.0)
    rows = [("a", 0, box(10), "12,50"), ("a", None, box(90), "13,00"), ("a", 1, box(10), "Итого"), ("a", 0, None, "no room"), ("a", 0, box(10), None), ("c", 0, box(0), "x"), ("e", 5, box(0), "x"), ("nobody", 0, box(0), "x")]
    filled = spark.createDataFrame(rows, "process_id string, page_num int, target struct<x_min: double, y_min: double, x_max: double, y_max: double>, text string")
    found = {r["process_id"]: r for r in acts.write_entries(documents, filled).collect()}
    assert set(found) == set("abcde")
    assert sorted(texts(bytes(found["a"]["pdf"]))[0].split("\n")) == ["12,50", "13,00", "one", "two"] and texts(bytes(found["a"]["pdf"]))[1] == "two\nИтого"
    assert bytes(found["b"]["pdf"]) == good and found["b"]["error"] is None and found["d"]["pdf"] is None
    assert found["c"]["error"] and bytes(found["c"]["pdf"]) == b"%PDF nothing" and "page" in found["e"]["error"] and bytes(found["e"]["pdf"]) == good
