"""Documents in, images out, words, acts, store and streams."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridleaf.config import OcrSettings
from gridleaf.operators import detect, ocr
from gridleaf.plans import acts
from gridleaf.plans.store import ProcessStore
from gridleaf.sources import documents as d
from gridleaf.streaming import ingest


def pdf(pages, deflate=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595 842] >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, text in enumerate(pages):
        stream = b"BT /F1 12 Tf (%s) Tj ET" % text.encode()
        body = zlib.compress(stream) if deflate else stream
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if deflate else b"", body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf_pages(spark, tmp_path, deflate):
    (tmp_path / "a.pdf").write_bytes(pdf(["A text layer of some length", "short"], deflate))
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "c.txt").write_bytes(b"not looked at")
    pages = d.decode_pages(d.scan(spark, str(tmp_path)), ["path"], d.SimplePdf()).withColumn("has", d.has_text_layer(F.col("text"))).orderBy("path", "page_num").collect()
    assert [(r["page_num"], r["num_pages"], r["width_pt"], r["has"], r["error"] is None) for r in pages] == [(0, 2, 595, True, True), (1, 2, 595, False, True), (None, None, None, False, False)]


@pytest.mark.parametrize("shape", [(13, 7), (13, 7, 3)])
def test_png_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (d.read_png(d.write_png(image)) == image).all()
    with pytest.raises(d.BadDocument):
        d.read_png(b"GIF89a")


def test_png_filters():
    import struct

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    raw = bytearray()
    for y in range(6):
        kind, row, up = y % 5, image[y].astype(int), image[y - 1].astype(int) if y else np.zeros(5, int)
        left, corner = np.r_[0, row[:-1]], np.r_[0, up[:-1]]
        paeth = [min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2] for a, b, c in zip(left, up, corner, strict=True) for p in [a + b - c]]
        guess = [np.zeros(5, int), left, up, (left + up) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + bytes(((row - guess) % 256).tolist())
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert (d.read_png(png) == image).all()


def test_scan_prepare_and_sinks(spark, tmp_path):
    page = np.full((120, 160), 230, dtype=np.uint8)
    page[40:44, 20:140] = 10
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.png").write_bytes(d.write_png(page))
    pages = d.decode_pages(d.scan(spark, str(tmp_path / "in"), "*.png"), ["path"], d.Png(), prepare=True)
    row = pages.first()
    assert row["image"]["channels"] == 1 and row["metrics"]["has_skew"] is False
    metrics = pages.select("path", "metrics.*")
    d.write_metrics_csv(metrics, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    assert (d.read_png(bytes(d.png_column(pages, ["path"]).first()["png"])) == page).all()


def test_base64_and_validation(spark):
    rows = spark.createDataFrame([("JVBERi0xLjc=",), ("UERG",), ("%%%",), (None,)], "t string").select(d.valid_pdf(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, False, False]


def test_words_keep_order_and_stop_at_the_shortest():
    assert ocr.from_arrays({"rec_texts": ["hello"], "rec_scores": [0.9], "rec_boxes": [[1, 2, 3, 4]]}) == [ocr.Word("hello", 0.9, (1, 2, 3, 4))]
    assert ocr.from_arrays({"rec_texts": np.array(["a", "b"]), "rec_scores": np.array([0.5]), "rec_boxes": np.array([[1, 2, 3, 4], [5, 6, 7, 8]])}) == [ocr.Word("a", 0.5, (1, 2, 3, 4))]
    assert ocr.from_arrays({}) == []
    engine = ocr.FixedEngine({(2, 2): [ocr.Word("x", 1.0, (0, 0, 1, 1))]})
    assert [len(w) for w in engine.predict([np.zeros((2, 2)), np.zeros((3, 3))])] == [1, 0]
    assert len(next(engine.predict(np.zeros((2, 2))))) == 1


def test_missing_models(tmp_path):
    with pytest.raises(FileNotFoundError, match="det"):
        ocr.check_models(OcrSettings(text_detection_model_dir=str(tmp_path / "det"), text_recognition_model_dir=str(tmp_path / "rec")))
    (tmp_path / "det").mkdir()
    with pytest.raises(FileNotFoundError, match="rec"):
        ocr.check_models(OcrSettings(text_detection_model_dir=str(tmp_path / "det"), text_recognition_model_dir=str(tmp_path / "rec")))


def test_act_totals(spark):
    rows = spark.createDataFrame([(1, "debit", 10000.50), (1, "credit", 5000.25), (2, "debit", 1.0)], "process_id int, side string, value double")
    found = {r["process_id"]: (r["total_debit"], r["total_credit"], r["balance"]) for r in acts.totals(rows, ["process_id"]).collect()}
    assert found == {1: (10000.50, 5000.25, 5000.25), 2: (1.0, 0.0, 1.0)}


def test_submit(spark):
    rows = acts.submit(spark.createDataFrame([("JVBERi0xLjc=",), ("nothing",)], "document string")).collect()
    assert [r["accepted"] for r in rows] == [True, False] and bytes(rows[0]["pdf"])[:4] == b"%PDF" and rows[1]["pdf"] is None


def test_each_request_has_one_answer(spark, tmp_path):
    """Requests alike in all columns, and requests without an id, are each stored and answered for themselves."""
    good, bad = "JVBERi0xLjc=", "R0lGOA=="
    asked = [(1, good), (1, good), (1, bad), (None, good), (None, good), (None, bad), (2, None)]
    store = ProcessStore(spark, str(tmp_path / "s"))
    requests = spark.createDataFrame(asked, "doc_id long, document string").repartition(3)
    given = acts.submit_all(requests, store, lambda r: r.withColumn("structure", F.concat(F.lit("act "), F.coalesce("doc_id", F.lit(-1)))))
    assert given.columns == ["doc_id", "accepted", "process_id"]
    rows = given.collect()
    assert sorted(str((r["doc_id"], r["accepted"])) for r in rows) == sorted(str((k, c == good)) for k, c in asked)
    ids = [r["process_id"] for r in rows if r["accepted"]]
    assert len(set(ids)) == len(ids) == 4 and all(r["process_id"] is None for r in rows if not r["accepted"])
    back = {r["process_id"]: (bytes(r["pdf"])[:4], r["structure"]) for r in store.get(given.where("accepted").select("process_id")).collect()}
    assert back == {r["process_id"]: (b"%PDF", f"act {-1 if r['doc_id'] is None else 1}") for r in rows if r["accepted"]}
    assert store.events().count() == 4 and sorted(r["process_id"] or "" for r in given.collect()) == sorted(r["process_id"] or "" for r in rows)
    assert acts.submit_all(requests.limit(0), store, lambda r: r.withColumn("structure", F.lit(""))).count() == 0


def test_store(spark, tmp_path):
    store = ProcessStore(spark, str(tmp_path / "s"), ttl_seconds=10)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    nobody = spark.createDataFrame([("nobody",)], "process_id string")
    assert store.get(nobody).first()["pdf"] is None
    created = store.create(spark.createDataFrame([(bytearray(b"%PDF"), "{}")], "pdf binary, structure string"), at(0))
    ids = created.select("process_id")
    assert len(ids.first()[0]) == 36
    assert bytes(store.get(ids, at(9)).first()["pdf"]) == b"%PDF"
    assert store.get(ids, at(10)).first()["pdf"] is None
    again = ProcessStore(spark, str(tmp_path / "s"), ttl_seconds=10)
    assert again.get(ids, at(5)).first()["structure"] == "{}"
    compact = again.compact(str(tmp_path / "t"), at(5))
    assert compact.events().count() == 1
    store.delete(ids, at(6))
    store.delete(nobody, at(6))
    assert store.get(ids, at(7)).first()["pdf"] is None
    assert again.compact(str(tmp_path / "u"), at(7)).events().count() == 0


def test_lookup_reads_its_buckets_and_shuffles_no_document(spark, tmp_path):
    from gridleaf.plans.store import BUCKETS, bucket_of

    store = ProcessStore(spark, str(tmp_path / "s"), ttl_seconds=100)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    rows = spark.range(300).select(F.concat(F.lit("p"), "id").alias("process_id"), F.encode(F.concat(F.lit("%PDF "), "id"), "utf-8").alias("pdf"), F.col("id").cast("string").alias("structure"))
    store.put(rows, at(0))
    one = spark.createDataFrame([("p7",), ("p7",), ("nobody",)], "process_id string")
    found = store.get(one, at(1))
    assert sorted((r["process_id"], r["structure"], r["pdf"] and bytes(r["pdf"])) for r in found.collect() if r["pdf"]) == [("p7", "7", b"%PDF 7")] * 2 and found.count() == 3
    assert found.where("pdf is null").first()["process_id"] == "nobody"
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "pdf#" in line and "FileScan" in line]
    assert scans and all("PartitionFilters: [bucket" in line or "PartitionFilters: [isnotnull(bucket" in line for line in scans)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    # Put and deleted at one instant is deleted; a later put of the same id is there again; two puts of one instant give one row.
    store.delete(one, at(0))
    assert store.get(one, at(1)).where("pdf is not null").count() == 0
    store.put(rows.where("process_id = 'p7'").unionByName(rows.where("process_id = 'p7'")), at(5))
    assert store.get(one.distinct(), at(6)).where("pdf is not null").count() == 1
    assert store.get(one.limit(0), at(6)).count() == 0
    # Bit by bit: some buckets now, the others later; a bucket that becomes empty goes.
    half = list(range(BUCKETS // 2))
    small = store.compact(str(tmp_path / "t"), at(6), half)
    inside = rows.where(bucket_of(F.col("process_id")) < BUCKETS // 2).count()
    assert small.events().count() == inside
    whole = store.compact(str(tmp_path / "t"), at(6), list(range(BUCKETS // 2, BUCKETS)))
    assert whole.events().count() == 300 and whole.get(one, at(6)).where("pdf is not null").count() == 2
    store.delete(rows.where(bucket_of(F.col("process_id")) < 3), at(7))
    gone = rows.where(bucket_of(F.col("process_id")) < 3).count()
    assert store.compact(str(tmp_path / "t"), at(8), [0, 1, 2]).events().count() == 300 - gone


def test_streams(spark, sf, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(source))
    stream = ingest.process_stream(spark, str(source), events.schema, "event_id", "ts", 3600)
    out = str(tmp_path / "out")
    q = ingest.ingest(stream, lambda batch: batch.write.mode("append").parquet(out), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    stored = spark.read.parquet(out)
    assert stored.count() == events.count() and stored.where("expires_at <= ts").count() == 0
    windows = ingest.activity(spark.readStream.schema(events.schema).parquet(str(source)), "ts", "event_type")
    q = windows.writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.table("activity").count() > 0
    spark.catalog.dropTempView("activity")


def test_map_pages_with_null_and_no_images(spark):
    ddl = "page int, image struct<height: int, width: int, channels: int, data: binary>"
    pages = spark.createDataFrame([(1, None), (2, (2, 2, 1, bytearray(b"\x00\xff\x00\xff")))], ddl)
    assert [r["page"] for r in detect.page_metrics(pages, ["page"]).collect()] == [2]
    assert detect.page_tables(spark.createDataFrame([], ddl), ["page"]).count() == 0


def cyrillic_pdf(words):
    """A PDF of version 1.5: pages and fonts in an object stream, text as glyph numbers with a ToUnicode map."""
    letters = sorted(set("".join(words)) - set("АБВ"))
    code = {c: i + 1 for i, c in enumerate(letters)} | {"А": 300, "Б": 301, "В": 302}
    chars = "".join(f"<{n:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, n in code.items() if n < 300)
    cmap = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(letters)} beginbfchar\n{chars}endbfchar\n1 beginbfrange <012c> <012e> <0410> endbfrange".encode()
    glyphs = ["".join(f"{code[c]:04x}" for c in w) for w in words]
    shown = f"BT /F1 12 Tf <{glyphs[0]}> Tj [<{glyphs[1][:4]}> -20 <{glyphs[1][4:]}>] TJ /F2 9 Tf (oct\\101l \\(\\)(in)\\\n) Tj ET % end".encode("latin-1")
    packed = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 595.5 842] /Resources 4 0 R >>", 3: "<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", 4: "<< /Font << /F1 5 0 R /F2 << /Type /Font /Subtype /Type1 >> >> >>", 5: "<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"}
    head, body = "", ""
    for n, text in packed.items():
        head += f"{n} {len(body)} "
        body += text + " "
    out = b"%PDF-1.5\n"
    for n, kind, data in ((7, f"/Type /ObjStm /N {len(packed)} /First {len(head)}", (head + body).encode()), (8, "", shown), (9, "", cmap)):
        raw = zlib.compress(data)
        out += f"{n} 0 obj << {kind} /Filter /FlateDecode /Length {len(raw)} >> stream\r\n".encode() + raw + b"\nendstream endobj\n"
    return out


def test_text_of_a_cyrillic_pdf():
    page = d.SimplePdf()(cyrillic_pdf(["Акт сверки", "АБВ 10 000,50"]))
    assert len(page) == 1 and (page[0].width_pt, page[0].height_pt) == (595.5, 842)
    assert page[0].text == "Акт сверки\nАБВ 10 000,50\noctAl ()(in)"


@pytest.mark.parametrize("content", [b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Filter /Odd >> stream\nx\nendstream endobj", b"%PDF", b"%PDF-1.4 1 0 obj << /Type /Page >> endobj trailer << /Encrypt 3 0 R >>", b"%PDF-1.4 1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Filter /FlateDecode >> stream\nx\nendstream endobj"])
def test_pdfs_that_cannot_be_read(content):
    with pytest.raises(d.BadDocument):
        d.SimplePdf()(content)


def test_png_honours_dpi():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    page = d.Png(72)(d.write_png(image))[0]
    assert (page.render(72) == image).all() and (page.width_pt, page.height_pt) == (4, 3)
    assert (page.render(144) == image.repeat(2, axis=0).repeat(2, axis=1)).all() and page.render(36).shape == (2, 2)


def scanned(image, extra="", attributes="", bits=8, predictor=False, data=None, contents="q 24 0 0 12 6 3 cm /I Do Q", channels=None):
    channels = channels or (1 if image.ndim == 2 else 3)
    rows = np.packbits(image > 0, axis=1) if bits == 1 else image.reshape(len(image), -1)
    body = data if data is not None else zlib.compress((np.insert(np.diff(rows, axis=0, prepend=0), 0, 2, axis=1).astype(np.uint8) if predictor else rows).tobytes())
    parameters = "/DecodeParms << /Predictor 15 /Colors 3 >>" if predictor else ""
    space = "/DeviceGray" if channels == 1 else "[/ICCBased 6 0 R]"
    text = contents.encode()
    out = f"%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 36 18] /Contents 2 0 R /Resources << /XObject << /I 3 0 R >> >> {extra} >> endobj\n2 0 obj << /Length {len(text)} >> stream\n".encode() + text + b"\nendstream endobj\n"
    out += f"6 0 obj << /N 3 /Length 0 >> stream\n\nendstream endobj\n3 0 obj << /Subtype /Image /Width {image.shape[1]} /Height {image.shape[0]} /BitsPerComponent {bits} /ColorSpace {space} {parameters} {attributes} /Filter /FlateDecode /Length {len(body)} >> stream\n".encode()
    return out + body + b"\nendstream endobj"


@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("shape", [(4, 8), (4, 8, 3)])
def test_scanned_pdf_pages_are_drawn(shape, predictor):
    """Placed at (6, 3) in 24 x 12 points of a page of 36 x 18: at 72 dots to the inch each pixel fills 3 x 3 dots."""
    image = np.random.default_rng(5).integers(0, 256, shape).astype(np.uint8)
    page = d.SimplePdf()(scanned(image, predictor=predictor))[0]
    expected = np.full((18, 36, *shape[2:]), 255, dtype=np.uint8)
    expected[3:15, 6:30] = (image if image.ndim == 2 else image[:, :, ::-1]).repeat(3, axis=0).repeat(3, axis=1)
    assert (page.render(72) == expected).all()
    assert (page.render(144) == expected.repeat(2, axis=0).repeat(2, axis=1)).all()
    assert page.render(24).shape[:2] == (6, 12)


def test_scans_of_one_bit_inverted_flipped_and_layered():
    image = (np.random.default_rng(6).integers(0, 2, (4, 9)) * 255).astype(np.uint8)
    at = "q 9 0 0 4 0 0 cm /I Do Q"
    one = d.SimplePdf()(scanned(image, bits=1, contents=at, extra="/MediaBox [0 0 9 4]"))[0].render(72)
    assert (one == image).all()
    assert (d.SimplePdf()(scanned(image, bits=1, contents=at, extra="/MediaBox [0 0 9 4]", attributes="/Decode [1 0]"))[0].render(72) == 255 - image).all()
    assert (d.SimplePdf()(scanned(image, contents="9 0 0 -4 0 4 cm /I Do", extra="/MediaBox [0 0 9 4]"))[0].render(72) == image[::-1]).all()
    twice = d.SimplePdf()(scanned(image, contents=at + " q 9 0 0 4 3 0 cm BT 3 Tr (ocr) Tj ET /I Do Q", extra="/MediaBox [0 0 9 4]"))[0]
    assert twice.text == "ocr" and (twice.render(72) == np.c_[image[:, :3], image[:, :6]]).all()


@pytest.mark.parametrize("case", [{"contents": "q 24 0 0 12 6 3 cm /I Do Q BT (seen) Tj ET"}, {"contents": "0 0 9 9 re f /I Do"}, {"contents": "0 1 -1 0 0 0 cm /I Do"}, {"contents": ""}, {"extra": "/Rotate 90"}, {"attributes": "/SMask 3 0 R"}, {"bits": 4}])
def test_pages_that_are_no_scans_are_not_drawn(case):
    image = np.zeros((2, 2), dtype=np.uint8)
    page = d.SimplePdf()(scanned(image, **case))[0]
    assert page.render is None and page.width_pt == 36


def test_broken_images_give_rows_with_an_error(spark):
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    good, short = scanned(image), scanned(image, data=zlib.compress(b"abc"))
    png = d.write_png(image)
    docs = spark.createDataFrame([(1, good), (2, short), (3, None)], "id int, content binary")
    rows = {r["id"]: r for r in d.decode_pages(docs, ["id"], d.SimplePdf(), 72).collect()}
    assert rows[1]["error"] is None and (rows[1]["image"]["height"], rows[1]["image"]["width"]) == (18, 36)
    assert rows[2]["error"] and rows[2]["image"] is None and rows[2]["width_pt"] == 36 and rows[3]["error"]
    for bad in (png[:40], png[:20], png.replace(b"IHDR", b"XHDR"), scanned(image)[:30]):
        with pytest.raises(d.BadDocument):
            (d.Png() if bad[:4] == b"\x89PNG" else d.SimplePdf())(bad)
