"""Reconciliation acts: two companies compare debit and credit entries.

A ledger has one row per entry: process_id, side (debit or credit), row_id, record,
value (not negative), date.  Money is summed as decimal(18, 2) and given as double.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridleaf.functions.entities import largest_free_space
from gridleaf.plans.store import ProcessStore, kept
from gridleaf.schema import ENTRY
from gridleaf.sources.documents import decode_base64, encode_base64, valid_pdf
from gridleaf.sources.pdf import Pdf
from gridleaf.sources.pdf_update import Entry, write_text

DEBIT, CREDIT = "debit", "credit"


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("decimal(18,2)")).cast("double"), F.lit(0.0))


def totals(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_debit, total_credit, balance (debit less credit), n_entries."""
    sides = {s: _total(F.when(F.col("side") == s, F.col("value"))) for s in (DEBIT, CREDIT)}
    found = ledger.groupBy(*keys).agg(sides[DEBIT].alias("total_debit"), sides[CREDIT].alias("total_credit"), F.count("*").alias("n_entries"))
    return found.withColumn("balance", (F.col("total_debit").cast("decimal(18,2)") - F.col("total_credit").cast("decimal(18,2)")).cast("double"))


def checked_entries(ledger: DataFrame) -> DataFrame:
    """Entries of a request: a negative or missing value is not accepted."""
    return ledger.where(F.col("value") >= 0)


def number(text: Column) -> Column:
    """A money amount as documents write it: blanks, points or commas between thousands, comma or point before the cents; null for anything else.

    Of two kinds of marks the last one stands before the cents; one mark alone does so too, and a mark
    that comes more than once parts thousands.
    """
    plain = F.regexp_replace(text, r"[\s\u00a0\u202f']", "")
    parted = plain.rlike(r"^-?\d{1,3}(,\d{3})+\.\d+$|^-?\d{1,3}(,\d{3}){2,}$")
    pointed = plain.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$|^-?\d{1,3}(\.\d{3}){2,}$")
    bare = F.when(parted, F.regexp_replace(plain, ",", "")).when(pointed, F.regexp_replace(F.regexp_replace(plain, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(plain, ",", "."))
    return F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.cast("double"))


def unreadable_amounts(cells: DataFrame, keys: list[str], debit_col: int = 1, credit_col: int = 2) -> DataFrame:
    """keys, table_id, row, side, value and error: amounts with a figure in them that ``number`` does not read, so that no entry vanishes unseen."""
    side = F.when(F.col("col") == debit_col, DEBIT).when(F.col("col") == credit_col, CREDIT)
    unread = F.col("value").rlike(r"\d") & number(F.col("value")).isNull()
    return cells.withColumn("side", side).where(F.col("side").isNotNull() & unread).select(*keys, "table_id", "row", "side", "value", F.lit("not an amount").alias("error"))


def ledger_from_cells(cells: DataFrame, keys: list[str], record_col: int = 0, debit_col: int = 1, credit_col: int = 2) -> DataFrame:
    """Table rows as entries: cells of one row side by side; a row gives an entry for each amount in it.

    ``cells`` has keys, table_id, row, col, value.  Rows without an amount, such as headings, give none.
    """
    at = lambda c: F.max(F.when(F.col("col") == c, F.trim(F.regexp_replace("value", r"\s+", " "))))
    rows = cells.groupBy(*keys, "table_id", "row").agg(at(record_col).alias("record"), number(at(debit_col)).alias(DEBIT), number(at(credit_col)).alias(CREDIT))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in (DEBIT, CREDIT))))
    date = F.nullif(F.regexp_extract("record", r"\b(\d{2}\.\d{2}\.\d{2,4})\b", 1), F.lit(""))
    row_id = F.struct(F.col("table_id").alias("id_table"), F.col("row").cast("string").alias("id_row"))
    return rows.select(*keys, row_id.alias("row_id"), "record", date.alias("date"), sides.alias("s")).select(*keys, "s.side", "row_id", "record", "s.value", "date").where("value is not null and value <> 0")


def submit(requests: DataFrame) -> DataFrame:
    """requests(document base64): what a store takes up; ``accepted`` is false for anything but a PDF."""
    return requests.withColumn("accepted", valid_pdf(F.col("document"))).withColumn("pdf", F.when(F.col("accepted"), decode_base64(F.col("document"))))


def submit_all(requests: DataFrame, store: ProcessStore, parse: Callable[[DataFrame], DataFrame], now: Column | None = None) -> DataFrame:
    """Check, parse and store documents: ``requests`` without the document, with accepted and process_id, null where nothing was stored.

    ``parse`` adds ``structure``, the act as text, to the accepted ones.  Each request has an answer and a process of its own, whatever
    its other columns hold: the id is drawn beside the request, both are written once, and store and answer are read from there.
    """
    key = [c for c in requests.columns if c != "document"]
    checked = submit(requests)
    parsed = parse(checked.where("accepted")).select(*key, "accepted", "pdf", F.expr("uuid()").alias("process_id"), F.col("structure").cast("string").alias("structure"))
    refused = checked.where(~F.col("accepted")).select(*key, "accepted", *(F.lit(None).cast(t).alias(c) for c, t in (("pdf", "binary"), ("process_id", "string"), ("structure", "string"))))
    answered = kept(parsed.unionByName(refused), "requests")
    store.put(answered.where("accepted").select("process_id", "pdf", "structure"), now)
    return answered.select(*key, "accepted", "process_id")


def status(requested: DataFrame, store: DataFrame, entries: DataFrame) -> DataFrame:
    """One answer per requested process_id: 200 with seller, buyer, period and entries by side, or 404.

    ``store`` holds the live processes (process_id, seller, buyer, period), ``entries`` their ledger.
    An answer holds all entries of its process, so it is one row and one task's work by its form.
    """
    entry = F.struct("row_id", "record", "value", "date").cast(ENTRY)
    by_side = entries.groupBy("process_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, entry))).alias(s) for s in (DEBIT, CREDIT)))
    found = requested.select("process_id").join(store, "process_id", "left").join(by_side, "process_id", "left")
    there = F.col("seller").isNotNull() | F.col("buyer").isNotNull()
    none = F.array().cast(f"array<{ENTRY}>")
    return found.select(
        "process_id", F.when(there, 200).otherwise(404).alias("status"), F.when(there, "ok").otherwise("process not found").alias("message"),
        "seller", "buyer", "period", *(F.coalesce(F.when(there, F.col(s)), none).alias(s) for s in (DEBIT, CREDIT)),
    )


def fill(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Where each requested entry goes: the free space of the cell its row_id and side name.

    ``requests``: process_id, side, row_id, record, value, date; ``cells``: process_id,
    table_id, row, side, bbox, blobs.  Entries without a cell have no ``target``.
    """
    wanted = checked_entries(requests).withColumn("table_id", F.col("row_id.id_table")).withColumn("row", F.try_to_number("row_id.id_row", F.lit("999999999")).cast("int"))
    joined = wanted.join(cells.select("process_id", "table_id", "row", "side", "bbox", "blobs"), ["process_id", "table_id", "row", "side"], "left")
    return joined.withColumn("target", largest_free_space(F.col("bbox"), F.col("blobs"))).drop("bbox", "blobs")


def write_entries(documents: DataFrame, filled: DataFrame, dpi: int = 300) -> DataFrame:
    """process_id, pdf and error: each document with its entries written where ``fill`` found room for them.

    ``documents``: process_id, pdf; ``filled``: process_id, page_num, target (pixels at ``dpi``) and text.  An update is
    appended, the old bytes stay.  The entries of a document come together in one row; entries without a target or text are
    left out.  A document that cannot be updated keeps its bytes and has an error; one without entries is as it was.
    """
    entry = F.struct("page_num", "target.x_min", "target.y_min", "target.x_max", "target.y_max", "text")
    asked = filled.where("target is not null and text is not null").groupBy("process_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    rows = documents.select("process_id", "pdf").join(asked, "process_id", "left")

    @F.arrow_udf("pdf binary, error string")
    def written_into(pdfs: pa.Array, entries: pa.Array) -> pa.Array:
        return pa.array([_written_into(pdf, held or [], dpi) for pdf, held in zip(pdfs.to_pylist(), entries.to_pylist(), strict=True)], type=pa.struct([("pdf", pa.binary()), ("error", pa.string())]))

    return rows.withColumn("__done", written_into("pdf", "entries")).select("process_id", "__done.pdf", "__done.error")


def _written_into(content: bytes | None, entries: list[dict], dpi: int) -> dict:
    if not content or not entries:
        return {"pdf": content, "error": None}
    try:
        pdf = Pdf(content)
        boxes = [pdf.box(p) for p in pdf.pages()]
        scale, placed = 72 / dpi, []
        for e in entries:
            page = e["page_num"] or 0
            left, _, _, top = boxes[page] if 0 <= page < len(boxes) else (0.0, 0.0, 0.0, 0.0)
            placed.append(Entry(page, left + e["x_min"] * scale, top - e["y_max"] * scale, (e["x_max"] - e["x_min"]) * scale, (e["y_max"] - e["y_min"]) * scale, e["text"]))
        return {"pdf": write_text(content, placed), "error": None}
    except (ValueError, zlib.error, TypeError, AttributeError, LookupError, ArithmeticError) as e:
        return {"pdf": content, "error": str(e) or type(e).__name__}


def answer(documents: DataFrame, content: str = "pdf") -> DataFrame:
    """documents with ``document``: their bytes as base64."""
    return documents.withColumn("document", encode_base64(F.col(content)))
