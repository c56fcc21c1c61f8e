"""Reject reasons of PDFs that are broken in stated ways."""

import zlib

from pyspark.sql import functions as F

from corpusloom.functions import pdf
from corpusloom.operators import filters


def made(kids=b"[3 0 R]", content=b"BT (x) Tj ET", extra=b"", catalog=b"/Type /Catalog /Pages 2 0 R", stream=b""):
    parts = [b"%PDF-1.4", b"1 0 obj << " + catalog + b" >> endobj", b"2 0 obj << /Type /Pages /Count 1 /Kids " + kids + b" >> endobj",
             b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj", b"4 0 obj << " + extra + b" >> stream\n" + content + b"\nendstream endobj", stream, b"trailer << /Root 1 0 R >>"]
    return b"\n".join(parts)


def packed():
    """Catalog and page tree within a compressed object stream."""
    bodies = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [ 5 0 R 3 0 R ] >>"), (5, b"<< /Type /Pages /Kids [] >>")]
    at, head, text = 0, [], b""
    for number, body in bodies:
        head.append(b"%d %d" % (number, len(text)))
        text += body + b" "
    table = b" ".join(head) + b" "
    stream = zlib.compress(table + text)
    return b"%PDF-1.5\n3 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n4 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT ET") + b"\nendstream endobj\n7 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >> stream\n" % len(table) + stream + b"\nendstream endobj"


CASES = [
    (made(), None), (packed(), None), (made(extra=b"/Filter /FlateDecode", content=zlib.compress(b"BT ET" * 99)), None),
    (made(extra=b"/Filter /FlateDecode", content=b"not deflated"), "pdf_unreadable"),
    (made(extra=b"/Filter /FlateDecode", content=b"hidden", stream=b"9 0 obj << >> endobj /Encrypt 9 0 R"), None),
    (made().replace(b"4 0 obj", b"8 0 obj"), "pdf_unreadable"), (made(kids=b"[]"), "pdf_no_pages"), (made(kids=b"[2 0 R 77 0 R]"), "pdf_no_pages"),
    (made(catalog=b"/Type /Other"), "pdf_validation_error"), (made(catalog=b"/Type /Catalog"), "pdf_validation_error"), (b"%PDF-1.4\n", "pdf_validation_error"),
    (packed().replace(b"/First", b"/Fir"), "pdf_validation_error"), (b"<html>", "invalid_pdf_signature"), (b"", "invalid_pdf_signature"), (None, "invalid_pdf_signature"),
    # a later version of an object replaces the earlier one
    (made(kids=b"[]") + b"\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj", None),
]


def test_reasons(spark):
    assert [pdf.problem(c) for c, _ in CASES] == [want for _, want in CASES]
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in enumerate(CASES)], "k int, content binary")
    got = {r.k: r.reason for r in rows.select("k", filters.pdf_reject_reason(F.col("content")).alias("reason")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}
    assert rows.where("k = 12").select(filters.rejected_header(F.col("content")).alias("h")).first().h == "<html"
