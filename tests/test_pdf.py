"""The PDF reader over files written here."""

import zlib

import pytest

from quillstone.sources import documents, pdf


def write(objects, trailer="/Root 1 0 R", streams=()):
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        body = body if isinstance(body, bytes) else body.encode("latin-1")
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer.encode(), at))


def stream(body, compress=False, extra=""):
    data = zlib.compress(body) if compress else body
    return f"<< /Length {len(data)}{' /Filter /FlateDecode' if compress else ''} {extra}>>\nstream\n".encode() + data + b"\nendstream"


def native(compress=True):
    return write([
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] /Count 3 /Resources << /Font << /F1 7 0 R >> >> >>",
        "<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", "<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        stream(b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)) Tj 0 -14 Td [(sec) -30 (ond) -300 (line)] TJ ET", compress), stream(b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <0102> Tj 1 0 0 1 90 700 Tm (\x02) Tj ET", compress),
        "<< /Type /Font /ToUnicode 8 0 R >>", stream(b"1 begincodespacerange <01> <ff> endcodespacerange 2 beginbfchar <01> <00C9> <02> <65E5> endbfchar 1 beginbfrange <20> <7e> <0020> endbfrange"), "<< /Type /Page /Parent 2 0 R >>",
    ])


@pytest.mark.parametrize("compress", [False, True])
def test_native_text(compress):
    assert pdf.native_pages(native(compress)) == ["Hello (you)\nsecond line", "É日日", ""]


def scan(actual=("One ", "two."), marks=b"/Span << /MCID 0 >> BDC EMC /Span << /MCID 1 >> BDC EMC", role="P", trailer="/Root 1 0 R"):
    return write([
        "<< /Type /Catalog /Pages 2 0 R /MarkInfo << /Marked true >> /StructTreeRoot 4 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /StructParents 0 /Contents 11 0 R >>",
        "<< /Type /StructTreeRoot /K [5 0 R] /ParentTree << /Nums [0 [8 0 R 9 0 R]] >> >>", "<< /S /Document /P 4 0 R /K [6 0 R] >>", "<< /S /Sect /P 5 0 R /Pg 3 0 R /K [7 0 R] >>", f"<< /S /{role} /P 6 0 R /Pg 3 0 R /K [8 0 R 9 0 R] >>",
        f"<< /S /Span /P 7 0 R /Pg 3 0 R /K 0 /ActualText ({actual[0]}) >>", f"<< /S /Span /P 7 0 R /Pg 3 0 R /K 1 /ActualText ({actual[1]}) >>", "null", stream(marks),
    ], trailer)


def test_tagged_scans():
    assert pdf.tagged_pages(scan()) == ["One two."]


@pytest.mark.parametrize("data", [
    scan(marks=b"/Span << /MCID 0 >> BDC EMC"), scan(role="H1"), scan(actual=(" ", " ")), scan(trailer="/Root 1 0 R /Prev 5"), scan() + b"more", native(), b"%PDF-1.4\nnothing", b"x", scan().replace(b"/K 1 ", b"/K 0 "),
])
def test_other_files_arent_tagged_scans(data):
    with pytest.raises(pdf.BadPdf):
        pdf.tagged_pages(data)


def test_parsers_over_files(spark):
    rows = [("a", bytearray(native()), "native"), ("b", bytearray(scan()), "ocr"), ("c", bytearray(b"%PDF-1.4 broken"), "native"), ("d", bytearray(native()), "ocr"), ("e", None, "native")]
    docs = spark.createDataFrame(rows, "document_id string, content binary, source_type string")
    parsers = {"native": pdf.native_parser(), "ocr": pdf.tagged_parser()}
    pages = documents.parse(docs, parsers)
    got = {(r["document_id"], r["page_number"]): (r["text"], r["visual"], [w.split(":")[0] for w in r["warnings"]]) for r in pages.collect()}
    assert got == {
        ("a", 1): ("Hello (you)\nsecond line", False, []), ("a", 2): ("É日日", False, []), ("a", 3): ("", True, ["NO_NATIVE_TEXT"]), ("b", 1): ("One two.", False, []), ("c", 1): ("", True, ["UNREADABLE"]),
        ("d", 1): ("", True, ["UNREADABLE"]), ("e", 1): ("", True, ["UNREADABLE"]),
    }
    marked = documents.mark_blank(pages.select("document_id", "page_number", "text", "visual", "warnings"))
    assert {r["document_id"] for r in documents.blank_documents(marked).collect()} == {"c", "d", "e"}
