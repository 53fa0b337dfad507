"""PDF files built here, read back by page."""

import zlib

import pytest

from noticelake.sources import files
from noticelake.sources.pdf import page_texts

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data: bytes, packed: bool, more: bytes = b"") -> bytes:
    raw = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode" if packed else b"", more, raw)


def pdf(objects: dict[int, bytes]) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def pages(contents: list[bytes], packed=False, font=FONT, inherit=False) -> dict[int, bytes]:
    """The last page has the smallest object number, so the tree's order shows."""
    n = len(contents)
    kids = [10 + 2 * (n - k) for k in range(n)]
    resources = b"/Resources << /Font << /F1 5 0 R >> >>"
    made = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] %s >>" % (n, b" ".join(b"%d 0 R" % k for k in kids), resources if inherit else b""), 5: font}
    for k, c in zip(kids, contents):
        made[k] = b"<< /Type /Page /Parent 2 0 R %s /Contents %d 0 R >>" % (b"" if inherit else resources, k + 1)
        made[k + 1] = stream(c, packed)
    return made


SHOW = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\)) Tj 0 -14 Td [(Sec) -20 (ond) -400 (line)] TJ T* <63616665E9> Tj ET"
SHOWN = "Hello (world)\nSecond line\ncafeé"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("inherit", [False, True])
def test_pages_in_order(packed, inherit):
    data = pdf(pages([SHOW, b"BT /F1 9 Tf (two \\101\\n\\\nmore) ' ET", b""], packed, inherit=inherit))
    assert page_texts(data) == [SHOWN, "two A\nmore", ""]


def test_object_streams_and_unicode_maps():
    cmap = b"2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<4E2D> <D83DDE00>] endbfrange"
    made = pages([b"BT /F1 9 Tf 1 0 0 1 50 700 Tm <00010002> Tj 1 0 0 1 90 700 Tm <001000110012> Tj 1 0 0 1 50 600 Tm [<0020> <0021>] TJ ET"], True, b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>")
    made[6] = stream(cmap, True)
    loose = {n: made.pop(n) for n in (1, 2, 5)}
    heads, bodies = [], b""
    for n, body in loose.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b" "
    head = b" ".join(heads) + b" "
    made[99] = stream(head + bodies, True, b"/Type /ObjStm /N 3 /First %d" % len(head))
    assert page_texts(pdf(made)) == ["Hé abc\n中😀"]


def test_files_that_say_nothing():
    assert page_texts(pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: stream(b"x", False, b"/Filter /DCTDecode")})) == [""]
    assert page_texts(b"%PDF-1.4\n%%EOF") == []
    for bad in (b"", b"plain text", pdf({}) + b" /Encrypt 3 0 R"):
        assert files.extract(bad, "a.pdf")[1].startswith("ValueError")


def test_pdfs_as_a_table(spark):
    shared = b"BT /F1 9 Tf (A notice) Tj T* (page %d says things that are long enough to count) Tj ET"
    rows = [("a.pdf", bytearray(pdf(pages([shared % 1, shared % 2], True)))), ("scan.pdf", bytearray(pdf(pages([b""])))), ("bad.pdf", bytearray(b"x")), ("none.pdf", None)]
    got = {r["path"]: r for r in files.extracted_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"]["text"] == "page 1 says things that are long enough to count\npage 2 says things that are long enough to count" and not got["a.pdf"]["needs_ocr"]
    assert got["scan.pdf"]["needs_ocr"] and got["bad.pdf"]["error"] == "ValueError: not a PDF" and got["none.pdf"]["error"] == "no content"
