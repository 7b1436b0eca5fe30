"""The reader of PDF files, over files made by hand."""

from __future__ import annotations

import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

from arbora.sources import files, pdf


def test_round_trip():
    random.seed(1)
    for _ in range(50):
        pages = ["\n".join(" ".join(random.choices(["word", "é", "字", "😀", "(a)", "b\\c", "<d>", "10%"], k=random.randint(1, 8))) for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 6))]
        title = random.choice([None, "A title", "Título – 字", ""])
        assert pdf.read(pdf.written(pages, title)) == (pages, title)


def made(objects: dict[int, bytes], trailer: bytes = b"<< /Root 1 0 R >>") -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in objects.items()) + b"trailer\n" + trailer


def stream(raw: bytes, more: bytes = b"", length: bytes | None = None) -> bytes:
    return b"<< /Length %s %s >>\nstream\n" % (length or b"%d" % len(raw), more) + raw + b"\nendstream"


CATALOG = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"}
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /fi 65 /uni4E2D] >> >>"


def test_operators():
    content = rb"""% a comment
BT /F1 12 Tf 14 TL 72 700 Td (Plain \(nested (deep)\) \101\
cut) Tj T* [(Ke) -50 (rn) -300 (ed)] TJ (next) ' 0 0 (third) "
1 0 0 1 72 500 Tm (moved) Tj 40 0 Td (same line) Tj 0 -14 TD (below) Tj T* <02 03> Tj ET
BI /W 1 /H 1 ID (x) Tj EI Q BT 72 100 Td /X Do ET"""
    form = b"<< /Type /XObject /Subtype /Form >>"
    objects = CATALOG | {4: stream(content), 5: FONT, 6: stream(b"BT /F1 9 Tf 1 50 Td (in a form) Tj ET", form[3:-2])}
    (text,), title = pdf.read(made(objects))
    assert text.split("\n") == ["Plain (nested (deep)) 中cut", "Kern ed", "next", "third", "moved same line", "below", "éfi", "in a form"]
    assert title is None


@pytest.mark.parametrize("filters, press", [(b"/FlateDecode", zlib.compress), (b"/ASCIIHexDecode", lambda x: x.hex().encode() + b">"), (b"[/ASCII85Decode /FlateDecode]", lambda x: base64.a85encode(zlib.compress(x)) + b"~>")])
def test_filters_and_lengths(filters, press):
    raw = press(b"BT /F1 9 Tf (shown) Tj ET")
    for length in (None, b"9999", b"7 0 R"):
        assert pdf.read(made(CATALOG | {4: stream(raw, b"/Filter " + filters, length), 5: FONT, 7: b"%d" % len(raw)}))[0] == ["shown"]


def test_object_streams_and_cross_reference_streams():
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: CATALOG[2], 3: CATALOG[3], 5: FONT, 9: b"<< /Title (Packed) >>"}
    heads, body = b"", b""
    for n, x in packed.items():
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    raw = zlib.compress(heads + body)
    objects = {8: stream(raw, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(packed), len(heads))), 4: stream(b"BT /F1 9 Tf (kept) Tj ET"), 10: stream(b"", b"/Type /XRef /Root 1 0 R /Info 9 0 R")}
    assert pdf.read(b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in objects.items())) == (["kept"], "Packed")


def test_files_that_cannot_be_read(spark):
    good = pdf.written(["one", "two"], "T")
    rows = [("a/good.pdf", good), ("a/bad.pdf", b"nothing"), ("a/locked.pdf", made(CATALOG | {4: stream(b""), 5: FONT}, b"<< /Root 1 0 R /Encrypt 9 0 R >>")), ("a/odd.pdf", made(CATALOG | {4: stream(b"x", b"/Filter /LZWDecode"), 5: FONT})), ("a/cut.pdf", good[:200])]
    made_ = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["doc_id"], r["physical_index"]): (r["text"], r["error"]) for r in files.pages_of(made_, lambda x: pdf.read(x)[0]).collect()}
    assert got.pop(("good.pdf", 1)) == ("one", None) and got.pop(("good.pdf", 2)) == ("two", None)
    assert got == {("bad.pdf", None): (None, "ValueError: not a PDF file"), ("locked.pdf", None): (None, "ValueError: encrypted"), ("odd.pdf", None): (None, "ValueError: filter LZWDecode is not read")}
    assert {r["doc_id"]: r["title"] for r in files.titles_of(made_).collect()} == {"good.pdf": "T", "bad.pdf": "Untitled", "locked.pdf": "Untitled", "odd.pdf": "Untitled", "cut.pdf": "Untitled"}


def test_random_bytes_end():
    random.seed(2)
    whole = pdf.written(["some words here", "and more"], "T")
    for _ in range(300):
        cut = bytearray(whole)
        for _ in range(random.randint(1, 30)):
            cut[random.randrange(9, len(cut))] = random.randrange(256)
        try:
            pdf.read(bytes(cut))
        except Exception:
            pass


def test_glyphs():
    assert [pdf.glyph(x) for x in ("A", "eacute", "Odieresis", "one", "exclam", "uni00E9", "u1F600", "quoteright", "nothing", "a.alt")] == ["A", "é", "Ö", "1", "!", "é", "😀", "’", "", "a"]


def test_command_line_reads_a_file(spark, tmp_path):
    import json

    from arbora.__main__ import parser, run

    (tmp_path / "d.pdf").write_bytes(pdf.written(["One\nwords of the first", "Two\nwords of the second", "more"]))
    assert run(parser().parse_args(["pdf", str(tmp_path / "d.pdf"), "-o", str(tmp_path / "o.json"), "--no-summary"])) == 0
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["doc_name"] == "d.pdf" and [(x["title"], x["start_index"], x["end_index"]) for x in got["structure"]] == [("One", 1, 1), ("Two", 2, 2), ("more", 3, 3)]


def test_titles_from_the_table_of_objects():
    """A plain file's title is read without its pages; any other file is read whole."""
    plain = pdf.written(["some text"] * 50, "Título – 字")
    assert pdf.title_of(plain) == "Título – 字" and pdf.title_of(pdf.written(["x"])) is None
    broken = plain.replace(b"/Type /Page ", b"/Type (Page ")  # pages that can't be told don't matter to the title
    assert pdf.title_of(broken) == "Título – 字"
    later = b"9 0 obj\n<< /Title (Later) >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 9 0 R >>\n"
    for other in (plain + later, plain + b"\n" + later + b"startxref\n0\n%%EOF\n", plain[7:].join([b"%PDF-1.4\n% moved\n", b""]), made(CATALOG)):
        assert pdf.title_of(other) == pdf.Pdf(other).title()
    with pytest.raises(ValueError):
        pdf.title_of(b"no file")


def test_one_map_of_characters_is_read_once(monkeypatch):
    calls, known = [], pdf.character_map
    monkeypatch.setattr(pdf, "character_map", lambda raw: calls.append(1) or known(raw))
    assert pdf.read(pdf.written(["a", "b", "c"]))[0] == ["a", "b", "c"] and len(calls) == 1


def test_files_come_in_small_batches(spark):
    """A task never holds the files, or the pages, of more than a small batch."""
    content = pdf.written(["x"] * 3)
    rows = spark.range(3000).coalesce(1).selectExpr("concat('in/', id, '.pdf') AS path").withColumn("content", F.lit(content))
    seen = files.pages_of(rows, lambda c: ["x"] * 3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= files.BATCH_FILES
    assert seen.count() == 9000 and files.titles_of(rows).where("title = 'Untitled'").count() == 3000
