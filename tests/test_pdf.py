"""PDF files: the forms of objects, fonts and content, damaged files, layout."""

import zlib

import pytest

from rillmark.operators import layout
from rillmark.sources import pdf, pdf_write


def rows(data):
    return list(pdf.read_file("a.pdf", data))


def shown(data):
    return [r[9] for r in rows(data) if r[4] == "text"]


def file_of(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=b"", page=b""):
    stream = b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> " + page + b">>", stream, font]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + more
    return out + b"trailer << /Root 1 0 R >>\n"


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("compressed", [False, True])
def test_forms_read_back(wide, packed, compressed):
    text = "Größe (a\\b) 100 % naïve <x> [y]"
    data = pdf_write.write_pdf([([(50, 700, text), (50, 680, "second")], []), ([(60, 600, "page two")], [(10, 10, 10, 90)])], wide, packed, compressed)
    assert shown(data) == [text, "second", "page two"]
    assert [r[1] for r in rows(data) if r[4] == "page"] == [1, 2]
    assert shown(data[:-30]) == [text, "second", "page two"]  # without its end: found by a scan
    assert [tuple(r[5:9]) for r in rows(data) if r[4] == "rule"] == [(10.0, 702.0, 10.0, 782.0)]


def test_letters_beyond_the_code_page():
    assert shown(pdf_write.write_pdf([([(50, 700, "Ωμέγα 漢字 𝄞")], [])])) == ["Ωμέγα 漢字 𝄞"]


def test_strings_and_operators():
    content = rb"""BT /F 10 Tf 14 TL 1 0 0 1 50 700 Tm (a\050b\)\134 \
c) Tj T* <48 69> Tj (next) ' 2 3 (set) " [(W) -50 (ord) -900 (far)] TJ ET % (comment)
q 2 0 0 2 10 10 cm BT /F 5 Tf 0 0 Td (scaled) Tj ET Q
BI /W 1 /H 1 ID xx(no text) Tj EI BT /F 5 Tf (after) Tj bad Tj (still) Tj ET /X Do"""
    form = b"6 0 obj << /Subtype /Form /Matrix [1 0 0 1 100 0] /Length 35 >> stream\nBT /F 9 Tf 5 5 Td (form) Tj ET     \nendstream endobj\n"
    got = [r for r in rows(file_of(content, more=form)) if r[4] == "text"]
    assert [r[9] for r in got] == ["a(b)\\ c", "Hi", "next", "set", "W", "ord", "far", "scaled", "after", "still", "form"]
    at = {r[9]: r for r in got}
    assert at["scaled"][5] == 10 and at["scaled"][8] == pytest.approx(800 - 10 + 2) and at["form"][5] == 105
    assert at["far"][5] - at["ord"][7] == pytest.approx(9)


def test_differences_and_widths():
    font = b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [1000 250] /Encoding << /Differences [65 /eacute /germandbls 67 /uni20AC /Scaron /odd] >> >>"
    got = [r for r in rows(file_of(b"BT /F 10 Tf 0 0 Td (ABCDE) Tj ET", font)) if r[4] == "text"]
    assert got[0][9] == "éß€Š�" and got[0][7] - got[0][5] == pytest.approx(10 * (1 + 0.25 + 3 * 0.5))


def test_range_maps():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <43> <0061> endbfrange 1 beginbfrange <44> <45> [<00660069> <D834DD1E>] endbfrange"
    more = b"7 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    assert shown(file_of(b"BT /F 9 Tf (ABCDE) Tj ET", b"<< /Subtype /Type1 /ToUnicode 7 0 R >>", more)) == ["abcfi𝄞"]


def test_filters_and_predictor():
    hexed = b"<< /Filter /AHx /Length 99 >>stream\n" + b"BT /F 9 Tf (hex) Tj ET".hex().encode() + b">\nendstream"
    assert shown(file_of(b"", more=b"4 0 obj " + hexed + b" endobj\n")) == ["hex"]
    broken = zlib.compress(b"BT /F 9 Tf (kept) Tj ET " + bytes(range(256)) * 400)[:-20]
    assert shown(file_of(b"", more=b"4 0 obj << /Filter /FlateDecode /Length 9 >> stream\n" + broken + b"\nendstream endobj\n"))[0] == "kept"
    assert shown(file_of(b"", more=b"4 0 obj << /Filter /LZWDecode /Length 9 >> stream\nx\nendstream endobj\n")) == []
    assert pdf._unpredicted(bytes([2, 1, 2, 2, 1, 1, 1, 5, 5, 4, 1, 1, 3, 2, 2]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3, 5, 10, 6, 11, 5, 10])


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R /Encrypt 9 0 R >>", b"%PDF-1.4 " + b"[" * 5000, b"%PDF-1.4 1 0 obj 1 0 R endobj trailer << /Root 1 0 R >>"])
def test_unreadable_files_have_a_row(data):
    (row,) = rows(data)
    assert row[0] == "a.pdf" and row[10] and all(x is None for x in row[1:10])


def test_layout_of_columns_below_a_title(spark):
    left = [(50, 700 - 11 * i, f"left line number {i} with words") for i in range(12)]
    right = [(320, 697 - 11 * i, f"right line number {i} with words") for i in range(9)]
    title = [(50, 740, "A title over both columns of the page that is very wide indeed")]
    foot = [(50, 500, "A last line over both columns of the page that is very wide too")]
    data = pdf_write.write_pdf([(foot + right + left + title, []), ([(50, 700, "few"), (320, 690, "other side"), (50, 680, "more")], [])])
    spans = pdf.pdf_spans(spark.createDataFrame([("a", bytearray(data)), ("b", None)], "path string, content binary"))
    texts = {r["page"]: r["text"] for r in layout.page_texts(spans).collect()}
    assert texts[1].replace("\n\n", "\n").split("\n") == [t[2] for t in title + left + right + foot]
    assert texts[2].split() == "few more other side".split()  # the other page's gutter
    blocks = layout.text_blocks(spans).filter("page = 1").orderBy("position").collect()
    assert [len(b["text"].split("\n")) for b in blocks] == [1, 12, 9, 1] and blocks[1]["x0"] == 50


def test_one_letter_line_of_the_right_column(spark):
    left = [(50, 700 - 11 * i, f"left line number {i} with words") for i in range(9)]
    right = [(320, 700 - 11 * i, "|" if i in (3, 8) else f"right line number {i} with words") for i in range(9)]
    page_number = [(303.3, 560, "7")]
    data = pdf_write.write_pdf([(left + right + page_number, [])])
    (found,) = layout.page_texts(pdf.pdf_spans(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))).collect()
    assert found["text"].replace("\n\n", "\n").split("\n") == [t[2] for t in left + right + page_number]


def test_spans_of_many_files_come_together(monkeypatch):
    """A batch of rows is of many files, and a long file's rows come in parts; no row is lost."""
    import pyarrow as pa

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    files = {f"{i}.pdf": pdf_write.write_pdf([([(50, 700 - 9 * j, f"{i} {j}") for j in range(i % 4)], [])]) for i in range(90)} | {"none.pdf": None}
    batch = pa.RecordBatch.from_arrays([pa.array(list(files)), pa.array(list(files.values()), pa.binary())], names=["path", "content"])
    expected = [r for path, data in files.items() for r in pdf.read_file(path, data or b"")]
    for most, n in ((20_000, 1), (100, -(-len(expected) // 100))):
        monkeypatch.setattr(pdf, "SPANS_AT_ONCE", most)
        got = list(pdf.pdf_spans(Files())(iter([batch])))
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == expected and len(got) == n


def test_layout_tables(spark):
    grid = [["Item", "Unnamed: 1", "2019", "none"], ["Cash and more", "x", "12", ""], ["total of all the items here"], ["Debt", "", "7", ""], ["Sum", "y", "19", ""]]
    full = [["Item", "Unnamed: 1", "2019", "none"], *grid[1:]]
    for ruled in (False, True):
        text, lines = pdf_write.table_page("A heading stands above the table here", full, ruled)
        data = pdf_write.write_pdf([(text, lines), ([(50, 700, "lone"), (300, 700, "pair")], [])])
        found = layout.layout_tables(pdf.pdf_spans(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))).collect()
        assert [(r["page"], r["table_no"]) for r in found] == [(1, 0)]  # one line is no table
        assert [list(x) for x in found[0]["rows"]] == [["Item", "2019"], ["Cash and more", "12"], ["total of all the items here", ""], ["Debt", "7"], ["Sum", "19"]]
