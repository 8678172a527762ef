"""Plain PDF files of given pages: text in one or two columns, and tables.

What ``rillmark.sources.pdf`` reads, in the forms that files have: codes of WinAnsi or two-byte codes with a
``ToUnicode`` map, plain or compressed streams, a cross-reference table or a stream with packed objects.
"""

from __future__ import annotations

import zlib

WIDTH, HEIGHT, SIZE, LEADING, PARAGRAPH, MARGIN = 612, 792, 9, 11, 8, 50
LETTER = 0.6 * SIZE  # Courier
ONE, TWO, RIGHT = 92, 44, 320


def wrapped(text: str, letters: int) -> list[list[str]]:
    """Paragraphs (lines of the text) as lines of whole words of at most that many letters."""
    out = []
    for line in text.split("\n"):
        own: list[str] = []
        for word in line.split():
            if own and len(own[-1]) + 1 + len(word) <= letters:
                own[-1] += " " + word
            else:
                own.append(word)
        if own:
            out.append(own)
    return out


class _Font:
    def __init__(self, wide: bool):
        self.wide, self.codes = wide, {}

    def shown(self, text: str) -> bytes:
        if not self.wide:
            data = text.encode("cp1252")
            return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
        codes = [self.codes.setdefault(c, len(self.codes) + 1) for c in text]
        return b"<" + b"".join(b"%04X" % c for c in codes) + b">"

    def objects(self, first: int) -> list[tuple[bytes, bytes | None]]:
        """(object, its stream's data or None); the first one is the font."""
        if not self.wide:
            return [(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", None)]
        pairs = [b"<%04X> <%s>" % (code, c.encode("utf-16-be").hex().encode()) for c, code in self.codes.items()]
        parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(own), b"\n".join(own)) for own in (pairs[i : i + 100] for i in range(0, len(pairs), 100))]
        cmap = b"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + b"\n".join(parts)
        below = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Mono /DW 600 >>"
        return [(b"<< /Type /Font /Subtype /Type0 /BaseFont /Mono /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (first + 1, first + 2), None), (below, None), (b"<< >>", cmap)]


def text_page(text: str, columns: bool) -> list[tuple[float, float, str]]:
    """(x, baseline, line) of a page's text; two columns of about equal length, the left one first."""
    paragraphs = wrapped(text, TWO if columns else ONE)
    lines = [(line, i == 0 and p > 0) for p, own in enumerate(paragraphs) for i, line in enumerate(own)]
    half = -(-len(lines) // 2) if columns else len(lines)
    out = []
    for x, own in ((MARGIN, lines[:half]), (RIGHT, lines[half:])):
        y = HEIGHT - 60
        for line, fresh in own:
            y -= PARAGRAPH if fresh else 0
            out.append((x, y, line))
            y -= LEADING
    return out


def table_page(head: str, rows: list[list[str]], ruled: bool) -> tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]]]:
    """Text and lines of a page with a heading and a table; a row of one cell stands for a merged one."""
    n = max(map(len, rows))
    widths = [max((len(r[i]) for r in rows if len(r) == n), default=1) + 4 for i in range(n)]
    lefts = [MARGIN + LETTER * sum(widths[:i]) for i in range(n + 1)]
    top = HEIGHT - 60 - 4 * LEADING
    text = [(MARGIN, HEIGHT - 60, head)]
    for k, row in enumerate(rows):
        text += [(lefts[i], top - k * LEADING, cell) for i, cell in enumerate(row) if cell]
    lines = [(x - 3, top + SIZE, x - 3, top - (len(rows) - 1) * LEADING - 3) for x in lefts] if ruled else []
    return text, lines


def write_pdf(pages: list[tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]]]], wide: bool = False, packed: bool = False, compressed: bool = True) -> bytes:
    """The bytes of a file of pages of text (x, baseline, string) and lines."""
    try:
        for text, _ in pages:
            for *_, line in text:
                line.encode("cp1252")
    except UnicodeEncodeError:
        wide = True
    font, contents = _Font(wide), []
    for text, lines in pages:
        parts = [b"BT /F1 %d Tf" % SIZE, *(b"1 0 0 1 %.2f %.2f Tm %s Tj" % (x, y, font.shown(line)) for x, y, line in text), b"ET"]
        parts += [b"%.2f %.2f m %.2f %.2f l S" % line for line in lines]
        contents.append(b"\n".join(parts))
    objects: list[tuple[bytes, bytes | None]] = [(b"<< /Type /Catalog /Pages 2 0 R >>", None), (b"", None)]
    fonts = font.objects(3)
    objects += fonts
    kids = []
    for data in contents:
        kids.append(len(objects) + 1)
        objects.append((b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2), None))
        objects.append((b"<< >>", data))
    refs = b" ".join(b"%d 0 R" % k for k in kids)
    objects[1] = (b"<< /Type /Pages /Count %d /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % (len(kids), WIDTH, HEIGHT, refs), None)
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}

    def add(number: int, body: bytes, data: bytes | None) -> None:
        places[number] = len(out)
        if data is not None:
            data = zlib.compress(data) if compressed else data
            body = body[:-2] + b"/Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if compressed else b"") + data + b"\nendstream"
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    plain = [(i, body) for i, (body, data) in enumerate(objects, 1) if data is None]
    for i, (body, data) in enumerate(objects, 1):
        if data is not None or not packed:
            add(i, body, data)
    n = len(objects)
    if packed:
        heads, bodies = [], b""
        for i, body in plain:
            heads.append(b"%d %d" % (i, len(bodies)))
            bodies += body + b" "
        first = b" ".join(heads) + b" "
        add(n + 1, b"<< /Type /ObjStm /N %d /First %d >>" % (len(plain), len(first)), first + bodies)
        places[n + 2] = len(out)
        order = {i: k for k, (i, _) in enumerate(plain)}
        rows = [b"\x00\x00\x00\x00\x00\x00\x00"]
        for i in range(1, n + 3):
            kind, a, b = (2, n + 1, order[i]) if i in order else (1, places[i], 0)
            rows.append(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big"))
        add(n + 2, b"<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R >>" % (n + 3), b"".join(rows))
        out.extend(b"startxref\n%d\n%%%%EOF\n" % places[n + 2])
    else:
        at = len(out)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (n + 1) + b"".join(b"%010d 00000 n \n" % places[i] for i in range(1, n + 1)))
        out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n + 1, at))
    return bytes(out)
