"""Small valid files of each format as bytes: for tests, demonstrations and queries over tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_CELLS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A workbook; None cells are left out, bools and numbers are typed, strings inline."""
    books, links, members = [], [], {}
    for i, (name, rows) in enumerate(sheets.items(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                at = f'r="{_letters(c)}{r}"'
                if isinstance(v, bool):
                    cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f"<c {at}><v>{v!r}</v></c>")
                elif v is not None:
                    cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        members[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_CELLS}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        books.append(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>')
    members["xl/workbook.xml"] = f'<workbook xmlns="{_CELLS}" xmlns:r="{_LINKS}"><sheets>{"".join(books)}</sheets></workbook>'
    members["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>'
    return _zip(members)


def docx(paragraphs: list, tables: list[list[list[str]]] = (), broken: bool = False) -> bytes:
    """A document of paragraphs (text, or (style, text)) and then tables; broken: without a body, so that only the plain stream can read it."""

    def p(text: str, style: str = "") -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join(p(x) if isinstance(x, str) else p(x[1], x[0]) for x in paragraphs)
    for t in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>"
    part = "other" if broken else "body"
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_WORDS}"><w:{part}>{body}</w:{part}></w:document>'})


def _shown(text: str) -> str:
    return "(" + text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ") Tj"


def _grid(rows: list[list[str]], top: int) -> str:
    """A ruled table of cells of 100 by 20 points."""
    out = []
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            x, y = 72 + 100 * c, top - 20 * (r + 1)
            out.append(f"{x} {y} 100 20 re S BT /F1 10 Tf {x + 4} {y + 6} Td {_shown(text)} ET")
    return " ".join(out)


def pdf(pages: list[list[str]], tables: dict[int, list[list[str]]] | None = None) -> bytes:
    """A file of plain lines a page, uncompressed, with a ruled table below the lines of some pages (by number from 0)."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for n, lines in enumerate(pages):
        text = "BT /F1 12 Tf 14 TL 72 720 Td " + " ".join(f"{_shown(x)} T*" for x in lines) + " ET"
        text += " " + _grid((tables or {}).get(n, []), 700 - 14 * len(lines))
        data = text.encode("cp1252", "replace")
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
