"""Excel workbooks: every sheet's rows as tab-joined cells; cached values of formulas."""

from __future__ import annotations

import datetime as dt
import re
from xml.etree import ElementTree

from siltstone.sources.safe_zip import Archive, events, local

#: Built-in number formats that show dates or times (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH, _EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
_REFERENCE = re.compile(r"([A-Z]+)(\d+)")


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", code.lower())
    return bool(re.search(r"[dmyhs]", bare)) and "general" not in bare


def _rich_text(e) -> str:
    """The text of a string item, without phonetic hints."""
    if local(e.tag) == "rPh":
        return ""
    return (e.text or "" if local(e.tag) == "t" else "") + "".join(_rich_text(c) for c in e)


def _relations(archive: Archive, name: str) -> dict[str, str]:
    if name not in archive.names:
        return {}
    return {e.get("Id"): e.get("Target") for e in ElementTree.parse(archive.open(name)).getroot()}


def _shared(archive: Archive) -> list[str]:
    out = []
    if "xl/sharedStrings.xml" in archive.names:
        for kind, e in events(archive.open("xl/sharedStrings.xml")):
            if kind == "end" and local(e.tag) == "si":
                out.append(_rich_text(e))
                e.clear()
    return out


def _date_styles(archive: Archive) -> list[bool]:
    if "xl/styles.xml" not in archive.names:
        return []
    root = ElementTree.parse(archive.open("xl/styles.xml")).getroot()
    own = {int(e.get("numFmtId")): _is_date(e.get("formatCode", "")) for e in root.iter() if local(e.tag) == "numFmt"}
    cells = next((e for e in root if local(e.tag) == "cellXfs"), ())
    ids = [int(e.get("numFmtId", 0)) for e in cells]
    return [own.get(i, i in DATE_FORMATS) for i in ids]


def _date(number: float, epoch: dt.datetime):
    if 0 <= number < 1:
        seconds = round(number * 86400)
        return (dt.datetime.min + dt.timedelta(seconds=seconds)).time() if seconds < 86400 else dt.time(0)
    if epoch is _EPOCH and number < 60:
        number += 1  # there was no 29 February 1900, but the format has one
    return epoch + dt.timedelta(days=int(number), seconds=round(number % 1 * 86400))


def _value(cell, shared: list[str], dates: list[bool], epoch: dt.datetime):
    kind, text = cell.get("t", "n"), None
    for e in cell:
        if local(e.tag) == "v":
            text = e.text
        elif local(e.tag) == "is":
            return _rich_text(e)
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return text == "1"
    if kind in ("str", "e"):
        return text
    if kind == "d":
        return dt.datetime.fromisoformat(text)
    number = float(text) if re.search(r"[.eE]", text) else int(text)
    style = int(cell.get("s", 0))
    return _date(number, epoch) if style < len(dates) and dates[style] else number


def _column(reference: str | None, after: int) -> int:
    m = _REFERENCE.match(reference or "")
    if not m:
        return after
    n = 0
    for ch in m[1]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def rows(archive: Archive, name: str, shared, dates, epoch):
    """Lists of values of each row of a sheet; cells that are left out are None."""
    for kind, e in events(archive.open(name)):
        if kind == "end" and local(e.tag) == "row":
            out: list = []
            for cell in (c for c in e if local(c.tag) == "c"):
                at = _column(cell.get("r"), len(out))
                out += [None] * (at - len(out))
                out[at:] = [_value(cell, shared, dates, epoch)]
            yield out
            e.clear()


def parse(content: bytes) -> dict:
    archive = Archive(content)
    book = ElementTree.parse(archive.open("xl/workbook.xml")).getroot()
    epoch = _EPOCH_1904 if any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book) else _EPOCH
    links, shared, dates = _relations(archive, "xl/_rels/workbook.xml.rels"), _shared(archive), _date_styles(archive)
    lines, names, total = [], [], 0
    for sheet in (e for e in book.iter() if local(e.tag) == "sheet"):
        names.append(sheet.get("name"))
        lines.append(f"\n[Sheet: {names[-1]}]")
        target = links[next(v for k, v in sheet.attrib.items() if local(k) == "id")]
        for values in rows(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared, dates, epoch):
            cells = ["" if v is None else str(v) for v in values]
            if any(c.strip() for c in cells):
                lines.append("\t".join(cells))
                total += 1
    return {"text": "\n".join(lines), "page_count": len(names), "metadata": {"format": "xlsx", "sheets": names, "total_rows": total}}
