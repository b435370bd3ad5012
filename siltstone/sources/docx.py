"""Word files: body paragraphs, then tables; a plainer stream of paragraphs if that fails."""

from __future__ import annotations

from xml.etree import ElementTree

from siltstone.sources.safe_zip import Archive, TooLarge, events, local

_BODY, _STYLES = "word/document.xml", "word/styles.xml"
#: Element names of a run's contents that stand for text of their own.
_SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def _attribute(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def _text(paragraph) -> str:
    out = []
    for e in paragraph.iter():
        tag = local(e.tag)
        if tag == "t":
            out.append(e.text or "")
        elif tag in _SIGNS and not (tag == "tab" and _attribute(e, "pos")):
            out.append(_SIGNS[tag])
    return "".join(out)


def _style_names(archive: Archive) -> dict[str, str]:
    names = {}
    if _STYLES in archive.names:
        for style in ElementTree.parse(archive.open(_STYLES)).getroot():
            if local(style.tag) == "style":
                name = next((_attribute(c, "val") for c in style if local(c.tag) == "name"), None)
                names[_attribute(style, "styleId")] = name or ""
    return names


def _heading(paragraph, names: dict[str, str]) -> bool:
    for e in paragraph.iter():
        if local(e.tag) == "pStyle":
            style = _attribute(e, "val") or ""
            return names.get(style, style).lower().startswith("heading")
    return False


def structured(content: bytes) -> list[str]:
    """Stripped paragraphs of the body (headings marked), then its tables as tab-joined rows."""
    archive = Archive(content)
    names = _style_names(archive)
    body = next(e for e in ElementTree.parse(archive.open(_BODY)).getroot() if local(e.tag) == "body")
    parts, tables = [], []
    for e in body:
        if local(e.tag) == "p":
            text = _text(e).strip()
            if text:
                parts.append(f"\n## {text}\n" if _heading(e, names) else text)
        elif local(e.tag) == "tbl":
            tables.append(e)
    for t in tables:
        rows = []
        for row in (r for r in t if local(r.tag) == "tr"):
            cells = ["\n".join(_text(p) for p in c if local(p.tag) == "p").strip() for c in row if local(c.tag) == "tc"]
            if any(cells):
                rows.append("\t".join(cells))
        if rows:
            parts.append("\n".join(rows))
    return parts


def stream(content: bytes) -> list[str]:
    """Every non-empty paragraph in document order, of any namespace; where the file breaks off, those that ended before."""
    paragraphs = [""]
    try:
        for e in (e for kind, e in events(Archive(content).open(_BODY)) if kind == "end"):
            name = local(e.tag) if "}" in e.tag else ""
            paragraphs[-1] += e.text or "" if name == "t" else ""
            if name == "p" and paragraphs[-1]:
                paragraphs.append("")
            e.clear()
    except TooLarge:
        raise
    except Exception:  # noqa: BLE001  the last resort: whatever fails leaves what was read
        pass
    return paragraphs[:-1]


def parse(content: bytes) -> dict:
    try:
        parts = structured(content)
    except TooLarge:
        raise
    except Exception:  # noqa: BLE001  any fault of the structured reader
        parts = stream(content)
    return {"text": "\n\n".join(parts), "page_count": 1, "metadata": {"format": "docx"}}
