"""XML files: health records line by line, other elements by their text, children before parents."""

from __future__ import annotations

import io
from xml.etree import ElementTree

from siltstone.sources.safe_zip import events

#: Record types that a result lists.
TYPES = 10


def _line(e) -> str | None:
    day = e.get("startDate", "")[:10]
    if e.tag == "Record":
        unit = e.get("unit", "")
        return f"{e.get('type', 'Unknown')}: {e.get('value', '')}" + (f" {unit}" if unit else "") + (f" ({day})" if day else "")
    if e.tag == "Workout":
        return f"Workout: {e.get('workoutActivityType', 'Unknown')} - {e.get('duration', '')}min ({day})"
    return (e.text or "").strip() or None


def parse(content: bytes) -> dict:
    """Text, one line a record; a file that breaks off keeps the lines so far and has an error. record_types are sorted."""
    lines, types, count = [], set(), 0
    try:
        for kind, e in events(io.BytesIO(content)):
            if kind == "start":
                continue
            line = _line(e)
            if e.tag in ("Record", "Workout"):
                count += 1
                if e.tag == "Record":
                    types.add(e.get("type", "Unknown"))
            if line is not None:
                lines.append(line)
                e.clear()
    except ElementTree.ParseError as e:
        return {"error": f"XML parse error: {e}", "text": "\n".join(lines), "page_count": 1, "metadata": {"format": "xml", "partial": True}}
    return {"text": "\n".join(lines), "page_count": 1, "metadata": {"format": "xml", "record_count": count, "record_types": sorted(types)[:TYPES]}}
