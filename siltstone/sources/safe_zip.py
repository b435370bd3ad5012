"""Members of an office file (a zip of XML) under limits, for untrusted input."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

#: Bytes that a member may expand to, and how much larger than its stored size.
MOST, RATIO = 512 << 20, 200
#: Nesting of elements.
DEPTH = 256


class TooLarge(ValueError):
    """A limit that a file of good faith doesn't reach; the file becomes an error record."""


class Archive:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def open(self, name: str):
        info = self.zip.getinfo(name)
        if info.file_size > MOST or (info.file_size > 1 << 20 and info.file_size > RATIO * max(1, info.compress_size)):
            raise TooLarge(f"{name} expands to {info.file_size} bytes, beyond {MOST} or {RATIO} times its stored size")
        return self.zip.open(info)


def events(stream):
    """(start or end, element) of an XML stream; too deep nesting and document types are refused."""
    depth = 0
    for kind, element in ElementTree.iterparse(stream, events=("start", "end")):
        depth += 1 if kind == "start" else -1
        if depth > DEPTH:
            raise TooLarge("XML is nested too deeply")
        yield kind, element


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]
