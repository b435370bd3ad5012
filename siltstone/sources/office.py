"""Office files as a Spark data source: `spark.read.format("office").load(folder)`.

Files are listed by the driver and dealt to partitions by bytes. A filter on
`suffix` (or on how `path` ends) reaches the list, so files that it excludes are
never opened. As a stream, a file is new if its time and path lie behind the
last offset; each is read once, whatever restarts lie between.

Paths are those of file systems that pyarrow.fs knows (local, HDFS, S3, GCS).
For a path that only Spark reads, use records.read_files(). Files without a byte
are rows here, which Spark's own binaryFile leaves out.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith

from siltstone.schemas import EXTRACTED
from siltstone.sources import records

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("filename", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("suffix", T.StringType()), *EXTRACTED.fields])
META = [f.name for f in EXTRACTED["metadata"].dataType.fields]
#: Bytes of files that a partition reads, about; a file of its own may have more.
PARTITION = 64 << 20


def suffix(path: str) -> str:
    """As native.suffix()."""
    m = re.search(r"(?<=[^/])(\.[^./]+)$", path)
    return m[1].lower() if m else ""


def refusal(end: str) -> str | None:
    """The message for a suffix that isn't read, as records.route_error() has it."""
    if end in records.REFUSED:
        return records.REFUSED[end]
    if end not in records.SUPPORTED:
        return f"Unsupported format: {end}. Supported: [{', '.join(map(repr, records.SUPPORTED))}]"
    return None


@dataclass(frozen=True)
class File:
    path: str
    length: int
    modified: int  # microseconds since 1970


@dataclass
class Files(InputPartition):
    files: list[File]


def listed(uri: str) -> list[File]:
    """All files at or below a path, by time and path; hidden ones (`_` or `.` first, in any part below) are left out."""
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    shown = (f for f in found if f.type == pafs.FileType.File and not any(p[:1] in ("_", ".") for p in f.path[len(path) :].split("/") if f is not info))
    return sorted((File(f.path, f.size, (f.mtime_ns or 0) // 1000) for f in shown), key=lambda f: (f.modified, f.path))


def dealt(files: list[File], most: int) -> list[Files]:
    """Partitions of about `most` bytes; each file counts a little of its own, as opening it costs."""
    out, size = [], 0
    for f in sorted(files, key=lambda f: f.path):
        cost = f.length + 65_536
        if not out or size + cost > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += cost
    return out


def parsed(uri: str, files: list[File]) -> Iterator[tuple]:
    """A row of SCHEMA for each file; one that can't be read, or is too large, is an error record."""
    fs = pafs.FileSystem.from_uri(uri)[0] if "://" in uri or uri.startswith("file:") else pafs.LocalFileSystem()
    for f in files:
        end = suffix(f.path)
        message = refusal(end)
        if message:
            record = {"text": "", "page_count": 0, "error": message, "metadata": {"format": end}}
        else:
            try:
                content = fs.open_input_file(f.path).read() if f.length <= records.MAX_FILE else None
                record = records.parse_bytes(content, end)
            except OSError as e:
                record = {"text": "", "page_count": 0, "error": f"Extraction failed: {e}", "metadata": {"format": end}}
        name = f.path.rstrip("/").rsplit("/", 1)[-1]
        meta = record["metadata"]
        at = datetime.datetime.fromtimestamp(f.modified / 1e6, datetime.UTC)
        yield (f.path, f.length, at, name, re.sub(r"(?<=.)\.[^./]+$", "", name), end, record["text"], record["page_count"], record["error"], tuple(meta.get(k) for k in META))


class OfficeReader(DataSourceReader):
    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most
        self.ends: list[set[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what tells files by their suffix; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                self.ends.append({f.value})
            elif isinstance(f, In) and f.attribute == ("suffix",):
                self.ends.append(set(f.value))
            else:
                if isinstance(f, StringEndsWith) and f.attribute == ("path",) and re.fullmatch(r"\.[^./]+", f.value):
                    self.ends.append({f.value.lower()})  # Spark tells upper and lower case
                yield f

    def partitions(self) -> list[Files]:
        return dealt([f for f in listed(self.uri) if all(suffix(f.path) in e for e in self.ends)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return parsed(self.uri, partition.files if partition else [])  # without partitions there is one call with None


class OfficeStreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file. A file that comes with an older time than one read before is not seen."""

    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.uri)
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["modified"], o["path"])
        return dealt([f for f in listed(self.uri) if key(start) < (f.modified, f.path) <= key(end)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return parsed(self.uri, partition.files if partition else [])  # without partitions there is one call with None

    def commit(self, end: dict) -> None:
        pass


class OfficeFiles(DataSource):
    """Options: path (load()'s), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> T.StructType:
        return SCHEMA

    def _where(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("format office needs a path")
        return self.options["path"], int(self.options.get("partitionBytes", PARTITION))

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(*self._where())

    def streamReader(self, schema) -> OfficeStreamReader:
        return OfficeStreamReader(*self._where())


def register(spark: SparkSession) -> SparkSession:
    """Let the session read format "office", filters reaching the list of files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeFiles)
    return spark
