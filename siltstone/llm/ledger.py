"""Secret scans (13): an incremental ledger of blobs.

Every version of every text is named by the SHA-256 of its bytes: its blob. The
ledger is a folder of Parquet files; a row says which versions of which rules a
blob has been scanned with and what they found. A scan sends one copy of each
blob from each task to the task that its name is dealt to, leaves out the pairs
of blob and rule version that the ledger has, runs the rest, appends them, and
joins the findings of the whole ledger back to all places that hold the blob.
So copies, unchanged versions and unchanged rules cost a hash each, and a new
rule runs alone.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, new_path, prepare, text_bytes


class Rule(NamedTuple):
    """A pattern whose leftmost matches, none within another one, are findings where `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        """Changes with anything that changes what the rule finds."""
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end (exclusive) in code points."""
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


def either(word: str) -> str:
    """A pattern of a word whose ASCII letters stand in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
#: Rules whose findings are counted and digested; lower bounds within a pattern drop what a match of the whole run would.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the base rules don't name: private key headers, web tokens, tokens with a prefix, credentials in addresses.
MORE = (
    Rule("pem", r"-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("address", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\x00-\x20/:@]{3,128}@"),
)
RULES = BASE + MORE

_FOUND = "array<struct<version:string,start:int,end:int>>"
LEDGER = f"blob binary, versions array<string>, found {_FOUND}"


def blob(text: Column) -> Column:
    """The name of a text: SHA-256 of its UTF-8 bytes; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read(spark, path: str) -> DataFrame:
    """blob, versions, found: one row a blob, of all scans so far; pairs that two scans ran at once count once."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path).groupBy("blob")
    return rows.agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def _once(docs: DataFrame, text: str) -> DataFrame:
    """blob, text: each different text once a task."""

    def task(batches):
        met = set()
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            raw = memoryview(data)
            names, rows = [], []
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                name = hashlib.sha256(raw[a:b]).digest()
                if name not in met:
                    met.add(name)
                    names.append(name)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.string())], ["blob", "text"])

    return docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(task, "blob binary, text string")


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Run all pairs of a blob of docs and a version of `rules` that the ledger at `path` lacks, and append them to it.

    Null is the empty text; whole texts are scanned, however long. A scan that
    is lost half-way leaves the ledger as it was; two scans at once may both
    run a pair, which then counts once. An empty table adds nothing.
    """
    spark = prepare(docs.sparkSession)
    wanted = [r.version for r in rules]
    rows = _once(docs, text)
    seen = read(spark, path)
    if seen.isEmpty():
        rows = rows.withColumn("versions", F.lit(wanted)).repartition("blob")
    else:
        have = seen.select(F.col("blob").alias("_blob"), F.col("versions").alias("_have"))
        left = F.array_except(F.lit(wanted), F.coalesce("_have", F.array().cast("array<string>")))
        rows = rows.join(have, F.col("blob") == F.col("_blob"), "left").select("blob", "text", left.alias("versions")).where(F.size("versions") > 0).repartition("blob")
    by = {r.version: r for r in rules}

    def task(batches):
        met = set()
        for batch in batches:
            names, versions, found = [], [], []
            for name, content, todo in zip(*(batch.column(c) for c in ("blob", "text", "versions")), strict=True):
                if (name := name.as_py()) in met:
                    continue
                met.add(name)
                content, todo = content.as_py(), todo.as_py()
                names.append(name)
                versions.append(todo)
                found.append([{"version": v, "start": a, "end": b} for v in todo for a, b in by[v].spans(content)])
            kinds = pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(versions, pa.list_(pa.string())), pa.array(found, kinds)], ["blob", "versions", "found"])

    rows.mapInArrow(task, LEDGER).write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with blob and found (kind, start, end; by start, then kind as listed), for every row of docs, from the ledger alone.

    Call scan() before. A row whose blob was never scanned with a rule has no
    findings of it. Findings are in no row of docs' own: equal texts at any
    number of places share them. A hot blob is a skewed join of narrow rows
    that Spark splits. Columns of docs called blob or found are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "blob", "found")]
    (name,) = fresh(docs, 1)
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))))
    kind = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.filter("found", lambda s: F.array_contains(F.lit([r.version for r in rules]), s["version"]))
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["version"]].alias("rule"), s["end"].alias("end"))))
    hits = read(docs.sparkSession, path).where(F.size("found") > 0).select(F.col("blob").alias(name), F.transform(spans, lambda s: F.struct(kind[s["rule"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    places = docs.select(*kept, blob(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return places.join(hits, F.col("blob") == F.col(name), "left").select(*kept, "blob", F.coalesce("found", none).alias("found"))


def op13(docs: DataFrame) -> DataFrame:
    """The digest of a scan of documents into a new ledger: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    path = new_path(docs.sparkSession, "ledger")
    rows = docs.select("doc_id", "text")
    scan(rows, path)
    got = findings(rows, path)
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256)
    return got.select("doc_id", *map(count, base), digest.alias("base_sha256"), joined("found").alias("spans"))
