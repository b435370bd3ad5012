"""The data source against extract() on the same files; pushed filters, partitions, streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains, StringEndsWith

from siltstone.sources import office, records, samples

KEPT = ("filename", "stem", "suffix", "text", "page_count", "error", "metadata")


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "deep").mkdir(parents=True)
    files = {"a.docx": samples.docx(["one", "two"]), "deep/b.XLSX": samples.xlsx({"S": [[1, "x"]]}), "c.xml": b"<a><Record type='q' value='1'/></a>", "d.xml": b"<a><b>", "e.pdf": b"broken", "f.key": b"k", "g.txt": b"text", "noend": b"n", "h.pdf": samples.pdf([["a line"]]), ".hidden.pdf": b"", "_tmp": b""}
    for name, content in files.items():
        (at / name).write_bytes(content)
    return at


def test_rows_equal_those_of_extract(spark, folder):
    got = office.register(spark).read.format("office").load(f"file://{folder}")
    want = records.extract(records.read_files(spark, f"file://{folder}").where("not path like '%/.hidden%' and not path like '%/\\\\_tmp'"))
    rows = lambda df: sorted(map(repr, df.select("path", *KEPT).collect()))
    assert rows(got) == rows(want) and got.count() == 9
    assert rows(office.register(spark).read.format("office").load(str(folder))) == rows(want)  # a plain path, too
    assert {r.length for r in got.where("filename = 'g.txt'").collect()} == {4}


def test_filters_keep_files_closed(spark, folder):
    reader = office.OfficeReader(str(folder), 1 << 20)
    left = list(reader.pushFilters([In(("suffix",), (".pdf", ".xml")), StringEndsWith(("path",), ".pdf"), StringContains(("path",), "h")]))
    assert [type(f) for f in left] == [StringEndsWith, StringContains]  # Spark still looks at these
    assert {f.path.rsplit("/", 1)[1] for p in reader.partitions() for f in p.files} == {"e.pdf", "h.pdf"}
    one = office.OfficeReader(str(folder), 1 << 20)
    assert list(one.pushFilters([EqualTo(("suffix",), ".xlsx")])) == []
    assert [f.path.rsplit("/", 1)[1] for p in one.partitions() for f in p.files] == ["b.XLSX"]
    df = office.register(spark).read.format("office").load(str(folder))
    assert [r.filename for r in df.where(F.col("suffix").isin(".pdf") & F.col("path").endswith("h.pdf")).collect()] == ["h.pdf"]
    assert df.where("suffix = '.nothing'").count() == 0


def test_partitions_by_bytes():
    files = [office.File(f"/f{i:03}", 1000 * i, i) for i in range(50)]
    parts = office.dealt(files, 400_000)
    assert sorted(f.path for p in parts for f in p.files) == [f.path for f in files]
    assert all(sum(f.length + 65_536 for f in p.files) <= 400_000 or len(p.files) == 1 for p in parts) and len(parts) > 10
    assert [len(p.files) for p in office.dealt([office.File("/x", 1 << 40, 0)], 10)] == [1] and office.dealt([], 10) == []


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    office.register(spark)

    def run():
        q = spark.readStream.format("office").load(str(folder)).select("path", "text", "error").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run() == 9
    assert run() == 9
    (folder / "later.docx").write_bytes(samples.docx(["three"]))
    assert run() == 10


def test_a_path_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere|path"):
        office.register(spark).read.format("office").load(f"{tmp_path}/nowhere").count()
    with pytest.raises(Exception, match="needs a path"):
        office.register(spark).read.format("office").load().count()
