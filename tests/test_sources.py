import io
import tracemalloc
import zipfile

import pytest

from siltstone.sources import pdf, records, samples


def parse(content, suffix):
    return records.parse_bytes(content, suffix)


def test_xml_lines_and_order():
    x = parse(b'<HealthData><Record type="HR" value="72" unit="bpm" startDate="2024-01-01 10:00"/><Record type="Steps" value="5"/><Workout workoutActivityType="Run" duration="30" startDate="2024-01-02 1"/><note> hi </note></HealthData>', ".xml")
    assert x["text"].split("\n") == ["HR: 72 bpm (2024-01-01)", "Steps: 5", "Workout: Run - 30min (2024-01-02)", "hi"]
    assert x["metadata"]["record_count"] == 3 and x["metadata"]["record_types"] == ["HR", "Steps"] and x["error"] is None
    assert parse(b"<a>x<b>y</b></a>", ".xml")["text"] == "y\nx"


def test_xml_partial():
    x = parse(b'<a><Record type="q" value="1"/><Rec', ".xml")
    assert x["error"].startswith("XML parse error: ") and x["text"] == "q: 1" and x["metadata"]["partial"]


def test_xml_too_deep_is_an_error():
    assert "deep" in parse(b"<a>" * 400 + b"</a>" * 400, ".xml")["error"]


def test_docx_both_readers():
    x = parse(samples.docx([("Heading1", "T"), " a ", ""], [[["c", "d"], ["", " "]]]), ".docx")
    assert x["text"] == "\n## T\n\n\na\n\nc\td" and x["page_count"] == 1
    assert parse(samples.docx([" a", "", "b"], broken=True), ".docx")["text"] == " a\n\nb"
    assert parse(b"no zip", ".docx")["text"] == ""


def test_xlsx_cells():
    x = parse(samples.xlsx({"S": [["a", 1, 1.5, None, True], [None], ["  "], [None, "z"]], "T": []}), ".xlsx")
    assert x["text"] == "\n[Sheet: S]\na\t1\t1.5\t\tTrue\n\tz\n\n[Sheet: T]"
    assert x["page_count"] == 2 and x["metadata"]["total_rows"] == 2 and x["metadata"]["sheets"] == ["S", "T"]


def test_large_workbook():
    """Ten thousand rows within a few times the size of their text."""
    book = samples.xlsx({"S": [[i, i * 37 % 1001, f"item {i % 97}", i % 2 == 0] for i in range(10_000)]})
    tracemalloc.start()
    x = parse(book, ".xlsx")
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert x["metadata"]["total_rows"] == 10_000 and x["text"].endswith("\n9999\t594\titem 8\tFalse")
    assert peak < 60 << 20


def test_docx_that_breaks_off_keeps_what_ended():
    whole = samples.docx(["one", "two", "three"])
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        body = z.read("word/document.xml").decode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body[: body.index("three") + 2])
    x = parse(out.getvalue(), ".docx")
    assert x["text"] == "one\n\ntwo" and x["error"] is None


def test_file_above_the_limit_is_an_error_record(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xml").write_bytes(b"<a>small</a>")
    (tmp_path / "b.xml").write_bytes(b"<a>" + b"large " * 100 + b"</a>")
    monkeypatch.setattr(records, "MAX_FILE", 100)
    got = {r.filename: r for r in records.extract(records.read_files(spark, str(tmp_path))).collect()}
    assert got["a.xml"].text == "small" and got["b.xml"].error.startswith("Extraction failed: ")


def test_pdf_pages():
    x = parse(samples.pdf([["Hello (x) \\ world", "second"], [], ["third"]]), ".pdf")
    assert x["text"] == "[Page 1]\n\nHello (x) \\ world\nsecond\n\n[Page 3]\n\nthird" and x["page_count"] == 3


def test_pdf_tables():
    x = parse(samples.pdf([["Title"], ["more"]], {0: [["name", "n"], ["a (b)", "1"], ["", "2"]], 1: [["alone"]]}), ".pdf")
    assert x["metadata"]["tables_found"] == 1 and x["text"].endswith("name\tn\na (b)\t1\n\t2\n\n[Page 2]\n\nmore\nalone")
    assert x["text"].startswith("[Page 1]\n\nTitle\nname")


def test_ruled_tables_by_lines():
    """Lines drawn apart, a cell that spans two columns, a scaled view, and a rectangle that is no table."""
    draw = b"q 2 0 0 2 0 0 cm 10 10 m 110 10 l S 10 30 m 60 30 l S 60 30 m 110 30 l S 10 50 m 110 50 l S 10 10 m 10 50 l S 110 10 m 110 50 l S 60 10 m 60 30 l S "
    text = b"BT /F1 8 Tf 12 35 Td (wide) Tj ET BT /F1 8 Tf 12 15 Td (left) Tj ET BT /F1 8 Tf 62 15 Td (right) Tj ET Q 300 300 50 50 re S 400 400 9 9 re n"
    strings, lines = pdf.shown(pdf.parse_values(draw + text), {})
    assert pdf.ruled_tables(lines, strings) == [[["wide", None], ["left", "right"]]]
    assert pdf.ruled_tables([], strings) == []


@pytest.mark.parametrize("suffix", [".pdf", ".xlsx"])
def test_garbage_is_an_error_record(suffix):
    assert parse(b"garbage", suffix)["error"].startswith("Extraction failed: ")


def test_router(spark):
    rows = [("/a/x.PAGES", b""), ("/a/x.txt", b""), ("/a/x", b""), ("/a/x.xml", None), ("/a/y.xml", b"<a>t</a>")]
    out = {r.path: r for r in records.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["/a/x.PAGES"].error == "Pages - use PDF export"
    assert out["/a/x.txt"].error == "Unsupported format: .txt. Supported: ['.pdf', '.docx', '.xlsx', '.xml']"
    assert out["/a/x"].error.startswith("Unsupported format: . ")
    assert out["/a/x.xml"].error.startswith("Extraction failed: ")
    assert out["/a/y.xml"].text == "t" and out["/a/y.xml"].stem == "y" and out["/a/y.xml"].metadata.format == "xml"


def test_a_drawing_keeps_its_tables_and_a_hatched_page_is_marked():
    import time

    grid = [(0, y, 100, y) for y in (0, 20, 40)] + [(x, 0, x, 40) for x in (0, 50, 100)]
    strings = [(30, 5, 8, "a"), (30, 55, 8, "b"), (10, 5, 8, "c"), (10, 55, 8, "d")]
    # three thousand lines each way that never meet: nine million pairs
    apart = [(200, 100 + 5 * k, 300, 100 + 5 * k) for k in range(3000)] + [(400 + 5 * k, 0, 400 + 5 * k, 50) for k in range(3000)]
    began = time.perf_counter()
    assert pdf.ruled_tables(grid + apart, strings) == [[["a", "b"], ["c", "d"]]]
    assert time.perf_counter() - began < 5
    hatched = [(0, 5 * k, 5000, 5 * k) for k in range(600)] + [(5 * k, 0, 5 * k, 5000) for k in range(600)]
    with pytest.raises(pdf.Hatched):
        pdf.ruled_tables(hatched, [])


def test_a_word_file_beyond_the_limits_is_an_error(monkeypatch):
    from siltstone.sources import safe_zip

    monkeypatch.setattr(safe_zip, "MOST", 100)
    x = parse(samples.docx(["some words " * 50]), ".docx")
    assert x["error"].startswith("Extraction failed: word/document.xml expands to") and x["text"] == ""
