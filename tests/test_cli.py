"""The command line, from files to hits."""

import json

import pytest

from siltstone import cli
from siltstone.sources import samples


@pytest.fixture
def own(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)


def test_ingest_search_stats(own, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(samples.pdf([["cooking pasta at home"], ["boil the water"]]))
    (tmp_path / "b.docx").write_bytes(samples.docx(["dogs bark " * 40]))
    out = str(tmp_path / "out")
    assert cli.main(["ingest", "-i", str(tmp_path / "a.pdf"), str(tmp_path / "b.docx"), "-o", out, "-v"]) == 0
    said = capsys.readouterr().out
    assert f"{'Total Chunks':<22} 1" in said and "Results saved to: " in said and "Errors                 -" in said
    rows = json.loads((tmp_path / "out" / "ingestion_result.json").read_text())
    assert [r["file"] for r in rows] == [str(tmp_path / "a.pdf"), str(tmp_path / "b.docx")]
    assert [r["chunk_ids"] for r in rows] == [["a_0000"], ["b_0000"]] and all(r["errors"] == [] and r["vectors_stored"] == 1 for r in rows)
    assert all(r["processing_time_sec"] > 0 and r["memory_mb"] > 0 for r in rows) and rows[0]["pages_per_sec"] > 0
    assert cli.main(["search", "-q", "pasta cooking", "-k", "1", "-d", f"{out}/vectors"]) == 0
    said = capsys.readouterr().out
    assert said.startswith("Result 1 (Score: 0.") and "cooking pasta at home" in said and "ID: a_0000" in said and "Result 2" not in said
    assert cli.main(["search", "-q", "dogs bark", "-d", f"{out}/vectors"]) == 0
    said = capsys.readouterr().out
    assert "[green]" in said.splitlines()[0] and "..." in said
    assert cli.main(["stats", "-d", f"{out}/vectors"]) == 0
    assert [x.split() for x in capsys.readouterr().out.splitlines()][:2] == [["Total", "Chunks", "2"], ["Total", "Vectors", "2"]]


def test_one_file_and_errors(own, tmp_path, capsys):
    (tmp_path / "x.key").write_bytes(b"")
    assert cli.main(["ingest", "-i", str(tmp_path / "x.key"), "-o", str(tmp_path / "out")]) == 1
    row = json.loads((tmp_path / "out" / "ingestion_result.json").read_text())
    assert row["total_chunks"] == 0 and row["errors"] == ["Extraction error: Keynote - use PDF export"]
    assert "Keynote" in capsys.readouterr().out
    assert cli.main(["search", "-q", "x", "-d", str(tmp_path / "none")]) == 2 and cli.main(["stats", "-d", str(tmp_path / "none")]) == 2
    assert "no store at" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["search"])
