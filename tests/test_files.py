"""Files as a source of facts and as a sink: large files in ranges, all or nothing on failure."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio.operators import exports, ingest, records
from folio.sources import files


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path).partition("/")[2] for d, _, some in os.walk(path) for f in some)


def test_ranges_of_files_count_as_the_whole(spark, tmp_path):
    texts = {"a": b"", "b/c": b"xstartxref" * 50, "b/d": b"start" + b"\xff" * 300 + b"aaaa", "e": b"%PDF-1.4 /Prev" + b"z" * 5_000 + b"startxref %%EOF\n \n"}
    os.makedirs(tmp_path / "b")
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "_hidden").write_bytes(b"x")
    for part in (50, 1_000, 10_000):
        facts = {os.path.relpath(r.path, tmp_path): r for r in files.file_facts(spark, str(tmp_path), 5, 4, ("startxref", "aa", "/Prev"), part).collect()}
        assert set(facts) == set(texts)
        for name, raw in texts.items():
            r = facts[name]
            assert (r.byte_length, bytes(r.head), bytes(r.tail)) == (len(raw), raw[:5], raw[-4:] if raw else b"")
            assert r.counts == [raw.count(b"startxref"), sum(raw[i : i + 2] == b"aa" for i in range(len(raw))), raw.count(b"/Prev")]
    triaged = {os.path.relpath(r.path, tmp_path): r for r in ingest.triage_folder(spark, str(tmp_path)).collect()}
    assert triaged["e"].valid and triaged["e"].previous_xref and triaged["e"].incremental_updates == 1
    assert triaged["a"].errors == ["empty-file", "missing-header", "missing-eof"] and not triaged["a"].encrypted


def test_a_large_file_is_read_in_blocks(tmp_path, monkeypatch):
    with open(tmp_path / "big", "wb") as out:
        out.seek(1 << 30)
        out.write(b"startxref %%EOF")
    reader = files._FactsReader({"path": str(tmp_path), "tokens": '["startxref"]', "tail": "16"})
    parts = reader.partitions()
    assert len(parts) == 9 and all(e - b <= files.PART for p in parts for _, _, b, e in p.parts)
    last = list(reader.read(parts[-1]))
    assert last[0][3].endswith(b"%%EOF") and last[0][4] == [1]
    read, _ = [], reader
    real = files._files(str(tmp_path))[0].open_input_file(str(tmp_path / "big"))

    class Spy:
        def read_at(self, n, at):
            read.append(n)
            return real.read_at(n, at)

    assert reader._count(Spy(), 0, 8 << 20, 1 << 30) == [0] and max(read) <= files.BLOCK + 8


def test_files_round_trip_and_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"é {i}\r\n\n") for i in range(40)] + [("empty", None)], "name string, body string").repartition(4)
    path = str(tmp_path / "out")
    files.write_files(rows, path)
    assert {(r.name, r.body or "") for r in files.read_texts(spark, path).collect()} >= {(r.name, r.body) for r in rows.where("body is not null").collect()}
    assert len(names(path)) == 41 and not [n for n in os.listdir(path) if n.startswith("_")]
    files.write_files(rows.where("name like 'd0%'"), path, "overwrite")
    assert names(path) == sorted(r.name for r in rows.where("name like 'd0%'").collect())


@pytest.mark.parametrize("bad", ["../up", "a//b", "_x", "", "same"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    files.write_files(spark.createDataFrame([("kept", "1")], "name string, body string"), path)
    rows = spark.createDataFrame([("same", "1"), (bad, "2")] + [(f"g{i}", "x") for i in range(30)], "name string, body string").coalesce(1)
    with pytest.raises(PySparkException):
        files.write_files(rows, path)
    assert names(path) == ["kept"] and len(os.listdir(path)) == 1


def test_chunks_with_missing_pages_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 8)], "doc_id long, page_number int, text string")
    got = exports.save_chunks(pages, 3, str(tmp_path / "ok"))
    assert sorted((r.chunk, r.name, r.page_count) for r in got.collect()) == [(0, "pages-0001-0003", 3), (1, "pages-0004-0006", 3), (2, "pages-0007-0007", 1)]
    assert names(str(tmp_path / "ok")) == ["1/pages-0001-0003.txt", "1/pages-0004-0006.txt", "1/pages-0007-0007.txt"]
    with pytest.raises(PySparkException):
        exports.save_chunks(pages.where("page_number <> 2"), 3, str(tmp_path / "torn"))
    assert names(str(tmp_path / "torn")) == []


def test_receipts_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([("k", 'a"b,\nc', None, 5, "s", "/r", "1")], "kind string, filename string, mime_type string, byte_length long, sha256 string, route string, release string").withColumn("created_at", F.timestamp_millis(F.lit(1704067200123))).coalesce(1)
    records.save_receipts(rows, str(tmp_path / "csv"))
    (file,) = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert (tmp_path / "csv" / file).read_text() == '"created_at","kind","filename","mime_type","byte_length","sha256","route","release"\n"2024-01-01T00:00:00.123Z","k","a""b,\nc","","5","s","/r","1"\n'


def test_the_driver_lists_folders_only(spark, tmp_path):
    """Reading texts takes a task for each task that wrote, whatever the number of files."""
    rows = spark.range(300).selectExpr("concat(id % 50, '/', id, '.txt') as name", "concat('t', id) as body").repartition(3)
    path = str(tmp_path / "out")
    files.write_files(rows, path)
    found = files.read_texts(spark, path)
    assert found.rdd.getNumPartitions() == 3 and {(r.name, r.body) for r in found.collect()} == {(r.name, r.body) for r in rows.collect()}
