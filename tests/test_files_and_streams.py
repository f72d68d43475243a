"""Readers, writers and streams over small files that the tests write."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers, writers
from lodestone.streaming import jobs


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿id,name,license\n1, Ann ,\n2,\"a,b\",CC0\n".encode())
    df = readers.manifest(spark, str(tmp_path / "m.csv"), ("id", "name"), {"license": "unknown", "split": "train"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "Ann", "unknown", "train"), ("2", "a,b", "CC0", "train")]
    with pytest.raises(ValueError, match="missing"):
        readers.manifest(spark, str(tmp_path / "m.csv"), ("nope",))


def test_lists(spark, tmp_path):
    (tmp_path / "a.smi").write_bytes("CCO  ethanol pure\n# no\n\nCC\r\nN \n".encode())
    rows = readers.line_list(spark, str(tmp_path / "a.smi")).orderBy("line_number").collect()
    assert [(r.line_number, r.value, r.name) for r in rows] == [(1, "CCO", "ethanol pure"), (4, "CC", "row_4"), (5, "N", "row_5")]
    (tmp_path / "b.csv").write_bytes("ID;SMILES\nx;CCO\ny;\n;CC\n".encode())
    (tmp_path / "c.csv").write_bytes("结构,甲\nCCC,乙\n".encode("gb18030"))
    got = {(r.source, r.line_number, r.value, r.name) for f in "bc" for r in readers.delimited_list(spark, str(tmp_path / f"{f}.csv")).collect()}
    assert got == {("b.csv", 2, "CCO", "x"), ("b.csv", 4, "CC", "row_4"), ("c.csv", 1, "结构", "row_1"), ("c.csv", 2, "CCC", "row_2")}


def test_json_and_checksums(spark, tmp_path):
    (tmp_path / "m1_metrics.json").write_text(json.dumps({"valid_rate": 0.5}))
    (tmp_path / "other.json").write_text("{}")
    assert [(r.backend, r.valid_rate) for r in readers.metrics_files(spark, str(tmp_path)).collect()] == [("m1", 0.5)]
    audits = tmp_path / "audits"
    audits.mkdir()
    for name, text in (("a", '{"sample_id": "s", "v": 1}'), ("b", '{"sample_id": "s", "v": 2}'), ("c", "{broken")):
        (audits / f"{name}.json").write_text(text)
    assert [(r.sample_id, r.v) for r in readers.audits(spark, str(audits)).collect() if r.sample_id] == [("s", 2)]
    note = {"pages": {"p1": {"source_document": "d", "page_number": 1, "width": 10, "height": 20, "annotations": [{"class": "molecule", "bbox": [1, 2, 3, 4]}]}}}
    (tmp_path / "n.json").write_text(json.dumps(note))
    assert tuple(readers.page_annotations(spark, str(tmp_path / "n.json")).first()) == ("p1", "d", 1, 10, 20, "molecule", 1, 2, 3, 4)
    sums = {r.name: r.sha256 for r in readers.file_checksums(spark, str(tmp_path), "*.json").collect()}
    (tmp_path / "sums.txt").write_text("".join(f"{s}  {n}\n" for n, s in sums.items()))
    assert {r.name: r.sha256 for r in readers.checksum_list(spark, str(tmp_path / "sums.txt")).collect()} == sums


def test_small_files_lie_in_folders(spark, tmp_path):
    rows, path = spark.range(600), str(tmp_path / "audits")
    writers.small_files(rows, path, F.format_string("a%d.json", "id"), F.format_string('{"sample_id": %d, "v": "é"}', "id"), per_folder=50)
    (tmp_path / "audits" / "broken.json").write_text('{"sample_id": 1, "v')
    held = [len(list(f.iterdir())) for f in (tmp_path / "audits").iterdir() if f.is_dir()]
    assert sum(held) == 600 and len(held) > 8 and max(held) < 100
    assert sorted(tuple(r)[:2] for r in readers.audits(spark, path, schema="sample_id long, v string").collect()) == [(i, "é") for i in range(600)]


def test_checksums_of_many_files_come_in_few_parts(spark, tmp_path):
    writers.small_files(spark.range(300), str(tmp_path), F.format_string("part-%d", "id"), F.format_string("%d\n", "id"), per_folder=10)
    sums = readers.file_checksums(spark, str(tmp_path), "part-*")
    assert {(r.name, r.size, r.sha256) for r in sums.collect()} == {(f"part-{i}", len(f"{i}\n"), hashlib.sha256(f"{i}\n".encode()).hexdigest()) for i in range(300)}
    sums.write.parquet(str(tmp_path / "sums"))
    assert len(list((tmp_path / "sums").glob("*.parquet"))) == 1


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.png", b"abc")
        z.writestr("../up.png", b"abc")
        z.writestr("zeros.bin", b"0" * 2_000_000)
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    got = {(r.archive, r.entry): r.code for r in readers.archive_entries(spark, str(tmp_path)).collect()}
    assert got == {("a.zip", "ok.png"): "", ("a.zip", "../up.png"): "unsafe_path", ("a.zip", "zeros.bin"): "odd_ratio", ("b.zip", ""): "bad_archive"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "new"), (2, "b", "done")], "id long, name string, status string")
    writers.csv_table(df, str(tmp_path / "csv"), ["name", "id", "extra"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["name", "id", "extra"]
    writers.named_list(df, str(tmp_path / "list"), "id", "name")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "list")).collect()) == ["1\ta", "2\tb"]
    writers.routed(df, str(tmp_path / "routes"), {"all": F.lit(True), "done": F.col("status") == "done"})
    assert [spark.read.parquet(str(tmp_path / "routes" / k)).count() for k in ("all", "done")] == [2, 1]
    writers.by_status(df, str(tmp_path / "parts"), "status")
    assert spark.read.parquet(str(tmp_path / "parts")).where("status = 'new'").count() == 1
    for _ in range(2):
        writers.json_lines(df, str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert writers.snapshot(df, df.limit(0), str(tmp_path / "frozen")).count() >= 1
    with pytest.raises(ValueError, match="remain"):
        writers.snapshot(df, df, str(tmp_path / "frozen2"))
    with pytest.raises(Exception, match="exist"):
        writers.snapshot(df, df.limit(0), str(tmp_path / "frozen"))
    assert writers.united(df, df.select("id")).columns == df.columns
    assert writers.guarded(df, ("id",), F.col("status") == "odd") is df
    with pytest.raises(ValueError, match="must not"):
        writers.guarded(df, ("id",), F.col("status") == "new")


def test_streams_in_many_batches_equal_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartitionByRange(5, "event_id").write.parquet(str(tmp_path / "events"))
    stream = lambda: jobs.events(spark, str(tmp_path / "events"))
    assert {tuple(r) for r in jobs.job_machine(stream()).collect()} == {tuple(r) for r in jobs.job_machine_batch(rows).collect()}
    assert jobs.latest_states(stream()).count() == rows.select("user_id").distinct().count()
    late = jobs.late(rows, "event_id", 600, 10)
    assert late.agg(F.sum("n")).first()[0] == rows.count()
