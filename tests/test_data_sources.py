"""Archives read by ranges, and snapshots that are written whole or not at all."""

import hashlib
import json
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import archives, readers, snapshots


def read(spark, path, **options):
    spark.dataSource.register(archives.ArchiveEntries)
    return spark.read.format("archive_entries").options(**options).load(str(path))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("ok.png", b"x"), ("../up.png", b"x"), ("/root.png", b"x"), ("d\\..\\e", b"x"), ("zeros.bin", b"\0" * 10**6), ("dir/", b""), ("né.png", b"y" * 50)):
            z.writestr(name, data)
        z.comment = b"a comment"
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "behind.zip").write_bytes(b"some program" + (tmp_path / "a.zip").read_bytes())
    got = {(r.archive, r.entry): (r.size, r.code) for r in read(spark, tmp_path, most_bytes=1 << 20).collect()}
    one = {"ok.png": (1, ""), "../up.png": (1, "unsafe_path"), "/root.png": (1, "unsafe_path"), "d\\..\\e": (1, "unsafe_path"), "zeros.bin": (10**6, "odd_ratio"), "né.png": (50, "")}
    assert got == {(a, k): v for a in ("a.zip", "behind.zip") for k, v in one.items()} | {("b.zip", ""): (0, "bad_archive"), ("empty.zip", ""): (0, "bad_archive")}
    same = {(r.archive, r.entry): (r.size, r.code) for r in readers.archive_entries(spark, str(tmp_path / "a.zip"), most_bytes=1 << 20).collect()}
    assert same == {k: v for k, v in got.items() if k[0] == "a.zip"}
    assert read(spark, tmp_path / "none.zip").count() == 0


def test_large_directory_is_dealt_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 1000)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(3000):
            z.writestr(f"entry-{k:05d}", b"z" * (k % 7))
    df = read(spark, tmp_path, task_bytes=20_000)
    assert df.rdd.getNumPartitions() > 5
    assert sorted((r.entry, r.size, r.code) for r in df.collect()) == [(f"entry-{k:05d}", k % 7, "") for k in range(3000)]


def test_sizes_of_64_bits(tmp_path):
    wide = (1 << 33).to_bytes(8, "little")
    extra = b"\x01\x00\x10\x00" + wide + (5).to_bytes(8, "little")
    record = archives.ENTRY + b"\0" * 16 + b"\xff" * 8 + (1).to_bytes(2, "little") + len(extra).to_bytes(2, "little") + b"\0" * 14 + b"n" + extra
    (tmp_path / "r").write_bytes(record)
    with open(tmp_path / "r", "rb") as file:
        assert list(archives.entries(file, 0, len(record), 1 << 40, 1 << 40)) == [("n", 1 << 33, "")]


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(1000).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string"))).repartition(3)
    with pytest.raises(ValueError):
        snapshots.freeze(rows, rows.limit(1), path)
    snapshots.freeze(rows, rows.where("false"), path)
    files = snapshots.manifest(spark, path).collect()
    for f in files:
        data = open(f"{path}/{f.name}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f.bytes, f.sha256)
    assert sum(f.rows for f in files) == 1000 == json.load(open(f"{path}/{snapshots.MANIFEST}"))["rows"]
    assert not snapshots.thawed(spark, path, rows.schema).exceptAll(rows).count()
    assert sorted(os.listdir(path)) == sorted([snapshots.MANIFEST, *[f.name for f in files]])
    with pytest.raises(PySparkException):
        snapshots.freeze(rows, rows.where("false"), path)


def test_failed_snapshot_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    bad = spark.range(1000).repartition(3).withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.lit("y")))
    with pytest.raises(PySparkException):
        snapshots.freeze(bad, bad.limit(0), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    snapshots.freeze(spark.range(3), spark.range(0), path)
    assert snapshots.thawed(spark, path, "id long").count() == 3


def test_empty_snapshot(spark, tmp_path):
    snapshots.freeze(spark.range(0), spark.range(0), str(tmp_path / "s"))
    assert json.load(open(tmp_path / "s" / snapshots.MANIFEST)) == {"files": [], "rows": 0}
