"""Frozen snapshots as a data source: written in two phases, with digests and counts in a manifest that is written last.

``spark.dataSource.register(Snapshot)``, then ``df.write.format("snapshot").mode("append").save(path)``. Tasks write files into a
staging folder of the job and return each file's name, rows, bytes and SHA-256, which they work out as they write. Only when
all tasks have succeeded are the files moved in and the manifest written; a failed job leaves nothing. A path that has a manifest
is refused, before any task runs and again at the end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "MANIFEST.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Digesting:
    """A file that hands on what is written and digests it."""

    def __init__(self, out):
        self.out, self.sha, self.size, self.closed = out, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.closed = True
        self.out.close()

    readable = seekable = lambda self: False
    writable = lambda self: True


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"
        self._refuse()

    def _refuse(self) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"a snapshot is frozen: {self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        name, rows, writer, out = f"part-{uuid.uuid4().hex}.parquet", 0, None, None
        store.create_dir(f"{root}/{self.staging}")
        for batch in iterator:
            if writer is None:
                out = _Digesting(store.open_output_stream(f"{root}/{self.staging}/{name}"))
                writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return _Written("", 0, 0, "")
        writer.close()
        out.close()
        return _Written(name, rows, out.size, out.sha.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        try:
            self._refuse()
            done = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.name)
            for m in done:
                store.move(f"{root}/{self.staging}/{m.name}", f"{root}/{m.name}")
            text = json.dumps({"files": [m.__dict__ for m in done], "rows": sum(m.rows for m in done)})
            with store.open_output_stream(f"{root}/{self.staging}/{MANIFEST}") as out:
                out.write(text.encode())
            store.move(f"{root}/{self.staging}/{MANIFEST}", f"{root}/{MANIFEST}")
        finally:
            self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class Snapshot(DataSource):
    """The writer of frozen snapshots; see the module."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def freeze(df: DataFrame, remaining: DataFrame, path: str) -> None:
    """Write ``df`` as a frozen snapshot, if nothing remains to be reviewed."""
    if not remaining.isEmpty():
        raise ValueError("rows remain to be reviewed")
    df.sparkSession.dataSource.register(Snapshot)
    df.write.format("snapshot").mode("append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, bytes, sha256) of the files of a snapshot."""
    files = "files array<struct<name:string,rows:long,bytes:long,sha256:string>>, rows long"
    return spark.read.schema(files).json(f"{path}/{MANIFEST}").selectExpr("inline(files)").select("name", "rows", "bytes", "sha256")


def thawed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a snapshot."""
    return spark.read.schema(schema).parquet(f"{path}/part-*.parquet")
