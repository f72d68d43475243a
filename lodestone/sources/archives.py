"""Entries of zip archives as a data source: only the directories at the ends of the files are read, by ranges.

``spark.dataSource.register(ArchiveEntries)``, then ``spark.read.format("archive_entries").load(folder)``. A task reads the
directories of several archives, or a run of entries of one large directory, a chunk at a time; an archive of any size takes the
same memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, entry string, size long, code string"
#: Fixed values of the zip format: signatures and fixed parts of its records.
ENTRY, END, END64, LOCATOR64 = b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 46, 22, 56, 20
MOST_COMMENT = 65_535
#: Bytes of directories that a task reads, about, and bytes read at once.
TASK_BYTES, CHUNK = 16 << 20, 1 << 20


def entry_code(name: str, encrypted: bool, size: int, packed: int, most_bytes: int, most_ratio: int) -> str:
    """What is wrong with an entry, or nothing: unsafe_path, encrypted, too_large, odd_ratio."""
    pure = PurePosixPath(name.replace("\\", "/"))
    if pure.is_absolute() or ".." in pure.parts:
        return "unsafe_path"
    if encrypted:
        return "encrypted"
    if size > most_bytes:
        return "too_large"
    return "odd_ratio" if size > most_ratio * max(1, packed) else ""


class BadArchive(ValueError):
    """A file that is no archive."""


def directory_of(file, size: int) -> tuple[int, int]:
    """(first byte, end) of an archive's directory, from the records at its end."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT - LOCATOR64_SIZE)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_SIZE:
        raise BadArchive
    length, start = struct.unpack_from("<II", tail, at + 12)
    locator = at - LOCATOR64_SIZE
    end = tail_at + at
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        (where,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(where)
        record = file.read(END64_SIZE)
        if record[:4] != END64:
            raise BadArchive
        length, start = struct.unpack_from("<QQ", record, 40)
        end = where
    # Archives may stand behind other bytes; the directory then ends where its end record starts.
    first = end - length
    if first < 0 or start > first:
        raise BadArchive
    return first, end


def _records(file, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, record) of the directory's entries from ``at`` on."""
    held, base = b"", at
    file.seek(at)
    while at < end:
        while at - base + ENTRY_SIZE > len(held) or (length := _length(held, at - base)) > len(held) - (at - base):
            more = file.read(min(CHUNK, end - base - len(held)))
            if not more:
                raise BadArchive
            held, base = held[at - base :] + more, at
        if held[at - base : at - base + 4] != ENTRY:
            raise BadArchive
        yield at, held[at - base : at - base + length]
        at += length


def _length(held: bytes, at: int) -> int:
    return ENTRY_SIZE + sum(struct.unpack_from("<HHH", held, at + 28))


def entries(file, at: int, end: int, most_bytes: int, most_ratio: int) -> Iterator[tuple[str, int, str]]:
    """(name, size, code) of the files among the entries of a directory between two positions."""
    for _, r in _records(file, at, end):
        flags = struct.unpack_from("<H", r, 8)[0]
        packed, size = struct.unpack_from("<II", r, 20)
        n_name, n_extra = struct.unpack_from("<HH", r, 28)
        name = r[ENTRY_SIZE : ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
        if 0xFFFFFFFF in (packed, size):
            size, packed = _wide(r[ENTRY_SIZE + n_name : ENTRY_SIZE + n_name + n_extra], size, packed)
        if not name.endswith("/"):
            yield name, size, entry_code(name, bool(flags & 1), size, packed, most_bytes, most_ratio)


def _wide(extra: bytes, size: int, packed: int) -> tuple[int, int]:
    """Sizes from the extra field that holds those of 64 bits, in which only the sizes that are full stand."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            size = next(numbers, size) if size == 0xFFFFFFFF else size
            packed = next(numbers, packed) if packed == 0xFFFFFFFF else packed
        at += 4 + length
    return size, packed


@dataclass
class _Runs(InputPartition):
    """Runs of entries: (path, name, from, to); an archive that can't be read has no run but itself."""

    runs: list[tuple[str, str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_bytes, self.most_ratio = int(options.get("most_bytes", 100 << 20)), int(options.get("most_ratio", 200))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        tasks, now, held = [], [], 0
        for info in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            name = info.path.rsplit("/", 1)[-1]
            with store.open_input_file(info.path) as file:
                try:
                    first, end = directory_of(file, info.size)
                    cuts = self._cuts(file, first, end)
                except BadArchive:
                    first, cuts = -1, [-1]
            for a, b in zip([first, *cuts], cuts, strict=False):
                if now and held + b - a > self.task_bytes:
                    tasks, now, held = [*tasks, _Runs(now)], [], 0
                now, held = [*now, (info.path, name, a, b)], held + b - a
        return [*tasks, _Runs(now)] if now or not tasks else tasks

    def _cuts(self, file, first: int, end: int) -> list[int]:
        """Where a directory is cut: only a large one is read here for that, a chunk at a time."""
        cuts, last = [], first
        if end - first > self.task_bytes:
            for at, _ in _records(file, first, end):
                if at - last >= self.task_bytes:
                    cuts, last = [*cuts, at], at
        return [*cuts, end]

    def read(self, partition: _Runs) -> Iterator[tuple]:
        store, _ = self._store()
        for path, name, a, b in partition.runs:
            if b < 0:
                yield name, "", 0, "bad_archive"
                continue
            with store.open_input_file(path) as file:
                try:
                    for row in entries(file, a, b, self.most_bytes, self.most_ratio):
                        yield (name, *row)
                except BadArchive:
                    yield name, "", 0, "bad_archive"


class ArchiveEntries(DataSource):
    """The entries of the archives under a path: (archive, entry, size, code).

    The code says what is wrong with an entry, and is empty if nothing is; a file that is no archive has one row, bad_archive.
    Options: ``most_bytes``, ``most_ratio`` (limits of an entry), ``task_bytes`` (of directories for each task).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
