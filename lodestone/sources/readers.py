"""Readers of files: manifests, line lists, delimited lists, JSON results, checksums, binary files and archives."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.archives import entry_code

#: Names of the value and name columns of a delimited list.
VALUE_NAMES = ("smiles", "canonical_smiles", "structure", "molecule")
NAME_NAMES = ("name", "id", "compound_id", "title")


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """A CSV manifest with a header (a byte-order mark is dropped): trimmed texts, missing ones empty, defaults for missing columns.

    Fails where a required column is missing. An empty file gives no rows.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"{path}: columns are missing: {', '.join(sorted(missing))}")
    df = df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def manifest_or_none(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of a CSV manifest as texts, empty where they or their values are missing; no rows where there is no file."""
    try:
        found = manifest(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return found.select(*[F.col(f"`{c}`") if c in found.columns else F.lit("").alias(c) for c in columns])


def decoded(content: bytes) -> str | None:
    """A text in UTF-8, with or without a mark, or else GB18030; None if it is neither."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return bytes(content).decode(name)
        except UnicodeDecodeError:
            pass
    return None


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Texts of file contents; see ``decoded``."""
    return content.map(decoded)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_number, value, name) of lists with one value a line and an optional name; blank and # lines are skipped."""
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.posexplode(F.split(decode_text("content"), "\r\n|\r|\n")).alias("at", "raw"))
    line = F.trim(F.regexp_replace("raw", "\\s+", " "))
    kept = lines.withColumn("line", line).where("line <> '' and not startswith(line, '#')")
    named = F.when(F.contains("line", F.lit(" ")), F.expr("substring(line, locate(' ', line) + 1)")).otherwise(F.concat(F.lit("row_"), F.col("at") + 1))
    return kept.select("source", (F.col("at") + 1).alias("line_number"), F.substring_index("line", " ", 1).alias("value"), named.alias("name"))


def delimited_list(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_number, value, name) of files with , ; or tab between cells; columns by usual names, else the first."""

    def rows(batches):
        for files in batches:
            out = []
            for name, content in zip(files["path"], files["content"], strict=True):
                text = decoded(content) or ""
                head = text.split("\n", 1)[0]
                mark = max(",;\t", key=head.count)
                cells = list(csv.reader(io.StringIO(text), delimiter=mark))
                names = [c.strip().lower().replace(" ", "_") for c in cells[0]] if cells else []
                value = next((k for k, c in enumerate(names) if c in VALUE_NAMES), None)
                label = next((k for k, c in enumerate(names) if c in NAME_NAMES), None)
                for n, row in enumerate(cells, 1):
                    k = value or 0
                    if (n > 1 or value is None) and k < len(row) and row[k].strip():
                        own = row[label].strip() if label is not None and label < len(row) else ""
                        out.append((name.rsplit("/", 1)[-1], n, row[k].strip(), own or f"row_{n}"))
            yield pd.DataFrame(out, columns=["source", "line_number", "value", "name"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "source string, line_number int, value string, name string")


def metrics_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON files named <backend>_metrics.json with their backend."""
    df = spark.read.json(path, multiLine=True, pathGlobFilter="*_metrics.json")
    return df.withColumn("backend", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)_metrics[.]json$", 1))


def audits(spark: SparkSession, path: str, key: str = "sample_id", schema: str | None = None) -> DataFrame:
    """One JSON record a file, in folders of any depth; unreadable files are skipped and the last file of a key counts.

    Without ``schema`` all files are read once more to find it, and the driver lists them one by one.
    """
    df = spark.read.json(path, schema, multiLine=True, mode="DROPMALFORMED", recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_name"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), "file").alias("r")).select("r.*")


def page_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, page_number, width, height, class, x1, y1, x2, y2) of nested annotation files."""
    box = "struct<class:string,bbox:array<int>>"
    schema = f"pages map<string,struct<source_document:string,page_number:int,width:int,height:int,annotations:array<{box}>>>"
    pages = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("pages").alias("page_id", "p"))
    rows = pages.select("page_id", "p.source_document", "p.page_number", "p.width", "p.height", F.explode("p.annotations").alias("a"))
    return rows.select("page_id", "source_document", "page_number", "width", "height", F.col("a.class").alias("class"), *[F.col("a.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, size, sha256) of files under a folder."""
    # Each task gets a few files only: their rows are put together again.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).hint("rebalance")


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, name) of lines with a checksum, white space and a path."""
    parts = F.split(F.trim("value"), "\\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("sha256"), F.regexp_replace(parts[1], "^[*]", "").alias("name"))


def archive_entries(spark: SparkSession, path: str, **limits) -> DataFrame:
    """(archive, entry, size, code) of zip files; see ``entries_of``."""
    files = spark.read.format("binaryFile").load(path)
    return entries_of(files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "length", "content"), **limits)


def entries_of(files: DataFrame, most_archive: int = 1 << 30, most_bytes: int = 100 << 20, most_ratio: int = 200) -> DataFrame:
    """(archive, entry, size, code) of zip files given as (archive, length, content).

    The code says what is wrong with an entry or archive, and is empty if nothing is. Archives of more than ``most_archive``
    bytes are not opened, as a worker holds one archive; the data source ``ArchiveEntries`` reads files of any size.
    """

    def rows(batches):
        for files in batches:
            for name, content in zip(files["archive"], files["content"], strict=True):
                out = []
                try:
                    found = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except (zipfile.BadZipFile, OSError):
                    found = []
                    out.append((name, "", 0, "bad_archive"))
                out += [(name, e.filename, e.file_size, entry_code(e.filename, bool(e.flag_bits & 1), e.file_size, e.compress_size, most_bytes, most_ratio)) for e in found if not e.is_dir()]
                yield pd.DataFrame(out, columns=["archive", "entry", "size", "code"])

    opened = files.where(F.col("length") <= most_archive).select("archive", "content").mapInPandas(rows, "archive string, entry string, size long, code string")
    large = files.where(F.col("length") > most_archive).select("archive", F.lit("").alias("entry"), F.col("length").alias("size"), F.lit("archive_too_large").alias("code"))
    return opened.unionByName(large)
