"""Writers: tables in fixed or united columns, lists, routed outputs, frozen snapshots and append-only logs."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.readers import file_checksums


def csv_table(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """A CSV table with a header; with ``fields`` in their order, others left out, missing ones empty."""
    if fields:
        df = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields])
    df.write.csv(path, header=True, mode="errorifexists")


def united(*tables: DataFrame) -> DataFrame:
    """Rows of several tables over all of their columns."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Records as JSON lines; with ``append`` a log that only grows."""
    df.write.json(path, mode="append" if append else "errorifexists")


def named_list(df: DataFrame, path: str, value: str, name: str) -> None:
    """Lines of a value, a tab and a name."""
    df.select(F.concat_ws("\t", value, name).alias("value")).write.text(path)


def small_files(rows: DataFrame, path: str, name: Column, content: Column, per_folder: int = 250) -> None:
    """A file for each row, in numbered folders of about ``per_folder``; names differ, so a task that runs again writes the same files.

    Each folder is written by one task straight into its place: nothing is renamed by the driver, and readers list the folders
    in tasks.
    """
    folders = max(1, -(-rows.count() // per_folder))

    def write(batches):
        store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        made, n = set(), 0
        for part in batches:
            for folder, own, text in zip(part["folder"], part["name"], part["content"], strict=True):
                if folder not in made:
                    store.create_dir(f"{root}/{folder}")
                    made.add(folder)
                with store.open_output_stream(f"{root}/{folder}/{own}") as file:
                    file.write(text.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    named = rows.select(name.alias("name"), content.alias("content")).withColumn("folder", F.pmod(F.xxhash64("name"), F.lit(folders)))
    named.repartition(folders, "folder").mapInPandas(write, "n long").agg(F.sum("n")).collect()  # one number


def routed(df: DataFrame, folder: str, routes: dict[str, Column]) -> None:
    """A Parquet table for each route with the rows that meet its condition; a row may go to several."""
    for name, condition in routes.items():
        df.where(condition).write.parquet(f"{folder}/{name}")


#: Visual states that turn a crop down.
VISUAL_REJECTED = ("reaction", "multiple_molecules", "text", "table", "figure", "logo", "blank", "invalid_crop")


def outcome_routes(visual: Column, structure: Column, rejected: tuple[str, ...] = VISUAL_REJECTED) -> dict[str, Column]:
    """The six outputs of a review, by the visual and the structure status of a row; a row may go to several."""
    good, verified = visual == "valid_single_molecule_crop", structure == "structure_ground_truth_verified"
    return {
        "visual_verified": good, "visual_rejected": visual.isin(*rejected), "detector_training_manifest": good | visual.isin(*rejected),
        "missing_files": visual == "missing_source_file", "structure_ground_truth_verified": verified, "chemistry_review_required": good & ~verified,
    }


#: The fields of a history as a flat file, in their order.
HISTORY_FIELDS = [
    "analysis_id", "created_at", "input_type", "filename", "image_sha256", "backend", "decision", "status", "final_smiles", "inchikey", "report_path", "is_favorite",
    "delete_status", "delete_errors", "delete_requested_at", "delete_updated_at", "artifact_status", "artifact_reason",
]


def by_status(df: DataFrame, path: str, status: str) -> None:
    """One folder for each status."""
    df.write.partitionBy(status).parquet(path)


def snapshot(df: DataFrame, remaining: DataFrame, path: str) -> DataFrame:
    """A table that is written once, and only when nothing remains to be reviewed; returns the checksums of its files."""
    if remaining.limit(1).count():
        raise ValueError("rows remain to be reviewed")
    df.write.parquet(path, mode="errorifexists")
    return file_checksums(df.sparkSession, path, "*.parquet")


def guarded(df: DataFrame, required: tuple[str, ...], forbidden: Column | None = None) -> DataFrame:
    """``df``, if it has the required columns and no row meets the forbidden condition."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    if forbidden is not None and df.where(forbidden).limit(1).count():
        raise ValueError("a row must not be exported")
    return df
