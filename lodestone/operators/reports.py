"""Nested reports to flat rows, and back to history records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import filled


def flatten(reports: DataFrame) -> DataFrame:
    """One wide row of each nested report; texts fall back to the next field that says something."""
    c = F.col
    return reports.select(
        "analysis_id", c("input.filename").alias("filename"), c("input.image_sha256").alias("image_sha256"), "status",
        c("recognition.decision").alias("recognition_decision"), F.coalesce(c("recognition.manual_review_recommended"), F.lit(False)).alias("manual_review_recommended"),
        F.to_json(F.coalesce(c("recognition.reason_codes"), F.array().cast("array<string>"))).alias("reason_codes"),
        c("ocsr.backend").alias("backend"), filled(c("ocsr.predicted"), c("ocsr.text")).alias("predicted"), filled(c("final.text"), c("ocsr.text")).alias("final"),
        filled(c("final.standardized"), c("validation.standardized")).alias("standardized"), F.coalesce(c("validation.valid"), F.lit(False)).alias("valid"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("candidate_count"), F.to_json("candidates").alias("candidates"),
    )


def regions(reports: DataFrame) -> DataFrame:
    """A row of each region of each report, with its box as columns."""
    each = reports.select("analysis_id", F.posexplode("regions").alias("at", "r"))
    return each.select("analysis_id", (F.col("at") + 1).alias("region_number"), F.col("r.kind").alias("kind"), *[F.col("r.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def history_record(reports: DataFrame) -> DataFrame:
    """The record that a history keeps of a report: id, name, status, decision, and the result that counts."""
    c = F.col
    decision = filled(c("recognition.decision"), F.when(c("status") == "failed", "rejected"), F.lit("review_needed"))
    return reports.select("analysis_id", filled(c("input.filename"), F.lit("unnamed")).alias("filename"), "status", decision.alias("decision"), filled(c("final.text"), c("ocsr.predicted"), c("ocsr.text")).alias("result"), F.lit(False).alias("is_favorite"))


#: What a report says of a correction, a final result and a human review that it does not have.
CORRECTION = {"applied": "false", "corrected_smiles": None, "corrected_canonical_smiles": None, "corrected_standardized_smiles": None, "corrected_at": None, "source": None, "last_error": None}
FINAL = {"smiles": None, "raw_smiles": None, "canonical_smiles": None, "standardized_smiles": None, "source": None}


def _filled(reports: DataFrame, block: str, defaults: dict[str, str | None]) -> Column:
    """A block with its own fields where it has them, and the defaults for the rest, whether the block is there or not."""
    own = {f.name for f in reports.schema[block].dataType.fields} if block in reports.columns else set()
    value = lambda k, v: F.coalesce(F.col(f"{block}.{k}").cast("string"), F.lit(v).cast("string")) if k in own else F.lit(v).cast("string")
    return F.struct(*[value(k, v).alias(k) for k, v in defaults.items()], *[F.col(f"{block}.{k}").alias(k) for k in sorted(own - set(defaults))])


def upgraded(reports: DataFrame) -> DataFrame:
    """Reports of any age with all blocks: ``correction`` and ``final`` have all fields, the prediction falls back to its older name."""
    named = filled(F.col("ocsr.predicted"), F.col("ocsr.text"))
    return reports.withColumns({"ocsr": F.col("ocsr").withField("predicted", named), "correction": _filled(reports, "correction", CORRECTION), "final": _filled(reports, "final", FINAL)})


def annotation(reports: DataFrame, first: DataFrame, review_status: str, include: Column) -> DataFrame:
    """(analysis_id, annotation): the nested record that feedback keeps of an upgraded report. ``first``: the first analysis of each image."""
    c = F.col
    joined = reports.join(first.select(c("image_sha256").alias("sha"), c("analysis_id").alias("first_id")), c("input.image_sha256") == c("sha"), "left")
    of = F.when(c("first_id") != c("analysis_id"), c("first_id"))
    return joined.select("analysis_id", F.struct(
        "analysis_id", c("input.image_sha256").alias("image_sha256"), F.struct(c("input.filename").alias("filename")).alias("original_input"),
        F.struct(c("ocsr.predicted").alias("predicted"), c("ocsr.backend").alias("backend")).alias("prediction"), "correction", "final",
        F.struct(F.lit(review_status).alias("review_status"), include.alias("include_in_training"), of.isNotNull().alias("duplicate_image"), of.alias("duplicate_of"), F.lit(1).alias("revision")).alias("feedback"),
    ).alias("annotation"))


def picked(reports: DataFrame, backend: str) -> DataFrame:
    """(analysis_id, result, applied, error): the stored candidate of a backend as the final result, the first by priority.

    Where there is none, or it has no result, the report's result stays and the error says why.
    """
    c = F.col
    hits = F.array_sort(F.filter("candidates", lambda x: x["backend"] == backend))
    hit, current = F.get(hits, F.lit(0)), filled(c("final.text"), c("ocsr.predicted"), c("ocsr.text"))
    key = F.nullif(hit["canonical_key"], F.lit(""))
    error = F.when(hit.isNull(), "candidate_missing").when(key.isNull(), "candidate_invalid").otherwise("")
    return reports.select("analysis_id", F.coalesce(key, current).alias("result"), key.isNotNull().alias("applied"), error.alias("error"))


def report_rows(payloads: DataFrame) -> DataFrame:
    """A row of each report of a payload; one without reports of its own gives those of its regions (regions without one give none)."""
    own = F.coalesce("reports", F.array())
    of_regions = F.filter(F.transform(F.coalesce("regions", F.array()), lambda r: r["report"]), lambda r: r.isNotNull())
    return payloads.select("payload_id", F.explode(F.when(F.size(own) > 0, own).otherwise(of_regions)).alias("r")).select("payload_id", "r.*")
