"""Review votes, history tables and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import count_if, filled, ladder
from lodestone.sources.writers import VISUAL_REJECTED


def vote_status(votes: DataFrame) -> DataFrame:
    """Status of each sample after its votes: each reviewer's last vote counts, and the last two of these must agree."""
    last = votes.groupBy("sample_id", "reviewer").agg(F.max_by(F.struct("decision", "canonical_key"), "seq").alias("v"), F.max("seq").alias("seq"))
    # The two latest of a sample come from an array of two at most in each partial step.
    turn = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("seq")))
    two = last.withColumn("turn", turn).where("turn <= 2").groupBy("sample_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("turn") == 1, F.col("v.decision"))).alias("d1"), F.max(F.when(F.col("turn") == 2, F.col("v.decision"))).alias("d2"),
        F.max(F.when(F.col("turn") == 1, F.col("v.canonical_key"))).alias("k1"), F.max(F.when(F.col("turn") == 2, F.col("v.canonical_key"))).alias("k2"),
    )
    c = F.col
    status = ladder("rejected", (c("n") < 2, "pending"), ((c("d1") != c("d2")) | ((c("d1") == "approve") & (c("k1") != c("k2"))), "disagreement"), (c("d1") == "approve", "verified"))
    return two.select("sample_id", status.alias("status"))


def queue_statistics(votes: DataFrame) -> DataFrame:
    """Counters over all samples: votes, reviewers, samples by status."""
    counts = votes.agg(F.count("*").alias("n_votes"), F.count_distinct("reviewer").alias("n_reviewers"), F.count_distinct("sample_id").alias("n_samples"))
    by = vote_status(votes).agg(*[count_if(F.col("status") == s).alias(f"n_{s}") for s in ("verified", "rejected", "disagreement", "pending")])
    return counts.crossJoin(by)  # one row each


def consistency(votes: DataFrame) -> DataFrame:
    """How often a reviewer's last vote on a sample is as the first, by first decision."""
    both = votes.groupBy("sample_id", "reviewer").agg(F.min_by("decision", "seq").alias("first"), F.max_by("decision", "seq").alias("last"), F.count("*").alias("n")).where("n > 1")
    return both.groupBy("first").agg(F.count("*").alias("n"), count_if(F.col("first") == F.col("last")).alias("n_same")).withColumn("rate", F.bround(F.col("n_same") / F.col("n"), 6))


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("v")).select(key, "v.*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """New rows over old ones by key; columns ``keep`` stay those of the old row where there is one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in (key, *keep) else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old rows of other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def resumed(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored rows, and the rows that are not stored yet, with ``origin``: work that goes on after a checkpoint."""
    fresh = rows.join(stored.select(key), key, "left_anti").withColumn("origin", F.lit("new"))
    return stored.withColumn("origin", F.lit("stored")).unionByName(fresh)


def search(history: DataFrame, text: str | None = None, status: str | None = None, favorites: bool = False) -> DataFrame:
    """Rows of a history whose file name has a text (any case; % and _ as wildcards), of a status, or marked."""
    if text:
        history = history.where(F.col("filename").ilike(f"%{text}%"))
    if status:
        history = history.where(F.col("status") == status)
    return history.where("is_favorite") if favorites else history


def page(history: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a history: marked rows first, then the newest."""
    return history.orderBy(F.desc("is_favorite"), F.desc("created_at"), "analysis_id").offset(offset).limit(limit)


def retention(runs: DataFrame, cutoff: str, most_bytes: int) -> DataFrame:
    """Runs to delete, oldest first: unprotected ones that are older than ``cutoff`` or while the rest is over ``most_bytes``.

    What earlier deletions free is a running sum over time; it is taken within days and added up over days, so it is not
    one long window.
    """
    total = runs.agg(F.sum("size_bytes").alias("total"))  # one row
    free = runs.where("not protected").withColumn("day", F.to_date("created_at"))
    days = free.groupBy("day").agg(F.sum("size_bytes").alias("freed"))
    base = days.withColumn("base", F.coalesce(F.sum("freed").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("day").orderBy("created_at", "analysis_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = free.withColumn("before", F.coalesce(F.sum("size_bytes").over(within), F.lit(0))).join(base.select("day", "base"), "day")
    over = F.col("total") - F.col("base") - F.col("before") > most_bytes
    return prior.crossJoin(F.broadcast(total)).where((F.col("created_at") < F.lit(cutoff).cast("timestamp")) | over).select("analysis_id", "created_at", "size_bytes")


def batch_category(rows: DataFrame) -> DataFrame:
    """Rows with the one category that a batch summary counts them in."""
    status, decision = F.lower(F.coalesce("status", F.lit(""))), F.lower(F.coalesce("recognition_decision", F.lit("")))
    known = ("accepted", "accepted_with_warning", "review_needed", "rejected")
    return rows.withColumn("main_category", ladder("accepted", (status == "skipped", "skipped"), (status != "success", "failed"), (decision.isin(*known), decision), (F.coalesce("manual_review_recommended", F.lit(False)), "review_needed")))


#: Where a trusted structure may come from.
TRUSTED_ORIGINS = ("pubchem", "chembl", "supplementary_sdf", "supplementary_smiles", "curated_database", "chemist_manual")


def review_queue_statistics(rows: DataFrame, audits: DataFrame, rejected: tuple[str, ...] = VISUAL_REJECTED, origins: tuple[str, ...] = TRUSTED_ORIGINS) -> DataFrame:
    """One row of counters of a review queue and its audits.

    ``rows`` has sample_id, verification_status, machine_category, category, ground_truth_origin and structure_valid, perhaps more than
    once for a sample; ``audits`` has one row for each audited sample_id, with visual_review_status. Counters of samples are of
    distinct ids, and a sample is rejected if a row of it or its audit says so: each id is brought to one row of flags,
    both sides are joined on it, and nothing but flags is counted. Null and empty ids count as rows only.
    """
    status = F.coalesce(F.col("verification_status"), F.lit(""))
    kind = filled(F.col("machine_category"), F.col("category"))
    trusted = F.lower(F.trim(F.coalesce("ground_truth_origin", F.lit("")))).isin(*origins) & F.coalesce("structure_valid", F.lit(False))
    flags = {"routed": status == "pending_human_review", "machine_rejected": status.startswith("rejected_"), "verified": status == "machine_verified", "pending": status == "pending_machine_review", "positive": kind.eqNullSafe(F.lit("molecule")), "trusted": trusted}
    by_id = rows.select("sample_id", *[v.alias(k) for k, v in flags.items()]).groupBy("sample_id").agg(F.count("*").alias("n"), *[count_if(F.col(k)).alias(k) for k in flags])
    seen = audits.select(F.col("sample_id").alias("audited"), F.col("visual_review_status").isin(*rejected).alias("negative"))
    both = by_id.join(seen, by_id["sample_id"] == seen["audited"], "full_outer")
    named, c = F.coalesce(F.col("sample_id").cast("string"), F.col("audited").cast("string"), F.lit("")) != "", F.col
    rows_of = lambda k: F.coalesce(F.sum(k), F.lit(0))
    routed = named & (c("routed") > 0)
    return both.agg(
        rows_of("n").alias("total"), count_if(routed).alias("machine_routed_visual"), count_if(routed & c("audited").isNull()).alias("visual_remaining"), count_if(routed).alias("pending_human"),
        rows_of("verified").alias("machine_verified"), rows_of("pending").alias("pending_machine"), F.count("audited").alias("reviewed"),
        count_if(named & (F.coalesce(c("machine_rejected") > 0, F.lit(False)) | F.coalesce("negative", F.lit(False)))).alias("rejected"), rows_of("machine_rejected").alias("machine_rejected"),
        count_if(c("negative")).alias("visual_negative"), rows_of("positive").alias("positive_candidates"), (rows_of("n") - rows_of("positive")).alias("negative_candidates"), rows_of("trusted").alias("trusted_structure_labels"),
    )
