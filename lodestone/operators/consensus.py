"""Several backends' candidates for one sample: consensus, best attempt, pairwise comparison, overlap classes, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import codes, count_if, ladder


def consensus(candidates: DataFrame) -> DataFrame:
    """One row for each sample: its status, decision, reasons, and the key and backend that are recommended.

    The largest group of valid candidates with one key counts, ties by the priority of its first member; a single valid
    candidate is taken with a warning; several keys without agreement go to review.
    """
    c = F.col
    tried = (c("status") == "success") & c("canonical_key").isNotNull()
    valid = tried & c("valid")
    groups = candidates.where(valid).groupBy("sample_id", "canonical_key").agg(F.count("*").alias("n"), F.min("priority").alias("first"), F.min_by("backend", "priority").alias("lead"))
    best = groups.groupBy("sample_id").agg(F.max_by(F.struct("canonical_key", "n", "lead"), F.struct("n", -c("first"), "canonical_key")).alias("best"), F.count("*").alias("n_keys"), F.sum("n").alias("n_valid"))
    all_ = candidates.groupBy("sample_id").agg(F.count("*").alias("n_candidates"), count_if(tried).alias("n_tried"))
    both = all_.join(best, "sample_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    status = ladder("disagreement", (c("n_tried") == 0, "all_failed"), (c("n_valid") == 0, "invalid_candidates"), (c("best.n") > 1, "agreement"), (c("n_valid") == 1, "single_valid"))
    made = both.withColumn("status", status)
    taken = c("status").isin("agreement", "single_valid")
    return made.select(
        "sample_id", "n_candidates", "n_valid", "status",
        ladder("review_needed", (c("status").isin("all_failed", "invalid_candidates"), "rejected"), (taken, "accepted_with_warning")).alias("decision"),
        ladder("high", (taken, "medium")).alias("risk"), F.when(taken, c("best.canonical_key")).alias("recommended_key"),
        F.when(c("status") == "agreement", "consensus").when(c("status") == "single_valid", c("best.lead")).alias("recommended_backend"),
    )


def best_attempt(candidates: DataFrame) -> DataFrame:
    """The best valid attempt of each sample: fewest atoms off first, then the first tried; and whether all valid ones agree."""
    good = candidates.where("status = 'success' and valid")
    return good.groupBy("sample_id").agg(F.max_by(F.struct("backend", "canonical_key"), F.struct("atom_count", -F.col("priority"), "canonical_key")).alias("b"), F.count("*").alias("n_valid"), F.count_distinct("canonical_key").alias("n_keys")).select(
        "sample_id", F.col("b.backend").alias("backend"), F.col("b.canonical_key").alias("canonical_key"), "n_valid", F.when(F.col("n_valid") >= 2, F.col("n_keys") == 1).alias("agree")
    )


def selected_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt of each sample that counts, and whether all valid ones agree (null for fewer than two).

    ``attempts``: sample_id, attempt, status, valid, canonical_key, confidence, retry_codes. Of valid ones, those without a code of
    image quality come first, then those not of low confidence, then the most confident, then the first (and the greatest key,
    where an attempt is there twice).
    """
    c = F.col
    good = attempts.where((c("status") == "success") & c("valid"))
    clear = ~F.exists("retry_codes", lambda x: F.startswith(x, F.lit("image_quality_")))
    score = F.struct(clear, ~F.array_contains("retry_codes", "low_confidence"), F.coalesce(c("confidence"), F.lit(0.0)), -c("attempt"), c("canonical_key"))
    keyed = F.when(c("canonical_key") != "", c("canonical_key"))
    by = good.groupBy("sample_id").agg(F.max_by(F.struct("attempt", "canonical_key"), score).alias("b"), F.count(keyed).alias("n_keyed"), F.count_distinct(keyed).alias("n_keys"))
    return by.select("sample_id", "b.attempt", "b.canonical_key", F.when(c("n_keyed") >= 2, c("n_keys") == 1).alias("agree"))


def pairwise(candidates: DataFrame) -> DataFrame:
    """Each pair of candidates of a sample, by priority: same key, and differences in atoms and charge. A sample has few candidates."""
    a, b = candidates.alias("a"), candidates.alias("b")
    both = a.join(b, "sample_id").where("a.priority < b.priority")
    return both.select("sample_id", F.col("a.backend").alias("first"), F.col("b.backend").alias("second"), F.col("a.canonical_key").eqNullSafe(F.col("b.canonical_key")).alias("same_key"), F.abs(F.col("a.atom_count") - F.col("b.atom_count")).alias("atom_difference"), (F.col("a.formal_charge") - F.col("b.formal_charge")).alias("charge_difference"))


def overlap_classes(candidates: DataFrame, first: str, second: str) -> DataFrame:
    """How often two backends are both right, one right, both wrong alike, or both wrong and different."""
    one = lambda name, p: candidates.where(F.col("backend") == name).select("sample_id", F.col("canonical_key").alias(f"{p}_key"), F.coalesce(F.col("canonical_key") == F.col("truth_key"), F.lit(False)).alias(f"{p}_right"))
    both = one(first, "a").join(one(second, "b"), "sample_id")
    kind = ladder("both_wrong_different", (F.col("a_right") & F.col("b_right"), "both_right"), (F.col("a_right"), "first_only"), (F.col("b_right"), "second_only"), (F.col("a_key") == F.col("b_key"), "both_wrong_alike"))
    return both.groupBy(kind.alias("overlap")).agg(F.count("*").alias("n"))


def route(candidates: DataFrame, primary: str, fallback: str) -> DataFrame:
    """The primary's candidate where it is valid, else the fallback's, else none: (sample_id, route, key)."""
    pick = lambda name: F.max(F.when((F.col("backend") == name) & (F.col("status") == "success") & F.col("valid"), F.col("canonical_key")))
    both = candidates.groupBy("sample_id").agg(pick(primary).alias("p"), pick(fallback).alias("f"))
    return both.select("sample_id", ladder("none", (F.col("p").isNotNull(), "primary"), (F.col("f").isNotNull(), "fallback")).alias("route"), F.coalesce("p", "f").alias("key"))


def risk_hints(candidates: DataFrame) -> DataFrame:
    """Codes of what is risky about each candidate."""
    c = F.col
    return candidates.select("sample_id", "backend", F.array_join(codes(("failed", c("status") != "success"), ("invalid", (c("status") == "success") & ~c("valid")), ("charged", c("formal_charge") != 0), ("large", c("atom_count") >= 40)), ",").alias("hints"))


def outcome_flags(candidates: DataFrame) -> DataFrame:
    """Of all samples with a consensus: right and wrong accepts and rejects, and abstentions."""
    truth = candidates.groupBy("sample_id").agg(F.max("truth_key").alias("truth_key"), F.max(F.coalesce(F.col("canonical_key") == F.col("truth_key"), F.lit(False))).alias("any_right"))
    both = consensus(candidates).join(truth, "sample_id")
    right, accepted, c = F.coalesce(F.col("recommended_key") == F.col("truth_key"), F.lit(False)), F.col("decision") == "accepted_with_warning", F.col
    return both.agg(F.count("*").alias("n"), count_if(accepted & right).alias("correct_accept"), count_if(accepted & ~right).alias("wrong_accept"), count_if((c("decision") == "rejected") & ~c("any_right")).alias("correct_reject"), count_if((c("decision") == "rejected") & c("any_right")).alias("unnecessary_reject"), count_if(c("decision") == "review_needed").alias("abstention"))


def attempts_made(attempts: DataFrame, key: str, turn: str, success: Column, valid: Column, reasons: Column) -> DataFrame:
    """Attempts with their reasons to go on, whether each could be the last, and whether it is made at all.

    An attempt that succeeds with a valid result and no reason to go on stops those after it: ``reasons``, ``stops``, ``made``. A
    key has a handful of attempts; of equal turns all are made or none.
    """
    stops = F.coalesce(success & valid, F.lit(False)) & (F.size("reasons") == 0)
    before = Window.partitionBy(key).orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("reasons", reasons).withColumn("stops", stops).withColumn("made", ~F.coalesce(F.max("stops").over(before), F.lit(False)))
