"""Denominator-explicit metrics of prediction runs, their groups, gates and comparisons.

Every measure is a count over small flag columns, so one partial aggregation before one shuffle of group rows serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import blank_metadata, contains_any, count_if, rate0, rate_null
from lodestone.functions.rules import failure_category, unclear_license

#: Words that mark a sample as high-risk.
HIGH_RISK = ("reject", "distractor", "non_molecule", "reaction", "stereo", "charge", "salt", "fragment", "metal", "multiple", "multi", "high")
#: Gates of a release, as (check, metric, at least or at most, threshold).
GATES = (
    ("valid_rate", "min", 0.95),
    ("exact_rate", "min", 0.80),
    ("false_accept_rate", "max", 0.05),
    ("high_risk_review_rate", "min", 1.0),
    ("p95_latency_ms", "max", 15000.0),
    ("n_positive", "min", 100.0),
    ("n_negative", "min", 20.0),
    ("n_source_documents", "min", 30.0),
)


#: Fields in which a word of ``HIGH_RISK`` marks a sample.
RISK_FIELDS = ("category", "complexity", "structure_features", "supported_scope", "notes")


def _text(rows: DataFrame, name: str) -> Column:
    """A text column, empty where it or the whole column is missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def _true(rows: DataFrame, name: str) -> Column:
    """A flag, false where it or the whole column is missing."""
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in rows.columns else F.lit(False)


def flags(predictions: DataFrame) -> DataFrame:
    """Predictions with what each counts for: polarity, validity, exactness, acceptance, review, error, risk and failure reason.

    Of the fields that risk is read from, those that a table lacks count as empty.
    """
    c = F.col
    action = F.lower(F.trim(F.coalesce(F.nullif(c("expected_action"), F.lit("")), F.lit("recognize"))))
    decision = F.lower(F.coalesce(c("recognition_decision"), F.lit("")))
    negative = action == "reject"
    valid = c("predicted_key").isNotNull()
    exact = F.coalesce(c("predicted_key") == c("truth_key"), F.lit(False))
    success = F.coalesce(c("recognition_success"), F.lit(False))
    recommended = F.coalesce(c("manual_review_recommended"), F.lit(False))
    fields = F.lower(F.concat_ws(" ", action, *[_text(predictions, k) for k in RISK_FIELDS]))
    return predictions.withColumns({
        "is_negative": negative, "is_positive": ~negative, "valid": valid, "exact": exact, "success": success,
        "auto_accept": (decision == "accepted") & ~recommended,
        "rejection_success": negative & ~success,
        "review": (decision == "review_needed") | recommended,
        "error": F.when(negative, valid).otherwise(~exact),
        "high_risk": contains_any(fields, HIGH_RISK),
        "derived": ~blank_metadata(c("perturbation")),
        "failure_reason": F.when(success & ~valid, "invalid_predicted_key").when(~success, F.coalesce(F.nullif(c("message"), F.lit("")), F.lit("recognition_failed"))),
    })


def _counts() -> dict[str, Column]:
    c = F.col
    return {
        "n_total": F.count("*"), "n_positive": count_if(c("is_positive")), "n_negative": count_if(c("is_negative")),
        "n_success": count_if(c("success")), "n_valid": count_if(c("valid")), "n_valid_positive": count_if(c("valid") & c("is_positive")),
        "n_exact": count_if(c("exact") & c("is_positive")), "n_rejected": count_if(c("is_negative") & ~c("valid")),
        "n_hallucinated": count_if(c("is_negative") & c("valid")), "n_false_accept": count_if(c("is_negative") & c("auto_accept")),
        "n_review": count_if(c("review")), "n_high_risk_error": count_if(c("high_risk") & c("error")),
        "n_high_risk_reviewed": count_if(c("high_risk") & c("error") & c("review")),
    }


def _rates() -> dict[str, Column]:
    c = F.col
    return {
        "success_rate": rate0(c("n_success"), c("n_total")), "valid_rate": rate_null(c("n_valid_positive"), c("n_positive")),
        "exact_rate": rate_null(c("n_exact"), c("n_positive")), "failed_rate": rate0(c("n_total") - c("n_success"), c("n_total")),
        "rejection_coverage": rate_null(c("n_rejected"), c("n_negative")), "hallucination_rate": rate_null(c("n_hallucinated"), c("n_negative")),
        "false_accept_rate": rate_null(c("n_false_accept"), c("n_negative")), "review_rate": rate0(c("n_review"), c("n_total")),
        "high_risk_reviewed_rate": rate0(c("n_high_risk_reviewed"), c("n_high_risk_error")),
    }


def summary(predictions: DataFrame, *by: str) -> DataFrame:
    """All counts and rates, overall or for each value of ``by``."""
    return flags(predictions).groupBy(*by).agg(*[v.alias(k) for k, v in _counts().items()]).withColumns(_rates())


#: Dimensions by which a release is reported.
DIMENSIONS = ("category", "source", "image_quality", "complexity", "perturbation", "structure_features", "split", "backend", "preprocessing_strategy")
#: Similarities are ranked in whole millionths.
MILLIONTHS = 1_000_000


def _structure_counts(threshold: float) -> dict[str, Column]:
    c = F.col
    positive = c("is_positive")
    compared = positive & c("valid")
    return {
        "n_equivalent": count_if(positive & c("equivalent")),
        "n_stereo_required": count_if(positive & c("stereo_required")), "n_stereo_exact": count_if(positive & c("stereo_required") & c("stereo_match")),
        "n_atom_count_error": count_if(compared & ~c("atom_count_match")), "n_charge_error": count_if(compared & ~c("charge_match")),
        "n_bond_type_error": count_if(compared & ~c("bond_type_match")), "n_similarity": count_if(positive & c("similarity").isNotNull()),
        "n_above_threshold": count_if(positive & (c("similarity") >= round(threshold * MILLIONTHS))),
        "n_derived": count_if(c("derived")), "n_verified": count_if(c("verified")), "n_unclear_license": count_if(c("unclear_license")),
    }


def _structure_rates() -> dict[str, Column]:
    c = F.col
    return {
        "valid_of_all_rate": rate0(c("n_valid"), c("n_total")), "equivalent_rate": rate_null(c("n_equivalent"), c("n_positive")),
        "stereo_exact_rate": rate_null(c("n_stereo_exact"), c("n_stereo_required")), "atom_count_error_rate": rate_null(c("n_atom_count_error"), c("n_valid_positive")),
        "charge_error_rate": rate_null(c("n_charge_error"), c("n_valid_positive")), "bond_type_error_rate": rate_null(c("n_bond_type_error"), c("n_valid_positive")),
        "above_threshold_rate": rate_null(c("n_above_threshold"), c("n_similarity")), "verified_rate": rate_null(c("n_verified"), c("n_total")),
    }


def release_summary(predictions: DataFrame, dimensions: tuple[str, ...] = (), *, overall: bool = True, threshold: float = 0.95, bins: int = 10) -> DataFrame:
    """The whole report of a release: a row for all predictions, (``all``, ``all``), and one for each value of each dimension.

    Columns are dimension, value, the counts and rates of ``summary``, and
    - of structures: equivalent results, stereochemistry where the truth has some, errors in atoms, charges and bonds of valid results;
    - of similarity (positive samples that have one): number, mean, median, and how many reach ``threshold``;
    - of latency: number, mean, median and the nearest ranks p50 and p95;
    - of confidence (positive samples, 0 to 1): number and expected calibration error over ``bins`` equal bins;
    - of the data: distinct source documents, originals, identities and scaffolds, derived, verified and unclearly licensed samples;
    - failure_distribution: category=number of the failures, sorted and joined by semicolons (raw messages: ``failure_reasons``).

    Empty values of a dimension are ``unknown``. Columns that a table lacks count as missing in all its rows; rates over nothing are
    null (or 0.0, as in ``summary``), and an empty table has no row. Each row is told to its groups within its task; what is
    shuffled is a row for each group, for each group and distinct number (whole milliseconds, millionths), and for each group
    and distinct name. Nothing but distinct numbers is ordered.
    """
    c = F.col
    optional = {k: _true(predictions, k) for k in ("stereo_required", "stereo_match", "atom_count_match", "charge_match", "bond_type_match")}
    similarity = F.bround(c("tanimoto_similarity").cast("double") * MILLIONTHS, 0).cast("long") if "tanimoto_similarity" in predictions.columns else F.lit(None).cast("long")
    confidence = F.when((c("confidence_milli") >= 0) & (c("confidence_milli") <= 1000), c("confidence_milli").cast("long"))
    rows = flags(predictions).withColumns({
        **optional, "equivalent": _true(predictions, "equivalent") | c("exact"), "similarity": similarity,
        "latency": F.bround("inference_time_ms", 0).cast("long"), "confidence_milli": confidence,
        "verified": F.lower(F.trim(_text(predictions, "review_status"))) == "verified", "unclear_license": unclear_license(_text(predictions, "source_license")),
    })
    name = lambda k, also=F.lit(True): F.when(also & ~blank_metadata(_text(predictions, k)), F.trim(_text(predictions, k)))
    # What is counted as distinct names, or as numbers of a kind.
    names = {"source": name("source_document"), "original": name("source_document", ~c("derived")), "identity": name("identity_key", c("is_positive")), "scaffold": name("scaffold_key", c("is_positive")), "failure": F.when(c("failure_reason").isNotNull(), failure_category(c("failure_reason")))}
    at = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(_text(predictions, d), F.lit("")), F.lit("unknown")).alias("value")) for d in dimensions]
    at += [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))] if overall else []
    long = rows.withColumns({f"name_{k}": v for k, v in names.items()}).withColumn("at", F.explode(F.array(*at))).withColumns({"dimension": c("at.dimension"), "value": c("at.value")})
    group = ("dimension", "value")

    counts = {**_counts(), **_structure_counts(threshold)}
    counted = long.groupBy(*group).agg(*[v.alias(k) for k, v in counts.items()]).withColumns(_rates() | _structure_rates())

    number = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("number"))
    numbers = long.select(*group, F.explode(F.array(number("latency", c("latency")), number("similarity", F.when(c("is_positive"), c("similarity"))))).alias("x")).select(*group, "x.*")
    ranked = _ranked(numbers.where("number is not null").groupBy(*group, "kind", "number").agg(F.count("*").alias("n")), "number", *group, "kind", digits=6)
    of = lambda kind, k: F.max(F.when(c("kind") == kind, c(k)))
    ranked = ranked.groupBy(*group).agg(
        F.coalesce(of("latency", "n"), F.lit(0)).alias("n_latency"), F.bround(of("latency", "mean"), 3).alias("mean_latency_ms"), F.bround(of("latency", "median"), 3).alias("median_latency_ms"),
        of("latency", "p50").alias("p50_latency_ms"), of("latency", "p95").alias("p95_latency_ms"),
        F.bround(of("similarity", "mean") / MILLIONTHS, 6).alias("mean_similarity"), F.bround(of("similarity", "median") / MILLIONTHS, 6).alias("median_similarity"))

    fact = lambda kind, key, v: F.struct(F.lit(kind).alias("kind"), key.alias("key"), v.alias("number"))
    nothing = F.lit(None).cast("long")
    facts = [fact(k, c(f"name_{k}"), nothing) for k in names] + [fact("confidence", F.when(c("is_positive") & c("confidence_milli").isNotNull(), c("exact").cast("string")), c("confidence_milli"))]
    cells = long.select(*group, F.explode(F.array(*facts)).alias("x")).select(*group, "x.*").where("key is not null").groupBy(*group, "kind", "key", "number").agg(F.count("*").alias("n"))
    bin_ = F.least(F.floor(c("number") * bins / 1000), F.lit(bins - 1))
    part = lambda b, v: F.coalesce(F.sum(F.when((c("kind") == "confidence") & (bin_ == b), v)), F.lit(0))
    off = sum((F.abs(part(b, c("number") * c("n")) - 1000 * part(b, F.when(c("key") == "true", c("n")).otherwise(0))) for b in range(bins)), F.lit(0))
    n_confidence = F.coalesce(F.sum(F.when(c("kind") == "confidence", c("n"))), F.lit(0))
    failures = F.array_join(F.array_sort(F.collect_list(F.when(c("kind") == "failure", F.concat_ws("=", "key", c("n").cast("string"))))), ";")
    told = cells.groupBy(*group).agg(
        n_confidence.alias("n_confidence"), rate_null(off, 1000 * n_confidence).alias("calibration_error"), F.nullif(failures, F.lit("")).alias("failure_distribution"),
        *[count_if(c("kind") == k).alias(f"n_{k}s") for k in ("source", "original", "scaffold")], count_if(c("kind") == "identity").alias("n_identities"))
    made = counted.join(ranked, list(group), "left").join(told, list(group), "left")
    return made.na.fill(0, [k for k in made.columns if k.startswith("n_")])


def failure_reasons(predictions: DataFrame) -> DataFrame:
    """Failures by reason, with the category of each reason."""
    found = flags(predictions).where("failure_reason is not null")
    return found.groupBy("failure_reason").agg(F.count("*").alias("n")).withColumn("category", failure_category(F.col("failure_reason")))


def sufficiency(samples: DataFrame) -> DataFrame:
    """How many independent sources, originals, identities and scaffolds a set of samples has, and how many are verified or unclear."""
    c = F.col
    positive = F.lower(F.coalesce(c("expected_action"), F.lit(""))) != "reject"
    known = lambda name, also=F.lit(True): F.count_distinct(F.when(~blank_metadata(c(name)) & also, F.trim(c(name))))
    verified = count_if(F.lower(F.trim("review_status")) == "verified")
    return samples.agg(
        F.count("*").alias("n_total"), known("source_document").alias("n_source_documents"),
        known("source_document", blank_metadata(c("perturbation"))).alias("n_original_sources"), count_if(~blank_metadata(c("perturbation"))).alias("n_derived"),
        known("inchikey", positive).alias("n_identities"), known("scaffold_key", positive).alias("n_scaffolds"), verified.alias("n_verified"),
        rate_null(verified, F.count("*")).alias("verified_rate"), count_if(unclear_license(c("source_license"))).alias("n_unclear_license"),
    )


def ranks(rows: DataFrame, value: str, *by: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles at index round(p / 100 (n - 1)), halves to even, with mean and median.

    Values are counted first, so what is ordered within a group is its distinct values.
    """
    return _ranked(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, *by, percents=percents)


def _ranked(counts: DataFrame, value: str, *by: str, percents: tuple[int, ...] = (50, 95), digits: int = 3) -> DataFrame:
    """``ranks`` of values that come with their number ``n``."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(own)})
    index = lambda p: F.bround(F.lit(p) / 100.0 * (F.col("total") - 1), 0)
    picks = [F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(f"p{p}") for p in percents]
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    median = (F.min(F.when(F.col("upto") > low, F.col(value))) + F.min(F.when(F.col("upto") > high, F.col(value)))) / 2.0
    return at.groupBy(*by).agg(F.sum("n").alias("n"), F.bround(F.sum(F.col(value) * F.col("n")) / F.sum("n"), digits).alias("mean"), F.bround(median, digits).alias("median"), *picks)


def calibration(predictions: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of confidence, the last one closed. Confidence comes in thousandths."""
    points = flags(predictions).where("is_positive and confidence_milli between 0 and 1000")
    each = points.withColumn("bin", F.least(F.floor(F.col("confidence_milli") * bins / 1000), F.lit(bins - 1)))
    cells = each.groupBy(*by, "bin").agg(F.count("*").alias("n"), count_if(F.col("exact")).alias("correct"), F.sum("confidence_milli").alias("milli"))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), rate_null(F.sum(F.abs(F.col("milli") - 1000 * F.col("correct"))), 1000 * F.sum("n")).alias("ece"))


def gates(predictions: DataFrame, thresholds=GATES) -> DataFrame:
    """A row for each check: its value, threshold and whether it passes; a null value fails. ``all_passed`` is that of the run."""
    one = summary(predictions).crossJoin(ranks(predictions, "inference_time_ms").select(F.col("p95").alias("p95_latency_ms")))  # one row each
    one = one.crossJoin(predictions.agg(F.count_distinct(F.when(~blank_metadata(F.col("source_document")), F.col("source_document"))).alias("n_source_documents")))
    one = one.withColumn("high_risk_review_rate", F.when(F.col("n_high_risk_error") == 0, 1.0).otherwise(F.col("high_risk_reviewed_rate")))
    checks = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(side).alias("side"), F.lit(float(x)).alias("threshold"), F.col(k).cast("double").alias("value")) for k, side, x in thresholds])
    rows = one.select(F.explode(checks).alias("c")).select("c.*")
    passed = F.coalesce(F.when(F.col("side") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False))
    # A handful of rows, however large the run.
    return rows.withColumn("passed", passed).withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy(F.lit(0))))


def compare(current: DataFrame, previous: DataFrame, key: str, metrics: dict[str, str], tolerance: float = 0.0) -> DataFrame:
    """Metric by metric change from ``previous`` to ``current`` for each key of both; ``metrics`` says whether higher or lower is better."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.col(m).cast("double").alias(name)) for m, d in metrics.items()])).alias("m")).select(key, "m.*")
    both = long(current, "current").join(long(previous, "previous"), [key, "metric", "direction"])
    both = both.withColumn("delta", F.bround(F.col("current") - F.col("previous"), 6))
    worse = F.when(F.col("direction") == "higher", F.col("delta") < -abs(tolerance)).otherwise(F.col("delta") > abs(tolerance))
    return both.withColumn("regressed", F.coalesce(worse, F.lit(False)))


def ensemble(candidates: DataFrame) -> DataFrame:
    """For each backend: samples, successes, valid and exact results with their rates over all samples."""
    c = F.col
    total = candidates.agg(F.count_distinct("sample_id").alias("n_samples"))
    exact = F.coalesce((c("canonical_key") == c("truth_key")) & c("valid"), F.lit(False))
    by = candidates.groupBy("backend").agg(count_if(c("status") == "success").alias("n_success"), count_if((c("status") == "success") & c("valid")).alias("n_valid"), count_if(exact).alias("n_exact"))
    made = by.crossJoin(F.broadcast(total))  # one row
    return made.withColumns({"success_rate": rate0(c("n_success"), c("n_samples")), "valid_rate": rate0(c("n_valid"), c("n_samples")), "exact_rate": rate0(c("n_exact"), c("n_samples"))})


def only_and_missed(candidates: DataFrame) -> DataFrame:
    """For each backend: samples that it alone has right, and samples that it misses though some backend has them right."""
    exact = candidates.where("status = 'success' and valid and canonical_key = truth_key").groupBy("sample_id").agg(F.collect_set("backend").alias("right"))
    total = exact.agg(F.count("*").alias("n_any"))  # one row
    own = exact.select(F.explode("right").alias("backend"), (F.size("right") == 1).alias("alone")).groupBy("backend").agg(F.count("*").alias("n_right"), count_if(F.col("alone")).alias("n_only"))
    names = candidates.select("backend").distinct().join(own, "backend", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return names.select("backend", zero("n_only").alias("n_only"), (F.col("n_any") - zero("n_right")).alias("n_missed"))


def only_correct(candidates: DataFrame) -> DataFrame:
    """For each ordered pair of backends: in how many samples the first is exact and the second is not.

    Exact backends of a sample are counted in pairs; what the first has alone follows by subtraction, so no sample is paired
    with the backends it lacks.
    """
    exact = candidates.where("status = 'success' and valid and canonical_key = truth_key").select("sample_id", "backend").distinct()
    own = exact.groupBy("backend").agg(F.count("*").alias("n"))
    both = exact.alias("a").join(exact.alias("b"), "sample_id").where("a.backend <> b.backend").groupBy(F.col("a.backend").alias("first"), F.col("b.backend").alias("second")).agg(F.count("*").alias("shared"))
    names = candidates.select("backend").distinct()  # as many rows as backends
    pairs = names.select(F.col("backend").alias("first")).crossJoin(names.select(F.col("backend").alias("second"))).where("first <> second")
    joined = pairs.join(own.select(F.col("backend").alias("first"), "n"), "first", "left").join(both, ["first", "second"], "left")
    return joined.select("first", "second", (F.coalesce("n", F.lit(0)) - F.coalesce("shared", F.lit(0))).alias("n_only_first"))


#: What trusted predictions are rated by: (measure, column of the predictions or flag).
TRUSTED = {
    "run": "recognition_success", "success": "backend_success", "valid": "valid", "exact": "exact", "isomeric_exact": "isomeric_exact",
    "key_exact": "key_exact", "full_key_exact": "full_key_exact", "connectivity_exact": "connectivity_exact", "formula_match": "formula_match",
    "connectivity_match": "connectivity_match", "nonisomeric_exact": "nonisomeric_exact", "stereo_match": "stereo_match",
    "stereo_wrong": "stereo_wrong", "charge_differs": "charge_differs",
}
IF_SUCCESS = ("valid", "exact", "isomeric_exact", "full_key_exact", "connectivity_exact", "formula_match")
IF_RUN = ("valid", "full_key_exact", "connectivity_exact")


def trusted_summary(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of the measures of ``TRUSTED``, overall or by groups: over all samples, over those whose backend
    succeeded and over those that ran; failures to run, acceptance, acceptance without the full key, and abstention.

    Connectivity that is right with wrong stereochemistry or another charge follows from the flags of a row where a table has no
    such column. A flag that is missing counts as false.
    """
    c = F.col
    rows = flags(predictions)
    right = _true(predictions, "connectivity_exact")
    derived = {"stereo_wrong": right & ~_true(predictions, "stereo_match"), "charge_differs": right & ~_true(predictions, "charge_match")}
    made = {f"is_{k}": c(f) if f in ("valid", "exact") else derived[f] if f in derived and f not in predictions.columns else _true(predictions, f) for k, f in TRUSTED.items()}
    rows = rows.withColumns(made).withColumn("accepted", F.coalesce(c("recognition_decision").isin("accepted", "accepted_with_warning"), F.lit(False)))
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[count_if(c(f"is_{k}")).alias(f"n_{k}") for k in TRUSTED],
        count_if(c("accepted")).alias("n_accepted"), count_if(c("accepted") & ~c("is_full_key_exact")).alias("n_false_accepted"),
        *[count_if(c("is_success") & c(f"is_{k}")).alias(f"n_{k}_if_success") for k in IF_SUCCESS],
        *[count_if(c("is_run") & c(f"is_{k}")).alias(f"n_{k}_if_run") for k in IF_RUN],
    ).withColumns({"n_not_run": c("n") - c("n_run"), "n_abstained": c("n") - c("n_accepted")})
    return counted.withColumns({
        **{f"{k}_rate": rate0(c(f"n_{k}"), c("n")) for k in (*TRUSTED, "not_run", "accepted", "false_accepted", "abstained")},
        **{f"{k}_if_success_rate": rate0(c(f"n_{k}_if_success"), c("n_success")) for k in IF_SUCCESS},
        **{f"{k}_if_run_rate": rate0(c(f"n_{k}_if_run"), c("n_run")) for k in IF_RUN},
    })


def by_tag(predictions: DataFrame, tags: str) -> DataFrame:
    """The trusted summary for each tag of a column with tags joined by semicolons; no tag is ``unspecified``."""
    split = F.split(F.coalesce(F.nullif(F.col(tags), F.lit("")), F.lit("unspecified")), ";")
    return trusted_summary(predictions.withColumn("tag", F.explode(split)), "tag")


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts of a whole-number column in equal bins between its extremes; one bin where they are equal."""
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))  # one row
    at = F.when(F.col("low") == F.col("high"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)))
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def counters(rows: DataFrame, *columns: str, tags: str | None = None, separator: str = ";") -> DataFrame:
    """(kind, value, n): how often each value of some columns, and each of the tags in one, occurs."""
    named = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    one = F.array(*[named(c, F.col(c).cast("string")) for c in columns])
    all_ = F.concat(one, F.transform(F.split(tags, separator), lambda t: named(tags, t))) if tags else one
    long = rows.select(F.explode(all_).alias("x")).select("x.*")
    return long.where((F.col("kind") != F.lit(tags or "")) | (F.col("value") != "")).groupBy("kind", "value").agg(F.count("*").alias("n"))


def modification_rate(rows: DataFrame, modified: Column, *by: str) -> DataFrame:
    """Rows of each group and the share of them that was modified."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bround(count_if(modified) / F.count("*"), 6).alias("modified_rate"))


def reasons_once(rows: DataFrame, key: str, reason: Column) -> DataFrame:
    """How many keys have each reason, however many of a key's rows have it; rows without one don't count."""
    return rows.select(key, reason.alias("reason")).where("reason is not null").distinct().groupBy("reason").agg(F.count("*").alias("n"))


#: What tells the models of a run apart.
ARTIFACT_FIELDS = ("model_name", "model_version", "model_sha256", "package_version", "device")


def model_artifacts(predictions: DataFrame, *by: str) -> DataFrame:
    """The distinct models that made the predictions (of each run), with all their fields; a field that is missing is null."""
    fields = [F.col(c) if c in predictions.columns else F.lit(None).cast("string").alias(c) for c in ARTIFACT_FIELDS]
    return predictions.select(*by, *fields).distinct()


def error_counts(runs: DataFrame, run: str = "backend", counts: str = "error_distribution") -> DataFrame:
    """(run, error_type, count): the counter maps of several runs as rows. An empty or missing map gives none."""
    return runs.select(run, F.explode(counts).alias("error_type", "count"))
