"""Registered queries: metrics, gates, comparisons and confusion tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.columns import codes, ladder, token_true
from lodestone.operators import confusion, metrics
from lodestone.plans.registry import query, rate
from lodestone.sources.adapters import records, twin

FLAGS = """f AS (
  SELECT *, expected_action = 'reject' AS neg, predicted_key IS NOT NULL AS valid, coalesce(predicted_key = truth_key, false) AS exact,
    recognition_decision = 'accepted' AND NOT manual_review_recommended AS auto, recognition_decision = 'review_needed' OR manual_review_recommended AS review,
    CASE WHEN expected_action = 'reject' THEN predicted_key IS NOT NULL ELSE NOT coalesce(predicted_key = truth_key, false) END AS err,
    regexp_matches(lower(concat_ws(' ', expected_action, category, complexity, structure_features, supported_scope, notes)), 'reject|distractor|non_molecule|reaction|stereo|charge|salt|fragment|metal|multiple|multi|high') AS risky
  FROM predictions)"""
COUNTS = """count(*) AS n_total, count(*) FILTER (NOT neg) AS n_positive, count(*) FILTER (neg) AS n_negative, count(*) FILTER (recognition_success) AS n_success,
    count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND NOT neg) AS n_valid_positive, count(*) FILTER (exact AND NOT neg) AS n_exact,
    count(*) FILTER (neg AND NOT valid) AS n_rejected, count(*) FILTER (neg AND valid) AS n_hallucinated, count(*) FILTER (neg AND auto) AS n_false_accept,
    count(*) FILTER (review) AS n_review, count(*) FILTER (risky AND err) AS n_high_risk_error, count(*) FILTER (risky AND err AND review) AS n_high_risk_reviewed"""
RATES = f"""{rate('n_success', 'n_total')} AS success_rate, {rate('n_valid_positive', 'n_positive', 'NULL')} AS valid_rate, {rate('n_exact', 'n_positive', 'NULL')} AS exact_rate,
    {rate('n_total - n_success', 'n_total')} AS failed_rate, {rate('n_rejected', 'n_negative', 'NULL')} AS rejection_coverage, {rate('n_hallucinated', 'n_negative', 'NULL')} AS hallucination_rate,
    {rate('n_false_accept', 'n_negative', 'NULL')} AS false_accept_rate, {rate('n_review', 'n_total')} AS review_rate, {rate('n_high_risk_reviewed', 'n_high_risk_error')} AS high_risk_reviewed_rate"""
STRUCTURE_COUNTS = """count(*) FILTER (NOT neg AND (equivalent OR exact)) AS n_equivalent, count(*) FILTER (NOT neg AND stereo_required) AS n_stereo_required,
    count(*) FILTER (NOT neg AND stereo_required AND stereo_match) AS n_stereo_exact, count(*) FILTER (NOT neg AND valid AND NOT atom_count_match) AS n_atom_count_error,
    count(*) FILTER (NOT neg AND valid AND NOT charge_match) AS n_charge_error, count(*) FILTER (NOT neg AND valid AND NOT bond_type_match) AS n_bond_type_error,
    count(*) FILTER (NOT neg AND tanimoto_similarity IS NOT NULL) AS n_similarity, count(*) FILTER (NOT neg AND tanimoto_similarity >= 0.95) AS n_above_threshold,
    count(*) FILTER (perturbation NOT IN ('', 'none')) AS n_derived, count(*) FILTER (review_status = 'verified') AS n_verified,
    count(*) FILTER (source_license IN ('', 'license unclear')) AS n_unclear_license"""
STRUCTURE_RATES = f"""{rate('n_valid', 'n_total')} AS valid_of_all_rate, {rate('n_equivalent', 'n_positive', 'NULL')} AS equivalent_rate, {rate('n_stereo_exact', 'n_stereo_required', 'NULL')} AS stereo_exact_rate,
    {rate('n_atom_count_error', 'n_valid_positive', 'NULL')} AS atom_count_error_rate, {rate('n_charge_error', 'n_valid_positive', 'NULL')} AS charge_error_rate, {rate('n_bond_type_error', 'n_valid_positive', 'NULL')} AS bond_type_error_rate,
    {rate('n_above_threshold', 'n_similarity', 'NULL')} AS above_threshold_rate, {rate('n_verified', 'n_total', 'NULL')} AS verified_rate"""


REASON = "CASE WHEN recognition_success AND predicted_key IS NULL THEN 'invalid_predicted_key' WHEN NOT recognition_success THEN coalesce(nullif(message, ''), 'recognition_failed') END"
CATEGORY = """CASE WHEN regexp_matches(lower({m}), 'timeout|timed out|超时') THEN 'timeout' WHEN regexp_matches(lower({m}), 'cuda|cudnn|cublas|gpu|out of memory|oom') THEN 'cuda_failure'
    WHEN regexp_matches(lower({m}), 'no such file|cannot identify image|decode|truncated image') THEN 'image_decode_failure' WHEN regexp_matches(lower({m}), 'preprocess|normalize|unsupported image|array dimensions') THEN 'input_preprocessing_failure'
    WHEN regexp_matches(lower({m}), 'dependency|modulenotfound|importerror|not installed') THEN 'dependency_failure' WHEN regexp_matches(lower({m}), 'subprocess|child process|return code|worker|子进程') THEN 'subprocess_failure'
    WHEN regexp_matches(lower({m}), 'inference|predict|model|推理') THEN 'model_inference_failure' ELSE 'unknown_backend_failure' END"""


def _release_sql(dimensions: list[str], overall: bool = True) -> str:
    """The whole report of a release in SQL, each part by its own plain statement."""
    parts = [f"SELECT '{d}' AS dimension, coalesce(nullif({d}, ''), 'unknown') AS value, * FROM f" for d in dimensions] + (["SELECT 'all' AS dimension, 'all' AS value, * FROM f"] if overall else [])
    return twin(f"""{FLAGS}, l AS ({' UNION ALL '.join(parts)}), s AS (SELECT dimension, value, {COUNTS}, {STRUCTURE_COUNTS} FROM l GROUP BY 1, 2),
      tr AS (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY inference_time_ms) - 1 AS at_, count(*) OVER (PARTITION BY dimension, value) AS n FROM l WHERE inference_time_ms IS NOT NULL),
      t AS (SELECT dimension, value, count(*) AS n_latency, round_even(CAST(sum(inference_time_ms) AS BIGINT) / count(*), 3) AS mean_latency_ms, round_even(median(inference_time_ms), 3) AS median_latency_ms,
        min(inference_time_ms) FILTER (at_ = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50_latency_ms, min(inference_time_ms) FILTER (at_ = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95_latency_ms FROM tr GROUP BY 1, 2),
      m AS (SELECT dimension, value, round_even(round_even(CAST(sum(CAST(tanimoto_similarity * 1000000 AS BIGINT)) AS BIGINT) / count(*), 6) / 1000000, 6) AS mean_similarity,
        round_even(median(CAST(tanimoto_similarity * 1000000 AS BIGINT)) / 1000000, 6) AS median_similarity FROM l WHERE NOT neg AND tanimoto_similarity IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT dimension, value, least(confidence_milli // 100, 9) AS bin, count(*) AS n, CAST(sum(confidence_milli) AS BIGINT) AS milli, count(*) FILTER (exact) AS correct FROM l WHERE NOT neg AND confidence_milli BETWEEN 0 AND 1000 GROUP BY 1, 2, 3),
      e AS (SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n_confidence, round_even(CAST(sum(abs(milli - 1000 * correct)) AS BIGINT) / CAST(1000 * sum(n) AS BIGINT), 6) AS calibration_error FROM b GROUP BY 1, 2),
      d AS (SELECT dimension, value, count(DISTINCT source_document) AS n_sources, count(DISTINCT source_document) FILTER (perturbation IN ('', 'none')) AS n_originals,
        count(DISTINCT identity_key) FILTER (NOT neg) AS n_identities, count(DISTINCT scaffold_key) FILTER (NOT neg AND scaffold_key <> 'none') AS n_scaffolds FROM l GROUP BY 1, 2),
      q AS (SELECT dimension, value, {REASON} AS why FROM l), r AS (SELECT dimension, value, {CATEGORY.format(m='why')} AS kind, count(*) AS n FROM q WHERE why IS NOT NULL GROUP BY 1, 2, 3),
      x AS (SELECT dimension, value, string_agg(kind || '=' || n, ';' ORDER BY kind || '=' || n) AS failure_distribution FROM r GROUP BY 1, 2)
      SELECT s.*, {RATES}, {STRUCTURE_RATES}, t.* EXCLUDE (dimension, value, n_latency), coalesce(n_latency, 0) AS n_latency, mean_similarity, median_similarity, coalesce(n_confidence, 0) AS n_confidence, calibration_error,
        n_sources, n_originals, n_identities, n_scaffolds, failure_distribution
      FROM s LEFT JOIN t USING (dimension, value) LEFT JOIN m USING (dimension, value) LEFT JOIN e USING (dimension, value) LEFT JOIN d USING (dimension, value) LEFT JOIN x USING (dimension, value)""", "predictions")


@query("a01_release_summary", _release_sql([]))
def a01(spark, d):
    return metrics.release_summary(records(spark, d, "predictions"))


@query("a02_grouped_summary", _release_sql(list(metrics.DIMENSIONS), overall=False))
def a02(spark, d):
    return metrics.release_summary(records(spark, d, "predictions"), metrics.DIMENSIONS, overall=False)


@query("a03_all_summaries", _release_sql(list(metrics.DIMENSIONS)))
def a03(spark, d):
    return metrics.release_summary(records(spark, d, "predictions"), metrics.DIMENSIONS)


@query("a04_failure_reasons", twin(f"r AS (SELECT {REASON} AS failure_reason FROM predictions) SELECT failure_reason, count(*) AS n, {CATEGORY.format(m='failure_reason')} AS category FROM r WHERE failure_reason IS NOT NULL GROUP BY 1", "predictions"))
def a04(spark, d):
    return metrics.failure_reasons(records(spark, d, "predictions"))


BLANK = "lower(trim(coalesce({c}, ''))) IN ('', 'none', 'unknown', 'unspecified', 'n/a', 'na')"
UNCLEAR = f"({BLANK.format(c='source_license')} OR regexp_matches(lower(coalesce(source_license, '')), 'no explicit|unclear|unknown|not stated|local research'))"


@query("a05_dataset_sufficiency", twin(f"""SELECT count(*) AS n_total, count(DISTINCT trim(source_document)) FILTER (NOT {BLANK.format(c='source_document')}) AS n_source_documents,
    count(DISTINCT trim(source_document)) FILTER (NOT {BLANK.format(c='source_document')} AND {BLANK.format(c='perturbation')}) AS n_original_sources, count(*) FILTER (NOT {BLANK.format(c='perturbation')}) AS n_derived,
    count(DISTINCT inchikey) FILTER (expected_action <> 'reject') AS n_identities, count(DISTINCT scaffold_key) FILTER (expected_action <> 'reject') AS n_scaffolds,
    count(*) FILTER (review_status = 'verified') AS n_verified, {rate("count(*) FILTER (review_status = 'verified')", 'count(*)', 'NULL')} AS verified_rate, count(*) FILTER ({UNCLEAR}) AS n_unclear_license FROM samples""", "samples"))
def a05(spark, d):
    return metrics.sufficiency(records(spark, d, "samples"))


def _ranks_sql(by: str) -> str:
    group, own = (f"{by},", f"PARTITION BY {by}") if by else ("", "")
    return f"""r AS (SELECT *, row_number() OVER ({own} ORDER BY inference_time_ms) - 1 AS pos_, count(*) OVER ({own}) AS n FROM predictions WHERE inference_time_ms IS NOT NULL)
      SELECT {group} count(*) AS n, round_even(CAST(sum(inference_time_ms) AS BIGINT) / count(*), 3) AS mean, round_even(median(inference_time_ms), 3) AS median,
        min(inference_time_ms) FILTER (pos_ = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50, min(inference_time_ms) FILTER (pos_ = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95 FROM r {'GROUP BY ' + by if by else ''}"""


@query("a06_latency_ranks", twin(_ranks_sql(""), "predictions"))
def a06(spark, d):
    return metrics.ranks(records(spark, d, "predictions"), "inference_time_ms")


@query("a06_latency_ranks_by_category", twin(_ranks_sql("category"), "predictions"))
def a06_by(spark, d):
    return metrics.ranks(records(spark, d, "predictions"), "inference_time_ms", "category")


@query("a07_ensemble_backends", twin(f"""t AS (SELECT count(DISTINCT sample_id) AS n_samples FROM candidates), b AS (SELECT backend, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'success' AND valid) AS n_valid,
    count(*) FILTER (canonical_key = truth_key AND valid) AS n_exact FROM candidates GROUP BY 1) SELECT *, {rate('n_success', 'n_samples')} AS success_rate, {rate('n_valid', 'n_samples')} AS valid_rate, {rate('n_exact', 'n_samples')} AS exact_rate FROM b, t""", "candidates"))
def a07(spark, d):
    return metrics.ensemble(records(spark, d, "candidates"))


@query("a07_only_correct_pairs", twin("""e AS (SELECT DISTINCT sample_id, backend FROM candidates WHERE status = 'success' AND valid AND canonical_key = truth_key), b AS (SELECT DISTINCT backend FROM candidates)
    SELECT x.backend AS first, y.backend AS second, (SELECT count(*) FROM e WHERE e.backend = x.backend AND NOT EXISTS (SELECT 1 FROM e o WHERE o.sample_id = e.sample_id AND o.backend = y.backend)) AS n_only_first FROM b x, b y WHERE x.backend <> y.backend""", "candidates"))
def a07_pairs(spark, d):
    return metrics.only_correct(records(spark, d, "candidates"))


@query("a07_only_and_missed", twin("""e AS (SELECT DISTINCT sample_id, backend FROM candidates WHERE status = 'success' AND valid AND canonical_key = truth_key), n AS (SELECT sample_id, count(*) AS n FROM e GROUP BY 1), b AS (SELECT DISTINCT backend FROM candidates)
    SELECT backend, (SELECT count(*) FROM e JOIN n USING (sample_id) WHERE n = 1 AND e.backend = b.backend) AS n_only, (SELECT count(*) FROM n) - (SELECT count(*) FROM e WHERE e.backend = b.backend) AS n_missed FROM b""", "candidates"))
def a07_only(spark, d):
    return metrics.only_and_missed(records(spark, d, "candidates"))


@query("a08_calibration", twin("""p AS (SELECT image_quality, least(floor(confidence_milli / 100), 9) AS bin, confidence_milli, coalesce(predicted_key = truth_key, false) AS exact FROM predictions WHERE expected_action <> 'reject' AND confidence_milli BETWEEN 0 AND 1000),
    b AS (SELECT image_quality, bin, count(*) AS n, count(*) FILTER (exact) AS correct, CAST(sum(confidence_milli) AS BIGINT) AS milli FROM p GROUP BY 1, 2) SELECT image_quality, CAST(sum(n) AS BIGINT) AS n, round_even(CAST(sum(abs(milli - 1000 * correct)) AS BIGINT) / CAST(1000 * sum(n) AS BIGINT), 6) AS ece FROM b GROUP BY 1""", "predictions"))
def a08(spark, d):
    return metrics.calibration(records(spark, d, "predictions"), "image_quality")


@query("a09_a10_rejection_and_review", twin(f"{FLAGS}, s AS (SELECT category, {COUNTS} FROM f GROUP BY 1) SELECT *, {RATES} FROM s", "predictions"))
def a09(spark, d):
    return metrics.summary(records(spark, d, "predictions"), "category")


_MEASURES = {
    "run": "recognition_success", "success": "backend_success", "valid": "valid", "exact": "exact", "isomeric_exact": "isomeric_exact", "key_exact": "key_exact", "full_key_exact": "full_key_exact",
    "connectivity_exact": "connectivity_exact", "formula_match": "formula_match", "connectivity_match": "connectivity_match", "nonisomeric_exact": "nonisomeric_exact", "stereo_match": "stereo_match",
    "stereo_wrong": "connectivity_exact AND NOT stereo_match", "charge_differs": "connectivity_exact AND NOT charge_match",
}
_IF = [(k, "success") for k in ("valid", "exact", "isomeric_exact", "full_key_exact", "connectivity_exact", "formula_match")] + [(k, "run") for k in ("valid", "full_key_exact", "connectivity_exact")]
_TRUSTED = f"""g AS (SELECT *, recognition_decision IN ('accepted', 'accepted_with_warning') AS acc FROM f), c AS (SELECT {{by}} count(*) AS n, {', '.join(f"count(*) FILTER ({v}) AS n_{k}" for k, v in _MEASURES.items())},
    count(*) FILTER (acc) AS n_accepted, count(*) FILTER (acc AND NOT full_key_exact) AS n_false_accepted, {', '.join(f"count(*) FILTER ({_MEASURES[k]} AND {_MEASURES[w]}) AS n_{k}_if_{w}" for k, w in _IF)} FROM {{rows}} {{group}}),
    s AS (SELECT *, n - n_run AS n_not_run, n - n_accepted AS n_abstained FROM c)
    SELECT *, {', '.join(f"{rate(f'n_{k}', 'n')} AS {k}_rate" for k in (*_MEASURES, 'not_run', 'accepted', 'false_accepted', 'abstained'))}, {', '.join(f"{rate(f'n_{k}_if_{w}', f'n_{w}')} AS {k}_if_{w}_rate" for k, w in _IF)} FROM s"""


@query("a11_trusted_summary", twin(f"{FLAGS}, " + _TRUSTED.format(by="", rows="g", group=""), "predictions"))
def a11(spark, d):
    return metrics.trusted_summary(records(spark, d, "predictions"))


@query("a12_tag_groups", twin(f"{FLAGS}, " + _TRUSTED.format(by="tag,", rows="(SELECT *, unnest(string_split(coalesce(nullif(structure_features, ''), 'unspecified'), ';')) AS tag FROM g)", group="GROUP BY tag"), "predictions"))
def a12(spark, d):
    return metrics.by_tag(records(spark, d, "predictions"), "structure_features")


@query("a13_perturbation_groups", twin(f"{FLAGS}, " + _TRUSTED.format(by="kind, severity,", rows="(SELECT *, coalesce(nullif(perturbation, ''), 'none') AS kind, CASE WHEN inference_time_ms >= 12000 THEN 'high' WHEN inference_time_ms >= 6000 THEN 'medium' ELSE 'low' END AS severity FROM g)", group="GROUP BY kind, severity"), "predictions"))
def a13(spark, d):
    t = F.col("inference_time_ms")
    rows = records(spark, d, "predictions").withColumns({"kind": F.coalesce(F.nullif("perturbation", F.lit("")), F.lit("none")), "severity": ladder("low", (t >= 12000, "high"), (t >= 6000, "medium"))})
    return metrics.trusted_summary(rows, "kind", "severity")


@query("a14_variant_consistency", twin("""v AS (SELECT sample_id, max(CASE WHEN priority = 1 THEN coalesce(canonical_key = truth_key, false) END) AS a, max(CASE WHEN priority = 2 THEN coalesce(canonical_key = truth_key, false) END) AS b,
    max(CASE WHEN priority = 3 THEN coalesce(canonical_key = truth_key, false) END) AS c FROM candidates GROUP BY 1), w AS (SELECT coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c FROM v)
    SELECT CASE WHEN a AND b AND c THEN 'all_three_correct' WHEN b AND NOT a AND NOT c THEN 'rendered_only_correct' WHEN (a OR b) AND NOT c THEN 'clean_correct_perturbed_wrong' WHEN NOT (a OR b OR c) THEN 'all_three_wrong' ELSE 'mixed_other' END AS consistency, count(*) AS n FROM w GROUP BY 1""", "candidates"))
def a14(spark, d):
    right = F.coalesce(F.col("canonical_key") == F.col("truth_key"), F.lit(False))
    at = lambda k: F.coalesce(F.max(F.when(F.col("priority") == k, right)), F.lit(False))
    a, b, c = (F.col(k) for k in "abc")
    by = records(spark, d, "candidates").groupBy("sample_id").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    kind = ladder("mixed_other", (a & b & c, "all_three_correct"), (b & ~a & ~c, "rendered_only_correct"), ((a | b) & ~c, "clean_correct_perturbed_wrong"), (~(a | b | c), "all_three_wrong"))
    return by.groupBy(kind.alias("consistency")).agg(F.count("*").alias("n"))


CLASSES = ["molecule", "text", "table", "reaction", "uncertain"]


@query("a15_confusion", twin("SELECT truth_class, predicted_class, count(*) AS n FROM classes GROUP BY 1, 2", "classes"))
def a15(spark, d):
    return confusion.confusion(records(spark, d, "classes"), "truth_class", "predicted_class")


@query("a15_confusion_wide", twin("SELECT truth_class, " + ", ".join(f"count(*) FILTER (predicted_class = '{c}') AS as_{c}" for c in CLASSES) + " FROM classes GROUP BY 1", "classes"))
def a15_wide(spark, d):
    return confusion.confusion_wide(records(spark, d, "classes"), "truth_class", "predicted_class", CLASSES)


PER_CLASS = f"""k AS (SELECT DISTINCT truth_class AS label FROM classes UNION SELECT DISTINCT predicted_class FROM classes), m AS (SELECT label, (SELECT count(*) FROM classes WHERE truth_class = label) AS support, (SELECT count(*) FROM classes WHERE predicted_class = label) AS predicted,
    (SELECT count(*) FROM classes WHERE truth_class = label AND predicted_class = label) AS correct FROM k), f1 AS (SELECT *, {rate('correct', 'predicted')} AS "precision", {rate('correct', 'support')} AS recall, {rate('2 * correct', 'support + predicted')} AS f1 FROM m)"""


@query("a16_per_class", twin(f"{PER_CLASS} SELECT * FROM f1", "classes"))
def a16(spark, d):
    return confusion.per_class(records(spark, d, "classes"), "truth_class", "predicted_class")


@query("a17_f1_averages", twin(f"{PER_CLASS} SELECT round_even(avg(2 * correct / (support + predicted)), 6) AS macro_f1, round_even(sum(2 * correct / (support + predicted) * support) / CAST(sum(support) AS BIGINT), 6) AS weighted_f1, {rate('CAST(sum(correct) AS BIGINT)', 'CAST(sum(support) AS BIGINT)')} AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM f1", "classes"))
def a17(spark, d):
    return confusion.averages(records(spark, d, "classes"), "truth_class", "predicted_class")


_BINARY = f"""b AS (SELECT {{by}} count(*) FILTER (truth_class = 'molecule' AND predicted_class = 'molecule') AS tp, count(*) FILTER (truth_class <> 'molecule' AND predicted_class = 'molecule') AS fp,
    count(*) FILTER (truth_class = 'molecule' AND predicted_class <> 'molecule') AS fn, count(*) FILTER (truth_class <> 'molecule' AND predicted_class <> 'molecule') AS tn FROM classes {{group}})
    SELECT *, {rate('tp', 'tp + fp')} AS "precision", {rate('tp', 'tp + fn')} AS recall, {rate('2 * tp', '2 * tp + fp + fn')} AS f1, {rate('fp', 'fp + tn')} AS false_positive_rate, {rate('tn', 'fp + tn')} AS negative_rejection_rate FROM b"""


@query("a18_binary", twin(_BINARY.format(by="", group=""), "classes"))
def a18(spark, d):
    return confusion.binary(records(spark, d, "classes"), "truth_class", "predicted_class", "molecule")


@query("a19_per_document", twin(_BINARY.format(by="source_document,", group="GROUP BY 1"), "classes"))
def a19(spark, d):
    return confusion.binary(records(spark, d, "classes"), "truth_class", "predicted_class", "molecule", "source_document")


@query("a20_class_errors", twin("SELECT predicted_class || '->' || truth_class AS error, count(*) AS n FROM classes WHERE predicted_class <> truth_class GROUP BY 1", "classes"))
def a20(spark, d):
    return confusion.errors(records(spark, d, "classes"), "truth_class", "predicted_class")


@query("a23_failure_matrix", twin(f"r AS (SELECT *, {REASON} AS failure_reason FROM predictions) SELECT category, image_quality, recognition_decision, {CATEGORY.format(m='failure_reason')} AS failure_category, count(*) AS n FROM r WHERE failure_reason IS NOT NULL GROUP BY 1, 2, 3, 4", "predictions"))
def a23(spark, d):
    rows = metrics.flags(records(spark, d, "predictions")).where("failure_reason is not null")
    return rows.groupBy("category", "image_quality", "recognition_decision", rules.failure_category(F.col("failure_reason")).alias("failure_category")).agg(F.count("*").alias("n"))


@query("a24_mean_statistics", twin("SELECT perturbation, round_even(CAST(sum(inference_time_ms) AS BIGINT) / count(*), 6) AS mean_latency_ms, round_even(CAST(sum(confidence_milli) AS BIGINT) / (1000 * count(*)), 6) AS mean_confidence FROM predictions GROUP BY 1", "predictions"))
def a24(spark, d):
    return records(spark, d, "predictions").groupBy("perturbation").agg(F.bround(F.sum("inference_time_ms") / F.count("*"), 6).alias("mean_latency_ms"), F.bround(F.sum("confidence_milli") / (1000 * F.count("*")), 6).alias("mean_confidence"))


@query("a33_histogram", twin("""e AS (SELECT min(inference_time_ms) AS low, max(inference_time_ms) AS high FROM predictions) SELECT CAST(CASE WHEN low = high THEN 0 ELSE least(floor((inference_time_ms - low) * 10 / (high - low)), 9) END AS INTEGER) AS bin, count(*) AS n, min(inference_time_ms) AS least, max(inference_time_ms) AS most FROM predictions, e GROUP BY 1""", "predictions"))
def a33(spark, d):
    return metrics.histogram(records(spark, d, "predictions"), "inference_time_ms")


GATES = f"""{FLAGS}, s AS (SELECT {COUNTS} FROM f), r AS (SELECT *, {RATES} FROM s), l AS (SELECT *, row_number() OVER (ORDER BY inference_time_ms) - 1 AS pos_, count(*) OVER () AS n FROM predictions),
    v AS (SELECT r.*, (SELECT min(inference_time_ms) FROM l WHERE pos_ = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95, (SELECT count(DISTINCT source_document) FROM predictions) AS docs FROM r),
    c AS (SELECT 'valid_rate' AS "check", 'min' AS side, 0.95::DOUBLE AS threshold, valid_rate AS value FROM v UNION ALL SELECT 'exact_rate', 'min', 0.8, exact_rate FROM v UNION ALL SELECT 'false_accept_rate', 'max', 0.05, false_accept_rate FROM v
    UNION ALL SELECT 'high_risk_review_rate', 'min', 1.0, CASE WHEN n_high_risk_error = 0 THEN 1.0 ELSE high_risk_reviewed_rate END FROM v UNION ALL SELECT 'p95_latency_ms', 'max', 15000.0, p95 FROM v
    UNION ALL SELECT 'n_positive', 'min', 100.0, n_positive FROM v UNION ALL SELECT 'n_negative', 'min', 20.0, n_negative FROM v UNION ALL SELECT 'n_source_documents', 'min', 30.0, docs FROM v),
    p AS (SELECT *, coalesce(CASE side WHEN 'min' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM c) SELECT *, bool_and(passed) OVER () AS all_passed FROM p"""


@query("a37_release_gates", twin(GATES, "predictions"))
def a37(spark, d):
    return metrics.gates(records(spark, d, "predictions"))


_SIDE = "(SELECT category, {c} FROM (SELECT * FROM f WHERE sample_id % 2 = {k}) f GROUP BY 1)"
METRICS = {"valid_rate": "higher", "exact_rate": "higher", "false_accept_rate": "lower", "failed_rate": "lower"}
_DELTA = " UNION ALL ".join(f"SELECT c.category, '{m}' AS metric, '{s}' AS direction, c.{m} AS current, p.{m} AS previous FROM c JOIN p USING (category)" for m, s in METRICS.items())


@query("j06_run_comparison", twin(f"""{FLAGS}, c AS (SELECT *, {RATES} FROM {_SIDE.format(c=COUNTS, k=1)}), p AS (SELECT *, {RATES} FROM {_SIDE.format(c=COUNTS, k=0)}), x AS ({_DELTA}), y AS (SELECT *, round_even(current - previous, 6) AS delta FROM x)
    SELECT *, coalesce(CASE direction WHEN 'higher' THEN delta < -0.01 ELSE delta > 0.01 END, false) AS regressed FROM y""", "predictions"))
def j06(spark, d):
    rows = records(spark, d, "predictions")
    # Two runs over one table: odd and even samples.
    now, before = (metrics.summary(rows.where(F.col("sample_id") % 2 == k), "category") for k in (1, 0))
    return metrics.compare(now, before, "category", METRICS, tolerance=0.01)


@query("a38_comparison_gates", twin(f"""{FLAGS}, c AS (SELECT *, {RATES} FROM {_SIDE.format(c=COUNTS, k=1)}), p AS (SELECT *, {RATES} FROM {_SIDE.format(c=COUNTS, k=0)}), x AS ({_DELTA}), y AS (SELECT *, round_even(current - previous, 6) AS delta FROM x)
    SELECT metric, count(*) AS n, count(*) FILTER (delta < 0) AS n_fell, bool_and(NOT coalesce(CASE direction WHEN 'higher' THEN delta < -0.01 ELSE delta > 0.01 END, false)) AS passed FROM y GROUP BY 1""", "predictions"))
def a38(spark, d):
    return j06(spark, d).groupBy("metric").agg(F.count("*").alias("n"), F.count(F.when(F.col("delta") < 0, 1)).alias("n_fell"), F.bool_and(~F.col("regressed")).alias("passed"))


@query("a39_classification_scores", twin("""s AS (SELECT coalesce(predicted_key = truth_key, false) AS y, confidence_milli AS s FROM predictions), g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s GROUP BY 1),
    a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), b AS (SELECT *, CAST(sum(p) OVER (ORDER BY s DESC) AS BIGINT) AS up, CAST(sum(n) OVER (ORDER BY s DESC) AS BIGINT) AS fup FROM a), o AS (SELECT CAST(sum(p) FILTER (s >= 500) AS BIGINT) AS tp, CAST(sum(n) FILTER (s >= 500) AS BIGINT) AS fp, CAST(sum(p) FILTER (s < 500) AS BIGINT) AS fn, CAST(sum(n) FILTER (s < 500) AS BIGINT) AS tn,
    CAST(sum(2 * p * below + p * n) AS BIGINT) AS twice, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, sum(CASE WHEN p > 0 THEN p * up / (up + fup) END) AS precisions FROM b)
    SELECT tp, fp, fn, tn, round_even((tp + tn) / (pos + neg), 6) AS accuracy, round_even((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round_even(twice / (2 * pos * neg), 6) AS roc_auc, round_even((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) AS macro_precision, round_even((tp / pos + tn / neg) / 2, 6) AS macro_recall, round_even((2 * tp / (pos + tp + fp) + 2 * tn / (neg + tn + fn)) / 2, 6) AS macro_f1, round_even(precisions / pos, 6) AS pr_auc FROM o""", "predictions"))
def a39(spark, d):
    rows = records(spark, d, "predictions").withColumn("exact", F.coalesce(F.col("predicted_key") == F.col("truth_key"), F.lit(False)))
    return confusion.binary_scores(rows, "exact", "confidence_milli")


@query("a40_regression_scores", twin("""r AS (SELECT molecular_weight::DOUBLE AS t, (molecular_weight - 60 * (1 + rotatable_bonds))::DOUBLE AS e FROM properties) SELECT count(*) AS n, round_even(sum(abs(e)) / count(*), 6) AS mae, round_even(sqrt(sum(e * e) / count(*)), 6) AS rmse, round_even(1 - sum(e * e) / (sum(t * t) - sum(t) * sum(t) / count(*)), 6) AS r2 FROM r""", "properties"))
def a40(spark, d):
    return confusion.regression(records(spark, d, "properties").withColumn("guess", 60 * (1 + F.col("rotatable_bonds"))), "molecular_weight", "guess")


@query("p06_p12_prediction_flags", twin(f"""{FLAGS} SELECT sample_id, NOT neg AS is_positive, valid, exact, auto AS auto_accept, review, err AS error, risky AS high_risk, perturbation = 'blur' AS derived, {REASON} AS failure_reason, neg AND NOT recognition_success AS rejection_success FROM f""", "predictions"))
def p06(spark, d):
    return metrics.flags(records(spark, d, "predictions")).select("sample_id", "is_positive", "valid", "exact", "auto_accept", "review", "error", "high_risk", "derived", "failure_reason", "rejection_success")


#: The statements of the samples, with what each is.
KEYS = """keys(source_license, license_key) AS (VALUES ('CC BY 4.0', 'cc-by-4.0'), ('https://creativecommons.org/licenses/by-sa/3.0/', 'cc-by-sa-3.0'), ('CC0', 'cc0-1.0'), ('CC BY', ''),
    ('Public Domain (PubChem)', 'public-domain-pubchem'), ('No explicit repository license found', ''), ('', ''), ('CC BY-NC 4.0', ''))"""


@query("p13_p14_licenses", twin(f"{KEYS}, k AS (SELECT sample_id, source_license, license_key FROM samples JOIN keys USING (source_license)) SELECT sample_id, license_key, license_key IN {rules.ALLOWED_LICENSES} AS allowed, {UNCLEAR} AS unclear FROM k", "samples"))
def p13(spark, d):
    c = F.col("source_license")
    return records(spark, d, "samples").select("sample_id", rules.license_key(c).alias("license_key"), rules.license_allowed(c).alias("allowed"), rules.unclear_license(c).alias("unclear"))


@query("p11_rejection_targets", twin("""m AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN '' ELSE expected_action END AS expected, category, structure_features FROM predictions)
    SELECT expected = 'reject' OR (expected = '' AND (contains(lower(category), 'low') OR contains(structure_features, 'salt'))) AS target, count(*) AS n FROM m GROUP BY 1""", "predictions"))
def p11(spark, d):
    expected = F.when(F.col("sample_id") % 3 == 0, "").otherwise(F.col("expected_action"))
    target = rules.rejection_target(expected, ("low", "salt"), F.col("category"), F.col("structure_features"))
    return records(spark, d, "predictions").groupBy(target.alias("target")).agg(F.count("*").alias("n"))


@query("p15_failure_categories", twin(f"""m AS (SELECT sample_id, CASE sample_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'odd' ELSE '' END AS given, CASE WHEN sample_id % 7 = 0 THEN 'C1=' ELSE '' END AS raw, CASE WHEN sample_id % 11 = 0 THEN 'Invalid SMILES' ELSE message END AS message, recognition_success FROM predictions)
    SELECT sample_id, CASE WHEN given = 'timeout' THEN given WHEN NOT recognition_success AND (raw <> '' OR message = 'Invalid SMILES') THEN 'output_parse_failure' ELSE {CATEGORY.format(m="message")} END AS category FROM m""", "predictions"))
def p15_full(spark, d):
    c = F.col
    given = ladder("", (c("sample_id") % 4 == 0, "timeout"), (c("sample_id") % 4 == 1, "odd"))
    raw, message = F.when(c("sample_id") % 7 == 0, "C1=").otherwise(""), F.when(c("sample_id") % 11 == 0, "Invalid SMILES").otherwise(c("message"))
    return records(spark, d, "predictions").select("sample_id", rules.failure_category(message, given, raw, ~c("recognition_success")).alias("category"))


@query("p15_p16_failure_messages", twin(f"SELECT sample_id, {CATEGORY.format(m='message')} AS category, replace(message, '/var/lib/models/a.bin', '<path>') AS line FROM predictions WHERE message <> ''", "predictions"))
def p15(spark, d):
    c = F.col("message")
    return records(spark, d, "predictions").where("message <> ''").select("sample_id", rules.failure_category(c).alias("category"), rules.tidy_message(c).alias("line"))


@query("p19_structural_errors", twin("""SELECT sample_id, backend, CASE WHEN status <> 'success' THEN 'backend_failure' WHEN NOT valid THEN 'invalid_structure' WHEN canonical_key = truth_key AND atom_count % 2 = 1 THEN 'stereochemistry_error' WHEN atom_count % 7 < 1 THEN 'missing_fragment' WHEN atom_count % 7 > 5 THEN 'extra_fragment'
    WHEN formal_charge <> 0 THEN 'charge_error' WHEN atom_count > 30 THEN 'wrong_atom' WHEN atom_count > 20 THEN 'wrong_bond_order' WHEN canonical_key <> truth_key THEN 'wrong_connectivity' ELSE 'structural_mismatch_unclassified' END AS error FROM candidates""", "candidates"))
def p19(spark, d):
    c = F.col
    same = c("canonical_key") == c("truth_key")
    kind = rules.structural_error(c("status") == "success", c("valid"), same, c("atom_count") % 2 == 0, c("atom_count") % 7, F.when(c("atom_count") % 7 < 1, 1).when(c("atom_count") % 7 > 5, 5).otherwise(c("atom_count") % 7), c("formal_charge") == 0, c("atom_count") <= 30, c("atom_count") <= 20, same)
    return records(spark, d, "candidates").select("sample_id", "backend", kind.alias("error"))


@query("p21_release_errors", twin(f"{FLAGS} SELECT sample_id, expected_action, category, CASE WHEN neg THEN 'negative_hallucination' WHEN NOT recognition_success THEN 'recognition_failed' WHEN NOT valid THEN 'invalid_predicted_key' ELSE 'not_exact' END AS reason, inference_time_ms FROM f WHERE err", "predictions"))
def p21(spark, d):
    c = F.col
    rows = metrics.flags(records(spark, d, "predictions")).where("error")
    return rows.select("sample_id", "expected_action", "category", ladder("not_exact", (c("is_negative"), "negative_hallucination"), (~c("success"), "recognition_failed"), (~c("valid"), "invalid_predicted_key")).alias("reason"), "inference_time_ms")


@query("p24_complexity", twin("SELECT compound_id, CASE WHEN molecular_weight // 13 <= 12 AND ring_count <= 1 THEN 'small_low_complexity' WHEN molecular_weight // 13 >= 35 OR ring_count >= 5 THEN 'large_high_complexity' ELSE 'medium_complexity' END AS complexity FROM properties", "properties"))
def p24(spark, d):
    return records(spark, d, "properties").select("compound_id", rules.complexity_group(F.floor(F.col("molecular_weight") / 13), F.col("ring_count")).alias("complexity"))


@query("p31_property_filter", twin("""v AS (SELECT compound_id, list_filter(['molecular_weight', 'logp', 'hbd', 'hba', 'rotatable_bonds'], lambda x: CASE x WHEN 'molecular_weight' THEN molecular_weight > 500 WHEN 'logp' THEN logp > 5 WHEN 'hbd' THEN hbd > 5 WHEN 'hba' THEN hba > 10 ELSE rotatable_bonds > 10 END) AS v FROM properties)
    SELECT compound_id, array_to_string(v, ',') AS violations, len(v) = 0 AS passes FROM v""", "properties"))
def p31(spark, d):
    found = records(spark, d, "properties").select("compound_id", rules.property_violations().alias("v"))
    return found.select("compound_id", F.array_join("v", ",").alias("violations"), (F.size("v") == 0).alias("passes"))


@query("p32_feature_tags", twin("""SELECT compound_id, coalesce(nullif(concat_ws(',', CASE WHEN formal_charge <> 0 THEN 'formal_charge' END, CASE WHEN ring_count >= 3 THEN 'high_ring_count' END, CASE WHEN molecular_weight >= 500 THEN 'large_molecular_weight' END,
    CASE WHEN ring_count <= 1 AND molecular_weight < 350 THEN 'simple_organic' END, CASE WHEN molecular_weight < 200 THEN 'small_molecule' END), ''), 'other') AS tags FROM properties""", "properties"))
def p32(spark, d):
    c = F.col
    tags = F.array_sort(codes(("small_molecule", c("molecular_weight") < 200), ("large_molecular_weight", c("molecular_weight") >= 500), ("simple_organic", (c("ring_count") <= 1) & (c("molecular_weight") < 350)), ("high_ring_count", c("ring_count") >= 3), ("formal_charge", c("formal_charge") != 0)))
    return records(spark, d, "properties").select("compound_id", F.array_join(F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags), ",").alias("tags"))


@query("p33_quality_score", twin("SELECT sample_id, greatest(0, 1000 - inference_time_ms // 40 - CASE WHEN confidence_milli < 300 THEN 300 ELSE 0 END) AS score_milli, concat_ws(',', CASE WHEN inference_time_ms > 15000 THEN 'slow' END, CASE WHEN confidence_milli < 300 THEN 'low_confidence' END) AS reasons FROM predictions", "predictions"))
def p33(spark, d):
    t, m = F.col("inference_time_ms"), F.col("confidence_milli")
    score = F.greatest(F.lit(0), 1000 - F.floor(t / 40) - F.when(m < 300, 300).otherwise(0))
    return records(spark, d, "predictions").select("sample_id", score.alias("score_milli"), F.array_join(codes(("slow", t > 15000), ("low_confidence", m < 300)), ",").alias("reasons"))


@query("p06_token_booleans", twin("SELECT sample_id, CAST(sample_id % 4 AS VARCHAR) AS token, sample_id % 4 = 1 AS yes FROM predictions", "predictions"))
def p06_tokens(spark, d):
    token = (F.col("sample_id") % 4).cast("string")
    return records(spark, d, "predictions").select("sample_id", token.alias("token"), token_true(F.concat(F.lit(" "), token)).alias("yes"))
