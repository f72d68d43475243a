"""Registered queries: findings of labelled samples, quality gates of models, models and errors of runs, review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import confusion, metrics, review, validation
from lodestone.plans.registry import query
from lodestone.sources.adapters import records, twin

_CATEGORIES = ("molecule", "text", "odd", "Molecule ", "invalid_crop", "logo")


@query("p30_row_findings", twin(f"""f AS (SELECT sample_id, sample_id AS n, source_document, CASE WHEN sample_id % 13 = 0 THEN ' ' ELSE 'u' END AS source_url, source_license, CASE WHEN sample_id % 17 <> 0 THEN 'x' END AS attribution,
      lower(trim({list(_CATEGORIES)}[sample_id % 6 + 1])) AS category, expected_action, review_status, content_key, inchikey,
      CASE sample_id % 7 WHEN 0 THEN NULL WHEN 1 THEN [1, 2] WHEN 2 THEN [-1, 0, 5, 5] WHEN 3 THEN [0, 0, 500, 10] WHEN 4 THEN [0, 0, 10, NULL] ELSE [1, 1, 9, 9] END AS bbox FROM samples),
    g AS (SELECT *, bbox IS NOT NULL AND (len(bbox) <> 4 OR list_contains(list_transform(bbox, lambda v: v IS NULL), true)) AS odd_box, n % 7 = 2 AS empty_box, n % 7 = 3 AND n % 2 = 0 AS beyond,
      CASE WHEN category IN ('molecule', 'text', 'logo') THEN category ELSE 'invalid_crop' END AS kind, n % 3 <> 0 AS va, n % 4 <> 1 AS vb, n % 11 = 0 AS vc FROM f)
    SELECT sample_id, list_filter([CASE WHEN sample_id IS NULL THEN 'missing_sample_id' END, CASE WHEN trim(coalesce(source_document, '')) = '' THEN 'missing_source_document' END, CASE WHEN trim(source_url) = '' THEN 'missing_source_url' END,
        CASE WHEN trim(source_license) = '' THEN 'missing_source_license' END, CASE WHEN attribution IS NULL THEN 'missing_attribution' END, CASE WHEN review_status = '' THEN 'missing_review_status' END,
        CASE WHEN n % 19 = 0 AND content_key IS NOT NULL THEN 'image_sha256_mismatch' END, CASE WHEN odd_box THEN 'invalid_bbox' END, CASE WHEN empty_box THEN 'bbox_out_of_bounds_or_empty' END, CASE WHEN beyond THEN 'bbox_out_of_bounds' END,
        CASE WHEN category = 'odd' THEN 'invalid_category' END, CASE WHEN n % 9 <> 0 AND n % 8 = 0 THEN 'invalid_reference_smiles' END, CASE WHEN n % 29 = 0 AND inchikey IS NOT NULL THEN 'source_inchikey_mismatch' END], lambda x: x IS NOT NULL) AS errors,
      list_filter([CASE WHEN n % 3 = 0 AND n % 5 = 0 THEN 'perceptual_hash_mismatch' END, CASE WHEN n % 4 = 0 AND NOT odd_box AND NOT empty_box AND NOT beyond THEN 'bbox_touches_structure_edge' END,
        CASE WHEN kind = 'molecule' AND NOT (va AND vb AND n % 2 = 0) THEN 'model_disagreement' END, CASE WHEN kind = 'molecule' AND va::INT + vb::INT + vc::INT = 1 THEN 'only_one_valid_model' END,
        CASE WHEN kind <> 'molecule' AND (va OR vb OR vc) THEN 'negative_sample_has_valid_smiles' END, CASE WHEN n % 10 < 5.5 THEN 'low_image_quality' END], lambda x: x IS NOT NULL) AS risks FROM g""", "samples"))
def p30(spark, d):
    c, n = F.col, F.col("sample_id")
    box = lambda *v: F.array(*[F.lit(x).cast("int") for x in v])
    boxes = F.when(n % 7 == 1, box(1, 2)).when(n % 7 == 2, box(-1, 0, 5, 5)).when(n % 7 == 3, box(0, 0, 500, 10)).when(n % 7 == 4, box(0, 0, 10, None)).when(n % 7 != 0, box(1, 1, 9, 9))
    backend = lambda name, valid, key: F.struct(F.lit(name).alias("backend"), valid.alias("valid"), key.alias("key"))
    rows = records(spark, d, "samples").withColumns({
        "source_url": F.when(n % 13 == 0, " ").otherwise("u"), "attribution": F.when(n % 17 != 0, "x"), "category": F.element_at(F.array(*map(F.lit, _CATEGORIES)), (n % 6 + 1).cast("int")),
        "image_sha256": c("content_key"), "found_sha256": F.when(n % 19 == 0, "0").when(n % 23 != 0, c("content_key")), "perceptual_hash": F.when(n % 3 == 0, "p"), "found_phash": F.when(n % 5 == 0, "q").otherwise("p"),
        "bbox": boxes, "page_width": F.when(n % 2 == 0, 400), "page_height": F.lit(400), "edge_ink": n % 4 == 0, "quality": (n % 10) / 10.0,
        "reference_smiles": F.when(n % 9 == 0, "").otherwise("C"), "reference_valid": n % 8 != 0, "reference_inchikey": c("inchikey"), "source_inchikey": F.when(n % 29 == 0, "K").when(n % 8 != 0, c("inchikey")),
        "backends": F.array(backend("a", n % 3 != 0, F.concat(F.lit("K"), (n % 2).cast("string"))), backend("b", n % 4 != 1, F.lit("K0")), backend("c", n % 11 == 0, F.lit("K1"))),
    })
    return validation.row_findings(rows)


@query("a41_quality_gate", twin("""r AS (SELECT source_document AS model, confidence_milli AS s, coalesce(predicted_key = truth_key, false) AS y FROM predictions UNION ALL SELECT 'few ' || CAST(sample_id % 3 AS VARCHAR), confidence_milli, true FROM predictions WHERE sample_id < 12 UNION ALL SELECT 'one class', confidence_milli, true FROM predictions),
    c AS (SELECT model, s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY 1, 2), u AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c),
    b AS (SELECT model, sum(p) AS p, sum(q) AS q, sum(p * (2 * under + q)) AS pairs, coalesce(sum(p) FILTER (s >= 500), 0) AS tp, coalesce(sum(q) FILTER (s >= 500), 0) AS fp FROM u GROUP BY 1),
    f AS (SELECT model, p + q AS n, CASE WHEN 2 * tp + fp + p - tp > 0 THEN 2 * tp / (2 * tp + fp + p - tp) ELSE 0 END AS yes, CASE WHEN 2 * (q - fp) + p - tp + fp > 0 THEN 2 * (q - fp) / (2 * (q - fp) + p - tp + fp) ELSE 0 END AS no,
      (p + tp + fp > 0)::INT + (q + p + q - tp - fp > 0)::INT AS classes, CASE WHEN p > 0 AND q > 0 THEN round_even(pairs / (2 * p * q), 6) END AS roc_auc FROM b),
    k AS (SELECT 'classification' AS task, model, CAST(n AS BIGINT) AS n, roc_auc, round_even((yes + no) / classes, 6) AS f1_macro, NULL::DOUBLE AS r2 FROM f),
    m AS (SELECT source_document AS model, count(*) AS n, sum(inference_time_ms) AS s, sum(inference_time_ms * inference_time_ms) AS ss, sum((inference_time_ms - confidence_milli * 20) * (inference_time_ms - confidence_milli * 20)) AS e FROM predictions GROUP BY 1),
    z AS (SELECT 'regression' AS task, model, n, NULL::DOUBLE, NULL::DOUBLE, CASE WHEN ss::DOUBLE - s::DOUBLE * s::DOUBLE / n > 0 THEN round_even(1 - e::DOUBLE / (ss::DOUBLE - s::DOUBLE * s::DOUBLE / n), 6) END FROM m),
    a AS (SELECT * FROM k UNION ALL SELECT * FROM z)
    SELECT *, CASE WHEN n < 4 THEN false WHEN task = 'regression' THEN coalesce(r2, -999) >= 0 WHEN roc_auc IS NOT NULL THEN roc_auc >= 0.6 AND f1_macro >= 0.5 ELSE f1_macro >= 0.5 END AS passed,
      CASE WHEN n < 4 THEN 'validation_rows_below_4' WHEN task = 'regression' THEN CASE WHEN coalesce(r2, -999) >= 0 THEN 'r2_met' ELSE 'r2_below' END WHEN roc_auc IS NOT NULL THEN CASE WHEN roc_auc >= 0.6 AND f1_macro >= 0.5 THEN 'roc_auc_f1_met' ELSE 'roc_auc_f1_below' END
        ELSE CASE WHEN f1_macro >= 0.5 THEN 'f1_met' ELSE 'f1_below' END END AS reason FROM a""", "predictions"))
def a41(spark, d):
    c, p = F.col, records(spark, d, "predictions")
    right = F.coalesce(c("predicted_key") == c("truth_key"), F.lit(False))
    rows = p.select(c("source_document").alias("model"), "confidence_milli", right.alias("y"))
    few = p.where("sample_id < 12").select(F.concat(F.lit("few "), (c("sample_id") % 3).cast("string")).alias("model"), "confidence_milli", F.lit(True).alias("y"))
    scores = confusion.group_scores(rows.unionByName(few).unionByName(p.select(F.lit("one class").alias("model"), "confidence_milli", F.lit(True).alias("y"))), "model", "y", "confidence_milli", 500)
    fits = confusion.group_r2(p.select(c("source_document").alias("model"), "inference_time_ms", (c("confidence_milli") * 20).alias("predicted")), "model", "inference_time_ms", "predicted")
    tasks = scores.withColumns({"task": F.lit("classification"), "r2": F.lit(None).cast("double")}).unionByName(fits.withColumn("task", F.lit("regression")), allowMissingColumns=True)
    gate = confusion.quality_gate(c("task"), c("n"), c("roc_auc"), c("f1_macro"), c("r2"))
    return tasks.withColumn("gate", gate).select("task", "model", "n", "roc_auc", "f1_macro", "r2", "gate.passed", "gate.reason")


@query("a43_model_artifacts", """SELECT DISTINCT 'm' || CAST(l_linenumber AS VARCHAR) AS model_name, 'v' || CAST(l_suppkey % 3 AS VARCHAR) AS model_version, md5(CAST(l_suppkey % 3 AS VARCHAR)) AS model_sha256, CAST(NULL AS VARCHAR) AS package_version, CASE WHEN l_returnflag = 'R' THEN 'cpu' ELSE 'gpu' END AS device FROM lineitem""")
def a43(spark, d):
    v = (F.col("l_suppkey") % 3).cast("string")
    made = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model_name"), F.concat(F.lit("v"), v).alias("model_version"), F.md5(v.cast("binary")).alias("model_sha256"), F.when(F.col("l_returnflag") == "R", "cpu").otherwise("gpu").alias("device"))
    return metrics.model_artifacts(made)


@query("a45_error_counts", twin("SELECT backend, CASE WHEN status = 'failed' THEN 'failed' WHEN NOT valid THEN 'invalid' ELSE 'wrong' END AS error_type, count(*) AS count FROM candidates WHERE status = 'failed' OR NOT valid OR canonical_key <> truth_key GROUP BY 1, 2", "candidates"))
def a45(spark, d):
    c = F.col
    error = F.when(c("status") == "failed", "failed").when(~c("valid"), "invalid").when(c("canonical_key") != c("truth_key"), "wrong")
    counted = records(spark, d, "candidates").groupBy("backend", error.alias("error_type")).agg(F.count("*").alias("count"))
    # The maps of the runs, as their metrics files hold them.
    runs = counted.groupBy("backend").agg(F.map_from_entries(F.collect_list(F.when(c("error_type").isNotNull(), F.struct("error_type", "count")))).alias("error_distribution"))
    return metrics.error_counts(runs)


@query("a28_review_queue", twin("""r AS (SELECT sample_id - sample_id % 2 AS id, ['pending_human_review', 'rejected_license', 'machine_verified', 'pending_machine_review', 'rejected_invalid'][sample_id % 5 + 1] AS v, CASE WHEN sample_id % 4 = 0 THEN 'molecule' WHEN sample_id % 4 = 1 THEN '' END AS mc, CASE WHEN sample_id % 3 = 0 THEN 'molecule' ELSE 'text' END AS cat,
      CASE sample_id % 7 WHEN 0 THEN ' PubChem' WHEN 1 THEN 'chembl' ELSE 'guess' END AS o, sample_id % 2 = 0 AS ok FROM samples), a AS (SELECT sample_id + 3 AS id, CASE WHEN sample_id % 10 = 5 THEN 'text' ELSE 'valid_single_molecule_crop' END AS s FROM samples WHERE sample_id % 5 = 0),
    x AS (SELECT DISTINCT id FROM r WHERE v = 'pending_human_review'), y AS (SELECT id FROM r WHERE v LIKE 'rejected%' UNION SELECT id FROM a WHERE s = 'text')
    SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM x) AS machine_routed_visual, (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM a)) AS visual_remaining, (SELECT count(*) FROM x) AS pending_human, (SELECT count(*) FROM r WHERE v = 'machine_verified') AS machine_verified,
      (SELECT count(*) FROM r WHERE v = 'pending_machine_review') AS pending_machine, (SELECT count(*) FROM a) AS reviewed, (SELECT count(*) FROM y) AS rejected, (SELECT count(*) FROM r WHERE v LIKE 'rejected%') AS machine_rejected, (SELECT count(*) FROM a WHERE s = 'text') AS visual_negative,
      (SELECT count(*) FROM r WHERE coalesce(nullif(mc, ''), cat) = 'molecule') AS positive_candidates, (SELECT count(*) FROM r WHERE coalesce(nullif(mc, ''), cat) <> 'molecule') AS negative_candidates, (SELECT count(*) FROM r WHERE lower(trim(o)) IN ('pubchem', 'chembl') AND ok) AS trusted_structure_labels""", "samples"))
def a28(spark, d):
    n, s = F.col("sample_id"), records(spark, d, "samples").select("sample_id")
    status = F.element_at(F.array(*map(F.lit, ("pending_human_review", "rejected_license", "machine_verified", "pending_machine_review", "rejected_invalid"))), (n % 5 + 1).cast("int"))
    origin = F.when(n % 7 == 0, " PubChem").when(n % 7 == 1, "chembl").otherwise("guess")
    rows = s.select((n - n % 2).alias("sample_id"), status.alias("verification_status"), F.when(n % 4 == 0, "molecule").when(n % 4 == 1, "").alias("machine_category"), F.when(n % 3 == 0, "molecule").otherwise("text").alias("category"), origin.alias("ground_truth_origin"), (n % 2 == 0).alias("structure_valid"))
    audits = s.where(n % 5 == 0).select((n + 3).alias("sample_id"), F.when(n % 10 == 5, "text").otherwise("valid_single_molecule_crop").alias("visual_review_status"))
    return review.review_queue_statistics(rows, audits)


_FEATURES = ("confidence", "image_quality", "outputs_agree")


@query("p43_feature_guard", twin("""f AS (SELECT 'confidence' AS feature, sample_id % 3 = 0 AS lacks FROM predictions UNION ALL SELECT 'image_quality', image_quality = 'P' FROM predictions UNION ALL SELECT 'outputs_agree', true FROM predictions)
    SELECT feature, 'missing' AS finding, count(*) AS n FROM f WHERE lacks GROUP BY 1 UNION ALL SELECT CASE WHEN sample_id % 2 = 0 THEN 'Truth_Key' ELSE 'canonical_exact_match' END, 'forbidden', count(*) FROM predictions GROUP BY 1
    UNION ALL SELECT 'latency ' || category, 'unsupported', count(*) FROM predictions GROUP BY 1""", "predictions"))
def p43(spark, d):
    c = F.col
    name = F.when(c("sample_id") % 2 == 0, "Truth_Key").otherwise("canonical_exact_match")
    pairs = [F.when(c("sample_id") % 3 != 0, F.struct(F.lit("confidence").alias("k"), F.lit("1").alias("v"))), F.when(c("image_quality") != "P", F.struct(F.lit("image_quality").alias("k"), F.lit("1").alias("v")))]
    pairs += [F.struct(n.alias("k"), F.lit("1").alias("v")) for n in (name, F.concat(F.lit("latency "), "category"))]
    rows = records(spark, d, "predictions").select(F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("features"))
    return validation.feature_findings(rows, "features", _FEATURES)
