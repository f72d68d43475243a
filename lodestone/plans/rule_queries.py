"""Registered queries: decision ladders, projections and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import decisions, measures, states
from lodestone.functions.columns import codes, count_if, filled, ladder
from lodestone.functions.rules import license_allowed
from lodestone.operators import consensus, dedup, metrics, reports, review, splits, validation
from lodestone.operators.tables import materialise
from lodestone.plans.job_queries import nested_reports
from lodestone.plans.registry import query
from lodestone.sources.adapters import records, twin


@query("p25_recognition_decisions", twin("""x AS (SELECT *, CASE WHEN inference_time_ms > 14000 THEN ['blurred'] ELSE [] END AS seen, CASE WHEN structure_features = '' THEN [] ELSE string_split(structure_features, ';') END AS odd FROM predictions),
    r AS (SELECT sample_id, seen, odd, CASE WHEN sample_id % 23 = 0 THEN 0 WHEN NOT recognition_success THEN 1 WHEN predicted_key IS NULL THEN 2 WHEN sample_id % 10 = 0 THEN 3 WHEN inference_time_ms > 16000 THEN 4 WHEN sample_id % 4 <> 0 AND confidence_milli >= 800 AND structure_features = '' THEN 5 WHEN sample_id % 4 <> 0 AND confidence_milli < 300 THEN 6 WHEN structure_features <> '' THEN 7 ELSE 8 END AS k FROM x)
    SELECT sample_id, ['accepted', 'rejected', 'rejected', 'review_needed', 'review_needed', 'accepted', 'review_needed', 'review_needed', 'review_needed'][k + 1] AS decision, ['low', 'high', 'high', 'high', 'high', 'low', 'high', 'medium', 'medium'][k + 1] AS risk,
      CASE WHEN k = 0 THEN 'manual_smiles_input' ELSE array_to_string(list_sort(list_distinct(list_concat(list_concat(seen, CASE WHEN k > 3 THEN odd ELSE [] END), CASE WHEN k = 4 THEN [] ELSE [['', 'no_valid_ocsr_result', 'rdkit_invalid', 'strategy_disagreement', '', 'calibrated_confidence_passed', 'calibrated_confidence_low', 'structure_requires_review', 'calibrated_confidence_missing'][k + 1]] END))), ',') END AS reasons FROM r""", "predictions"))
def p25(spark, d):
    c, none = F.col, F.array().cast("array<string>")
    seen = F.when(c("inference_time_ms") > 14000, F.array(F.lit("blurred"))).otherwise(none)
    odd = F.when(c("structure_features") == "", none).otherwise(F.split("structure_features", ";"))
    made = decisions.recognition_decision(c("recognition_success"), c("predicted_key").isNotNull(), c("sample_id") % 10 != 0, 20000 - c("inference_time_ms"), odd, c("confidence_milli"), c("sample_id") % 4 != 0, least_quality=4000, accept=800, review=300, quality_codes=seen, manual=c("sample_id") % 23 == 0)
    return records(spark, d, "predictions").select("sample_id", made.alias("d")).select("sample_id", "d.decision", "d.risk", F.array_join("d.reasons", ",").alias("reasons"))


@query("p32_structure_tags", """WITH m AS (SELECT p_partkey, p_size AS heavy_atoms, p_partkey % 700 AS weight, p_partkey % 5 AS rings, p_partkey % 4 AS aromatic, 1 + p_partkey % 2 AS fragments, p_partkey % 3 AS chiral, p_partkey % 6 - 1 AS charge, p_size % 16 AS plain, ['C', ['Cl', 'N', 'O', 'S', 'P', 'I', 'C'][CAST(p_partkey % 7 AS INTEGER) + 1]] AS el FROM part),
    t AS (SELECT p_partkey, list_sort(list_filter([CASE WHEN heavy_atoms <= 12 AND weight < 200 THEN 'small_molecule' END, CASE WHEN weight >= 500 THEN 'large_molecular_weight' END, CASE WHEN rings <= 1 AND weight < 350 AND fragments = 1 THEN 'simple_organic' END, CASE WHEN rings >= 3 THEN 'high_ring_count' END, CASE WHEN aromatic >= 2 THEN 'polycyclic_or_fused' END, CASE WHEN chiral > 0 THEN 'stereochemical' END,
      CASE WHEN charge <> 0 THEN 'formal_charge' END, CASE WHEN fragments > 1 THEN 'salt_or_multifragment' END, CASE WHEN el[2] IN ('Cl', 'I') THEN 'halogen' END, CASE WHEN plain >= 10 AND rings <= 1 THEN 'long_chain' END, CASE WHEN el[2] IN ('N', 'O', 'S', 'P') THEN 'contains_' || el[2] END], lambda x: x IS NOT NULL)) AS tags FROM m)
    SELECT p_partkey, CASE WHEN len(tags) = 0 THEN 'other' ELSE array_to_string(tags, ',') END AS tags FROM t""")
def p32_tags(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    at = {"heavy_atoms": size, "weight": k % 700, "rings": k % 5, "aromatic_rings": k % 4, "fragments": 1 + k % 2, "chiral_centers": k % 3, "formal_charge": k % 6 - 1, "plain_carbons": size % 16}
    elements = F.array(F.lit("C"), F.get(F.array(*map(F.lit, ("Cl", "N", "O", "S", "P", "I", "C"))), (k % 7).cast("int")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(measures.structure_tags({**at, "elements": elements}.__getitem__), ",").alias("tags"))


@query("p33_image_quality", """WITH m AS (SELECT CAST(l_quantity AS BIGINT) * 8 AS w, l_suppkey % 300 + 20 AS h, l_partkey % 130 AS contrast, l_orderkey % 1000 AS blur, (l_partkey % 700) / 1000.0::DOUBLE AS ink, (l_orderkey % 40) / 100.0::DOUBLE AS border FROM lineitem),
    s AS (SELECT *, greatest(0.0::DOUBLE, (w * h - 6400) / 83600.0::DOUBLE) AS area, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (contrast - 18) / 102.0::DOUBLE)) AS con, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (blur - 20) / 880.0::DOUBLE)) AS blu,
      CASE WHEN ink < 0.006 THEN greatest(0.0::DOUBLE, (ink - 0.001) / 0.005::DOUBLE) WHEN ink <= 0.32 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (ink - 0.32) / 0.33::DOUBLE) END AS ik, 1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (border - 0.05) / 0.25::DOUBLE)) AS crop FROM m),
    q AS (SELECT concat_ws(',', CASE WHEN least(w, h) < 96 THEN 'low_resolution' END, CASE WHEN contrast < 25 THEN 'low_contrast' END, CASE WHEN blur < 35 THEN 'blurred' END, CASE WHEN ink < 0.006 THEN 'too_little_foreground' END, CASE WHEN ink > 0.45 THEN 'too_dense_foreground' END, CASE WHEN border > 0.18 THEN 'possibly_cropped' END) AS codes,
      round_even(0.26 * least(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (least(w, h) - 64) / 116.0::DOUBLE)), least(1.0::DOUBLE, area)) + 0.22 * con + 0.22 * blu + 0.20 * ik + 0.10 * crop, 4) >= 0.55 AND NOT ink < 0.006 AS passed FROM s)
    SELECT codes, passed, count(*) AS n FROM q GROUP BY 1, 2""")
def p33_quality(spark, d):
    c = F.col
    at = {"width": c("l_quantity").cast("long") * 8, "height": c("l_suppkey") % 300 + 20, "contrast": c("l_partkey") % 130, "blur": c("l_orderkey") % 1000, "ink": (c("l_partkey") % 700) / 1000.0, "border": (c("l_orderkey") % 40) / 100.0}
    made = measures.image_quality(at.__getitem__)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(made.alias("q"))
    return rows.select(F.array_join("q.reason_codes", ",").alias("codes"), "q.passed").groupBy("codes", "passed").agg(F.count("*").alias("n"))


@query("p47_retry_codes", twin("SELECT sample_id, concat_ws(',', CASE WHEN predicted_key IS NOT NULL AND sample_id % 9 = 0 THEN 'invalid' END, CASE WHEN confidence_milli < 300 THEN 'low_confidence' END, CASE WHEN predicted_key IS NULL THEN 'missing_result' END, CASE WHEN NOT recognition_success THEN 'recognition_failed' END, CASE WHEN recognition_decision = 'review_needed' THEN 'result_review_needed' END) AS reasons FROM predictions", "predictions"))
def p47(spark, d):
    c = F.col
    found = decisions.retry_codes(c("recognition_success"), c("predicted_key"), c("sample_id") % 9 != 0, c("confidence_milli"), c("recognition_decision"), 300)
    return records(spark, d, "predictions").select("sample_id", F.array_join(found, ",").alias("reasons"))


@query("p47_attempts_made", twin("""a AS (SELECT *, coalesce(canonical_key, '') <> '' AS there, atom_count * 20 AS conf, priority = 1 AS orig, atom_count % 7 = 0 AS blurred, atom_count % 5 = 0 AND priority = 1 AS faint, atom_count % 6 = 1 AS small, atom_count % 4 <> 0 AS passed FROM candidates),
    u AS (SELECT *, status = 'success' AND there AND valid AND conf >= 300 AS good FROM a),
    r AS (SELECT *, concat_ws(',', CASE WHEN blurred THEN 'image_quality_blurred' END, CASE WHEN NOT good AND NOT passed AND NOT blurred AND NOT faint AND NOT small THEN 'image_quality_failed' END, CASE WHEN faint THEN 'image_quality_low_contrast' END,
      CASE WHEN small AND (NOT good OR blurred OR faint) THEN 'image_quality_low_resolution' END, CASE WHEN there AND NOT valid THEN 'invalid' END, CASE WHEN conf < 300 THEN 'low_confidence' END, CASE WHEN NOT there THEN 'missing_result' END,
      CASE WHEN status <> 'success' THEN 'recognition_failed' END, CASE WHEN formal_charge = 1 THEN 'result_review_needed' END) AS reasons FROM u),
    s AS (SELECT *, status = 'success' AND valid AND reasons = '' AS stops FROM r)
    SELECT sample_id, backend, reasons, stops, NOT coalesce(bool_or(stops) OVER (PARTITION BY sample_id ORDER BY priority RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS made FROM s""", "candidates"))
def p47_attempts(spark, d):
    c = F.col
    n = c("atom_count")
    quality = codes(("blurred", n % 7 == 0), ("low_contrast", n % 5 == 0), ("low_resolution", n % 6 == 1))
    success = c("status") == "success"
    why = decisions.retry_codes(success, c("canonical_key"), c("valid"), n * 20, F.when(c("formal_charge") == 1, "review_needed"), 300, quality, n % 4 != 0, c("priority") == 1)
    made = consensus.attempts_made(records(spark, d, "candidates"), "sample_id", "priority", success, c("valid"), why)
    return made.select("sample_id", "backend", F.array_join("reasons", ",").alias("reasons"), "stops", "made")


@query("p26_consensus_decisions", twin("""v AS (SELECT sample_id, canonical_key, count(*) AS n FROM candidates WHERE status = 'success' AND canonical_key IS NOT NULL AND valid GROUP BY 1, 2), g AS (SELECT sample_id, sum(n) AS n_valid, max(n) AS most FROM v GROUP BY 1),
    a AS (SELECT sample_id, count(*) FILTER (status = 'success' AND canonical_key IS NOT NULL) AS tried FROM candidates GROUP BY 1)
    SELECT sample_id, CASE WHEN n_valid IS NULL THEN 'rejected' WHEN most > 1 OR n_valid = 1 THEN 'accepted_with_warning' ELSE 'review_needed' END AS decision FROM a LEFT JOIN g USING (sample_id)""", "candidates"))
def p26(spark, d):
    rows = consensus.consensus(records(spark, d, "candidates"))
    return rows.select("sample_id", decisions.consensus_decision(F.col("status")).alias("decision"))


SETTINGS = {"blank_ink": 20, "text_lines": 5, "least_width": 70, "least_height": 70, "arrow_aspect": 1800, "arrow_parts": 3, "merged_clusters": 3, "merged_parts": 20, "least_score": 500, "ink_low": 50, "ink_high": 600, "parts_least": 4, "aspect_low": 500, "aspect_high": 1500}


@query("p34_p35_crop_screening", twin("""m AS (SELECT sample_id, atom_count * 17 % 900 AS ink, atom_count AS parts, priority AS lines, 400 + atom_count * 53 % 1700 AS aspect, valid AS sk, 1 + priority % 4 AS cl, 50 + atom_count * 7 % 200 AS w, 60 + atom_count * 11 % 200 AS h, CASE WHEN priority = 7 THEN 'Fig. 2' ELSE '' END AS t FROM candidates),
    s AS (SELECT *, 240 + CASE WHEN ink BETWEEN 50 AND 600 THEN 180 ELSE 0 END + CASE WHEN parts >= 4 THEN 120 ELSE 0 END + CASE WHEN sk THEN 180 ELSE 0 END + CASE WHEN aspect BETWEEN 500 AND 1500 THEN 100 ELSE 0 END + CASE WHEN cl = 1 THEN 60 ELSE 0 END AS score FROM m),
    l AS (SELECT *, CASE WHEN ink < 20 THEN 'blank' WHEN t <> '' AND NOT sk THEN 'text' WHEN lines >= 5 AND NOT sk THEN 'text' WHEN w < 70 OR h < 70 THEN 'text' WHEN aspect >= 1800 AND parts <= 3 THEN 'reaction' WHEN cl >= 3 AND parts >= 20 THEN 'multiple_molecules' WHEN sk AND score >= 500 THEN 'molecule' ELSE 'uncertain' END AS label,
      CASE WHEN ink < 20 THEN 'blank' WHEN t <> '' AND NOT sk THEN 'short_text_hard_reject,pdf_text_token' WHEN lines >= 5 AND NOT sk THEN 'text_like' WHEN w < 70 OR h < 70 THEN 'too_small,text_like' WHEN aspect >= 1800 AND parts <= 3 THEN 'reaction_arrow'
        WHEN cl >= 3 AND parts >= 20 THEN 'multiple_or_merged_region' WHEN sk AND score >= 500 THEN 'possible_molecule' WHEN NOT sk THEN 'missing_skeleton_evidence' ELSE 'uncertain' END AS reasons FROM s)
    SELECT label, reasons, CASE WHEN label = 'molecule' THEN 'accept_molecule' WHEN label IN ('blank', 'text', 'reaction') THEN 'reject_negative' ELSE 'review_needed' END AS decision, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM l GROUP BY 1, 2""", "candidates"))
def p34(spark, d):
    a, p = F.col("atom_count"), F.col("priority")
    rows = records(spark, d, "candidates").select(
        (a * 17 % 900).alias("ink_milli"), a.alias("components"), p.alias("text_lines"), (400 + a * 53 % 1700).alias("aspect_milli"), F.col("valid").alias("skeleton"), (1 + p % 4).alias("clusters"), (50 + a * 7 % 200).alias("width"), (60 + a * 11 % 200).alias("height"), F.when(p == 7, "Fig. 2").otherwise("").alias("text")
    )
    return rows.select(decisions.screening(F.col, SETTINGS).alias("s")).groupBy("s.label", "s.decision", F.array_join("s.reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.sum("s.score_milli").alias("score"))


@query("p36_short_tokens", """WITH k AS (SELECT p_partkey, p_partkey % 12 AS kind, CASE p_partkey % 12 WHEN 0 THEN 'Fig. ' || CAST(p_size AS VARCHAR) WHEN 1 THEN '(' || substr(p_name, 1, 1) || ').' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.' || CAST(p_size % 7 AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) || ' mg' WHEN 4 THEN 'K g' WHEN 5 THEN p_brand WHEN 6 THEN p_name
      WHEN 7 THEN CAST(p_size AS VARCHAR) || ')' WHEN 8 THEN CAST(p_size AS VARCHAR) || 'b' WHEN 9 THEN 'Scheme' || CAST(p_size AS VARCHAR) || 'c' WHEN 10 THEN '1234567890123456789' ELSE '' END AS token FROM part)
    SELECT p_partkey, token, kind IN (0, 1, 2, 4, 7, 8, 9) AS is_short FROM k""")
def p36(spark, d):
    part, size = spark.read.parquet(f"{d}/part.parquet"), F.col("p_size").cast("string")
    forms = (F.concat(F.lit("Fig. "), size), F.concat(F.lit("("), F.substring("p_name", 1, 1), F.lit(").")), F.concat(size, F.lit("."), (F.col("p_size") % 7).cast("string")), F.concat(size, F.lit(" mg")), F.lit("K g"), F.col("p_brand"), F.col("p_name"), F.concat(size, F.lit(")")), F.concat(size, F.lit("b")), F.concat(F.lit("Scheme"), size, F.lit("c")), F.lit("1234567890123456789"), F.lit(""))
    token = F.get(F.array(*forms), (F.col("p_partkey") % 12).cast("int"))
    return part.select("p_partkey", token.alias("token"), decisions.short_text(token).alias("is_short"))


@query("p37_output_plausibility", twin("SELECT sample_id, backend, CASE WHEN valid AND priority * 5 >= 20 AND atom_count <= 2 THEN 'output_too_simple_for_input' WHEN NOT valid AND priority * 5 <= 5 AND atom_count >= 8 THEN 'output_too_complex_for_input' ELSE '' END AS code FROM candidates", "candidates"))
def p37(spark, d):
    return records(spark, d, "candidates").select("sample_id", "backend", decisions.plausible_output(F.col("priority") * 5, F.col("valid"), F.col("atom_count")).alias("code"))


@query("p22_classes_from_ids", twin("i AS (SELECT 'd_' || truth_class || '_' || CAST(sample_id AS VARCHAR) AS id, truth_class FROM classes) SELECT regexp_extract(id, '_(molecule|text|table|reaction)_[0-9a-f]+$', 1) AS found, truth_class, count(*) AS n FROM i GROUP BY 1, 2", "classes"))
def p22(spark, d):
    name = F.concat(F.lit("d_"), F.col("truth_class"), F.lit("_"), F.col("sample_id").cast("string"))
    return records(spark, d, "classes").groupBy(states.class_from_id(name, ("molecule", "text", "table", "reaction")).alias("found"), "truth_class").agg(F.count("*").alias("n"))


@query("p23_perturbation_parameters", """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 66 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 33 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY 1, 2""")
def p23(spark, d):
    k = states.json_number(F.col("props"), "k")
    return spark.read.parquet(f"{d}/events.parquet").groupBy(k.alias("k"), states.severity(k, 33, 66).alias("severity")).agg(F.count("*").alias("n"))


@query("p18_identity_comparison", twin("SELECT sample_id, backend, coalesce(canonical_key = truth_key, false) AS full_match, coalesce(substr(canonical_key, 1, 1) = substr(truth_key, 1, 1), false) AS first_block_match, formal_charge <> 0 AS charged FROM candidates", "candidates"))
def p18(spark, d):
    c = F.col
    return records(spark, d, "candidates").select("sample_id", "backend", F.coalesce(c("canonical_key") == c("truth_key"), F.lit(False)).alias("full_match"), F.coalesce(F.substring("canonical_key", 1, 1) == F.substring("truth_key", 1, 1), F.lit(False)).alias("first_block_match"), (c("formal_charge") != 0).alias("charged"))


@query("p45_expected_actions", twin("SELECT category, CASE category WHEN 'molecule' THEN 'recognize' WHEN 'reaction' THEN 'recognize' ELSE 'reject' END AS expected_action, n FROM (SELECT truth_class AS category, count(*) AS n FROM classes GROUP BY 1) x", "classes"))
def p45(spark, d):
    rows = records(spark, d, "classes").groupBy(F.col("truth_class").alias("category")).agg(F.count("*").alias("n"))
    return rows.select("category", states.expected_action(F.col("category"), ("molecule", "reaction")).alias("expected_action"), "n")


@query("p46_review_changes", twin("b AS (SELECT box_id, page_id, x1 % 3 = 0 AS moved, decision <> 'accept_molecule' AS retyped FROM boxes) SELECT concat_ws(',', CASE WHEN moved THEN 'bbox' END, CASE WHEN retyped THEN 'region_type' END) AS changed, count(*) AS n FROM b GROUP BY 1", "boxes"))
def p46(spark, d):
    changed = states.changed_fields(bbox=F.col("x1") % 3 == 0, region_type=F.col("decision") != "accept_molecule")
    return records(spark, d, "boxes").groupBy(F.array_join(changed, ",").alias("changed")).agg(F.count("*").alias("n"))


@query("a32_box_modification_rate", twin("SELECT decision, count(*) AS n, round_even(count(*) FILTER (x1 % 3 = 0) / count(*), 6) AS modified_rate FROM boxes GROUP BY 1", "boxes"))
def a32(spark, d):
    return metrics.modification_rate(records(spark, d, "boxes"), F.col("x1") % 3 == 0, "decision")


@query("p51_rescreening", twin("SELECT decision, count(*) AS n_eligible, count(*) FILTER (x2 - x1 < 80) AS n_changed FROM boxes WHERE side = 'proposal' AND decision <> 'accept_molecule' GROUP BY 1", "boxes"))
def p51(spark, d):
    rows = records(spark, d, "boxes").where("side = 'proposal' and decision <> 'accept_molecule'")
    return rows.groupBy("decision").agg(F.count("*").alias("n_eligible"), count_if(F.col("x2") - F.col("x1") < 80).alias("n_changed"))


@query("p49_retry_selection", twin("SELECT sample_id, CASE WHEN NOT recognition_success THEN 'failed' WHEN recognition_decision = 'review_needed' THEN 'needs_review' ELSE 'selected' END AS mode FROM predictions WHERE NOT recognition_success OR recognition_decision = 'review_needed' OR sample_id % 100 = 0", "predictions"))
def p49(spark, d):
    c = F.col
    mode = states.retry_mode(~c("recognition_success"), c("recognition_decision") == "review_needed", c("sample_id") % 100 == 0)
    return records(spark, d, "predictions").select("sample_id", mode.alias("mode")).where("mode is not null")


@query("p44_artifact_states", twin("f AS (SELECT analysis_id FROM history WHERE size_bytes % 4 <> 0) SELECT h.analysis_id, CASE WHEN f.analysis_id IS NOT NULL THEN 'available' WHEN h.created_at < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'missing' END AS state FROM history h LEFT JOIN f USING (analysis_id)", "history"))
def p44(spark, d):
    rows = records(spark, d, "history")
    files = rows.where("size_bytes % 4 <> 0").select("analysis_id", F.lit(True).alias("there"))
    state = states.artifact_state(F.col("there"), F.col("created_at"), F.lit("1996-01-01").cast("timestamp_ntz"))
    return rows.join(files, "analysis_id", "left").select("analysis_id", state.alias("state"))


@query("p57_deletion_verdicts", twin("SELECT analysis_id, CASE WHEN size_bytes % 4 = 0 THEN 'missing' WHEN filename NOT LIKE 'file\\_1%' ESCAPE '\\' THEN 'outside_root' WHEN protected THEN 'not_owned' ELSE 'delete' END AS verdict FROM history", "history"))
def p57(spark, d):
    verdict = states.deletion_verdict(F.col("size_bytes") % 4 != 0, F.startswith("filename", F.lit("file_1")), ~F.col("protected"))
    return records(spark, d, "history").select("analysis_id", verdict.alias("verdict"))


@query("p05_p53_defaults", twin("SELECT sample_id, coalesce(nullif(perturbation, ''), 'none') AS perturbation, coalesce(nullif(structure_features, ''), nullif(message, ''), category) AS label FROM predictions", "predictions"))
def p05(spark, d):
    return records(spark, d, "predictions").select("sample_id", filled(F.col("perturbation"), F.lit("none")).alias("perturbation"), filled(F.col("structure_features"), F.col("message"), F.col("category")).alias("label"))


@query("p56_reused_computations", twin("SELECT molecular_weight, count(*) AS n, count(*) - 1 AS n_reused FROM properties GROUP BY 1", "properties"))
def p56(spark, d):
    rows = dedup.first_seen(records(spark, d, "properties").select("compound_id", "molecular_weight"), "molecular_weight", "compound_id")
    return rows.groupBy("molecular_weight").agg(F.count("*").alias("n"), count_if(F.col("repeats")).alias("n_reused"))


@query("j30_picked_candidates", twin("""h AS (SELECT sample_id, arg_min(coalesce(canonical_key, ''), (priority, coalesce(canonical_key, ''))) AS k FROM candidates WHERE backend = 'm2' GROUP BY 1), x AS (SELECT p.sample_id, k, coalesce(CASE WHEN sample_id % 5 = 0 THEN truth_key END, predicted_key, 'raw') AS current FROM predictions p LEFT JOIN h USING (sample_id))
    SELECT 'a' || CAST(sample_id AS VARCHAR) AS analysis_id, coalesce(nullif(k, ''), current) AS result, coalesce(k <> '', false) AS applied, CASE WHEN k IS NULL THEN 'candidate_missing' WHEN k = '' THEN 'candidate_invalid' ELSE '' END AS error FROM x""", "predictions", "candidates"))
def j30(spark, d):
    return reports.picked(nested_reports(spark, d), "m2")


@query("p03_report_rows", twin("SELECT sample_id - sample_id % 4 AS payload_id, sample_id, predicted_key FROM predictions WHERE (sample_id - sample_id % 4) % 8 = 0 AND sample_id % 4 < 2 OR (sample_id - sample_id % 4) % 8 <> 0 AND sample_id % 4 >= 2 AND sample_id % 3 <> 0", "predictions"))
def p03_rows(spark, d):
    n, group = F.col("sample_id"), F.col("sample_id") - F.col("sample_id") % 4
    report = F.struct("sample_id", "predicted_key")
    own = F.when((n % 4 < 2) & (group % 8 == 0), report)
    region = F.when(n % 4 >= 2, F.struct(F.when(n % 3 != 0, report).alias("report")))
    payloads = records(spark, d, "predictions").groupBy(group.alias("payload_id")).agg(F.collect_list(own).alias("reports"), F.collect_list(region).alias("regions"))
    return reports.report_rows(payloads)


@query("j04_replayed_outputs", twin("r AS (SELECT sample_id, 'images\\' || CAST(sample_id AS VARCHAR) AS path FROM samples), o AS (SELECT 'images/' || CAST(sample_id AS VARCHAR) AS path, predicted_key FROM predictions) SELECT r.sample_id, o.predicted_key, o.path IS NULL AS missing FROM r LEFT JOIN o ON replace(r.path, '\\', '/') = o.path", "samples", "predictions"))
def j04(spark, d):
    name = F.col("sample_id").cast("string")
    asked = records(spark, d, "samples").select("sample_id", F.replace(F.concat(F.lit("images\\"), name), F.lit("\\"), F.lit("/")).alias("path"))
    stored = records(spark, d, "predictions").select(F.concat(F.lit("images/"), name).alias("path"), "predicted_key", F.lit(True).alias("there"))
    return asked.join(stored, "path", "left").select("sample_id", "predicted_key", F.col("there").isNull().alias("missing"))


@query("j28_missing_and_changed_files", twin("l AS (SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN md5('x') ELSE content_key END AS found FROM samples WHERE sample_id % 7 <> 0) SELECT s.sample_id, CASE WHEN l.sample_id IS NULL THEN 'missing_file' WHEN found <> content_key THEN 'checksum_mismatch' ELSE '' END AS error FROM samples s LEFT JOIN l USING (sample_id)", "samples"))
def j28(spark, d):
    rows = records(spark, d, "samples").select("sample_id", "content_key")
    listing = rows.where("sample_id % 7 <> 0").select("sample_id", F.when(F.col("sample_id") % 10 == 0, F.md5(F.lit("x"))).otherwise(F.col("content_key")).alias("found"))
    return rows.join(listing, "sample_id", "left").select("sample_id", ladder("", (F.col("found").isNull(), "missing_file"), (F.col("found") != F.col("content_key"), "checksum_mismatch")).alias("error"))


@query("j10_audited_rows", twin("a AS (SELECT sample_id, count(*) FILTER (decision = 'approve') AS n_approve, count(*) AS n FROM votes GROUP BY 1) SELECT s.sample_id, s.category, a.n_approve, a.n FROM samples s JOIN a USING (sample_id)", "samples", "votes"))
def j10(spark, d):
    audits = records(spark, d, "votes").groupBy("sample_id").agg(count_if(F.col("decision") == "approve").alias("n_approve"), F.count("*").alias("n"))
    return records(spark, d, "samples").select("sample_id", "category").join(audits, "sample_id")


@query("a30_reasons_once_per_sample", twin("r AS (SELECT DISTINCT sample_id, CASE WHEN status <> 'success' THEN 'failed' WHEN NOT valid THEN 'invalid' ELSE 'unspecified' END AS reason FROM candidates WHERE status <> 'success' OR NOT valid) SELECT reason, count(*) AS n FROM r GROUP BY 1", "candidates"))
def a30(spark, d):
    rows = records(spark, d, "candidates")
    return metrics.reasons_once(rows, "sample_id", F.when(F.col("status") != "success", "failed").when(~F.col("valid"), "invalid"))


@query("a46_versioned_counts", twin("SELECT status, CAST(sum(greatest(CASE WHEN size_bytes % 2 = 0 THEN size_bytes % 100 - 10 ELSE size_bytes % 50 END, 0)) AS BIGINT) AS done FROM history GROUP BY 1", "history"))
def a46(spark, d):
    s = F.col("size_bytes")
    done = F.greatest(F.when(s % 2 == 0, s % 100 - 10).otherwise(s % 50), F.lit(0))
    return records(spark, d, "history").groupBy("status").agg(F.sum(done).alias("done"))


@query("w19_newest_first", twin("SELECT analysis_id, created_at FROM history WHERE status = 'failed' ORDER BY created_at DESC, analysis_id LIMIT 40", "history"))
def w19(spark, d):
    return review.search(records(spark, d, "history"), status="failed").orderBy(F.desc("created_at"), "analysis_id").limit(40).select("analysis_id", "created_at")


@query("u04_distinct_in_order", twin("SELECT scaffold_key, min(sample_id) AS first FROM samples GROUP BY 1", "samples"))
def u04(spark, d):
    return dedup.distinct_in_order(records(spark, d, "samples"), "scaffold_key", "sample_id")


@query("w04_verified_manifest", twin("""l AS (SELECT sample_id, reviewer, max(seq) AS seq, arg_max(decision, seq) AS decision, arg_max(canonical_key, seq) AS k FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) AS turn FROM l),
    v AS (SELECT sample_id FROM r WHERE turn <= 2 GROUP BY 1 HAVING count(*) = 2 AND min(decision) = 'approve' AND max(decision) = 'approve' AND min(k) = max(k)), m AS (SELECT s.* FROM samples s JOIN v USING (sample_id) WHERE source_license IN ('CC BY 4.0', 'https://creativecommons.org/licenses/by-sa/3.0/', 'CC0', 'Public Domain (PubChem)')),
    k AS (SELECT sample_id AS id, 'a' || inchikey AS v FROM m UNION ALL SELECT sample_id, 'b' || content_key FROM m), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (v)), reach AS (SELECT sample_id AS id, sample_id AS seen FROM m UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a)
    SELECT m.sample_id, m.inchikey, min(seen) AS component, CAST(1 AS BIGINT) AS n_splits FROM m JOIN reach ON reach.id = m.sample_id GROUP BY 1, 2""", "samples", "votes").replace("WITH ", "WITH RECURSIVE ", 1))
def w04(spark, d):
    votes = review.vote_status(records(spark, d, "votes")).where("status = 'verified'").select("sample_id")
    rows = materialise(records(spark, d, "samples").drop("split").join(votes, "sample_id", "left_semi").where(license_allowed(F.col("source_license"))), "verified")
    made = materialise(splits.grouped_split(splits.linked_groups(rows, "sample_id", "inchikey", "content_key"), "sample_id"), "splits")
    in_splits = made.groupBy("component").agg(F.count_distinct("split").alias("n_splits"))
    return rows.select("sample_id", "inchikey").join(made.join(in_splits, "component").select("sample_id", "component", "n_splits"), "sample_id")


@query("g08_reviewed_batches", twin("""a AS (SELECT sample_id, arg_max(decision, seq) AS last FROM votes GROUP BY 1), r AS (SELECT p.sample_id, CASE WHEN last = 'approve' THEN 'confirmed' WHEN last = 'reject' THEN 'revoked' ELSE 'unreviewed' END AS review, recognition_decision FROM predictions p LEFT JOIN a USING (sample_id)) SELECT review, recognition_decision, count(*) AS n FROM r GROUP BY 1, 2""", "predictions", "votes"))
def g08(spark, d):
    last = review.latest(records(spark, d, "votes"), "sample_id", "seq", "decision")
    rows = records(spark, d, "predictions").select("sample_id", "recognition_decision").join(last, "sample_id", "left")
    state = ladder("unreviewed", (F.col("decision") == "approve", "confirmed"), (F.col("decision") == "reject", "revoked"))
    return rows.groupBy(state.alias("review"), "recognition_decision").agg(F.count("*").alias("n"))


@query("v03_holdout_checks", twin("""SELECT (SELECT count(*) FROM (SELECT inchikey FROM samples WHERE split = 'train' INTERSECT SELECT inchikey FROM samples WHERE split = 'test') x) = 0 AS no_shared_identity, (SELECT count(DISTINCT inchikey) FROM samples WHERE split = 'test') >= 300 AS enough_identities, (SELECT count(DISTINCT category) FROM samples WHERE split = 'test') >= 4 AS all_categories""", "samples"))
def v03(spark, d):
    rows = records(spark, d, "samples")
    by = rows.where(F.col("split").isin("train", "test")).groupBy("inchikey").agg(F.count_distinct("split").alias("k"))
    shared = by.agg((count_if(F.col("k") > 1) == 0).alias("no_shared_identity"))
    test = rows.where("split = 'test'").agg((F.count_distinct("inchikey") >= 300).alias("enough_identities"), (F.count_distinct("category") >= 4).alias("all_categories"))
    return shared.crossJoin(test)  # one row each


_HELD = """h AS (SELECT CASE WHEN split = 'test' THEN 'external_holdout' ELSE split END AS split, sample_id, inchikey, content_key, CASE WHEN perturbation = 'blur' THEN 'synthetic_perturbation' ELSE 'official_clean' END AS image_variant,
      CASE WHEN perturbation = 'blur' THEN CASE sample_id % 4 WHEN 0 THEN 'blur' WHEN 1 THEN 'noise' WHEN 2 THEN 'rotation' END END AS perturbation, CASE WHEN size_bytes % 11 = 0 THEN inchikey ELSE content_key END AS image_sha256 FROM samples WHERE split <> 'train')"""


@query("v03_holdout_findings", twin(f"""{_HELD}, t AS (SELECT unnest(['blur', 'noise', 'rotation', 'skew']) AS t),
    f AS (SELECT 'inchikey_leakage' AS code, (SELECT count(DISTINCT inchikey) FROM h WHERE inchikey IN (SELECT inchikey FROM samples WHERE split = 'train' AND inchikey IS NOT NULL)) AS n
    UNION ALL SELECT 'content_key_leakage', (SELECT count(DISTINCT content_key) FROM h WHERE content_key IN (SELECT content_key FROM samples WHERE split = 'train' AND content_key IS NOT NULL))
    UNION ALL SELECT 'wrong_split', (SELECT count(*) FROM h WHERE split <> 'external_holdout') UNION ALL SELECT 'untyped_perturbation', (SELECT count(*) FROM h WHERE image_variant = 'synthetic_perturbation' AND perturbation IS NULL)
    UNION ALL SELECT 'type_missing', (SELECT count(*) FROM t WHERE t NOT IN (SELECT perturbation FROM h WHERE perturbation IS NOT NULL)) UNION ALL SELECT 'too_few_identities', (SELECT greatest(0, 300 - count(DISTINCT sample_id)) FROM h)
    UNION ALL SELECT 'not_byte_exact', (SELECT count(*) FROM h WHERE image_variant = 'official_clean' AND image_sha256 IS DISTINCT FROM CASE WHEN sample_id % 20 <> 0 THEN content_key END)) SELECT * FROM f WHERE n > 0""", "samples"))
def v03_findings(spark, d):
    rows, c = records(spark, d, "samples"), F.col
    blurred = c("perturbation") == "blur"
    kind = F.when(c("sample_id") % 4 == 0, "blur").when(c("sample_id") % 4 == 1, "noise").when(c("sample_id") % 4 == 2, "rotation")
    held = rows.where("split <> 'train'").select("sample_id", "inchikey", "content_key", F.when(c("split") == "test", "external_holdout").otherwise(c("split")).alias("split"), F.when(blurred, "synthetic_perturbation").otherwise("official_clean").alias("image_variant"), F.when(blurred, kind).alias("perturbation"), F.when(c("size_bytes") % 11 == 0, c("inchikey")).otherwise(c("content_key")).alias("image_sha256"))
    sources = rows.where("sample_id % 20 <> 0").select("sample_id", c("content_key").alias("response_sha256"))
    return validation.holdout_findings(held, rows.where("split = 'train'"), sources, ("inchikey", "content_key"), "sample_id", ("blur", "noise", "rotation", "skew"))


@query("v05_annotation_errors", twin("SELECT page_id, box_id, CASE WHEN x2 > 450 OR y2 > 450 THEN 'outside_page' WHEN decision = 'reject_negative' THEN 'unknown_class' ELSE 'incomplete' END AS error FROM boxes WHERE x2 > 450 OR y2 > 450 OR decision = 'reject_negative' OR x1 = y1", "boxes"))
def v05(spark, d):
    c = F.col
    error = states.annotation_error((c("x2") <= 450) & (c("y2") <= 450), c("decision") != "reject_negative", c("x1") != c("y1"))
    return records(spark, d, "boxes").select("page_id", "box_id", error.alias("error")).where("error is not null")


@query("v07_protocol_guards", twin("SELECT count(*) FILTER (split = 'test' AND expected_action = 'recognize' AND review_status <> 'verified') AS n_unverified_test, count(*) FILTER (split = 'test') = 0 AS free_of_test FROM samples", "samples"))
def v07(spark, d):
    test = F.col("split") == "test"
    return records(spark, d, "samples").agg(count_if(test & (F.col("expected_action") == "recognize") & (F.col("review_status") != "verified")).alias("n_unverified_test"), (count_if(test) == 0).alias("free_of_test"))


@query("k05_routed_outputs", twin("""r AS (SELECT unnest(list_filter([CASE WHEN NOT recognition_success THEN 'failed' END, CASE WHEN manual_review_recommended THEN 'pending_review' END, CASE WHEN recognition_success AND recognition_decision = 'accepted' THEN 'confirmed' END], lambda x: x IS NOT NULL)) AS route FROM predictions) SELECT route, count(*) AS n FROM r GROUP BY 1""", "predictions"))
def k05(spark, d):
    c = F.col
    found = codes(("failed", ~c("recognition_success")), ("pending_review", c("manual_review_recommended")), ("confirmed", c("recognition_success") & (c("recognition_decision") == "accepted")))
    return records(spark, d, "predictions").select(F.explode(found).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("p03_p48_truth_projection", twin("SELECT sample_id, truth_key, bool_or(backend = 'm1' AND coalesce(canonical_key = truth_key, false)) AS m1_match, bool_or(backend = 'm2' AND coalesce(canonical_key = truth_key, false)) AS m2_match FROM candidates GROUP BY 1, 2", "candidates"))
def p03(spark, d):
    hit = lambda b: F.bool_or((F.col("backend") == b) & F.coalesce(F.col("canonical_key") == F.col("truth_key"), F.lit(False)))
    return records(spark, d, "candidates").groupBy("sample_id", "truth_key").agg(hit("m1").alias("m1_match"), hit("m2").alias("m2_match"))


@query("p54_property_rows", twin("SELECT compound_id, 'C' || CAST(compound_id AS VARCHAR) AS name, molecular_weight AS mw, hbd + hba AS polar_atoms, string_split(structure_features, ';')[1] AS brand FROM properties", "properties"))
def p54(spark, d):
    c = F.col
    return records(spark, d, "properties").select("compound_id", F.concat(F.lit("C"), c("compound_id").cast("string")).alias("name"), c("molecular_weight").alias("mw"), (c("hbd") + c("hba")).alias("polar_atoms"), F.split("structure_features", ";")[0].alias("brand"))


@query("p39_confirmed_rows", twin("SELECT category, count(*) FILTER (recognition_decision = 'accepted' AND NOT manual_review_recommended) AS n_confirmed, count(*) FILTER (manual_review_recommended OR recognition_decision = 'review_needed') AS n_required FROM predictions GROUP BY 1", "predictions"))
def p39(spark, d):
    return metrics.flags(records(spark, d, "predictions")).groupBy("category").agg(count_if(F.col("auto_accept")).alias("n_confirmed"), count_if(F.col("review")).alias("n_required"))


@query("p18_identity_flags", """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 9 <> 0 THEN 'B' || CAST(l_partkey % 2 AS VARCHAR) || '-' || CAST(l_suppkey % 2 AS VARCHAR) END AS pk, 'B' || CAST(l_orderkey % 2 AS VARCHAR) || '-' || CAST(l_linenumber % 2 AS VARCHAR) AS tk,
      l_partkey % 2 AS pc, l_orderkey % 2 AS tc, l_suppkey % 2 AS pi, l_linenumber % 2 AS ti, l_partkey % 3 AS pf, l_orderkey % 3 AS tf, l_partkey % 5 AS pq, l_orderkey % 5 AS tq FROM lineitem),
    f AS (SELECT *, coalesce(pk = tk, false) AS full_match, pc = tc AS canonical_match, pc = tc AND pi = ti AS isomeric_match, pf = tf AS formula_match, coalesce(split_part(pk, '-', 1) = split_part(tk, '-', 1), false) AS connectivity_match FROM m),
    g AS (SELECT *, connectivity_match AND NOT full_match AND (pq <> tq OR pf <> tf) AS only_charge_differs FROM f)
    SELECT id, full_match, canonical_match, isomeric_match, formula_match, connectivity_match, canonical_match AND isomeric_match AS stereo_match, only_charge_differs, connectivity_match AND NOT only_charge_differs AND canonical_match AND NOT isomeric_match AS only_stereo_differs FROM g""")
def p18_flags(spark, d):
    text, c = lambda x: x.cast("string"), F.col
    two = lambda a, b: F.concat(text(a), F.lit("/"), text(b))
    side = lambda a, b, gone: {"key": F.when(~gone, F.concat(F.lit("B"), text(c(a) % 2), F.lit("-"), text(c(b) % 2))), "canonical": c(a) % 2, "isomeric": two(c(a) % 2, c(b) % 2), "formula": c(a) % 3, "charge": c(a) % 5}
    flags = decisions.identity_flags(side("l_partkey", "l_suppkey", c("l_partkey") % 9 == 0), side("l_orderkey", "l_linenumber", F.lit(False)))
    return spark.read.parquet(f"{d}/lineitem.parquet").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), flags.alias("f")).select("id", "f.*")


@query("p29_machine_status", twin("""m AS (SELECT sample_id, sample_id % 31 = 0 AS bad, sample_id % 5 = 0 AS denied, sample_id % 7 = 0 AS unclear, CASE WHEN sample_id % 11 = 0 THEN 'text' ELSE 'molecule' END AS kind, sample_id % 3 AS n_valid, sample_id % 13 <> 0 AS agree, predicted_key, CASE WHEN sample_id % 2 = 0 THEN truth_key ELSE '' END AS expected, sample_id % 17 = 0 AS edge, structure_features, manual_review_recommended AS seen FROM predictions),
    s AS (SELECT *, CASE WHEN bad THEN 'rejected_invalid' WHEN denied AND NOT unclear THEN 'rejected_license' WHEN unclear OR kind <> 'molecule' THEN 'pending_human_review' WHEN n_valid = 0 THEN 'pending_machine_review' WHEN NOT agree OR n_valid = 1 OR (expected <> '' AND predicted_key IS DISTINCT FROM expected) OR edge OR structure_features = 'stereo;charge' THEN 'pending_human_review' ELSE 'machine_verified' END AS machine FROM m)
    SELECT sample_id, machine, CASE WHEN starts_with(machine, 'rejected') THEN machine WHEN seen THEN 'human_verified' ELSE machine END AS final FROM s""", "predictions"))
def p29_status(spark, d):
    c, n = F.col, F.col("sample_id")
    errors = F.when(n % 31 == 0, F.array(F.lit("hash_mismatch"))).otherwise(F.array().cast("array<string>"))
    risks = F.when(c("structure_features") == "stereo;charge", F.array(F.lit("stereochemistry"), F.lit("charged_structure"))).otherwise(F.array(F.lit("small")))
    machine = decisions.machine_status(errors, n % 5 != 0, n % 7 == 0, F.when(n % 11 == 0, "text").otherwise("molecule"), n % 13 != 0, n % 3, c("predicted_key"), (F.when(n % 2 == 0, c("truth_key")).otherwise(""), F.lit(None).cast("string")), n % 17 == 0, risks)
    rows = records(spark, d, "predictions").select("sample_id", machine.alias("machine"), F.when(c("manual_review_recommended"), "verified").otherwise("").alias("human"))
    return rows.select("sample_id", "machine", decisions.final_status(F.col("machine"), F.col("human")).alias("final"))


@query("w06_selected_attempt", twin("""a AS (SELECT sample_id, priority AS attempt, canonical_key, status = 'success' AND valid AS good, (atom_count % 10) / 10.0::DOUBLE AS confidence, atom_count % 4 = 0 AS poor, atom_count % 10 < 3 AS low FROM candidates),
    b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY poor, low, confidence DESC, attempt, canonical_key DESC NULLS LAST) AS turn FROM a WHERE good), k AS (SELECT sample_id, CASE WHEN count(canonical_key) >= 2 THEN count(DISTINCT canonical_key) = 1 END AS agree FROM a WHERE good GROUP BY 1)
    SELECT sample_id, attempt, canonical_key, agree FROM b JOIN k USING (sample_id) WHERE turn = 1""", "candidates"))
def w06_selected(spark, d):
    c = F.col
    retry = codes(("image_quality_blurred", c("atom_count") % 4 == 0), ("low_confidence", c("atom_count") % 10 < 3))
    rows = records(spark, d, "candidates").select("sample_id", c("priority").alias("attempt"), "status", "valid", "canonical_key", ((c("atom_count") % 10) / 10.0).cast("double").alias("confidence"), retry.alias("retry_codes"))
    return consensus.selected_attempt(rows)
