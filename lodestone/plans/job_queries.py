"""Registered queries: nested reports, edit logs, review actions, streams and the forest baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import confusion, edits, forest, reports
from lodestone.plans.registry import query
from lodestone.sources.adapters import records, twin
from lodestone.streaming import jobs, tracking


def nested_reports(spark, d):
    """Nested reports as orders and their lines give them."""
    lines = records(spark, d, "candidates").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("priority", "backend", "canonical_key"))).alias("candidates"))
    c = F.col
    rows = records(spark, d, "predictions").join(lines, "sample_id", "left")
    x = c("sample_id") % 400
    box = F.struct(F.concat(F.lit("k"), (c("sample_id") % 3).cast("string")).alias("kind"), F.array(x, x + 1, x + 20, x + 30).alias("bbox"))
    return rows.select(
        F.concat(F.lit("a"), c("sample_id").cast("string")).alias("analysis_id"), F.when(c("recognition_success"), "success").otherwise("failed").alias("status"),
        F.struct(F.when(c("sample_id") % 9 != 0, F.concat(F.lit("f"), c("sample_id").cast("string"), F.lit(".png"))).otherwise("").alias("filename"), F.md5(c("sample_id").cast("string")).alias("image_sha256")).alias("input"),
        F.struct(F.when(c("sample_id") % 4 != 3, c("recognition_decision")).otherwise("").alias("decision"), c("manual_review_recommended"), F.array(c("category")).alias("reason_codes")).alias("recognition"),
        F.struct(F.lit("m1").alias("backend"), c("predicted_key").alias("predicted"), F.lit("raw").alias("text")).alias("ocsr"),
        F.struct(F.when(c("sample_id") % 5 == 0, c("truth_key")).otherwise("").alias("text"), F.lit("").alias("standardized")).alias("final"),
        F.struct(c("predicted_key").alias("standardized"), c("predicted_key").isNotNull().alias("valid")).alias("validation"), "candidates",
        F.when(c("sample_id") % 2 == 0, F.array(box, box)).otherwise(F.array(box)).alias("regions"),
    )


@query("p01_flattened_reports", twin("""n AS (SELECT sample_id, count(*) AS n FROM candidates GROUP BY 1) SELECT 'a' || CAST(sample_id AS VARCHAR) AS analysis_id, CASE WHEN sample_id % 9 <> 0 THEN 'f' || CAST(sample_id AS VARCHAR) || '.png' ELSE '' END AS filename, CASE WHEN recognition_success THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN sample_id % 4 <> 3 THEN recognition_decision ELSE '' END AS recognition_decision, manual_review_recommended, '["' || category || '"]' AS reason_codes, coalesce(predicted_key, 'raw') AS predicted, CASE WHEN sample_id % 5 = 0 THEN truth_key ELSE 'raw' END AS final, predicted_key AS standardized, predicted_key IS NOT NULL AS valid, CAST(coalesce(n, 0) AS INTEGER) AS candidate_count
    FROM predictions LEFT JOIN n USING (sample_id)""", "predictions", "candidates"))
def p01(spark, d):
    return reports.flatten(nested_reports(spark, d)).drop("image_sha256", "backend", "candidates")


@query("p02_report_regions", twin("r AS (SELECT sample_id, unnest(CASE WHEN sample_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS region_number FROM predictions) SELECT 'a' || CAST(sample_id AS VARCHAR) AS analysis_id, region_number, 'k' || CAST(sample_id % 3 AS VARCHAR) AS kind, sample_id % 400 AS x1, sample_id % 400 + 1 AS y1, sample_id % 400 + 20 AS x2, sample_id % 400 + 30 AS y2 FROM r", "predictions"))
def p02(spark, d):
    return reports.regions(nested_reports(spark, d))


@query("p04_history_records", twin("""SELECT 'a' || CAST(sample_id AS VARCHAR) AS analysis_id, CASE WHEN sample_id % 9 <> 0 THEN 'f' || CAST(sample_id AS VARCHAR) || '.png' ELSE 'unnamed' END AS filename, CASE WHEN recognition_success THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN sample_id % 4 <> 3 THEN recognition_decision WHEN NOT recognition_success THEN 'rejected' ELSE 'review_needed' END AS decision, coalesce(CASE WHEN sample_id % 5 = 0 THEN truth_key END, predicted_key, 'raw') AS result, false AS is_favorite FROM predictions""", "predictions"))
def p04(spark, d):
    return reports.history_record(nested_reports(spark, d))


def page_regions(spark, d):
    # Of boxes with one number the least.
    boxes = records(spark, d, "boxes").groupBy("page_id", "box_id").agg(F.min(F.struct("x1", "y1", "x2", "y2", "decision")).alias("b")).select("page_id", "box_id", "b.*")
    c = F.col
    return boxes.select(c("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), c("box_id").cast("string").alias("region_id"), *[c(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")], F.lit("molecule").alias("region_type"), F.lit("detected").alias("status"), (c("decision") == "accept_molecule").alias("confirmed"))


def edit_log(regions):
    """An edit of each region that its number asks for; every document has its own log."""
    c, n = F.col, F.col("region_id").cast("long")
    actions = F.element_at(F.array(*map(F.lit, ("confirm", "delete", "mark", "update", "unconfirm", "split", "noop"))), (n % 7 + 1).cast("int"))
    return regions.select("document_id", n.alias("seq"), actions.alias("action"), "region_id", F.concat("region_id", F.lit("b")).alias("other_id"), "page", c("x1"), (c("y1") - 10).alias("y1"), c("x2"), c("y2"), F.lit(None).cast("string").alias("region_type"))


#: Each region has one edit, by its number; all boxes fit once they are held to the page.
EDITED = """b AS (SELECT CAST(page_id AS VARCHAR) AS document_id, CAST(1 AS INTEGER) AS page, CAST(box_id AS VARCHAR) AS region_id, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, decision = 'accept_molecule' AS confirmed, box_id % 7 AS k FROM boxes QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY x1, y1, x2, y2, decision) = 1),
    edited AS (SELECT document_id, page, region_id, x1, CASE WHEN k = 3 THEN greatest(0, y1 - 10) ELSE y1 END AS y1, CASE WHEN k = 3 THEN least(500, x2) WHEN k = 5 THEN (x1 + x2) // 2 ELSE x2 END AS x2, CASE WHEN k = 3 THEN least(500, y2) ELSE y2 END AS y2,
      CASE WHEN k IN (1, 2) THEN 'non_molecule' ELSE 'molecule' END AS region_type, CASE k WHEN 0 THEN 'confirmed' WHEN 1 THEN 'deleted' WHEN 4 THEN 'edited' WHEN 5 THEN 'edited' WHEN 6 THEN 'detected' ELSE CASE WHEN confirmed THEN 'confirmed' ELSE 'edited' END END AS status,
      CASE WHEN k = 0 THEN true WHEN k IN (1, 4, 5) THEN false ELSE confirmed END AS confirmed, ['confirm', 'delete', 'mark', 'update', 'unconfirm', 'split', 'noop!'][k + 1] AS audit FROM b
      UNION ALL SELECT document_id, page, region_id || 'b', (x1 + x2) // 2, y1, x2, y2, 'molecule', 'edited', false, 'split_from' FROM b WHERE k = 5)"""


@query("g06_region_edits", twin(f"{EDITED} SELECT * FROM edited", "boxes"))
def g06(spark, d):
    regions = page_regions(spark, d)
    return edits.apply_edits(regions, edit_log(regions), 500, 500)


@query("a27_region_summary", twin(f"{EDITED} SELECT status, region_type, count(*) AS n, count(*) FILTER (confirmed) AS n_confirmed FROM edited GROUP BY 1, 2", "boxes"))
def a27(spark, d):
    return g06(spark, d).groupBy("status", "region_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"))


@query("k10_detection_annotations", twin(f"{EDITED} SELECT document_id, page, CAST(count(*) AS INTEGER) AS n_regions, string_agg(region_id, ',' ORDER BY region_id) AS region_ids FROM edited WHERE status <> 'deleted' AND confirmed GROUP BY 1, 2", "boxes"))
def k10(spark, d):
    return edits.annotations(g06(spark, d)).select("document_id", "page", F.size("regions").alias("n_regions"), F.array_join(F.transform("regions", lambda r: r["region_id"]), ",").alias("region_ids"))


@query("k11_export_skips", twin(f"{EDITED} SELECT CASE WHEN status = 'deleted' THEN 'deleted' WHEN NOT confirmed THEN 'unconfirmed' ELSE '' END AS reason, count(*) AS n FROM edited GROUP BY 1", "boxes"))
def k11(spark, d):
    return edits.skipped(g06(spark, d))


@query("g07_review_states", """WITH a AS (SELECT event_id - event_id % 6 AS item, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'return' WHEN 2 THEN 'reject' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'license_unclear' WHEN 5 THEN 'resubmit' ELSE 'odd' END AS action, CASE WHEN user_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS actor FROM events),
    g AS (SELECT item, arg_max(action, seq) AS action, arg_max(actor, seq) AS actor, count(*) FILTER (action = 'resubmit') AS revision, count(*) AS n_actions FROM a WHERE action <> 'odd' AND actor <> '' GROUP BY 1)
    SELECT item, CASE action WHEN 'approve' THEN 'verified' WHEN 'return' THEN 'needs_revision' WHEN 'reject' THEN 'rejected' WHEN 'duplicate' THEN 'duplicate' WHEN 'license_unclear' THEN 'license_unclear' ELSE 'pending_review' END AS status, action = 'approve' AS include_in_training, revision, n_actions, CASE WHEN action <> 'resubmit' THEN actor END AS reviewer FROM g""")
def g07(spark, d):
    e, c = spark.read.parquet(f"{d}/events.parquet"), F.col
    action = F.element_at(F.array(*map(F.lit, ("approve", "return", "reject", "duplicate", "license_unclear", "resubmit", "odd"))), (c("event_id") % 7 + 1).cast("int"))
    rows = e.select((c("event_id") - c("event_id") % 6).alias("item"), c("event_id").alias("seq"), action.alias("action"), F.when(c("user_id") % 10 == 0, "").otherwise(c("user_id").cast("string")).alias("actor"))
    return edits.review_states(rows)


def _events(spark, d):
    return jobs.events(spark, f"{d}/events.parquet")


@query("t01_windowed_counts", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t01(spark, d):
    return jobs.window_counts(_events(spark, d))


@query("t02_latest_states", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1")
def t02(spark, d):
    return jobs.latest_states(_events(spark, d))


@query("t03_job_machine", """WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS es FROM events GROUP BY 1), f AS (SELECT user_id, list_reduce(list_transform(es, lambda e: {'s': e, 'n': CAST(0 AS BIGINT)}), lambda a, e: CASE a.s || ' ' || e.s WHEN 'queued click' THEN {'s': 'running', 'n': a.n + 1} WHEN 'running view' THEN {'s': 'paused', 'n': a.n + 1} WHEN 'paused click' THEN {'s': 'running', 'n': a.n + 1}
      WHEN 'running purchase' THEN {'s': 'completed', 'n': a.n + 1} WHEN 'running error' THEN {'s': 'failed', 'n': a.n + 1} WHEN 'queued error' THEN {'s': 'cancelled', 'n': a.n + 1} WHEN 'paused error' THEN {'s': 'cancelled', 'n': a.n + 1} ELSE a END, {'s': 'queued', 'n': CAST(0 AS BIGINT)}) AS f FROM l)
    SELECT user_id, f.s AS status, f.n AS transitions FROM f""")
def t03(spark, d):
    return jobs.job_machine(_events(spark, d))


_STEP = " ".join(f"WHEN '{a} {e}' THEN '{b}'" for (a, e), b in tracking.STEPS.items())
_GONE = lambda s: f"CASE {s} WHEN 'cancelling' THEN 'cancelled' ELSE 'failed' END"
_LIVE = "('queued', 'running', 'paused', 'cancelling')"


@query("t03_tracked_jobs", f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS tm FROM events), l AS (SELECT user_id, list({{'s': event_type, 'tm': tm, 'n': 0::BIGINT, 'g': false}} ORDER BY tm, event_id) AS es, min(tm) AS first FROM e GROUP BY 1),
    f AS (SELECT user_id, list_reduce(es, lambda a, e: CASE WHEN a.s IN {_LIVE} AND e.tm - a.tm >= 86400000 THEN {{'s': {_GONE('a.s')}, 'tm': e.tm, 'n': a.n + 1, 'g': true}}
      ELSE {{'s': CASE a.s || ' ' || e.s {_STEP} ELSE a.s END, 'tm': e.tm, 'n': a.n + (CASE a.s || ' ' || e.s {_STEP} ELSE a.s END <> a.s)::INT, 'g': a.g}} END, {{'s': 'queued', 'tm': first, 'n': 0::BIGINT, 'g': false}}) AS f FROM l),
    w AS (SELECT max(tm) - 172800000 AS mark FROM e), r AS (SELECT user_id, f.s AS s, f.n AS n, f.g AS g, f.tm AS tm, f.s IN {_LIVE} AND f.tm + 86400000 <= mark AS gone FROM f, w)
    SELECT user_id, CASE WHEN gone THEN {_GONE('s')} ELSE s END AS status, n + gone::INT AS transitions, g OR gone AS reconciled, tm AS seen_ms FROM r""")
def t03_tracked(spark, d):
    return tracking.tracked_jobs(_events(spark, d), 86400, "2 days")


@query("t04_streamed_agreement", twin("""l AS (SELECT sample_id, reviewer, max(seq) AS seq, arg_max(decision, seq) AS decision, arg_max(canonical_key, seq) AS k FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) AS turn FROM l),
  g AS (SELECT sample_id, count(*) AS n, max(decision) FILTER (turn = 1) AS d1, max(decision) FILTER (turn = 2) AS d2, max(k) FILTER (turn = 1) AS k1, max(k) FILTER (turn = 2) AS k2 FROM r WHERE turn <= 2 GROUP BY 1)
  SELECT sample_id, CASE WHEN n < 2 THEN 'pending' WHEN d1 <> d2 OR (d1 = 'approve' AND k1 <> k2) THEN 'disagreement' WHEN d1 = 'approve' THEN 'verified' ELSE 'rejected' END AS status FROM g""", "votes"))
def t04(spark, d):
    e, c = _events(spark, d), F.col
    no = c("event_type").isin("error", "view")
    votes = e.select((c("event_id") - c("event_id") % 6).alias("sample_id"), c("user_id").alias("reviewer"), c("event_id").alias("seq"), F.when(no, "reject").otherwise("approve").alias("decision"), F.when(no, "").when(c("event_id") % 12 < 9, "K0").otherwise(F.concat(F.lit("K"), (c("event_id") % 2).cast("string"))).alias("canonical_key"))
    return jobs.agreement(votes)


@query("t05_first_of_content", "SELECT DISTINCT props FROM events")
def t05(spark, d):
    return jobs.first_of_content(_events(spark, d), "props", "3650 days").select("props")


@query("t06_streamed_upsert", twin("""e AS (SELECT 'a' || CAST(user_id AS VARCHAR) AS analysis_id, max(event_id) AS last FROM events GROUP BY 1) SELECT h.analysis_id, h.created_at, h.is_favorite, coalesce('job ' || CAST(last AS VARCHAR), h.decision) AS decision FROM history h LEFT JOIN e USING (analysis_id)
    UNION ALL SELECT e.analysis_id, CAST(date_trunc('day', min(ts)) AS TIMESTAMP), false, 'job ' || CAST(max(event_id) AS VARCHAR) FROM (SELECT *, 'a' || CAST(user_id AS VARCHAR) AS analysis_id FROM events) e WHERE analysis_id NOT IN (SELECT analysis_id FROM history) GROUP BY 1""", "history"))
def t06(spark, d):
    old = records(spark, d, "history").select("analysis_id", "created_at", "is_favorite", "decision")
    c = F.col
    new = _events(spark, d).select(c("event_id"), F.concat(F.lit("a"), c("user_id").cast("string")).alias("analysis_id"), F.date_trunc("day", "ts").cast(old.schema["created_at"].dataType).alias("created_at"), F.lit(False).alias("is_favorite"), F.concat(F.lit("job "), c("event_id").cast("string")).alias("decision"))
    return jobs.upserts(new, "analysis_id", "event_id", ("created_at", "is_favorite"), old)


@query("t07_throughput", """WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS window_start FROM events, (VALUES (0), (1)) v(k)) SELECT window_start, count(*) AS n, count(*) * 1000 // 3600 AS milli_per_second FROM w GROUP BY 1""")
def t07(spark, d):
    return jobs.throughput(_events(spark, d))


@query("t07_remaining_time", """WITH t AS (SELECT user_id, count(*) + 5 AS total FROM events GROUP BY 1), c AS (SELECT user_id, epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT + 21600 AS e, count(*) AS n FROM events GROUP BY 1, 2),
    k AS (SELECT * FROM c WHERE e * 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM events)), s AS (SELECT user_id, e, sum(n) OVER (PARTITION BY user_id ORDER BY e) AS done, sum(n) OVER (PARTITION BY user_id ORDER BY e RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW) AS lately FROM k)
    SELECT user_id, make_timestamp(e * 1000000) AS window_end, CAST(done AS BIGINT) AS done, total, CAST(greatest(0, total - done) * 172800 // lately AS BIGINT) AS remaining_seconds FROM s JOIN t USING (user_id)""")
def t07_remaining(spark, d):
    totals = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg((F.count("*") + 5).alias("total"))
    return tracking.progress(_events(spark, d), totals, "48 hours", "6 hours", "1 day")


@query("t08_late_events", """WITH s AS (SELECT greatest(1, ceil((max(event_id) + 1) / 10)) AS size FROM events), o AS (SELECT CAST(floor(event_id / size) AS BIGINT) AS batch, ts FROM events, s), t AS (SELECT batch, max(ts) AS top FROM o GROUP BY 1), m AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
    SELECT batch, count(*) AS n, count(*) FILTER (ts < seen - INTERVAL 600 SECONDS) AS n_late FROM o JOIN m USING (batch) GROUP BY 1""")
def t08(spark, d):
    return jobs.late(spark.read.parquet(f"{d}/events.parquet"), "event_id", 600, 10)


# A stream drops what is later than the watermark that the batch before went by.
@query("t08_kept_in_time", """WITH s AS (SELECT greatest(1, ceil((max(event_id) + 1) / 4)) AS size FROM events), o AS (SELECT CAST(floor(((event_id * 37) % (SELECT max(event_id) + 1 FROM events)) / size) AS BIGINT) AS batch, ts FROM events, s), t AS (SELECT batch, max(ts) AS top FROM o GROUP BY 1),
    m AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM t), w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, seen FROM o JOIN m USING (batch))
    SELECT window_start, count(*) AS n FROM w WHERE seen IS NULL OR window_start + INTERVAL '10 minutes' > date_trunc('milliseconds', seen) - INTERVAL '3 days' GROUP BY 1""")
def t08_kept(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    top = rows.agg((F.max("event_id") + 1).alias("top"))  # one row
    shuffled = rows.crossJoin(F.broadcast(top)).withColumn("arrival", F.col("event_id") * 37 % F.col("top")).select("arrival", "ts")
    return jobs.kept_in_time(shuffled, "arrival", 4, delay="3 days")


def _vectors(spark, d):
    return forest.cleaned(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "embedding")


@query("l03_l04_forest_scores")
def l03(spark, d):
    scores, _ = forest.baseline(_vectors(spark, d), F.col("vec_id") % 5 == 0, "label", "embedding", least_accuracy=0.5, trees=100, depth=6)
    return scores


@query("l03_forest_measures")
def l03_measures(spark, d):
    _, measures = forest.baseline(_vectors(spark, d), F.col("vec_id") % 5 == 0, "label", "embedding", least_accuracy=0.5, trees=50, depth=6)
    return spark.createDataFrame([(k, float(v)) for k, v in measures.items()], "measure string, value double")


@query("l02_forest_numbers")
def l02(spark, d):
    rows = _vectors(spark, d).withColumn("target", F.col("embedding")[0].cast("double") * 10)
    model = forest.fit_numbers(rows.where("vec_id % 5 <> 0"), "target", "embedding", trees=50, depth=5)
    scored = forest.score(model, rows.where("vec_id % 5 = 0"), "embedding").withColumn("guess", F.bround("prediction", 3))
    return confusion.regression(scored, "target", "guess")
