"""Registered queries: boxes, duplicates, splits, consensus, review, history, similarity and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.columns import codes, count_if, ladder
from lodestone.operators import boxes, consensus, dedup, metrics, review, similarity, splits
from lodestone.operators.order import numbered
from lodestone.operators.tables import key_difference
from lodestone.plans.registry import query, rate
from lodestone.sources.adapters import records, twin

PAIRS = """t AS (SELECT * FROM boxes WHERE side = 'truth'), p AS (SELECT * FROM boxes WHERE side = 'proposal'),
  j AS (SELECT t.page_id, t.box_id AS t_id, p.box_id AS p_id, p.decision AS p_decision, (least(t.x2, p.x2) - greatest(t.x1, p.x1)) * (least(t.y2, p.y2) - greatest(t.y1, p.y1)) AS shared,
    (t.x2 - t.x1) * (t.y2 - t.y1) AS t_area, (p.x2 - p.x1) * (p.y2 - p.y1) AS p_area FROM t JOIN p ON t.page_id = p.page_id AND t.x1 < p.x2 AND p.x1 < t.x2 AND t.y1 < p.y2 AND p.y1 < t.y2),
  i AS (SELECT *, t_area + p_area - shared AS uni, round_even(shared / (t_area + p_area - shared), 6) AS iou FROM j)"""


@query("j11_box_pairs", twin(f"{PAIRS} SELECT page_id, t_id, p_id, shared, iou FROM i", "boxes"))
def j11(spark, d):
    return boxes.pairs(records(spark, d, "boxes")).select("page_id", "t_id", "p_id", "shared", "iou")


#: The matches as a fold over the pairs of a page, the largest overlap first.
MATCHES = f"""{PAIRS}, o AS (SELECT page_id, list({{'t': t_id, 'p': p_id, 'iou': iou}} ORDER BY shared / uni DESC, t_id DESC, p_id DESC) AS found FROM i WHERE shared / uni >= 0.3 GROUP BY 1),
  f AS (SELECT page_id, unnest(list_reduce(found, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.t = x.t OR y.p = x.p)) > 0 THEN a ELSE list_append(a, x) END, CAST([] AS STRUCT(t BIGINT, p BIGINT, iou DOUBLE)[]))) AS m FROM o),
  matches AS (SELECT page_id, m.t AS t_id, m.p AS p_id, m.iou AS iou FROM f)"""


@query("j12_box_matches", twin(f"{MATCHES} SELECT * FROM matches", "boxes"))
def j12(spark, d):
    return boxes.match(records(spark, d, "boxes"), 0.3)


@query("j12_missed_and_false_boxes", twin(f"{MATCHES} SELECT page_id, box_id, CASE side WHEN 'truth' THEN 'missed' ELSE 'false' END AS kind FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page_id = b.page_id AND b.box_id IN (m.t_id, m.p_id))", "boxes"))
def j12_rest(spark, d):
    rows = records(spark, d, "boxes")
    return boxes.unmatched(rows, boxes.match(rows, 0.3))


@query("j13_merge_and_split_events", twin(f"""{PAIRS}, m AS (SELECT page_id, count(*) AS n FROM (SELECT page_id, p_id FROM i WHERE shared / t_area >= 0.1 GROUP BY 1, 2 HAVING count(*) >= 2) x GROUP BY 1), s AS (SELECT page_id, count(*) AS n FROM (SELECT page_id, t_id FROM i WHERE shared / p_area >= 0.1 GROUP BY 1, 2 HAVING count(*) >= 2) x GROUP BY 1)
    SELECT page_id, coalesce(m.n, 0) AS merged, coalesce(s.n, 0) AS split FROM (SELECT DISTINCT page_id FROM boxes) g LEFT JOIN m USING (page_id) LEFT JOIN s USING (page_id)""", "boxes"))
def j13(spark, d):
    return boxes.events(records(spark, d, "boxes"))


@query("j14_duplicate_boxes", twin(f"{PAIRS}, a AS (SELECT page_id, t_id, count(*) AS n FROM i WHERE p_decision = 'accept_molecule' AND shared / uni >= 0.2 GROUP BY 1, 2) SELECT page_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM a GROUP BY 1", "boxes"))
def j14(spark, d):
    return boxes.duplicates(records(spark, d, "boxes"), 0.2)


@query("j15_box_context", twin(f"""{PAIRS}, o AS (SELECT *, shared * 1000000 // p_area AS covered, shared * 1000000 // least(t_area, p_area) AS best FROM i),
    g AS (SELECT page_id, p_id, CAST(least(1000000, sum(covered) FILTER (best >= 350000)) AS BIGINT) AS coverage, max(best) AS best_overlap, arg_max(t_id, (covered, t_id)) AS container FROM o GROUP BY 1, 2)
    SELECT p.page_id, p.box_id AS p_id, coalesce(coverage, 0) AS coverage, coalesce(best_overlap, 0) AS best_overlap, container FROM p LEFT JOIN g ON p.page_id = g.page_id AND p.box_id = g.p_id""", "boxes"))
def j15(spark, d):
    return boxes.context(records(spark, d, "boxes"))


def _share(a: str, b: str) -> str:
    """SQL text of what two boxes share over the smaller one's area."""
    return f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / least(greatest(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1), 1), greatest(({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1), 1))"


@query("j16_box_suppression", twin(f"""o AS (SELECT page_id, list({{'id': box_id, 'side': side, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY side <> 'truth', y1, x1, box_id) AS found FROM boxes GROUP BY 1),
    f AS (SELECT page_id, unnest(list_reduce(found, lambda a, x: CASE WHEN x.side <> 'truth' AND len(list_filter(a, lambda y: {_share('x', 'y')} >= 0.68)) > 0 THEN a ELSE list_append(a, x) END, found[1:0])) AS k FROM o)
    SELECT page_id, k.id AS box_id, k.side AS side FROM f""", "boxes"))
def j16(spark, d):
    return boxes.suppress(records(spark, d, "boxes"))


_UNION = "{'x1': list_min(list_transform(h, lambda y: y.x1)), 'y1': list_min(list_transform(h, lambda y: y.y1)), 'x2': list_max(list_transform(h, lambda y: y.x2)), 'y2': list_max(list_transform(h, lambda y: y.y2))}"


@query("g05_box_merge", twin(f"""o AS (SELECT page_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY y1, x1, box_id) AS found FROM boxes GROUP BY 1),
    s AS (SELECT page_id, 1 AS k, found[1] AS x, found[1:0] AS regions FROM o
      UNION ALL SELECT page_id, CASE WHEN len(hit) = 0 THEN k + 1 ELSE k END, CASE WHEN len(hit) = 0 THEN found[k + 1] ELSE {_UNION} END, CASE WHEN len(hit) = 0 THEN list_append(regions, x) ELSE rest END
      FROM (SELECT *, list_append(hit, x) AS h FROM (SELECT page_id, k, x, regions, list_filter(regions, lambda y: {_share('x', 'y')} >= 0.5) AS hit, list_filter(regions, lambda y: {_share('x', 'y')} < 0.5) AS rest FROM s) JOIN o USING (page_id)) WHERE k <= len(found)),
    e AS (SELECT page_id, unnest(regions) AS b FROM s JOIN o USING (page_id) WHERE k = len(found) + 1)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY b.y1, b.x1, b.y2, b.x2) AS region, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM e""", "boxes").replace("WITH ", "WITH RECURSIVE ", 1))
def g05(spark, d):
    return boxes.merge(records(spark, d, "boxes"))


@query("a21_proposal_totals", twin(f"""{MATCHES}, s AS (SELECT count(DISTINCT page_id) AS n_pages, count(*) FILTER (side = 'truth') AS n_truth, count(*) FILTER (side = 'proposal') AS n_proposals FROM boxes), c AS (SELECT count(*) AS tp, sum(CAST(round_even(iou * 1e6, 0) AS BIGINT)) AS millionths FROM matches)
    SELECT n_pages, n_truth, n_proposals, tp, {rate('tp', 'n_proposals')} AS precision, {rate('tp', 'n_truth')} AS recall, {rate('2 * tp', 'n_truth + n_proposals')} AS f1, round_even(millionths / tp, 3) AS mean_iou_millionths FROM s, c""", "boxes"))
def a21(spark, d):
    return boxes.proposal_totals(records(spark, d, "boxes"), 0.3)


_ROUTING = "count(*) FILTER (side = 'truth') AS n_truth, count(*) FILTER (side = 'proposal') AS n_proposals, " + ", ".join(f"count(*) FILTER (side = 'proposal' AND decision = '{k}') AS {n}" for k, n in (("accept_molecule", "n_accepted"), ("review_needed", "n_review"), ("reject_negative", "n_rejected")))


@query("a22_routing_totals", twin(f"SELECT {_ROUTING} FROM boxes", "boxes"))
def a22(spark, d):
    return boxes.routing(records(spark, d, "boxes"))


@query("a22_routing_by_page", twin(f"SELECT page_id, {_ROUTING} FROM boxes GROUP BY 1", "boxes"))
def a22_by(spark, d):
    return boxes.routing(records(spark, d, "boxes"), "page_id")


@query("w07_reading_order", twin("SELECT page_id, box_id, format('p{}_r{:03d}', page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, side, box_id)) AS region_id FROM boxes", "boxes"))
def w07(spark, d):
    return boxes.reading_order(records(spark, d, "boxes"))


@query("p42_clamped_boxes", twin("""c AS (SELECT page_id, box_id, least(greatest(x1, 0), 420) AS x1, least(greatest(y1, 0), 420) AS y1, least(greatest(x2, 0), 420) AS x2, least(greatest(y2, 0), 420) AS y2, x1 < 0 OR y1 < 0 OR x2 > 420 OR y2 > 420 AS cut FROM boxes)
    SELECT page_id, box_id, x1, y1, x2, y2, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'empty_box' WHEN cut THEN 'outside_page' ELSE '' END AS error FROM c""", "boxes"))
def p42(spark, d):
    return boxes.clamp(records(spark, d, "boxes"), 420, 420)


@query("p30_box_risks", twin("SELECT page_id, box_id, concat_ws(',', CASE WHEN (x2 - x1) * (y2 - y1) < 6400 THEN 'small' END, CASE WHEN x2 > 400 OR y2 > 400 THEN 'outside' END, CASE WHEN x1 = 0 OR y1 = 0 THEN 'at_edge' END) AS codes FROM boxes", "boxes"))
def p30(spark, d):
    return boxes.risks(records(spark, d, "boxes"))


@query("p50_scaled_boxes", twin("SELECT box_id, x1 * 3 // 2 AS x1, y1 * 3 // 2 AS y1, x2 * 3 // 2 AS x2, y2 * 3 // 2 AS y2 FROM boxes", "boxes"))
def p50(spark, d):
    return records(spark, d, "boxes").select("box_id", *[F.floor(F.col(k) * 3 / 2).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("w01_first_seen", twin("SELECT sample_id, content_key, min(sample_id) OVER g AS first, count(*) OVER g AS copies, sample_id <> min(sample_id) OVER g AS repeats FROM samples WINDOW g AS (PARTITION BY content_key)", "samples"))
def w01(spark, d):
    return dedup.first_seen(records(spark, d, "samples").select("sample_id", "content_key"), "content_key", "sample_id")


@query("w02_keep_first_two_keys", twin("""k AS (SELECT sample_id, CASE WHEN sample_id % 7 <> 0 THEN CASE WHEN sample_id % 5 = 0 THEN 'k' || CAST(sample_id % 40 AS VARCHAR) ELSE inchikey END END AS a, CASE WHEN sample_id % 11 <> 0 THEN CASE WHEN sample_id % 3 = 0 THEN 'k' || CAST(sample_id % 33 AS VARCHAR) ELSE content_key END END AS b FROM samples),
    f AS (SELECT list_reduce(list({'i': sample_id, 'a': a, 'b': b} ORDER BY sample_id), lambda s, x: CASE WHEN x.a IS NOT NULL AND list_contains(s.a, x.a) THEN {'a': s.a, 'b': s.b, 'o': list_append(s.o, {'i': x.i, 'r': 'duplicate_a'})} WHEN x.b IS NOT NULL AND list_contains(s.b, x.b) THEN {'a': s.a, 'b': s.b, 'o': list_append(s.o, {'i': x.i, 'r': 'duplicate_b'})}
      ELSE {'a': list_append(s.a, x.a), 'b': list_append(s.b, x.b), 'o': list_append(s.o, {'i': x.i, 'r': ''})} END, {'a': CAST([] AS VARCHAR[]), 'b': CAST([] AS VARCHAR[]), 'o': CAST([] AS STRUCT(i BIGINT, r VARCHAR)[])}) AS f FROM k), u AS (SELECT unnest(f.o) AS u FROM f)
    SELECT u.i AS sample_id, u.r AS reason FROM u""", "samples"))
def w02(spark, d):
    # Some keys are shared more widely, some are missing.
    n = F.col("sample_id")
    some = lambda k: F.concat(F.lit("k"), (n % k).cast("string"))
    a = F.when(n % 7 != 0, F.when(n % 5 == 0, some(40)).otherwise(F.col("inchikey")))
    b = F.when(n % 11 != 0, F.when(n % 3 == 0, some(33)).otherwise(F.col("content_key")))
    return dedup.keep_first_two_keys(records(spark, d, "samples").select("sample_id", a.alias("a"), b.alias("b")), "sample_id", "a", "b")


@query("a26_duplicate_groups", twin("g AS (SELECT 'content_key' AS key, content_key AS v FROM samples UNION ALL SELECT 'inchikey', inchikey FROM samples), n AS (SELECT key, v, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1) SELECT key, count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM n GROUP BY 1", "samples"))
def a26(spark, d):
    return dedup.duplicate_groups(records(spark, d, "samples"), "content_key", "inchikey")


@query("j17_near_hashes", """WITH h AS (SELECT vec_id, label, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END), lambda a, b: a + b) AS bits FROM embeddings)
    SELECT x.vec_id, min(y.vec_id) AS match FROM h x JOIN h y ON x.label = y.label AND y.vec_id < x.vec_id AND bit_count(xor(x.bits, y.bits)) <= 3 GROUP BY 1""")
def j17(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", dedup.sign_bits("embedding").alias("bits"))
    return dedup.near(rows, "vec_id", "bits", "label")


@query("j18_earliest_match", twin("SELECT sample_id, nullif(least(min(sample_id) OVER (PARTITION BY content_key), min(sample_id) OVER (PARTITION BY inchikey)), sample_id) AS match FROM samples", "samples"))
def j18(spark, d):
    return dedup.earliest_match(records(spark, d, "samples"), "sample_id", "content_key", "inchikey")


@query("g01_linked_groups", twin("""k AS (SELECT sample_id AS id, 'a' || inchikey AS v FROM samples UNION ALL SELECT sample_id, 'b' || content_key FROM samples), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (v)),
    reach AS (SELECT sample_id AS id, sample_id AS seen FROM samples UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a) SELECT id AS sample_id, min(seen) AS component FROM reach GROUP BY 1""", "samples").replace("WITH ", "WITH RECURSIVE ", 1))
def g01(spark, d):
    return splits.linked_groups(records(spark, d, "samples"), "sample_id", "inchikey", "content_key")


@query("g02_grouped_splits")
def g02(spark, d):
    return splits.grouped_split(g01(spark, d), "sample_id")


@query("g03_scaffold_splits")
def g03(spark, d):
    rows = records(spark, d, "samples").select("sample_id", F.col("scaffold_key").alias("component"))
    return splits.grouped_split(rows, "sample_id", shares=(0.7, 0.15, 0.15), labels=("train", "dev", "test"))


def _one_by_one(groups: str, shares: tuple[float, ...], labels: tuple[str, ...]) -> str:
    """SQL that gives groups (component, n), the largest first, one by one to the split that is filled least; the counts of each size and split."""
    target = ", ".join(f"greatest(1.0, (SELECT sum(n) FROM c) * {x}::DOUBLE / {sum(shares)}::DOUBLE)" for x in shares)
    least = "list_sort(list_transform(range(1, len(a.f) + 1), lambda i: {'l': a.f[i] / t[i], 'f': a.f[i], 'i': i}))[1].i"
    return f"""{groups}, t AS (SELECT [{target}] AS t), l AS (SELECT list({{'f': [n::DOUBLE], 'o': CAST([] AS STRUCT(s BIGINT, k BIGINT)[])}} ORDER BY n DESC) AS ns FROM c),
    r AS (SELECT list_reduce(ns, lambda a, x: {{'f': list_transform(range(1, len(a.f) + 1), lambda i: a.f[i] + CASE WHEN i = {least} THEN x.f[1] ELSE 0 END),
      'o': list_append(a.o, {{'s': x.f[1]::BIGINT, 'k': {least}::BIGINT}})}}, {{'f': [{', '.join('0::DOUBLE' for _ in shares)}], 'o': CAST([] AS STRUCT(s BIGINT, k BIGINT)[])}}) AS r FROM l, t),
    u AS (SELECT unnest(r.o) AS u FROM r) SELECT u.s AS size, {list(labels)}[u.k] AS split, count(*) AS n FROM u GROUP BY 1, 2"""


@query("g02_split_plan", twin(_one_by_one("""k AS (SELECT sample_id AS id, 'a' || inchikey AS v FROM samples UNION ALL SELECT sample_id, 'b' || content_key FROM samples), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (v)),
    reach AS (SELECT sample_id AS id, sample_id AS seen FROM samples UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a), p AS (SELECT id, min(seen) AS component FROM reach GROUP BY 1), c AS (SELECT component, count(*) AS n FROM p GROUP BY 1)""", (0.8, 0.1, 0.1), splits.LABELS), "samples").replace("WITH ", "WITH RECURSIVE ", 1))
def g02_plan(spark, d):
    return splits.split_plan(g02(spark, d))


@query("g03_split_plan", twin(_one_by_one("c AS (SELECT scaffold_key AS component, count(*) AS n FROM samples GROUP BY 1)", (0.7, 0.15, 0.15), ("train", "dev", "test")), "samples"))
def g03_plan(spark, d):
    return splits.split_plan(g03(spark, d))


@query("g04_scaffold_holdout", twin("""s AS (SELECT scaffold_key, count(*) AS n FROM samples GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, scaffold_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s)
    SELECT scaffold_key, n, CASE WHEN above < greatest(1, round_even((SELECT sum(n) FROM s) * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM r""", "samples"))
def g04(spark, d):
    return splits.holdout(records(spark, d, "samples"), "scaffold_key")


_CASES = """c AS (SELECT 'scaffolds' AS split_of, sample_id, scaffold_key AS g, category AS y FROM samples UNION ALL SELECT 'one scaffold', sample_id, 'x', category FROM samples
    UNION ALL SELECT 'classes apart', sample_id, CASE WHEN category = 'en' THEN 'x' ELSE scaffold_key END, CASE WHEN category = 'en' THEN 'en' ELSE 'other' END FROM samples)"""


@query("g04_holdout_with_fallback", twin(_CASES + """, s AS (SELECT split_of, g, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT split_of, sum(n) AS total, greatest(1, round_even(sum(n) * 0.2::DOUBLE, 0)) AS target FROM s GROUP BY 1),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split_of ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s),
    p AS (SELECT c.*, CASE WHEN above < target THEN 'test' ELSE 'train' END AS part FROM c JOIN r USING (split_of, g) JOIN t USING (split_of)),
    k AS (SELECT split_of, min(classes) AS least, count(*) AS parts FROM (SELECT split_of, part, count(DISTINCT y) AS classes FROM p GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT split_of, CASE WHEN parts < 2 THEN 'random_fallback_single_scaffold' WHEN least < 2 THEN 'random_fallback_class_coverage' ELSE 'scaffold' END AS reason FROM k),
    n AS (SELECT split_of, y, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split_of) AS BIGINT) AS total FROM c GROUP BY 1, 2), m AS (SELECT *, (total + 4) // 5 AS test FROM n),
    q AS (SELECT *, test * n // total + CASE WHEN row_number() OVER (PARTITION BY split_of ORDER BY test * n % total DESC, y) <= test - sum(test * n // total) OVER (PARTITION BY split_of) THEN 1 ELSE 0 END AS quota FROM m),
    h AS (SELECT split_of, sample_id, CASE WHEN row_number() OVER (PARTITION BY split_of, y ORDER BY md5('7:' || CAST(sample_id AS VARCHAR)), sample_id) <= quota THEN 'test' ELSE 'train' END AS part FROM c JOIN q USING (split_of, y))
    SELECT split_of, sample_id, CASE WHEN reason = 'scaffold' THEN p.part ELSE h.part END AS part, reason FROM p JOIN w USING (split_of) JOIN h USING (split_of, sample_id)""", "samples"))
def g04_fallback(spark, d):
    # As it is, with one group of all rows, and with all rows of the largest class in one group.
    rows = records(spark, d, "samples").select("sample_id", "scaffold_key", "category")
    apart = rows.select("sample_id", F.when(F.col("category") == "en", "x").otherwise(F.col("scaffold_key")).alias("scaffold_key"), F.when(F.col("category") == "en", "en").otherwise("other").alias("category"))
    cases = {"scaffolds": rows, "one scaffold": rows.withColumn("scaffold_key", F.lit("x")), "classes apart": apart}
    done = [splits.holdout_split(r, "sample_id", "scaffold_key", "category").withColumn("split_of", F.lit(k)) for k, r in cases.items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("a35_split_leakage", twin("""l AS (SELECT split, 'inchikey' AS key, inchikey AS value FROM samples UNION ALL SELECT split, 'scaffold_key', scaffold_key FROM samples UNION ALL SELECT split, 'content_key', content_key FROM samples)
    SELECT key, value, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM l GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""", "samples"))
def a35(spark, d):
    return splits.leakage(records(spark, d, "samples"), "split", "inchikey", "scaffold_key", "content_key")


@query("a36_group_checks", twin("SELECT inchikey, count(DISTINCT split) AS n_splits, count(DISTINCT content_key) AS n_identities, count(*) AS n FROM samples GROUP BY 1 HAVING count(DISTINCT split) > 1 OR count(DISTINCT content_key) > 1", "samples"))
def a36(spark, d):
    return splits.group_checks(records(spark, d, "samples"), "inchikey", "split", "content_key")


@query("w12_strata_sample", twin("""c AS (SELECT category, count(*) AS n FROM samples GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM c), s AS (SELECT category, n, greatest(1, n * 120 // total) AS base, n * 120 % total AS rest FROM c, t),
    q AS (SELECT *, greatest(0, 120 - sum(base) OVER ()) AS spare, row_number() OVER (ORDER BY rest DESC, category) AS rank FROM s), k AS (SELECT category, least(n, base + CASE WHEN rank <= spare THEN 1 ELSE 0 END) AS quota FROM q),
    r AS (SELECT category, sample_id, row_number() OVER (PARTITION BY category ORDER BY md5('7:' || CAST(sample_id AS VARCHAR)), sample_id) AS turn FROM samples) SELECT category, sample_id, CAST(turn AS INTEGER) AS turn FROM r JOIN k USING (category) WHERE turn <= quota""", "samples"))
def w12(spark, d):
    return splits.strata_sample(records(spark, d, "samples"), "category", "sample_id", 120)


@query("w12_recheck_queue", twin("""e AS (SELECT sample_id, category AS s, sample_id % 25 = 1 OR category = 'es' AS had FROM samples), c AS (SELECT s, count(*) AS n, count(*) FILTER (had) AS h FROM e GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(round_even(sum(n) * 0.3, 0) AS BIGINT) AS target FROM c),
    b AS (SELECT *, greatest(1, target * n // total) AS base FROM c, t), r AS (SELECT *, row_number() OVER (ORDER BY target * n - base * total DESC, n DESC, s DESC) <= target - sum(base) OVER () AS more FROM b),
    q AS (SELECT s, greatest(0, base + more::INT - h) AS lacking FROM r), o AS (SELECT e.s, sample_id, row_number() OVER (PARTITION BY e.s ORDER BY md5('7:' || CAST(sample_id AS VARCHAR)), sample_id) AS turn, lacking FROM e JOIN q USING (s) WHERE NOT had)
    SELECT s AS category, sample_id, 'quota' AS origin FROM o WHERE turn <= lacking UNION ALL SELECT s, sample_id, 'existing' FROM e WHERE had""", "samples"))
def w12_recheck(spark, d):
    rows = records(spark, d, "samples").select("category", "sample_id")
    return splits.recheck_sample(rows, rows.where("sample_id % 25 = 1 or category = 'es'"), "category", "sample_id", 0.3)


@query("w13_slice_sample", twin("""e AS (SELECT category, max(sample_id + 1) AS last FROM samples GROUP BY 1), s AS (SELECT category, CAST(floor(sample_id * 3 / last) AS BIGINT) AS slice, sample_id FROM samples JOIN e USING (category)) SELECT category, slice, arg_min(sample_id, (md5('7:' || CAST(sample_id AS VARCHAR)), sample_id)) AS sample_id FROM s GROUP BY 1, 2""", "samples"))
def w13(spark, d):
    rows = records(spark, d, "samples").select("category", "sample_id", (F.col("sample_id") + 1).alias("position"))
    return splits.slices(rows, "category", "position", "sample_id")


@query("w14_hash_sample", twin("s AS (SELECT DISTINCT scaffold_key, md5('7:' || scaffold_key) AS h FROM samples), r AS (SELECT scaffold_key, row_number() OVER (ORDER BY h) AS turn FROM s) SELECT scaffold_key, CAST(turn AS INTEGER) AS turn, CASE WHEN turn <= 20 THEN 'train' ELSE 'dev' END AS part FROM r WHERE turn <= 30", "samples"))
def w14(spark, d):
    return splits.hash_sample(records(spark, d, "samples"), "scaffold_key", 30, 20)


@query("w15_rarity", twin("l AS (SELECT compound_id, unnest(string_split(structure_features, ';')) AS tag FROM properties), f AS (SELECT tag, count(*) AS n FROM l GROUP BY 1) SELECT compound_id, CAST(sum(1000000 // n) AS BIGINT) AS rarity, count(*) AS n_tags FROM l JOIN f USING (tag) GROUP BY 1", "properties"))
def w15(spark, d):
    return splits.rarity(records(spark, d, "properties"), "compound_id", "structure_features")


@query("w16_round_robin", twin("SELECT category, sample_id, CAST((row_number() OVER (PARTITION BY category ORDER BY sample_id) - 1) % 8 AS INTEGER) AS label FROM samples", "samples"))
def w16(spark, d):
    rows = numbered(records(spark, d, "samples").select("category", "sample_id"), "category", "sample_id")
    return rows.select("category", "sample_id", F.pmod("place", F.lit(8)).cast("int").alias("label"))


VALID = "v AS (SELECT * FROM candidates WHERE status = 'success' AND canonical_key IS NOT NULL AND valid)"
CONSENSUS = f"""{VALID}, k AS (SELECT sample_id, canonical_key, count(*) AS n, min(priority) AS first, arg_min(backend, priority) AS lead FROM v GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first, canonical_key DESC) AS pick FROM k),
  c AS (SELECT sample_id, count(*) AS n_candidates, count(*) FILTER (status = 'success' AND canonical_key IS NOT NULL) AS n_tried FROM candidates GROUP BY 1), w AS (SELECT sample_id, count(*) AS n_valid FROM v GROUP BY 1),
  s AS (SELECT c.*, coalesce(n_valid, 0) AS n_valid, b.canonical_key, b.lead, CASE WHEN n_tried = 0 THEN 'all_failed' WHEN coalesce(n_valid, 0) = 0 THEN 'invalid_candidates' WHEN b.n > 1 THEN 'agreement' WHEN n_valid = 1 THEN 'single_valid' ELSE 'disagreement' END AS status
    FROM c LEFT JOIN w USING (sample_id) LEFT JOIN b ON b.sample_id = c.sample_id AND b.pick = 1),
  o AS (SELECT sample_id, n_candidates, n_valid, status, CASE WHEN status IN ('all_failed', 'invalid_candidates') THEN 'rejected' WHEN status IN ('agreement', 'single_valid') THEN 'accepted_with_warning' ELSE 'review_needed' END AS decision,
    CASE WHEN status IN ('agreement', 'single_valid') THEN 'medium' ELSE 'high' END AS risk, CASE WHEN status IN ('agreement', 'single_valid') THEN canonical_key END AS recommended_key, CASE status WHEN 'agreement' THEN 'consensus' WHEN 'single_valid' THEN lead END AS recommended_backend FROM s)"""


@query("w05_consensus", twin(f"{CONSENSUS} SELECT * FROM o", "candidates"))
def w05(spark, d):
    return consensus.consensus(records(spark, d, "candidates"))


@query("p20_outcome_flags", twin(f"""{CONSENSUS}, t AS (SELECT sample_id, max(truth_key) AS truth_key, max(coalesce(canonical_key = truth_key, false)) AS any_right FROM candidates GROUP BY 1), x AS (SELECT o.*, any_right, coalesce(recommended_key = truth_key, false) AS correct FROM o JOIN t USING (sample_id))
    SELECT count(*) AS n, count(*) FILTER (decision = 'accepted_with_warning' AND correct) AS correct_accept, count(*) FILTER (decision = 'accepted_with_warning' AND NOT correct) AS wrong_accept, count(*) FILTER (decision = 'rejected' AND NOT any_right) AS correct_reject, count(*) FILTER (decision = 'rejected' AND any_right) AS unnecessary_reject, count(*) FILTER (decision = 'review_needed') AS abstention FROM x""", "candidates"))
def p20(spark, d):
    return consensus.outcome_flags(records(spark, d, "candidates"))


@query("w06_best_attempt", twin(f"{VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY atom_count DESC, priority, canonical_key DESC) AS pick, count(*) OVER (PARTITION BY sample_id) AS n_valid FROM v), k AS (SELECT sample_id, count(DISTINCT canonical_key) AS n FROM v GROUP BY 1) SELECT sample_id, backend, canonical_key, n_valid, CASE WHEN n_valid >= 2 THEN k.n = 1 END AS agree FROM r JOIN k USING (sample_id) WHERE pick = 1", "candidates"))
def w06(spark, d):
    return consensus.best_attempt(records(spark, d, "candidates"))


@query("j19_candidate_pairs", twin("SELECT a.sample_id, a.backend AS first, b.backend AS second, a.canonical_key IS NOT DISTINCT FROM b.canonical_key AS same_key, abs(a.atom_count - b.atom_count) AS atom_difference, a.formal_charge - b.formal_charge AS charge_difference FROM candidates a JOIN candidates b ON a.sample_id = b.sample_id AND a.priority < b.priority", "candidates"))
def j19(spark, d):
    return consensus.pairwise(records(spark, d, "candidates"))


@query("j01_j02_backend_overlap", twin("""a AS (SELECT sample_id, canonical_key, coalesce(canonical_key = truth_key, false) AS ok FROM candidates WHERE backend = 'm1'), b AS (SELECT sample_id, canonical_key, coalesce(canonical_key = truth_key, false) AS ok FROM candidates WHERE backend = 'm2')
    SELECT CASE WHEN a.ok AND b.ok THEN 'both_right' WHEN a.ok THEN 'first_only' WHEN b.ok THEN 'second_only' WHEN a.canonical_key = b.canonical_key THEN 'both_wrong_alike' ELSE 'both_wrong_different' END AS overlap, count(*) AS n FROM a JOIN b USING (sample_id) GROUP BY 1""", "candidates"))
def j02(spark, d):
    return consensus.overlap_classes(records(spark, d, "candidates"), "m1", "m2")


@query("p27_candidate_routing", twin("g AS (SELECT sample_id, max(CASE WHEN backend = 'm1' AND status = 'success' AND valid THEN canonical_key END) AS p, max(CASE WHEN backend = 'm2' AND status = 'success' AND valid THEN canonical_key END) AS f FROM candidates GROUP BY 1) SELECT sample_id, CASE WHEN p IS NOT NULL THEN 'primary' WHEN f IS NOT NULL THEN 'fallback' ELSE 'none' END AS route, coalesce(p, f) AS key FROM g", "candidates"))
def p27(spark, d):
    return consensus.route(records(spark, d, "candidates"), "m1", "m2")


@query("p28_candidate_hints", twin("SELECT sample_id, backend, concat_ws(',', CASE WHEN status <> 'success' THEN 'failed' END, CASE WHEN status = 'success' AND NOT valid THEN 'invalid' END, CASE WHEN formal_charge <> 0 THEN 'charged' END, CASE WHEN atom_count >= 40 THEN 'large' END) AS hints FROM candidates", "candidates"))
def p28(spark, d):
    return consensus.risk_hints(records(spark, d, "candidates"))


@query("j25_variant_flips", twin("""v AS (SELECT sample_id, max(canonical_key) FILTER (priority = 1) AS a, max(canonical_key) FILTER (priority = 2) AS b, max(canonical_key) FILTER (priority = 3) AS c FROM candidates GROUP BY 1) SELECT sample_id, a, b, c, coalesce(a <> b, false) AS flips_1_2, coalesce(b <> c, false) AS flips_2_3 FROM v""", "candidates"))
def j25(spark, d):
    at = [F.max(F.when(F.col("priority") == k, F.col("canonical_key"))).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))]
    flip = lambda x, y: F.coalesce(F.col(x) != F.col(y), F.lit(False))
    return records(spark, d, "candidates").groupBy("sample_id").agg(*at).select("sample_id", "a", "b", "c", flip("a", "b").alias("flips_1_2"), flip("b", "c").alias("flips_2_3"))


VOTES = """l AS (SELECT sample_id, reviewer, max(seq) AS seq, arg_max(decision, seq) AS decision, arg_max(canonical_key, seq) AS k FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) AS turn FROM l),
  g AS (SELECT sample_id, count(*) AS n, max(decision) FILTER (turn = 1) AS d1, max(decision) FILTER (turn = 2) AS d2, max(k) FILTER (turn = 1) AS k1, max(k) FILTER (turn = 2) AS k2 FROM r WHERE turn <= 2 GROUP BY 1),
  s AS (SELECT sample_id, CASE WHEN n < 2 THEN 'pending' WHEN d1 <> d2 OR (d1 = 'approve' AND k1 <> k2) THEN 'disagreement' WHEN d1 = 'approve' THEN 'verified' ELSE 'rejected' END AS status FROM g)"""


@query("w03_vote_status", twin(f"{VOTES} SELECT * FROM s", "votes"))
def w03(spark, d):
    return review.vote_status(records(spark, d, "votes"))


@query("a28_queue_statistics", twin(f"{VOTES} SELECT (SELECT count(*) FROM votes) AS n_votes, (SELECT count(DISTINCT reviewer) FROM votes) AS n_reviewers, (SELECT count(DISTINCT sample_id) FROM votes) AS n_samples, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'rejected') AS n_rejected, count(*) FILTER (status = 'disagreement') AS n_disagreement, count(*) FILTER (status = 'pending') AS n_pending FROM s", "votes"))
def a28(spark, d):
    return review.queue_statistics(records(spark, d, "votes"))


@query("a31_recheck_consistency", twin("b AS (SELECT arg_min(decision, seq) AS first, arg_max(decision, seq) AS last FROM votes GROUP BY sample_id, reviewer HAVING count(*) > 1) SELECT first, count(*) AS n, count(*) FILTER (first = last) AS n_same, round_even(count(*) FILTER (first = last) / count(*), 6) AS rate FROM b GROUP BY 1", "votes"))
def a31(spark, d):
    return review.consistency(records(spark, d, "votes"))


@query("w17_latest_per_key", twin("SELECT reviewer, arg_max(decision, seq) AS decision, arg_max(sample_id, seq) AS sample_id FROM votes GROUP BY 1", "votes"))
def w17(spark, d):
    return review.latest(records(spark, d, "votes"), "reviewer", "seq", "decision", "sample_id")


@query("j08_p41_review_queue", twin(f"{VOTES} SELECT sample_id, category FROM samples WHERE category IN ('en', 'de') AND sample_id NOT IN (SELECT sample_id FROM s WHERE status IN ('verified', 'rejected'))", "votes", "samples"))
def j08(spark, d):
    done = review.vote_status(records(spark, d, "votes")).where(F.col("status").isin("verified", "rejected"))
    return records(spark, d, "samples").where(F.col("category").isin("en", "de")).join(done, "sample_id", "left_anti").select("sample_id", "category")


@query("j22_history_upsert", twin("""n AS (SELECT analysis_id, TIMESTAMP '2030-01-01' AS created_at, upper(filename) AS filename, 'success' AS status, decision, false AS is_favorite, protected, size_bytes + 1 AS size_bytes FROM history WHERE size_bytes % 3 = 0)
    SELECT h.analysis_id, h.created_at, coalesce(n.filename, h.filename) AS filename, coalesce(n.status, h.status) AS status, h.decision, h.is_favorite, h.protected, coalesce(n.size_bytes, h.size_bytes) AS size_bytes FROM history h LEFT JOIN n USING (analysis_id)""", "history"))
def j22(spark, d):
    old = records(spark, d, "history")
    new = old.where("size_bytes % 3 = 0").select("analysis_id", F.lit("2030-01-01").cast("timestamp_ntz").cast(old.schema["created_at"].dataType).alias("created_at"), F.upper("filename").alias("filename"), F.lit("success").alias("status"), "decision", F.lit(False).alias("is_favorite"), "protected", (F.col("size_bytes") + 1).alias("size_bytes"))
    return review.upsert(old, new, "analysis_id", ("created_at", "is_favorite"))


@query("j23_replace_by_key", twin("SELECT analysis_id, CASE WHEN size_bytes % 3 = 0 THEN 'new' ELSE status END AS status FROM history", "history"))
def j23(spark, d):
    old = records(spark, d, "history").select("analysis_id", "status", "size_bytes")
    return review.replace(old.select("analysis_id", "status"), old.where("size_bytes % 3 = 0").select("analysis_id", F.lit("new").alias("status")), "analysis_id")


@query("j24_cascade_delete", twin("SELECT c.sample_id, c.backend FROM candidates c WHERE 'a' || CAST(c.sample_id AS VARCHAR) NOT IN (SELECT analysis_id FROM history WHERE status = 'failed')", "candidates", "history"))
def j24(spark, d):
    gone = records(spark, d, "history").where("status = 'failed'").select("analysis_id")
    return records(spark, d, "candidates").withColumn("analysis_id", F.concat(F.lit("a"), F.col("sample_id").cast("string"))).join(gone, "analysis_id", "left_anti").select("sample_id", "backend")


@query("p40_history_search", twin("SELECT analysis_id, filename FROM history WHERE filename ILIKE '%FILE_1_%' AND status = 'success' AND is_favorite", "history"))
def p40(spark, d):
    return review.search(records(spark, d, "history"), "FILE_1_", "success", favorites=True).select("analysis_id", "filename")


@query("w18_history_page", twin("SELECT analysis_id, is_favorite, created_at FROM history ORDER BY is_favorite DESC, created_at DESC, analysis_id LIMIT 50 OFFSET 20", "history"))
def w18(spark, d):
    return review.page(records(spark, d, "history"), 20, 50).select("analysis_id", "is_favorite", "created_at")


@query("w08_retention", twin("""t AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS total FROM history), p AS (SELECT *, coalesce(CAST(sum(size_bytes) OVER (ORDER BY created_at, analysis_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior FROM history WHERE NOT protected)
    SELECT analysis_id, created_at, size_bytes FROM p, t WHERE created_at < TIMESTAMP '1996-01-01' OR total - prior > 300000000""", "history"))
def w08(spark, d):
    return review.retention(records(spark, d, "history"), "1996-01-01", 300000000)


@query("p38_a25_batch_summary", twin("""c AS (SELECT image_quality, CASE WHEN NOT recognition_success THEN 'failed' ELSE recognition_decision END AS main_category, manual_review_recommended FROM predictions) SELECT image_quality, main_category, count(*) AS n, count(*) FILTER (manual_review_recommended) AS n_recommended FROM c GROUP BY 1, 2""", "predictions"))
def p38(spark, d):
    rows = records(spark, d, "predictions").withColumn("status", F.when(F.col("recognition_success"), "success").otherwise("failed"))
    return review.batch_category(rows).groupBy("image_quality", "main_category").agg(F.count("*").alias("n"), count_if(F.col("manual_review_recommended")).alias("n_recommended"))


@query("j05_a38_per_document_change", twin("""m AS (SELECT source_document, count(*) FILTER (truth_class = predicted_class AND sample_id % 2 = 0) AS base, count(*) FILTER (truth_class = predicted_class AND sample_id % 2 = 1) AS candidate FROM classes WHERE truth_class = predicted_class GROUP BY 1) SELECT source_document, base, candidate, candidate - base AS change, candidate >= base AS passed FROM m""", "classes"))
def j05(spark, d):
    right = records(spark, d, "classes").where("truth_class = predicted_class")
    side = lambda k, name: right.where(F.col("sample_id") % 2 == k).groupBy("source_document").agg(F.count("*").alias(name))
    both = side(0, "base").join(side(1, "candidate"), "source_document", "full_outer").fillna(0)
    return both.withColumns({"change": F.col("candidate") - F.col("base"), "passed": F.col("candidate") >= F.col("base")})


@query("j03_enriched_manifest", twin("SELECT s.sample_id, s.category, p.recognition_decision, p.inference_time_ms FROM samples s LEFT JOIN predictions p USING (sample_id)", "samples", "predictions"))
def j03(spark, d):
    return records(spark, d, "samples").join(records(spark, d, "predictions").select("sample_id", "recognition_decision", "inference_time_ms"), "sample_id", "left").select("sample_id", "category", "recognition_decision", "inference_time_ms")


@query("j07_key_difference", twin("a AS (SELECT sample_id FROM predictions), b AS (SELECT DISTINCT sample_id FROM candidates) SELECT sample_id, 'missing' AS error FROM a WHERE sample_id NOT IN (SELECT sample_id FROM b) UNION ALL SELECT sample_id, 'unexpected' FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a)", "predictions", "candidates"))
def j07(spark, d):
    return key_difference(records(spark, d, "predictions"), records(spark, d, "candidates"), "sample_id")


@query("j09_excluded_identities", twin("""r AS (SELECT * FROM samples WHERE split = 'test'), c AS (SELECT * FROM samples WHERE split <> 'test') SELECT sample_id, CASE WHEN inchikey IN (SELECT inchikey FROM r) THEN 'inchikey' WHEN content_key IN (SELECT content_key FROM r) THEN 'content_key' ELSE '' END AS excluded_by FROM c""", "samples"))
def j09(spark, d):
    rows = records(spark, d, "samples").select("sample_id", "split", "inchikey", "content_key")
    held, rest = rows.where("split = 'test'"), rows.where("split <> 'test'")
    for k in ("inchikey", "content_key"):
        rest = rest.join(held.select(k).distinct().withColumn(f"by_{k}", F.lit(True)), k, "left")
    return rest.select("sample_id", ladder("", (F.col("by_inchikey"), "inchikey"), (F.col("by_content_key"), "content_key")).alias("excluded_by"))


@query("j26_set_overlap", twin("SELECT k.key, k.n FROM (SELECT 'inchikey' AS key, count(*) AS n FROM (SELECT inchikey FROM samples WHERE split = 'train' INTERSECT SELECT inchikey FROM samples WHERE split = 'test') x UNION ALL SELECT 'scaffold_key', count(*) FROM (SELECT scaffold_key FROM samples WHERE split = 'train' INTERSECT SELECT scaffold_key FROM samples WHERE split = 'test') y) k", "samples"))
def j26(spark, d):
    rows = records(spark, d, "samples")
    both = lambda k: rows.where("split = 'train'").select(k).intersect(rows.where("split = 'test'").select(k)).agg(F.lit(k).alias("key"), F.count("*").alias("n"))
    return both("inchikey").unionByName(both("scaffold_key"))


@query("j27_j29_expansion", twin("v AS (SELECT unnest(['clean', 'blur', 'rotate']) AS variant) SELECT sample_id, variant, CASE WHEN recognition_success THEN recognition_decision ELSE 'failed' END AS outcome FROM predictions, v WHERE expected_action = 'recognize'", "predictions"))
def j27(spark, d):
    c = F.col
    rows = records(spark, d, "predictions").where("expected_action = 'recognize'")
    return rows.select("sample_id", F.explode(F.array(*map(F.lit, ("clean", "blur", "rotate")))).alias("variant"), F.when(c("recognition_success"), c("recognition_decision")).otherwise("failed").alias("outcome"))


@query("j20_pair_similarity", """WITH b AS (SELECT vec_id, list_filter(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE > 0.1::DOUBLE) AS bits FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.bits AS p, y.bits AS q FROM b x JOIN b y ON y.vec_id = x.vec_id + 1)
    SELECT a, b, CASE WHEN len(list_distinct(list_concat(p, q))) > 0 THEN round_even(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) END AS similarity FROM p""")
def j20(spark, d):
    sets = similarity.bit_sets(spark.read.parquet(f"{d}/embeddings.parquet"))
    pairs = sets.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return similarity.pair_similarity(sets, pairs)


NEAREST = """b AS (SELECT vec_id, list_filter(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE > 0.1::DOUBLE) AS bits FROM embeddings), q AS (SELECT * FROM b WHERE vec_id % 50 = 0), t AS (SELECT * FROM b WHERE vec_id % 50 <> 0),
  s AS (SELECT q.vec_id, t.vec_id AS tid, len(list_intersect(q.bits, t.bits)) AS k, len(q.bits) + len(t.bits) AS n FROM q, t), r AS (SELECT *, k / (n - k) AS sim FROM s WHERE k > 0), w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, tid) AS pick FROM r),
  o AS (SELECT q.vec_id, w.tid AS match, round_even(coalesce(w.sim, 0.0), 4) AS similarity FROM q LEFT JOIN w ON q.vec_id = w.vec_id AND w.pick = 1)"""


@query("j21_nearest_neighbour", f"WITH {NEAREST} SELECT * FROM o")
def j21(spark, d):
    sets = similarity.bit_sets(spark.read.parquet(f"{d}/embeddings.parquet"))
    # The stated query set: every id that 50 divides, against all others.
    return similarity.nearest(sets.where("vec_id % 50 = 0"), sets.where("vec_id % 50 <> 0"))


@query("a42_applicability_domain", f"WITH {NEAREST} SELECT round_even(quantile_cont(similarity, 0.05), 6) AS threshold, min(similarity) AS least, round_even(sum(similarity::DECIMAL(18,4))::DOUBLE / count(*), 6) AS mean, count(*) AS n FROM o")
def a42(spark, d):
    return similarity.domain(j21(spark, d))


@query("u01_u03_key_sets", twin("a AS (SELECT DISTINCT source_document FROM predictions WHERE expected_action = 'reject'), b AS (SELECT DISTINCT source_document FROM predictions WHERE recognition_decision = 'accepted') SELECT source_document, source_document IN (SELECT * FROM a) AS in_first, source_document IN (SELECT * FROM b) AS in_second FROM (SELECT * FROM a UNION SELECT * FROM b) u", "predictions"))
def u01(spark, d):
    rows = records(spark, d, "predictions")
    a, b = rows.where("expected_action = 'reject'").select("source_document"), rows.where("recognition_decision = 'accepted'").select("source_document")
    sides = a.withColumn("k", F.lit(1)).unionByName(b.withColumn("k", F.lit(2)))
    return sides.groupBy("source_document").agg(F.bool_or(F.col("k") == 1).alias("in_first"), F.bool_or(F.col("k") == 2).alias("in_second"))


@query("u02_set_difference", twin("SELECT CAST(sample_id AS BIGINT) AS sample_id FROM (SELECT sample_id FROM samples EXCEPT SELECT sample_id FROM predictions WHERE recognition_success) x", "samples", "predictions"))
def u02(spark, d):
    return records(spark, d, "samples").select("sample_id").subtract(records(spark, d, "predictions").where("recognition_success").select("sample_id"))


@query("u05_error_union", twin("SELECT sample_id, backend, 'failed' AS reason, atom_count, NULL::BIGINT AS inference_time_ms FROM candidates WHERE status = 'failed' UNION ALL SELECT sample_id, 'ensemble', 'slow', NULL, inference_time_ms FROM predictions WHERE inference_time_ms > 19000", "candidates", "predictions"))
def u05(spark, d):
    a = records(spark, d, "candidates").where("status = 'failed'").select("sample_id", "backend", F.lit("failed").alias("reason"), "atom_count")
    b = records(spark, d, "predictions").where("inference_time_ms > 19000").select("sample_id", F.lit("ensemble").alias("backend"), F.lit("slow").alias("reason"), "inference_time_ms")
    return a.unionByName(b, allowMissingColumns=True)


@query("w09_run_ranking", twin("s AS (SELECT source_document, count(*) FILTER (predicted_key = truth_key) AS n_exact, count(*) FILTER (predicted_key IS NOT NULL) AS n_valid FROM predictions GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n_exact DESC, n_valid DESC, source_document) AS INTEGER) AS place FROM s", "predictions"))
def w09(spark, d):
    by = records(spark, d, "predictions").groupBy("source_document").agg(count_if(F.col("predicted_key") == F.col("truth_key")).alias("n_exact"), count_if(F.col("predicted_key").isNotNull()).alias("n_valid"))
    # One row for each run.
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_exact"), F.desc("n_valid"), "source_document")))


@query("w10_profile_selection", twin("""m AS (SELECT image_quality AS backend, category AS profile, count(*) AS n, count(*) FILTER (predicted_key = truth_key) AS n_exact, count(*) FILTER (recognition_success) AS n_success FROM predictions GROUP BY 1, 2), b AS (SELECT backend, n AS bn, n_success AS bs FROM m WHERE profile = '1-URGENT'),
    e AS (SELECT m.*, n_success * bn >= bs * n AS eligible FROM m JOIN b USING (backend)), r AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY eligible DESC, n_exact DESC, profile DESC) AS pick FROM e) SELECT backend, profile, n, n_exact, eligible FROM r WHERE pick = 1""", "predictions"))
def w10(spark, d):
    c = F.col
    m = records(spark, d, "predictions").groupBy(c("image_quality").alias("backend"), c("category").alias("profile")).agg(F.count("*").alias("n"), count_if(c("predicted_key") == c("truth_key")).alias("n_exact"), count_if(c("recognition_success")).alias("n_success"))
    base = m.where("profile = '1-URGENT'").select("backend", c("n").alias("bn"), c("n_success").alias("bs"))
    e = m.join(base, "backend").withColumn("eligible", c("n_success") * c("bn") >= c("bs") * c("n"))
    best = F.max_by(F.struct("profile", "n", "n_exact", "eligible"), F.struct("eligible", "n_exact", "profile")).alias("b")
    return e.groupBy("backend").agg(best).select("backend", "b.*")


@query("w11_worst_rows", twin("SELECT sample_id, CASE WHEN predicted_key IS NULL THEN NULL ELSE confidence_milli END AS score FROM predictions ORDER BY score NULLS FIRST, sample_id LIMIT 25", "predictions"))
def w11(spark, d):
    score = F.when(F.col("predicted_key").isNotNull(), F.col("confidence_milli"))
    return records(spark, d, "predictions").select("sample_id", score.alias("score")).orderBy(F.asc_nulls_first("score"), "sample_id").limit(25)


@query("w20_examples_by_reason", twin("r AS (SELECT recognition_decision, sample_id, row_number() OVER (PARTITION BY recognition_decision ORDER BY inference_time_ms DESC, sample_id) AS turn FROM predictions WHERE predicted_key IS DISTINCT FROM truth_key) SELECT recognition_decision, sample_id, CAST(turn AS INTEGER) AS turn FROM r WHERE turn <= 10", "predictions"))
def w20(spark, d):
    turn = F.row_number().over(Window.partitionBy("recognition_decision").orderBy(F.desc("inference_time_ms"), "sample_id"))
    rows = records(spark, d, "predictions").where(~F.col("predicted_key").eqNullSafe(F.col("truth_key")))
    return rows.select("recognition_decision", "sample_id", turn.alias("turn")).where("turn <= 10")


@query("p29_triage", twin("SELECT sample_id, CASE WHEN review_status = 'rejected' THEN 'rejected' WHEN source_license IN ('', 'CC BY', 'CC BY-NC 4.0') OR source_license LIKE 'No explicit%' THEN 'human_review' WHEN expected_action = 'reject' THEN 'human_review' WHEN review_status = 'verified' THEN 'machine_verified' ELSE 'pending' END AS verification_status FROM samples", "samples"))
def p29(spark, d):
    from lodestone.functions.rules import license_allowed

    c = F.col
    risk = codes(("license", ~license_allowed(c("source_license"))), ("negative", c("expected_action") == "reject"))
    return records(spark, d, "samples").select("sample_id", ladder("pending", (c("review_status") == "rejected", "rejected"), (F.arrays_overlap(risk, F.array(F.lit("license"), F.lit("negative"))), "human_review"), (c("review_status") == "verified", "machine_verified")).alias("verification_status"))


@query("v01_manifest_errors", twin("""e AS (SELECT sample_id, 'empty_license' AS error FROM samples WHERE source_license = '' UNION ALL SELECT sample_id, 'duplicate_content' FROM (SELECT sample_id, count(*) OVER (PARTITION BY content_key) AS n FROM samples) x WHERE n > 1 UNION ALL SELECT sample_id, 'short_text' FROM samples WHERE size_bytes < 100 UNION ALL SELECT sample_id, 'unverified_test' FROM samples WHERE split = 'test' AND review_status <> 'verified') SELECT * FROM e""", "samples"))
def v01(spark, d):
    c = F.col
    rows = dedup.first_seen(records(spark, d, "samples"), "content_key", "sample_id")
    found = codes(("empty_license", c("source_license") == ""), ("duplicate_content", c("copies") > 1), ("short_text", c("size_bytes") < 100), ("unverified_test", (c("split") == "test") & (c("review_status") != "verified")))
    return rows.select("sample_id", F.explode(found).alias("error"))


@query("a29_risk_counters", twin("""r AS (SELECT unnest(string_split(concat_ws(',', CASE WHEN status <> 'success' THEN 'failed' END, CASE WHEN status = 'success' AND NOT valid THEN 'invalid' END, CASE WHEN formal_charge <> 0 THEN 'charged' END, CASE WHEN atom_count >= 40 THEN 'large' END), ',')) AS hint FROM candidates) SELECT hint, count(*) AS n FROM r WHERE hint <> '' GROUP BY 1""", "candidates"))
def a29(spark, d):
    return consensus.risk_hints(records(spark, d, "candidates")).select(F.explode(F.split("hints", ",")).alias("hint")).where("hint <> ''").groupBy("hint").agg(F.count("*").alias("n"))


@query("a43_a45_artifacts", twin("SELECT source_document, count(DISTINCT category) AS n_categories, count(DISTINCT recognition_decision) AS n_decisions, min(sample_id) AS first_sample FROM predictions GROUP BY 1", "predictions"))
def a43(spark, d):
    return records(spark, d, "predictions").groupBy("source_document").agg(F.count_distinct("category").alias("n_categories"), F.count_distinct("recognition_decision").alias("n_decisions"), F.min("sample_id").alias("first_sample"))


@query("a44_input_totals", twin("SELECT source_document, count(*) AS n_files, count(DISTINCT content_key) AS n_unique, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, concat_ws(',', CASE WHEN count(*) > 40 THEN 'too_many_files' END, CASE WHEN sum(size_bytes) > 100000 THEN 'too_large' END) AS limits FROM samples GROUP BY 1", "samples"))
def a44(spark, d):
    by = records(spark, d, "samples").groupBy("source_document").agg(F.count("*").alias("n_files"), F.count_distinct("content_key").alias("n_unique"), F.sum("size_bytes").alias("total_bytes"))
    return by.withColumn("limits", F.array_join(codes(("too_many_files", F.col("n_files") > 40), ("too_large", F.col("total_bytes") > 100000)), ","))


@query("s12_remaining_work", twin("SELECT sample_id FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM predictions WHERE recognition_success) ORDER BY sample_id LIMIT 100", "samples", "predictions"))
def s12(spark, d):
    done = records(spark, d, "predictions").where("recognition_success").select("sample_id")
    return records(spark, d, "samples").select("sample_id").join(done, "sample_id", "left_anti").orderBy("sample_id").limit(100)


@query("s13_cache_reuse", twin("n AS (SELECT sample_id, content_key FROM samples WHERE split = 'test'), c AS (SELECT content_key, min(sample_id) AS cached FROM samples WHERE split = 'train' AND review_status = 'verified' GROUP BY 1) SELECT n.sample_id, cached, cached IS NOT NULL AS hit FROM n LEFT JOIN c USING (content_key)", "samples"))
def s13(spark, d):
    rows = records(spark, d, "samples")
    cached = rows.where("split = 'train' and review_status = 'verified'").groupBy("content_key").agg(F.min("sample_id").alias("cached"))
    return rows.where("split = 'test'").join(cached, "content_key", "left").select("sample_id", "cached", F.col("cached").isNotNull().alias("hit"))


@query("s15_chunks", twin("r AS (SELECT category, sample_id, (row_number() OVER (PARTITION BY category ORDER BY sample_id) - 1) // 75 AS chunk FROM samples) SELECT category, chunk, count(*) AS n, min(sample_id) AS first, max(sample_id) AS last FROM r GROUP BY 1, 2", "samples"))
def s15(spark, d):
    rows = numbered(records(spark, d, "samples").select("category", "sample_id"), "category", "sample_id").withColumn("chunk", F.floor(F.col("place") / 75))
    return rows.groupBy("category", "chunk").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))


@query("a41_model_gate", twin("s AS (SELECT image_quality, count(*) AS n, count(*) FILTER (predicted_key = truth_key) AS k FROM predictions GROUP BY 1) SELECT image_quality, CASE WHEN n < 100 THEN 'insufficient' WHEN k / n >= 0.7 THEN 'qualified' ELSE 'unqualified' END AS status FROM s", "predictions"))
def a41(spark, d):
    by = metrics.flags(records(spark, d, "predictions")).groupBy("image_quality").agg(F.count("*").alias("n"), count_if(F.col("exact")).alias("k"))
    return by.select("image_quality", ladder("unqualified", (F.col("n") < 100, "insufficient"), (F.col("k") / F.col("n") >= 0.7, "qualified")).alias("status"))
