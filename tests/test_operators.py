"""Folds and joins whose steps depend on each other, against plain versions; odd inputs."""

import datetime
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.columns import tanimoto
from lodestone.functions.decisions import retry_codes, short_text
from lodestone.functions.rules import license_allowed, license_key, tidy_message
from lodestone.operators import boxes, confusion, consensus, dedup, edits, folds, metrics, review, similarity, splits, tables, validation
from lodestone.operators.graph import components
from lodestone.operators.order import numbered

BOX = "page_id long, side string, box_id long, x1 long, y1 long, x2 long, y2 long, decision string"


def random_boxes(seed, n=14, pages=3):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for i in range(n):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((p, rng.choice(["truth", "proposal"]), p * 100 + i, x, y, x + rng.randrange(20, 50), y + rng.randrange(20, 50), "accept_molecule"))
    return rows


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    s = max(0, w) * max(0, h)
    return s / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - s)


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_takes_the_largest_overlap_first(spark, seed):
    rows = random_boxes(seed)
    got = {(r.page_id, r.t_id, r.p_id) for r in boxes.match(spark.createDataFrame(rows, BOX), 0.3).collect()}
    want = set()
    for p in range(3):
        own = [r for r in rows if r[0] == p]
        pairs = sorted(((iou(t, q), t[2], q[2]) for t in own if t[1] == "truth" for q in own if q[1] == "proposal"), reverse=True)
        used = set()
        for s, t, q in pairs:
            if s >= 0.3 and not {("t", t), ("q", q)} & used:
                used |= {("t", t), ("q", q)}
                want.add((p, t, q))
    assert got == want


def test_ties_prefer_larger_ids_and_merges_grow(spark):
    rows = [(0, "truth", 1, 0, 0, 10, 10, ""), (0, "proposal", 5, 0, 0, 10, 10, ""), (0, "proposal", 6, 0, 0, 10, 10, "")]
    assert [r.p_id for r in boxes.match(spark.createDataFrame(rows, BOX)).collect()] == [6]
    chain = [(0, "truth", 1, 0, 0, 10, 10, ""), (0, "truth", 2, 6, 0, 18, 10, ""), (0, "truth", 3, 1, 0, 11, 10, ""), (0, "truth", 4, 40, 40, 50, 50, "")]
    merged = boxes.merge(spark.createDataFrame(chain, BOX), 0.4).orderBy("region").collect()
    assert [(r.x1, r.x2) for r in merged] == [(0, 18), (40, 50)]
    kept = boxes.suppress(spark.createDataFrame(rows, BOX)).collect()
    assert [r.box_id for r in kept] == [1]


def test_keep_first_over_two_keys(spark):
    # The second row is dropped for its a and so does not reserve its b.
    rows = [(1, "p", "x"), (2, "p", "y"), (3, "q", "y"), (4, "r", "x"), (5, "r", "z"), (6, "s", "z")]
    got = dict(dedup.keep_first_two_keys(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b").collect())
    assert got == {1: "", 2: "duplicate_a", 3: "", 4: "duplicate_b", 5: "", 6: "duplicate_b"}


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first_with_missing_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(i, *(None if rng.random() < 0.2 else f"{k}{rng.randrange(25)}" for k in "ab")) for i in range(80)]
    want, seen = {}, (set(), set())
    for i, a, b in rows:
        want[i] = "duplicate_a" if a in seen[0] else "duplicate_b" if b in seen[1] else ""
        if not want[i]:
            seen[0].update({a} - {None})
            seen[1].update({b} - {None})
    got = dedup.keep_first_two_keys(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b").collect()
    assert dict(got) == want and len(got) == len(rows)


def test_region_edits_that_need_a_state(spark):
    schema = "document_id string, page int, region_id string, x1 int, y1 int, x2 int, y2 int, region_type string, status string, confirmed boolean"
    regions = spark.createDataFrame([("d", 1, "r", 0, 0, 9, 9, "molecule", "detected", False), ("d", 1, "s", 0, 0, 9, 9, "text", "detected", True)], schema)
    log = [("recognize", "r"), ("confirm", "r"), ("recognize", "r"), ("recognize", "s"), ("recognize", "none")]
    df = spark.createDataFrame([("d", k, a, r, None, 1, None, None, None, None, None) for k, (a, r) in enumerate(log)], "document_id string, seq long, action string, region_id string, other_id string, page int, x1 int, y1 int, x2 int, y2 int, region_type string")
    assert {r.region_id: r.audit for r in edits.apply_edits(regions, df, 100, 100).collect()} == {"r": "recognize!,confirm,recognize", "s": "recognize!"}


def test_components_and_splits(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 170)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    up = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = up[a], up[b]
        up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = [(i, f"s{rng.randrange(30)}", rng.choice(["", "negative", f"k{rng.randrange(40)}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s string, k string")
    groups = splits.linked_groups(df, "id", "s", "k")
    made = df.join(splits.grouped_split(groups, "id"), "id")
    assert made.count() == 120
    assert splits.leakage(made, "split", "s", "k").count() == 0
    counts = {r.split: r["count"] for r in splits.grouped_split(df.select("id", F.col("id").alias("component")), "id").groupBy("split").count().collect()}
    assert counts == {"train": 96, "validation": 12, "test": 12}


def test_fill_plan_is_as_even_as_one_by_one():
    rng = random.Random(5)
    for _ in range(50):
        sizes = {rng.randrange(1, 30): rng.randrange(1, 40) for _ in range(5)}
        total = sum(s * n for s, n in sizes.items())
        target, filled = [total * x for x in (0.8, 0.1, 0.1)], [0, 0, 0]
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                k = min(range(3), key=lambda i: (filled[i] / max(target[i], 1), filled[i], i))
                filled[k] += s
        own = [0, 0, 0]
        for s, a, b, k in splits.fill_plan(sizes, (0.8, 0.1, 0.1)):
            own[k] += s * (b - a)
        assert sum(own) == total
        assert own == filled


def test_votes(spark):
    rows = [(1, "a", 1, "approve", "K"), (1, "b", 2, "approve", "K"), (2, "a", 3, "approve", "K"), (2, "b", 4, "approve", "L"), (3, "a", 5, "reject", ""), (4, "a", 6, "approve", "K"), (4, "b", 7, "reject", ""), (4, "a", 8, "reject", ""), (5, "a", 9, "approve", "K"), (5, "a", 10, "approve", "K")]
    votes = spark.createDataFrame(rows, "sample_id long, reviewer string, seq long, decision string, canonical_key string")
    assert dict(review.vote_status(votes).collect()) == {1: "verified", 2: "disagreement", 3: "pending", 4: "rejected", 5: "pending"}


def test_licenses(spark):
    given = {"CC BY 4.0": "cc-by-4.0", "https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa-3.0", "CC0": "cc0-1.0", "CC BY": "", "Public Domain (PubChem)": "public-domain-pubchem", "": "", "cc-by-sa 4.0": "", "CC BY-SA version 4.0": "cc-by-sa-4.0", "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0", "CC BY-NC 4.0": ""}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", license_key(F.col("s")).alias("k"), license_allowed(F.col("s")).alias("ok")).collect()
    assert {r.s: r.k for r in rows} == given
    assert not any(r.ok for r in rows if r.s in ("CC BY", "", "CC BY-NC 4.0"))
    line = spark.range(1).select(tidy_message(F.lit(" bad \n file /usr/lib/x.so  now")).alias("x")).first().x
    assert line == "bad file <path> now"
    paths = {"C:\\a\\b.txt and/or x": "<path> and/or x", "at=/a/b": "at=<path>", "a/b/c": "a<path>", "": "", "/a": "/a"}
    rows = spark.createDataFrame([(k,) for k in paths], "s string").select("s", tidy_message(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == paths


def test_short_texts(spark):
    given = {"(a).": True, "A": True, "Fig 3b": True, "figure": True, "Eq.2": True, "12": True, "12)": True, "12c": True, "1.2.3": True, "kHz": True, "": False, None: False, "ab": False, "1..2": False, "C6H6": False, "figs": True, "a1": False, "1234567890123456789": False}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", short_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == given


def test_ranks_are_half_even(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v long")
    r = metrics.ranks(df, "v").first()
    assert (r.p50, r.p95, r.median, r.mean) == (30, 40, 25.0, 25.0)
    assert metrics.ranks(spark.createDataFrame([(v,) for v in (1, 2)], "v long"), "v").first().p50 == 1
    assert metrics.ranks(df.limit(0), "v").first().n is None


def test_golden_run(spark):
    """The rates of a small published run: nine of ten positives valid and exact, one of two negatives read as positive."""
    rows = [("recognize", "K", "K" if i < 9 else None, True, "accepted_with_warning", True) for i in range(10)] + [("reject", "", "X", True, "review_needed", True), ("reject", "", None, False, "rejected", True)]
    df = spark.createDataFrame([(i, *r, "", "", "", "", "", 9000 + i) for i, r in enumerate(rows)], "sample_id long, expected_action string, truth_key string, predicted_key string, recognition_success boolean, recognition_decision string, manual_review_recommended boolean, category string, source_document string, perturbation string, structure_features string, message string, inference_time_ms long")
    r = metrics.summary(df).first()
    assert (r.n_positive, r.n_negative, r.valid_rate, r.exact_rate, r.hallucination_rate, r.false_accept_rate) == (10, 2, 0.9, 0.9, 0.5, 0.0)
    only = metrics.summary(df.where("expected_action = 'reject'")).first()
    assert only.valid_rate is None and only.success_rate == 0.5
    assert not metrics.gates(df).first().all_passed


def test_near_hashes(spark):
    rng = random.Random(7)
    rows, base = [], [rng.getrandbits(64) for _ in range(6)]
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h, rng.choice("ab")))
    got = dict(dedup.near(spark.createDataFrame(rows, "id long, bits long, g string"), "id", "bits", "g").collect())
    want = {}
    for i, h, g in rows:
        found = [j for j, k, o in rows if j < i and g == o and bin((h ^ k) & (1 << 64) - 1).count("1") <= 3]
        if found:
            want[i] = min(found)
    assert got == want


def test_nearest(spark):
    rng = random.Random(8)
    sets = [(i, 0, sorted(rng.sample(range(30), rng.randrange(8)))) for i in range(60)]
    df = spark.createDataFrame(sets, "vec_id long, label int, bits array<int>")
    got = {r.vec_id: (r.match, r.similarity) for r in similarity.nearest(df.where("vec_id < 10"), df.where("vec_id >= 10")).collect()}
    for i, _, b in sets[:10]:
        best = max(((len(set(b) & set(c)) / len(set(b) | set(c)), -j) for j, _, c in sets[10:] if set(b) & set(c)), default=None)
        assert got[i] == ((None, 0.0) if best is None else (-best[1], round(best[0], 4)))
    assert spark.range(1).select(tanimoto(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("x")).first().x is None


def test_edits(spark):
    regions = spark.createDataFrame([("d", 1, "r1", 0, 0, 10, 10, "molecule", "detected", False), ("d", 1, "r2", 20, 0, 30, 10, "text", "detected", False), ("e", 1, "r1", 0, 0, 10, 10, "molecule", "detected", False)], "document_id string, page int, region_id string, x1 int, y1 int, x2 int, y2 int, region_type string, status string, confirmed boolean")
    log = [("d", 1, "confirm", "r1", None, 1, None, None, None, None, None), ("d", 2, "merge", "r1", "r2", 1, None, None, None, None, None), ("d", 3, "update", "r1", None, 1, -5, 0, 40, 20, "reaction"), ("d", 4, "add", "r3", None, 1, 50, 50, 70, 70, None), ("d", 5, "split", "r3", "r4", 1, None, None, None, None, None), ("d", 6, "delete", "zz", None, 1, None, None, None, None, None), ("d", 7, "confirm_page", "", None, 1, None, None, None, None, None)]
    df = spark.createDataFrame(log, "document_id string, seq long, action string, region_id string, other_id string, page int, x1 int, y1 int, x2 int, y2 int, region_type string")
    got = {(r.document_id, r.region_id): r for r in edits.apply_edits(regions, df, 100, 100).collect()}
    a = got["d", "r1"]
    assert (a.x1, a.x2, a.y2, a.region_type, a.status, a.audit) == (0, 40, 20, "reaction", "confirmed", "confirm,merge,update,confirm_page")
    assert (got["d", "r2"].status, got["d", "r2"].audit) == ("deleted", "merged_into")
    assert [(got["d", k].x1, got["d", k].x2, got["d", k].confirmed) for k in ("r3", "r4")] == [(50, 60, True), (60, 70, True)]
    assert got["e", "r1"].audit == ""
    assert {r.reason: r.n for r in edits.skipped(edits.apply_edits(regions, df, 100, 100)).collect()} == {"deleted": 1, "unconfirmed": 1, "": 3}
    assert edits.annotations(edits.apply_edits(regions, df, 100, 100)).first().page == 1


def test_consensus_statuses(spark):
    rows = [(1, "m1", 1, "success", "A", True), (1, "m2", 2, "success", "A", True), (1, "m3", 3, "success", "B", True), (2, "m1", 1, "failed", None, False), (3, "m1", 1, "success", "A", False), (4, "m1", 1, "success", "A", True), (5, "m1", 1, "success", "A", True), (5, "m2", 2, "success", "B", True)]
    df = spark.createDataFrame(rows, "sample_id long, backend string, priority int, status string, canonical_key string, valid boolean")
    got = {r.sample_id: (r.status, r.decision, r.recommended_key, r.recommended_backend) for r in consensus.consensus(df).collect()}
    assert got == {1: ("agreement", "accepted_with_warning", "A", "consensus"), 2: ("all_failed", "rejected", None, None), 3: ("invalid_candidates", "rejected", None, None), 4: ("single_valid", "accepted_with_warning", "A", "m1"), 5: ("disagreement", "review_needed", None, None)}


def test_retention_in_order(spark):
    rng = random.Random(9)
    rows = [(f"a{i}", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=rng.randrange(900))).to_pydatetime(), rng.random() < 0.2, rng.randrange(1, 50)) for i in range(200)]
    got = {r.analysis_id for r in review.retention(spark.createDataFrame(rows, "analysis_id string, created_at timestamp, protected boolean, size_bytes long"), "2024-01-10", 1500).collect()}
    total, want = sum(r[3] for r in rows), set()
    for i, t, p, s in sorted(rows, key=lambda r: (r[1], r[0])):
        if not p and (t < pd.Timestamp("2024-01-10") or total > 1500):
            want.add(i)
            total -= s
    assert got == want


def test_scores(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, rng.randrange(1000)) for _ in range(300)]
    r = confusion.binary_scores(spark.createDataFrame(rows, "y boolean, s long"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert abs(r.roc_auc - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-6


def test_two_orders_of_sampling(spark):
    df = spark.createDataFrame([(i, "x" if i % 10 else "y") for i in range(100)], "id long, s string")
    got = splits.strata_sample(df, "s", "id", 10).collect()
    by = defaultdict(int)
    for r in got:
        by[r.s] += 1
    assert by == {"x": 9, "y": 1}
    assert splits.hash_sample(df, "id", 5, 3).where("part = 'train'").count() == 3
    assert splits.holdout(df, "s", 0.2).where("part = 'test'").count() == 1


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000)) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, v long").repartition(7), "g", "v").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.place, r.v))
    for g, own in by.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for h, v in rows if h == g)


def test_nearest_by_pivots_is_exact_and_skips(spark):
    rng = random.Random(18)
    # Forty families whose members share most of their elements, one copied over a third of the rows, and odd sets.
    sets = []
    for i in range(600):
        family = i % 40
        core = range(1000 * family, 1000 * family + 30)
        sets.append((i, 0, sorted(rng.sample(core, 24))))
    sets += [(600 + i, 0, list(range(5000, 5020))) for i in range(300)]
    sets += [(900, 0, None), (901, 0, []), (902, 0, [7777777]), (903, 0, [3, 3, None, 4])]
    df = spark.createDataFrame(sets, "vec_id long, label int, bits array<int>")
    asked = "vec_id % 20 = 0 or vec_id >= 900"
    got = {r.vec_id: (r.match, r.similarity) for r in similarity.nearest(df.where(asked), df.where(f"not ({asked})"), chunk=16).collect()}
    plain = {i: set(b or ()) - {None} for i, _, b in sets}
    train = [i for i in plain if i % 20 and i < 900]
    assert set(got) == set(plain) - set(train)
    for i in got:
        best = max(((len(plain[i] & plain[j]) / len(plain[i] | plain[j]), -j) for j in train if plain[i] & plain[j]), default=None)
        assert got[i] == ((None, 0.0) if best is None else (-best[1], round(best[0], 4))), i
    # Pairs compared: whole chunks that a query is sent to.
    clean = similarity._clean(df)
    pivots = [list(r.bits) for r in clean.orderBy(F.xxhash64("bits")).dropDuplicates(["bits"]).limit(32).collect()]
    dealt, about = similarity._cells(clean.where(f"not ({asked})"), pivots, 16)
    asking = clean.where("vec_id % 20 = 0").withColumn("found", F.lit(0.5))
    sent = similarity._asked(asking, pivots, about, False).groupBy("cell", "chunk").agg(F.count("*").alias("q")).join(dealt.groupBy("cell", "chunk").agg(F.count("*").alias("t")), ["cell", "chunk"])
    assert sent.agg(F.sum(F.col("q") * F.col("t"))).first()[0] < 0.3 * asking.count() * len(train)
    assert [tuple(r) for r in similarity.nearest(df.where("vec_id = 3"), df.where("false")).collect()] == [(3, None, 0.0)]


def test_dense_pages_compare_near_boxes_only():
    rng = random.Random(4)

    def plain(rows):
        regions = []
        for box in rows:
            while hit := [o for o in regions if boxes._smaller(box, o) >= 0.5]:
                regions = [o for o in regions if o not in hit]
                for o in hit:
                    box = (min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3]))
            regions.append(box)
        return sorted(regions)

    for side in (60, 400, 3000):
        rows = [(x, y, x + rng.randrange(-1, rng.choice((3, 30, 300))), y + rng.randrange(30)) for x, y in ((rng.randrange(-side, side), rng.randrange(side)) for _ in range(400))]
        state = boxes._Regions(1, 0.5)
        for k, b in enumerate(rows):
            state.take(k, *b)
        assert sorted(state.regions.values()) == plain(rows)
        chosen, kept = boxes._Uncovered(1, 0.68), []
        for k, b in enumerate(rows):
            free = not any(boxes._smaller(b, o) >= 0.68 for o in kept)
            assert bool(chosen.take(k, "proposal", *b)) == free
            kept += [b] if free else []
    start = time.time()
    state = boxes._Regions(1, 0.5)
    for k in range(100_000):
        x, y = rng.randrange(60_000), rng.randrange(60_000)
        state.take(k, x, y, x + 40, y + 40)
    assert len(state.end()) > 50_000 and time.time() - start < 60
    with pytest.raises(ValueError):
        boxes.merge(None, 0.0)


def test_release_summary_of_few_columns(spark):
    schema = "sample_id long, expected_action string, truth_key string, predicted_key string, recognition_success boolean, confidence_milli long, inference_time_ms long, recognition_decision string, manual_review_recommended boolean, category string, perturbation string, message string"
    rows = [(1, "recognize", "A", "A", True, 900, 10, "accepted", False, "x", "", ""), (2, None, "A", None, None, None, None, None, None, None, None, None), (3, "reject", "B", "B", True, 2000, 30, "accepted", False, "x", "blur", "")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.dimension, r.value): r for r in metrics.release_summary(df, ("category", "backend")).collect()}
    assert set(got) == {("all", "all"), ("category", "x"), ("category", "unknown"), ("backend", "unknown")}
    r = got["all", "all"]
    assert (r.n_total, r.n_positive, r.n_exact, r.n_false_accept, r.n_confidence, r.calibration_error, r.n_latency, r.p95_latency_ms) == (3, 2, 1, 1, 1, 0.1, 2, 30)
    assert (r.n_similarity, r.mean_similarity, r.stereo_exact_rate, r.n_sources, r.failure_distribution) == (0, None, None, 0, "unknown_backend_failure=1")
    alone = got["category", "unknown"]
    assert (alone.n_total, alone.n_latency, alone.median_latency_ms, alone.calibration_error) == (1, 0, None, None)
    assert metrics.release_summary(df.where("false")).count() == 0
    assert metrics.trusted_summary(df).first().n_charge_differs == 0


def test_attempts_stop_at_the_first_usable_one(spark):
    rows = [(1, 1, False, None, False, None, None), (1, 2, True, "A", True, 900, None), (1, 3, True, "A", True, 900, None), (2, 1, True, "A", True, None, ["low_contrast"]), (2, 2, True, "A", True, 900, ["low_contrast"]), (2, 3, True, "B", True, 900, []), (3, 1, True, "", False, 100, [])]
    df = spark.createDataFrame(rows, "k long, turn int, success boolean, result string, valid boolean, confidence long, quality array<string>")
    c = F.col
    why = retry_codes(c("success"), c("result"), c("valid"), c("confidence"), F.lit(None).cast("string"), 300, c("quality"), F.lit(False), c("turn") == 1)
    got = {(r.k, r.turn): (r.reasons, r.stops, r.made) for r in consensus.attempts_made(df, "k", "turn", c("success"), c("valid"), why).collect()}
    assert got[1, 1] == (["image_quality_failed", "missing_result", "recognition_failed"], False, True)
    assert got[1, 2] == ([], True, True) and not got[1, 3][2]
    assert got[2, 1] == (["image_quality_low_contrast"], False, True) and got[2, 2] == ([], True, True) and not got[2, 3][2]
    assert got[3, 1][0] == ["image_quality_failed", "low_confidence", "missing_result"]


def test_holdout_findings_of_odd_sets(spark):
    schema = "cid string, key string, split string, image_variant string, perturbation string, image_sha256 string"
    sources = spark.createDataFrame([("1", "s1")], "cid string, response_sha256 string")
    found = lambda rows, least: {r.code: r.n for r in validation.holdout_findings(spark.createDataFrame(rows, schema), reference, sources, ("key",), "cid", ("blur",), least=least).collect()}
    reference = spark.createDataFrame([("9", "k9", "train", None, None, None)], schema)
    good = [("1", "k1", "external_holdout", "official_clean", None, "s1"), ("2", None, "external_holdout", "synthetic_perturbation", "blur", None)]
    assert found(good, 2) == {}
    assert found([("1", "k9", None, "official_clean", None, None), ("2", "k9", "external_holdout", "synthetic_perturbation", None, None)], 3) == {"key_leakage": 1, "wrong_split": 1, "untyped_perturbation": 1, "type_missing": 1, "not_byte_exact": 1, "too_few_identities": 1}
    assert found([], 2) == {"type_missing": 1, "too_few_identities": 2}


def test_forest_baseline_searches_once(spark, sf, monkeypatch):
    from lodestone.operators import forest

    calls = []
    monkeypatch.setattr(forest, "nearest", lambda *a: calls.append(1) or similarity.nearest(*a))
    rows = forest.cleaned(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "embedding", least=2)
    scores, measures = forest.baseline(rows, F.col("vec_id") % 5 == 0, "label", "embedding", 0.0, trees=2, depth=2)
    assert scores.count() == rows.where("vec_id % 5 = 0").count() and measures["qualified"] and len(calls) == 1


@pytest.mark.parametrize("dense", [0, 1024])
def test_packs_of_queries_share_what_each_query_does(spark, monkeypatch, dense):
    monkeypatch.setattr(similarity, "DENSE", dense)
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(60), rng.randrange(1, 25))) for _ in range(300)]
    index, asking = similarity._Index(sets[:200]), [*sets[200:], [99], [0, 77]]
    both = index.shared_each(np.array([len(b) for b in asking]), np.concatenate(asking))
    assert both.tolist() == [[len(set(a) & set(b)) for b in sets[:200]] for a in asking]
    sizes = np.array([len(b) for b in sets])
    packs = similarity._packs(np.arange(300), sizes)
    assert np.concatenate(packs).tolist() == list(range(300)) and len(packs) < 10 and max(sizes[p].sum() for p in packs) <= similarity.PACK + 25


def test_merging_by_list_and_by_grid_is_the_same(monkeypatch):
    rng, found = random.Random(7), []
    rows = [(i, x, y, x + rng.randrange(0, 12), y + rng.randrange(0, 12)) for i in range(400) for x, y in [(rng.randrange(120), rng.randrange(120))]]
    for few in (0, 20, 10**6):
        monkeypatch.setattr(boxes, "FEW", few)
        page = boxes._Regions(1, 0.5)
        for r in rows:
            page.take(*r)
        assert (page.places is None) == (few == 10**6)
        found.append(page.end())
    assert found[0] == found[1] == found[2] and 20 < len(found[0]) < 400


def test_columns_of_a_fold_keep_their_values():
    columns = [[1, None, 2**62 + 1], [1, 2, 3], [None, None], [True, None, False], [True, False], ["a", None, "é"], ["a"], [0.5, None], [0.5, float("inf")], [[1], None], []]
    for c in columns:
        for array in (pa.array(c), pa.array([*c, *c]).slice(len(c))):
            got = folds.values(array)
            assert got == c and [type(x) for x in got] == [type(x) for x in array.to_pylist()]
    assert folds.values(pa.array([datetime.date(2020, 1, 2)])) == [datetime.date(2020, 1, 2)]
    numbers = pa.array(range(500_000))
    began = time.process_time()
    folds.values(numbers)
    middle = time.process_time()
    numbers.to_pylist()
    assert middle - began < (time.process_time() - middle) / 2


def test_key_difference_in_tasks_of_so_many_rows(spark):
    a = spark.createDataFrame([(i,) for i in [*range(500), 7, 7, 600, 600, None, None]], "k long")
    b = spark.createDataFrame([(i,) for i in [*range(10, 520), 515, 515, None, None]], "k long")
    found = tables.key_difference(a, b, "k", 100)
    want = [(i, "missing") for i in [*range(10), 7, 7, 600, 600, None, None]] + [(i, "unexpected") for i in [*range(500, 520), None]]
    assert Counter(tuple(r) for r in found.collect()) == Counter(want) and found.rdd.getNumPartitions() == 11


def test_only_edits_that_need_a_box_are_held_to_the_page(monkeypatch):
    held, clamp = [], edits._Regions.clamp
    monkeypatch.setattr(edits._Regions, "clamp", lambda self, *box: held.append(box) or clamp(self, *box))
    page = edits._Regions("d", 100, 100)
    page.take(False, None, None, "r", None, 1, 5, 5, 50, 60, "molecule", "detected", False)
    for n, (action, own) in enumerate((("confirm", "r"), ("split", "r"), ("delete", "rb"), ("update", "r"), ("add", "s"), ("noop", "r"), ("confirm_page", "r")), 1):
        page.take(True, n, action, own, own + "b", 1, -4, 5, 120, 60, None, None, None)
    assert len(held) == 2
    assert page.end() == [
        ("d", 1, "r", 0, 5, 100, 60, "molecule", "confirmed", True, "confirm,split,update,noop!,confirm_page"),
        ("d", 1, "rb", 27, 5, 50, 60, "non_molecule", "deleted", False, "split_from,delete"),
        ("d", 1, "s", 0, 5, 100, 60, "molecule", "confirmed", True, "add,confirm_page"),
    ]
