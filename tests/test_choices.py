"""Keep-first over two keys, recheck queues, holdouts with a fallback, quality gates, and the entry without the subpackage."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import confusion, dedup, splits, validation
from lodestone.operators.order import exact_percentile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def first_of_two(rows):
    seen_a, seen_b, out = set(), set(), {}
    for i, a, b in sorted(rows):
        if a is not None and a in seen_a:
            out[i] = "duplicate_a"
        elif b is not None and b in seen_b:
            out[i] = "duplicate_b"
        else:
            out[i] = ""
            seen_a.add(a)
            seen_b.add(b)
    return out


def table_of(kind):
    rng = random.Random(kind)
    if kind == "chain":  # each row shares a key with the one before: as slow as it gets
        return [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(60)]
    if kind == "third":
        return [(i, "hot" if i % 3 == 0 else f"a{rng.randrange(50)}", f"b{rng.randrange(80)}") for i in range(300)]
    some = lambda k, n: None if rng.random() < 0.2 else f"{k}{rng.randrange(n)}"
    return [(i, some("a", 60), some("b", 60)) for i in range(200)]


@pytest.mark.parametrize("kind, rounds", [("random", 24), ("third", 24), ("chain", 24), ("chain", 2), ("random", 0)])
def test_keep_first_two_keys(spark, kind, rounds):
    rows = table_of(kind)
    df = spark.createDataFrame(rows, "i long, a string, b string").repartition(3)
    assert {r.i: r.reason for r in dedup.keep_first_two_keys(df, "i", "a", "b", rounds).collect()} == first_of_two(rows)


def test_keep_first_of_no_rows(spark):
    assert dedup.keep_first_two_keys(spark.createDataFrame([], "i long, a string, b string"), "i", "a", "b").count() == 0


def queue(rows, existing, share, most):
    """A plain version of the recheck queue."""
    digest = lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest()
    counts = Counter(s for s, _ in rows)
    n = round(len(rows) * share)
    n = min(max(n, 1) if share > 0 and rows else n, len(rows), len(rows) if most is None else most)
    quota = splits.recheck_quotas(counts, n, sorted(counts, key=lambda s: (digest(s), s)))
    had = {k for _, k in rows if k in existing}
    out = {k: "existing" for k in had}
    rest = []
    for s in counts:
        free = sorted((k for t, k in rows if t == s and k not in had), key=lambda k: (digest(k), k))
        need = max(0, quota[s] - sum(1 for t, k in rows if t == s and k in had))
        out.update(dict.fromkeys(free[:need], "quota"))
        rest += free[need:]
    spare = max(0, n - len(out))
    out.update(dict.fromkeys(sorted(rest, key=lambda k: (digest(k), k))[:spare], "refill"))
    return out


@pytest.mark.parametrize("share, most, had", [(0.3, None, 5), (0.5, 40, 0), (1.0, None, 30), (0.0, None, 3), (0.01, None, 1), (0.4, 2, 0), (0.6, None, 70)])
def test_recheck_queue(spark, share, most, had):
    rng = random.Random(had)
    rows = [(rng.choice("aaaaaaabbc") if k else "d", k) for k in range(100)]
    existing = set(rng.sample(range(110), had))
    df = spark.createDataFrame(rows, "s string, k long").repartition(3)
    known = spark.createDataFrame([(k,) for k in existing], "k long")
    assert {r.k: r.origin for r in splits.recheck_sample(df, known, "s", "k", share, most).collect()} == queue(rows, existing, share, most)


@pytest.mark.parametrize("seed", range(20))
def test_recheck_quotas_share_out_all(seed):
    rng = random.Random(seed)
    counts = {f"s{i}": rng.randrange(1, 30) for i in range(rng.randrange(1, 8))}
    n = rng.randrange(0, sum(counts.values()) + 1)
    quota = splits.recheck_quotas(counts, n, sorted(counts))
    assert sum(quota.values()) == n and all(0 <= quota[s] <= counts[s] for s in counts)
    assert n < len(counts) or min(quota.values()) >= 1


def test_holdout_split(spark):
    rows = [(i, f"g{i % 12}", "y" if i % 12 == 11 else "x") for i in range(120)]
    df = spark.createDataFrame(rows, "i long, g string, y string")
    by = lambda got: (got[0].reason, Counter(r.part for r in got))
    assert by(splits.holdout_split(df, "i", "g", "y").collect()) == ("random_fallback_class_coverage", Counter(train=96, test=24))
    assert by(splits.holdout_split(df, "i", "g").collect())[0] == "scaffold"
    mixed = df.withColumn("g", F.concat(F.lit("g"), F.floor(F.col("i") / 10).cast("string")))
    assert by(splits.holdout_split(mixed, "i", "g", "y").collect())[0] == "scaffold"
    one = splits.holdout_split(df.withColumn("g", F.lit("x")), "i", "g", "y").collect()
    assert by(one) == ("random_fallback_single_scaffold", Counter(train=96, test=24))
    classes = dict((i, y) for i, _, y in rows)
    assert Counter(classes[r.i] for r in one if r.part == "test") == Counter(x=22, y=2)
    lone = spark.createDataFrame([(i, "g", "x" if i else "y") for i in range(10)], "i long, g string, y string")
    assert Counter(r.part for r in splits.holdout_split(lone, "i", "g", "y").collect()) == Counter(train=8, test=2)


def test_quality_gate(spark):
    c = [("classification", 3, 0.9, 0.9, None), ("classification", 4, 0.6, 0.5, None), ("classification", 9, 0.6, 0.49, None), ("classification", 9, None, 0.5, None), ("classification", 9, None, None, None), ("regression", 9, None, None, 0.0), ("regression", 9, None, None, None)]
    df = spark.createDataFrame(c, "task string, n long, a double, f double, r double")
    got = [tuple(r.g) for r in df.select(confusion.quality_gate(F.col("task"), F.col("n"), F.col("a"), F.col("f"), F.col("r")).alias("g")).collect()]
    assert got == [(False, "validation_rows_below_4"), (True, "roc_auc_f1_met"), (False, "roc_auc_f1_below"), (True, "f1_met"), (False, "f1_below"), (True, "r2_met"), (False, "r2_below")]


def test_feature_guard(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert validation.guarded_features(df, ("b", "a")).columns == ["b", "a"]
    for bad, allowed, said in ((df.withColumn(" Truth", F.lit(1)), ("a", "b"), "must not be read"), (df, ("a",), "not supported"), (df, ("a", "b", "c"), "missing")):
        with pytest.raises(ValueError, match=said):
            validation.guarded_features(bad, allowed)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.77, 1.0])
def test_exact_percentile(spark, share):
    rng = random.Random(share)
    for values in ([rng.choice([0.1, 0.2, 0.25, 1.0]) for _ in range(101)], [rng.lognormvariate(0, 9) for _ in range(300)], [3.0], [2.0, 2.0, None]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert exact_percentile(df, "v", share) == pytest.approx(df.agg(F.percentile("v", F.lit(share))).first()[0], rel=1e-12)
    assert exact_percentile(df.limit(0), "v", share) is None


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    n, some, known = said.stdout.split()
    assert int(n) > 200 and (some, known) == ("False", "True")
