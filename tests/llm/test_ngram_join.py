"""Links and components against all pairs on small inputs."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import ngram_join
from lodestone.operators.graph import components


def plain(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "THE", "é"]
    rows, passage = [], " ".join(rng.choice(words) for _ in range(30))
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rows[rng.randrange(max(1, len(rows) // 8))][1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, rng.choice([" ", " ", "\n"]).join(w)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(90))) + (" " + passage if rng.random() < 0.3 else "")))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "a b"), (904, "A  b "), (905, "a b c"), (None, "x y z u v w"), (None, "x y z u v w"), (906, rows[0][1]), (0, rows[3][1]), (907, "a\xa0b c"), (908, "z " * 4000)]


@pytest.mark.parametrize(("seed", "cell"), [(1, 2048), (2, 40), (3, 7)])
def test_links(spark, seed, cell, monkeypatch):
    if cell == 7:  # parts of frequent shingles, one leader, and queries of blocks
        monkeypatch.setattr(ngram_join, "SHINGLE_ENTRIES", 10)
        monkeypatch.setattr(ngram_join, "LEADERS", 1)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, n int").repartition(5)
    got = ngram_join.link_documents(docs, cell_docs=cell).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in plain(rows))
    kept = ngram_join.drop_near_copies(docs, cell_docs=cell)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {c for _, n, c in plain(rows) if c is not None}


def test_chains_over_blocks(spark):
    """Each text links to the next one only, so few are connected to a leader and most are sent as queries."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(80)] + [(200 + i, " ".join(words[::-1][4 * i : 4 * i + 60])) for i in range(40)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell_docs=5).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == sorted(plain(rows))


def test_very_long_texts_and_column_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "a", 0, 0), (2, long.replace("w777 ", "x "), "b", 0, 0), (3, long[: len(long) // 2], "c", 0, 0), (4, "e f g h i j", None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key int, may_go int")
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._id) for r in kept.collect()) == [(1, "a"), (3, "c"), (4, None)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_documents(none).count() == 0
    assert ngram_join.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_search(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, size=40).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base[rng.random(40) < rng.choice([0.8, 0.95])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 60, size=rng.integers(0, 6)).astype(np.uint64), base[:1]])))
    side = rng.integers(0, 2, size=60) if seed % 2 else None
    roots = ngram_join.search(sets, 80, side)
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) and (side is None or side[i] != side[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    pairs = lambda r: {(i, j) for i in range(60) for j in range(60) if r[i] == r[j]}
    assert pairs(roots.tolist()) == pairs(up)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 160))
        a = np.unique(rng.integers(0, 400, size=n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 200, size=3).astype(np.uint64)]))
        frequent = np.unique(rng.integers(0, 200, size=50).astype(np.uint64))
        rank = rng.integers(0, 9, size=len(frequent))
        k = len(np.intersect1d(a, b))
        if len(b) and 100 * k >= 80 * (len(a) + len(b) - k):
            least = ngram_join.extra(min(len(a), len(b)))
            assert len(np.intersect1d(ngram_join.prefix(a, 80, frequent, rank), ngram_join.prefix(b, 80, frequent, rank))) >= least


def test_shared_entries_of_any_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(int(t), int(t % 5 == 0) * int(rng.integers(1, 3)), int(n), int(c)) for t, n, c in zip(rng.integers(0, 40, 150), rng.integers(1, 30, 150), rng.integers(0, 99, 150), strict=True)})
    fits = lambda x, y: x[:2] == y[:2] and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2])
    want = [r for i, r in enumerate(rows) if r[1] or any(0 <= j < len(rows) and fits(rows[j], r) for j in (i - 1, i + 1))]
    for step in (1, 2, 7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + step], strict=True)], names=["t", "part", "n", "c"]) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in ngram_join._shared(iter(parts), 80) for r in b.to_pylist()]
        assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_meetings_of_any_batches(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    rows = sorted({(int(t), int(t % 5 == 0) * int(rng.integers(1, 3)), int(n), int(c)) for t, n, c in zip(rng.integers(0, 30, 400), rng.integers(20, 60, 400), rng.integers(0, 60, 400), strict=True)})
    runs = [[rows[0]]]
    for r in rows[1:]:
        x = runs[-1][-1]
        if x[:2] == r[:2] and 100 * x[2] >= 80 * r[2]:
            runs[-1].append(r)
        else:
            runs.append([r])
    want = []
    for run in runs:
        if len(run) > ngram_join.SHORT or run[0][1]:
            want += [(1, r[3], run[0][3], 0) for r in run if r[3] != run[0][3]] + [(2, r[3], r[3], 0) for r in run]
            want += [(1, run[0][3], int(ngram_join._node(np.int64(run[0][0]))), 0)] if run[0][1] else []
        else:
            want += [(0, min(x[3], y[3]), max(x[3], y[3]), max(1, min(x[2], y[2]) // ngram_join.EXTRA)) for i, x in enumerate(run) for y in run[:i] if x[3] != y[3]]
    assert any(w[0] == 0 for w in want) and any(w[0] == 1 for w in want)
    for step in (1, 2, 7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + step], strict=True)], names=["t", "part", "n", "c"]) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in ngram_join._meetings(iter(parts), 80) for r in b.to_pylist()]
        # The node of a split run that goes over batches may come again.
        assert sorted(set(got)) == sorted(set(want)) and sorted(g for g in got if g[0] == 0) == sorted(w for w in want if w[0] == 0)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    up = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = up[a], up[b]
        up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
