"""Whitening against exact rational arithmetic and numpy on small tables."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import whitening


def exact(vectors):
    """n, sums and products of n x - S over the distinct vectors, in Python's integers."""
    rows = sorted(set(vectors))
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    return n, s, [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("low, high", [(-300, 300), (10**6, 10**6 + 20), (-(2**61), 2**61)])
def test_covariance_is_exact(spark, low, high):
    rng = random.Random(low)
    vectors = [tuple(rng.randrange(low, high) for _ in range(5)) for _ in range(200)]
    fit = spark.createDataFrame([(list(v),) for v in set(vectors)], "x array<bigint>").repartition(3)
    got = whitening.covariance(fit)
    assert (got.n, got.sums, got.products) == exact(vectors)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    plain = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + [0, 50, 0, -3, 0, 0]).astype(np.float32)
    out = [(i, [float(c) for c in v], 0) for i, v in enumerate(plain)]
    out += [(1000 + i, out[0][1], 1) for i in range(150)] + [out[1], out[1]]
    odd = [None, [], [None] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] * 6, [1.0] * 5, [3e38] * 6]
    return out, [(-1 - i, v, 2) for i, v in enumerate(odd)]


def test_whiten(spark, rows):
    good, odd = rows
    df = spark.createDataFrame(good + odd + [(None, good[5][1], 5)], "vec_id long, embedding array<float>, n int").repartition(4)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 4 * (len(good) + 1)
    x_of = lambda v: tuple(math.floor(256 * c) for c in v)
    n, s, products = exact([x_of(v) for _, v, _ in good])
    values, vectors = np.linalg.eigh(np.array(products, dtype=float) / n**3)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = {}
    for r in got:
        x = x_of(r.embedding)
        assert r.n == n and int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        k = r.component - 1
        want = (np.array(x) - np.array(s) / n) @ vectors[:, k] / math.sqrt(values[k])
        sign = signs.setdefault(k, np.sign(want) * np.sign(r.whitened))
        assert r.whitened == pytest.approx(sign * want, abs=1e-9)
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one) == [(v, k, 1, 0, None, None, None) for v in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert len(line) == 15 and all((r.whitened is None) == (r.component > 1) for r in line)
    assert {round(r.explained, 9) for r in line} == {1.0, 0.0} and line[0].identity_error < 1e-9


def test_given_table(spark, sf):
    from lodestone.llm.queries import QUERIES

    got = QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert len(got) == 4 * vectors.count() and set(got.component) == {1, 2, 3, 4}
    assert got.identity_error.max() < 1e-9 and (got.deviation == got.deviation_exact.astype("int64")).all()
