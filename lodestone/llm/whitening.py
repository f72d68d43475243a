"""Whitening of vectors with exact covariances by polarisation.

Entries become whole numbers. Over the distinct vectors, tasks add up exact squares of centred values: of every dimension, and of
the sum of every two dimensions. Then ``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``, so every cross-covariance is a difference of
variances of whole numbers, and no rounding happens before the matrix is assembled for ``eigh``.

Values are centred at the whole part of their mean before they are squared; what is left of the mean, less than one, is taken off
the sums exactly. So squares are as small as the data's spread, and fit machine integers in all but odd tables; where they do not,
numpy adds up Python's integers, which have no bound.

What reaches the driver is a number (in a few limbs) for each two dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, materialise

SCALE = 256
#: Bits of a limb: the sum of limbs of 2^40 tasks fits a long.
LIMB = 23
#: Entries squared at once.
CHUNK = 1 << 18


def whole_numbers(vector: str, scale: int = SCALE) -> F.Column:
    """``floor(scale * entry)`` of each entry, or null where the vector is null, empty, or has an entry that is null, not finite, or beyond a long."""
    v = f"`{vector}`"
    fits = F.expr(f"{v} is not null and size({v}) > 0 and forall({v}, c -> c is not null and abs({float(scale)!r}D * cast(c as double)) < 9.2e18D)")
    return F.when(fits, F.expr(f"transform({v}, c -> cast(floor({float(scale)!r}D * cast(c as double)) as bigint))"))


def _limbs(value: int) -> list[int]:
    """The base-2^LIMB digits of a number, the least first; the last has the sign."""
    out = []
    while not -(1 << LIMB) < value < (1 << LIMB):
        value, low = value >> LIMB, value & ((1 << LIMB) - 1)
        out.append(low)
    return [*out, value]


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one dimension as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact_sums(fit: DataFrame, add, keys: tuple[str, ...]) -> dict[tuple, int]:
    """Sums over all batches of ``fit``: ``add(matrix)`` gives index arrays and a number for each, for every chunk of rows."""
    names = (*keys, "limb", "part")

    def run(batches):
        total, at = None, None
        for batch in batches:
            whole = _matrix(batch.column(0))
            step = max(1, CHUNK // whole.shape[1])
            for k in range(0, len(whole), step):
                at, values = add(whole[k : k + step])
                total = values.astype(object) if total is None else total + values
        rows = [(*(int(a[i]) for a in at), limb, part) for i, v in enumerate(total) for limb, part in enumerate(_limbs(int(v)))] if at is not None else []
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    parts = fit.select("x").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    found: dict[tuple, int] = {}
    for r in parts.groupBy(*keys, "limb").agg(F.sum("part").alias("part")).collect():
        key = tuple(r[k] for k in keys)
        found[key] = found.get(key, 0) + (r["part"] << LIMB * r["limb"])
    return found


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """``x - centre`` in longs where squares of sums of two fit a chunk's sum, else in Python's integers."""
    low, high = x.min(axis=0).astype(object) - centre, x.max(axis=0).astype(object) - centre
    most = max(int(-low.min()), int(high.max()))
    return x - centre.astype(np.int64) if 4 * most * most * len(x) < 2**62 else x.astype(object) - centre


class Covariance:
    """Exact sums over a fit list: ``n``, the per-dimension sums ``S``, and the sums of products of ``n * x - S``."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]]):
        self.n, self.sums, self.products = n, sums, products

    def matrix(self) -> np.ndarray:
        """Covariances with divisor n, each rounded once."""
        return np.array([[p / self.n**3 for p in row] for row in self.products])

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(eigenvalues, unit eigenvectors in rows, trace) of the first ``k`` by falling eigenvalue. The largest entry of each is positive."""
        v = self.matrix()
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:k]
        rows = vectors.T[order]
        signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
        return values[order], rows * signs[:, None], float(np.trace(v))


def covariance(fit: DataFrame) -> Covariance | None:
    """The exact covariance of a table with one column ``x`` (vectors of longs, of one dimension), each row once; None for no rows."""

    def plain(x):
        d = x.shape[1]
        total = x.sum(axis=0) if np.abs(x, dtype=np.float64).max() * len(x) < 2**62 else x.astype(object).sum(axis=0)
        return (np.arange(-1, d),), np.concatenate([[len(x)], total])

    first = _exact_sums(fit, plain, ("i",))
    if not first:
        return None
    n, d = first[(-1,)], len(first) - 1
    sums = [first[(i,)] for i in range(d)]
    centre = np.array([s // n for s in sums], dtype=object)
    rest = [s % n for s in sums]
    i_of, j_of = np.triu_indices(d)

    def squares(x):
        z = _centred(x, centre)
        out = []
        for i in range(d):  # the dimension by itself, then its sum with each later one
            both = z[:, i:] + z[:, i : i + 1]
            both[:, 0] = z[:, i]
            out.append((both * both).sum(axis=0))
        return (i_of, j_of), np.concatenate(out)

    found = _exact_sums(fit, squares, ("i", "j"))
    # The sum of (n z - r)^2 for z with sum r: n^2 sum z^2 - n r^2.
    spread = lambda i, j: n * n * found[i, j] - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2
    alone = [spread(i, i) for i in range(d)]
    products = [[0] * d for _ in range(d)]
    for i in range(d):
        products[i][i] = alone[i]
        for j in range(i + 1, d):
            products[i][j] = products[j][i] = (spread(i, j) - alone[i] - alone[j]) // 2
    return Covariance(n, sums, products)


def _dimension(rows: DataFrame, x: str) -> int | None:
    """The dimension that most vectors have (of equally many, the larger)."""
    first = rows.where(F.col(x).isNotNull()).groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first and first["d"]


class _Projection:
    """Whitened values and deviations of a batch of vectors."""

    def __init__(self, known: Covariance, k: int):
        values, vectors, trace = known.components(k)
        d, n = len(known.sums), known.n
        flat = values <= trace * d * np.finfo(float).eps
        self.known = ~flat
        self.explained = values / trace if trace > 0 else np.full(len(values), np.nan)
        self.weights = np.divide(vectors, np.sqrt(np.where(flat, 1, values))[:, None]).T
        self.n, self.centre = n, np.array([s // n for s in known.sums], dtype=object)
        self.rest = np.array([s % n for s in known.sums], dtype=object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.centre).astype(np.float64) - (self.rest / self.n).astype(np.float64)) @ self.weights

    def deviations(self, x: np.ndarray) -> np.ndarray:
        z = _centred(x, self.centre)
        small = z.dtype != object and (int(np.abs(z).max(initial=0)) + 1) * self.n < 2**31 / x.shape[1] ** 0.5
        moved = z * self.n - self.rest.astype(np.int64) if small else z.astype(object) * self.n - self.rest
        return (moved * moved).sum(axis=1)


def _identity_error(fit: DataFrame, project: _Projection) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, measured on its rows: the largest absolute entry."""
    at = np.flatnonzero(project.known)
    k = len(at)
    if not k:
        return None

    def run(batches):
        total, outer, count = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            w = project.whitened(_matrix(batch.column(0)))[:, at]
            total, outer, count = total + w.sum(axis=0), outer + w.T @ w, count + len(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, outer.ravel()]))], names=["at", "value"])

    found = {r["at"]: r["value"] for r in fit.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    flat = np.array([found[i] for i in range(k + k * k)]) / project.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, columns: list[str] | None = None, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component, with all columns or those named, and with ``component``, ``n``, ``deviation`` (decimal), ``whitened``, ``explained``, ``identity_error``.

    Entries are read as ``floor(scale * entry)``. The covariance is that of the distinct vectors, which are written once as a
    table of their own: the only rows that move, after repeats have been combined in the tasks. ``components`` is cut to the
    dimension. ``deviation`` is the exact squared length of ``n * x - S``.

    - Rows whose vector is null or empty, or has an entry that is null, not finite or beyond a long when scaled, are left out.
    - Rows whose vector has another dimension than most vectors (of equally many: than the longer ones) are left out.
    - A component without variance (one vector, or fewer independent directions than components) has null ``whitened`` and
      ``explained`` 0; where no direction has any, ``explained`` and ``identity_error`` are null.
    - Repeated rows each get theirs; a vector counts once in the covariance, however many rows have it.
    - Equal eigenvalues: any unit vectors of their space, the same for all rows.
    - ``deviation`` is null where it has over 38 digits. An empty table gives an empty result.
    - Columns of ``vectors`` named like a new one are replaced by it.
    """
    new = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.DecimalType(38, 0), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    named = [c for c in (vectors.columns if columns is None else columns) if c not in new]
    own = fresh(vectors, "x")
    rows = vectors.select(*[F.col(f"`{c}`") for c in named], whole_numbers(vector_col, scale).alias(own))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, t) for c, t in new.items())])
    d = _dimension(rows, own)
    if d is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size(own) == d)
    fit = materialise(rows.select(F.col(own).alias("x")).distinct(), "fit-list")
    known = covariance(fit)
    project = _Projection(known, min(components, d))
    error, k, n_cols = _identity_error(fit, project), min(components, d), len(named)
    nan = np.isnan(project.explained)

    def run(batches):
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            x = _matrix(batch.column(n_cols))
            turn = pa.array(np.repeat(np.arange(size), k))
            kept = [c.take(turn) for c in batch.columns[:n_cols]]
            deviation = [v if abs(v) < 10**38 else None for v in map(int, project.deviations(x))]
            made = [
                pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                pa.array(np.full(size * k, project.n), pa.int64()),
                pa.array([None if v is None else Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(turn),
                pa.array(project.whitened(x).ravel(), mask=np.tile(~project.known, size)),
                pa.array(np.tile(project.explained, size), mask=np.tile(nan, size)),
                pa.array([error] * (size * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:n_cols], *new])

    return rows.mapInArrow(run, schema)
