"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each text is the set of its byte n-grams (hashed to a fixed number of features). A feature's value is the ratio of its
smoothed log-counts among good and bad documents; a linear hinge-loss model over these values is fitted by dual coordinate
descent, and its margin is turned into a probability by a logistic curve fitted on margins of documents left out.

The fit takes a bounded sample of labelled documents (``sample`` rows and ``sample_grams`` n-grams, chosen by a hash of the
id), in one task. The weights
have a fixed size, so they are broadcast; every text is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, whole
from lodestone.llm.slices import slices

BITS = 18


def _hashed(codes: np.ndarray, salt: int) -> np.ndarray:
    return (codes + np.uint32(salt)) * np.uint32(2654435761) >> np.uint32(32 - BITS)


def features(text: bytes) -> np.ndarray:
    """The distinct hashed n-grams of a text; none for an empty text.

    These are its byte 2- and 3-grams, and the runs of 1, 2, 4 and 8 repeats: n-grams over whether a word equals the one before.
    """
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 2:
        return np.zeros(0, dtype=np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    words = text.split()
    same = "".join("R" if x == y else "." for x, y in zip(words, words[1:], strict=False))
    shape = [k for k, run in enumerate(("R", "RR", "RRRR", "RRRRRRRR")) if run in same]
    codes = [_hashed(two, 1 << 24), _hashed(three, 0), _hashed(np.array(shape, dtype=np.uint32), 1 << 25)]
    if len(b) > 20_000:
        seen = np.zeros(1 << BITS, dtype=bool)
        for c in codes:
            seen[c] = True
        return np.flatnonzero(seen).astype(np.uint32)
    c = np.sort(np.concatenate(codes))
    return c[np.concatenate([[True], c[1:] != c[:-1]])]


@dataclass
class Model:
    """Weight of each feature's presence, and the curve from margin to probability."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1.0, len(found) ** 0.5) + self.bias

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of each feature's smoothed share among good documents over that among bad ones."""
    shares = []
    for side in (1, -1):
        n = np.full(1 << BITS, smooth)
        for d in (d for d, s in zip(docs, y, strict=True) if s == side):
            n[d] += 1
        shares.append(n / n.sum())
    return np.log(shares[0] / shares[1])


def descend(docs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty by dual coordinate descent over rows; each class has half of the cost."""
    rng = np.random.default_rng(seed)
    values = [(ratio[d] / max(1.0, len(d) ** 0.5)).astype(np.float32) for d in docs]
    square = np.array([float(v.astype(float) @ v) + 1.0 for v in values])
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w, bias = np.zeros(len(y)), np.zeros(1 << BITS), 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            d, v = docs[i], values[i]
            gradient = y[i] * (float(w[d] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if step := (new - alpha[i]) * y[i]:
                w[d] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w * ratio, bias


def logistic(margins: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the curve that best gives the classes from the margins (Newton's method, smoothed targets)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: list[np.ndarray], good: np.ndarray, cost: float = 1.0, epochs: int = 12) -> Model:
    """The model of these documents; without documents of both classes every score is one half."""
    if not (good.any() and (~good).any()):
        return Model(np.zeros(1 << BITS))
    y = np.where(good, 1, -1)
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % 2
    for k in (0, 1):
        own = np.flatnonzero(fold != k)
        part = [docs[i] for i in own]
        if len(set(y[own])) == 2:
            half = Model(*descend(part, y[own], log_count_ratio(part, y[own]), cost, epochs, k))
            for i in np.flatnonzero(fold == k):
                margins[i] = half.margin(docs[i])
    weights, bias = descend(docs, y, log_count_ratio(docs, y), cost, epochs, 2)
    return Model(weights, bias, *logistic(margins, good))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_grams: int) -> Model:
    """Fit on at most ``sample`` labelled documents with ``sample_grams`` n-grams together, those whose ids have the least hashes."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("good")).where("id is not null and good is not null")
    chosen = named.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id", "good").agg(F.min("text").alias("text"))

    def found(batches):
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([features(t.encode("utf-8", "surrogatepass")).tobytes() for t in part.column(2).to_pylist()], pa.binary())], names=["id", "good", "features"])

    def learn(batches):
        good, own, held = [], [], 0
        for rows in batches:
            for y, x in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                held += len(x) // 4
                if held <= sample_grams or not own:
                    good.append(y)
                    own.append(np.frombuffer(x, dtype=np.uint32))
        if own:
            model = fit(own, np.array(good) == 1)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64()))], names=["weights", "rest"])

    kind = rows.schema["id"].dataType.simpleString()
    known = rows.mapInArrow(found, f"id {kind}, good int, features binary")
    learnt = known.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(learn, "weights binary, rest array<double>").collect()  # one row of a fixed size
    return Model(np.frombuffer(learnt[0]["weights"], dtype=np.float32), *learnt[0]["rest"]) if learnt else Model(np.zeros(1 << BITS, dtype=np.float32))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8_000, sample_grams: int = 40_000_000, threshold: float = 0.7, folds: int = 4, held_out: int = 2, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, with ``held_out``, ``score`` and ``predicted``.

    Labels are learnt only where crc32 of the id as text, modulo ``folds``, is not ``held_out``. Scores are probabilities of
    label 1 and depend on the text alone.

    The model is fitted when this is called, in one task of bounded size: on ``sample`` documents at most, and ``sample_grams``
    n-grams (4 bytes each, and as many for their values).

    - Null and empty texts have no n-gram: their score is that of the intercept. A null id is never held out.
    - Labels without id or value are left out; of several labels for one id the least counts; of several texts of a
      labelled id the least is learnt, each is scored. Ids of labels that no document has are left out.
    - Without labels of both classes every score is 0.5. An empty table gives an empty result.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    small_batches(docs.sparkSession)
    away = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == held_out, F.lit(False))
    model = train(docs, labels.where(~away(f"`{id_col}`")), id_col, text_col, label_col, sample, sample_grams)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = sent.value
        return pd.Series(model.score(np.array([model.margin(features(t.encode("utf-8", "surrogatepass"))) for t in texts])))

    named = [c for c in (docs.columns if columns is None else columns) if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*[F.col(f"`{c}`") for c in named], away(f"`{id_col}`").alias("held_out"), score(whole(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with its columns; see ``score_documents``."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    scored = score_documents(safe, labels.withColumnRenamed(id_col, at[id_col]), id_col=at[id_col], text_col=at[text_col], **options)
    return scored.where("predicted = 1").select(*[F.col(at[c]).alias(c) for c in docs.columns])
