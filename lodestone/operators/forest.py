"""A random-forest baseline with quality gate and applicability domain."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.similarity import bit_sets, domain, nearest
from lodestone.operators.tables import materialise


def cleaned(rows: DataFrame, label: str, vector: str, least: int = 20) -> DataFrame:
    """Rows with a label and a whole vector; fails below ``least`` rows or with one class."""
    good = rows.where(F.col(label).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)))
    n = good.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
    if n["n"] < least or n["k"] < 2:
        raise ValueError(f"{n['n']} rows of {n['k']} classes are too few")
    return good


def fit_numbers(train: DataFrame, target: str, vector: str, trees: int = 300, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A forest for numbers."""
    forest = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[forest]).fit(train.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))


def evaluate(scored: DataFrame, label: str) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1 of scored rows, from their confusion counts."""
    cells = {(r[label], int(r["prediction"])): r["n"] for r in scored.groupBy(label, "prediction").agg(F.count("*").alias("n")).collect()}  # classes squared
    total, classes = sum(cells.values()), {k for pair in cells for k in pair}
    each = []
    for k in classes:
        hit, said, true = cells.get((k, k), 0), sum(n for (_, p), n in cells.items() if p == k), sum(n for (t, _), n in cells.items() if t == k)
        p, r = hit / said if said else 0.0, hit / true if true else 0.0
        each.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    macro = [sum(x) / len(each) if each else 0.0 for x in zip(*each, strict=True)] or [0.0] * 3
    return {"n": total, "accuracy": sum(n for (t, p), n in cells.items() if t == p) / total if total else 0.0, "macro_precision": macro[0], "macro_recall": macro[1], "macro_f1": macro[2]}


def baseline(rows: DataFrame, test: Column, label: str, vector: str, least_accuracy: float, share: float = 0.05, **options) -> tuple[DataFrame, dict[str, float]]:
    """(scores of the test rows, measures): trained, evaluated, gated, and held to the domain of the training rows.

    The model is qualified if it reaches ``least_accuracy`` on the test rows; a row is inside the domain from the similarity
    that a ``share`` of the test rows stays below.
    """
    train, held = rows.where(~test), rows.where(test)
    model = fit(train, label, vector, **options)
    measures = evaluate(score(model, held, vector), label)
    near = materialise(nearest(bit_sets(held), bit_sets(train)).select("vec_id", "similarity"), "near")  # searched once
    measures["threshold"] = domain(near, share).first()["threshold"]
    measures["qualified"] = measures["accuracy"] >= least_accuracy
    return batch_scores(model, held, train, measures["qualified"], measures["threshold"], near), measures


def fit(train: DataFrame, label: str, vector: str, trees: int = 300, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A forest with classes weighted by the inverse of their share."""
    shares = train.groupBy(label).agg(F.count("*").alias("n"))  # one row for each class
    total = train.count()
    weighted = train.join(F.broadcast(shares), label).withColumn("weight", F.lit(float(total)) / F.col("n"))
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[forest]).fit(weighted.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))


def save(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame, vector: str) -> DataFrame:
    """Rows with the forest's class."""
    return model.transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))).drop("features", "rawPrediction", "probability")


def batch_scores(model: PipelineModel, rows: DataFrame, train: DataFrame, qualified: bool, threshold: float, near: DataFrame | None = None) -> DataFrame:
    """(vec_id, label, prediction, similarity, status): a prediction counts where the model is qualified and a training row is near.

    ``near`` is (vec_id, similarity) of the rows, if they have been searched for already.
    """
    near = near if near is not None else nearest(bit_sets(rows), bit_sets(train)).select("vec_id", "similarity")
    made = score(model, rows, "embedding").join(near, "vec_id")
    status = F.when(F.lit(not qualified), "unqualified").when(F.col("similarity") < threshold, "outside_domain").otherwise("success")
    return made.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"), "similarity", status.alias("status"))
