"""Confusion tables and what follows from them: precision, recall, F1, binary and per-document metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import count_if, rate0


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Counts by true and predicted class, in long form."""
    return rows.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))


def confusion_wide(rows: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """A row for each true class and a column for each of ``classes`` as predicted."""
    return rows.groupBy(truth).agg(*[count_if(F.col(predicted) == c).alias(f"as_{c}") for c in classes])


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, predicted count, precision, recall and F1 of each class that occurs on either side."""
    cells = confusion(rows, truth, predicted)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    # Each hit is seen from both sides.
    totals = sides.groupBy("s.label").agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("correct"))
    c = F.col
    return totals.withColumns({
        "precision": rate0(c("correct"), c("predicted")), "recall": rate0(c("correct"), c("support")), "f1": rate0(2 * c("correct"), c("support") + c("predicted")),
    })


def averages(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Macro and weighted F1, and accuracy."""
    c = F.col
    f1 = 2 * c("correct") / (c("support") + c("predicted"))
    return per_class(rows, truth, predicted).agg(
        F.bround(F.avg(f1), 6).alias("macro_f1"), F.bround(F.sum(f1 * c("support")) / F.sum("support"), 6).alias("weighted_f1"), rate0(F.sum("correct"), F.sum("support")).alias("accuracy"), F.sum("support").alias("n")
    )


def binary(rows: DataFrame, truth: str, predicted: str, positive: str, *by: str) -> DataFrame:
    """Counts of the four cells for one class, with precision, recall, false positive rate and negative rejection."""
    t, p, c = F.col(truth) == positive, F.col(predicted) == positive, F.col
    cells = rows.groupBy(*by).agg(count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"), count_if(t & ~p).alias("fn"), count_if(~t & ~p).alias("tn"))
    return cells.withColumns({
        "precision": rate0(c("tp"), c("tp") + c("fp")), "recall": rate0(c("tp"), c("tp") + c("fn")), "f1": rate0(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "false_positive_rate": rate0(c("fp"), c("fp") + c("tn")), "negative_rejection_rate": rate0(c("tn"), c("fp") + c("tn")),
    })


def errors(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Wrong classes as ``predicted->truth`` with their counts."""
    return rows.where(F.col(truth) != F.col(predicted)).groupBy(F.concat(F.col(predicted), F.lit("->"), F.col(truth)).alias("error")).agg(F.count("*").alias("n"))


def binary_scores(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1, MCC, ROC-AUC and PR-AUC of whole-number scores against a boolean; 500 or more says yes.

    The area counts pairs by distinct score, so its work after one aggregation depends on the scores, not the rows.
    """
    from pyspark.sql import Window

    by = rows.groupBy(F.col(score).alias("score")).agg(count_if(F.col(truth)).alias("p"), count_if(~F.col(truth)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    at = by.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Of all with a score or a higher one: those that are true, and those that are not.
    at = at.withColumns({"true_above": F.sum("p").over(every) - F.coalesce(F.sum("p").over(before), F.lit(0)), "false_above": F.sum("n").over(every) - F.col("below")})
    yes, c = F.col("score") >= 500, F.col
    one = at.agg(
        F.sum(F.when(yes, c("p")).otherwise(0)).alias("tp"), F.sum(F.when(yes, c("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~yes, c("p")).otherwise(0)).alias("fn"), F.sum(F.when(~yes, c("n")).otherwise(0)).alias("tn"),
        F.sum(2 * c("p") * c("below") + c("p") * c("n")).alias("twice"), F.sum("p").alias("pos"), F.sum("n").alias("neg"),
        F.sum(F.when(c("p") > 0, c("p") * c("true_above") / (c("true_above") + c("false_above")))).alias("precisions"),
    )
    part = lambda hit, said: F.when(said == 0, 0.0).otherwise(hit / F.when(said != 0, said))
    p1, r1, p0, r0 = part(c("tp"), c("tp") + c("fp")), part(c("tp"), c("pos")), part(c("tn"), c("tn") + c("fn")), part(c("tn"), c("neg"))
    f1, f0 = part(2 * c("tp"), c("pos") + c("tp") + c("fp")), part(2 * c("tn"), c("neg") + c("tn") + c("fn"))
    mean = lambda a, b: F.bround((a + b) / 2, 6)
    spread = F.sqrt((c("tp") + c("fp")).cast("double") * (c("tp") + c("fn")) * (c("tn") + c("fp")) * (c("tn") + c("fn")))
    return one.select("tp", "fp", "fn", "tn", rate0(c("tp") + c("tn"), c("pos") + c("neg")).alias("accuracy"), rate0(c("tp").cast("double") * c("tn") - c("fp").cast("double") * c("fn"), spread).alias("mcc"), rate0(c("twice"), 2 * c("pos") * c("neg")).alias("roc_auc"), mean(p1, p0).alias("macro_precision"), mean(r1, r0).alias("macro_recall"), mean(f1, f0).alias("macro_f1"), F.bround(c("precisions") / c("pos"), 6).alias("pr_auc"))


def regression(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 of whole numbers."""
    t, e = F.col(truth).cast("double"), (F.col(truth) - F.col(predicted)).cast("double")
    one = rows.agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("absolute"), F.sum(e * e).alias("square"), F.sum(t).alias("total"), F.sum(t * t).alias("total2"))
    c = F.col
    return one.select("n", F.bround(c("absolute") / c("n"), 6).alias("mae"), F.bround(F.sqrt(c("square") / c("n")), 6).alias("rmse"), F.bround(1 - c("square") / (c("total2") - c("total") * c("total") / c("n")), 6).alias("r2"))


#: The least measures at which a model's numbers are shown.
LEAST_ROWS, LEAST_AUC, LEAST_F1, LEAST_R2 = 4, 0.6, 0.5, 0.0


def quality_gate(task: Column, n: Column, roc_auc: Column, f1_macro: Column, r2: Column) -> Column:
    """(passed, reason) of a model by its validation measures.

    Fewer than four rows never pass. A classifier needs its area under the curve and its macro F1, or the F1 alone where there
    is no area (one class only); a missing F1 counts as 0. Any other model needs its R2, which is below every limit if missing.
    """
    f1, fit = F.coalesce(f1_macro, F.lit(0.0)), F.coalesce(r2, F.lit(-999.0))
    few, classes, area = n < LEAST_ROWS, task == "classification", roc_auc.isNotNull()
    both, only, regression = (roc_auc >= LEAST_AUC) & (f1 >= LEAST_F1), f1 >= LEAST_F1, fit >= LEAST_R2
    passed = F.when(few, False).when(classes & area, both).when(classes, only).otherwise(regression)
    said = lambda ok, name: F.when(ok, f"{name}_met").otherwise(f"{name}_below")
    reason = F.when(few, "validation_rows_below_4").when(classes & area, said(both, "roc_auc_f1")).when(classes, said(only, "f1")).otherwise(said(regression, "r2"))
    return F.struct(passed.alias("passed"), reason.alias("reason"))


def group_scores(rows: DataFrame, group: str, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(group, n, f1_macro, roc_auc) of binary classifiers, each with its own group of rows; six places, the area null for one class.

    The area counts pairs over the distinct scores of a group, each with its numbers of true and false rows, so what is ordered
    are distinct scores and not rows.
    """
    cells = rows.groupBy(group, score).agg(F.count(F.when(F.col(truth), 1)).alias("p"), F.count(F.when(~F.col(truth), 1)).alias("q"))
    below = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumns({"under": F.coalesce(F.sum("q").over(below), F.lit(0)), "said": F.col(score) >= threshold})
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    by = placed.groupBy(group).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (2 * F.col("under") + F.col("q"))).alias("pairs"), total("p", F.col("said")).alias("tp"), total("q", F.col("said")).alias("fp"))
    f1 = lambda hit, wrong, missed: F.when(2 * hit + wrong + missed > 0, 2 * hit / (2 * hit + wrong + missed)).otherwise(0.0)
    c = F.col
    yes, no = f1(c("tp"), c("fp"), c("p") - c("tp")), f1(c("q") - c("fp"), c("p") - c("tp"), c("fp"))
    # A class that is neither there nor predicted does not count.
    there = lambda n, m: (n + m > 0).cast("int")
    n_classes = there(c("p"), c("tp") + c("fp")) + there(c("q"), c("p") + c("q") - c("tp") - c("fp"))
    return by.select(group, (c("p") + c("q")).alias("n"), F.bround((yes + no) / n_classes, 6).alias("f1_macro"), F.when((c("p") > 0) & (c("q") > 0), F.bround(c("pairs") / (2 * c("p") * c("q")), 6)).alias("roc_auc"))


def group_r2(rows: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """(group, n, r2) of regressions over whole numbers, from exact sums; six places, null where the truth does not vary."""
    y, e = F.col(truth).cast("decimal(19,0)"), (F.col(truth) - F.col(predicted)).cast("decimal(19,0)")
    by = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.sum(e * e).alias("residual"))
    spread = F.col("ss").cast("double") - F.col("s").cast("double") * F.col("s").cast("double") / F.col("n")
    return by.select(group, "n", F.when(spread > 0, F.bround(1 - F.col("residual").cast("double") / F.when(spread > 0, spread), 6)).alias("r2"))
