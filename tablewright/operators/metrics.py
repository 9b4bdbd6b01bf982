"""Evaluation of a predictions table by aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.operators.ordering import running_before


def accuracy(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return preds.agg(F.avg(quoted(y).eqNullSafe(quoted(p)).cast("int")).alias("accuracy"))


def class_scores(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Hits, false alarms and misses per label seen in truth or prediction.

    Rows are first counted per (truth, prediction) pair, so what follows works
    on classes, not on rows.
    """
    pairs = preds.groupBy(quoted(y).alias("y"), quoted(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    miss = F.col("n") - hit
    zero = F.lit(0).cast("bigint")
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")),
                F.struct(F.col("p").alias("label"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn")),
            )
        )
    )
    return sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(a, b):
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def macro_scores(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Unweighted class means of F1, precision and recall; empty classes count 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_scores(preds, y, p).agg(
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_macro"),
        F.avg(_ratio(tp, tp + fp)).alias("precision_macro"),
        F.avg(_ratio(tp, tp + fn)).alias("recall_macro"),
    )


def roc_auc(preds: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half; ``y`` is 0 or 1.

    Rows with one score are counted first. What is left is one row per distinct
    score, and the running number of negatives below it.
    """
    s, positive = quoted(score), quoted(y) == 1
    size = preds.agg(F.approx_count_distinct(s)).first()[0]
    per_score = preds.groupBy(s.alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_before(per_score, ["s"], {"below": F.col("neg")}, size)
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg((won / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def regression_scores(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    yy, e = quoted(y).cast("double"), quoted(y).cast("double") - quoted(p).cast("double")
    total = F.var_pop(yy) * F.count(yy)
    return preds.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"),
    )


def classification_scores(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy and the macro scores from one count of (truth, prediction) pairs."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_scores(preds, y, p).agg(
        (F.sum("tp") / F.sum(tp + fn).cast("double")).alias("acc"),
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_macro"),
        F.avg(_ratio(tp, tp + fp)).alias("precision_macro"),
        F.avg(_ratio(tp, tp + fn)).alias("recall_macro"),
    )
