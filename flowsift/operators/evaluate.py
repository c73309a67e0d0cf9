"""Classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.operators.ordering import running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, y: str = "y_true", predicted: str = "y_pred", digits: int = 4) -> DataFrame:
    """F1, precision and recall; 0 where undefined."""
    yes, said = F.col(y) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        F.round(_ratio(tp, tp + fp), digits).alias("precision"),
        F.round(_ratio(tp, tp + fn), digits).alias("recall"),
    )


def _score_groups(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a class is missing."""
    summed = running_sums(_score_groups(df, y, score), ["score"], {"cum_neg": F.col("neg")})
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    totals = summed.agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return totals.select(F.try_divide("won", (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """False and true positive rate at every distinct score used as threshold."""
    groups = _score_groups(df, y, score)
    p, n = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) != 1)).first()
    summed = running_sums(groups, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})
    return summed.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_neg"), F.lit(n)).alias("fpr"), _ratio(F.col("cum_pos"), F.lit(p)).alias("tpr"),
    )


def confusion_matrix(df: DataFrame, y: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.groupBy(y, predicted).agg(F.count(F.lit(1)).alias("rows"))


def class_report(df: DataFrame, y: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Per class precision, recall, F1 and support; then accuracy and the macro mean."""
    cells = confusion_matrix(df, y, predicted)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(y).alias("cls"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.col(y) == F.col(predicted), F.col("rows")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("said"),
                 F.lit(0).cast("bigint").alias("hit")),
    )))
    sums = sides.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    hit, said, support = F.col("hit"), F.col("said"), F.col("support")
    per_class = sums.select(
        F.col("cls").cast("string").alias("label"), _ratio(hit, said).alias("precision"),
        _ratio(hit, support).alias("recall"), _ratio(2 * hit, said + support).alias("f1"), "support",
    )
    macro = per_class.agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    )
    accuracy = sums.agg(F.sum("hit").alias("hit"), F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("label"), *[_ratio(hit, support).alias(m) for m in ("precision", "recall", "f1")], "support"
    )
    return per_class.unionByName(macro).unionByName(accuracy)


def class_balance(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("rows"))
    total = df.count()
    return counts.withColumn("percent", F.lit(100.0) * F.col("rows") / F.lit(total))


def top_confidence(df: DataFrame, score: str, row_id: str) -> DataFrame:
    """The row with the highest score, smallest id on ties."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(row_id)))
    return df.agg(best.alias("_best")).select("_best.*")


def comparison(scored: Mapping[str, DataFrame], threshold: float = 0.5, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """One metrics row per model."""
    rows = None
    for name, df in scored.items():
        predicted = df.withColumn("y_pred", (F.col(score) > threshold).cast("int"))
        auc = roc_auc(df, y, score).first()[0]
        row = binary_metrics(predicted, y).select(
            F.lit(name).alias("model"), "*", F.round(F.lit(auc).cast("double"), 4).alias("roc_auc")
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def cross_validated(fold_metrics: DataFrame, metric: str) -> DataFrame:
    """Mean and (population) deviation of a metric over folds."""
    return fold_metrics.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns) if columns else None)


def duplicate_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows before and after exact duplicate removal, in one pass.

    Long strings are compared by digest, so the shuffle carries 64 characters
    per distinct row instead of the text.
    """
    keys = [F.sha2(F.col(c), 256).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in columns]
    groups = df.select(*keys).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.sum(F.col("_n") - 1).alias("dropped")
    )
