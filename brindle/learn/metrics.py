"""Quality of predictions: confusion counts, curves, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import running_totals, sliding
from brindle.operators.relational import attach_row


def confusion(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rows (label, precision, recall, false_positive_rate, f, share) from confusion counts.

    f weighs recall ``beta`` times as much as precision.  A class that is never
    predicted has precision 0; where all rows are of one class its false positive rate is 0.
    """
    hits = cells.groupBy("label").agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    both = attach_row(hits.join(said, "label", "left"), cells.agg(F.sum("n").alias("total")))
    precision = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    recall = F.col("hit") / F.col("actual")
    b = beta * beta
    f = F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)
    others = F.col("total") - F.col("actual")
    wrong = F.when((others > 0) & F.col("said").isNotNull(), (F.col("said") - F.col("hit")) / others).otherwise(0.0)
    share = F.col("actual") / F.col("total")
    columns = {"precision": precision, "recall": recall, "false_positive_rate": wrong, "f": f, "share": share}
    return both.select("label", *[c.alias(n) for n, c in columns.items()])


def weighted_metrics(by_class: DataFrame) -> DataFrame:
    return by_class.agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in ("precision", "recall", "false_positive_rate", "f")])


def threshold_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows (threshold, tp, fp, positives, negatives), one per distinct score, descending totals.

    Equal scores are merged before the running sums, so a score shared by many rows is one row.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q")
    )
    run = running_totals(counts, [], [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("q")})
    totals = counts.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return attach_row(run, totals).drop("p", "q")


def roc_points(counts: DataFrame) -> DataFrame:
    return counts.select("threshold", (F.col("fp") / F.col("negatives")).alias("x"), (F.col("tp") / F.col("positives")).alias("y"))


def pr_points(counts: DataFrame) -> DataFrame:
    return counts.select("threshold", (F.col("tp") / F.col("positives")).alias("x"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("y"))


def area_under(points: DataFrame, first: tuple[float, float], last: tuple[float, float] | None = None) -> DataFrame:
    """Trapezoid area under points by descending threshold, with an added first (and last) point."""
    ends = [(float("inf"), *first)] + ([(float("-inf"), *last)] if last else [])
    extra = points.sparkSession.createDataFrame(ends, "threshold double, x double, y double")
    rows = points.select(F.col("threshold").cast("double").alias("threshold"), "x", "y").unionAll(extra)
    pairs = sliding(rows, [F.desc("threshold")], 2, F.struct("x", "y"), "w")
    a, b = F.col("w")[0], F.col("w")[1]
    return pairs.agg(F.sum((b["x"] - a["x"]) * (a["y"] + b["y"]) / 2).alias("area"))


def by_threshold(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rows (threshold, precision, recall, f)."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.col("positives")
    b = beta * beta
    f = F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)
    return counts.select("threshold", precision.alias("precision"), recall.alias("recall"), f.alias("f"))
