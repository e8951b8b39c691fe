"""Checks against bounds, gates, and comparisons of runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(counts: DataFrame, minimum: dict[str, float] | None = None, maximum: dict[str, float] | None = None) -> DataFrame:
    """QA-CHECK: label, actual, bound, kind, passed for each bound; ``counts`` has metric and item_count.

    A metric that is not there counts as 0.
    """
    bounds = [(m, float(b), "minimum") for m, b in (minimum or {}).items()] + [(m, float(b), "maximum") for m, b in (maximum or {}).items()]
    frame = counts.sparkSession.createDataFrame(bounds, "label string, bound double, kind string")
    joined = frame.join(counts, F.col("label") == F.col("metric"), "left").withColumn("actual", F.coalesce("item_count", F.lit(0)).cast("double"))
    return joined.select("label", "actual", "bound", "kind", F.when(F.col("kind") == "minimum", F.col("actual") >= F.col("bound")).otherwise(F.col("actual") <= F.col("bound")).alias("passed"))


def gate(check_rows: DataFrame) -> DataFrame:
    """QA-GATE: one row, whether all checks passed and how many did not."""
    return check_rows.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failures"))


def compare(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """QL-COMPARE: metric, before, after, delta and status of two runs; ``value`` is better if higher."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    delta = F.col("after") - F.col("before")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("same")
    return b.join(a, "metric", "full").withColumn("delta", delta).withColumn("status", status)


def severity(delta: Column) -> Column:
    """QL-SEVERITY of a change in a score."""
    return F.when(delta >= 0, "IMPROVEMENT").when(delta >= -0.02, "ACCEPTABLE").when(delta >= -0.05, "WARNING").otherwise("CRITICAL")


def variance(runs: DataFrame, by: str) -> DataFrame:
    """QL-VARIANCE: n, mean, sample deviation, variation and bounds of a value."""
    out = runs.groupBy(by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))).withColumn("deterministic", F.col("low") == F.col("high"))


def significant(runs: DataFrame, by: str, baseline: float) -> DataFrame:
    """QL-SIGNIF: whether the mean exceeds the baseline by more than 1.96 standard errors, from three runs on."""
    v = variance(runs, by)
    return v.select(by, "n", "mean", F.coalesce((F.col("n") >= 3) & (F.col("mean") - baseline > 1.96 * F.col("sd") / F.sqrt("n")), F.lit(False)).alias("improved"))
