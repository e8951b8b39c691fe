"""Two snapshots of metrics against each other: determinism of runs, gates on increases, regressions by phase.

A snapshot has a metric and its value; a metric without a value counts as not measured.
"""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """What a metric may be at most, and by how much it may be more than in the baseline."""

    total: float | None = None
    increase: float | None = None


# Counts that a quality gate can limit.
GATED = ("tlink_anchor_inconsistent", "tlink_missing_anchor_metadata", "tlink_reciprocal_cycle", "isolated_temporal_anchor", "documents_with_temporal_connectivity_gaps", "documents_without_temporal_tlinks",
         "participation_in_frame_missing", "participation_in_mention_missing", "timexmention_missing_doc_id", "timexmention_missing_span_coordinates", "timexmention_broken_refers_to", "dct_timexmention")


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    side = lambda df, name: df.where("value IS NOT NULL").select("metric", F.col("value").cast("double").alias(name))
    return side(first, "value1").join(side(second, "value2"), "metric", "full")


def differ(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers differ by more than a share of the larger one; without a tolerance, at all."""
    return F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b)) if tolerance > 0 else a != b


def determinism(first: DataFrame, second: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """QL-DETERM: metric, value1, value2, absolute_diff, relative_diff_percent of what two runs do not agree in.

    A metric that one run lacks is a violation without differences; a difference from zero has no percentage.
    """
    a, b = F.col("value1"), F.col("value2")
    wrong = _both(first, second).where(a.isNull() | b.isNull() | differ(a, b, tolerance))
    return wrong.select("metric", "value1", "value2", F.abs(a - b).alias("absolute_diff"), F.when(a != 0, 100 * F.abs(a - b) / F.abs(a)).alias("relative_diff_percent"))


def determinism_verdict(violations: DataFrame) -> DataFrame:
    """QL-DETERM: one row: conclusive, num_violations, summary."""
    n = F.count("*")
    return violations.agg((n == 0).alias("conclusive"), n.alias("num_violations"), F.when(n == 0, "Deterministic").otherwise(F.concat(F.lit("Non-deterministic: "), n.cast("string"), F.lit(" metric(s) differ"))).alias("summary"))


def gate(baseline: DataFrame, current: DataFrame, limits: Mapping[str, Limit]) -> DataFrame:
    """QA-DELTA: metric, reason, baseline, current, increase of every limit that the current snapshot breaks.

    Reasons are the metric's name, followed by ``_increase`` for limits of growth.  A count that a
    snapshot lacks is zero.
    """
    spark = current.sparkSession
    number = lambda x: None if x is None else float(x)
    known = spark.createDataFrame([(m, number(x.total), number(x.increase)) for m, x in limits.items()], "metric string, most double, more double")  # as many rows as there are limits
    v = F.broadcast(known).join(_both(baseline, current), "metric", "left").fillna(0.0, ["value1", "value2"]).withColumn("grown", F.col("value2") - F.col("value1"))
    broken = F.array_compact(F.array(F.when(F.col("value2") > F.col("most"), F.col("metric")), F.when(F.col("grown") > F.col("more"), F.concat("metric", F.lit("_increase")))))
    return v.select("metric", F.explode(broken).alias("reason"), F.col("value1").alias("baseline"), F.col("value2").alias("current"), F.col("grown").alias("increase"))


def gate_verdict(baseline_quality: DataFrame, current_quality: DataFrame, broken: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """QA-DELTA: one row: passed, baseline_quality, current_quality, delta and the reasons, sorted.

    ``baseline_quality`` and ``current_quality`` are one row with quality; less than the baseline by
    more than ``tolerance`` is the reason ``overall_quality``.
    """
    one = lambda df, name: df.select(F.col("quality").alias(name), F.lit(1).alias("_one"))
    q = one(baseline_quality, "baseline_quality").join(one(current_quality, "current_quality"), "_one")
    reasons = broken.agg(F.collect_set("reason").alias("r")).withColumn("_one", F.lit(1))
    low = F.col("current_quality") < F.col("baseline_quality") - tolerance
    every = F.array_sort(F.concat("r", F.when(low, F.array(F.lit("overall_quality"))).otherwise(F.array().cast("array<string>"))))
    return q.join(reasons, "_one").select((F.size(every) == 0).alias("passed"), "baseline_quality", "current_quality", (F.col("current_quality") - F.col("baseline_quality")).alias("delta"), F.array_join(every, ",").alias("reasons"))


def regression(baseline_quality: DataFrame, current_quality: DataFrame, allowed_percent: float = 1.0) -> DataFrame:
    """QL-REGRESS: one row: quality_delta, percent_change, is_regression and whether the change exceeds what is allowed."""
    one = lambda df, name: df.select(F.col("quality").alias(name), F.lit(1).alias("_one"))
    q = one(baseline_quality, "b").join(one(current_quality, "c"), "_one")
    delta = F.col("c") - F.col("b")
    percent = F.when(F.col("b") != 0, delta / F.col("b") * 100).otherwise(0.0)
    return q.select(F.col("b").alias("baseline_quality"), F.col("c").alias("current_quality"), delta.alias("quality_delta"), percent.alias("percent_change"), (delta < -0.001).alias("is_regression"), (F.abs(percent) > allowed_percent).alias("is_significant"))


def phase_regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """QL-REGRESS: phase, baseline, current, delta of phases whose score is lower; a phase new in ``current`` starts at zero."""
    both = current.select("phase", F.col("score").alias("current")).join(baseline.select("phase", F.col("score").alias("baseline")), "phase", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    return both.withColumn("delta", F.col("current") - F.col("baseline")).where("delta < 0").select("phase", "baseline", "current", "delta")
