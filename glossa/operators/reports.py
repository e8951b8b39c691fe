"""Inventories and integrity reports over nodes and edges."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(parts: dict[str, DataFrame], name: str, value: str) -> DataFrame:
    """One row per entry: its name and its number of rows."""
    out = None
    for label, df in parts.items():
        row = df.agg(F.count("*").alias(value)).select(F.lit(label).alias(name), value)
        out = row if out is None else out.unionByName(row)
    return out


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """P-DEGREE0: nodes (id) without an edge at either end."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(touched, "id", "left_anti")


def anchor_gaps(anchors: DataFrame, linked: DataFrame) -> DataFrame:
    """Documents with several temporal anchors of which some have no live link.

    ``anchors`` has doc_id and id, ``linked`` the ids with a live link.
    """
    marked = anchors.select("doc_id", "id").distinct().join(linked.select("id").distinct().withColumn("connected", F.lit(1)), "id", "left")
    per = marked.groupBy("doc_id").agg(F.count("*").alias("total_anchors"), F.count("connected").alias("connected_anchor_count"))
    out = per.withColumn("isolated_anchor_count", F.col("total_anchors") - F.col("connected_anchor_count"))
    return out.where("total_anchors > 1 and (isolated_anchor_count > 0 or connected_anchor_count = 0)")


def endpoint_violations(edges: DataFrame, labels: DataFrame, allowed: Sequence[tuple[str, str]], by: Column) -> DataFrame:
    """QA-ENDPOINT: edges whose end labels are no allowed pair, counted by type.

    ``labels`` has id and label, ``allowed`` pairs of a source and a target label: a contract, held in the filter.
    """
    s, t = labels.select(F.col("id").alias("src"), F.col("label").alias("source_label")), labels.select(F.col("id").alias("dst"), F.col("label").alias("target_label"))
    fits = F.lit(False)
    for a, b in allowed:
        fits = fits | (F.col("source_label").eqNullSafe(a) & F.col("target_label").eqNullSafe(b))
    bad = edges.join(s, "src").join(t, "dst").where(~fits)
    return bad.groupBy(by.alias("rel_type")).agg(F.count("*").alias("violation_count"))


def unreferenced(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key points to nothing."""
    return rows.join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def coverage(df: DataFrame, by: list[str], field: Column) -> DataFrame:
    """total, covered and their ratio by group; blank text counts as missing."""
    full = F.count(F.when(field.isNotNull() & (F.trim(field.cast("string")) != ""), 1))
    return df.groupBy(*by).agg(F.count("*").alias("total"), full.alias("covered")).withColumn("ratio", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Rows by bucket of a value: the number of edges at or below it."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(value >= e, 1).otherwise(0)
    return df.where(value.isNotNull()).groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
