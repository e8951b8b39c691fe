"""Provenance of inferred edges and the resolution of conflicting evidence."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

FIELDS = ("confidence", "evidence_source", "rule_id", "authority_tier", "source_kind", "conflict_policy")


def stamp(edges: DataFrame, values: dict[str, Column], preserve: bool = True) -> DataFrame:
    """PRV-STAMP: write provenance columns, or fill only what is missing."""
    have = set(edges.columns)
    return edges.withColumns({c: F.coalesce(F.col(c), v) if preserve and c in have else v for c, v in values.items()})


def missing(edges: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """PRV-VALIDATE: per rule, how many edges lack each field and how many lack any."""
    lacks = {f: (F.col(f).isNull() if f in edges.columns else F.lit(True)) for f in fields}
    any_of = lacks[fields[0]]
    for f in fields[1:]:
        any_of = any_of | lacks[f]
    return edges.groupBy("rule_id").agg(F.count("*").alias("total"), *(F.count(F.when(c, 1)).alias(f"missing_{f}") for f, c in lacks.items()), F.count(F.when(any_of, 1)).alias("violations"))


def breakdown(edges: DataFrame, by: Sequence[str] = ("evidence_source", "rule_id", "authority_tier"), fields: Sequence[str] = FIELDS) -> DataFrame:
    """Missing provenance fields by source, rule and tier, with their total."""
    unset = lambda c: F.coalesce(F.col(c), F.lit("UNSET")).alias(c)
    marked = edges.select(*(unset(c) for c in by), *(F.col(f).isNull().cast("long").alias(f"missing_{f}") for f in fields))
    sums = [F.sum(f"missing_{f}").alias(f"missing_{f}") for f in fields]
    return marked.groupBy(*by).agg(*sums).withColumn("total_missing_fields", sum((F.col(f"missing_{f}") for f in fields), F.lit(0).cast("long")))


def authoritative(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PRV-PICK: per key the record of the highest tier, then confidence, source and value."""
    order = F.struct(scores.tier_rank(F.col("authority_tier")).alias("rank"), "confidence", "evidence_source", "value")
    return records.groupBy(*keys).agg(F.max(order).alias("best")).select(*keys, "best.value", "best.evidence_source", "best.confidence", F.col("best.rank").alias("tier_rank"))


def decision(existing: Column, incoming: Column, existing_rank: Column, incoming_rank: Column, policy: str = "authority") -> Column:
    """PRV-DECIDE: noop, insert, keep, coexist or replace.

    ``authority`` replaces only what has a lower rank, ``coexist`` keeps both.
    """
    clash = F.lit("coexist") if policy == "coexist" else F.when(incoming_rank > existing_rank, "replace").otherwise("keep")
    return F.when(incoming.isNull(), "noop").when(existing.isNull(), "insert").when(existing == incoming, "noop").otherwise(clash)
