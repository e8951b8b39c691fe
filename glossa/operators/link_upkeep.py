"""Links inferred in two steps, and links that are given up again.

Links have src, dst, rel_type, rule_id and confidence.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import enrich

# Rule -> first relation, second relation, result, confidence.
COMPOSITIONS = {"ga01_transitive_before": ("BEFORE", "BEFORE", "BEFORE", 0.72), "ga01_transitive_after": ("AFTER", "AFTER", "AFTER", 0.72), "ga01_included_before": ("IS_INCLUDED", "BEFORE", "BEFORE", 0.65)}


def inferred(links: DataFrame, events: DataFrame, rules: Sequence[str] = tuple(COMPOSITIONS)) -> DataFrame:
    """GA-01: (src, dst, rel_type, confidence, rule_id): two links in a row between events that no link joins yet.

    Both ends are events that are not low in confidence; what lies between may be anything.  Rules run
    in the order given: a pair that an earlier one joined is left to it.
    """
    sure = events.where(~F.coalesce("low_confidence", F.lit(False))).select("id")
    stated = links.select("src", "dst").distinct()
    out = None
    for rule in rules:
        first, second, result, confidence = COMPOSITIONS[rule]
        step = lambda rel, a, b: links.where(F.col("rel_type") == rel).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()
        left = step(first, "src", "mid").join(sure.withColumnRenamed("id", "src"), "src", "left_semi")
        right = step(second, "mid", "dst").join(sure.withColumnRenamed("id", "dst"), "dst", "left_semi")
        new = left.join(right, "mid").where("src <> dst").select("src", "dst").distinct().join(stated, ["src", "dst"], "left_anti")
        one = new.select("src", "dst", F.lit(result).alias("rel_type"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id"))
        out = one if out is None else out.unionByName(one)
        stated = stated.unionByName(new)
    return out


def given_up(rules: Sequence[str] = enrich.PURGED_RULES, inferences: Sequence[str] = tuple(COMPOSITIONS), seed: str = enrich.SEED_RULE, seed_types: Sequence[str] = enrich.SEED_TYPES) -> dict[str, Column]:
    """The purges by name: GA-01 inferences, GA-12 rules, GA-14 seeds of some types."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return {"inferences": no(F.col("rule_id").isin(list(inferences))), "rules": no(F.col("rule_id").isin(list(rules))), "seeds": no((F.col("rule_id") == seed) & F.col("rel_type").isin(list(seed_types)))}


def purge(links: DataFrame, gone: dict[str, Column], shadow_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """P-SHADOW, P-DELETE: the links that stay, and how many each purge takes (purge, deleted).

    A link that several purges name counts for the first.  With ``shadow_only`` all links stay and
    the counts are those of links that would go.
    """
    first = F.coalesce(*(F.when(c, F.lit(name)) for name, c in gone.items()))
    marked = links.withColumn("_purge", first)
    names = links.sparkSession.createDataFrame([(n,) for n in gone], "purge string")
    counts = F.broadcast(names).join(marked.where("_purge IS NOT NULL").groupBy(F.col("_purge").alias("purge")).agg(F.count("*").alias("deleted")), "purge", "left").select("purge", F.coalesce("deleted", F.lit(0).cast("long")).alias("deleted"))
    return links if shadow_only else marked.where("_purge IS NULL").drop("_purge"), counts
