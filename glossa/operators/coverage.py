"""How much of a table carries an attribute, and which rows break an attribute's contract."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: str) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def coverage(df: DataFrame, present: Column, total: str, with_it: str) -> DataFrame:
    """One row: rows, rows where ``present`` holds, and their ratio (0 for an empty table)."""
    counted = df.agg(F.count("*").alias(total), F.count(F.when(present, 1)).alias(with_it))
    return counted.withColumn("coverage_ratio", share(F.col(with_it), F.col(total)))


def scope_population(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """Of each document, event mentions and how many have a clause and a scope; documents without any count too."""
    held = mentions.groupBy(F.col("doc_id").alias("of_doc")).agg(F.count("*").alias("total_mentions"), F.count("clause_type").alias("with_clause"), F.count("scope_type").alias("with_scope"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = documents.select("doc_id").distinct().join(held, F.col("doc_id") == F.col("of_doc"), "left").select("doc_id", n("total_mentions"), n("with_clause"), n("with_scope"))
    ratio = lambda c: share(F.col(c), F.col("total_mentions"))
    return rows.select("*", ratio("with_clause").alias("clause_coverage"), ratio("with_scope").alias("scope_coverage"))


def factuality_disagreements(mentions: DataFrame) -> DataFrame:
    """Mentions whose factuality is not their event's, where the event is not flagged as in conflict."""
    a, b = F.upper("factuality"), F.upper("event_factuality")
    bad = mentions.where(filled("factuality") & filled("event_factuality") & (a != b) & ~F.coalesce("conflict_flag", F.lit(False)))
    return bad.groupBy(a.alias("mention_factuality"), b.alias("tevent_factuality")).agg(F.count("*").alias("violation_count"))


def factuality_attribution(mentions: DataFrame) -> DataFrame:
    """One row: mentions with a factuality whose source, confidence or either is missing."""
    no_source, no_confidence = ~filled("factuality_source"), F.col("factuality_confidence").isNull()
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return mentions.where(filled("factuality")).agg(n(no_source, "missing_source_count"), n(no_confidence, "missing_confidence_count"), n(no_source | no_confidence, "missing_contract_count"))


def timex_mention_contract(mentions: DataFrame, timexes: DataFrame) -> DataFrame:
    """Four counts over time mentions: no document, no span, no time expression behind them, the creation date."""
    known = timexes.select(F.col("id").alias("known")).distinct()
    m = mentions.join(known, F.col("refers_to") == F.col("known"), "left")
    metrics = {
        "missing_doc_id": ~filled("doc_id"), "missing_span_coordinates": F.col("start_tok").isNull() | F.col("end_tok").isNull(),
        "broken_refers_to_chain": F.col("known").isNull(), "dct_timexmention_count": F.upper(F.trim(F.coalesce("tid", F.lit("")))).isin("DCT", "T0")}
    row = m.agg(*(F.count(F.when(c, 1)).alias(name) for name, c in metrics.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).alias("item_count")) for name in metrics))).alias("m")).select("m.*")
