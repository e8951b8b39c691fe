"""Fusion of entities within and across documents.

Mentions have id, doc_id, surface, type, kb_id and sent_idx.  The entity of a mention is its
knowledge-base id, or else its surface.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity() -> Column:
    return F.coalesce("kb_id", "surface")


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """FUS-COOC: entity pairs of a sentence, with the number of sentences they share.

    Mentions are first reduced to the distinct entities of each sentence.
    """
    seen = mentions.select("doc_id", "sent_idx", entity().alias("entity")).where("entity is not null").distinct()
    a, b = seen.withColumnRenamed("entity", "a"), seen.withColumnRenamed("entity", "b")
    return a.join(b, ["doc_id", "sent_idx"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("sentences"), F.lit(0.65).alias("confidence"))


def same_kb(mentions: DataFrame) -> DataFrame:
    """FUS-KB: documents that name one knowledge-base id with compatible types, as classes.

    A class is (kb_id, type); its documents are linked through the smallest one, which says the same
    as all their pairs.
    """
    kind = F.upper(F.coalesce("type", F.lit("")))
    seen = mentions.where("kb_id is not null and kb_id <> ''").select("kb_id", kind.alias("type"), "doc_id").distinct()
    return seen.groupBy("kb_id", "type").agg(F.count("*").alias("documents"), F.min("doc_id").alias("representative")).where("documents > 1").withColumn("links", (F.col("documents") * (F.col("documents") - 1) / 2).cast("long"))


def same_key(mentions: DataFrame, min_length: int = 2) -> DataFrame:
    """FUS-COREF: surfaces found in several documents where one side has no knowledge-base id, as classes.

    ``links`` counts pairs of documents' mentions keys of which at least one is without an id.
    """
    key = F.lower(F.trim(F.coalesce("surface", F.lit(""))))
    seen = (mentions.select(key.alias("key"), F.upper(F.coalesce("type", F.lit(""))).alias("type"), "doc_id", (F.coalesce("kb_id", F.lit("")) != "").alias("known"))
            .where(F.length("key") >= min_length).groupBy("key", "type", "doc_id").agg(F.max("known").alias("known")))
    n, k = F.col("documents"), F.col("known_documents")
    return (seen.groupBy("key", "type").agg(F.count("*").alias("documents"), F.count(F.when(F.col("known"), 1)).alias("known_documents"), F.min("doc_id").alias("representative"))
            .withColumn("links", (n * (n - 1) / 2 - k * (k - 1) / 2).cast("long")).where("links > 0"))
