"""Confidence, salience and consistency passes over events, frames and entities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_confidence_without_frame(events: DataFrame, frames: DataFrame, confidence: Column, limit: float = 0.6) -> DataFrame:
    """GA-02A: events below the limit that no verbal or nominal frame heads are marked and halved, unless they are marked already."""
    framed = frames.where("framework IN ('PROPBANK', 'NOMBANK')").select("doc_id", F.col("head_tok").alias("start_tok")).distinct().withColumn("framed", F.lit(True))
    joined = events.withColumn("confidence", confidence).join(framed, ["doc_id", "start_tok"], "left")
    low = F.col("framed").isNull() & (F.coalesce("confidence", F.lit(1.0)) < limit) & ~F.coalesce("low_confidence", F.lit(False))
    return joined.select("doc_id", "id", (F.coalesce("low_confidence", F.lit(False)) | low).alias("low_confidence"), F.when(low, F.col("confidence") * 0.5).otherwise(F.col("confidence")).alias("confidence"))


def salience(mentions: DataFrame, entity: Column, events_per_doc: DataFrame) -> DataFrame:
    """GA-05: ``round((.6 mentions + .4 events) / (mentions + events + 1), 4)`` of each entity and document."""
    counted = mentions.select("doc_id", entity.alias("entity"), "id").groupBy("doc_id", "entity").agg(F.countDistinct("id").alias("mentions"))
    joined = counted.join(events_per_doc, "doc_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    m, e = F.col("mentions"), F.col("events")
    return joined.select("doc_id", "entity", "mentions", "events", F.round((0.6 * m + 0.4 * e) / (m + e + 1), 4).alias("salience"))


def chain_quality(mentions: DataFrame, entity: Column) -> DataFrame:
    """GA-07: confidence in a chain of mentions, by its length and the entities it is anchored at."""
    chain = mentions.groupBy("doc_id", entity.alias("entity")).agg(F.count("*").alias("mentions"), F.countDistinct("kb_id").alias("anchored"))
    n, known = F.col("mentions"), F.col("anchored") >= 1
    return chain.withColumn("confidence", F.when((n >= 5) & known, 0.92).when((n >= 3) & known, 0.82).when(n >= 2, 0.7).otherwise(0.5))


def sentence_roots(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """GA-08: the root token of each sentence."""
    roots = deps.where("type = 'ROOT'").select("doc_id", F.col("dep_tok").alias("tok_index_doc"))
    return tokens.join(roots, ["doc_id", "tok_index_doc"]).select("doc_id", "sent_idx", F.col("tok_index_doc").alias("root_tok"), F.col("text").alias("root_text"), F.col("pos").alias("root_pos"))


def noun_event_pos(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """GA-10: an event on a noun token gets the part of speech NOUN."""
    tok = tokens.select("doc_id", F.col("tok_index_doc").alias("start_tok"), F.col("pos").alias("token_pos"))
    return events.join(tok, ["doc_id", "start_tok"]).select("doc_id", "id", F.when(F.col("token_pos").startswith("NN"), "NOUN").otherwise(F.col("pos")).alias("pos"))


def polarity(events: DataFrame, deps: DataFrame) -> DataFrame:
    """MORPH-POL: an event whose token has a negation beside it in the dependencies, either way, is negative."""
    neg = deps.where("type = 'neg' and head_tok <> dep_tok")
    ends = neg.select("doc_id", F.col("head_tok").alias("start_tok")).union(neg.select("doc_id", "dep_tok")).distinct().withColumn("negated", F.lit(True))
    return events.join(ends, ["doc_id", "start_tok"], "left").select("doc_id", "id", F.when(F.col("negated"), "NEG").otherwise(F.col("polarity")).alias("polarity"))


def aligned_frames(frames: DataFrame, at_most: int = 5) -> DataFrame:
    """ING-ALIGN: frames of the two frameworks on one head word, close by; geometric mean of confidences."""
    from ..plans.prims import band_join

    side = lambda f, p: frames.where(F.col("framework") == f).select("doc_id", F.lower("pred").alias("word"), F.col("id").alias(f"{p}_id"), F.col("head_tok").alias(f"{p}_tok"), F.col("confidence").alias(f"{p}_conf"))
    met = band_join(side("PROPBANK", "verbal"), side("NOMBANK", "nominal"), ["doc_id", "word"], "verbal_tok", "nominal_tok", at_most)
    return met.select("doc_id", "verbal_id", "nominal_id", F.round(F.sqrt(F.col("verbal_conf") * F.col("nominal_conf")), 6).alias("confidence"))
