"""Rival entity mentions of one head: one is kept and takes over what the others know; heads that are missing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prims import span_tokens, top1

# Types of numbers and times, for which one recogniser is preferred.
NUMERIC_TYPES = ("CARDINAL", "DATE", "ORDINAL", "MONEY", "TIME", "QUANTITY", "PERCENT")


def rivals(entities: DataFrame, types: Sequence[str] = NUMERIC_TYPES, prefer: str = "spacy") -> DataFrame:
    """ING-FUSE-NUM: (loser, winner) among mentions of one document, head token and type.

    The mention of the preferred source wins, then one with a knowledge-base id, then the smallest id.
    ``entities`` has doc_id, id, head_tok, type, source and kb_id; mentions without a head have no rivals.
    """
    known = entities.where(F.col("type").isin(*types) & F.col("head_tok").isNotNull())
    order = F.struct(F.coalesce(F.col("source") != prefer, F.lit(True)).alias("other"), F.col("kb_id").isNull().alias("unlinked"), F.col("id").alias("id"))
    best = known.groupBy("doc_id", "head_tok", "type").agg(F.min(order).alias("b"), F.count("*").alias("n")).where("n > 1").select("doc_id", "head_tok", "type", F.col("b.id").alias("winner"))
    return known.join(best, ["doc_id", "head_tok", "type"]).where("id <> winner").select(F.col("id").alias("loser"), "winner")


def fused(entities: DataFrame, lost: DataFrame, salvage: Sequence[str] = ("kb_id", "score")) -> DataFrame:
    """ING-FUSE-NUM: entities without the losers; winners take missing fields from them, the smallest id first.

    ``is_mention`` is true where it was for the winner or one of the losers.
    """
    given = lost.join(entities.select(F.col("id").alias("loser"), *(F.col(c).alias(f"_{c}") for c in salvage), F.coalesce("is_mention", F.lit(False)).alias("_is_mention")), "loser")
    gained = given.groupBy(F.col("winner").alias("id")).agg(*(F.min_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("loser"))).alias(f"_{c}") for c in salvage), F.bool_or("_is_mention").alias("_is_mention"))
    kept = entities.join(lost.select(F.col("loser").alias("id")), "id", "left_anti").join(gained, "id", "left")
    return kept.withColumns({**{c: F.coalesce(c, f"_{c}") for c in salvage}, "is_mention": F.coalesce("is_mention", F.lit(False)) | F.coalesce("_is_mention", F.lit(False))}).drop("_is_mention", *(f"_{c}" for c in salvage))


def relinked(links: DataFrame, lost: DataFrame) -> DataFrame:
    """ING-FUSE-NUM: links (id, entity_id) of losers as links of their winners, each once."""
    to = lost.select(F.col("loser").alias("id"), "winner")
    return links.join(to, "id", "left").select(F.coalesce("winner", "id").alias("id"), "entity_id").distinct()


def filled_heads(entities: DataFrame, tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """ING-FUSE-HEAD: entities with head and head_tok where they had none; what is there stays.

    The head is a token that no other token of the mention governs, first one that governs another,
    then the first.  ``entities`` has doc_id, id, start_tok, end_tok, head and head_tok.
    """
    bare = entities.where("head IS NULL OR head_tok IS NULL").select("doc_id", F.col("id").alias("span_id"), "start_tok", "end_tok")
    inside = span_tokens(bare, tokens.select("doc_id", "tok_index_doc", "text"))
    arcs = deps.where("head_tok <> dep_tok").select("doc_id", "head_tok", "dep_tok")
    within = inside.select("doc_id", "span_id", "start_tok", "end_tok", F.col("tok_index_doc").alias("dep_tok")).join(arcs, ["doc_id", "dep_tok"]).where("head_tok BETWEEN start_tok AND end_tok")
    governed = within.select("span_id", F.col("dep_tok").alias("tok_index_doc")).distinct()
    governs = within.select("span_id", F.col("head_tok").alias("tok_index_doc")).distinct().withColumn("governs", F.lit(True))
    free = inside.join(governed, ["span_id", "tok_index_doc"], "left_anti").join(governs, ["span_id", "tok_index_doc"], "left")
    found = top1(free, ["span_id"], F.coalesce("governs", F.lit(False)).desc(), F.col("tok_index_doc")).select(F.col("span_id").alias("id"), F.col("text").alias("_head"), F.col("tok_index_doc").alias("_head_tok"))
    return entities.join(found, "id", "left").withColumns({"head": F.coalesce("head", "_head"), "head_tok": F.coalesce("head_tok", "_head_tok")}).drop("_head", "_head_tok")


def unique_mentions(entities: DataFrame, keys: Sequence[str] = ("doc_id", "start_tok", "end_tok", "type")) -> DataFrame:
    """ING-FUSE-HEAD: one mention for each span and type, the smallest id, with the fields that any of them knows."""
    rest = [c for c in entities.columns if c not in (*keys, "id")]
    w = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = entities.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in rest})
    return top1(filled, keys, F.col("id")).select(*entities.columns)
