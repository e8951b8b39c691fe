"""Linking of arguments, mentions and entities; knowledge-base choices; numeric values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prims import top1


def by_head(arguments: DataFrame, heads: DataFrame) -> DataFrame:
    """LNK-FA-NE, LNK-ANT-NE: arguments whose head is the head of a span (doc_id, span_id, head_tok_index)."""
    h = heads.select("doc_id", "span_id", F.col("head_tok_index").alias("head_tok"))
    return arguments.select("doc_id", F.col("id").alias("argument_id"), "head_tok").join(h, ["doc_id", "head_tok"]).select("doc_id", "argument_id", "span_id").distinct()


def by_complement(arguments: DataFrame, deps: DataFrame, heads: DataFrame, relation: str = "pobj") -> DataFrame:
    """LNK-FA-POBJ: prepositional arguments whose complement is the head of a span."""
    below = deps.where((F.col("type") == relation) & (F.col("head_tok") != F.col("dep_tok"))).select("doc_id", "head_tok", "dep_tok")
    comp = arguments.select("doc_id", F.col("id").alias("argument_id"), "head_tok").join(below, ["doc_id", "head_tok"])
    h = heads.select("doc_id", "span_id", F.col("head_tok_index").alias("dep_tok"))
    return comp.join(h, ["doc_id", "dep_tok"]).select("doc_id", "argument_id", "span_id").distinct()


def nested(spans: DataFrame) -> DataFrame:
    """ING-FUSE-KB, BF-NATIVE: spans inside a larger span of their document; they meet at the inner start."""
    outer = spans.select("doc_id", F.col("span_id").alias("outer_id"), F.col("start_tok").alias("a"), F.col("end_tok").alias("b"), F.explode(F.sequence("start_tok", "end_tok")).alias("start_tok"))
    met = spans.join(outer, ["doc_id", "start_tok"])
    return met.where((F.col("span_id") != F.col("outer_id")) & (F.col("end_tok") <= F.col("b")) & ((F.col("b") - F.col("a")) > (F.col("end_tok") - F.col("start_tok")))).select("doc_id", F.col("span_id").alias("inner_id"), "outer_id")


def stale(entities: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """ING-STALE: entities that were not seen again."""
    return entities.join(seen.select(key).distinct(), key, "left_anti")


def chain_kb(mentions: DataFrame, chain: Column) -> DataFrame:
    """NEL-HAVE, NEL-MISS: the knowledge-base id of each chain of a document, and how many mentions it fixes.

    The id of most mentions wins, then the smallest; ``conflicts`` have another, ``filled`` none.
    """
    m = mentions.select("doc_id", chain.alias("chain"), "kb_id")
    votes = m.where("kb_id is not null").groupBy("doc_id", "chain", "kb_id").agg(F.count("*").alias("votes"))
    best = top1(votes, ["doc_id", "chain"], F.col("votes").desc(), F.col("kb_id")).select("doc_id", "chain", F.col("kb_id").alias("chain_kb"))
    joined = m.join(best, ["doc_id", "chain"])
    return joined.groupBy("doc_id", "chain", "chain_kb").agg(F.count(F.when(F.col("kb_id").isNull(), 1)).alias("filled"), F.count(F.when(F.col("kb_id") != F.col("chain_kb"), 1)).alias("conflicts"))


def kb_scores(candidates: DataFrame, floor: float = 0.3, margin: float = 0.05) -> DataFrame:
    """ING-KBSCORE: best candidate of each mention (mention_id, surface, label) and its status.

    The score is one minus the edit distance as a share of the longer text, plus 0.04 if equal.
    """
    a, b = F.lower("surface"), F.lower("label")
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    scored = candidates.withColumn("score", F.round(1 - F.levenshtein(a, b) / longer + F.when(a == b, 0.04).otherwise(0.0), 6))
    w = Window.partitionBy("mention_id").orderBy(F.col("score").desc(), F.col("label"))
    ranked = scored.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("place = 1")
    status = F.when(F.col("score") < floor, "rejected").when(F.col("score") - F.coalesce("second", F.lit(0.0)) < margin, "ambiguous").otherwise("resolved")
    return ranked.select("mention_id", "label", "score", status.alias("status"))


def values(tokens: DataFrame) -> DataFrame:
    """NUM-VALUE, SRC-VALUE: numeric tokens with their normalised value and kind."""
    clean = F.regexp_replace("text", "[,$%]", "")
    kind = F.when(F.col("text").rlike(r"^\$"), "MONEY").when(F.col("text").rlike("%$"), "PERCENT").otherwise("CARDINAL")
    return tokens.where(F.col("text").rlike(r"^\$?[0-9][0-9,]*(\.[0-9]+)?%?$")).select("doc_id", "tok_index_doc", kind.alias("kind"), clean.cast("double").alias("value"))


def triples(arguments: DataFrame, frames: DataFrame, subject: str = "ARG0", object_: str = "ARG1") -> DataFrame:
    """ING-SVO: subject, predicate and object of frames that have both roles, counted by document."""
    side = lambda r, n: arguments.where(F.col("role") == r).select("frame_id", F.lower("head").alias(n))
    f = frames.select("doc_id", F.col("id").alias("frame_id"), "pred")
    return f.join(side(subject, "subject"), "frame_id").join(side(object_, "object"), "frame_id").groupBy("doc_id", "subject", "pred", "object").agg(F.count("*").alias("n"))


def semantic_heads(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """NOM-SEMHEAD: the best noun of a span by rank of its tag, distance from the right end, then position."""
    from ..plans.prims import span_tokens

    inside = span_tokens(spans, tokens)
    rank = F.when(F.col("pos").isin("NN", "NNS"), 0).when(F.col("pos") == "NNP", 1).when(F.col("pos") == "PRP", 2).otherwise(3)
    best = top1(inside.withColumn("rank", rank), ["span_id"], F.col("rank"), F.col("end_tok") - F.col("tok_index_doc"), F.col("tok_index_doc").desc())
    return best.select("doc_id", "span_id", F.col("tok_index_doc").alias("semantic_head"), "rank")


def profile(spans_with: DataFrame, weights: dict[str, float]) -> DataFrame:
    """NOM-PROFILE: weighted sum of boolean signals of a span, and the list of those that hold."""
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.when(F.col(c), w).otherwise(0.0)
    return spans_with.select("doc_id", "span_id", F.round(score, 4).alias("score"), F.array_join(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in weights))), ",").alias("signals"))


def near_events(mentions: DataFrame, edges: Sequence[DataFrame]) -> DataFrame:
    """MEN-DISC: mentions (id) that an edge (src) touches directly."""
    touched = edges[0].select("src")
    for e in edges[1:]:
        touched = touched.union(e.select("src"))
    return mentions.join(touched.select(F.col("src").alias("id")).distinct(), "id", "left_semi")

