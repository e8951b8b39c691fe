"""Gold-versus-system scoring.

Mentions have doc_id, kind, start_tok and end_tok; attributes are further columns.
"""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

_SPAN = ("start_tok", "end_tok")


def strict_counts(gold: DataFrame, predicted: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """EVAL-PAIR-STRICT: tp, fp, fn of each document; equal mentions are matched one to one."""
    keys = ["doc_id", *_SPAN, *attributes]
    side = lambda df, g, p: df.select(*keys, F.lit(g).alias("g"), F.lit(p).alias("p"))
    both = side(gold, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    hit = F.least("g", "p")
    return both.groupBy("doc_id").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def prf(counts: DataFrame) -> DataFrame:
    """EVAL-MENTION: precision, recall and F1 beside the counts, 0 where undefined."""
    p, r = scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scores.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", scores.f1(F.col("precision"), F.col("recall")))


def aggregate(per_doc: DataFrame) -> DataFrame:
    """EVAL-AGG: micro scores from summed counts and macro scores as means over documents."""
    micro = prf(per_doc.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))).select(F.lit("micro").alias("average"), "precision", "recall", "f1")
    macro = prf(per_doc).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).select(F.lit("macro").alias("average"), "precision", "recall", "f1")
    return micro.unionByName(macro)


def overlaps(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, gold_id, pred_id, iou) of mentions that share a token; spans meet token by token."""
    unroll = lambda df, name: df.select("doc_id", F.col("id").alias(f"{name}_id"), F.col("start_tok").alias(f"{name}_start"), F.col("end_tok").alias(f"{name}_end"), F.explode(F.sequence("start_tok", "end_tok")).alias("tok"))
    met = unroll(gold, "gold").join(unroll(predicted, "pred"), ["doc_id", "tok"]).drop("tok").distinct()
    return met.withColumn("iou", scores.interval_iou(F.col("gold_start"), F.col("gold_end"), F.col("pred_start"), F.col("pred_end")))


def relaxed_pairs(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """EVAL-PAIR-RELAX: one-to-one pairs, greedily by overlap, then gold and predicted id, per document."""
    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_g, taken_p, rows = set(), set(), []
        for r in pdf.sort_values(["iou", "gold_id", "pred_id"], ascending=[False, True, True]).itertuples(index=False):
            if r.gold_id not in taken_g and r.pred_id not in taken_p:
                taken_g.add(r.gold_id)
                taken_p.add(r.pred_id)
                rows.append((r.doc_id, r.gold_id, r.pred_id, r.iou))
        return pd.DataFrame(rows, columns=["doc_id", "gold_id", "pred_id", "iou"])
    near = overlaps(gold, predicted).where(F.col("iou") >= threshold).select("doc_id", "gold_id", "pred_id", "iou")
    return near.groupBy("doc_id").applyInPandas(greedy, "doc_id long, gold_id string, pred_id string, iou double")


def token_alignment(gold_tokens: DataFrame, predicted_tokens: DataFrame) -> DataFrame:
    """EVAL-ALIGN: (doc_id, pred_tok, gold_tok) of equal runs of two token sequences, per document."""
    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        side = lambda s: pdf[pdf.side == s].sort_values("tok")
        a, b = side("pred"), side("gold")
        rows = [(pdf.doc_id.iloc[0], int(a.tok.iloc[m.a + k]), int(b.tok.iloc[m.b + k])) for m in SequenceMatcher(None, a.text.tolist(), b.text.tolist(), autojunk=False).get_matching_blocks() for k in range(m.size)]
        return pd.DataFrame(rows, columns=["doc_id", "pred_tok", "gold_tok"])
    mark = lambda df, s: df.select("doc_id", F.col("tok_index_doc").alias("tok"), "text", F.lit(s).alias("side"))
    return mark(gold_tokens, "gold").unionByName(mark(predicted_tokens, "pred")).groupBy("doc_id").applyInPandas(align, "doc_id long, pred_tok long, gold_tok long")


def error_buckets(gold: DataFrame, predicted: DataFrame, attribute: str) -> DataFrame:
    """EVAL-BUCKET-M: mentions by kind of error.

    exact: span and attribute agree; type: only the span; boundary: spans overlap; missing and
    spurious: nothing on the other side.
    """
    g = gold.select("doc_id", *_SPAN, "id", F.col(attribute).alias("a"))
    p = predicted.select("doc_id", *_SPAN, F.col("id").alias("pred_id"), F.col(attribute).alias("b"))
    exact = g.join(p, ["doc_id", *_SPAN]).withColumn("bucket", F.when(F.col("a").eqNullSafe(F.col("b")), "exact").otherwise("type"))
    g_left, p_left = g.join(exact.select("id"), "id", "left_anti"), p.join(exact.select("pred_id"), "pred_id", "left_anti")
    near = overlaps(g_left, p_left.withColumnRenamed("pred_id", "id"))
    g_near, p_near = near.select(F.col("gold_id").alias("id")).distinct(), near.select("pred_id").distinct()
    count = lambda df, b: df.agg(F.count("*").alias("n")).select(F.lit(b).alias("bucket"), "n")
    return (exact.groupBy("bucket").agg(F.count("*").alias("n")).unionByName(count(g_near, "boundary"))
            .unionByName(count(g_left.join(g_near, "id", "left_anti"), "missing")).unionByName(count(p_left.join(p_near, "pred_id", "left_anti"), "spurious")))


def signature(mentions: DataFrame) -> DataFrame:
    """EVAL-SIG: sha256 of each document's sorted mentions; equal projections have equal signatures."""
    row = F.concat_ws(":", "start_tok", "end_tok", F.coalesce("tense", F.lit("-")))
    return mentions.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";"), 256).alias("signature"))
