"""Toxicity from class-conditional Kneser-Ney models.

Toxic and ordinary training texts give two character models of words that share their backoff
counts.  A text is judged by the length-normalised difference of its log-likelihoods, over the
whole text and over its most telling words; a logistic regression on these turns them into a score.
It is fitted on labelled texts that the models have not seen.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chargram
from .common import materialise

#: Bounds of the labelled sample: texts of each class, those with the smallest hashes of their ids.
MAX_TOXIC, MAX_ORDINARY = 1_500, 3_500
_FEATURES = 5


@dataclass
class ToxicityModel:
    ratio: chargram.LikelihoodRatio | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([(features - self.centre) / self.scale, np.ones(len(features))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _word_counts(sample: DataFrame) -> pd.DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                totals.update((w, bool(toxic)) for w in chargram.WORD.findall((text or "").lower()))
        yield pd.DataFrame([(w, t, n) for (w, t), n in totals.items()], columns=["word", "toxic", "n"])
    counted = sample.select("text", "toxic").mapInPandas(count, "word string, toxic boolean, n long")
    when = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    return counted.groupBy("word").agg(when(True).alias("t"), when(False).alias("o")).toPandas()


def _features(text: Column, shared: Broadcast) -> Column:
    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = chargram.LikelihoodRatio.of(shared.value)
        for texts in batches:
            yield pa.array([model.features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))
    return of(text)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta -= np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Three quarters of the sample are counted, the rest fits the regression, weighted back to the
    classes' shares among all labelled rows.  Null labels and ids are left out.  Without texts of
    both classes every score is 0.
    """
    usable = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)").where(~held_out(F.col("label_id")))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = lambda t, n: usable.where(F.col("toxic") == t).orderBy(F.xxhash64("label_id"), "label_id").limit(n)
    ids = materialise(first(1, max_toxic).union(first(0, max_ordinary)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))  # the bounds hold the broadcast
    sample = materialise(rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0).alias("apart")))
    empty = ToxicityModel(None, np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros(_FEATURES + 1))
    counts = _word_counts(sample.where(~F.col("apart")))
    if not (counts["t"].any() and counts["o"].any()):
        return empty
    ratio = chargram.LikelihoodRatio(list(counts.itertuples(index=False, name=None)))
    del counts
    shared = docs.sparkSession.sparkContext.broadcast(ratio.state)
    judged = sample.where("apart").select("toxic", _features(F.col("text"), shared).alias("x")).toPandas()
    shared.unpersist()
    y = judged["toxic"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return empty
    x = np.array(judged["x"].tolist())
    drawn = {1: min(sizes[1], max_toxic), 0: min(sizes[0], max_ordinary)}
    w = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return ToxicityModel(ratio, centre, scale, _logistic((x - centre) / scale, y, w / w.mean()))


def score(text: Column, model: ToxicityModel) -> Column:
    """Score between 0 and 1 of a text column; a null text is an empty one."""
    if model.ratio is None:
        return F.lit(0.0)
    shared = SparkSession.active().sparkContext.broadcast(model.ratio.state)
    numbers = (model.centre, model.scale, model.weights)

    # A batch stays in Arrow's form; one text at a time becomes a string.
    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = ToxicityModel(chargram.LikelihoodRatio.of(shared.value), *numbers)
        for texts in batches:
            yield pa.array(m.scores(np.array([m.ratio.features(t.as_py() or "") for t in texts]).reshape(len(texts), _FEATURES)), pa.float64())
    return of(text)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Only the text is scored.  Null and empty texts get the score of no evidence; repeated rows and
    null ids stay (a null id counts as not held out); an empty table gives an empty result; further
    columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
