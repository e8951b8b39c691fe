"""URL filter: host and path rules, else logistic regression on hashed character n-grams."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Most rules that are written into one expression.
MAX_RULES = 500
#: Most labelled URLs that the model is fitted on.
MAX_LABELLED = 5_000
BUCKETS = 1 << 15
_NGRAMS = (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.  Rules are (host + path, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules for one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of ``^host$`` and ``^path$``, which are told apart."""
    found = set()
    for kind, part in (("h", host), ("p", path)):
        s = f"^{part}$"
        found.update(zlib.crc32(f"{kind}{s[i:i + n]}".encode()) % BUCKETS for n in _NGRAMS for i in range(len(s) - n + 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


def fit(labelled: list[tuple[str, str, bool]], rounds: int = 200, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by full gradient steps with momentum."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not labelled:
        return weights, bias
    rows = [features(h, p) for h, p, _ in labelled]
    y = np.array([float(v) for *_, v in labelled])
    sizes = np.array([len(r) for r in rows])
    cols, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(sizes)
    speed, bias_speed = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, weights[cols], len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        speed = 0.9 * speed - rate * (np.bincount(cols, (error * scale)[owner], BUCKETS) + decay * weights)
        bias_speed = 0.9 * bias_speed - 0.1 * rate * error.sum()
        weights, bias = weights + speed, bias + bias_speed
    return weights, bias


def judge_urls(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of ``urls``.

    ``labelled`` has url and allowed (boolean).  The model is fitted on at most ``max_labelled`` of
    its distinct URLs, those with the smallest hashes; where it is empty, every score is 0.5 and
    allows.  A url that is null or has no ``://`` has empty parts and is scored as such.  A rule
    wins over the model, a longer rule over a shorter one.  Repeated rows stay, further columns are
    ignored, an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    sample = (labelled.where("url is not null and allowed is not null").groupBy("url").agg(F.min("allowed").alias("allowed"))
              .orderBy(F.xxhash64("url"), "url").limit(max_labelled).select(host.alias("host"), path.alias("path"), "allowed"))
    weights, bias = fit([tuple(r) for r in sample.collect()])
    model = urls.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        w, known = model.value, {}
        for part in parts:
            out = []
            for h, p in zip(part["host"], part["path"]):
                if h is None:
                    out.append(None)
                    continue
                if (h, p) not in known:
                    if len(known) > 100_000:
                        known.clear()
                    f = features(h, p)
                    known[h, p] = float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(len(f)) + bias)))) if len(f) else 0.5
                out.append(known[h, p])
            yield pd.Series(out, dtype="float64")

    parts = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    free = lambda c: F.when(F.col("rule").isNull(), F.col(c)).alias(c)
    return (ruled.select("*", score(F.struct(free("host"), free("path"))).alias("score"))
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score"))
