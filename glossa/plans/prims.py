"""Relational building blocks of the annotation operators."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top1(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group under a total order (P-TOP1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str], left_pos: str, right_pos: str, at_most: int, *tie: Column) -> DataFrame:
    """For each left row the closest right row of the same keys within ``at_most`` positions (P-NEAREST).

    Positions are bucketed as wide as the limit, so that a hot key is spread over its buckets and a
    left row meets three buckets at most.  ``key`` tells the left rows apart.  ``right`` has no other
    columns in common with ``left`` but those of ``on``; ``tie`` breaks equal distances.
    """
    bucket = lambda c: F.floor(F.col(c) / max(1, at_most))
    l = left.withColumn("_bucket", F.explode(F.sequence(bucket(left_pos) - 1, bucket(left_pos) + 1)))  # noqa: E741
    r = right.withColumn("_bucket", bucket(right_pos))
    met = l.join(r, [*on, "_bucket"]).withColumn("distance", F.abs(F.col(left_pos) - F.col(right_pos))).where(F.col("distance") <= at_most)
    return top1(met, [*on, *key], F.col("distance"), *tie).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_pos: str, right_pos: str, at_most: int) -> DataFrame:
    """Pairs of equal keys at most ``at_most`` positions apart, by buckets (P-JOIN-BAND)."""
    bucket = lambda c: F.floor(F.col(c) / max(1, at_most))
    l = left.withColumn("_bucket", F.explode(F.sequence(bucket(left_pos) - 1, bucket(left_pos) + 1)))  # noqa: E741
    met = l.join(right.withColumn("_bucket", bucket(right_pos)), [*on, "_bucket"])
    return met.where(F.abs(F.col(left_pos) - F.col(right_pos)) <= at_most).drop("_bucket")


def span_tokens(spans: DataFrame, tokens: DataFrame, doc: str = "doc_id", start: str = "start_tok", end: str = "end_tok", tok: str = "tok_index_doc") -> DataFrame:
    """One row per token inside each span (P-JOIN-RANGE): spans are unrolled, then joined by equality."""
    return spans.withColumn(tok, F.explode(F.sequence(F.col(start), F.col(end)))).join(tokens, [doc, tok])


def enclosed_tokens(spans: DataFrame, tokens: DataFrame, on: Sequence[str], key: Sequence[str], width: int = 64) -> DataFrame:
    """``spans`` (start_char, end_char) with start_tok and end_tok, the first and last token wholly inside (P-JOIN-RANGE).

    Characters are put into buckets of ``width``, so the join is by equality and a long document is
    spread; a span meets the buckets it reaches into.  Spans without a token have nulls.
    """
    keys = [*on, *key]
    cut = spans.where("end_char >= start_char").select(*keys, F.col("start_char").alias("_from"), F.col("end_char").alias("_to"), F.explode(F.sequence(F.floor(F.col("start_char") / width), F.floor(F.col("end_char") / width))).alias("_bucket"))
    t = tokens.select(*on, F.floor(F.col("start_char") / width).alias("_bucket"), "start_char", "end_char", "tok_index_doc")
    inside = cut.join(t, [*on, "_bucket"]).where("start_char >= _from AND end_char <= _to").groupBy(*keys).agg(F.min("tok_index_doc").alias("start_tok"), F.max("tok_index_doc").alias("end_tok"))
    return spans.join(inside, keys, "left")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], policy: str, confidence: str = "confidence") -> DataFrame:
    """Merge rows by key (P-UPSERT).

    ``policy`` says what happens where both have a row: ``overwrite``, ``keep`` (fills only what is
    null), ``higher`` (replace if the incoming confidence is higher), ``create`` (current row as it
    is).  Several incoming rows of a key are reduced to the most confident first; all current rows
    of a key are affected alike.
    """
    if policy not in ("overwrite", "keep", "higher", "create"):
        raise ValueError(f"unknown policy {policy}")
    columns = current.columns
    order = [F.col(confidence).desc_nulls_last()] if confidence in incoming.columns else []
    new = top1(incoming.select(*columns), keys, *order, *(F.col(c) for c in columns)).select(*(F.col(c).alias(f"_new_{c}") for c in columns))
    both = current.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), [F.col(k) == F.col(f"_new_{k}") for k in keys], "full")
    wins = {"overwrite": F.col("_new").isNotNull(), "keep": F.lit(False), "create": F.lit(False),
            "higher": F.coalesce(F.col(f"_new_{confidence}") > F.coalesce(F.col(confidence), F.lit(0.0)), F.lit(False)) if policy == "higher" else None}[policy]

    def value(c: str) -> Column:
        old, fresh = F.col(c), F.col(f"_new_{c}")
        kept = F.coalesce(old, fresh) if policy == "keep" else old
        return F.when(F.col("_old").isNull(), fresh).when(wins, fresh if policy == "higher" else F.coalesce(fresh, old)).otherwise(kept).alias(c)
    return both.select(*(value(c) for c in columns))


def delete(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a match in ``keys`` (P-DELETE)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in ``gone`` (id) and what hangs on them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    left = nodes.join(ids, F.col("id") == F.col("_gone"), "left_anti")
    kept = edges.join(ids, F.col("src") == F.col("_gone"), "left_anti").join(ids, F.col("dst") == F.col("_gone"), "left_anti")
    return left, kept


def suppress(edges: DataFrame, losers: DataFrame, on: Sequence[str], by: str, reason: Column) -> DataFrame:
    """Mark the rows of ``losers`` (keys and the columns of ``reason``) as suppressed, keep all (P-SUPPRESS)."""
    marks = losers.select(*on, reason.alias("_reason")).groupBy(*on).agg(F.min("_reason").alias("_reason"))
    joined = edges.join(marks, list(on), "left")
    lost = F.col("_reason").isNotNull()
    return (joined.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)) | lost)
            .withColumn("suppressed_by", F.when(lost, F.lit(by))).withColumn("suppression_reason", F.col("_reason")).drop("_reason"))


def reachable(edges: DataFrame, start: DataFrame, depth: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, origin, node, hops): nodes within ``depth`` edges of each start, with the fewest hops (P-PATH).

    ``edges`` has group, src and dst, ``start`` group and node.  Each step keeps only what is new.
    """
    found = start.select(*group, F.col("node").alias("origin"), "node", F.lit(0).alias("hops")).distinct()
    front = found
    for hop in range(1, depth + 1):
        step = front.withColumnRenamed("node", "src").drop("hops").join(edges.select(*group, "src", "dst"), [*group, "src"]).select(*group, "origin", F.col("dst").alias("node")).distinct()
        front = step.join(found, [*group, "origin", "node"], "left_anti").withColumn("hops", F.lit(hop))
        found = found.unionByName(front)
    return found


def case_map(column: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    """Dictionary lookup written as a literal map (P-CASEMAP)."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.element_at(pairs, column)
    return found if otherwise is None else F.coalesce(found, otherwise)


def completeness(df: DataFrame, present: dict[str, Column], core: Sequence[Column]) -> DataFrame:
    """One row: total, how many have each field, and how many lack one of the core fields."""
    missing = core[0].isNull()
    for c in core[1:]:
        missing = missing | c.isNull()
    return df.agg(F.count("*").alias("total"), *(F.count(c).alias(name) for name, c in present.items()), F.count(F.when(missing, 1)).alias("missing_core"))


def metrics(rows: dict[str, tuple[DataFrame, Callable[[], Column]]]) -> DataFrame:
    """metric, item_count: one aggregated row for each entry."""
    out = None
    for name, (df, count) in rows.items():
        row = df.agg(count().alias("item_count")).select(F.lit(name).alias("metric"), "item_count")
        out = row if out is None else out.unionByName(row)
    return out
