"""Exact deduplication by deterministic block naming.

The UTF-8 bytes of a text are cut into blocks of a fixed size.  Equal blocks get one integer name,
then the names of adjacent blocks are paired and the pairs named in turn, until every document has
one name.  Texts are equal if and only if they need as many rounds and end with the same name: a
name always stands for compared content, never for a hash, so no two texts can collide.

Naming is one shuffle: equal keys are sorted together and take the smallest row number among them.
Hashes only find the keys that are so frequent that their rows must be spread; those are named in
parts, and the few names of the parts are made one afterwards.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, sized, text_or_empty

#: Stands for the missing second name of a pair.
_NONE = -1


@dataclass(frozen=True)
class Naming:
    block_bytes: int = 1024
    #: A key on more than one row in so many is spread over parts of at most that size.
    hot: int = 1024
    #: Rows that a part may always have.
    part_rows: int = 64
    #: Keys that the search for frequent ones follows.
    tracked: int = 1 << 14


def _hot_keys(rows: DataFrame, key: list[str], naming: Naming, *more) -> tuple[DataFrame | None, list]:
    """(hash, parts) of the keys on too many rows, at most ``naming.hot`` of them, and the aggregates ``more``."""
    frequent, n, *rest = rows.agg(F.expr(f"approx_top_k(xxhash64({', '.join(key)}), {naming.hot}, {naming.tracked})"), F.count("*"), *more).first()
    most = max(naming.part_rows, n // naming.hot)
    hot = [(x["item"], -(-x["count"] // most)) for x in frequent or [] if x["count"] > most]
    return (rows.sparkSession.createDataFrame(hot, "hot_key long, parts long") if hot else None), rest


def _named(rows: DataFrame, key: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` without ``key``, with ``name``: the smallest ``at`` of the rows of one key.  Written as a table."""
    if hot is None:
        return materialise(rows.withColumn("name", F.min("at").over(Window.partitionBy(*key))).drop(*key))
    spread = rows.join(F.broadcast(hot), F.xxhash64(*key) == F.col("hot_key"), "left")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("at"), F.coalesce("parts", F.lit(1))))
    first = F.col("parts").isNotNull() & (F.col("at") == F.col("name"))
    parts = materialise(spread.withColumn("name", F.min("at").over(Window.partitionBy(*key, "part")))
                        .withColumn("of_part", F.when(first, F.struct(*key))).drop(*key, "hot_key", "parts", "part"))
    of = parts.where(F.col("of_part").isNotNull()).select("of_part", F.col("name").alias("part_name"))
    one = of.groupBy("of_part").agg(F.min("part_name").alias("one"))
    renamed = materialise(of.join(one, "of_part").where("part_name <> one").select("part_name", "one"))
    return parts.drop("of_part").join(sized(renamed), F.col("name") == F.col("part_name"), "left").withColumn("name", F.coalesce("one", "name")).drop("part_name", "one")


def identities(docs: DataFrame, naming: Naming | None = None) -> DataFrame:
    """(doc_id, text_sha256, at, rounds, name) for every row of ``docs``; (rounds, name) is the text's identity.

    ``docs`` is read twice and must give its rows in the same order (a table does).  A null text counts as
    empty, an empty text is one empty block.  Columns besides doc_id and text are not looked at.
    """
    naming = naming or Naming()
    size = naming.block_bytes
    data = text_or_empty().cast("binary")
    n = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1)).cast("long")
    texts = docs.select(F.col("doc_id"), F.sha2(data, 256).alias("sha"), data.alias("data"), F.monotonically_increasing_id().alias("rid"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), (i * size + 1).cast("int"), F.lit(size)))
    rows = texts.withColumn("n", n).select("doc_id", "sha", "rid", "n", F.posexplode(blocks).alias("pos", "block"))
    head = F.when(F.col("pos") == 0, F.struct("doc_id", "sha")).alias("head")
    hot, (most,) = _hot_keys(rows, ["block"], naming, F.max("n"))
    level = _named(rows.select("rid", F.col("pos").cast("long").alias("pos"), "n", head, "block", F.monotonically_increasing_id().alias("at")), ["block"], hot)
    rounds, out = 0, []
    in_order = Window.partitionBy("rid").orderBy("pos")
    while True:
        out.append(level.where("n = 1").select("head.doc_id", F.col("head.sha").alias("text_sha256"), "at", F.lit(rounds).alias("rounds"), "name"))
        if most is None or most <= 1:
            break
        # Names at odd places end the pair of the name before them.
        paired = level.where("n > 1").withColumn("b", F.coalesce(F.lead("name").over(in_order), F.lit(_NONE))).where("pos % 2 = 0")
        pairs = materialise(paired.select("rid", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("n") / 2).alias("n"), "head", F.col("name").alias("a"), "b", "at"))
        hot, _ = _hot_keys(pairs, ["a", "b"], naming)
        level = _named(pairs, ["a", "b"], hot)
        discard(pairs)
        most, rounds = -(-most // 2), rounds + 1
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def deduplicate(docs: DataFrame, naming: Naming | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows of one text (null: empty) one is kept, that with the largest doc_id; null ids count as
    smallest, and of repeated rows one is kept.  Texts may have any length.  No rows give no rows.
    """
    rows = identities(docs, naming)
    groups = rows.groupBy("rounds", "name").agg(F.max(F.struct("doc_id", "at")).alias("top"), F.count("*").alias("n")).where("n > 1")
    repeated = materialise(groups.select(F.col("rounds").alias("g_rounds"), F.col("name").alias("g_name"), "top", "n"))
    joined = rows.join(sized(repeated), (F.col("rounds") == F.col("g_rounds")) & (F.col("name") == F.col("g_name")), "left")
    alone = F.col("n").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                         (alone | (F.col("at") == F.col("top.at"))).alias("kept"), "text_sha256")
