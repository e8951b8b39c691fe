"""Following pointers from row to row by doubling, and tables that end lineage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of spark.checkpoint.dir; one is made only in local mode, where none is set."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossa-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``checkpointed`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def heads(pointers: DataFrame) -> DataFrame:
    """(id, head) for every row of ``pointers`` (id, to, order): where its pointers lead in the end.

    An id has one pointer.  A chain ends at the row that has none.  A cycle has no such row; its head
    is the member with the smallest ``order``, then id.  Each round doubles the steps that a row has
    taken and keeps the best row on its way, so chains and cycles of n rows take log2(n) rounds,
    however many there are; a row that many point at costs no more than those rows.
    """
    state = checkpointed(pointers.select("id", F.col("to").alias("at"), F.struct("order", "id").alias("best"), F.lit(False).alias("done"), F.lit(True).alias("gained")))
    before = None
    while True:
        beyond = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("best").alias("_best"), F.col("done").alias("_done"))
        left = state.drop("gained").join(beyond, "at", "left")
        ended = F.col("_at").isNull()
        done = ended | F.col("_done")
        new = checkpointed(left.select("id", F.coalesce("_at", "at").alias("at"), F.when(ended, F.col("best")).otherwise(F.least("best", "_best")).alias("best"), done.alias("done"), (~done & (F.col("_best") < F.col("best"))).alias("gained")))
        discard(state)
        state = new
        still = state.where("NOT done").agg(F.count("*"), F.count_distinct("at"), F.max("gained")).first()
        # A round that closes nothing leaves what leads into cycles.  If it leaves the number of rows that are arrived at,
        # they all lie on cycles; if no row met a better one, the steps have gone round every cycle.
        if still[0] == 0 or (still[:2] == before and not still[2]):
            break
        before = still[:2]
    round_trip = state.where("NOT done").select(F.col("id").alias("at"), F.col("best.id").alias("_head"))
    return state.join(round_trip, "at", "left").select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("_head")).alias("head"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b); root is the smallest node that can be reached.

    Every round each class takes the smallest class that a link joins it to, and roots follow their
    pointers, so that rounds grow with the logarithm of a class, not with its length.  A hub costs its
    links, as minima are taken before the shuffle.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    state = checkpointed(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m"))
        to = state.join(near, "node", "left").groupBy("root").agg(F.min(F.least("root", F.coalesce("m", "root"))).alias("to"))
        further = to.select(F.col("root").alias("to"), F.col("to").alias("next"))
        jump = to.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("new"))
        state = checkpointed(state.join(jump, "root").select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")
