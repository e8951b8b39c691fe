"""Column helpers that several operators share."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows up to which a small side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: Characters of its strings, arrays and maps, written out, likewise.
BROADCAST_CHARS = 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of a prefix sum that are added up one by one.
_BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the checkpoint folder that the cluster names; one of its own only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossa-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, already materialised, with a broadcast hint if its counted rows and characters are within bounds."""
    long_ones = [c for c, kind in small.dtypes if kind.startswith(("string", "binary", "array", "map", "struct"))]
    chars = F.sum(F.length(F.to_json(F.struct(*long_ones))).cast("long")) if long_ones else F.lit(0)
    n, width = small.agg(F.count("*"), chars).first()
    return F.broadcast(small) if n <= rows and (width or 0) <= BROADCAST_CHARS else small


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Memo:
    """What a Python worker remembers across tasks: the memo of one operator at a time.

    Taking one forgets those of other operators, so that a worker that serves several stages
    holds no more than the largest of their bounds.
    """

    @classmethod
    def take(cls, name: str, key: object, make: Callable[[], object]) -> object:
        held = cls.__dict__.get("_held")
        if held is None or held[:2] != (name, key):
            cls.forget()
            cls._held = held = (name, key, make())
        return held[2]

    @classmethod
    def forget(cls) -> None:
        """Drop what an operator that ran before in this worker remembered."""
        cls._held = None
        pa.default_memory_pool().release_unused()
        # What was freed goes back to the system, where the C library can.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    """What tells texts apart: the SHA-256 of the text, a null one being empty."""
    return F.sha2(text_or_empty(text), 256)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(steps: Column) -> Column:
    """Inclusive prefix sums of an array of longs, by blocks, so that long arrays stay cheap."""
    def from_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(x, b * _BLOCK + 1, _BLOCK)))
        return let(blocks, lambda sums: F.flatten(F.transform(sums, lambda _, b: let(
            total(F.slice(sums, F.lit(1), b)),
            lambda before: F.transform(F.slice(x, b * _BLOCK + 1, _BLOCK), lambda _y, i: before + total(F.slice(x, b * _BLOCK + 1, i + 1)))))))
    return let(steps, lambda x: F.when(F.size(x) == 0, x).otherwise(from_blocks(x)))


def find_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value, left, right>>.

    Positions are code points, the end exclusive; ``left`` and ``right`` are the text up to the
    neighbouring matches.  The text between the matches is split off only where there is a match.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(m: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(
            prefix_sums(F.transform(m, lambda _, i: (F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(m, i - 1))).otherwise(0)).cast("long"))),
            lambda starts: F.transform(m, lambda v, i: F.struct(
                F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(v)).alias("end"), v.alias("value"),
                F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right")))))
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array<struct<kind, start, end>>, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
