"""Codes of vectors by product quantisation, with a lexicographic trie over distinct parts.

Vectors become integers and are cut into equal parts, each position with its own codebook.  The
distinct parts of a position, in lexicographic order, are the leaves of a trie whose levels are the
dimensions.  A depth-first walk carries the distances to all entries that the dimensions so far have
summed up, so parts that begin alike share that work; at a leaf the least of them is the code, and
the part, weighted by the number of vectors that have it, is added to the sums of its entry.

Distinct parts are counted once and dealt out by ranges of their order.  Each task walks its range
and returns sums by entry; only codebooks, whose size is fixed, reach the driver.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, sized

PARTS = 4
#: Components beyond this would leave 64 bits when squared and summed.
LARGEST = 1 << 27
#: Distinct parts of one walk.
_WALK = 4096


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the lower of equal ones, and its squared distance for distinct parts in lexicographic order."""
    n, d = parts.shape
    codes, errors = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def leaves(at: np.ndarray, sums: np.ndarray) -> None:
        codes[at] = best = sums.argmin(axis=1)
        errors[at] = sums[np.arange(len(at)), best]

    stack = [(0, n, 0, np.zeros(len(entries), dtype=np.int64))] if n and d else []
    while stack:
        low, high, depth, above = stack.pop()
        values = parts[low:high, depth]
        begin = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
        width = np.diff(np.append(begin, high - low))
        sums = above + (values[begin, None] - entries[None, :, depth]) ** 2
        # A branch with one leaf has nothing left to share: its other dimensions are added at once.
        lone = width == 1 if depth + 1 < d else np.ones(len(begin), dtype=bool)
        at, ends = low + begin[lone], sums[lone]
        for j in range(depth + 1, d):
            ends += (parts[at, None, j] - entries[None, :, j]) ** 2
        leaves(at, ends)
        for i in np.flatnonzero(~lone):
            stack.append((low + begin[i], low + begin[i] + width[i], depth + 1, sums[i]))
    return codes, errors


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``walk`` for parts in any order, repeated ones included."""
    distinct, where = np.unique(parts, axis=0, return_inverse=True)
    met = [walk(distinct[i:i + _WALK], entries) for i in range(0, len(distinct), _WALK)]
    codes, errors = (np.concatenate([m[k] for m in met]) if met else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return codes[where.ravel()], errors[where.ravel()]


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec) with floor(1024 * x), without null vectors and those with null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * 1024), F.lit(LARGEST)), F.lit(-LARGEST)))
    return vectors.where(x.isNotNull() & ~bad).select("vec_id", "label", whole.alias("vec"))


def _first_entries(kept: DataFrame, entries: int) -> tuple[list[list[int]], int]:
    """Vectors of the smallest ids and the number of components that all vectors must have."""
    least = kept.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(1).collect()
    width = len(least[0].vec) if least else 0
    same = kept.where(F.size("vec") == width).select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries)
    return [r.vec for r in same.collect()], width


def train(kept: DataFrame, entries: int = 256, rounds: int = 4) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, component) of integer vectors, and the width of the vectors they are for."""
    first, width = _first_entries(kept, entries)
    d = width // PARTS
    books = np.array(first, dtype=np.int64).reshape(len(first), width)[:, :PARTS * d].reshape(len(first), PARTS, d).transpose(1, 0, 2).copy()
    if not len(first) or not d:
        return books, width
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("part"), F.slice("vec", p * d + 1, d).alias("x"))))
    distinct = kept.where(F.size("vec") == width).select(cut.alias("c")).groupBy("c.part", "c.x").agg(F.count("*").alias("n"))
    parts = materialise(distinct.repartitionByRange("part", "x").sortWithinPartitions("part", "x"))
    fields = [f"s{j}" for j in range(d)]

    def sums(books: np.ndarray):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for b in batches:
                part, n, x = b["part"].to_numpy(), b["n"].to_numpy(), _matrix(b["x"], d)
                for p in np.unique(part):
                    mine = part == p
                    codes, _ = nearest(x[mine], books[p])
                    np.add.at(total[p], codes, x[mine] * n[mine, None])
                    np.add.at(count[p], codes, n[mine])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, j]) for j in range(d))], ["part", "entry", "n", *fields])
        return of

    for _ in range(rounds):
        made = parts.mapInArrow(sums(books), ", ".join(f"{c} long" for c in ("part", "entry", "n", *fields)))
        for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in fields)).collect():
            books[r["part"], r["entry"]] = [r[c] // r["n"] for c in fields]
    discard(parts)
    return books, width


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that can be compressed.

    ``vectors`` has vec_id, embedding and label; other columns are not looked at.  Null vectors and
    those with null or non-finite components are dropped, and so are those with another number of
    components than the vector of the smallest id; components that four parts leave over are not
    looked at.  Null ids come last, equal ids in the order of their vectors, repeated rows stay.
    Null labels are one label.  Components x beyond 131,072 count as that.  No rows give no rows.
    """
    kept = integer_vectors(vectors)
    books, width = train(kept, entries, rounds)
    d = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["vec"], width)
            met = [nearest(x[:, p * d:(p + 1) * d], books[p]) for p in range(PARTS)]
            code = np.stack([m[0] for m in met], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(m[1] for m in met))], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    codes = materialise(kept.where(F.size("vec") == width).mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    totals = sized(materialise(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
