"""Ranked lexical search by branch and bound over FP-trees of the documents.

Only terms that some item asks for matter.  Each document becomes the vector of those terms, ordered
by how frequent they are, so that documents share the beginnings of their vectors as paths of an
FP-tree.  A tree is a sorted block of documents of one task; a node stands for documents that share
a path and knows the largest tf of every term below it and the smallest m.  As a term's part of the
score grows with tf and falls with m, these give a bound for each item; a depth-first walk enters a
node only for the items whose bound reaches their fiftieth score so far.  Items are walked together,
each with its own bound and threshold.

A first search among one in 64 documents gives thresholds that any task starts from: the fiftieth
score of some documents is never above that of all.  So tasks return few rows besides the final ones.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, UPPER, materialise

#: Bytes of UTF-8 that terms do not have become blanks, capitals small letters; other bytes stay.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
#: Bytes of a text that are split at a time.
_PIECE = 1 << 22


@dataclass(frozen=True)
class Ranking:
    top: int = 50
    #: One document in so many is searched first, for thresholds.
    seed: int = 64
    #: Documents and terms of one tree; documents of a leaf.
    tree_docs: int = 4096
    tree_terms: int = 1 << 20
    leaf_docs: int = 32
    #: Different terms and items that one reading of the documents looks for.
    block_terms: int = 20_000
    block_items: int = 2_000


def term_counts(data: bytes, wanted: dict[bytes, int] | set[bytes]) -> tuple[int, Counter]:
    """How many terms a text has, and how often each wanted one occurs."""
    n, found, low = 0, Counter(), 0
    while low < len(data):
        high = low + _PIECE
        while high < len(data) and _BYTES[data[high]] != 32:
            high += 1
        terms = data[low:high].translate(_BYTES).split()
        n += len(terms)
        found.update(filter(wanted.__contains__, terms))
        low = high
    return n, found


def item_blocks(items: DataFrame, limits: Ranking) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items (item_id, its terms) in blocks of bounded size; repeated rows once, those without terms not."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"), F.lit(0)))
    block, known = [], set()
    for r in items.where("text IS NOT NULL").select("item_id", terms.alias("terms")).distinct().where(F.size("terms") > 0).orderBy("item_id", "terms").toLocalIterator():
        own = [t.encode() for t in r.terms]
        if block and (len(known | set(own)) > limits.block_terms or len(block) >= limits.block_items):
            yield block
            block, known = [], set()
        block.append((r.item_id, own))
        known |= set(own)
    if block:
        yield block


class Tree:
    """A block of documents (sorted term vectors, flat) as a path-compressed FP-tree with its bounds."""

    def __init__(self, terms: np.ndarray, tf: np.ndarray, begin: np.ndarray, m: np.ndarray, n_terms: int, leaf_docs: int) -> None:
        self.terms, self.tf, self.begin, self.m = terms, tf, begin, m
        # Node: first and last document; its children follow later in the lists, so a walk backwards sees them first.
        self.low, self.high, self.children = [0], [len(m)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= leaf_docs:
                continue
            depth = self._shared(low, high - 1)
            place = begin[low:high] + depth
            ended = place >= begin[low + 1:high + 1]
            here = np.where(ended, -1, terms[np.minimum(place, len(terms) - 1)])
            cuts = np.concatenate(([0], np.flatnonzero(here[1:] != here[:-1]) + 1, [high - low]))
            if len(cuts) == 2:  # the same vector again and again: slices of it are leaves
                cuts = np.append(np.arange(0, high - low, leaf_docs), high - low)
            # Small branches side by side are one leaf.
            kept = [0]
            for a, b in zip(cuts[1:], cuts[2:]):
                if b - kept[-1] > leaf_docs:
                    kept.append(a)
            for a, b in zip(kept, [*kept[1:], high - low]):
                self.children[node].append(len(self.low))
                todo.append(len(self.low))
                self.low.append(low + int(a))
                self.high.append(low + int(b))
                self.children.append([])
        self.most = np.zeros((len(self.low), n_terms), dtype=np.int32)
        self.least = np.zeros(len(self.low), dtype=np.int64)
        for node in range(len(self.low) - 1, -1, -1):
            low, high = self.low[node], self.high[node]
            self.least[node] = m[low:high].min()
            if self.children[node]:
                np.max(self.most[self.children[node]], axis=0, out=self.most[node])
            else:
                here = slice(begin[low], begin[high])
                np.maximum.at(self.most[node], terms[here], tf[here])

    def _shared(self, a: int, b: int) -> int:
        """Terms that two vectors begin with; as vectors are sorted, all between them do."""
        x, y = self.terms[self.begin[a]:self.begin[a + 1]], self.terms[self.begin[b]:self.begin[b + 1]]
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        return int(differ[0]) if len(differ) else k


def worth(w: np.ndarray, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return w * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m))


class Best:
    """The best documents of each item so far, and the score that another one must reach."""

    def __init__(self, n_items: int, top: int, floor: np.ndarray) -> None:
        self.rows, self.top, self.floor = [[] for _ in range(n_items)], top, np.maximum(floor, 1)

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[item]
        rows += [(-int(s), i is None, i) for s, i in zip(scores, ids)]
        if len(rows) >= 2 * self.top:
            self.trim(item)

    def trim(self, item: int) -> None:
        rows = self.rows[item]
        rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        del rows[self.top:]
        if len(rows) == self.top:
            self.floor[item] = max(self.floor[item], -rows[-1][0])


def search(tree: Tree, ids: list, weights: np.ndarray, asked: list[np.ndarray], best: Best) -> int:
    """Depth-first branch and bound of all items at once.  Returns the number of documents scored."""
    flat, starts, scored = np.concatenate(asked), np.cumsum([0, *map(len, asked[:-1])]), 0
    stack = [0]
    while stack:
        node = stack.pop()
        there = np.flatnonzero(tree.most[node])
        part = np.zeros(len(weights), dtype=np.int64)
        part[there] = worth(weights[there], tree.most[node, there], tree.least[node])
        alive = np.flatnonzero(np.add.reduceat(part[flat], starts) >= best.floor)
        if not len(alive):
            continue
        if tree.children[node]:
            stack += reversed(tree.children[node])
            continue
        low, high = tree.low[node], tree.high[node]
        here = slice(tree.begin[low], tree.begin[high])
        doc = np.repeat(np.arange(high - low), np.diff(tree.begin[low:high + 1]))
        scored += high - low
        parts = np.zeros((high - low, len(weights)), dtype=np.int64)
        parts[doc, tree.terms[here]] = worth(weights[tree.terms[here]], tree.tf[here], tree.m[low:high][doc])
        for i in alive:
            scores = parts[:, asked[i]].sum(axis=1)
            hits = np.flatnonzero(scores >= best.floor[i])
            if len(hits):
                best.add(i, scores[hits], [ids[low + h] for h in hits])
    return scored


def trees(rows: Iterator[tuple[object, int, np.ndarray, np.ndarray]], rank: np.ndarray, limits: Ranking, of_m) -> Iterator[tuple[Tree, list]]:
    """Trees over documents (id, n, terms, tf), each of bounded size.  ``rank`` orders terms, the most frequent first."""
    held, size = [], 0

    def built() -> tuple[Tree, list]:
        held.sort(key=lambda h: h[0])
        begin = np.cumsum([0, *(len(h[3]) for h in held)])
        return Tree(np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), begin, of_m(np.array([h[2] for h in held], dtype=np.int64)), len(rank), limits.leaf_docs), [h[1] for h in held]

    for doc, n, terms, tf in rows:
        order = np.argsort(rank[terms])
        path = rank[terms][order]
        held.append((path.astype(">u4").tobytes(), doc, n, path, tf[order]))
        size += len(path)
        if len(held) >= limits.tree_docs or size >= limits.tree_terms:
            yield built()
            held, size = [], 0
    if held:
        yield built()


def _vectors(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document that has a term; the wanted terms by their numbers."""
    kind = dict(docs.dtypes)["doc_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc, data in zip(b["doc_id"], b["data"]):
                n, found = term_counts(data.as_py(), wanted)
                if n:
                    ids.append(doc.as_py())
                    ns.append(n)
                    terms.append([wanted[t] for t in found])
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b["doc_id"].type), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])
    return materialise(docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(of, f"doc_id {kind}, n long, terms array<int>, tf array<int>"))


def _block(docs: DataFrame, block: list[tuple[object, list[bytes]]], item_type: str, limits: Ranking) -> DataFrame:
    terms = sorted({t for _, own in block for t in own})
    wanted = {t: i for i, t in enumerate(terms)}
    vectors = _vectors(docs, wanted)
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block has terms
        df[r["t"]] = r["count"]
    order = np.lexsort((np.arange(len(terms)), -df))
    rank = np.empty(len(terms), dtype=np.int64)
    rank[order] = np.arange(len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) for t in order], dtype=np.int64)
    asked = [np.sort(rank[[wanted[t] for t in own]]) for _, own in block]
    of_m = lambda n: 50 + (50 * n * n_docs) // max(n_terms, 1)
    kind, ids_as = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)

    def found_by(floor: np.ndarray):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(asked), limits.top, floor)

            def rows():
                for b in batches:
                    at, tf, n, ids = b["terms"].offsets.to_numpy(), b["tf"].flatten().to_numpy(), b["n"].to_numpy(), b["doc_id"].to_pylist()
                    t = b["terms"].flatten().to_numpy()
                    at = at - at[0]
                    for i, doc in enumerate(ids):
                        yield doc, n[i], t[at[i]:at[i + 1]], tf[at[i]:at[i + 1]]

            for tree, ids in trees(rows(), rank, limits, of_m):
                search(tree, ids, weights, asked, best)
            for i in range(len(asked)):
                best.trim(i)
            found = [(i, doc, -s) for i, rows_ in enumerate(best.rows) for s, _, doc in rows_]
            for k in range(0, max(len(found), 1), 10_000):
                item, doc, score = zip(*found[k:k + 10_000]) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, ids_as), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
        return of

    full = vectors.where(F.size("terms") > 0)
    search_in = lambda df, floor: df.mapInArrow(found_by(floor), f"item int, doc_id {kind}, score long")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    floor = np.zeros(len(asked), dtype=np.int64)
    some = full.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(limits.seed)) == 0)
    for r in ranked(search_in(some, floor)).where(F.col("rank") == limits.top).collect():  # a row for each item at most
        floor[r["item"]] = r["score"]
    names = docs.sparkSession.createDataFrame([Row(of_item=i, item_id=item) for i, (item, _) in enumerate(block)], f"of_item int, item_id {item_type}")
    return ranked(search_in(full, floor)).where(F.col("rank") <= limits.top).join(F.broadcast(names), F.col("item") == F.col("of_item")).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, limits: Ranking | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, equal scores by ascending doc_id.

    Null texts have no terms and do not count.  Null ids come last among equal scores; repeated rows
    are ranked each.  Items are told apart by id and terms; those without terms have no rows, and
    neither has an item whose terms stand in no document.  ``docs`` is read once for each block of
    items.  Other columns are not looked at.
    """
    limits = limits or Ranking()
    kind = dict(items.dtypes)["item_id"]
    out = None
    for block in item_blocks(items.select("item_id", "text"), limits):
        one = _block(docs.select("doc_id", "text"), block, kind, limits)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
