"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over hashed words, with document frequencies of the
distinct texts of the whole corpus.  A distributed randomised SVD of them gives the latent space.  Windows of every document,
as long as the passages, are compared with them by cosine in that space; a window whose share in the
space cannot reach the threshold is passed over, which loses nothing.
All candidates are then held against the passage by their longest common subsequence of words, and
paraphrases also by whether the passage's answer, its last sentence, is there.  Items of a few words
have no direction of their own in such a space; they are searched for as exact runs of words.
"""
from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialise, sized, text_key

BUCKETS = 1 << 17
#: Words that enter or leave a window together.
STEP = 8
#: Words whose buckets a worker remembers.
_REMEMBERED = 300_000
#: Words of a document that are looked at together.
_CHUNK = 1 << 14


@dataclass(frozen=True)
class Search:
    #: Dimensions of the sketch beyond those of the latent space, which has one for each passage of a block.
    oversampling: int = 16
    #: Cosine from which a window is a candidate.
    min_cosine: float = 0.45
    #: Share of a passage's words in common order: a copy, or a paraphrase if the answer is there too.
    copied: float = 0.8
    paraphrased: float = 0.6
    #: Items with fewer words are found where their words stand in a row, unchanged.
    min_words: int = 8
    #: Items with fewer words are found only in texts that have no other words.
    lone_words: int = 4
    #: Longer items are cut into passages of about so many words.
    max_words: int = 96
    #: Passages that share a latent space, about.
    block: int = 128
    #: Bytes of latent spaces that one reading of the documents searches.
    reading: int = 64 << 20


def normal(token: str) -> str:
    """Lower case, without what is neither letter nor digit at the ends."""
    word = token.lower().strip(string.punctuation)
    return word if word.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", word)


class Buckets(dict):
    """Tokens to hashed buckets, remembered; -1 for tokens without a letter or digit."""

    def __missing__(self, token: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[token] = found = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS if (w := normal(token)) else -1
        return found

    def __call__(self, tokens: Collection[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def words_of(text: str | None) -> list[str]:
    return [w for t in (text or "").split() if (w := normal(t))]


def passages_of(text: str | None, max_words: int) -> list[list[str]]:
    """The words of an item, cut into equal passages if they are many."""
    words = words_of(text)
    n = max(1, math.ceil(len(words) / max_words))
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


def answer_of(text: str | None) -> list[str]:
    """The words of the last sentence."""
    sentences = [words for s in re.split(r"[.!?\n]+", text or "") if (words := words_of(s))]
    return sentences[-1] if sentences else []


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        m = places.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indexed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, words): the buckets of each document's words as 32-bit integers, so that texts are split once."""
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Memo.take("buckets", BUCKETS, Buckets)
        for b in batches:
            words = []
            for t in b["text"]:
                ids = bucket((t or "").split())
                words.append(ids[ids >= 0].astype("<i4").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "words": words})
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInPandas(index, "doc_id long, text_key string, words binary")


def document_frequencies(index: DataFrame) -> np.ndarray:
    """Distinct texts of the whole corpus by bucket: each task counts its own, Spark adds them up.

    Each of n copies counts as the nth part of a text, so only the hashes of texts are grouped.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, last = np.zeros(BUCKETS), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for words, part in zip(b["words"], b["part"]):
                ids = np.frombuffer(words, dtype="<i4")
                at = np.arange(len(ids))
                last[ids] = at
                df[ids[last[ids] == at]] += part  # each word where it stands last
        hit = np.nonzero(df)[0]
        yield pd.DataFrame({"bucket": hit, "n": df[hit]})
    total = np.zeros(BUCKETS)
    copies = sized(materialise(index.groupBy(F.col("text_key").alias("copied")).agg(F.count("*").alias("copies")).where("copies > 1")))
    parts = index.join(copies, F.col("text_key") == F.col("copied"), "left").select("words", (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    rows = parts.mapInPandas(count, "bucket long, n double").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total


def weights(df: np.ndarray, n_texts: int) -> np.ndarray:
    """Weights of words by their document frequencies, from 0.8 for a word of every text; none is zero.

    The root keeps a passage of frequent words visible among rare ones.
    """
    return np.sqrt(np.log1p((1 + n_texts) / (1 + df)))


def _vector(bucket: Buckets, words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(bucket(words), return_counts=True)
    ids, counts = ids[idf[ids] > 0], counts[idf[ids] > 0]
    v = counts * idf[ids]
    norm = np.sqrt((v * v).sum())
    return ids, v / norm if norm else v


def latent_space(passages: DataFrame, rank: int, idf: np.ndarray, vocabulary: np.ndarray, search: Search) -> np.ndarray:
    """Right singular vectors over ``vocabulary`` of the passages' TF-IDF matrix, by randomised SVD.

    ``rank`` is the number of passages, so that the space holds each of them whole.
    Tasks multiply their own passages with the sketch and return sums over the vocabulary, which is
    that of one block of passages; the driver only orthogonalises.
    """
    sc = passages.sparkSession.sparkContext
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    shared = sc.broadcast((idf.astype(np.float32), place))
    width = min(rank + search.oversampling, len(vocabulary))

    def gram_times(q: np.ndarray) -> np.ndarray:
        sketch = sc.broadcast(q.astype(np.float32))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (idf_, place_), s, bucket = shared.value, sketch.value, Buckets()
            out = np.zeros_like(s, dtype=np.float64)
            for b in batches:
                for words in b["words"]:
                    ids, v = _vector(bucket, list(words), idf_)
                    out[place_[ids]] += np.outer(v, v @ s[place_[ids]])
            hit = np.nonzero(out.any(axis=1))[0]
            if len(hit):
                yield pd.DataFrame({"row": hit, "sums": list(out[hit])})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            at, place_of = np.unique(rows["row"].to_numpy(), return_inverse=True)
            out = np.zeros((len(at), len(rows["sums"].iloc[0])))
            np.add.at(out, place_of, np.array(rows["sums"].tolist()))
            return pd.DataFrame({"row": at, "sums": list(out)})
        added = passages.select("words").mapInPandas(multiply, "row long, sums array<double>").groupBy(F.pmod("row", F.lit(64))).applyInPandas(add, "row long, sums array<double>").toPandas()
        sketch.unpersist()
        total = np.zeros(q.shape)
        if len(added):
            total[added["row"].to_numpy()] = np.array(added["sums"].tolist())
        return total

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(vocabulary), width)))[0]
    for _ in range(2):
        q = np.linalg.qr(gram_times(q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_times(q))
    shared.unpersist()
    order = np.argsort(values)[::-1][:rank]
    return (q @ turn[:, order[values[order] > 1e-9]]).astype(np.float32)


def window_of(words: int) -> int:
    """A window that holds a passage of so many words wherever it begins."""
    return STEP * (-(-words // STEP) + 1)


class Finder:
    """Candidate windows of documents for a block of passages."""

    def __init__(self, state: tuple) -> None:
        idf2, place, weighted, self.classes, self.words, self.min_cosine, self.min_share = state
        # The last bucket stands for the blank space between documents.
        self.idf2, self.place = np.append(idf2, np.float32(0)), np.append(place, np.int32(-1))
        # The last row, which is blank, is that of words outside the vocabulary.
        self.weighted = np.vstack([weighted, np.zeros((1, weighted.shape[1]), dtype=np.float32)])
        self.longest = max(self.classes, default=0)
        # For each word and passage the places that the word has in the passage, as bits; a column for
        # each passage in the order of the classes, a lane for each 64 words of the longest.
        numbers = [p for own, _ in self.classes.values() for p in own.tolist()]
        sizes = [int(self.words[p][1].sum()) for p in numbers]
        lanes = -(-max(sizes, default=0) // 64)
        self.bits = np.zeros((lanes, len(weighted) + 1, len(numbers)), dtype=np.uint64)
        for column, p in enumerate(numbers):
            at = 0
            for row, n in zip(place[self.words[p][0]].tolist(), self.words[p][1].tolist()):
                for bit in range(at, at + n):
                    self.bits[bit // 64, row, column] |= np.uint64(1 << bit % 64)
                at += n
        self.needed = self.min_share * np.array(sizes)

    def __call__(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, list[float], list[int], list[int]]]:
        """(number of the text, passage, cosines, first words, last words) with every window of a text and passage.

        Windows without enough of the passage's words, in whatever order, cannot hold it and are left out.
        """
        met: dict[tuple[int, int], dict[tuple[int, int], float]] = {}
        for pieces in self._pieces(texts):
            whole = np.array([at + len(own) == len(texts[number]) for number, at, own in pieces])
            for number, at, p, dot, a, b in self._windows(pieces, ~whole):
                a, b = at + a, at + b
                half = (b - a) // 2
                first, last = max(0, a - half), b + half
                if self._shared(p, texts[number][first:last]) >= self.min_share:
                    own, counts = np.unique(texts[number][a:b], return_counts=True)
                    met.setdefault((number, p), {})[first, last] = dot / math.sqrt((counts ** 2 * self.idf2[own]).sum())
        for (number, p), windows in met.items():
            yield number, p, list(windows.values()), [a for a, _ in windows], [b for _, b in windows]

    def _shared(self, passage: int, there: np.ndarray) -> float:
        """The part of the passage's words, each as often as it stands in it, that is there."""
        ids, counts = self.words[passage]
        own, n = np.unique(there, return_counts=True)
        at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        return np.where(own[at] == ids, np.minimum(n[at], counts), 0).sum() / counts.sum()

    def _pieces(self, texts: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Runs of (number of the text, first word, buckets) of about _CHUNK words; long texts are cut with an overlap."""
        run, size = [], 0
        for number, ids in enumerate(texts):
            for at in range(0, len(ids), _CHUNK):
                run.append((number, at, ids[at:at + _CHUNK + self.longest]))
                size += len(run[-1][2]) + self.longest
                if size >= _CHUNK:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def _windows(self, pieces: list[tuple[int, int, np.ndarray]], unfinished: np.ndarray) -> Iterator[tuple[int, int, int, float, int, int]]:
        sizes, offsets = np.array([len(ids) for *_, ids in pieces]), np.array([at for _, at, _ in pieces])
        begins = np.concatenate([[0], np.cumsum(-(-sizes // STEP) * STEP + self.longest)])
        ids = np.full(begins[-1], BUCKETS, dtype=np.int64)
        for (*_, own), at in zip(pieces, begins):
            ids[at:at + len(own)] = own
        steps = len(ids) // STEP
        rows = self.place[ids]
        present = self._present(rows, steps)
        live = self._live(present, steps, begins[:-1] // STEP, (begins[:-1] + sizes) // STEP, offsets > 0, unfinished)
        if not live.any():
            return
        # The energy counts a recurring word once for each time, which is at most the square of the
        # window's norm: no window above the threshold is lost.
        energy = np.zeros(steps + 1)
        np.cumsum(self.idf2[ids].reshape(steps, STEP).sum(axis=1), out=energy[1:])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(np.int8), [0]])))
        for low_step, high_step in zip(edges[::2].tolist(), edges[1::2].tolist()):
            # Latent sums of everything in this stretch before each step.
            latent = np.zeros((high_step - low_step + 1, self.weighted.shape[1]), dtype=np.float32)
            for word in range(STEP):
                latent[1:] += self.weighted[rows[low_step * STEP + word:high_step * STEP:STEP]]
            np.cumsum(latent, axis=0, out=latent)
            column = 0
            for length, (numbers, passages) in self.classes.items():
                n, mine = length // STEP, column
                column += len(numbers)
                if high_step - low_step < n:
                    continue
                norm2 = energy[low_step + n:high_step + 1] - energy[low_step:high_step + 1 - n]
                # No cosine exceeds the part of the window that lies in the latent space.
                inside = latent[n:] - latent[:-n]
                near = np.nonzero((norm2 > 1e-3) & (np.einsum("ij,ij->i", inside, inside) >= self.min_cosine ** 2 * norm2))[0]
                dots = inside[near] @ passages.T
                i, j = np.nonzero(dots >= self.min_cosine * np.sqrt(norm2[near])[:, None])
                if not len(i):
                    continue
                at_step = low_step + near[i]
                start = at_step * STEP
                k = np.searchsorted(begins, start, side="right") - 1
                # Where a long text was cut, what lies beyond is not seen, so nothing is left out.
                low, high = at_step - (n + 1) // 2, at_step + n + (n + 1) // 2
                cut = ((low * STEP < begins[k]) & (offsets[k] > 0)) | ((high * STEP > begins[k] + sizes[k]) & unfinished[k])
                around = np.clip(low[:, None] + np.arange(n + 2 * ((n + 1) // 2)), 0, steps - 1)
                there = sum(np.bitwise_count(np.bitwise_or.reduce(lane[around, (mine + j)[:, None]], axis=1)).astype(np.int64) for lane in present)
                ok = (start - begins[k] < sizes[k]) & (cut | (there >= self.needed[mine + j]))  # not in the blank space
                for x in np.nonzero(ok)[0].tolist():
                    number, at, own = pieces[k[x]]
                    first = int(start[x] - begins[k[x]])
                    yield number, at, int(numbers[j[x]]), float(dots[i[x], j[x]]), first, min(len(own), first + length)

    def _live(self, present: np.ndarray, steps: int, first: np.ndarray, last: np.ndarray, cut_before: np.ndarray, cut_behind: np.ndarray) -> np.ndarray:
        """Steps near which enough of some passage's words stand; elsewhere no window can hold one.

        Words are gathered over stretches as long as the longest window with its surroundings.
        """
        n, coarse = self.longest // STEP, -(-steps // STEP)
        padded = np.zeros((len(present), coarse * STEP, present.shape[2]), dtype=np.uint64)
        padded[:, :steps] = present
        own = np.bitwise_or.reduce(padded.reshape(len(present), coarse, STEP, -1), axis=2)
        reach = -(-(2 * n + 2) // STEP) + 1
        whole = own.copy()
        for k in range(1, min(reach, coarse)):
            whole[:, :-k] |= own[:, k:]
        hot = (np.bitwise_count(whole).sum(axis=0, dtype=np.int64) >= self.needed).any(axis=1)
        for a, b, before, behind in zip(first.tolist(), last.tolist(), cut_before.tolist(), cut_behind.tolist()):
            if before:
                hot[max(0, a - n) // STEP:(a + n) // STEP + 1] = True
            if behind:
                hot[max(0, b - 2 * n - 2) // STEP:b // STEP + 1] = True
        live = hot.copy()
        for k in range(1, min(reach, coarse)):
            live[k:] |= hot[:-k]
        return np.repeat(live, STEP)[:steps]

    def _present(self, rows: np.ndarray, steps: int) -> np.ndarray:
        """By lane, step and passage, the places of the passage whose words stand in the step."""
        out = np.zeros((len(self.bits), steps, self.bits.shape[2]), dtype=np.uint64)
        for lane, bits in zip(out, self.bits):
            for word in range(STEP):
                lane |= bits[rows[word::STEP]]
        return out


def block_state(passages: DataFrame, idf: np.ndarray, search: Search) -> tuple:
    """What a ``Finder`` needs of one block of passages."""
    block = {r["passage"]: r["words"] for r in passages.collect()}  # one block of passages
    bucket = Buckets()
    vocabulary = np.unique(np.concatenate([bucket(w) for w in block.values()]))
    vocabulary = vocabulary[(vocabulary >= 0) & (idf[vocabulary] > 0)]
    v = latent_space(passages, len(block), idf, vocabulary, search)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    classes: dict[int, tuple[list, list]] = {}
    known = {}
    for number, words in block.items():
        known[number] = np.unique(bucket(words), return_counts=True)
        ids, x = _vector(bucket, words, idf)
        numbers, latent = classes.setdefault(window_of(len(words)), ([], []))
        numbers.append(number)
        z = x @ v[place[ids]]
        latent.append(z / max(np.linalg.norm(z), 1e-9))
    weighted = (v * idf[vocabulary][:, None]).astype(np.float32)
    return place, weighted, {n: (np.array(a), np.array(b, dtype=np.float32)) for n, (a, b) in classes.items()}, known, search.min_cosine, min(search.copied, search.paraphrased)


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` buckets."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[j:j + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def exact_state(passages: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of items of a few words: number of words -> hashes, ascending, and passages."""
    bucket, found = Buckets(), {}
    for r in passages.collect():  # one block of passages
        found.setdefault(len(r["words"]), []).append((int(_run_hashes(bucket(r["words"]), len(r["words"]))[0]), r["passage"]))
    return {n: (np.array([h for h, _ in sorted(rows)], dtype=np.uint64), np.array([p for _, p in sorted(rows)], dtype=np.int64)) for n, rows in found.items()}


def exact_runs(state: dict, texts: list[np.ndarray], lone_words: int) -> Iterator[tuple[int, int, list[float], list[int], list[int]]]:
    """As ``Finder``: all runs of each text that may be one of the items of a few words."""
    for number, ids in enumerate(texts):
        for n, (hashes, passages) in state.items():
            if len(ids) < n or n < lone_words and len(ids) != n:
                continue
            own = _run_hashes(ids, n)
            met: dict[int, list[int]] = {}
            low, high = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
            for at in np.nonzero(high > low)[0].tolist():
                for p in passages[low[at]:high[at]].tolist():
                    met.setdefault(p, []).append(at)
            for p, places in met.items():
                yield number, p, [1.0] * len(places), places, [at + n for at in places]


_FOUND = "doc_id long, text_key string, passage long, cosines array<double>, firsts array<long>, lasts array<long>"


def candidates(index: DataFrame, blocks: list[tuple], exact: list[dict], idf: np.ndarray, search: Search) -> DataFrame:
    """(doc_id, text_key, passage, cosines, firsts, lasts): all windows of each document for each passage it may hold."""
    state = index.sparkSession.sparkContext.broadcast(((idf ** 2).astype(np.float32), blocks, exact))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf2, spaces, runs = state.value
        finders = [Finder((idf2, *b)) for b in spaces]
        for b in batches:
            ids, keys, texts = b["doc_id"].astype("Int64"), b["text_key"].tolist(), [np.frombuffer(w, dtype="<i4") for w in b["words"]]
            found = [x for finder in finders for x in finder(texts)] + [x for r in runs for x in exact_runs(r, texts, search.lone_words)]
            if found:
                at = [number for number, *_ in found]
                columns = dict(zip(("passage", "cosines", "firsts", "lasts"), map(list, zip(*(rest for _, *rest in found)))))
                yield pd.DataFrame({"doc_id": ids.iloc[at].array, "text_key": [keys[i] for i in at], **columns})
    met = materialise(index.mapInPandas(find, _FOUND))
    state.unpersist()
    return met


def _overlap(search: Search, *columns: str) -> Column:
    """Of a document's text with a passage and its answer: the best of all windows, one that holds the passage first."""
    @F.pandas_udf("struct<cosine:double,share:double,answered:boolean,held:boolean>")
    def of(texts: pd.Series, cosines: pd.Series, firsts: pd.Series, lasts: pd.Series, passages: pd.Series, answers: pd.Series) -> pd.DataFrame:
        rows, split, words = [], None, []
        for t, cs, fs, ls, p, a in zip(texts, cosines, firsts, lasts, passages, answers):
            if t != split:
                split, words = t, words_of(t)
            p, a, best = list(p), list(a), None
            for c, first, last in sorted(zip(cs, fs, ls), reverse=True):
                there = words[first:last]
                share, answered = common_subsequence(p, there) / len(p), bool(a) and common_subsequence(a, there) >= 0.9 * len(a)
                if len(p) < search.min_words:
                    held = there == p
                else:
                    held = share >= search.copied or share >= search.paraphrased and answered
                best = max(best or (False, -1.0, 0.0, False), (held, share, c, answered))
                if held and share == 1 and answered:
                    break
            rows.append((best[2], best[1], best[3], best[0]))
        return pd.DataFrame(rows, columns=["cosine", "share", "answered", "held"])
    return of(*map(F.col, columns))


def held_items(docs: DataFrame, benchmark: DataFrame, search: Search) -> DataFrame:
    """(doc_id, text_key, item_id, cosine, share, answered) for each row of ``docs`` (doc_id long, text) and passage in it."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, w, answer_of(t)) for i, t in zip(b["item_id"], b["text"]) for w in passages_of(t, search.max_words) if w]
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "words", "answer"])
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").mapInPandas(cut, "item_id long, words array<string>, answer array<string>")
    numbered = items.groupBy("item_id", "words", "answer").agg(F.lit(1)).select("item_id", "words", "answer", F.monotonically_increasing_id().alias("passage"))
    passages = materialise(numbered.withColumn("long", F.size("words") >= search.min_words))
    sizes = {r["long"]: r["n"] for r in passages.groupBy("long").agg(F.count("*").alias("n")).collect()}
    result = docs.sparkSession.createDataFrame([], "doc_id long, text_key string, item_id long, cosine double, share double, answered boolean")
    if not sizes:
        return result
    index = materialise(indexed(docs))
    idf = weights(document_frequencies(index), index.select("text_key").distinct().count())

    def parts(of_long: bool, size: int) -> Iterator[DataFrame]:
        n = math.ceil(sizes.get(of_long, 0) / size)
        mine = passages.where(F.col("long") == of_long)
        return (mine.where(F.pmod(F.xxhash64("passage"), F.lit(n)) == i) for i in range(n))

    def readings() -> Iterator[tuple[list, list]]:
        """Spaces and exact items of each reading of the documents, within its bytes."""
        spaces, used, runs = [], 0, [s for p in parts(False, 50 * search.block) if (s := exact_state(p))]
        for some in parts(True, search.block):
            if some.isEmpty():
                continue
            space = block_state(some, idf, search)
            spaces.append(space)
            used += space[1].nbytes + space[0].nbytes
            if used >= search.reading:
                yield spaces, runs
                spaces, used, runs = [], 0, []
        if spaces or runs:
            yield spaces, runs
    for spaces, runs in readings():
        met = candidates(index, spaces, runs, idf, search)
        keys = sized(materialise(met.select(F.col("text_key").alias("met_key")).distinct()))
        texts = materialise(docs.select(text_key().alias("of_key"), "text").join(keys, F.col("of_key") == F.col("met_key"), "left_semi").dropDuplicates(["of_key"]))
        # A text is held against a passage once, however many copies there are.
        pairs = met.dropDuplicates(["text_key", "passage"]).drop("doc_id")
        held = pairs.join(passages.withColumnRenamed("passage", "held"), F.col("passage") == F.col("held")).join(texts, F.col("text_key") == F.col("of_key"))
        sure = materialise(held.select("of_key", F.col("passage").alias("of_passage"), "item_id", _overlap(search, "text", "cosines", "firsts", "lasts", "words", "answer").alias("o")).where("o.held")
                           .select("of_key", "of_passage", "item_id", "o.cosine", "o.share", "o.answered"))
        result = result.union(met.select("doc_id", "text_key", "passage").join(sized(sure), (F.col("text_key") == F.col("of_key")) & (F.col("passage") == F.col("of_passage"))).select("doc_id", "text_key", "item_id", "cosine", "share", "answered"))
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, share, answered), a row for each document and item found in it.

    ``share`` is the part of the passage's words that stands in the document in order.  A document
    holds an item if the share is at least ``copied``, or at least ``paraphrased`` with the item's
    answer there as well.  An item of fewer than ``min_words`` words must stand there in a row, one
    of fewer than ``lone_words`` must be the whole text.  Items without words, null ones and those
    of a null id hold for nothing; null and empty texts hold nothing; equal items are found each;
    equal rows give one row, different texts of one id are searched each; documents with a null id
    are one; empty tables give an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result = held_items(rows, benchmark, search or Search())
    best = F.max(F.struct("share", "cosine", "answered")).alias("b")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.share", "b.answered")
