"""Harmonic packing of token streams.

Every document is tokenised once.  What exceeds whole capacities is its rest.  A rest longer than
capacity / (k + 1) and not longer than capacity / k is of class k, and a bin of class k takes k of
them.  The gap that they leave is shorter than any rest of the class, so it takes the head of the
next one, whose tail is classed anew; every bin is thus full, and most rests stay whole.  Each task
fills its own bins, one open bin per class, without a shuffle.  What is open in the end is laid out
in a row and cut into full bins and a last run, which is cut into powers of two: there is no padding.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: Chunks whose ids a worker remembers.
_REMEMBERED = 500_000
#: Characters that are tokenised at a time.
_SLICE = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkTokenizer:
    """Ids of whole texts from the ids of their chunks between blanks, tabs and line feeds.

    The vocabulary drops white space, lower-cases and never merges letters with other characters, so
    the ids of the chunks, and within a chunk of its letters and what follows them, are the text's
    ids in a row.  Both recur; new runs of letters reach the tokenizer many at a time.
    """

    #: Letters whose lower case and normal form are plain, then marks other than the apostrophe.
    _PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # A task has one core: threads of the library would add their own memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # Runs of lower-case letters are words already: the patterns and normal forms would find nothing to do.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case where that surely is what the tokenizer does first."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text if "<|" in text else text.lower()

    def _learn(self, runs: list[str]) -> None:
        """Ids of runs of lower-case letters: each is a word, so its last id is the next that ends a word."""
        ids = np.array(self.words.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u2")
        to = 2 * (np.nonzero(self.ends[ids])[0] + 1)
        if len(to) != len(runs):
            raise ValueError("the vocabulary has no word ends")
        raw, to = ids.tobytes(), to.tolist()
        self.known.update(zip(runs, (raw[at:end] for at, end in zip([0, *to], to))))

    def _single(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            self.known[c] = np.array(e.ids, dtype="<u2").tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [self._folded(t).replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > _REMEMBERED:
            # What came first is what recurs most.
            known = self.known = dict(islice(known.items(), _REMEMBERED // 2))
        new = set().union(*chunks).difference(known)
        runs = {c for c in new if c.isalpha() and c.isascii() and c.islower()}
        mixed = {c: (m[1].lower(), m[2]) for c in new.difference(runs) if (m := self._PLAIN.fullmatch(c))}
        runs.update(w for w, _ in mixed.values() if w not in known)
        if runs:
            self._learn(list(runs))
        alone = {t for _, t in mixed.values()}.union(new).difference(mixed)
        self._single(list(alone.difference(known)))
        known.update([(c, known[w] + known[t]) for c, (w, t) in mixed.items()])
        return [np.frombuffer(b"".join(map(known.__getitem__, cs)), dtype="<u2") for cs in chunks]


def slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows with about ``_SLICE`` characters, which bounds a task's memory."""
    some, held, size = [], [], 0
    for i, t in zip(ids, texts):
        some.append(i)
        held.append(t or "")
        size += len(held[-1])
        if size >= _SLICE:
            yield some, held
            some, held, size = [], [], 0
    if some:
        yield some, held


class Bins:
    """The open bins of one task.  A piece is (document, start, ids, ids of the document).

    ``done`` holds closed bins as columns: documents, starts, lengths, checksums, sizes of the
    documents, bins, offsets.
    """

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.room: dict[int, int] = {}
        self.done: list[list] = [[] for _ in range(7)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, c, at = len(ids), self.capacity, 0
        while n - at >= c:
            self._close([(doc_id, at, ids[at:at + c], n)])
            at += c
        while at < n:
            k = c // (n - at)
            held, room = self.open.setdefault(k, []), self.room.get(k, c)
            if len(held) < k:
                held.append((doc_id, at, ids[at:], n))
                self.room[k] = room - (n - at)
                at = n
            else:
                held.append((doc_id, at, ids[at:at + room], n))
                at += room
                self.room[k] = 0
            if not self.room[k]:
                self._close(held)
                del self.open[k], self.room[k]

    def finish(self) -> None:
        """Close what is open, the longest rests first."""
        row, room = [], self.capacity
        for k in sorted(self.open):
            for doc_id, at, ids, n in self.open[k]:
                while len(ids):
                    row.append((doc_id, at, ids[:room], n))
                    room -= len(row[-1][2])
                    at, ids = at + len(row[-1][2]), ids[len(row[-1][2]):]
                    if not room:
                        self._close(row)
                        row, room = [], self.capacity
        self.open.clear()
        self.room.clear()
        left = self.capacity - room
        for size in (1 << j for j in range(self.capacity.bit_length() - 2, -1, -1) if left >> j & 1):
            part, need = [], size
            while need:
                doc_id, at, ids, n = row.pop(0)
                part.append((doc_id, at, ids[:need], n))
                if len(ids) > need:
                    row.insert(0, (doc_id, at + need, ids[need:], n))
                need -= len(part[-1][2])
            self._close(part)

    def _close(self, pieces: list[tuple]) -> None:
        docs, starts, lengths, sums, sizes, bins, offsets = self.done
        at = 0
        for doc_id, start, ids, n in pieces:
            docs.append(doc_id)
            starts.append(start)
            lengths.append(len(ids))
            sums.append(zlib.crc32(ids.tobytes()))
            sizes.append(n)
            bins.append(self.next_id)
            offsets.append(at)
            at += len(ids)
        self.next_id += 1

    def take(self) -> list[list]:
        """The closed bins so far, which are given up."""
        done, self.done = self.done, [[] for _ in range(7)]
        return done


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two.  A null or empty text is the end id alone.  Repeated rows and
    null ids are packed like others; an empty table gives an empty result; further columns of
    ``docs`` are ignored.  sequence_id is the number of the task (upper bits) and of its bin.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = Memo.take("tokens", tokenizer_path, lambda: ChunkTokenizer(tokenizer_path)), Bins(capacity, TaskContext.get().partitionId() << 32)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in bins.take()], names=names)
        for rows in batches:
            for some, texts in slices(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                for doc_id, ids in zip(some, tokens(texts)):
                    own = np.empty(len(ids) + 1, dtype="<u4")
                    own[:-1] = ids
                    own[-1] = end_id
                    bins.add(doc_id, own)
                yield batch()
        bins.finish()
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, PIECES)
