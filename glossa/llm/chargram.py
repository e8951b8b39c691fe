"""Class-conditional Kneser-Ney models over the characters of words.

A word is read from its start mark to its end mark.  The highest order, which near the start is the
whole beginning of the word, is counted by class; all lower orders are continuation counts that
both classes share.  What neither class has seen often is therefore as likely in either.
"""
from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import xxhash

from .common import Memo

#: Runs of letters, lower-cased.
WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
ORDER = 5
DISCOUNT = 0.75
#: Words whose scores a worker remembers.
REMEMBERED = 150_000


def grams(word: str) -> list[tuple[str, str]]:
    s = START + word + END
    return [(s[max(0, i - ORDER + 1):i], s[i]) for i in range(1, len(s))]


class _Counts:
    """Strings to rows of numbers, by 64-bit hashes in order: a few bytes a string."""

    def __init__(self, rows: dict[str, tuple]) -> None:
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in rows], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], np.array(list(rows.values()) or [()], dtype=np.float64)[order]

    def get(self, key: str) -> list[float] | None:
        h = np.uint64(xxhash.xxh64_intdigest(key))
        i = int(self.hashes.searchsorted(h))
        return self.rows[i].tolist() if i < len(self.hashes) and self.hashes[i] == h else None


class LikelihoodRatio:
    """log p(word | toxic) - log p(word | ordinary) for any word."""

    def __init__(self, counts: list[tuple[str, float, float]]) -> None:
        """``counts``: word, times in toxic texts, times in ordinary ones."""
        top: dict[str, list[float]] = {}
        for word, toxic, ordinary in counts:
            for h, c in grams(word):
                pair = top.setdefault(h + c, [0.0, 0.0])
                pair[0] += toxic
                pair[1] += ordinary
        above: dict[str, list[float]] = {}
        for key, (t, o) in top.items():
            context = above.setdefault(key[:-1], [0.0] * 4)
            for k, n in ((0, t), (2, o)):
                context[k] += n > 0
                context[k + 1] += n
        # A shared lower order counts in how many longer contexts a character follows.
        shared: Counter = Counter()
        level = set(top)
        while level:
            longer = {key for key in level if len(key) > 1}
            shared.update(key[1:] for key in longer)
            level = {key[1:] for key in longer}
        below: dict[str, list[float]] = {}
        for key, n in shared.items():
            context = below.setdefault(key[:-1], [0.0, 0.0])
            context[0] += 1
            context[1] += n
        self.load((_Counts(top), _Counts(above), _Counts({k: (n,) for k, n in shared.items()}), _Counts(below), uuid.uuid4().hex))

    @classmethod
    def of(cls, state: tuple) -> LikelihoodRatio:
        return cls.__new__(cls).load(state)

    def load(self, state: tuple) -> LikelihoodRatio:
        """Take over plain counts, as ``state`` has them; what they score is remembered by the worker."""
        self.state = state
        self.top, self.above, self.shared, self.below, key = state
        self.steps, self.known = Memo.take("chargram", key, lambda: ({}, {}))
        self.floor = 1 / (1 + (self.below.get("") or (0, 0))[0])
        return self

    def _lower(self, h: str, c: str) -> float:
        below = self._lower(h[1:], c) if h else self.floor
        found = self.below.get(h)
        if found is None:
            return below
        kinds, n = found
        return (max((self.shared.get(h + c) or (0.0,))[0] - DISCOUNT, 0) + DISCOUNT * kinds * below) / n

    def _log_ratio(self, h: str, c: str) -> float:
        seen = self.above.get(h)
        if seen is None:
            return 0.0  # both back off to the same
        below, counts = self._lower(h[1:], c), self.top.get(h + c) or (0.0, 0.0)
        logs = [math.log((max(counts[k] - DISCOUNT, 0) + DISCOUNT * seen[2 * k] * below) / seen[2 * k + 1] if seen[2 * k + 1] else below) for k in (0, 1)]
        return logs[0] - logs[1]

    def __call__(self, word: str) -> float:
        s, steps, total = START + word + END, self.steps, 0.0
        for i in range(2, len(s) + 1):
            key = s[max(0, i - ORDER):i]
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._log_ratio(key[:-1], key[-1])
            total += step
        return total

    def features(self, text: str) -> np.ndarray:
        """Mean ratio per word, and how far single words and short passages stand out."""
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(5)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.steps) > REMEMBERED:
            self.steps.clear()
        for w in set(words):
            if w not in known:
                known[w] = self(w)
        r = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
        top = np.sort(np.partition(r, max(0, len(r) - 3))[-3:])[::-1]
        n = len(r)
        return np.array([r.mean(), r.sum() / math.sqrt(n), top[0], top.mean(), math.log(n)])
