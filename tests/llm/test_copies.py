"""Near copies: a bound on differing sets, and tables that are given up."""
import os
import random
from urllib.parse import urlparse

import numpy as np

from glossa.llm import common, simhash


def test_parities_differ_in_no_more_bits_than_sets_in_members():
    rng = random.Random(5)
    for _ in range(300):
        a = {rng.getrandbits(63) for _ in range(rng.randint(0, 60))}
        b = set(rng.sample(sorted(a), rng.randint(0, len(a)))) | {rng.getrandbits(63) for _ in range(rng.randint(0, 9))}
        bits = [simhash.parity_bits(np.array(sorted(s), dtype=np.int64)) for s in (a, b)]
        assert ((bits[0] ^ bits[1]) & (1 << 64) - 1).bit_count() <= len(a ^ b)


def test_only_the_result_is_left_on_disk(spark):
    folder = urlparse(os.path.dirname(common.shared_dir(spark))).path
    held = lambda: {d for d in os.listdir(folder) if os.path.isdir(f"{folder}/{d}")}
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(reversed(words)), None]
    before = held()
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert len(held() - before) == 1
