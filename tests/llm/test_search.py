"""Block naming, part tries and FP-tree search against brute force, with odd rows."""
import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from glossa.llm import blocknames, fptree, parttrie, queries

DOCS = "doc_id long, text string, name string, part int"
TABLES = ("documents", "embeddings", "benchmark")


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_vector_codes", "op13_lexical_search"])
def test_same_rows_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(rel.select(*columns).fetchall())


def kept_rows(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = collections.Counter()
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, order[0], len(ids), k == 0, sha) for k, i in enumerate(order))
    return out


@pytest.mark.parametrize("naming", [blocknames.Naming(), blocknames.Naming(block_bytes=4), blocknames.Naming(block_bytes=3, hot=50, part_rows=2)])
def test_naming_against_grouping(spark, naming):
    rnd = random.Random(5)
    pieces = ["abcd", "abce", "é", "\U0001F600", "x"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(12))) for _ in range(150)]
    rows = [(rnd.randrange(90), t) for t in [*texts, *texts[:40], *(["hot text"] * 120)]]
    rows += [(None, None), (None, ""), (7, None), (7, ""), (7, ""), (None, "abcd"), (1000, "y" * 100_000), (1001, "y" * 100_000), (1002, "y" * 99_999), (1003, "y" * 99_999 + "z"), (1004, "y" * 1024), (1005, "y" * 1025), (1006, "y\0"), (1007, "y")]
    got = blocknames.deduplicate(spark.createDataFrame([(*r, "n", 1) for r in rows], DOCS).repartition(5).cache(), naming)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == kept_rows(rows)


def test_nothing_to_deduplicate(spark):
    assert blocknames.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def test_walk_against_all_distances():
    rnd = np.random.default_rng(3)
    for spread in (2, 5, 400):
        parts = np.unique(rnd.integers(-spread, spread, (700, 5)), axis=0)
        entries = rnd.integers(-spread, spread, (40, 5))
        entries[7] = entries[3]
        all_of = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        codes, errors = parttrie.walk(parts, entries)
        assert (codes == all_of.argmin(axis=1)).all() and (errors == all_of.min(axis=1)).all()


def plain_codes(rows, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    d = width // 4
    cut = lambda v: [tuple(v[p * d:(p + 1) * d]) for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [collections.defaultdict(list) for _ in range(4)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                got[p][near(p, x)[1]].append(x)
        for p in range(4):
            for e, xs in got[p].items():
                books[p][e] = tuple(sum(x[j] for x in xs) // len(xs) for j in range(d))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, label, [near(p, x) for p, x in enumerate(cut(v))]) for i, v, label in kept]
    total = collections.Counter()
    for _, label, n in out:
        total[label] += sum(e for e, _ in n)
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in n), sum(e for e, _ in n), total[label], sha) for i, label, n in out)


def test_codes_against_plain_rounds(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-0.01, 0.01) for _ in range(10)], rnd.choice([0, 1, None])) for i in range(60)]
    rows += [(i, rows[3][1], 1) for i in range(100, 140)]  # a hot vector
    rows += [(5, rows[5][1], 0), (5, [0.5] * 10, 0), (None, [0.1] * 10, None), (200, None, 0), (201, [0.1] * 9 + [None], 0), (202, [float("nan")] * 10, 0), (203, [float("inf")] * 10, 0), (204, [0.1] * 9, 0), (205, [], 0), (206, [-300.0] * 10, 2)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = parttrie.compress(df, entries=9, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == plain_codes(rows, 9, 3)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.25, 0.0, 1.0], None), (1, [0.5, 0.25, 0.0, 1.0], None)]])
def test_few_vectors(spark, rows):
    got = parttrie.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [("00000000", 0, 0) for _, v, _ in rows if v is not None]


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, top=50):
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, own in {(i, tuple(dict.fromkeys(terms_of(t)))) for i, t in items}:
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [fptree.Ranking(), fptree.Ranking(seed=2, tree_docs=40, tree_terms=300, leaf_docs=2, block_terms=25), fptree.Ranking(top=3, leaf_docs=1, block_items=2)])
def test_search_against_all_scores(spark, limits):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (1 + i) for i in range(60)]
    docs = [(i, " ".join(rnd.choices(words, odds, k=rnd.randrange(1, 40)))) for i in range(300)]
    docs += [(i, "w1 W2. w1-w3") for i in range(1000, 1070)]  # equal scores
    docs += [(None, "w5 w5 w6"), (None, "w5 w5 w6"), (3, "w5 w5 w6"), (3, "w5 w5 w6"), (400, None), (401, ""), (402, " .,; "), (403, "Äö w7é É_w8 \U0001F600w9"), (404, "w10 " * 5000)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(8)] + [(20, "w1, w3! W3 w2"), (20, "w1, w3! W3 w2"), (21, None), (22, "..."), (23, "absent words"), (24, "w7é \U0001F600W9 É"), (None, "w5 w6")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, rank string, score int").repartition(3)
    got = fptree.rank_documents(d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int"), limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_ranking(docs, items, limits.top)


def test_bounds_prune_and_lose_nothing():
    rnd = np.random.default_rng(6)
    held = sorted(np.sort(rnd.choice(30, rnd.integers(1, 9), replace=False)).tolist() for _ in range(400))
    begin = np.cumsum([0, *map(len, held)])
    terms = np.concatenate([np.array(h, dtype=np.int64) for h in held])
    tf, m, w = rnd.integers(1, 5, len(terms)), rnd.integers(50, 200, len(held)), np.arange(30)[::-1].copy() * 7 + 1
    tree = fptree.Tree(terms, tf, begin, m, 30, 4)
    asked = [np.array([0, 3, 9]), np.array([29]), np.array([1, 2, 25, 28])]
    best = fptree.Best(len(asked), 5, np.zeros(len(asked), dtype=np.int64))
    scored = fptree.search(tree, list(range(len(held))), w, asked, best)
    assert scored < len(held)
    for i, own in enumerate(asked):
        best.trim(i)
        scores = [(-sum(int(fptree.worth(w[t], tf[begin[k] + held[k].index(t)], m[k])) for t in own if t in held[k]), False, k) for k in range(len(held))]
        assert best.rows[i] == sorted(s for s in scores if s[0] < 0)[:5]


def test_nothing_to_search(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert fptree.rank_documents(none, items).collect() == fptree.rank_documents(one, items.where("item_id = 2")).collect() == []
    assert [tuple(r) for r in fptree.rank_documents(one, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
