"""Whole jobs: cases that a cut in the search would lose."""
import random

from glossa.llm import decontam, pii, secrets, simhash

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def test_copies_of_over_a_thousand_passages_are_found(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(20, 56)))) for i in range(1100)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=30) + [text] + rnd.choices(vocabulary, k=30))) for i, text in items]
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert found == {(i, i) for i, _ in items}


def test_copied_texts_and_frequent_words_keep_their_weight(spark):
    rnd = random.Random(12)
    rare, frequent = [f"w{i}" for i in range(5000)], [f"the{i}" for i in range(60)]
    items = [(0, " ".join(rnd.choices(rare, k=30))), (1, " ".join(rnd.choices(frequent, k=30)))]
    text = lambda: rnd.choices(rare, k=40) + rnd.choices(frequent, k=40)
    docs = [(i, " ".join(text())) for i in range(200)]
    copied = " ".join(text() + [items[0][1]] + text())
    docs += [(1000 + i, copied) for i in range(100)] + [(2000, " ".join(text() + [items[0][1]] + text())), (2001, " ".join(text() + [items[1][1]] + rnd.choices(rare, k=40)))]
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert found == {(1000 + i, 0) for i in range(100)} | {(2000, 0), (2001, 1)}


def test_a_run_of_one_word_does_not_hide_a_copy(spark):
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.sample(vocabulary, 25))) for i in range(30)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=200) + [text] + rnd.choices(vocabulary, k=200) + [text.split()[7]] * 32 + rnd.choices(vocabulary, k=200))) for i, text in items]
    docs += [(1000 + i, " ".join([text.split()[7]] * 400)) for i, text in items]
    rows = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i, _ in items}
    assert all(r.share == 1 and 0.45 <= r.cosine <= 1.0001 for r in rows)


def similar_groups(texts):
    """Components of the texts whose five-word shingles are similar, by all pairs."""
    sets = [frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def edited(rnd, words, vocabulary, edits):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = rnd.choice(vocabulary)
    return " ".join(words)


def test_no_near_copy_is_missed(spark):
    rnd = random.Random(14)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for length in [12, 30, 60, 60, 120, 200] * 4:
        base = rnd.choices(vocabulary, k=length)
        texts += [edited(rnd, base, vocabulary, rnd.randrange(1 + length // 40)) for _ in range(6)] + [" ".join(base[:-1])]
    line = " ".join(rnd.choices(vocabulary, k=8))
    texts += [" ".join([line, *rnd.choices(vocabulary, k=rnd.randrange(6))]) for _ in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == similar_groups(texts)


def test_thousands_of_short_pairs_at_the_limit_are_linked(spark):
    rnd = random.Random(17)
    texts = []
    for i in range(2500):  # four shingles of five are the same
        words = [f"w{rnd.randrange(10**6)}" for _ in range(9 if i % 2 else 19)]
        texts += [" ".join(words), " ".join(words[:-1] if i % 2 else words[:-3])]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_long_texts_are_compared_whole(spark):
    rnd = random.Random(15)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=1500)
        texts.append(" ".join(base))
        for cut in (1215, 1195):  # similarities of 0.81 and just below 0.8
            texts.append(" ".join(base[:cut]))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == similar_groups(texts)


def test_long_keys_are_linked(spark):
    rnd = random.Random(16)
    key = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=86)) + "=="
    late = "aB" * 50 + "cdefghijk7"
    texts = [f"account=store1 with {key} beside", f"see https://store.example.org and {late} there", f"nothing beside {key} here", "account=store1 with " + "aB" * 50]
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.weak] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert spans == {0: [("account", "account=store1"), ("mixed", key)], 1: [("endpoint", "https://store.example.org"), ("mixed", late)], 2: [], 3: []}


def test_terms_far_from_an_entity_are_found(spark):
    rnd = random.Random(17)
    vocabulary = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    prose = lambda: " ".join(rnd.choices(vocabulary, k=40))
    docs = [(i, prose()) for i in range(200)]
    docs += [(1000 + i, f"Zarquon {prose()} regards office jo@example.org desk thanks") for i in range(4)]
    docs += [(2000 + i, f"Slartib once {docs[0][1]} to x@example.org") for i in range(4)]  # copies prove nothing
    terms = {r.doc_id: {dict(docs)[r.doc_id][s.start:s.end] for s in r.term} for r in pii.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(terms[1000 + i] == {"Zarquon", "regards", "office", "desk", "thanks"} for i in range(4))
    assert not any(terms[i] for i in terms if not 1000 <= i < 1004)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    import corpus_pipeline

    rnd = random.Random(18)
    a, b, c = (" ".join(rnd.choices([f"w{i}" for i in range(3000)], k=80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (7, c), (7, b + " end"), (7, c), (None, c), (None, "one text"), (None, "one text"), (None, "another")]
    left = corpus_pipeline.near_duplicates_out(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(1, a), (2, b), (7, c), (None, "one text"), (None, "another")]))


def test_the_pipeline_runs_whole_and_over_nothing(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir).cache()
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count() and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    whole = pieces.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert all(r["doc_tokens"] == r["sum(length)"] for r in whole)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
