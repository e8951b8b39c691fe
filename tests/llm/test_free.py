"""URL filter, HTML text, packing, toxicity, decontamination and near-duplicates, with odd rows."""
import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossa.llm import components, decontam, html, packing, queries, simhash, toxicity, urls

ODD = ["", None, " \n\t ", "word", "two words", "é́ \U0001F600 ünïcode", "x " * 5000, "don't DON'T 's 12,3.5 <|endoftext|> ½ İstanbul"]


def documents(spark, sf_dir, more=()):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(10**6 + i, t) for i, t in enumerate([*ODD, *more])]
    rows = [*real, *odd, odd[4], (None, "no id at all")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, start int")


# Near-duplicates

def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, sf_dir):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 30
    rows, df = documents(spark, sf_dir, [base, base.replace("lazy", "idle", 1), base.upper()])
    f = {t: fingerprint(t) for _, t in rows}
    least = {}
    for i, t in rows:
        least[f[t]] = min((x for x in (least.get(f[t]), i) if x is not None), default=None)
    parent = {x: x for x in least}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    fs = list(least)
    for k, a in enumerate(fs):
        for b in fs[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    group = collections.defaultdict(list)
    for x in fs:
        group[find(x)].append(least[x])
    root = {x: min((v for v in group[find(x)] if v is not None), default=None) for x in fs}
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == collections.Counter((i, f"{f[t]:016x}", root[f[t]]) for i, t in rows)


@pytest.mark.parametrize("max_bits", [4, 7])
def test_links_lose_none(spark, max_bits):
    rnd = random.Random(max_bits)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    values = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(10))) for s in seeds for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), max_bits).collect()]
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in values for b in values if a != b and (a ^ b).bit_count() <= max_bits}
    assert len(got) == len(want) and set(got) == want


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Packing

def test_tokens_are_those_of_whole_texts_when_chunks_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_REMEMBERED", 20)
    whole, tokens = Tokenizer.from_file(queries.tokenizer_path()), packing.ChunkTokenizer(queries.tokenizer_path())
    often = "the quick brown fox straße Éçü naïve, ÿes! don't"
    for i in range(30):
        texts = [*(t or "" for t in ODD), f"{often} w{i} {chr(97 + i % 26) * (i + 1)}, Ünder{'x' * i}"]
        assert [ids.tolist() for ids in tokens(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tokens.known) < 100
    before = tokens.known["quick"]
    tokens([" ".join(f"{'z' * j}" for j in range(1, 40))])
    tokens(["new"])
    assert tokens.known["quick"] is before


def test_packing_is_whole_and_full(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows, df = documents(spark, sf_dir)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    pieces = packing.pack(df, queries.tokenizer_path()).collect()
    covered = collections.Counter()
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == collections.Counter({i: sum(map(len, xs)) for i, xs in ids.items()})
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding at all
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


def test_classes_of_a_task():
    rnd = random.Random(5)
    bins = packing.Bins(64, 7 << 32)
    sizes = [rnd.choice([1, 2, 3, 5, 9, 17, 22, 33, 40, 64, 65, 150]) for _ in range(500)]
    for i, n in enumerate(sizes):
        bins.add(i, np.arange(n, dtype="<u4"))
    closed = len(bins.done[0])
    bins.finish()
    docs, starts, lengths, _, totals, sequences, offsets = bins.done
    held, inside = collections.defaultdict(list), collections.defaultdict(list)
    for row in zip(docs, starts, lengths, sequences, offsets, range(len(docs))):
        held[row[0]].append(row[1:3])
        inside[row[3]].append(row)
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(held[i]):
            assert start == at
            at += length
        assert at == n
    for rows in inside.values():
        used = sum(r[2] for r in rows)
        assert [r[4] for r in rows] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
        assert used == 64 if rows[0][5] < closed else used & (used - 1) == 0
        if rows[0][5] < closed and len(rows) > 2:  # k rests of one class, and the head of another
            k = 64 // rows[0][2]
            assert all(64 // r[2] == k for r in rows[:k]) and len(rows) in (k, k + 1)
    assert sum(len(x) > 1 for i, x in held.items() if sizes[i] < 64) < 0.35 * len(sizes)  # most stay whole


# URLs

def test_host_path_and_rules(spark):
    cases = [("HTTP://Blog.Example.ORG/es/x?y#z", "blog.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("x://a.org", "a.org", "", None, None),
             ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://a.com:80/fr/", "a.com:80", "/fr/", None, None), ("a.com/fr/1", "", "", None, None), (None, "", "", None, None), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("y://b.com?u=://c.org/z", "b.com", "", None, None), ("p\n://org/a\nb", "org", "/a\nb", "org/", "allow")]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://good{i}.net/fine/{i}", True) for i in range(40)] + [(f"http://spam{i}.biz/win/{i}", False) for i in range(40)], "url string, allowed boolean")
    got = {r.page_id: r for r in urls.judge_urls(df.unionByName(df.where("page_id = 1")), labelled, queries.URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    new = spark.createDataFrame([(1, "http://good99.net/fine/7"), (2, "http://spam77.biz/win/5")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(new, labelled, []).collect()} == {1: "allow", 2: "block"}
    assert urls.judge_urls(new.limit(0), labelled.limit(0), []).count() == 0


# Pages

PAGE = """<html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=1>One</a></ul></nav>
<div id="cookie-notice">We use cookies, accept them all now please.</div><article><h1>A &amp; B</h1><p>First <b>bold</b> text&nbsp;here.<br>Next line<p>Second &lt;one&gt;<aside>Related things</aside><form><label>Mail</label><button>Send</button></form><div class="comments"><p>Nice post!</p></div></article>
<div class="sidebar">Side</div><footer>&copy; Us</footer></body></html>"""


def test_page_text(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>plain text, with a full sentence in it.</p>", "x"), (1, "u", PAGE, "x"), (4, "u", "<div " * 50 + '"<' * 200, "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()]
    want = "A & B First bold text here. Next line Second <one>"
    assert got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got
    assert any(i is None and t.startswith("plain text") for i, t, _ in got)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<div class="layout-with-sidebar"><p>First paragraph, with a sentence.</p><p>Second one of text, too.</p></div>', "First paragraph, with a sentence. Second one of text, too."),
    ('<div class="has-sidebar sidebar"><article><p>First paragraph, with a sentence.</p></article><div class=sidebar>See <a href=1>this</a></div></div>', "First paragraph, with a sentence."),
    ("<article><header><h1>Title</h1><p class=byline>By me, today</p></header><p>Text here and there.</p><section class=comments><p>I like this, really.</p></section></article>", "Title Text here and there."),
    ("<p>Alone it stands, a sentence.", "Alone it stands, a sentence.")])
def test_markup_is_weighed(page, want):
    blocks = html.blocks_of(page)
    assert " ".join(b.text for b, kept in zip(blocks, html.label(blocks, html._UNTRAINED, html.CutWeights())) if kept) == want


def test_the_cut_can_turn_a_marked_block():
    # A marked block between sentences of its own kind, with weak evidence, goes with its neighbours.
    blocks = html.blocks_of("<div><p>One sentence of text, here.</p><p class=notice>Another sentence of text, there.</p><p>A third sentence of text, too.</p></div>")
    weights = html.CutWeights(capacity=1.0)
    assert html.label(blocks, html._UNTRAINED, weights) == [True, True, True]
    assert html.label(blocks, html._UNTRAINED, html.CutWeights(neighbour=0, sibling=0)) == [True, False, True]


def test_deep_pages_are_read_in_linear_time():
    import time

    began = time.process_time()
    blocks = html.blocks_of("<div>x" * 40_000 + "</b>" * 1000)
    assert len(blocks) == 40_000 and time.process_time() - began < 10


def test_pages_of_the_tables(spark, sf_dir):
    import html as entities

    got = {r.page_id: r.text for r in queries.op4_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        score = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 1.5)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda x: sum(max(v, 0) if not k else max(-v, 0) for v, k in zip(score, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html.minimum_cut(score, edges)) == pytest.approx(best)


# Toxicity

def test_ratios_against_plain_kneser_ney():
    """All counts as nested dictionaries, straight from the definition."""
    import math

    from glossa.llm import chargram as C
    rnd = random.Random(3)
    counts = [("".join(rnd.choices("abcde", k=rnd.randrange(1, 7))), rnd.randrange(3), rnd.randrange(4)) for _ in range(60)]
    top = [collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)]
    for w, t, o in counts:
        for h, c in C.grams(w):
            for k, n in ((0, t), (1, o)):
                if n:
                    top[k][h][c] += n
    # Every longer context counts once for the character behind it, level by level.
    pairs = {(h, c) for w, t, o in counts for h, c in C.grams(w)}
    lower = collections.defaultdict(collections.Counter)
    while pairs:
        for h, c in {(h, c) for h, c in pairs if h}:
            lower[h[1:]][c] += 1
        pairs = {(h[1:], c) for h, c in pairs if h}

    def low(h, c):
        rest = low(h[1:], c) if h else 1 / (1 + len(lower[""]))
        return rest if h not in lower else (max(lower[h][c] - .75, 0) + .75 * len(lower[h]) * rest) / sum(lower[h].values())

    def p(k, h, c):
        cs = top[k].get(h)
        return low(h[1:], c) if cs is None else (max(cs[c] - .75, 0) + .75 * len(cs) * low(h[1:], c)) / sum(cs.values())
    ratio = C.LikelihoodRatio(counts)
    for w in [*(w for w, *_ in counts), "zebra", "aabbccdd", "e"]:
        want = sum(math.log(p(0, h, c)) - math.log(p(1, h, c)) for h, c in C.grams(w) if h in top[0] or h in top[1])
        assert ratio(w) == pytest.approx(want)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.judge(docs, labels)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    rows = scored.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) >= 0.9
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in scored.collect())


def test_toxicity_without_labels_and_with_odd_rows(spark, sf_dir):
    rows, df = documents(spark, sf_dir)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.judge(df, none).select("predicted").distinct().collect()] == [0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.judge(df, labels).count() == len(rows)
    assert toxicity.judge(df.limit(0), labels).count() == 0


# Decontamination

def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = rnd.choices("abcd", k=rnd.randrange(1, 12)), rnd.choices("abcd", k=rnd.randrange(0, 12))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(a, b) == t[-1][-1]


def test_copies_and_paraphrases_of_items_are_found(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows, df = documents(spark, sf_dir)
    rnd = random.Random(4)
    host = [t for _, t in rows if t and 100 < len(t.split()) < 400]
    planted, k = [], 5 * 10**6
    for item, text in items[:20]:
        w, h = text.split(), rnd.choice(host).split()
        if len(w) < 12:
            continue
        some = {i for i in range(1, len(w) - 6) if i % 8 == 3}
        for version in (w, [f"changed{rnd.random()}" if i in some else x for i, x in enumerate(w)]):
            at = rnd.randrange(len(h))
            planted.append((k, " ".join([*h[:at], *version, *h[at:]]), item))
            k += 1
    more = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in planted], df.schema)
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(df.unionByName(more), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert all((i, item) in found for i, _, item in planted)
    exact = {(i, item) for i, t in rows if t and i is not None for item, text in items if text in t}
    assert exact <= found
    assert {x for x in found if x[0] < 10**6} == exact  # clean documents are left alone
    assert decontam.contaminated(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(df, spark.createDataFrame([(1, None), (2, "short one")], "item_id long, text string")).count() == 0


# The pipeline

def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t, None, None, None, "x") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, "x"), (7, "again", None, None, None, "x"), (10**6 + 50, "token=abcdefgh in a text", None, None, 25, "x")], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    docs = docs.withColumn("fp", F.lit("x")).unionByName(odd)
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= n
            n = docs.count()
    secret = spark.read.parquet(str(tmp_path / "3")).where(F.col("doc_id") == 10**6 + 50).first()
    assert secret.text == "<SECRET> in a text" and secret.n_chars == 18
    assert docs.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "3")).select("doc_id").distinct().count()


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.randrange(120, 240))
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 12):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", None, " ", "short text", "short text", "Short text"]
    sets = [frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert len(got) == len(texts)
    assert all(find(i) == find(got[i]) for i in got)  # nothing is joined that should be apart
    assert {i: find(i) for i in got} == got  # and nothing is missed
    assert simhash.near_copies(df.limit(0)).count() == 0
