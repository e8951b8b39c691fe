"""Small cases for primitives and for operators that SQL cannot express."""
import random

import pytest
from pyspark.sql import functions as F

from glossa import registry
from glossa.functions import ids, scores, timeml
from glossa.operators import evaluation, provenance, quality, spans, tlinks
from glossa.plans import prims


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, iso", [("2024-01-05", "2024-01-05"), ("2024", "2024"), ("20240105", "2024-01-05"), ("05/01/2024", "05/01/2024"), ("5 January 2024", "2024-01-05"), ("January 5, 2024", "2024-01-05"), ("Aug. 5 2007", "Aug. 5 2007"), ("Sept 5,  2007", "2007-09-05"), ("August 2007", "2007-08"), ("2007 aug", "2007-08"), ("200708", "2007-08"), ("2007081", "2007-08-1"), ("Foo 5 2007", "Foo 5 2007"), (" soon ", "soon"), (None, "")])
def test_iso_date(spark, raw, iso):
    assert one(spark, timeml.iso_date(F.lit(raw).cast("string"))) == iso


@pytest.mark.parametrize("tense, aspect, rel", [("PRESENT", "NONE", "VAGUE"), ("PRESENT", None, "VAGUE"), ("PRESENT", "PERFECTIVE", "BEFORE"), ("PRESENT", "PROGRESSIVE", "IS_INCLUDED"), ("PAST", "PROGRESSIVE", "BEFORE"), ("FUTURE", "PROGRESSIVE", "AFTER")])
def test_relation_to_the_creation_date(spark, tense, aspect, rel):
    assert one(spark, tlinks.dct_relation(F.lit(tense), F.lit(aspect).cast("string"))) == rel


def test_nominal_events_link_all_near_expressions(spark):
    e = spark.createDataFrame([(1, 0, "e", 5, False, False), (1, 0, "merged", 5, False, True)], "doc_id long, sent_idx int, id string, start_tok long, low_confidence boolean, merged boolean")
    t = spark.createDataFrame([(1, 0, "near", 6, "DATE"), (1, 0, "far", 14, "DATE"), (1, 0, "edge", 13, "SET"), (1, 0, "span", 7, "DURATION"), (1, 1, "other", 6, "TIME")], "doc_id long, sent_idx int, id string, start_tok long, type string")
    assert rows(tlinks.nominal_in_sentence(e, t).select("event_id", "timex_id", "distance")) == [("e", "edge", 8), ("e", "near", 1)]


@pytest.mark.parametrize("raw, name", [("before", "BEFORE"), (" overlap ", "SIMULTANEOUS"), ("measure", "DURING"), ("", "VAGUE"), (None, "VAGUE"), ("odd", "VAGUE")])
def test_relation_type(spark, raw, name):
    assert one(spark, timeml.relation_type(F.lit(raw).cast("string"))) == name


def test_roles_and_confidence(spark):
    r = one(spark, scores.role(F.lit("C-R-ARG1-PRD")))
    assert (r.canonical, r.is_continuation, r.is_relative, r.predicative) == ("ARG1", True, True, True)
    assert one(spark, scores.weighted_confidence(F.expr("map('syntax', 1.0D, 'srl', 0.0D, 'odd', 0.3D)"))) == pytest.approx(0.5)
    assert one(spark, scores.lemma_similarity(F.lit("take off"), F.lit("take"))) == pytest.approx(0.9)
    assert one(spark, scores.calibrated(F.lit(0.5))) == pytest.approx(0.5)


def test_entity_id_is_the_same_in_every_document(spark):
    assert one(spark, ids.entity_id(F.lit("http://kb/x:Paris"), F.lit("LOC"))) == one(spark, ids.entity_id(F.lit("other/Paris"), F.lit("LOC")))
    assert one(spark, ids.entity_id(F.lit(" New  York "), F.lit("LOC"))) == one(spark, ids.entity_id(F.lit("new york"), F.lit("loc")))


def test_nearest_against_brute_force(spark):
    rnd = random.Random(3)
    left = [(d, rnd.randrange(400), i) for i, d in enumerate(rnd.choices("ab", k=60))]
    right = [(d, rnd.randrange(400), 1000 + i) for i, d in enumerate(rnd.choices("ab", k=60))]
    got = prims.nearest(spark.createDataFrame(left, "d string, x long, i long"), spark.createDataFrame(right, "d string, y long, j long"), ["d"], ["i"], "x", "y", 9, F.col("j"))
    want = [(i, min((abs(x - y), j) for dd, y, j in right if dd == d and abs(x - y) <= 9)) for d, x, i in left if any(dd == d and abs(x - y) <= 9 for dd, y, _ in right)]
    assert rows(got.select("i", "distance", "j")) == sorted((i, a, j) for i, (a, j) in want)


@pytest.mark.parametrize("policy, value, confidence", [("overwrite", "new", 0.9), ("keep", "old", 0.5), ("higher", "new", 0.9), ("create", "old", 0.5)])
def test_upsert_policies(spark, policy, value, confidence):
    now = spark.createDataFrame([(1, "old", 0.5), (2, "only", 0.1)], "k long, v string, confidence double")
    new = spark.createDataFrame([(1, "new", 0.9), (3, "made", 0.2)], "k long, v string, confidence double")
    assert rows(prims.upsert(now, new, ["k"], policy)) == [(1, value, confidence), (2, "only", 0.1), (3, "made", 0.2)]


def test_reachable_keeps_the_fewest_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1)], "src long, dst long")
    got = prims.reachable(e, spark.createDataFrame([(1,)], "node long"), 2)
    assert rows(got) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]


def test_detach_and_suppress(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2, False), (2, 2, False)], "src long, dst long, suppressed boolean")
    n, e = prims.detach(nodes, edges, spark.createDataFrame([(1,)], "id long"))
    assert rows(n) == [(2,)] and rows(e) == [(2, 2, False)]
    s = prims.suppress(edges, edges.where("src = dst"), ["src", "dst"], "test", F.lit("loop"))
    assert rows(s) == [(1, 2, False, None, None), (2, 2, True, "test", "loop")]


def test_bio_spans(spark):
    tags = ["B-A", "I-A", "O", "I-B", "B-B", "I-B"]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(tags)], "doc_id long, seq long, pos long, tag string")
    assert rows(spans.bio_spans(df).select("label", "start_tok", "end_tok")) == [("A", 0, 1), ("B", 3, 3), ("B", 4, 5)]


def test_span_filter_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(d, f"s{d}_{i}", a, a + rnd.randrange(6)) for d in range(3) for i in range(30) for a in [rnd.randrange(60)]]
    want = []
    for d in range(3):
        kept = []
        for s in sorted((x for x in data if x[0] == d), key=lambda x: (x[2] - x[3], x[2], x[1])):
            if all(s[3] < k[2] or k[3] < s[2] for k in kept):
                kept.append(s)
        want += kept
    assert rows(spans.non_overlapping(spark.createDataFrame(data, "doc_id long, span_id string, start_tok long, end_tok long"))) == sorted(want)


def test_relaxed_pairs_are_one_to_one_and_greedy(spark, sf_dir):
    got = registry.get("relaxed_pairs").run(spark, sf_dir).collect()
    assert got and len({r.gold_id for r in got}) == len({r.pred_id for r in got}) == len(got)
    g = spark.createDataFrame([(1, "g1", 0, 3), (1, "g2", 2, 5)], "doc_id long, id string, start_tok long, end_tok long")
    p = spark.createDataFrame([(1, "p1", 2, 4), (1, "p2", 0, 2)], "doc_id long, id string, start_tok long, end_tok long")
    assert rows(evaluation.relaxed_pairs(g, p, 0.3).select("gold_id", "pred_id")) == [("g1", "p2"), ("g2", "p1")]


def test_token_alignment(spark):
    t = lambda ws: spark.createDataFrame([(1, i, w) for i, w in enumerate(ws)], "doc_id long, tok_index_doc long, text string")
    assert rows(evaluation.token_alignment(t("abcd"), t("abxd")).select("pred_tok", "gold_tok")) == [(0, 0), (1, 1), (3, 3)]


def test_decisions_and_checks(spark):
    d = lambda e, i, a, b, p="authority": one(spark, provenance.decision(F.lit(e).cast("string"), F.lit(i).cast("string"), F.lit(a), F.lit(b), p))
    assert [d(None, "x", 0, 1), d("x", "x", 0, 1), d("x", "y", 0, 1), d("x", "y", 1, 0), d("x", "y", 0, 1, "coexist"), d("x", None, 0, 1)] == ["insert", "noop", "replace", "keep", "coexist", "noop"]
    counts = spark.createDataFrame([("a", 5)], "metric string, item_count long")
    c = quality.checks(counts, {"a": 3, "b": 1}, {"a": 4})
    assert rows(c.select("label", "kind", "passed")) == [("a", "maximum", False), ("a", "minimum", True), ("b", "minimum", False)]
    assert tuple(quality.gate(c).first()) == (False, 2)


def test_closure_of_nothing_is_nothing(spark):
    e = spark.createDataFrame([], "src long, dst long, rel string, confidence double, suppressed boolean")
    assert tlinks.identity_closure(e).count() == 0


def test_closure_rounds_against_brute_force(spark):
    rnd = random.Random(9)
    data = list({(rnd.randrange(9), rnd.randrange(9), rnd.choice(["IDENTITY", "BEFORE", "AFTER"])): rnd.randrange(1, 10) / 10 for _ in range(16)}.items())
    e = spark.createDataFrame([(*k, c, False) for k, c in data], "src long, dst long, rel string, confidence double, suppressed boolean")
    known, want = dict(data), {}
    for r in range(1, 4):
        made = {}
        for (a, b, t), c in known.items():
            for (x, y, u), d in known.items():
                for rel in [u] * (t == "IDENTITY") + [t] * (u == "IDENTITY"):
                    if b == x and a != y and (a, y, rel) not in known:
                        made[a, y, rel] = max(made.get((a, y, rel), 0), round((c + d) / 2 + 1e-9, 3))
        known |= made
        want |= {k: (c, r) for k, c in made.items()}
    got = {(r.src, r.dst, r.rel): (r.confidence, r.closure_round) for r in tlinks.identity_closure(e, 3).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-3 for k in want)
