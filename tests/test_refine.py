"""Argument graphs against loops, snapshots of metrics, fused entities, families of rules, wide noun phrases."""
import random

import pytest

from glossa.operators import argument_graph as G
from glossa.operators import entity_fusion, families, nominals, regressions
from glossa.plans.assign import assigned
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


EDGES, NODES = "doc_id long, src string, dst string, role string", "doc_id long, id string, label string"
DEPS = "doc_id long, head_tok long, dep_tok long, type string"
TOKENS = "doc_id long, sent_idx int, tok_index_doc long, text string, lemma string, pos string"


def on_cycles(edges):
    """Edges between nodes that both come from and lead to cycles, by peeling."""
    left = set(edges)
    while True:
        keep = {(s, t) for s, t in left if any(b == s for _, b in left) and any(a == t for a, _ in left)}
        if keep == left:
            return left
        left = keep


def test_graph_against_loops(make):
    rnd = random.Random(2)
    graphs = {d: sorted({(f"n{rnd.randrange(7)}", f"n{rnd.randrange(7)}", rnd.choice("AB")) for _ in range(rnd.randrange(3, 9))}) for d in range(20)}
    e = make([(d, *x) for d, xs in graphs.items() for x in xs], EDGES)
    n = make([(d, f"n{i}", f"l{i % 4}") for d in graphs for i in range(6)], NODES)  # n6 dangles
    wanted = [(d, f"n{i}", f"n{(i + d) % 7}") for d in graphs for i in range(3)]

    def ways(edges, at, end, nodes, roles, depth):
        for s, t, r in edges:
            if s == at:
                if t == end:
                    yield tuple([*nodes, t]), tuple([*roles, r])
                elif depth > 1:
                    yield from ways(edges, t, end, [*nodes, t], [*roles, r], depth - 1)
    want = sorted((d, s, t, len(roles), nodes, roles) for d, s, t in wanted for nodes, roles in ways(graphs[d], s, t, [s], [], 3))
    got = sorted((r.doc_id, r.start, r.end, r.length, tuple(r.nodes), tuple(r.roles)) for r in G.paths(e, make(wanted, "doc_id long, start string, end string")).collect())
    assert got == want

    def near(edges, start, depth):
        hops, front = {start}, {start}
        for _ in range(depth):
            front = {t for s, t, _ in edges if s in front} - hops
            hops |= front
        return hops
    chains = {(d, "n0", r, f"l{int(t[1:]) % 4}") for d, xs in graphs.items() for s, t, r in xs if s in near(xs, "n0", 2) and t != "n6"}
    assert set(map(tuple, G.role_chains(n, e, make([(d, "n0") for d in graphs], "doc_id long, start string")).collect())) == chains
    want = [(d, sum(s == "n6" for s, *_ in xs), sum(t == "n6" for _, t, _ in xs), bool(on_cycles({(s, t) for s, t, _ in xs}))) for d, xs in graphs.items()]
    assert rows(G.violations(n, e)) == sorted(want, key=repr)
    assert set(map(tuple, G.cyclic_edges(e).collect())) == {(d, s, t) for d, xs in graphs.items() for s, t in on_cycles({(s, t) for s, t, _ in xs})}


def test_graph_of_frames(make):
    frames, args = make([(1, "f", "sell")], "doc_id long, id string, pred string"), make([(1, "a", "f", "ARG0", "he"), (1, "b", "f", "ARG1", "car")], "doc_id long, id string, frame_id string, role string, head string")
    nodes, edges = G.build(frames, args, make([("a", "E1")], "argument_id string, entity_id string"))
    assert rows(nodes.select("id", "kind", "label")) == [("a", "entity", "he"), ("b", "argument", "car"), ("f", "predicate", "sell")]
    assert rows(edges) == [(1, "f", "a", "ARG0"), (1, "f", "b", "ARG1")]
    assert G.violations(nodes, edges.where("false")).collect() == []


def test_snapshots(make):
    a = make([("x", 1.0), ("y", 0.0), ("z", 100.0), ("gone", 3.0), ("null", None)], "metric string, value double")
    b = make([("x", 1.0), ("y", 2.0), ("z", 100.5), ("new", 4.0), ("null", None)], "metric string, value double")
    assert rows(regressions.determinism(a, b, 0.01)) == [("gone", 3.0, None, None, None), ("new", None, 4.0, None, None), ("y", 0.0, 2.0, 2.0, None)]
    assert rows(regressions.determinism(a, b).select("metric")) == [("gone",), ("new",), ("y",), ("z",)]
    assert regressions.determinism_verdict(regressions.determinism(a, a)).first().asDict() == {"conclusive": True, "num_violations": 0, "summary": "Deterministic"}
    broken = regressions.gate(a, b, {"z": regressions.Limit(total=100), "y": regressions.Limit(increase=1), "gone": regressions.Limit(0, 0), "absent": regressions.Limit(0, 0), "new": regressions.Limit(3, 3)})
    assert rows(broken.select("reason")) == [("new",), ("new_increase",), ("y_increase",), ("z",)]
    q = lambda x: make([(x,)], "quality double")
    assert tuple(regressions.gate_verdict(q(0.9), q(0.8), broken, 0.05).select("passed", "reasons").first()) == (False, "new,new_increase,overall_quality,y_increase,z")
    assert regressions.gate_verdict(q(0.9), q(0.86), broken.limit(0), 0.05).first().passed
    r = regressions.regression(q(0.9), q(0.88)).first()
    assert r.is_regression and r.is_significant and r.percent_change == pytest.approx(-2.2222222)
    assert regressions.regression(q(0.0), q(0.5)).first().percent_change == 0.0
    p = lambda x: make(x, "phase string, score double")
    assert rows(regressions.phase_regressions(p([("a", 0.5), ("b", 0.5)]), p([("a", 0.25), ("b", 0.6), ("c", -0.5)]))) == [("a", 0.5, 0.25, -0.25), ("c", 0.0, -0.5, -0.5)]


def test_rivals_are_fused(make):
    e = make([(1, "d", 5, "DATE", "dbpedia", "Q1", 0.5, True), (1, "s", 5, "DATE", "spacy", None, None, None), (1, "x", 5, "DATE", None, "Q2", 0.9, None), (1, "p", 5, "PERSON", "dbpedia", None, None, None), (1, "q", 5, "PERSON", "spacy", None, None, None), (1, "n", None, "DATE", "spacy", None, None, None), (1, "m", None, "DATE", "spacy", None, None, None)],
             "doc_id long, id string, head_tok long, type string, source string, kb_id string, score double, is_mention boolean")
    lost = entity_fusion.rivals(e)
    assert rows(lost) == [("d", "s"), ("x", "s")]
    got = {r.id: (r.kb_id, r.score, r.is_mention) for r in entity_fusion.fused(e, lost).collect()}
    assert set(got) == {"s", "p", "q", "n", "m"} and got["s"] == ("Q1", 0.5, True)
    assert rows(entity_fusion.relinked(make([("d", "E"), ("x", "E"), ("s", "E"), ("p", "F")], "id string, entity_id string"), lost)) == [("p", "F"), ("s", "E")]


def test_heads_fill_gaps_only(make):
    e = make([(1, "a", 0, 2, None, None), (1, "b", 0, 2, "kept", None), (1, "c", 3, 3, None, None), (1, "d", 0, 3, None, None), (1, "e", 3, 3, "z", 9)], "doc_id long, id string, start_tok long, end_tok long, head string, head_tok long")
    tokens = make([(1, 0, i, w, w, "NN") for i, w in enumerate(["w0", "w1", "w2", "w3"])], TOKENS)
    deps = make([(1, 1, 0, "amod"), (1, 1, 2, "x"), (1, 1, 1, "ROOT"), (1, 9, 3, "y")], DEPS)
    got = {r.id: (r.head, r.head_tok) for r in entity_fusion.filled_heads(e, tokens, deps).collect()}
    assert got == {"a": ("w1", 1), "b": ("kept", 1), "c": ("w3", 3), "d": ("w1", 1), "e": ("z", 9)}
    twice = make([(1, "b", 0, 2, "DATE", None, 2.0), (1, "a", 0, 2, "DATE", "Q", None), (1, "c", 0, 2, "TIME", None, None)], "doc_id long, id string, start_tok long, end_tok long, type string, kb_id string, score double")
    assert rows(entity_fusion.unique_mentions(twice).select("id", "kb_id", "score")) == [("a", "Q", 2.0), ("c", None, None)]


@pytest.fixture(scope="module")
def sentence(make):
    """The chairman of Acme , a large bank , sued Bob , Carl and Dan ."""
    words = "The/DT chairman/NN of/IN Acme/NNP ,/, a/DT large/JJ bank/NN ,/, sued/VBD Bob/NNP ,/, Carl/NNP and/CC Dan/NNP ./.".split()
    tokens = make([(1, 0, i, *(lambda w, p: (w, w.lower(), p))(*w.split("/"))) for i, w in enumerate(words)], TOKENS)
    deps = make([(1, 9, 9, "ROOT"), (1, 9, 1, "nsubj"), (1, 1, 0, "det"), (1, 1, 2, "prep"), (1, 2, 3, "pobj"), (1, 3, 4, "punct"), (1, 3, 7, "appos"), (1, 7, 5, "det"), (1, 7, 6, "amod"), (1, 3, 8, "punct"), (1, 9, 10, "dobj"), (1, 10, 11, "punct"), (1, 10, 12, "conj"), (1, 10, 13, "cc"), (1, 10, 14, "conj")], DEPS)
    return tokens, deps


def test_wide_phrases(make, sentence):
    tokens, deps = sentence
    assert rows(nominals.wider_appositions(deps, tokens).select("id", "head", "value")) == [("app_wide_1_3_7", "Acme", "Acme , a large bank")]
    assert rows(nominals.wider_conjunctions(deps, tokens).select("id", "head", "value")) == [("conj_wide_1_10_14", "Bob", "Bob , Carl and Dan")]
    deep = make([(1, i, i + 1, "x") for i in range(10)], DEPS)
    flat = make([(1, 0, i, "w", "w", "NN") for i in range(11)], TOKENS)
    assert rows(nominals.subtrees(make([(1, 0), (1, 9)], "doc_id long, root long"), deep, flat)) == [(1, 0, 0, 6), (1, 9, 9, 10)]
    loop = make([(1, 0, 1, "x"), (1, 1, 0, "x")], DEPS)
    assert rows(nominals.subtrees(make([(1, 0)], "doc_id long, root long"), loop, flat)) == [(1, 0, 0, 1)]


def test_families_run_twice_like_once(make, sentence):
    tokens, deps = sentence
    tables = {"tokens": tokens, "deps": deps, "entities": make([(1, 3, 3, False), (1, 14, 14, True)], "doc_id long, start_tok long, end_tok long, stale boolean"),
              "mentions": make([(1, "m", 0, 1, 1, "The chairman", "NOM", "given")], "doc_id long, id string, start_tok long, end_tok long, head_tok long, value string, syntactic_type string, source string"),
              "events": make([(1, "e", 9, None, None, "POS")], "doc_id long, id string, start_tok long, tense string, aspect string, polarity string")}
    once = families.BOOK.run_all(tables)
    twice = families.BOOK.run_all(once)
    for name in ("mentions", "events"):
        assert rows(once[name]) == rows(twice[name].select(*once[name].columns)) and once[name].count()
    assert rows(once["mentions"].select("id", "start_tok", "end_tok")) == [("app_1_7", 7, 7), ("app_wide_1_3_7", 3, 7), ("conj_wide_1_10_14", 10, 14), ("m", 1, 1)]


def test_a_book_of_ones_own(make):
    book = families.RuleBook()

    @book.rule("first")
    def one(t):
        return {"t": families.added(t["t"], t["t"].select(F.lit("new").alias("id"), F.lit(1).alias("x")))}

    @book.rule("second", "other")
    def two(t):
        return {"t": t["t"].withColumn("x", F.lit(7))}
    assert list(book.rule_names()) == [("first", "one"), ("second", "other")]
    t = {"t": make([("a", 2)], "id string, x int")}
    assert rows(book.run_family(t, "first")["t"]) == [("a", 2), ("new", 1)]
    assert rows(book.run_all(book.run_all(t))["t"]) == [("a", 7), ("new", 7)]
    with pytest.raises(ValueError):
        book.run_family(t, "third")
    with pytest.raises(ValueError):
        book.rule("first", "one")(one)


def test_assignment_is_the_greedy_choice(make):
    rnd = random.Random(1)
    pairs = sorted({(g, f"l{rnd.randrange(12)}", f"r{rnd.randrange(12)}") for g in range(5) for _ in range(40)})
    weight = {p: rnd.randrange(6) for p in pairs}
    want, used = set(), set()
    for g, a, b in sorted(pairs, key=lambda p: (weight[p], p)):
        if not {(g, a), (g, b)} & used:
            used |= {(g, a), (g, b)}
            want.add((g, a, b))
    order = F.struct("w", "a", "b")
    got = assigned(make([(*p, weight[p]) for p in pairs], "g long, a string, b string, w int"), ["g"], "a", "b", order, order)
    assert set(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["nominal_family_mentions", "wider_appositions", "wider_conjunctions"])
def test_nominal_rules_read_texts_no_more_than_once_a_table(spark, sf_dir, name):
    from glossa import registry

    assert "posexplode" not in registry.get(name).run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
