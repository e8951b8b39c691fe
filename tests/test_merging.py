"""Hand cases of event clusters, conflicting fields, nominal frames and mentions; pointers against a walk."""
import random

import pytest

from glossa.operators import merging
from glossa.plans import pointers
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


FRAMES = "id string, sense string, provisional boolean, is_light_verb_host boolean"
EVENTS = "id string, tense string, aspect string, confidence double, merged boolean"
PAIRS = "canonical string, secondary string"


def walked(to, order):
    out = {}
    for i in to:
        path = [i]
        while path[-1] in to and to[path[-1]] not in path:
            path.append(to[path[-1]])
        last = path[-1]
        cycle = path[path.index(to[last]):] if last in to else None
        out[i] = min(cycle, key=lambda x: (order[x], x)) if cycle else last
    return out


def test_pointers_against_a_walk(make):
    rnd = random.Random(9)
    to = {i: rnd.randrange(60) for i in range(60) if i % 3}
    to |= {1000 + i: 1001 + i for i in range(70)}  # a long chain
    to |= {2000 + i: 2000 + (i + 1) % 37 for i in range(37)} | {3000 + i: 3001 + i for i in range(20)} | {3020: 2005}  # a tail into a long cycle
    to = {i: t for i, t in to.items() if i != t}
    order = {i: (i * 7919) % 13 for i in set(to) | set(to.values())}
    got = pointers.heads(make([(i, t, order[i]) for i, t in to.items()], "id long, to long, order long"))
    assert {r.id: r.head for r in got.collect()} == walked(to, order)
    assert pointers.heads(make([], "id long, to long, order long")).collect() == []


def merge(make, pairs, frames=(), events=()):
    names = sorted({x for p in pairs for x in p})
    known = {f[0]: f for f in frames}
    stated = {e[0]: e for e in events}
    f = make([known.get(n, (n, None, None, None)) for n in names], FRAMES)
    e = make([stated.get(n, (n, None, None, 0.5, False)) for n in names], EVENTS)
    described = make([(n, n) for n in names], "frame_id string, event_id string")
    p = make(pairs, PAIRS)
    return e, merging.sense_conflicts(p, f), merging.event_merges(p, f, described, e)


def test_a_chain_of_three_has_one_head(make):
    *_, got = merge(make, [("a", "b"), ("b", "c"), ("c", "d")])
    assert rows(got.select("id", "merged_into")) == [("b", "a"), ("c", "a"), ("d", "a")]


def test_a_cycle_elects_the_most_confident(make):
    *_, got = merge(make, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x")], events=[("b", None, None, 0.9, False)])
    assert rows(got.select("id", "merged_into")) == [("a", "b"), ("c", "b"), ("x", "b")]


def test_conflicts_provisional_frames_and_merged_events_stay_apart(make):
    frames = [("a", "01", None, None), ("b", "02", None, None), ("c", "01", None, None), ("p", None, True, None)]
    _, pairs, got = merge(make, [("a", "b"), ("a", "c"), ("a", "p"), ("a", "m"), ("z", "c"), ("a", "a")], frames, [("m", None, None, 0.5, True), ("z", None, None, 0.9, False)])
    assert rows(got.select("id", "merged_into")) == [("c", "z")]  # the more confident of two
    assert rows(pairs.where("sense_conflict").select("canonical", "secondary")) == [("a", "b")]


def test_light_verbs_go_into_their_noun(make):
    e, pairs, got = merge(make, [("take", "decision"), ("decide", "decision")], [("take", "01", None, True), ("decision", "02", None, None)],
                          [("take", "PAST", "NONE", 0.9, False), ("decision", None, None, 0.5, False), ("decide", "PRESENT", None, 0.5, None)])
    assert rows(got) == [("decision", "decide", merging.ALIGNED), ("take", "decide", merging.LIGHT)]
    assert rows(merging.merged_events(e, got).select("id", "tense", "aspect", "merged")) == [("decide", "PRESENT", "NONE", False), ("decision", None, None, True), ("take", "PAST", "NONE", True)]
    refs = make([("m1", "take"), ("m2", "decision"), ("m2", "decide"), ("m3", "decide")], "mention_id string, event_id string")
    moved = merging.redirected_references(refs, got)
    assert rows(moved) == [("m1", "decide", "take", "light_verb_canonicalization", 0.85)]
    edges = make([("take", "x", "BEFORE", 0.5), ("decision", "x", "BEFORE", 0.7), ("take", "decide", "IDENTITY", 1.0)], "src string, dst string, rel_type string, confidence double")
    assert rows(merging.redirected_edges(edges, got)) == [("decide", "x", "BEFORE", 0.7)]
    assert merging.merge_diagnostics(pairs, moved, merging.merged_events(e, got)).first().asDict() == {"clusters_formed": 1, "sense_conflicts": 1, "em_redirected": 1, "events_merged": 2, "events_unmerged": 1, "lv_merges": 1}


def test_fields_keep_the_loser(make):
    events = make([("a", "POS", None), ("b", "POS", "spacy"), ("c", None, None), ("d", "NEG", None), ("e", "POS", None)], "id string, polarity string, polarity_source string")
    said = make([("a", "NEG"), ("b", "NEG"), ("b", "POS"), ("c", "NEG"), ("d", "NEG"), ("e", None), ("gone", "NEG")], "event_id string, polarity string")
    got = {r.id: r for r in merging.field_conflicts(events, said, "polarity").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].value, got["a"].source, got["a"].conflict_value, got["a"].conflict_source, got["a"].conflict_flag) == ("POS", "temporal_phase", "NEG", "event_enrichment", True)
    assert (got["b"].value, got["b"].authority_tier, got["b"].conflict_value) == ("POS", "secondary", "NEG")
    assert (got["c"].value, got["c"].authority_tier, got["c"].conflict_flag) == ("NEG", "secondary", False)
    assert (got["d"].value, got["d"].source, got["d"].conflict_flag, got["d"].conflict_value) == ("NEG", "temporal_phase", False, None)
    new = {r.id: r for r in merging.with_resolved_field(events, merging.field_conflicts(events, said, "polarity"), "polarity").collect()}
    assert new["c"].polarity == "NEG" and new["e"].polarity == "POS" and new["a"].polarity_conflict_value == "NEG" and new["e"].polarity_conflict_flag is None
    with pytest.raises(ValueError):
        merging.field_conflicts(events, said, "tense")


def test_nominal_frames_that_become_events(make):
    frames = make([(1, "n1", "NOMBANK", "Merger ", 0.6, None), (1, "n2", "NOMBANK", "merger", 0.5, None), (1, "n3", "NOMBANK", "table", 0.9, None), (1, "n4", "NOMBANK", "merger", 0.9, True), (1, "n5", "NOMBANK", "merger", 0.9, None), (1, "n6", "NOMBANK", "merger", 0.9, None), (1, "v", "PROPBANK", "merge", 0.9, None)],
                  "doc_id long, id string, framework string, pred string, sense_conf double, provisional boolean")
    tokens = make([(f"n{i}", i * 10 + k) for i in range(1, 7) for k in (1, 0)], "frame_id string, tok_index_doc long")
    args = make([(f"n{i}", "arg1") for i in range(1, 6)] + [("n6", "ARG2")], "frame_id string, role string")
    described, aligned, nouns = make([("n5", "e")], "frame_id string, event_id string"), make([("n2", "v")], PAIRS), make([("merger",)], "lemma string")
    got = merging.nominal_events(frames, tokens, args, described, aligned, nouns)
    assert rows(got.select("frame_id", "text", "start_tok", "end_tok", "confidence")) == [("n1", "merger", 10, 11, 0.7), ("n2", "merger", 20, 21, 0.8)]
    import hashlib
    assert {r.frame_id: r.id for r in got.collect()}["n1"] == int(hashlib.md5(b"nombank:1:10:11:merger").hexdigest(), 16) % 10**9
    assert rows(merging.nominal_events(frames, tokens, args, described, aligned).select("frame_id")) == [("n2",), ("n3",)]


def test_mentions_and_their_bounds(make):
    tokens = make([(1, 0, 0, "VBD", "Drag", "dragged"), (1, 0, 1, "RP", "down", "down"), (1, 0, 2, "JJ", "big", "big"), (1, 0, 3, "NN", "car", "car"), (1, 0, 4, "NN", "bomb", "bombs"), (1, 1, 5, "VB", None, "go"), (1, 1, 6, "NN", "x", "x")],
                  "doc_id long, sent_idx int, tok_index_doc long, pos string, lemma string, text string")
    events = make([(1, "e0", 0, 0, "p0"), (1, "e4", 4, 4, "p4"), (1, "e5", 5, 5, "p5"), (1, "old", 6, 6, "x")], "doc_id long, id string, start_tok long, end_tok long, pred string")
    m = merging.event_mentions(events, tokens, make([("old",)], "event_id string"))
    assert rows(m.select("id", "pred", "start_tok", "end_tok", "token_id")) == [("1_e0_mention", "drag down", 0, 1, "em_1_0_1"), ("1_e4_mention", "bomb", 4, 4, "em_1_4_4"), ("1_e5_mention", "p5", 5, 5, "em_1_5_5")]
    deps = make([(1, 0, 1, "prt"), (1, 4, 3, "compound"), (1, 4, 2, "amod"), (1, 5, 9, "prt")], "doc_id long, head_tok long, dep_tok long, type string")
    got = merging.event_bounds(events, deps, tokens)
    assert rows(got.select("id", "start_tok", "end_tok", "pred")) == [("e0", 0, 1, "Drag down"), ("e4", 2, 4, "big car bombs"), ("e5", 5, 5, "p5"), ("old", 6, 6, "x")]


def test_components_against_union_find(make):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 290)] + [(400, 400 + i) for i in range(1, 30)] + [(500, 500)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in pointers.components(make(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert pointers.components(make([], "a long, b long")).collect() == []


def test_many_short_cycles_take_few_rounds(make, monkeypatch):
    tables = []
    monkeypatch.setattr(pointers, "checkpointed", lambda df, f=pointers.checkpointed: tables.append(f(df)) or tables[-1])
    to = {i: i + 1 if i % 3 < 2 else i - 2 for i in range(3000)}
    got = pointers.heads(make([(i, t, -i) for i, t in to.items()], "id long, to long, order long"))
    assert {r.id: r.head for r in got.collect()} == {i: i - i % 3 + 2 for i in to}
    assert len(tables) <= 6


def test_merges_split_texts_before_they_follow_pointers(spark, sf_dir):
    from glossa import registry

    for name in ("event_merges", "merged_events", "redirected_references"):
        assert "posexplode" not in registry.get(name).run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
