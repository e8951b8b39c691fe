"""Hand cases of event enrichment and link upkeep."""
import pytest

from glossa.operators import enrich


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


EVENTS = "doc_id long, id string, start_tok long, pos string, low_confidence boolean, merged boolean"
DEPS = "doc_id long, head_tok long, dep_tok long, type string"
TIMEX = "doc_id long, id string, start_tok long, end_tok long, type string, value string, text string"
LINKS = "src string, dst string"


def test_core_is_any_mention(make):
    m = make([(1, "a", "say", "VBD"), (1, "a", "Rise fast", "VBD"), (1, "b", "Said so", "VBD"), (1, "c", "market", "NN"), (1, "d", "market", "VB"), (1, "e", None, None)], "doc_id long, event_id string, pred string, pos string")
    assert rows(enrich.core_events(m)) == [(1, "a", True), (1, "b", False), (1, "c", False), (1, "d", True), (1, "e", True)]


def test_light_verb_hands_on_its_tense(make):
    m = make([(1, "v", 2, "make", "VBD", "PAST", "NONE"), (1, "n", 4, "decision", "NN", None, "PERFECTIVE"), (1, "w", 6, "price", "NN", None, None)],
             "doc_id long, event_id string, start_tok long, pred string, pos string, tense string, aspect string")
    d = make([(1, 2, 4, "dobj"), (1, 2, 6, "dobj"), (1, 4, 2, "dobj")], DEPS)
    lemmas = make([(1, 2, "make"), (1, 4, "decision")], "doc_id long, tok_index_doc long, lemma string")
    assert rows(enrich.light_verbs(m, d, lemmas)) == [(1, "v", "n", "PAST", "PERFECTIVE")]


def test_participants_follow_one_merge_and_keep_what_stands(make):
    p = make([("x", "m", "ARG0", 0.8), ("y", "m", "ARG1", None), ("y", "h", "ARG1", 0.9), ("z", "m2", "ARG0", 0.5)], "src string, event_id string, type string, confidence double")
    g = make([("m", True, "h"), ("h", False, None), ("m2", True, "m")], "id string, merged boolean, merged_into string")
    (row,) = enrich.canonical_participants(p, g).collect()
    assert (row.src, row.event_id, row.type, row.transferred_from) == ("x", "h", "ARG0", "m") and row.confidence == pytest.approx(0.76)


def test_predicate_links_take_the_nearest_event_of_the_argument(make):
    f = make([(1, "f", 1, "Prevent", "PROPBANK"), (1, "g", 2, "cause", "NOMBANK")], "doc_id long, id string, head_tok long, pred string, framework string")
    a = make([("f", "a1", 5, "ARG1"), ("f", "a2", 5, "ARGM-TMP")], "frame_id string, id string, head_tok long, role string")
    t = make([("a1", k) for k in (3, 4, 5, 6)] + [("a2", 8)], "argument_id string, tok long")
    e = make([(1, "m", 1, "VB", False, False), (1, "s", 4, "NN", False, False), (1, "u", 6, "NN", False, False), (1, "gone", 5, "NN", False, True), (1, "o", 8, "NN", False, False)], EVENTS)
    assert rows(enrich.predicate_links(f, a, t, e, enrich.CAUSAL)) == [(1, "m", "s", "PREVENT", 0.60)]


def test_time_rules_respect_links_and_directions(make):
    e = make([(1, "e1", 1, "VBD", False, False), (1, "e2", 2, "VBD", True, False), (1, "e3", 3, "NN", False, False)], EVENTS)
    t = make([(1, "t8", 8, 8, "DATE", "1987", "last week"), (1, "t9", 9, 9, "DATE", "2007-W32", "Last week")], TIMEX)
    d = make([(1, 1, 8, "advmod"), (1, 1, 9, "advmod"), (1, 2, 8, "advmod"), (1, 1, 9, "npadvmod"), (1, 8, 3, "compound"), (1, 8, 1, "compound")], DEPS)
    none, back = make([], LINKS), make([("t8", "e1")], LINKS)
    assert rows(enrich.adverbial_timex(e, d, t, none)) == [(1, "e1", "t8", "IS_INCLUDED", 0.85)] == rows(enrich.adverbial_timex(e, d, t, back))
    assert rows(enrich.last_week_timex(e, d, t, none)) == [(1, "e1", "t9", "IS_INCLUDED", 0.85)]
    assert [r[1] for r in rows(enrich.governing_timex(e, d, t, none))] == ["e1", "e3"]
    assert [r[1] for r in rows(enrich.governing_timex(e, d, t, back))] == ["e3"]


def test_nominal_preposition_both_ways(make):
    e = make([(1, "loss", 3, "NN", False, True), (1, "fell", 4, "VBD", False, False)], EVENTS)
    d = make([(1, 3, 4, "prep"), (1, 4, 5, "pobj")], DEPS)
    w = make([(1, 4, "of")], "doc_id long, tok_index_doc long, lemma string")
    t = make([(1, "t", 5, 5, "DATE", "2007", "2007")], TIMEX)
    assert rows(enrich.nominal_preposition_timex(e, d, w, t, make([], LINKS))) == [(1, "loss", "t", "event_timex", "IS_INCLUDED", 0.78), (1, "loss", "t", "timex_event", "INCLUDES", 0.78)]


def test_relation_key_turns_and_inverts(make):
    r = make([(1, "timex", 4, "event", 9, "includes"), (1, "event", 9, "event", 2, "BEFORE"), (1, "event", 2, "event", 9, None), (1, "event", 9, "timex", 2, "SIMULTANEOUS")],
             "doc_id long, src_kind string, src_tok long, dst_kind string, dst_tok long, rel_type string")
    assert rows(enrich.relation_key(r)) == [(1, "event", 2, "event", 9, ""), (1, "event", 2, "event", 9, "AFTER"), (1, "event", 9, "timex", 2, "SIMULTANEOUS"), (1, "event", 9, "timex", 4, "IS_INCLUDED")]


def test_purge_preview_and_orphans(make):
    g = make([("inverse_consistency", "AFTER"), ("xml_e2e_seed", "BEFORE"), ("xml_e2e_seed", "SIMULTANEOUS"), (None, "BEFORE")], "rule_id string, rel_type string")
    assert {r.rule_id: (r.purged, r.kept) for r in enrich.purge_counts(g).collect()} == {"inverse_consistency": (1, 0), "xml_e2e_seed": (1, 1), None: (0, 1)}
    m = make([(1, 1, "pro"), (2, 1, "nom"), (3, 1, "NAM")], "id long, doc_id long, syntactic_type string")
    assert rows(enrich.orphan_mentions(m, make([(7, 2)], "src long, dst long"))) == [(1, 1, False), (1, 2, True)]


def test_labels(make):
    from pyspark.sql import functions as F

    from glossa.functions import labels

    d = make([(1, " nominal", ["Entity", "TEvent"], "Motion", "Goal"), (2, "pro", ["TIMEX", "TEvent"], "Motion", "Owner"), (3, None, ["Signal"], None, "Goal"), (4, "x", None, "Possession", "Owner")], "i long, t string, l array<string>, f string, e string")
    t = labels.syntactic_type(F.col("t"))
    got = d.select("i", t, labels.former_syntactic_type(t), labels.node_kind(F.col("l")), labels.framenet_role(F.col("f"), F.col("e")))
    assert rows(got) == [(1, "NOM", "NOMINAL", "event", "recipient"), (2, "PRO", "PRO", "timex", None), (3, "", "NOMINAL", None, None), (4, "", "NOMINAL", None, "agent")]
    assert rows(make([(" gpe ",), ("Person",), ("date",), (None,)], "l string").select("l", labels.entity_class(F.col("l")))) == sorted([(" gpe ", "LOC"), ("Person", "PER"), ("date", "DATE"), (None, "")], key=repr)
