"""Hand cases of mention attributes and of links that are inferred or given up."""
import pytest

from glossa.operators import link_upkeep, mention_attributes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


COLUMNS = "doc_id long, id string, event_id string, start_tok long, pos string, form string, pred string, modality string, tense string, aspect string, polarity string, certainty string, time string, special_cases string, clause_type string, scope_type string"


@pytest.fixture(scope="module")
def got(spark):
    make = spark.createDataFrame
    blank = dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")])
    ms = [dict(blank, id="may", modality="may"), dict(blank, id="must", modality="must", certainty=None), dict(blank, id="kept", modality="may", certainty="CERTAIN", time="UNDERSPECIFIED", polarity="NEG"),
          dict(blank, id="to", start_tok=2, tense="INFINITIVE"), dict(blank, id="start", start_tok=4, tense="INFINITIVE"), dict(blank, id="noun", pos="NNS", tense="PAST", aspect="HABITUAL"), dict(blank, id="adj", pos="JJ", tense="PAST", aspect="odd"),
          dict(blank, id="fear", start_tok=5, pos="VERB", tense="PRESPART", pred="Fear", aspect="PROGRESSIVE"), dict(blank, id="said"), dict(blank, id="not"), dict(blank, id="cue", clause_type="COMPLEMENT"), dict(blank, id="of_event", form="it Will rain")]
    mentions = make([tuple(dict(m, doc_id=1, event_id="e_" + m["id"]).values()) for m in ms], COLUMNS)
    events = make([("e_of_event", "PERFECTIVE", "NEG", None), ("e_may", None, None, "NON_FUTURE")], "id string, aspect string, polarity string, time string")
    tokens = make([(1, 0, 1, "to", "TO"), (1, 0, 2, "sell", "VB"), (1, 0, 3, "to", "TO"), (1, 1, 4, "buy", "VB"), (1, 1, 5, "fear", "VBG"), (1, 1, 6, "That", "IN")], "doc_id long, sent_idx int, tok_index_doc long, lemma string, pos string")
    frames = make([("f1", "said"), ("f2", "not"), ("f3", "cue"), ("f4", "may")], "frame_id string, mention_id string")
    arguments = make([("f1", "ARGM-DSP", "that"), ("f2", "ARGM-NEG", "not"), ("f2", "ARGM-CAU", None), ("f3", "ARGM-TMP", "Until"), ("f3", "ARG0", "until")], "frame_id string, role string, head string")
    m = mention_attributes.enriched(mentions, events, tokens, frames, arguments)
    return {r.id: r for r in m.collect()}, mention_attributes.synced_time(events, m)


def test_certainty_and_time(got):
    m, events = got
    assert [m[i].certainty for i in ("may", "must", "kept", "to", "said")] == ["POSSIBLE", "PROBABLE", "CERTAIN", "POSSIBLE", "CERTAIN"]
    assert [m[i].time for i in ("to", "start", "kept", "of_event")] == ["FUTURE", "NON_FUTURE", "UNDERSPECIFIED", "FUTURE"]  # the word before counts within the sentence only
    assert rows(events.select("id", "time")) == [("e_may", "NON_FUTURE"), ("e_of_event", "FUTURE")]


def test_clauses_and_scopes(got):
    m, _ = got
    assert [(m[i].clause_type, m[i].scope_type) for i in ("said", "not", "cue", "may", "noun")] == [("COMPLEMENT", "REPORTED_SCOPE"), ("SUBORDINATE", "NEGATION_SCOPE"), ("COMPLEMENT", "TEMPORAL_SCOPE"), ("MAIN", "LOCAL_SCOPE"), (None, None)]
    assert m["cue"].temporal_cues == ["until"] and m["may"].temporal_cues == [] and m["noun"].temporal_cues is None


def test_tense_aspect_polarity(got):
    m, _ = got
    assert [(m[i].tense, m[i].aspect) for i in ("noun", "adj", "fear", "of_event", "may")] == [("NONE", "NONE"), ("NONE", "UNDERSPECIFIED"), ("PRESENT", None), (None, "PERFECTIVE"), (None, "UNDERSPECIFIED")]
    assert [m[i].polarity for i in ("kept", "of_event", "not", "may")] == ["NEG", "NEG", "NEG", "POS"]


def test_factuality(got):
    m, _ = got
    assert {i: (m[i].factuality, m[i].factuality_confidence) for i in ("not", "said", "may", "cue")} == {"not": ("NEGATED", 0.8), "said": ("REPORTED", 0.74), "may": ("HYPOTHETICAL", 0.68), "cue": ("ASSERTED", 0.7)}


LINKS = "src string, dst string, rel_type string, rule_id string, confidence double"


def test_inferred_links(spark):
    links = spark.createDataFrame([("a", "t", "BEFORE", "x", 1.0), ("t", "b", "BEFORE", "x", 1.0), ("t", "c", "BEFORE", "x", 1.0), ("a", "c", "VAGUE", "x", 1.0), ("a", "u", "IS_INCLUDED", "x", 1.0), ("u", "b", "BEFORE", "x", 1.0), ("u", "d", "BEFORE", "x", 1.0), ("u", "a", "BEFORE", "x", 1.0), ("b", "v", "AFTER", "x", 1.0), ("v", "a", "AFTER", "x", 1.0), ("v", "low", "AFTER", "x", 1.0)], LINKS)
    events = spark.createDataFrame([("a", None), ("b", False), ("c", False), ("d", False), ("low", True)], "id string, low_confidence boolean")
    assert rows(link_upkeep.inferred(links, events)) == [("a", "b", "BEFORE", 0.72, "ga01_transitive_before"), ("a", "d", "BEFORE", 0.65, "ga01_included_before"), ("b", "a", "AFTER", 0.72, "ga01_transitive_after")]


def test_purges(spark):
    links = spark.createDataFrame([("a", "b", "BEFORE", "xml_e2e_seed", 1.0), ("a", "c", "SIMULTANEOUS", "xml_e2e_seed", 1.0), ("a", "d", "BEFORE", "case6_dct_anchor", 1.0), ("a", "e", "BEFORE", "ga01_included_before", 1.0), ("a", "f", "BEFORE", None, None)], LINKS)
    kept, counts = link_upkeep.purge(links, link_upkeep.given_up())
    assert rows(kept.select("dst")) == [("c",), ("f",)] and rows(counts) == [("inferences", 1), ("rules", 1), ("seeds", 1)]
    same, shadow = link_upkeep.purge(links, link_upkeep.given_up(), shadow_only=True)
    assert same.count() == 5 and rows(shadow) == rows(counts)
    assert rows(link_upkeep.purge(links.limit(0), link_upkeep.given_up())[1]) == [("inferences", 0), ("rules", 0), ("seeds", 0)]
