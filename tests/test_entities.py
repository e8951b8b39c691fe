"""Hand cases of parser rows and of links from arguments to entities."""
import pytest

from glossa.operators import entity_links as L
from glossa.sources import parses as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def parsed(make):
    """Two sentences, a blank at the head of the second: John paid $5 . / _ He left today"""
    words = [(0, 0, "John", "NNP", "nsubj", 1), (0, 5, "paid", "VBD", "ROOT", 1), (0, 10, "$", "$", "nmod", 3), (0, 11, "5", "CD", "dobj", 1), (0, 13, ".", ".", "punct", 1), (1, 14, "\n", "_SP", "dep", 6), (1, 15, "He", "PRP", "nsubj", 7), (1, 18, "left", "VBD", "ROOT", 7), (1, 23, "today", "NN", "npadvmod", 7)]
    return make([(1, s, i, idx, t, t.lower(), tag, "X", dep, head, t == "He", tag == ".", t == "\n") for i, (s, idx, t, tag, dep, head) in enumerate(words)],
                "doc_id long, sent_idx int, tok_index_doc long, idx long, text string, lemma string, tag string, pos string, dep string, head long, is_stop boolean, is_punct boolean, is_space boolean")


def test_tokens_and_dependencies(parsed):
    t = P.tokens(parsed)
    assert rows(t.where("sent_idx = 1").select("id", "end_char", "tok_index_sent", "is_stop")) == [("1_1_15", 17, 1, True), ("1_1_18", 22, 2, False), ("1_1_23", 28, 3, False)]
    assert rows(P.next_tokens(t).where("sent_idx = 1").select("src", "dst")) == [("1_1_15", "1_1_18"), ("1_1_18", "1_1_23")]
    assert rows(P.lemma_links(t).select("lemma")) == [("$",), ("5",), ("john",), ("left",), ("paid",), ("today",)]
    assert ("1_0_11", "1_0_10", "nmod") in rows(P.dependencies(parsed).select("src", "dst", "type")) and P.dependencies(parsed).count() == 8


SPANS = "doc_id long, start long, end long, root long, label string, text string, kb_id string, score double"


def test_chunks_and_entities(make, parsed):
    t = P.tokens(parsed)
    chunks = P.noun_chunks(make([(1, 0, 1, 0, "", "John", None, None), (1, 0, 1, 0, "", "John", None, None), (1, 6, 7, 6, "NP", "He", None, None), (1, 3, 3, 3, "NP", "", None, None)], SPANS), t)
    assert rows(chunks.select("id", "type", "syntactic_type", "start_char")) == [("nc_1_0_0_0", "NOUN_CHUNK", "NAM", 0), ("nc_1_6_6_6", "NP", "PRO", 15)]
    assert rows(P.attached_tokens(chunks, t).select("token_id")) == [("1_0_0",), ("1_1_15",)]
    spans = make([(1, 0, 1, 0, "PERSON", "John", "Q1", 0.9), (1, 2, 4, 3, "MONEY", "$5", "", None), (1, 3, 4, 3, "CARDINAL", "5", "", None), (1, 8, 9, 8, "DATE", "today", None, None), (1, 6, 7, 6, "ORG", "He", "", 0.3)], SPANS)
    ne = P.named_entities(spans, t)
    assert rows(ne.select("id", "token_id", "ent_class", "kb_id", "score")) == [("1_0_0_PERSON", "1_0_0", "PER", "Q1", 0.9), ("1_6_6_ORG", "1_6_6", "ORG", None, None)]
    assert rows(P.value_mentions(spans, t).select("type", "value", "start_tok", "end_tok", "confidence")) == [("MONEY", "$5", 2, 3, 0.7)]  # the longer span wins
    assert rows(P.timex_candidates(spans, t).select("type", "value", "source", "confidence")) == [("DATE", "today", "spacy", 0.6)]
    old = make([(1, "u1", "1_0_0_PERSON", "gone", True), (1, "u2", "other", "stays", False), (2, "u3", "far", "untouched", False)], "doc_id long, uid string, id string, value string, stale boolean")
    got = {r.uid: r for r in P.upserted_entities(old, ne).collect()}
    assert (got["u1"].value, got["u1"].stale) == ("John", False) and got["u2"].stale and not got["u3"].stale and len(got) == 4


ARGUMENTS = "doc_id long, id string, role string, head_tok long, head_pos string, head string, syntactic_type string, complement_tok long, complement string, complement_text string, start_tok long, end_tok long"


def test_arguments_get_entities(make):
    a = make([(1, "a", "ARG0", 1, "IN", "of", "NOMINAL", 2, "people", "Some People!", 1, 2), (2, "b", "ARG1", 5, "IN", "of", "NOMINAL", 6, "people", "some people", 5, 6), (1, "c", "ARG1", 9, "NN", "car", "NOMINAL", None, None, None, None, None), (1, "d", "ARG1", 9, "NN", "car", "NOMINAL", None, None, None, None, None),
              (1, "e", "ARG0", 7, "PRP", "he", "PRO", 3, "x", "x", 7, 7), (1, "f", "ARGM-LOC", 12, "NN", "town", "NOMINAL", 13, "y", "y", 12, 13), (1, "g", "ARG0", 20, "NNP", "Acme", "NAM", 21, "z", "z", 20, 20), (1, "h", "ARG2", 31, "CD", "5", None, None, None, None, 30, 31)], ARGUMENTS)
    named = make([(1, "n1", "ORG", 20, 20, 20), (1, "n2", "ORG", 21, 21, 21), (1, "m", "MONEY", 30, 30, 31), (1, "p", "PERCENT", 9, 9, 9), (1, "q", "PERSON", 3, 3, 3)], "doc_id long, id string, type string, head_tok long, start_tok long, end_tok long")
    links = make([("g", "n1", "NamedEntity"), ("c", "E", "Entity")], "argument_id string, target_id string, target_kind string")
    entities, made = L.complement_entities(a, named, links)
    assert rows(entities) == [("entity_somepeople", "NOMINAL", "people", 2)] and rows(made.select("argument_id", "target_id")) == [("a", "entity_somepeople"), ("b", "entity_somepeople")]
    entities, made = L.new_entities(a, named.where("id <> 'p'"))
    assert rows(entities.select("id", "head", "source_argument")) == [("nominal_1_9_9", "car", "c")] and rows(made.select("argument_id")) == [("c",), ("d",)]
    assert rows(L.numeric_links(a, named, make([("m", "V5")], "id string, value_id string"), links)) == [("d", "p", "NamedEntity"), ("h", "V5", "VALUE")]
    ants = L.antecedent_links(make([(1, "x", 20), (1, "y", 99)], "doc_id long, id string, head_tok long"), named)
    assert rows(ants) == [("x", "n1")]
    assert rows(L.pronoun_links(a, make([(1, "k", 7), (1, "l", 9)], "doc_id long, id string, head_tok long"), make([("k", "x"), ("l", "x")], "mention_id string, antecedent_id string"), ants)) == [("e", "n1", "NamedEntity")]
    flat = L.flattened(links, make([("n1", "E1"), ("zz", "E2")], "id string, entity_id string"))
    assert rows(flat) == [("c", "E", "Entity"), ("g", "E1", "Entity"), ("g", "n1", "NamedEntity")]
    assert rows(L.cleaned(flat)) == [("c", "E", "Entity"), ("g", "E1", "Entity")] and rows(L.cleaned(links)) == rows(links)
