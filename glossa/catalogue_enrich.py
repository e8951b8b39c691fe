"""Registered queries on event enrichment by word lists, further link rules and link upkeep, each beside its SQL."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import labels
from .operators import enrich, events
from .registry import Views, query


def _in(words: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_CORE = f"NOT ((m.pos LIKE 'VB%' AND m.pred IN {_in(enrich.WEAK_VERBS)}) OR (m.pos LIKE 'NN%' AND m.pred IN {_in(enrich.WEAK_NOUNS)}))"
_MENTIONS = "m AS (SELECT e.doc_id, e.id AS event_id, e.start_tok, l.lemma AS pred, e.pos, e.tense, e.aspect FROM g_tevent e JOIN g_lemma l ON l.doc_id = e.doc_id AND l.tok_index_doc = e.start_tok)"
_DESCRIBED = "u AS (SELECT DISTINCT e.doc_id, u.frame_id, e.id AS event_id FROM (SELECT doc_id, id AS frame_id, head_tok FROM g_frame UNION ALL SELECT doc_id, frame_id, head_tok FROM g_frame_argument) u JOIN g_tevent e ON e.doc_id = u.doc_id AND e.start_tok = u.head_tok)"
_FREE = "NOT EXISTS (SELECT 1 FROM g_link k WHERE k.src = e.id AND k.dst = t.id) AND NOT EXISTS (SELECT 1 FROM g_link k WHERE k.src = t.id AND k.dst = e.id)"
_USABLE = "NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true)"
_BOTH = "SELECT doc_id, event_id, timex_id, 'event_timex' AS direction, 'IS_INCLUDED' AS rel, CAST({0} AS DOUBLE) AS confidence FROM p UNION ALL SELECT doc_id, event_id, timex_id, 'timex_event', 'INCLUDES', CAST({0} AS DOUBLE) FROM p"


def _mentions(v: Views) -> DataFrame:
    lemma = v("g_lemma").select("doc_id", F.col("tok_index_doc").alias("start_tok"), F.col("lemma").alias("pred"))
    return v("g_tevent").select("doc_id", F.col("id").alias("event_id"), "start_tok", "pos", "tense", "aspect").join(lemma, ["doc_id", "start_tok"])


def _described(v: Views) -> DataFrame:
    return events.frame_events(v("g_frame"), v("g_frame_argument"), v("g_tevent"))


@query("event_core_flags", f"WITH {_MENTIONS} SELECT doc_id, event_id, bool_or({_CORE}) AS is_core FROM m GROUP BY 1, 2")
def event_core_flags(v: Views) -> DataFrame:
    """EV-CORE: events of the core, by word lists."""
    return enrich.core_events(_mentions(v))


@query("light_verb_merges", f"""WITH {_MENTIONS} SELECT w.doc_id, w.event_id, m.event_id AS merged_into, coalesce(m.tense, w.tense) AS tense, coalesce(m.aspect, w.aspect) AS aspect FROM m JOIN g_dep d ON d.doc_id = m.doc_id AND d.dep_tok = m.start_tok AND d.type IN ('dobj','obj','pobj') AND d.head_tok <> d.dep_tok
JOIN m w ON w.doc_id = d.doc_id AND w.start_tok = d.head_tok WHERE w.pred IN {_in(enrich.LIGHT_VERBS)} AND {_CORE}""")
def light_verb_merges(v: Views) -> DataFrame:
    """EV-LIGHT: light verbs and the events they go into."""
    return enrich.light_verbs(_mentions(v), v("g_dep"), v("g_lemma"))


@query("canonical_participants", """WITH p AS (SELECT a.id AS src, e.id AS event_id, a.role AS type, f.confidence FROM g_frame_argument a JOIN g_frame f ON f.id = a.frame_id JOIN g_tevent e ON e.doc_id = f.doc_id AND e.start_tok = f.head_tok),
n AS (SELECT p.src, g.merged_into AS event_id, p.type, round(coalesce(p.confidence, 0.65) * 0.95, 9) AS confidence, p.event_id AS transferred_from, row_number() OVER (PARTITION BY p.src, g.merged_into ORDER BY p.confidence DESC, p.event_id) AS rn FROM p JOIN g_merge g ON g.id = p.event_id AND g.merged JOIN g_merge h ON h.id = g.merged_into AND NOT h.merged
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.event_id = g.merged_into)) SELECT src, event_id, type, confidence, transferred_from FROM n WHERE rn = 1""")
def canonical_participants(v: Views) -> DataFrame:
    """EV-CANON: participants handed on by merged events."""
    f = v("g_frame").join(v("g_tevent").select("doc_id", F.col("start_tok").alias("head_tok"), F.col("id").alias("event_id")), ["doc_id", "head_tok"]).select(F.col("id").alias("frame_id"), "event_id", "confidence")
    p = v("g_frame_argument").select("frame_id", F.col("id").alias("src"), F.col("role").alias("type")).join(f, "frame_id").drop("frame_id")
    return enrich.canonical_participants(p, v("g_merge")).withColumn("confidence", F.round("confidence", 9))


def _class_sql(classes: dict) -> str:
    case = lambda pick: "CASE " + " ".join(f"WHEN l.lemma IN {_in(words)} THEN {pick(name, weight)}" for name, (weight, words) in reversed(classes.items())) + " END"
    every = _in(w for _, words in classes.values() for w in words)
    return f"""WITH x AS (SELECT e.doc_id, e.id AS event_id, s.id AS sub_id, {case(lambda n, w: f"'{n}'")} AS link_type, CAST({case(lambda n, w: w)} AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY a.id, e.id ORDER BY abs(s.start_tok - a.head_tok), s.start_tok, s.id) AS rn
FROM g_frame f JOIN g_lemma l ON l.doc_id = f.doc_id AND l.tok_index_doc = f.head_tok AND l.lemma IN {every} JOIN g_tevent e ON e.doc_id = f.doc_id AND e.start_tok = f.head_tok AND NOT e.merged JOIN g_frame_argument a ON a.frame_id = f.id AND a.role IN ('ARG1','ARG2')
JOIN g_tevent s ON s.doc_id = f.doc_id AND s.start_tok BETWEEN a.head_tok - 1 AND a.head_tok + 2 AND NOT s.merged AND s.id <> e.id WHERE f.framework = 'PROPBANK') SELECT doc_id, event_id, sub_id, min(link_type) AS link_type, arg_min(confidence, link_type) AS confidence FROM x WHERE rn = 1 GROUP BY 1, 2, 3"""


def _predicate_links(v: Views, classes: dict) -> DataFrame:
    """Arguments are taken to reach from one token before their head to two behind it."""
    lemma = v("g_lemma").select("doc_id", F.col("tok_index_doc").alias("head_tok"), "lemma")
    frames = v("g_frame").drop("pred").join(lemma, ["doc_id", "head_tok"]).withColumnRenamed("lemma", "pred")
    tokens = v("g_frame_argument").select(F.col("id").alias("argument_id"), F.explode(F.sequence(F.col("head_tok") - 1, F.col("head_tok") + 2)).alias("tok"))
    return enrich.predicate_links(frames, v("g_frame_argument"), tokens, v("g_tevent"), classes)


@query("causal_predicate_links", _class_sql(enrich.CAUSAL))
def causal_predicate_links(v: Views) -> DataFrame:
    """EV-CLINK-PRED: causal links by the predicate's class."""
    return _predicate_links(v, enrich.CAUSAL)


@query("subordinating_predicate_links", _class_sql(enrich.SUBORDINATING))
def subordinating_predicate_links(v: Views) -> DataFrame:
    """EV-SLINK-PRED: subordinating links by the predicate's class."""
    return _predicate_links(v, enrich.SUBORDINATING)


_CLASS = "CASE " + " ".join(f"WHEN frame IN {_in(f'{w}.01' for w in words)} THEN '{name}'" for name, words in enrich.FRAME_CLASSES.items()) + " ELSE 'OCCURRENCE' END"


@query("event_class_from_frames", f"WITH {_DESCRIBED} SELECT doc_id, event_id, {_CLASS} AS event_class FROM (SELECT u.doc_id, u.event_id, min(concat(l.lemma, '.01')) AS frame FROM u JOIN g_frame f ON f.id = u.frame_id JOIN g_lemma l ON l.doc_id = f.doc_id AND l.tok_index_doc = f.head_tok JOIN g_tevent e ON e.id = u.event_id AND e.start_tok % 3 <> 0 GROUP BY 1, 2) x")
def event_class_from_frames(v: Views) -> DataFrame:
    """GA-03: classes of events without one."""
    lemma = v("g_lemma").select("doc_id", F.col("tok_index_doc").alias("head_tok"), F.concat("lemma", F.lit(".01")).alias("frame"))
    return enrich.event_class(v("g_frame").join(lemma, ["doc_id", "head_tok"]), _described(v), v("g_tevent").withColumn("class", F.expr("CASE WHEN start_tok % 3 = 0 THEN 'STATE' END")))


@query("nominal_events_without_verb", """SELECT e.doc_id, e.id AS event_id, round(coalesce(f.confidence, 0.5) * 0.6, 9) AS confidence FROM g_tevent e JOIN g_frame f ON f.doc_id = e.doc_id AND f.head_tok = e.start_tok JOIN g_token k ON k.doc_id = e.doc_id AND k.tok_index_doc = e.start_tok
WHERE NOT e.low_confidence AND e.pos LIKE 'NN%' AND k.pos IN ('NN','NNS') AND k.lemma NOT IN (SELECT lemma FROM g_token WHERE pos = 'VBD')""")
def nominal_events_without_verb(v: Views) -> DataFrame:
    """GA-02B: nominal events whose word is no verb anywhere."""
    e = v("g_tevent").join(v("g_frame").select("doc_id", F.col("head_tok").alias("start_tok"), "confidence"), ["doc_id", "start_tok"])
    return enrich.nominal_without_verb(e, v("g_token"), v("g_token").where("pos = 'VBD'")).withColumn("confidence", F.round("confidence", 9))


@query("frame_alignment_gaps", f"""WITH {_DESCRIBED}, f AS (SELECT u.*, l.lemma, f.framework FROM u JOIN g_frame f ON f.id = u.frame_id JOIN g_token l ON l.doc_id = f.doc_id AND l.tok_index_doc = f.head_tok) SELECT DISTINCT a.doc_id, a.frame_id AS verb_frame, b.frame_id AS noun_frame, CAST(0.7 AS DOUBLE) AS confidence
FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.event_id = a.event_id AND b.lemma = a.lemma AND b.framework = 'NOMBANK' WHERE a.framework = 'PROPBANK' AND NOT EXISTS (SELECT 1 FROM g_aligned k WHERE k.verb_frame = a.frame_id AND k.noun_frame = b.frame_id)""")
def frame_alignment_gaps(v: Views) -> DataFrame:
    """GA-06: frames of one event and lemma that are not aligned."""
    return enrich.alignment_gaps(v("g_frame"), _described(v), v("g_aligned"))


@query("governing_timex_links", f"""SELECT DISTINCT e.doc_id, e.id AS event_id, t.id AS timex_id, 'INCLUDES' AS rel, CAST(0.75 AS DOUBLE) AS confidence FROM g_dep_times d JOIN g_tevent e ON e.doc_id = d.doc_id AND e.start_tok = d.dep_tok JOIN g_timex t ON t.doc_id = d.doc_id AND t.start_tok = d.head_tok
WHERE d.type IN {_in(enrich.TIME_DEPENDENCIES)} AND d.head_tok <> d.dep_tok AND t.type IN ('DATE','SET','TIME') AND {_USABLE} AND {_FREE}""")
def governing_timex_links(v: Views) -> DataFrame:
    """TL-20A: time expressions that govern events."""
    return enrich.governing_timex(v("g_tevent"), v("g_dep_times"), v("g_timex"), v("g_link"))


@query("adverbial_timex_links", f"""SELECT DISTINCT e.doc_id, e.id AS event_id, t.id AS timex_id, 'IS_INCLUDED' AS rel, CAST(0.85 AS DOUBLE) AS confidence FROM g_dep_times d JOIN g_tevent e ON e.doc_id = d.doc_id AND e.start_tok = d.head_tok JOIN g_timex t ON t.doc_id = d.doc_id AND t.start_tok = d.dep_tok
WHERE d.type = 'advmod' AND d.head_tok <> d.dep_tok AND regexp_full_match(t.value, '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?') AND {_USABLE} AND NOT EXISTS (SELECT 1 FROM g_link k WHERE k.src = e.id AND k.dst = t.id)""")
def adverbial_timex_links(v: Views) -> DataFrame:
    """TL-24: calendar dates as adverbs of events."""
    return enrich.adverbial_timex(v("g_tevent"), v("g_dep_times"), v("g_timex"), v("g_link"))


@query("last_week_links", f"""SELECT DISTINCT e.doc_id, e.id AS event_id, t.id AS timex_id, 'IS_INCLUDED' AS rel, CAST(0.85 AS DOUBLE) AS confidence FROM g_dep_times d JOIN g_tevent e ON e.doc_id = d.doc_id AND e.start_tok = d.head_tok JOIN g_timex_week t ON t.doc_id = d.doc_id AND t.start_tok = d.dep_tok
WHERE d.type = 'npadvmod' AND d.head_tok < d.dep_tok AND lower(t.text) LIKE 'last%' AND t.value LIKE '%-W%' AND {_USABLE} AND {_FREE}""")
def last_week_links(v: Views) -> DataFrame:
    """TL-27: events in "last ..." weeks."""
    return enrich.last_week_timex(v("g_tevent"), v("g_dep_times"), v("g_timex_week"), v("g_link"))


@query("nominal_preposition_links", f"""WITH p AS (SELECT DISTINCT e.doc_id, e.id AS event_id, t.id AS timex_id FROM g_tevent e JOIN g_dep_times a ON a.doc_id = e.doc_id AND a.head_tok = e.start_tok AND a.type = 'prep' AND a.dep_tok <> a.head_tok JOIN g_place w ON w.doc_id = a.doc_id AND w.tok_index_doc = a.dep_tok AND w.lemma IN ('in','on','at','of')
JOIN g_dep_times b ON b.doc_id = a.doc_id AND b.head_tok = a.dep_tok AND b.type = 'pobj' AND b.dep_tok <> b.head_tok JOIN g_timex t ON t.doc_id = b.doc_id AND t.start_tok = b.dep_tok WHERE t.type IN ('DATE','TIME') AND e.pos IN ('NN','NNS','NNP','NNPS') AND NOT e.low_confidence AND {_FREE}) {_BOTH.format(0.78)}""")
def nominal_preposition_links(v: Views) -> DataFrame:
    """TL-26: nominal events and the times behind their prepositions."""
    return enrich.nominal_preposition_timex(v("g_tevent"), v("g_dep_times"), v("g_place"), v("g_timex"), v("g_link"))


@query("reporting_dateline_links", f"""WITH d AS (SELECT t.doc_id, arg_min(t.id, t.start_tok) AS id, min(t.start_tok) AS line FROM g_timex_day t JOIN g_dct c ON c.doc_id = t.doc_id AND left(c.value, 10) = left(t.value, 10) WHERE t.type = 'DATE' GROUP BY 1),
p AS (SELECT DISTINCT e.doc_id, e.id AS event_id, t.id AS timex_id FROM g_tevent e JOIN g_lemma l ON l.doc_id = e.doc_id AND l.tok_index_doc = e.start_tok JOIN d t ON t.doc_id = e.doc_id WHERE l.lemma IN {_in(enrich.REPORTING_VERBS)} AND l.pos IN ('VBD','VBZ','VBP','VB') AND e.start_tok <= 103 AND e.start_tok > t.line AND {_FREE}) {_BOTH.format(0.68)}""")
def reporting_dateline_links(v: Views) -> DataFrame:
    """TL-25: reporting verbs of the lead and the dateline."""
    return enrich.reporting_dateline(v("g_tevent"), v("g_timex_day"), v("g_dct"), v("g_lemma"), v("g_link"))


@query("tlink_purge_preview", "SELECT rule_id, count(CASE WHEN gone THEN 1 END) AS purged, count(CASE WHEN NOT gone THEN 1 END) AS kept FROM (SELECT rule_id, coalesce(rule_id = 'rule_A' OR (rule_id = 'rule_N' AND rel_type IN ('BEFORE','AFTER','VAGUE')), false) AS gone FROM g_tlink) x GROUP BY 1")
def tlink_purge_preview(v: Views) -> DataFrame:
    """GA-12, GA-14, P-SHADOW: links that a purge would delete and keep, by rule."""
    return enrich.purge_counts(v("g_tlink"), ["rule_A"], "rule_N")


_INVERSE = "CASE rel " + " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in enrich.INVERSES.items()) + " ELSE rel END"


@query("relation_keys", f"""WITH r AS (SELECT doc_id, src_kind AS a, src_tok AS i, dst_kind AS b, dst_tok AS j, upper(trim(coalesce(rel_type, ''))) AS rel FROM g_relation), t AS (SELECT *, (a = 'timex' AND b = 'event') OR (a = b AND i > j) AS turn FROM r)
SELECT doc_id, a AS src_kind, i AS src_tok, b AS dst_kind, j AS dst_tok, rel AS rel_type FROM t WHERE NOT turn UNION ALL SELECT doc_id, b, j, a, i, {_INVERSE} FROM t WHERE turn""")
def relation_keys(v: Views) -> DataFrame:
    """EVAL-RELKEY: links in one direction."""
    return enrich.relation_key(v("g_relation"))


@query("orphan_mentions", "SELECT doc_id, id, id IN (SELECT src FROM g_coref UNION SELECT dst FROM g_coref) AS is_core FROM g_syntax WHERE syntactic_type IN ('pro','nom','NOMINAL','PRONOUN')")
def orphan_mentions(v: Views) -> DataFrame:
    """ENT-ORPHAN: pronouns and nominals by their coreferences."""
    return enrich.orphan_mentions(v("g_syntax"), v("g_coref"))


@query("propbank_role_names", """SELECT role_name, is_core, is_modifier, count(*) AS arguments FROM (SELECT role_name, coalesce(role_name IN ('agent','patient','instrument','recipient','attribute','location'), false) AS is_core, coalesce(role_name IN ('temporal','locative','manner','purpose','cause'), false) AS is_modifier
FROM (SELECT CASE role WHEN 'ARG0' THEN 'agent' WHEN 'ARG1' THEN 'patient' WHEN 'ARG2' THEN 'instrument' WHEN 'ARG3' THEN 'recipient' WHEN 'ARG4' THEN 'attribute' WHEN 'ARG5' THEN 'location' WHEN 'ARGM-TMP' THEN 'temporal' WHEN 'ARGM-LOC' THEN 'locative' WHEN 'ARGM-MNR' THEN 'manner' WHEN 'ARGM-PRP' THEN 'purpose' WHEN 'ARGM-CAU' THEN 'cause' END AS role_name FROM g_frame_argument) x) y GROUP BY 1, 2, 3""")
def propbank_role_names(v: Views) -> DataFrame:
    """FN-PROPROLE: arguments by the name of their role."""
    named = v("g_frame_argument").select(labels.propbank_role(F.col("role")).alias("role_name"))
    return named.groupBy("role_name", labels.is_core_role(F.col("role_name")).alias("is_core"), labels.is_modifier_role(F.col("role_name")).alias("is_modifier")).agg(F.count("*").alias("arguments"))


@query("syntactic_types", """SELECT type, CASE type WHEN 'NOM' THEN 'NOMINAL' WHEN '' THEN 'NOMINAL' ELSE type END AS former_type, count(*) AS mentions FROM (SELECT CASE WHEN t = 'NOMINAL' THEN 'NOM' WHEN t = 'PROPER' THEN 'NAM' WHEN t = 'PRONOMINAL' THEN 'PRO' WHEN t IN ('NAM','NOM','PRO','PTV','PRE','HLS','CONJ','APP','ARC') THEN t ELSE '' END AS type FROM (SELECT upper(trim(syntactic_type)) AS t FROM g_syntax) x) y GROUP BY 1""")
def syntactic_types(v: Views) -> DataFrame:
    """FN-STYPENORM: mentions by syntactic type and its older name."""
    kinds = v("g_syntax").groupBy(labels.syntactic_type(F.col("syntactic_type")).alias("type")).agg(F.count("*").alias("mentions"))
    return kinds.select("type", labels.former_syntactic_type(F.col("type")).alias("former_type"), "mentions")
