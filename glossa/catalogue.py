"""The registered queries, each beside the SQL that says the same."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import ids, scores, timeml
from .operators import enhance, evaluation, fusion, provenance, quality, spans, tlinks
from .plans import prims
from .registry import Views, query

_CANON = """CASE upper(trim(coalesce(rel_type,''))) WHEN 'OVERLAP' THEN 'SIMULTANEOUS' WHEN 'MEASURE' THEN 'DURING' WHEN '' THEN 'VAGUE' ELSE upper(trim(rel_type)) END"""
_EDGES = f"e AS (SELECT src, dst, {_CANON} AS rel, rel_type, confidence, rule_id, evidence_source, suppressed, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, src, dst) AS eid, l_orderkey, l_linenumber, l_extendedprice FROM g_tlink)"
_OPP = "CASE {0} WHEN 'BEFORE' THEN 'AFTER' WHEN 'AFTER' THEN 'BEFORE' WHEN 'INCLUDES' THEN 'IS_INCLUDED' WHEN 'IS_INCLUDED' THEN 'INCLUDES' WHEN 'BEGINS' THEN 'BEGUN_BY' WHEN 'BEGUN_BY' THEN 'BEGINS' WHEN 'ENDS' THEN 'ENDED_BY' WHEN 'ENDED_BY' THEN 'ENDS' END"


# Temporal links

@query("tlink_consistency_violations", f"""WITH {_EDGES} SELECT a.rel AS rel_type_1, b.rel AS rel_type_2, count(*) AS conflict_count FROM e a JOIN e b ON a.src = b.src AND a.dst = b.dst AND a.eid < b.eid
WHERE NOT a.suppressed AND NOT b.suppressed AND b.rel = {_OPP.format('a.rel')} GROUP BY 1, 2""")
def tlink_consistency_violations(v: Views) -> DataFrame:
    """Contradictory live links on the same ends, by type."""
    return tlinks.contradictions(tlinks.edges(v("g_tlink")))


@query("tlink_reciprocal_cycle_signals", f"""WITH {_EDGES} SELECT a.rel AS rel_type, count(*) AS cycle_count FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src AND a.eid < b.eid AND a.rel = b.rel
WHERE NOT a.suppressed AND NOT b.suppressed AND a.rel IN ('BEFORE','AFTER','INCLUDES','IS_INCLUDED','BEGINS','BEGUN_BY','ENDS','ENDED_BY') GROUP BY 1""")
def tlink_reciprocal_cycle_signals(v: Views) -> DataFrame:
    """Pairs of live links of one directional type that run both ways."""
    return tlinks.reciprocal_cycles(tlinks.edges(v("g_tlink")))


@query("tlink_family_distribution", f"WITH {_EDGES} SELECT coalesce(evidence_source,'UNSET') AS evidence_source, coalesce(rule_id,'UNSET') AS rule_id, rel AS rel_type, suppressed, count(*) AS rel_count FROM e GROUP BY 1,2,3,4")
def tlink_family_distribution(v: Views) -> DataFrame:
    """Links by source, rule, type and suppression."""
    e = tlinks.edges(v("g_tlink"))
    return e.groupBy(F.coalesce("evidence_source", F.lit("UNSET")).alias("evidence_source"), F.coalesce("rule_id", F.lit("UNSET")).alias("rule_id"), F.col("rel").alias("rel_type"), "suppressed").agg(F.count("*").alias("rel_count"))


@query("tlink_relation_inventory", f"WITH {_EDGES} SELECT rel_type, rel AS rel_type_canonical, 2 * count(*) AS link_count FROM e GROUP BY 1, 2")
def tlink_relation_inventory(v: Views) -> DataFrame:
    """Links by raw and canonical type; an undirected match counts each twice."""
    return tlinks.edges(v("g_tlink")).groupBy("rel_type", F.col("rel").alias("rel_type_canonical")).agg((2 * F.count("*")).alias("link_count"))


@query("tlink_suppression_inventory", f"WITH {_EDGES} SELECT rel AS rel_type, rule_id, count(*) AS total, count(CASE WHEN suppressed THEN 1 END) AS suppressed_links FROM e GROUP BY 1, 2")
def tlink_suppression_inventory(v: Views) -> DataFrame:
    """Suppressed links by type and rule."""
    return tlinks.edges(v("g_tlink")).groupBy(F.col("rel").alias("rel_type"), "rule_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("suppressed"), 1)).alias("suppressed_links"))


@query("tlink_normalized", f"WITH {_EDGES} SELECT l_orderkey, l_linenumber, l_extendedprice, src, dst, rel, rel_type AS original FROM e")
def tlink_normalized(v: Views) -> DataFrame:
    """TL-NORM: every link with its canonical and original type."""
    return tlinks.edges(v("g_tlink")).select("edge_id.l_orderkey", "edge_id.l_linenumber", "edge_id.l_extendedprice", "src", "dst", "rel", F.col("rel_type").alias("original"))


@query("tlink_conflict_losers", f"""WITH {_EDGES}, l AS (SELECT * FROM e WHERE NOT suppressed)
SELECT DISTINCT b.l_orderkey, b.l_linenumber, b.l_extendedprice, b.src, b.dst, b.rel, a.rel AS winner_rel FROM l a JOIN l b ON a.src = b.src AND a.dst = b.dst AND a.eid <> b.eid AND b.rel = {_OPP.format('a.rel')}
WHERE coalesce(a.confidence,0) > coalesce(b.confidence,0) OR (coalesce(a.confidence,0) = coalesce(b.confidence,0) AND a.eid < b.eid)""")
def tlink_conflict_losers(v: Views) -> DataFrame:
    """TL-SUPPRESS: links that lose against a contradictory one."""
    return tlinks.contradiction_losers(tlinks.edges(v("g_tlink"))).select("edge_id.l_orderkey", "edge_id.l_linenumber", "edge_id.l_extendedprice", "src", "dst", "rel", "winner_rel")


@query("tlink_bidirectional_losers", f"""WITH {_EDGES}, l AS (SELECT * FROM e WHERE NOT suppressed AND rel IN ('BEFORE','AFTER','INCLUDES','IS_INCLUDED','BEGINS','BEGUN_BY','ENDS','ENDED_BY'))
SELECT DISTINCT b.l_orderkey, b.l_linenumber, b.l_extendedprice, b.src, b.dst, b.rel FROM l a JOIN l b ON a.src = b.dst AND a.dst = b.src AND a.eid <> b.eid AND a.rel = b.rel
WHERE coalesce(a.confidence,0) > coalesce(b.confidence,0) OR (coalesce(a.confidence,0) = coalesce(b.confidence,0) AND a.eid < b.eid)""")
def tlink_bidirectional_losers(v: Views) -> DataFrame:
    """TL-SOLVE-BI: directional links that lose against the same type back."""
    return tlinks.bidirectional_losers(tlinks.edges(v("g_tlink"))).select("edge_id.l_orderkey", "edge_id.l_linenumber", "edge_id.l_extendedprice", "src", "dst", "rel")


@query("tlink_solver_inverses", f"""WITH {_EDGES}, w AS (SELECT dst AS src, src AS dst, CASE rel WHEN 'IDENTITY' THEN 'IDENTITY' ELSE {_OPP.format('rel')} END AS rel, max(coalesce(confidence, 0.5)) AS confidence FROM e WHERE NOT suppressed GROUP BY 1, 2, 3)
SELECT * FROM w WHERE rel IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.src AND e.dst = w.dst AND e.rel = w.rel)""")
def tlink_solver_inverses(v: Views) -> DataFrame:
    """TL-SOLVE-INV: inverses that no link states."""
    return tlinks.missing_inverses(tlinks.edges(v("g_tlink")))


@query("tlink_inverses", f"""WITH {_EDGES}, c AS (SELECT dst AS src, src AS dst, {_OPP.format('rel')} AS rel, coalesce(confidence, 0.5) AS confidence, rel AS derived_from FROM e WHERE NOT suppressed AND rel IN ('INCLUDES','IS_INCLUDED','BEGINS','BEGUN_BY','ENDS','ENDED_BY')),
w AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, rel, derived_from) AS rn FROM c), p AS (SELECT src, dst, max(coalesce(confidence, 0)) AS present FROM e GROUP BY 1, 2)
SELECT w.src, w.dst, w.rel, w.confidence, w.derived_from, CASE WHEN present IS NULL THEN 'create' WHEN present < w.confidence THEN 'replace' ELSE 'keep' END AS action FROM w LEFT JOIN p USING (src, dst) WHERE rn = 1""")
def tlink_inverses(v: Views) -> DataFrame:
    """TL-INV: swept inverses and whether they create or replace."""
    return tlinks.sweep_inverses(tlinks.edges(v("g_tlink")))


def _closure_round(k: int, known: str, stated: str) -> str:
    compose = f"SELECT a.src, b.dst, b.rel, max(round((a.confidence + b.confidence) / 2, 3)) AS confidence FROM {known} a JOIN {known} b ON a.dst = b.src WHERE a.rel = 'IDENTITY' AND a.src <> b.dst GROUP BY 1, 2, 3"
    other = f"SELECT a.src, b.dst, a.rel, max(round((a.confidence + b.confidence) / 2, 3)) AS confidence FROM {known} a JOIN {known} b ON a.dst = b.src WHERE b.rel = 'IDENTITY' AND a.src <> b.dst GROUP BY 1, 2, 3"
    return f"n{k} AS MATERIALIZED (SELECT src, dst, rel, max(confidence) AS confidence FROM (SELECT * FROM ({compose}) UNION ALL SELECT * FROM ({other})) u WHERE NOT EXISTS (SELECT 1 FROM {stated} s WHERE s.src = u.src AND s.dst = u.dst AND s.rel = u.rel) GROUP BY 1, 2, 3)"


def _closure(rounds: int) -> str:
    steps = ["k0 AS MATERIALIZED (SELECT src, dst, rel, max(coalesce(confidence, 0)) AS confidence FROM e WHERE NOT suppressed GROUP BY 1, 2, 3)", "s0 AS MATERIALIZED (SELECT DISTINCT src, dst, rel FROM e)"]
    for k in range(1, rounds + 1):
        steps += [_closure_round(k, f"k{k - 1}", f"s{k - 1}"), f"k{k} AS MATERIALIZED (SELECT * FROM k{k - 1} UNION ALL SELECT * FROM n{k})", f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT src, dst, rel FROM n{k})"]
    return ", ".join(steps)


_ROUNDS = 3


@query("tlink_identity_closure", f"""WITH {_EDGES}, {_closure(1)} SELECT src, dst, rel, confidence, CAST(1 AS BIGINT) AS closure_round FROM n1""")
def tlink_identity_closure(v: Views) -> DataFrame:
    """TL-CLOSURE, one round over a dense random graph; ``document_identity_closure`` runs all three over documents."""
    return tlinks.identity_closure(tlinks.edges(v("g_tlink")), rounds=1).withColumn("closure_round", F.col("closure_round").cast("long"))


@query("tlink_anchor_flags", f"""WITH {_EDGES} SELECT l_orderkey, l_linenumber, l_extendedprice, src, dst, src <> dst AS anchor_consistency, CASE WHEN src = dst THEN 'self_link' END AS anchor_consistency_reason, suppressed OR src = dst AS suppressed,
CASE WHEN src = dst AND NOT suppressed THEN 'tlink_anchor_consistency_filter' END AS suppressed_by FROM e""")
def tlink_anchor_flags(v: Views) -> DataFrame:
    """TL-ANCHOR: anchor consistency of every link."""
    return tlinks.anchor_flags(tlinks.edges(v("g_tlink"))).select("edge_id.l_orderkey", "edge_id.l_linenumber", "edge_id.l_extendedprice", "src", "dst", "anchor_consistency", "anchor_consistency_reason", "suppressed", "suppressed_by")


@query("tlink_anchor_consistency_inventory", "SELECT 'inconsistent_tlinks' AS metric, count(CASE WHEN src = dst THEN 1 END) AS item_count FROM g_tlink UNION ALL SELECT 'self_link_tlinks', count(CASE WHEN src = dst THEN 1 END) FROM g_tlink UNION ALL SELECT 'anchor_filter_suppressed_tlinks', count(CASE WHEN src = dst AND NOT suppressed THEN 1 END) FROM g_tlink")
def tlink_anchor_consistency_inventory(v: Views) -> DataFrame:
    """Anchor metrics of all links."""
    f = tlinks.anchor_flags(tlinks.edges(v("g_tlink")))
    return prims.metrics({
        "inconsistent_tlinks": (f, lambda: F.count(F.when(~F.col("anchor_consistency"), 1))),
        "self_link_tlinks": (f, lambda: F.count(F.when(F.col("anchor_consistency_reason") == "self_link", 1))),
        "anchor_filter_suppressed_tlinks": (f, lambda: F.count("suppressed_by"))})


@query("tlink_included_before", f"""WITH {_EDGES}, p AS (SELECT DISTINCT src, dst, rel FROM e WHERE NOT suppressed) SELECT a.src, b.dst, count(*) AS paths, 'BEFORE' AS rel FROM p a JOIN p b ON a.dst = b.src WHERE a.rel = 'IS_INCLUDED' AND b.rel = 'BEFORE' AND a.src <> b.dst
AND NOT EXISTS (SELECT 1 FROM p c WHERE c.src = a.src AND c.dst = b.dst AND c.rel = 'BEFORE') GROUP BY 1, 2""")
def tlink_included_before(v: Views) -> DataFrame:
    """GA-01: IS_INCLUDED and then BEFORE gives BEFORE."""
    return tlinks.compose(tlinks.edges(v("g_tlink")), "IS_INCLUDED", "BEFORE", "BEFORE")


@query("timex_same_value", "SELECT doc_id, value, count(*) AS members, min_by(id, start_tok) AS representative, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS links FROM g_timex GROUP BY 1, 2 HAVING count(*) > 1")
def timex_same_value(v: Views) -> DataFrame:
    """TL-17A: classes of simultaneous time expressions."""
    return tlinks.same_value_timexes(v("g_timex"))


_TL09 = """p AS (SELECT e.doc_id, e.id AS event_id, t.id AS timex_id, min(abs(e.start_tok - t.start_tok)) AS distance FROM g_tevent e JOIN g_frame f ON f.doc_id = e.doc_id AND f.head_tok = e.start_tok AND f.framework = 'NOMBANK' JOIN g_timex t ON e.doc_id = t.doc_id AND e.sent_idx = t.sent_idx
WHERE NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true) AND t.type IN ('DATE','TIME','SET') AND e.start_tok <> t.start_tok AND abs(e.start_tok - t.start_tok) <= 8 GROUP BY 1, 2, 3)"""


def _nominal_events(v: Views) -> DataFrame:
    heads = v("g_frame").where("framework = 'NOMBANK'").select("doc_id", F.col("head_tok").alias("start_tok")).distinct()
    return v("g_tevent").join(heads, ["doc_id", "start_tok"], "left_semi")


@query("event_sentence_timex", f"WITH {_TL09} SELECT doc_id, event_id, timex_id, distance, 'IS_INCLUDED' AS rel, CAST(0.6 AS DOUBLE) AS confidence FROM p")
def event_sentence_timex(v: Views) -> DataFrame:
    """TL-09: events of nominal frames and the dates, times and sets of their sentence."""
    return tlinks.nominal_in_sentence(_nominal_events(v), v("g_timex"))


@query("event_unanchored", f"WITH {_TL09} SELECT doc_id, id AS event_id, concat('dct_', CAST(doc_id AS STRING)) AS timex_id, 'IS_INCLUDED' AS rel, CAST(0.55 AS DOUBLE) AS confidence FROM g_tevent WHERE NOT low_confidence AND NOT merged AND coalesce(is_timeml_core, true) AND NOT EXISTS (SELECT 1 FROM p WHERE p.event_id = g_tevent.id)")
def event_unanchored(v: Views) -> DataFrame:
    """TL-20B: events left to the document's date."""
    return tlinks.unanchored(v("g_tevent"), tlinks.nominal_in_sentence(_nominal_events(v), v("g_timex")))


@query("event_dct_relation", """SELECT e.doc_id, e.id, CASE WHEN tense = 'FUTURE' THEN 'AFTER' WHEN tense = 'PRESENT' AND aspect = 'PROGRESSIVE' THEN 'IS_INCLUDED' WHEN tense = 'PAST' THEN 'BEFORE' WHEN tense = 'PRESENT' AND aspect = 'PERFECTIVE' THEN 'BEFORE' ELSE 'VAGUE' END AS rel, CAST(0.78 AS DOUBLE) AS confidence
FROM g_tevent e JOIN g_token t ON t.doc_id = e.doc_id AND t.tok_index_doc = e.start_tok WHERE NOT low_confidence AND NOT merged AND coalesce(is_timeml_core, true) AND t.pos NOT IN ('NNP','NNS','NN') AND tense IN ('PAST','PRESENT','FUTURE')""")
def event_dct_relation(v: Views) -> DataFrame:
    """TL-06: events on words other than nouns against the document's date."""
    words = v("g_token").where("pos not in ('NNP', 'NNS', 'NN')").select("doc_id", F.col("tok_index_doc").alias("start_tok"))
    e = tlinks.usable(v("g_tevent")).where("tense in ('PAST', 'PRESENT', 'FUTURE')").join(words, ["doc_id", "start_tok"])
    return e.select("doc_id", "id", tlinks.dct_relation(F.col("tense"), F.col("aspect")).alias("rel"), F.lit(0.78).alias("confidence"))


@query("duration_in_date", "SELECT d.doc_id, d.id AS duration_id, t.id AS date_id, abs(d.start_tok - t.start_tok) AS distance FROM g_timex d JOIN g_timex t ON d.doc_id = t.doc_id AND d.sent_idx = t.sent_idx WHERE d.type = 'DURATION' AND t.type = 'DATE' AND abs(d.start_tok - t.start_tok) <= 10")
def duration_in_date(v: Views) -> DataFrame:
    """TL-17B: durations close to a date of their sentence."""
    return tlinks.duration_in_date(v("g_timex"))


@query("duration_fix", "SELECT doc_id, id, value AS raw_value, regexp_replace(value, '^P([YMDWH])([0-9]+)$', 'P\\2\\1') AS value FROM g_timex WHERE type = 'DURATION'")
def duration_fix(v: Views) -> DataFrame:
    """FN-DURATION: transposed durations put right, the raw value kept."""
    return v("g_timex").where("type = 'DURATION'").select("doc_id", "id", F.col("value").alias("raw_value"), timeml.duration(F.col("value")).alias("value"))


_DATE_FORMS = {"compact": ("%Y%m%d", "yyyyMMdd"), "month_only": ("%Y%m", "yyyyMM"), "named": ("%-d %B %Y", "d MMMM yyyy"), "short": ("%b %-d, %Y", "MMM d, yyyy"), "month_year": ("%B %Y", "MMMM yyyy"), "year_month": ("%Y %b", "yyyy MMM"), "slashed": ("%d/%m/%Y", "dd/MM/yyyy")}
_DATE_WANTS = {"month_only": "%Y-%m", "month_year": "%Y-%m", "year_month": "%Y-%m", "slashed": "%d/%m/%Y"}


@query("iso_dates", "SELECT o_orderkey, " + ", ".join(f"strftime(o_orderdate, '{_DATE_WANTS.get(n, '%Y-%m-%d')}') AS iso_{n}" for n in _DATE_FORMS) + " FROM orders")
def iso_dates(v: Views) -> DataFrame:
    """FN-DATE: spellings of order dates back to ISO; day/month/year stays as it is."""
    return v("orders").select("o_orderkey", *(timeml.iso_date(F.date_format("o_orderdate", java)).alias(f"iso_{n}") for n, (_, java) in _DATE_FORMS.items()))


# Fusion and provenance

@query("entity_cooccurrence", "WITH s AS (SELECT DISTINCT doc_id, id % 7 AS sent_idx, coalesce(kb_id, surface) AS entity FROM g_mention) SELECT a.entity AS a, b.entity AS b, count(*) AS sentences, CAST(0.65 AS DOUBLE) AS confidence FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.entity < b.entity GROUP BY 1, 2")
def entity_cooccurrence(v: Views) -> DataFrame:
    """FUS-COOC: entities that share sentences."""
    return fusion.cooccurrence(v("g_mention").withColumn("sent_idx", F.col("id") % 7))


@query("entity_same_kb", "WITH s AS (SELECT DISTINCT kb_id, upper(coalesce(type,'')) AS type, doc_id FROM g_mention WHERE kb_id IS NOT NULL) SELECT kb_id, type, count(*) AS documents, min(doc_id) AS representative, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS links FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def entity_same_kb(v: Views) -> DataFrame:
    """FUS-KB: documents linked by a knowledge-base id."""
    return fusion.same_kb(v("g_mention"))


@query("entity_same_key", """WITH s AS (SELECT lower(trim(surface)) AS key, upper(type) AS type, doc_id, max(CASE WHEN kb_id IS NULL THEN 0 ELSE 1 END) AS known FROM g_mention WHERE length(trim(surface)) >= 2 GROUP BY 1, 2, 3)
SELECT a.key, a.type, any_value(n.documents) AS documents, any_value(n.known_documents) AS known_documents, any_value(n.representative) AS representative, count(*) AS links FROM s a JOIN s b ON a.key = b.key AND a.type = b.type AND a.doc_id < b.doc_id AND (a.known = 0 OR b.known = 0)
JOIN (SELECT key, type, count(*) AS documents, CAST(sum(known) AS BIGINT) AS known_documents, min(doc_id) AS representative FROM s GROUP BY 1, 2) n ON n.key = a.key AND n.type = a.type GROUP BY 1, 2""")
def entity_same_key(v: Views) -> DataFrame:
    """FUS-COREF: surfaces shared by documents, one side without an id."""
    return fusion.same_key(v("g_mention"))


@query("provenance_breakdown", """WITH m AS (SELECT coalesce(evidence_source,'UNSET') AS evidence_source, coalesce(rule_id,'UNSET') AS rule_id, CAST(confidence IS NULL AS BIGINT) AS c, CAST(evidence_source IS NULL AS BIGINT) AS s, CAST(rule_id IS NULL AS BIGINT) AS r FROM g_tlink)
SELECT evidence_source, rule_id, CAST(sum(c) AS BIGINT) AS missing_confidence, CAST(sum(s) AS BIGINT) AS missing_evidence_source, CAST(sum(r) AS BIGINT) AS missing_rule_id, CAST(sum(c + s + r) AS BIGINT) AS total_missing_fields FROM m GROUP BY 1, 2""")
def provenance_breakdown(v: Views) -> DataFrame:
    """Missing provenance fields by source and rule."""
    return provenance.breakdown(v("g_tlink"), by=("evidence_source", "rule_id"), fields=("confidence", "evidence_source", "rule_id"))


@query("provenance_missing", "SELECT rule_id, count(*) AS total, count(CASE WHEN confidence IS NULL THEN 1 END) AS missing_confidence, count(CASE WHEN evidence_source IS NULL THEN 1 END) AS missing_evidence_source, count(*) AS missing_authority_tier, count(*) AS violations FROM g_tlink GROUP BY 1")
def provenance_missing(v: Views) -> DataFrame:
    """PRV-VALIDATE: links without full provenance, by rule."""
    return provenance.missing(v("g_tlink"), ("confidence", "evidence_source", "authority_tier"))


@query("provenance_stamped", "SELECT l_orderkey, l_linenumber, l_extendedprice, src, dst, coalesce(evidence_source, 'heuristic') AS evidence_source, CASE WHEN evidence_source = 'tlinks_recognizer' THEN 'secondary' ELSE 'support' END AS authority_tier FROM g_tlink")
def provenance_stamped(v: Views) -> DataFrame:
    """PRV-STAMP and FN-AUTH: missing sources filled, tiers resolved."""
    stamped = provenance.stamp(v("g_tlink"), {"evidence_source": F.lit("heuristic")})
    return stamped.select("l_orderkey", "l_linenumber", "l_extendedprice", "src", "dst", "evidence_source", scores.tier(F.col("evidence_source")).alias("authority_tier"))


@query("evidence_pick", """WITH r AS (SELECT src, rel_type AS value, coalesce(evidence_source, 'heuristic') AS evidence_source, confidence, CASE WHEN evidence_source IS NOT NULL THEN 1 ELSE 0 END AS tier_rank FROM g_tlink),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY tier_rank DESC, confidence DESC, evidence_source DESC, value DESC) AS rn FROM r) SELECT src, value, evidence_source, confidence, tier_rank FROM o WHERE rn = 1""")
def evidence_pick(v: Views) -> DataFrame:
    """PRV-PICK: the most authoritative record of each source node."""
    source = F.coalesce("evidence_source", F.lit("heuristic"))
    records = v("g_tlink").select("src", F.col("rel_type").alias("value"), source.alias("evidence_source"), "confidence", scores.tier(source).alias("authority_tier"))
    return provenance.authoritative(records, ["src"])


# Documents, spans, heads

@query("doc_invariants", "SELECT t.doc_id, t.sentences, t.tokens, coalesce(e.events, 0) AS events, coalesce(x.timexes, 0) AS timexes FROM (SELECT doc_id, count(DISTINCT sent_idx) AS sentences, count(*) AS tokens FROM g_token GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(*) AS events FROM g_tevent GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS timexes FROM g_timex GROUP BY 1) x USING (doc_id)")
def doc_invariants(v: Views) -> DataFrame:
    """Sentences, tokens, events and time expressions of each document.

    All counts come from one pass over the tokens of each table, joined per document.
    """
    tokens = v("g_token").groupBy("doc_id").agg((F.max("sent_idx") - F.min("sent_idx")).alias("width"), F.countDistinct("sent_idx").alias("sentences"), F.count("*").alias("tokens")).drop("width")
    events = v("g_tevent").groupBy("doc_id").agg(F.count("*").alias("events"))
    timexes = v("g_timex").groupBy("doc_id").agg(F.count("*").alias("timexes"))
    filled = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return tokens.join(events, "doc_id", "left").join(timexes, "doc_id", "left").select("doc_id", "sentences", "tokens", filled("events"), filled("timexes"))


@query("event_completeness", "SELECT count(*) AS total, count(id) AS with_eid, count(tense) AS with_tense, count(aspect) AS with_aspect, count(polarity) AS with_polarity, count(pos) AS with_pos, count(CASE WHEN id IS NULL OR tense IS NULL OR aspect IS NULL OR polarity IS NULL OR pos IS NULL THEN 1 END) AS missing_core FROM g_tevent")
def event_completeness(v: Views) -> DataFrame:
    """TimeML fields of events."""
    c = {f: F.col(f) for f in ("id", "tense", "aspect", "polarity", "pos")}
    return prims.completeness(v("g_tevent"), {"with_eid": c["id"]} | {f"with_{f}": x for f, x in c.items() if f != "id"}, list(c.values()))


@query("timex_completeness", "SELECT count(*) AS total, count(id) AS with_tid, count(type) AS with_type, count(value) AS with_value, count(CASE WHEN id IS NULL OR type IS NULL OR value IS NULL THEN 1 END) AS missing_core FROM g_timex")
def timex_completeness(v: Views) -> DataFrame:
    """TimeML fields of time expressions."""
    i, t, x = F.col("id"), F.col("type"), F.col("value")
    return prims.completeness(v("g_timex"), {"with_tid": i, "with_type": t, "with_value": x}, [i, t, x])


@query("tlink_completeness", "SELECT count(*) AS total, count(rel_type) AS with_rel_type, count(evidence_source) AS with_evidence_source, count(CASE WHEN rel_type IS NULL OR evidence_source IS NULL THEN 1 END) AS missing_core FROM g_tlink")
def tlink_completeness(v: Views) -> DataFrame:
    """TimeML fields of links."""
    r, s = F.col("rel_type"), F.col("evidence_source")
    return prims.completeness(v("g_tlink"), {"with_rel_type": r, "with_evidence_source": s}, [r, s])


_SPANS5 = "s AS (SELECT doc_id, id AS span_id, start_tok, least(start_tok + 3, floor(start_tok / 20) * 20 + 19) AS end_tok FROM g_tevent)"


def _spans5(v: Views) -> DataFrame:
    end = F.least(F.col("start_tok") + 3, F.floor(F.col("start_tok") / 20) * 20 + 19)
    return v("g_tevent").select("doc_id", F.col("id").alias("span_id"), "start_tok", end.alias("end_tok"))


@query("span_heads", f"""WITH {_SPANS5}, i AS (SELECT s.*, t.tok_index_doc, t.text, t.pos, d.head_tok FROM s JOIN g_token t ON t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.tok_index_doc BETWEEN s.start_tok AND s.end_tok LEFT JOIN g_dep d ON d.doc_id = t.doc_id AND d.dep_tok = t.tok_index_doc AND d.head_tok <> d.dep_tok),
f AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY tok_index_doc) AS rn FROM i WHERE head_tok IS NULL OR head_tok < start_tok OR head_tok > end_tok)
SELECT doc_id, span_id, start_tok, CAST(end_tok AS BIGINT) AS end_tok, tok_index_doc AS head_tok_index, text AS head, pos AS head_pos, CASE WHEN pos IN ('NNP','NNPS') THEN 'NAM' WHEN pos IN ('NN','NNS') THEN 'NOM' WHEN pos LIKE 'PRP%' THEN 'PRO' WHEN pos = 'CD' THEN 'PTV' ELSE 'OTHER' END AS syntactic_type FROM f WHERE rn = 1""")
def span_heads(v: Views) -> DataFrame:
    """HEAD-*: the head token of each span."""
    return spans.heads(_spans5(v), v("g_token"), v("g_dep"))


@query("preposition_complements", """SELECT d.doc_id, d.head_tok, h.text AS signal, d.dep_tok, c.text AS complement, c.pos AS complement_pos FROM g_dep d JOIN g_token h ON h.doc_id = d.doc_id AND h.tok_index_doc = d.head_tok JOIN g_token c ON c.doc_id = d.doc_id AND c.tok_index_doc = d.dep_tok
WHERE d.type = 'pobj' AND h.pos = 'IN' AND d.head_tok <> d.dep_tok""")
def preposition_complements(v: Views) -> DataFrame:
    """HEAD-FA-PREP: prepositions and the objects below them."""
    return spans.complements(v("g_token"), v("g_dep"), "IN", "pobj")


@query("appositive_mentions", f"""WITH {_SPANS5} SELECT d.doc_id, d.dep_tok, d.head_tok, d.type, c.text, c.pos FROM g_dep d JOIN g_token c ON c.doc_id = d.doc_id AND c.tok_index_doc = d.dep_tok WHERE d.type = 'appos' AND d.head_tok <> d.dep_tok AND c.pos IN ('NN','NNS','NNP')
AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND d.dep_tok BETWEEN s.start_tok AND s.end_tok)""")
def appositive_mentions(v: Views) -> DataFrame:
    """NOM-APPOS: appositives that no span covers."""
    return spans.dependent_mentions(v("g_token"), v("g_dep"), ["appos"], _spans5(v))


@query("event_argument_mentions", f"""WITH {_SPANS5} SELECT d.doc_id, d.dep_tok, d.head_tok, d.type, c.text, c.pos FROM g_dep d JOIN g_token c ON c.doc_id = d.doc_id AND c.tok_index_doc = d.dep_tok WHERE d.type IN ('nsubj','dobj','nsubjpass') AND d.head_tok <> d.dep_tok AND c.pos IN ('NN','NNS','NNP')
AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND d.dep_tok BETWEEN s.start_tok AND s.end_tok)""")
def event_argument_mentions(v: Views) -> DataFrame:
    """NOM-EVARG: arguments of events that no span covers."""
    return spans.dependent_mentions(v("g_token"), v("g_dep"), ["nsubj", "dobj", "nsubjpass"], _spans5(v))


@query("trimmed_spans", f"""WITH {_SPANS5}, k AS (SELECT s.span_id, min(t.tok_index_doc) AS a, max(t.tok_index_doc) AS b FROM s JOIN g_token t ON t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.tok_index_doc BETWEEN s.start_tok AND s.end_tok WHERE t.pos NOT IN ('DT','PRP') GROUP BY 1)
SELECT s.doc_id, s.span_id, coalesce(k.a, s.start_tok) AS start_tok, CAST(coalesce(k.b, s.end_tok) AS BIGINT) AS end_tok FROM s LEFT JOIN k USING (span_id)""")
def trimmed_spans(v: Views) -> DataFrame:
    """MEN-DET: spans without determiners at their ends."""
    return spans.trimmed(_spans5(v), v("g_token"), F.col("pos").isin("DT", "PRP"))


@query("frame_argument_roles", "SELECT role, CASE WHEN role LIKE 'ARGM-%' THEN 'Argm-' || substr(role, 6) ELSE 'Arg' || substr(role, 4) END AS semantic_role, count(*) AS arguments, count(DISTINCT frame_id) AS frames FROM g_frame_argument GROUP BY 1, 2")
def frame_argument_roles(v: Views) -> DataFrame:
    """FN-SEMROLE: arguments by role."""
    return v("g_frame_argument").groupBy("role", scores.semantic_role(F.col("role")).alias("semantic_role")).agg(F.count("*").alias("arguments"), F.countDistinct("frame_id").alias("frames"))


@query("frame_voice", """WITH r AS (SELECT frame_id, max(CASE WHEN role = 'ARG0' THEN 1 ELSE 0 END) AS a0, max(CASE WHEN role = 'ARG1' THEN 1 ELSE 0 END) AS a1 FROM g_frame_argument GROUP BY 1) SELECT frame_id, CASE WHEN a0 = 1 THEN 'active' WHEN a1 = 1 THEN 'passive' ELSE 'other' END AS voice FROM r""")
def frame_voice(v: Views) -> DataFrame:
    """FN-VOICE: voice of each frame by its core roles."""
    return v("g_frame_argument").groupBy("frame_id").agg(F.collect_set("role").alias("roles")).select("frame_id", scores.voice(F.col("roles")).alias("voice"))


@query("frame_alignment", """SELECT a.doc_id, a.id AS verbal_id, b.id AS nominal_id, round(sqrt(a.confidence * b.confidence), 6) AS confidence FROM g_frame a JOIN g_frame b ON a.doc_id = b.doc_id AND lower(a.pred) = lower(b.pred) AND a.sent_idx - b.sent_idx BETWEEN -1 AND 1 AND abs(a.head_tok - b.head_tok) <= 5 WHERE a.framework = 'PROPBANK' AND b.framework = 'NOMBANK'""")
def frame_alignment(v: Views) -> DataFrame:
    """ING-ALIGN: frames of two frameworks on one word."""
    return enhance.aligned_frames(v("g_frame"))


@query("event_polarity", """WITH n AS (SELECT doc_id, head_tok AS tok FROM g_dep_words WHERE type = 'neg' AND head_tok <> dep_tok UNION SELECT doc_id, dep_tok FROM g_dep_words WHERE type = 'neg' AND head_tok <> dep_tok) SELECT e.doc_id, e.id, CASE WHEN n.tok IS NOT NULL THEN 'NEG' ELSE e.polarity END AS polarity FROM g_tevent e LEFT JOIN n ON n.doc_id = e.doc_id AND n.tok = e.start_tok""")
def event_polarity(v: Views) -> DataFrame:
    """MORPH-POL: events beside a negation."""
    return enhance.polarity(v("g_tevent"), v("g_dep_words"))


@query("sentence_roots", "SELECT t.doc_id, t.sent_idx, t.tok_index_doc AS root_tok, t.text AS root_text, t.pos AS root_pos FROM g_token t JOIN g_dep d ON d.doc_id = t.doc_id AND d.dep_tok = t.tok_index_doc WHERE d.type = 'ROOT'")
def sentence_roots(v: Views) -> DataFrame:
    """GA-08: root token of each sentence."""
    return enhance.sentence_roots(v("g_token"), v("g_dep"))


@query("event_noun_pos", "SELECT e.doc_id, e.id, CASE WHEN t.pos LIKE 'NN%' THEN 'NOUN' ELSE e.pos END AS pos FROM g_tevent e JOIN g_token t ON t.doc_id = e.doc_id AND t.tok_index_doc = e.start_tok")
def event_noun_pos(v: Views) -> DataFrame:
    """GA-10: events on nouns."""
    return enhance.noun_event_pos(v("g_tevent"), v("g_token"))


@query("event_low_confidence", """WITH x AS (SELECT e.doc_id, e.id, e.low_confidence AS was, CAST(e.start_tok % 10 AS DOUBLE) / 10 AS confidence, f.head_tok IS NULL AND e.start_tok % 10 < 6 AND NOT e.low_confidence AS low
FROM g_tevent e LEFT JOIN (SELECT DISTINCT doc_id, head_tok FROM g_frame WHERE framework IN ('PROPBANK','NOMBANK') AND head_tok % 4 <> 1) f ON f.doc_id = e.doc_id AND f.head_tok = e.start_tok) SELECT doc_id, id, was OR low AS low_confidence, CASE WHEN low THEN confidence * 0.5 ELSE confidence END AS confidence FROM x""")
def event_low_confidence(v: Views) -> DataFrame:
    """GA-02A: events without a frame lose confidence; every fourth token stands for one without."""
    return enhance.low_confidence_without_frame(v("g_tevent"), v("g_frame").where("head_tok % 4 <> 1"), (F.col("start_tok") % 10).cast("double") / 10)


@query("entity_salience", """WITH m AS (SELECT doc_id, coalesce(kb_id, surface) AS entity, count(DISTINCT id) AS mentions FROM g_mention GROUP BY 1, 2), e AS (SELECT doc_id, count(*) AS events FROM g_tevent GROUP BY 1)
SELECT doc_id, entity, mentions, coalesce(events, 0) AS events, round((0.6 * mentions + 0.4 * coalesce(events, 0)) / (mentions + coalesce(events, 0) + 1), 4) AS salience FROM m LEFT JOIN e USING (doc_id)""")
def entity_salience(v: Views) -> DataFrame:
    """GA-05: salience of entities in documents."""
    return enhance.salience(v("g_mention"), fusion.entity(), v("g_tevent").groupBy("doc_id").agg(F.count("*").alias("events")))


@query("coref_chain_quality", "SELECT doc_id, coalesce(kb_id, surface) AS entity, count(*) AS mentions, count(DISTINCT kb_id) AS anchored, CAST(CASE WHEN count(*) >= 5 AND count(kb_id) >= 1 THEN 0.92 WHEN count(*) >= 3 AND count(kb_id) >= 1 THEN 0.82 WHEN count(*) >= 2 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM g_mention GROUP BY 1, 2")
def coref_chain_quality(v: Views) -> DataFrame:
    """GA-07: quality of mention chains."""
    return enhance.chain_quality(v("g_mention"), fusion.entity())


# Identifiers and similarities

@query("mention_identifiers", r"""SELECT id, 'ne_' || CAST(doc_id AS STRING) || '_' || substr(sha1(CAST(doc_id AS STRING) || '|' || lower(trim(surface)) || '|' || CAST(sent_idx AS STRING)), 1, 20) AS ne_uid,
'em_' || CAST(doc_id AS STRING) || '_' || substr(sha1(CAST(doc_id AS STRING) || '|events|' || lower(trim(surface)) || '|' || CAST(sent_idx AS STRING)), 1, 20) AS em_uid, 'entity_' || substr(sha1(lower(trim(surface)) || '|' || lower(type)), 1, 20) AS entity_id FROM g_mention""")
def mention_identifiers(v: Views) -> DataFrame:
    """FN-UID-*, FN-ID-ENTITY: stable identifiers of mentions."""
    doc, s, h = F.col("doc_id"), F.col("surface"), F.col("sent_idx")
    return v("g_mention").select("id", ids.named_entity_uid(doc, s, h).alias("ne_uid"), ids.mention_uid(doc, s, h, F.lit("events")).alias("em_uid"), ids.entity_id(s, F.col("type")).alias("entity_id"))


@query("confidence_calibrated", """SELECT id, greatest(0.0, least(1.0, 1 / (1 + exp(-(2.0 * ln(least(1 - 1e-6, greatest(1e-6, greatest(0.0, least(1.0, confidence)))) / (1 - least(1 - 1e-6, greatest(1e-6, greatest(0.0, least(1.0, confidence)))))) + 0.5))))) > 0.5 AS likely,
round(greatest(0.0, least(1.0, 0.5 * greatest(0.0, least(1.0, confidence)) + 0.25)), 9) AS affine FROM g_mention""")
def confidence_calibrated(v: Views) -> DataFrame:
    """FN-CALIB: calibrated confidences of mentions."""
    c = F.col("confidence")
    return v("g_mention").select("id", (scores.calibrated(c, 2.0, 0.5) > 0.5).alias("likely"), F.round(scores.calibrated(c, 0.5, 0.25, "affine"), 9).alias("affine"))


# Scoring

_STRICT = """g AS (SELECT doc_id, start_tok, end_tok, tense, count(*) AS g FROM g_gold GROUP BY 1,2,3,4), p AS (SELECT doc_id, start_tok, end_tok, tense, count(*) AS p FROM g_pred GROUP BY 1,2,3,4),
b AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.start_tok = p.start_tok AND g.end_tok = p.end_tok AND g.tense IS NOT DISTINCT FROM p.tense),
c AS (SELECT doc_id, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM b GROUP BY 1)"""
_PRF = "CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0 END AS precision, CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0 END AS recall"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


@query("strict_scores", f"WITH {_STRICT}, r AS (SELECT *, {_PRF.format(tp='tp', fp='fp', fn='fn')} FROM c) SELECT *, {_F1} AS f1 FROM r")
def strict_scores(v: Views) -> DataFrame:
    """EVAL-MENTION: strict scores of each document."""
    return evaluation.prf(evaluation.strict_counts(v("g_gold"), v("g_pred"), ["tense"]))


@query("micro_macro_f1", f"""WITH {_STRICT}, r AS (SELECT *, {_PRF.format(tp='tp', fp='fp', fn='fn')} FROM c), f AS (SELECT *, {_F1} AS f1 FROM r), m AS (SELECT {_PRF.format(tp='sum(tp)', fp='sum(fp)', fn='sum(fn)')} FROM c)
SELECT 'micro' AS average, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1}, 9) AS f1 FROM m UNION ALL SELECT 'macro', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM f""")
def micro_macro_f1(v: Views) -> DataFrame:
    """EVAL-AGG: micro and macro scores."""
    a = evaluation.aggregate(evaluation.strict_counts(v("g_gold"), v("g_pred"), ["tense"]))
    return a.select("average", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("error_buckets", """WITH x AS (SELECT g.id, p.id AS pid, CASE WHEN g.tense IS NOT DISTINCT FROM p.tense THEN 'exact' ELSE 'type' END AS bucket FROM g_gold g JOIN g_pred p ON g.doc_id = p.doc_id AND g.start_tok = p.start_tok AND g.end_tok = p.end_tok),
gl AS (SELECT * FROM g_gold WHERE id NOT IN (SELECT id FROM x)), pl AS (SELECT * FROM g_pred WHERE id NOT IN (SELECT pid FROM x)), o AS (SELECT gl.id, pl.id AS pid FROM gl JOIN pl ON gl.doc_id = pl.doc_id AND gl.start_tok <= pl.end_tok AND pl.start_tok <= gl.end_tok)
SELECT bucket, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'boundary', count(DISTINCT id) FROM o UNION ALL SELECT 'missing', count(*) FROM gl WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT 'spurious', count(*) FROM pl WHERE id NOT IN (SELECT pid FROM o)""")
def error_buckets(v: Views) -> DataFrame:
    """EVAL-BUCKET-M: mentions by kind of error."""
    return evaluation.error_buckets(v("g_gold"), v("g_pred"), "tense")


@query("projection_signature", "SELECT doc_id, sha256(string_agg(s, ';' ORDER BY s)) AS signature FROM (SELECT doc_id, CAST(start_tok AS STRING) || ':' || CAST(end_tok AS STRING) || ':' || coalesce(tense, '-') AS s FROM g_gold) GROUP BY 1")
def projection_signature(v: Views) -> DataFrame:
    """EVAL-SIG: content signatures of documents."""
    return evaluation.signature(v("g_gold"))


@query("relaxed_pairs")
def relaxed_pairs(v: Views) -> DataFrame:
    """EVAL-PAIR-RELAX: greedy one-to-one pairs of overlapping mentions."""
    wide = lambda df: df.withColumn("end_tok", F.col("end_tok") + 2)
    return evaluation.relaxed_pairs(wide(v("g_gold")), wide(v("g_pred")), 0.4)


@query("span_filter")
def span_filter(v: Views) -> DataFrame:
    """ING-SPANFILTER: longest non-overlapping spans."""
    return spans.non_overlapping(_spans5(v).withColumn("end_tok", F.col("end_tok") + F.col("start_tok") % 4))


# Runs and gates

@query("phase_execution_summary", "SELECT phase, count(*) AS executions, count(DISTINCT doc_id) AS documents, round(avg(duration), 6) AS mean_duration, max(duration) AS max_duration FROM g_phase_run GROUP BY 1")
def phase_execution_summary(v: Views) -> DataFrame:
    """Executions, documents and durations of each phase."""
    return v("g_phase_run").groupBy("phase").agg(F.count("*").alias("executions"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.max("duration").alias("max_duration"))


@query("recent_phase_runs", "SELECT id, phase, hour, duration FROM g_phase_run ORDER BY hour DESC, id DESC LIMIT 50")
def recent_phase_runs(v: Views) -> DataFrame:
    """The latest 50 runs."""
    return v("g_phase_run").orderBy(F.col("hour").desc(), F.col("id").desc()).limit(50).select("id", "phase", "hour", "duration")


@query("phase_variance", "SELECT phase, count(duration) AS n, round(avg(duration), 6) AS mean, round(stddev_samp(duration), 6) AS sd, min(duration) AS low, max(duration) AS high, min(duration) = max(duration) AS deterministic FROM g_phase_run GROUP BY 1")
def phase_variance(v: Views) -> DataFrame:
    """QL-VARIANCE: spread of durations."""
    out = quality.variance(v("g_phase_run").withColumn("value", F.col("duration")), "phase")
    return out.select("phase", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high", "deterministic")


@query("phase_run_report", "SELECT hour, phase, count(CASE WHEN failed THEN 1 END) AS failed, count(CASE WHEN NOT failed THEN 1 END) AS processed FROM g_phase_run GROUP BY 1, 2")
def phase_run_report(v: Views) -> DataFrame:
    """QA-RUNREPORT: processed and failed runs by hour and phase."""
    return v("g_phase_run").groupBy("hour", "phase").agg(F.count(F.when(F.col("failed"), 1)).alias("failed"), F.count(F.when(~F.col("failed"), 1)).alias("processed"))


@query("materialization_gate", """WITH c AS (SELECT 'tokens' AS label, count(*) AS n, 1000.0 AS bound FROM g_token UNION ALL SELECT 'events', count(*), 100.0 FROM g_tevent UNION ALL SELECT 'timexes', count(*), 1e12 FROM g_timex)
SELECT label, CAST(n AS DOUBLE) AS actual, CAST(bound AS DOUBLE) AS bound, 'minimum' AS kind, n >= bound AS passed FROM c""")
def materialization_gate(v: Views) -> DataFrame:
    """QA-GATE: counts against their minima; the last bound is out of reach and fails."""
    counts = prims.metrics({"tokens": (v("g_token"), lambda: F.count("*")), "events": (v("g_tevent"), lambda: F.count("*")), "timexes": (v("g_timex"), lambda: F.count("*"))})
    return quality.checks(counts, {"tokens": 1000, "events": 100, "timexes": 1e12})


@query("run_comparison", """WITH b AS (SELECT phase AS metric, avg(duration) AS before FROM g_phase_run WHERE id % 2 = 0 GROUP BY 1), a AS (SELECT phase AS metric, avg(duration) AS after FROM g_phase_run WHERE id % 2 = 1 GROUP BY 1)
SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN after - before < -0.01 THEN 'regressed' WHEN after - before > 0.01 THEN 'improved' ELSE 'same' END AS status FROM b FULL JOIN a USING (metric)""")
def run_comparison(v: Views) -> DataFrame:
    """QL-COMPARE: two halves of the runs against each other."""
    half = lambda k: v("g_phase_run").where(F.col("id") % 2 == k).groupBy(F.col("phase").alias("metric")).agg(F.avg("duration").alias("value"))
    c = quality.compare(half(0), half(1))
    return c.select("metric", *(F.round(x, 6).alias(x) for x in ("before", "after", "delta")), "status")
