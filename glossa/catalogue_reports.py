"""Registered coverage reports, contracts and further link rules, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _closure, _ROUNDS
from .operators import coverage, rules, tlinks
from .plans import prims
from .registry import Views, query


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({part} AS DOUBLE) / {whole} END"


def _coverage_sql(table: str, present: str, total: str, with_it: str) -> str:
    return f"SELECT *, {_ratio(with_it, total)} AS coverage_ratio FROM (SELECT count(*) AS {total}, count(CASE WHEN {present} THEN 1 END) AS {with_it} FROM {table}) x"


@query("clause_scope_inventory", "SELECT coalesce(clause_type, 'UNSET') AS clause_type, coalesce(scope_type, 'UNSET') AS scope_type, count(*) AS mention_count FROM g_event_mention GROUP BY 1, 2")
def clause_scope_inventory(v: Views) -> DataFrame:
    """Event mentions by clause and scope."""
    unset = lambda c: F.coalesce(c, F.lit("UNSET")).alias(c)
    return v("g_event_mention").groupBy(unset("clause_type"), unset("scope_type")).agg(F.count("*").alias("mention_count"))


@query("clause_scope_population_rate", f"SELECT *, {_ratio('with_clause', 'total_mentions')} AS clause_coverage, {_ratio('with_scope', 'total_mentions')} AS scope_coverage FROM (SELECT d.doc_id, count(m.id) AS total_mentions, count(m.clause_type) AS with_clause, count(m.scope_type) AS with_scope FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g_event_mention m ON m.doc_id = d.doc_id GROUP BY 1) x")
def clause_scope_population_rate(v: Views) -> DataFrame:
    """Clauses and scopes of each document's event mentions."""
    return coverage.scope_population(v("documents"), v("g_event_mention"))


@query("entity_specificity_coverage", _coverage_sql("g_entity_mention", "coalesce(ent_class, '') <> ''", "total_mentions", "mentions_with_ent_class"))
def entity_specificity_coverage(v: Views) -> DataFrame:
    """Entity mentions with a class."""
    return coverage.coverage(v("g_entity_mention"), F.coalesce("ent_class", F.lit("")) != "", "total_mentions", "mentions_with_ent_class")


@query("entity_state_coverage", _coverage_sql("g_entity_mention", "coalesce(trim(entity_state), '') <> ''", "total_entity_mentions", "entity_mentions_with_state"))
def entity_state_coverage(v: Views) -> DataFrame:
    """Entity mentions with a state."""
    return coverage.coverage(v("g_entity_mention"), coverage.filled("entity_state"), "total_entity_mentions", "entity_mentions_with_state")


@query("entity_state_type_distribution", "SELECT CASE WHEN coalesce(trim(state_type), '') = '' THEN 'STATE' ELSE trim(state_type) END AS entity_state_type, count(*) AS mention_count FROM g_entity_mention WHERE coalesce(trim(entity_state), '') <> '' GROUP BY 1")
def entity_state_type_distribution(v: Views) -> DataFrame:
    """Stated entity mentions by the state's type."""
    kind = F.when(coverage.filled("state_type"), F.trim("state_type")).otherwise("STATE").alias("entity_state_type")
    return v("g_entity_mention").where(coverage.filled("entity_state")).groupBy(kind).agg(F.count("*").alias("mention_count"))


@query("event_external_ref_coverage", _coverage_sql("(SELECT external_ref FROM g_event_mention UNION ALL SELECT CAST(NULL AS VARCHAR) FROM g_tevent) n", "coalesce(external_ref, '') <> ''", "total_event_nodes", "event_nodes_with_external_ref"))
def event_external_ref_coverage(v: Views) -> DataFrame:
    """Event mentions and events with an external reference."""
    nodes = v("g_event_mention").select("external_ref").unionByName(v("g_tevent").select(F.lit(None).cast("string").alias("external_ref")))
    return coverage.coverage(nodes, F.coalesce("external_ref", F.lit("")) != "", "total_event_nodes", "event_nodes_with_external_ref")


@query("factuality_mention_coverage", _coverage_sql("g_event_mention", "coalesce(trim(factuality), '') <> ''", "total_event_mentions", "event_mentions_with_factuality"))
def factuality_mention_coverage(v: Views) -> DataFrame:
    """Event mentions with a factuality."""
    return coverage.coverage(v("g_event_mention"), coverage.filled("factuality"), "total_event_mentions", "event_mentions_with_factuality")


@query("factuality_alignment_violations", "SELECT upper(factuality) AS mention_factuality, upper(event_factuality) AS tevent_factuality, count(*) AS violation_count FROM g_event_mention WHERE trim(coalesce(factuality, '')) <> '' AND trim(coalesce(event_factuality, '')) <> '' AND upper(factuality) <> upper(event_factuality) AND NOT conflict_flag GROUP BY 1, 2")
def factuality_alignment_violations(v: Views) -> DataFrame:
    """Mentions and events that disagree on factuality."""
    return coverage.factuality_disagreements(v("g_event_mention"))


@query("factuality_attribution_violations", "SELECT count(CASE WHEN trim(coalesce(factuality_source, '')) = '' THEN 1 END) AS missing_source_count, count(CASE WHEN factuality_confidence IS NULL THEN 1 END) AS missing_confidence_count, count(CASE WHEN trim(coalesce(factuality_source, '')) = '' OR factuality_confidence IS NULL THEN 1 END) AS missing_contract_count FROM g_event_mention WHERE trim(coalesce(factuality, '')) <> ''")
def factuality_attribution_violations(v: Views) -> DataFrame:
    """Factualities without source or confidence."""
    return coverage.factuality_attribution(v("g_event_mention"))


@query("glink_relation_inventory", "SELECT coalesce(rel_type, '') AS reltype, count(*) AS glink_count FROM g_glink GROUP BY 1")
def glink_relation_inventory(v: Views) -> DataFrame:
    """Aspectual links by type."""
    return v("g_glink").groupBy(F.coalesce("rel_type", F.lit("")).alias("reltype")).agg(F.count("*").alias("glink_count"))


@query("signal_completeness", "SELECT count(*) AS total, count(text) AS with_text, count(start_tok) AS with_start_tok, count(end_tok) AS with_end_tok, count(CASE WHEN text IS NULL OR start_tok IS NULL OR end_tok IS NULL THEN 1 END) AS missing_core FROM g_signal")
def signal_completeness(v: Views) -> DataFrame:
    """TimeML fields of signals."""
    t, a, b = F.col("text"), F.col("start_tok"), F.col("end_tok")
    return prims.completeness(v("g_signal"), {"with_text": t, "with_start_tok": a, "with_end_tok": b}, [t, a, b])


@query("timexmention_contract_inventory", """SELECT 'missing_doc_id' AS metric, count(CASE WHEN doc_id IS NULL THEN 1 END) AS item_count FROM g_timex_mention UNION ALL SELECT 'missing_span_coordinates', count(CASE WHEN start_tok IS NULL OR end_tok IS NULL THEN 1 END) FROM g_timex_mention
UNION ALL SELECT 'broken_refers_to_chain', count(*) FROM g_timex_mention m WHERE NOT EXISTS (SELECT 1 FROM g_timex t WHERE t.id = m.refers_to) UNION ALL SELECT 'dct_timexmention_count', count(CASE WHEN upper(trim(coalesce(tid, ''))) IN ('DCT', 'T0') THEN 1 END) FROM g_timex_mention""")
def timexmention_contract_inventory(v: Views) -> DataFrame:
    """Time mentions that break their contract."""
    return coverage.timex_mention_contract(v("g_timex_mention"), v("g_timex"))


@query("numeric_value_transition_inventory", "SELECT 'namedentity_numeric_labels' AS metric, count(CASE WHEN numeric_label THEN 1 END) AS item_count FROM g_entity_mention UNION ALL SELECT 'namedentity_value_labels', count(CASE WHEN value_label THEN 1 END) FROM g_entity_mention UNION ALL SELECT 'canonical_value_nodes', count(*) FROM g_token WHERE pos = 'CD' UNION ALL SELECT 'namedentity_value_tagged_history', count(CASE WHEN value_tagged THEN 1 END) FROM g_entity_mention")
def numeric_value_transition_inventory(v: Views) -> DataFrame:
    """Numeric and value labels of entities, and value nodes."""
    e, n = v("g_entity_mention"), lambda c: lambda: F.count(F.when(F.col(c), 1))
    return prims.metrics({"namedentity_numeric_labels": (e, n("numeric_label")), "namedentity_value_labels": (e, n("value_label")), "canonical_value_nodes": (v("g_token").where("pos = 'CD'"), lambda: F.count("*")), "namedentity_value_tagged_history": (e, n("value_tagged"))})


def _lemmas(name: str) -> str:
    return ", ".join(f"'{x}'" for x in rules.ASPECTUAL[name])


@query("glink_bridge", f"""WITH g AS (SELECT *, CASE WHEN lower(lemma) IN ({_lemmas('BEGUN_BY')}) THEN 'BEGUN_BY' WHEN lower(lemma) IN ({_lemmas('ENDED_BY')}) THEN 'ENDED_BY' WHEN lower(lemma) IN ({_lemmas('INCLUDES')}) THEN 'INCLUDES' WHEN lower(lemma) IN ({_lemmas('SIMULTANEOUS')}) THEN 'SIMULTANEOUS' END AS rel FROM g_glink)
SELECT DISTINCT g.doc_id, CASE WHEN rel IN ('BEGUN_BY','ENDED_BY') THEN dst ELSE src END AS first_id, CASE WHEN rel IN ('BEGUN_BY','ENDED_BY') THEN src ELSE dst END AS second_id, rel, CAST(0.88 AS DOUBLE) AS confidence FROM g JOIN g_tevent a ON a.id = src JOIN g_tevent b ON b.id = dst WHERE rel IS NOT NULL AND NOT a.low_confidence AND NOT a.merged AND coalesce(a.is_timeml_core, true) AND NOT b.low_confidence AND NOT b.merged AND coalesce(b.is_timeml_core, true)""")
def glink_bridge(v: Views) -> DataFrame:
    """TL-12: temporal links from aspectual ones."""
    return rules.aspectual_bridge(v("g_tevent"), v("g_glink"))


_CANDIDATES = "SELECT DISTINCT e.doc_id, e.id AS event_id, c.timex_id, 'IS_INCLUDED' AS rel, CAST({0} AS DOUBLE) AS confidence FROM g_timex_candidate c JOIN g_frame_argument a ON a.id = c.argument_id AND a.role = 'ARGM-TMP' JOIN g_frame f ON f.id = a.frame_id JOIN g_tevent e ON e.doc_id = f.doc_id AND e.start_tok = f.head_tok WHERE NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true) AND coalesce(c.value, '') <> '' AND c.timex_id IS NOT NULL"


@query("nominal_candidate_links", _CANDIDATES.format("0.58") + " AND f.framework = 'NOMBANK'")
def nominal_candidate_links(v: Views) -> DataFrame:
    """TL-10: nominal events and the times behind their temporal arguments."""
    return rules.candidate_links(v("g_tevent"), v("g_frame"), v("g_frame_argument"), v("g_timex_candidate"), True)


@query("anchor_candidate_links", _CANDIDATES.format("0.57"))
def anchor_candidate_links(v: Views) -> DataFrame:
    """TL-11: events and the times that their temporal arguments anchor them to."""
    return rules.candidate_links(v("g_tevent"), v("g_frame"), v("g_frame_argument"), v("g_timex_candidate"), False)


@query("document_identity_closure", f"WITH e AS (SELECT src, dst, upper(rel_type) AS rel, confidence, suppressed FROM g_elink), {_closure(_ROUNDS)} " + " UNION ALL ".join(f"SELECT src, dst, rel, confidence, CAST({k} AS BIGINT) AS closure_round FROM n{k}" for k in range(1, _ROUNDS + 1)))
def document_identity_closure(v: Views) -> DataFrame:
    """TL-CLOSURE: all three rounds over the links of events in documents."""
    e = v("g_elink").select("src", "dst", F.upper("rel_type").alias("rel"), "confidence", "suppressed")
    return tlinks.identity_closure(e, rounds=_ROUNDS).withColumn("closure_round", F.col("closure_round").cast("long"))
