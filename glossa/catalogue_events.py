"""Registered queries on events, arguments and reports, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _SPANS5, _spans5
from .functions import scores
from .operators import events, reports, tlinks
from .plans import prims
from .registry import Views, query


@query("frame_describes_event", """SELECT e.doc_id, u.frame_id, e.id AS event_id, max(u.via) AS via FROM (SELECT doc_id, id AS frame_id, head_tok, 'frame' AS via FROM g_frame UNION ALL SELECT doc_id, frame_id, head_tok, 'argument' FROM g_frame_argument) u
JOIN g_tevent e ON e.doc_id = u.doc_id AND e.start_tok = u.head_tok GROUP BY 1, 2, 3""")
def frame_describes_event(v: Views) -> DataFrame:
    """EV-FRAME: events triggered by frames and their arguments."""
    return events.frame_events(v("g_frame"), v("g_frame_argument"), v("g_tevent"))


_PARTICIPANTS = """p AS (SELECT a.doc_id, a.id AS argument_id, a.role, e.id AS event_id, abs(f.head_tok - e.start_tok) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY abs(f.head_tok - e.start_tok), e.start_tok) AS rn
FROM g_frame_argument a JOIN g_frame f ON f.id = a.frame_id JOIN g_tevent e ON e.doc_id = a.doc_id AND abs(f.head_tok - e.start_tok) <= 5 WHERE a.role IN ({roles}) AND NOT e.merged)"""


@query("core_participants", f"WITH {_PARTICIPANTS.format(roles="'ARG0','ARG1','ARG2'")} SELECT doc_id, argument_id, role, event_id, distance FROM p WHERE rn = 1")
def core_participants(v: Views) -> DataFrame:
    """EV-PART-CORE: core arguments at the nearest unmerged event."""
    return events.core_participants(v("g_frame_argument"), v("g_frame"), v("g_tevent").where("not merged"), ["ARG0", "ARG1", "ARG2"])


@query("non_core_participants", f"WITH {_PARTICIPANTS.format(roles="'ARGM-TMP','ARGM-CAU','ARGM-NEG'")} SELECT doc_id, argument_id, event_id, CASE role WHEN 'ARGM-TMP' THEN 'Temporal' WHEN 'ARGM-CAU' THEN 'Cause' ELSE 'Negation' END AS argument_type FROM p WHERE rn = 1")
def non_core_participants(v: Views) -> DataFrame:
    """EV-PART-NONCORE: modifiers with the type of their argument."""
    p = events.core_participants(v("g_frame_argument"), v("g_frame"), v("g_tevent").where("not merged"), ["ARGM-TMP", "ARGM-CAU", "ARGM-NEG"])
    return p.select("doc_id", "argument_id", "event_id", prims.case_map(F.col("role"), events.ARGUMENT_TYPES).alias("argument_type"))


@query("causal_links", """SELECT DISTINCT a.doc_id, c.id AS cause_id, e.id AS effect_id FROM g_frame_argument a JOIN g_tevent c ON c.doc_id = a.doc_id AND c.start_tok = a.head_tok JOIN g_frame f ON f.id = a.frame_id JOIN g_tevent e ON e.doc_id = f.doc_id AND e.start_tok = f.head_tok WHERE a.role = 'ARGM-CAU' AND c.id <> e.id""")
def causal_links(v: Views) -> DataFrame:
    """EV-CLINK-ARG: causes inside causal arguments."""
    return events.causal_links(v("g_frame_argument"), v("g_frame"), v("g_tevent"))


_REPORTED = "r AS (SELECT * FROM (SELECT doc_id, id AS event_id, lead(id) OVER w AS sub_id, lead(start_tok) OVER w - start_tok AS distance, start_tok % 4 = 0 AS reports FROM g_tevent WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY start_tok)) WHERE reports AND distance <= 10)"


@query("reported_events", f"WITH {_REPORTED} SELECT doc_id, event_id, sub_id, distance FROM r")
def reported_events(v: Views) -> DataFrame:
    """EV-SLINK: reporting events and what they report."""
    return events.reported(v("g_tevent"), F.col("start_tok") % 4 == 0)


@query("event_factuality", f"WITH {_REPORTED}, s AS (SELECT DISTINCT sub_id FROM r) SELECT e.doc_id, e.id, CASE WHEN polarity = 'NEG' THEN 'NEGATED' WHEN s.sub_id IS NOT NULL THEN 'REPORTED' WHEN coalesce(tense,'NONE') IN ('FUTURE','INFINITIVE') THEN 'HYPOTHETICAL' ELSE 'ASSERTED' END AS factuality FROM g_tevent e LEFT JOIN s ON s.sub_id = e.id")
def event_factuality(v: Views) -> DataFrame:
    """EV-FACTUALITY: factuality of every event."""
    return events.factuality(v("g_tevent"), events.reported(v("g_tevent"), F.col("start_tok") % 4 == 0))


@query("factuality_coverage", f"WITH {_REPORTED}, s AS (SELECT DISTINCT sub_id FROM r) SELECT CASE WHEN polarity = 'NEG' THEN 'NEGATED' WHEN s.sub_id IS NOT NULL THEN 'REPORTED' WHEN coalesce(tense,'NONE') IN ('FUTURE','INFINITIVE') THEN 'HYPOTHETICAL' ELSE 'ASSERTED' END AS factuality, count(*) AS n FROM g_tevent e LEFT JOIN s ON s.sub_id = e.id GROUP BY 1")
def factuality_coverage(v: Views) -> DataFrame:
    """Events by factuality."""
    return event_factuality(v).groupBy("factuality").agg(F.count("*").alias("n"))


@query("event_defaults", "SELECT doc_id, id, coalesce(tense,'NONE') AS tense, coalesce(aspect,'NONE') AS aspect, CASE WHEN coalesce(tense,'NONE') IN ('FUTURE','INFINITIVE') THEN 'FUTURE' WHEN tense IS NULL THEN 'NON_FUTURE_OR_NONE' ELSE 'NON_FUTURE' END AS time FROM g_tevent")
def event_defaults(v: Views) -> DataFrame:
    """EV-DEFAULTS and EV-TIME."""
    return events.defaults(v("g_tevent"))


@query("event_support", f"""WITH {_PARTICIPANTS.format(roles="'ARG0','ARG1','ARG2'")}, {_REPORTED}, u AS (SELECT event_id AS id, 'participant' AS s FROM p WHERE rn = 1 UNION SELECT sub_id, 'reported' FROM r), n AS (SELECT id, count(*) AS sources FROM u GROUP BY 1)
SELECT doc_id, e.id, coalesce(sources, 0) AS sources, coalesce(sources, 0) < 1 AS low_confidence FROM g_tevent e LEFT JOIN n ON n.id = e.id""")
def event_support(v: Views) -> DataFrame:
    """EV-SUPPORT: sources that support each event."""
    r = events.reported(v("g_tevent"), F.col("start_tok") % 4 == 0).select(F.col("sub_id").alias("event_id"))
    return events.low_support(v("g_tevent"), {"participant": core_participants(v), "reported": r})


@query("standalone_frames", "SELECT doc_id, 'shadow_' || id AS id, head_tok, confidence * 0.5 AS confidence FROM g_frame f WHERE NOT EXISTS (SELECT 1 FROM g_tevent e WHERE e.doc_id = f.doc_id AND e.start_tok = f.head_tok AND NOT e.merged)")
def standalone_frames(v: Views) -> DataFrame:
    """GA-15: frames that no unmerged event covers."""
    return events.standalone_frames(v("g_frame"), v("g_tevent").where("not merged"))


@query("temporal_argument_candidates", "SELECT DISTINCT doc_id, head_tok, head FROM g_frame_argument a WHERE role = 'ARGM-TMP' AND NOT EXISTS (SELECT 1 FROM g_timex t WHERE t.doc_id = a.doc_id AND a.head_tok BETWEEN t.start_tok AND t.end_tok)")
def temporal_argument_candidates(v: Views) -> DataFrame:
    """TMP-SRLCAND: temporal arguments without a time expression."""
    return events.uncovered_arguments(v("g_frame_argument"), v("g_timex"))


@query("timex_reconciled", f"WITH {_SPANS5} SELECT doc_id, span_id AS id, CASE WHEN EXISTS (SELECT 1 FROM g_timex t WHERE t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.start_tok <= s.end_tok AND s.start_tok <= t.end_tok) THEN 'confirmed' ELSE 'needs_review' END AS status FROM s")
def timex_reconciled(v: Views) -> DataFrame:
    """TMP-RECON: candidate spans confirmed by a time expression."""
    return events.reconciled(_spans5(v).withColumnRenamed("span_id", "id"), v("g_timex"))


@query("argument_mentions", f"""WITH {_SPANS5}, m AS (SELECT a.doc_id, a.id AS argument_id, s.span_id AS mention_id, CAST(s.end_tok - s.start_tok AS BIGINT) AS width, row_number() OVER (PARTITION BY a.id ORDER BY s.end_tok - s.start_tok, s.span_id) AS rn FROM g_frame_argument a JOIN s ON s.doc_id = a.doc_id AND a.head_tok BETWEEN s.start_tok AND s.end_tok)
SELECT doc_id, argument_id, mention_id, width FROM m WHERE rn = 1""")
def argument_mentions(v: Views) -> DataFrame:
    """LNK-FA-VIA-EM: arguments and the shortest mention over their head."""
    return events.covering_mentions(v("g_frame_argument"), _spans5(v))


@query("span_specificity", f"""WITH {_SPANS5}, r AS (SELECT s.doc_id, s.span_id, min(CASE WHEN lower(text) IN ('no','none','neither','nicht','kein') THEN 0 WHEN lower(text) IN ('the','this','that','these','those','der','die','das','la','le','el') THEN 1 WHEN lower(text) IN ('a','an','some','any','ein','eine','un','une','una') THEN 2 ELSE 3 END) AS k
FROM s JOIN g_token t ON t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.tok_index_doc BETWEEN s.start_tok AND s.end_tok GROUP BY 1, 2) SELECT doc_id, span_id, CASE k WHEN 0 THEN 'NEG' WHEN 1 THEN 'SPC' WHEN 2 THEN 'USP' ELSE 'GEN' END AS specificity FROM r""")
def span_specificity(v: Views) -> DataFrame:
    """ENT-SPEC: specificity of spans."""
    return events.specificity(_spans5(v), v("g_token"))


@query("preposition_timex", """SELECT e.doc_id, e.id AS event_id, t.id AS timex_id, p.text AS preposition, CASE WHEN t.type = 'DURATION' AND lower(p.text) = 'for' AND e.tense IN ('PAST','PRESENT') THEN 'MEASURE' WHEN t.type = 'DATE' AND lower(p.text) = 'since' THEN 'BEGUN_BY' WHEN t.type = 'DURATION' AND lower(p.text) IN ('in','during') THEN 'IS_INCLUDED'
WHEN t.type = 'DATE' AND lower(p.text) IN ('by','until') AND e.tense = 'PAST' THEN 'ENDED_BY' WHEN t.type IN ('DATE','TIME') AND lower(p.text) = 'by' THEN 'BEFORE' WHEN t.type IN ('TIME','DATE','DURATION') AND lower(p.text) = 'before' THEN 'BEFORE' WHEN t.type IN ('TIME','DATE','DURATION') AND lower(p.text) = 'after' THEN 'AFTER'
WHEN t.type = 'TIME' AND lower(p.text) = 'at' THEN 'SIMULTANEOUS' WHEN t.type IN ('TIME','DATE','DURATION') AND lower(p.text) IN ('on','in') THEN 'IS_INCLUDED' ELSE 'VAGUE' END AS rel
FROM g_timex t JOIN g_token p ON p.doc_id = t.doc_id AND p.tok_index_doc = t.start_tok - 1 JOIN g_tevent e ON e.doc_id = t.doc_id AND e.sent_idx = t.sent_idx AND e.start_tok < t.start_tok WHERE NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true) AND t.start_tok <= 150""")
def preposition_timex(v: Views) -> DataFrame:
    """TL-05: events before a time expression, by the word in front of it."""
    t = v("g_timex").where("start_tok <= 150").select("doc_id", "sent_idx", F.col("id").alias("timex_id"), "type", F.col("start_tok").alias("timex_tok"), (F.col("start_tok") - 1).alias("tok_index_doc"))
    p = t.join(v("g_token").select("doc_id", "tok_index_doc", F.col("text").alias("preposition")), ["doc_id", "tok_index_doc"])
    e = tlinks.usable(v("g_tevent")).select("doc_id", "sent_idx", F.col("id").alias("event_id"), "start_tok", "tense")
    return p.join(e, ["doc_id", "sent_idx"]).where("start_tok < timex_tok").select("doc_id", "event_id", "timex_id", "preposition", events.preposition_timex_relation(F.col("preposition"), F.col("type"), F.col("tense")).alias("rel"))


# Inventories

@query("counts_by_label", "SELECT 'TagOccurrence' AS label, count(*) AS node_count FROM g_token UNION ALL SELECT 'TEvent', count(*) FROM g_tevent UNION ALL SELECT 'TIMEX', count(*) FROM g_timex UNION ALL SELECT 'Frame', count(*) FROM g_frame UNION ALL SELECT 'FrameArgument', count(*) FROM g_frame_argument UNION ALL SELECT 'NamedEntity', count(*) FROM g_mention")
def counts_by_label(v: Views) -> DataFrame:
    """Nodes of each label."""
    return reports.counts({"TagOccurrence": v("g_token"), "TEvent": v("g_tevent"), "TIMEX": v("g_timex"), "Frame": v("g_frame"), "FrameArgument": v("g_frame_argument"), "NamedEntity": v("g_mention")}, "label", "node_count")


@query("edge_type_distribution", "SELECT 'TLINK' AS rel_type, count(*) AS edge_count FROM g_tlink UNION ALL SELECT 'IS_DEPENDENT', count(*) FROM g_dep UNION ALL SELECT 'HAS_FRAME_ARGUMENT', count(*) FROM g_frame_argument")
def edge_type_distribution(v: Views) -> DataFrame:
    """Edges of each type."""
    return reports.counts({"TLINK": v("g_tlink"), "IS_DEPENDENT": v("g_dep"), "HAS_FRAME_ARGUMENT": v("g_frame_argument")}, "rel_type", "edge_count")


@query("entity_density", "SELECT d.doc_id, coalesce(e.n, 0) AS entity_mentions, coalesce(v.n, 0) AS event_mentions, coalesce(t.n, 0) AS timex_mentions FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT id) AS n FROM g_mention GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g_tevent GROUP BY 1) v USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g_timex GROUP BY 1) t USING (doc_id)")
def entity_density(v: Views) -> DataFrame:
    """Mentions of three layers in each document."""
    n = lambda name, out: v(name).groupBy("doc_id").agg(F.count("id").alias(out))
    d = v("documents").select("doc_id").join(n("g_mention", "entity_mentions"), "doc_id", "left").join(n("g_tevent", "event_mentions"), "doc_id", "left").join(n("g_timex", "timex_mentions"), "doc_id", "left")
    return d.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("entity_mentions", "event_mentions", "timex_mentions")))


_LABEL = "CASE id % 3 WHEN 0 THEN 'TEvent' WHEN 1 THEN 'TIMEX' ELSE 'Signal' END"


@query("orphaned_nodes", f"SELECT {_LABEL} AS label, count(*) AS orphans FROM (SELECT p_partkey AS id FROM part) WHERE id NOT IN (SELECT src FROM g_tlink WHERE NOT suppressed AND confidence > 0.08) AND id NOT IN (SELECT dst FROM g_tlink WHERE NOT suppressed AND confidence > 0.08) GROUP BY 1")
def orphaned_nodes(v: Views) -> DataFrame:
    """P-DEGREE0: nodes without a live confident link, by label."""
    return reports.isolated(v("part").select(F.col("p_partkey").alias("id")), v("g_tlink").where("not suppressed and confidence > 0.08")).groupBy(F.expr(_LABEL).alias("label")).agg(F.count("*").alias("orphans"))


@query("endpoint_contract_violations", f"WITH l AS (SELECT DISTINCT id, {_LABEL} AS label FROM (SELECT src AS id FROM g_tlink UNION SELECT dst FROM g_tlink)) SELECT g.rule_id AS rel_type, count(*) AS violation_count FROM g_tlink g JOIN l a ON a.id = g.src JOIN l b ON b.id = g.dst WHERE a.label = 'Signal' OR b.label = 'Signal' GROUP BY 1")
def endpoint_contract_violations(v: Views) -> DataFrame:
    """QA-ENDPOINT: links with an end that is neither an event nor a time expression."""
    e = v("g_tlink")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.expr(_LABEL))
    pairs = [(a, b) for a in ("TEvent", "TIMEX") for b in ("TEvent", "TIMEX")]
    return reports.endpoint_violations(e, nodes, pairs, F.col("rule_id"))


@query("temporal_anchor_gaps", """WITH a AS (SELECT doc_id, id FROM g_tevent UNION SELECT doc_id, id FROM g_timex), l AS (SELECT id FROM g_tevent WHERE NOT low_confidence AND NOT merged UNION SELECT id FROM g_timex WHERE type = 'DATE'), p AS (SELECT doc_id, count(*) AS total_anchors, count(l.id) AS connected_anchor_count FROM a LEFT JOIN l ON l.id = a.id GROUP BY 1)
SELECT *, total_anchors - connected_anchor_count AS isolated_anchor_count FROM p WHERE total_anchors > 1 AND (total_anchors > connected_anchor_count OR connected_anchor_count = 0)""")
def temporal_anchor_gaps(v: Views) -> DataFrame:
    """Documents with isolated temporal anchors."""
    anchors = v("g_tevent").select("doc_id", "id").union(v("g_timex").select("doc_id", "id"))
    linked = v("g_tevent").where("not low_confidence and not merged").select("id").union(v("g_timex").where("type = 'DATE'").select("id"))
    return reports.anchor_gaps(anchors, linked)


@query("referential_integrity", "SELECT 'Frame_DESCRIBES_TEvent' AS contract, count(*) AS violation_count FROM g_frame f WHERE NOT EXISTS (SELECT 1 FROM g_gold e WHERE e.doc_id = f.doc_id AND e.start_tok = f.head_tok) UNION ALL SELECT 'FrameArgument_OF_Frame', count(*) FROM g_frame_argument a WHERE frame_id NOT IN (SELECT id FROM g_frame WHERE framework = 'PROPBANK')")
def referential_integrity(v: Views) -> DataFrame:
    """Frames and arguments that point to nothing."""
    key = lambda tok: F.concat_ws(":", "doc_id", tok).alias("key")
    frames = reports.unreferenced(v("g_frame").select(key("head_tok")), "key", v("g_gold").select(key("start_tok")), "key")
    arguments = reports.unreferenced(v("g_frame_argument").select("frame_id"), "frame_id", v("g_frame").where("framework = 'PROPBANK'"), "id")
    return reports.counts({"Frame_DESCRIBES_TEvent": frames, "FrameArgument_OF_Frame": arguments}, "contract", "violation_count")


@query("tense_coverage", "SELECT doc_id, count(*) AS total, count(tense) AS covered, round(CAST(count(tense) AS DOUBLE) / count(*), 9) AS ratio FROM g_tevent GROUP BY 1")
def tense_coverage(v: Views) -> DataFrame:
    """Coverage of the tense in each document."""
    return reports.coverage(v("g_tevent"), ["doc_id"], F.col("tense")).withColumn("ratio", F.round("ratio", 9))


@query("frame_confidence_histogram", "SELECT CAST(confidence >= 0.25 AS BIGINT) + CAST(confidence >= 0.5 AS BIGINT) + CAST(confidence >= 0.75 AS BIGINT) AS bucket, count(*) AS n FROM g_frame GROUP BY 1")
def frame_confidence_histogram(v: Views) -> DataFrame:
    """QL-SRL: frames by confidence."""
    return reports.histogram(v("g_frame"), F.col("confidence"), [0.25, 0.5, 0.75])


@query("srl_quality", "SELECT f.doc_id, count(*) AS frames, count(a.n) AS frames_with_arguments, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS arguments, round(CAST(coalesce(sum(a.n), 0) AS DOUBLE) / count(*), 9) AS argument_density FROM g_frame f LEFT JOIN (SELECT frame_id, count(*) AS n FROM g_frame_argument GROUP BY 1) a ON a.frame_id = f.id GROUP BY 1")
def srl_quality(v: Views) -> DataFrame:
    """QL-SRL: frame coverage and argument density of each document."""
    n = v("g_frame_argument").groupBy(F.col("frame_id").alias("id")).agg(F.count("*").alias("n"))
    per = v("g_frame").join(n, "id", "left").groupBy("doc_id").agg(F.count("*").alias("frames"), F.count("n").alias("frames_with_arguments"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("arguments"))
    return per.withColumn("argument_density", F.round(scores.ratio(F.col("arguments"), F.col("frames")), 9))


@query("worst_documents", """WITH s AS (SELECT g.doc_id, count(*) AS gold, count(p.id) AS hits FROM g_gold g LEFT JOIN g_pred p ON p.doc_id = g.doc_id AND p.start_tok = g.start_tok AND p.end_tok = g.end_tok GROUP BY 1)
SELECT doc_id, gold, hits, round(CAST(hits AS DOUBLE) / gold, 9) AS recall FROM s ORDER BY CAST(hits AS DOUBLE) / gold, doc_id LIMIT 20""")
def worst_documents(v: Views) -> DataFrame:
    """EVAL-DIAG: the 20 documents with the lowest recall."""
    p = v("g_pred").select("doc_id", "start_tok", "end_tok", F.col("id").alias("pred_id"))
    per = v("g_gold").join(p, ["doc_id", "start_tok", "end_tok"], "left").groupBy("doc_id").agg(F.count("*").alias("gold"), F.count("pred_id").alias("hits"))
    return per.withColumn("recall", scores.ratio(F.col("hits"), F.col("gold"))).orderBy("recall", "doc_id").limit(20).withColumn("recall", F.round("recall", 9))


@query("dependency_neighbourhood", """WITH d AS (SELECT doc_id, head_tok AS src, dep_tok AS dst FROM g_dep WHERE head_tok <> dep_tok), s AS (SELECT doc_id, dep_tok AS origin FROM g_dep WHERE type = 'ROOT'), h1 AS (SELECT DISTINCT s.doc_id, origin, dst FROM s JOIN d ON d.doc_id = s.doc_id AND d.src = s.origin), h2 AS (SELECT DISTINCT h1.doc_id, origin, d.dst FROM h1 JOIN d ON d.doc_id = h1.doc_id AND d.src = h1.dst),
n2 AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.doc_id = h2.doc_id AND h1.origin = h2.origin AND h1.dst = h2.dst) AND h2.dst <> h2.origin), u AS (SELECT doc_id, origin, 0 AS hops FROM s UNION ALL SELECT doc_id, origin, 1 FROM h1 UNION ALL SELECT doc_id, origin, 2 FROM n2) SELECT doc_id, origin, hops, count(*) AS nodes FROM u GROUP BY 1, 2, 3""")
def dependency_neighbourhood(v: Views) -> DataFrame:
    """P-PATH: tokens within two dependency steps below each root, by distance."""
    d = v("g_dep")
    below = d.where("head_tok <> dep_tok").select("doc_id", F.col("head_tok").alias("src"), F.col("dep_tok").alias("dst"))
    roots = d.where("type = 'ROOT'").select("doc_id", F.col("dep_tok").alias("node"))
    return prims.reachable(below, roots, 2, ["doc_id"]).groupBy("doc_id", "origin", "hops").agg(F.count("*").alias("nodes"))
