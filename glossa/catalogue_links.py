"""Registered queries on linking, further rules, relations and runs, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _SPANS5, _spans5
from .functions import scores
from .operators import linking, quality, rules, spans
from .registry import Views, query

_HEADS = f"""{_SPANS5}, si AS (SELECT s.*, t.tok_index_doc, t.pos, d.head_tok FROM s JOIN g_token t ON t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.tok_index_doc BETWEEN s.start_tok AND s.end_tok LEFT JOIN g_dep d ON d.doc_id = t.doc_id AND d.dep_tok = t.tok_index_doc AND d.head_tok <> d.dep_tok),
h AS (SELECT doc_id, span_id, min(tok_index_doc) AS head_tok FROM si WHERE head_tok IS NULL OR head_tok < start_tok OR head_tok > end_tok GROUP BY 1, 2)"""


def _heads(v: Views) -> DataFrame:
    return spans.heads(_spans5(v), v("g_token"), v("g_dep"))


@query("argument_entities", f"WITH {_HEADS} SELECT DISTINCT a.doc_id, a.id AS argument_id, h.span_id FROM g_frame_argument a JOIN h ON h.doc_id = a.doc_id AND h.head_tok = a.head_tok")
def argument_entities(v: Views) -> DataFrame:
    """LNK-FA-NE: arguments and spans with one head."""
    return linking.by_head(v("g_frame_argument"), _heads(v))


@query("argument_complement_entities", f"WITH {_HEADS} SELECT DISTINCT a.doc_id, a.id AS argument_id, h.span_id FROM g_frame_argument a JOIN g_dep d ON d.doc_id = a.doc_id AND d.head_tok = a.head_tok AND d.type = 'pobj' AND d.head_tok <> d.dep_tok JOIN h ON h.doc_id = a.doc_id AND h.head_tok = d.dep_tok")
def argument_complement_entities(v: Views) -> DataFrame:
    """LNK-FA-POBJ: arguments whose complement heads a span."""
    return linking.by_complement(v("g_frame_argument"), v("g_dep"), _heads(v))


@query("nested_spans", f"WITH {_SPANS5} SELECT a.doc_id, a.span_id AS inner_id, b.span_id AS outer_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.span_id <> b.span_id AND a.start_tok BETWEEN b.start_tok AND b.end_tok AND a.end_tok <= b.end_tok AND b.end_tok - b.start_tok > a.end_tok - a.start_tok")
def nested_spans(v: Views) -> DataFrame:
    """ING-FUSE-KB: spans inside spans."""
    return linking.nested(_spans5(v))


@query("stale_entities", "SELECT kb_id, count(*) AS mentions FROM g_mention WHERE kb_id IS NOT NULL AND kb_id NOT IN (SELECT kb_id FROM g_mention WHERE kb_id IS NOT NULL AND confidence > 3) GROUP BY 1")
def stale_entities(v: Views) -> DataFrame:
    """ING-STALE: entities that no mention of high confidence names."""
    m = v("g_mention").where("kb_id is not null")
    return linking.stale(m.groupBy("kb_id").agg(F.count("*").alias("mentions")), m.where("confidence > 3"), "kb_id")


@query("chain_entities", """WITH m AS (SELECT doc_id, surface AS chain, CASE WHEN id % 6 = 0 THEN kb_id || 'x' ELSE kb_id END AS kb_id FROM g_mention), b AS (SELECT doc_id, chain, kb_id AS chain_kb FROM (SELECT doc_id, chain, kb_id, row_number() OVER (PARTITION BY doc_id, chain ORDER BY count(*) DESC, kb_id) AS rn FROM m WHERE kb_id IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1)
SELECT doc_id, chain, chain_kb, count(CASE WHEN kb_id IS NULL THEN 1 END) AS filled, count(CASE WHEN kb_id <> chain_kb THEN 1 END) AS conflicts FROM m JOIN b USING (doc_id, chain) GROUP BY 1, 2, 3""")
def chain_entities(v: Views) -> DataFrame:
    """NEL-HAVE and NEL-MISS: ids of coreference chains."""
    m = v("g_mention").withColumn("kb_id", F.when(F.col("id") % 6 == 0, F.concat("kb_id", F.lit("x"))).otherwise(F.col("kb_id")))
    return linking.chain_kb(m, F.col("surface"))


@query("kb_candidate_choice", """WITH c AS (SELECT m.id AS mention_id, m.surface, n.n_name AS label FROM g_mention m JOIN nation n ON n.n_nationkey % 5 = m.id % 5),
s AS (SELECT *, round(1 - levenshtein(lower(surface), lower(label)) / greatest(length(surface), length(label), 1) + CASE WHEN lower(surface) = lower(label) THEN 0.04 ELSE 0 END, 6) AS score FROM c),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, label))
SELECT mention_id, label, score, CASE WHEN score < 0.3 THEN 'rejected' WHEN score - coalesce(second, 0) < 0.05 THEN 'ambiguous' ELSE 'resolved' END AS status FROM r WHERE place = 1""")
def kb_candidate_choice(v: Views) -> DataFrame:
    """ING-KBSCORE: every mention against five candidate names."""
    m, n = v("g_mention"), v("nation")
    c = m.join(n, F.col("n_nationkey") % 5 == F.col("id") % 5).select(F.col("id").alias("mention_id"), "surface", F.col("n_name").alias("label"))
    return linking.kb_scores(c)


@query("numeric_values", r"SELECT doc_id, tok_index_doc, CASE WHEN text LIKE '$%' THEN 'MONEY' WHEN text LIKE '%\%' ESCAPE '\' THEN 'PERCENT' ELSE 'CARDINAL' END AS kind, CAST(regexp_replace(text, '[,$%]', '', 'g') AS DOUBLE) AS value FROM g_token WHERE regexp_matches(text, '^\$?[0-9][0-9,]*(\.[0-9]+)?%?$')")
def numeric_values(v: Views) -> DataFrame:
    """NUM-VALUE: numeric tokens."""
    return linking.values(v("g_token"))


@query("subject_object_triples", "SELECT f.doc_id, lower(a.head) AS subject, f.pred, lower(b.head) AS object, count(*) AS n FROM g_frame f JOIN g_frame_argument a ON a.frame_id = f.id AND a.role = 'ARG0' JOIN g_frame_argument b ON b.frame_id = f.id AND b.role = 'ARG1' GROUP BY 1, 2, 3, 4")
def subject_object_triples(v: Views) -> DataFrame:
    """ING-SVO: subject, predicate, object."""
    return linking.triples(v("g_frame_argument"), v("g_frame"))


@query("semantic_heads", f"""WITH {_SPANS5}, r AS (SELECT s.doc_id, s.span_id, t.tok_index_doc, CASE WHEN pos IN ('NN','NNS') THEN 0 WHEN pos = 'NNP' THEN 1 WHEN pos = 'PRP' THEN 2 ELSE 3 END AS rank, s.end_tok FROM s JOIN g_token t ON t.doc_id = s.doc_id AND t.sent_idx = CAST(floor(s.start_tok / 20) AS INT) AND t.tok_index_doc BETWEEN s.start_tok AND s.end_tok),
o AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY rank, end_tok - tok_index_doc, tok_index_doc DESC) AS rn FROM r) SELECT doc_id, span_id, tok_index_doc AS semantic_head, rank FROM o WHERE rn = 1""")
def semantic_heads(v: Views) -> DataFrame:
    """NOM-SEMHEAD: noun-preferred heads."""
    return linking.semantic_heads(_spans5(v), v("g_token"))


@query("nominal_profiles", f"WITH {_SPANS5}, p AS (SELECT doc_id, span_id, start_tok % 2 = 0 AS eventive, end_tok - start_tok >= 3 AS wide, start_tok < 40 AS early FROM s) SELECT doc_id, span_id, CAST(round(CASE WHEN eventive THEN 0.45 ELSE 0 END + CASE WHEN wide THEN 0.30 ELSE 0 END + CASE WHEN early THEN 0.15 ELSE 0 END, 4) AS DOUBLE) AS score, concat_ws(',', CASE WHEN eventive THEN 'eventive' END, CASE WHEN wide THEN 'wide' END, CASE WHEN early THEN 'early' END) AS signals FROM p")
def nominal_profiles(v: Views) -> DataFrame:
    """NOM-PROFILE: weighted signals of spans."""
    s = _spans5(v).withColumns({"eventive": F.col("start_tok") % 2 == 0, "wide": F.col("end_tok") - F.col("start_tok") >= 3, "early": F.col("start_tok") < 40})
    return linking.profile(s, {"eventive": 0.45, "wide": 0.30, "early": 0.15})


# Further rules

@query("argument_timex", """SELECT a.doc_id, e.id AS event_id, t.id AS timex_id, 'IS_INCLUDED' AS rel, CAST(0.88 AS DOUBLE) AS confidence FROM g_frame_argument a JOIN g_timex t ON t.doc_id = a.doc_id AND t.start_tok = a.head_tok JOIN g_frame f ON f.id = a.frame_id JOIN g_tevent e ON e.doc_id = f.doc_id AND e.start_tok = f.head_tok
WHERE a.role = 'ARGM-TMP' AND NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true) AND t.start_tok > e.start_tok AND t.start_tok - e.start_tok <= 15 GROUP BY 1, 2, 3""")
def argument_timex(v: Views) -> DataFrame:
    """TL-04: events included in the time expression of their temporal argument."""
    return rules.argument_timex(v("g_tevent"), v("g_frame"), v("g_frame_argument"), v("g_timex"))


@query("dependent_timex", "SELECT d.doc_id, e.id AS event_id, t.id AS timex_id, d.type AS via, 'IS_INCLUDED' AS rel FROM g_dep d JOIN g_tevent e ON e.doc_id = d.doc_id AND e.start_tok = d.head_tok JOIN g_timex t ON t.doc_id = d.doc_id AND t.start_tok = d.dep_tok WHERE d.head_tok <> d.dep_tok AND NOT e.low_confidence AND NOT e.merged AND coalesce(e.is_timeml_core, true)")
def dependent_timex(v: Views) -> DataFrame:
    """TL-15: time expressions that depend on events."""
    return rules.dependent_timex(v("g_tevent"), v("g_dep"), v("g_timex"))


@query("connective_links", """WITH m AS (SELECT doc_id, sent_idx, tok_index_doc AS tok, CASE lower(text) WHEN 'the' THEN 'AFTER' WHEN 'of' THEN 'BEFORE' END AS rel FROM g_token WHERE lower(text) IN ('the','of')), e AS (SELECT * FROM g_tevent WHERE NOT low_confidence AND NOT merged AND coalesce(is_timeml_core, true)),
b AS (SELECT m.doc_id, m.tok, m.rel, arg_max(e.id, e.start_tok) AS first_id, max(e.start_tok) AS bt FROM m JOIN e ON e.doc_id = m.doc_id AND e.sent_idx = m.sent_idx AND e.start_tok < m.tok GROUP BY 1, 2, 3), a AS (SELECT m.doc_id, m.tok, arg_min(e.id, e.start_tok) AS second_id, min(e.start_tok) AS at FROM m JOIN e ON e.doc_id = m.doc_id AND e.sent_idx = m.sent_idx AND e.start_tok > m.tok GROUP BY 1, 2)
SELECT doc_id, first_id, second_id, rel, tok AS signal_tok FROM b JOIN a USING (doc_id, tok) WHERE tok - bt <= 8 AND a.at - tok <= 8""")
def connective_links(v: Views) -> DataFrame:
    """TL-23: events around connectives; two frequent words stand in for them."""
    return rules.connective_links(v("g_tevent"), v("g_token"), {"the": "AFTER", "of": "BEFORE"})


@query("dateline_links", """WITH d AS (SELECT t.doc_id, arg_min(t.id, t.start_tok) AS timex_id, arg_min(t.end_tok, t.start_tok) AS line_end, any_value(left(t.value, 10)) AS day FROM g_timex_day t JOIN g_dct c ON c.doc_id = t.doc_id AND left(c.value, 10) = left(t.value, 10) WHERE t.type = 'DATE' GROUP BY 1),
e AS (SELECT v.* FROM g_tevent v JOIN g_token k ON k.doc_id = v.doc_id AND k.tok_index_doc = v.start_tok JOIN g_dep r ON r.doc_id = v.doc_id AND r.dep_tok = v.start_tok AND r.head_tok = v.start_tok AND r.type = 'ROOT' WHERE NOT v.low_confidence AND NOT v.merged AND coalesce(v.is_timeml_core, true) AND k.pos IN ('VBD','VBN','VBZ','VBP','VB','MD') AND v.start_tok <= 103 AND k.sent_idx <= 5),
m AS (SELECT e.doc_id, e.id AS event_id, d.timex_id, EXISTS (SELECT 1 FROM g_dep s JOIN g_timex_day t ON t.doc_id = s.doc_id AND t.start_tok = s.dep_tok WHERE s.type = 'nsubj' AND s.doc_id = e.doc_id AND s.head_tok = e.start_tok AND t.type = 'DATE' AND left(t.value, 10) = d.day) AS same FROM e JOIN d ON d.doc_id = e.doc_id AND e.start_tok > d.line_end)
SELECT doc_id, event_id, timex_id, 'timex_event' AS direction, CASE WHEN same THEN 'SIMULTANEOUS' ELSE 'INCLUDES' END AS rel, CAST(0.7 AS DOUBLE) AS confidence FROM m UNION ALL SELECT doc_id, event_id, timex_id, 'event_timex', CASE WHEN same THEN 'SIMULTANEOUS' ELSE 'IS_INCLUDED' END, CAST(0.7 AS DOUBLE) FROM m""")
def dateline_links(v: Views) -> DataFrame:
    """TL-22: root events of the first sentences and the dateline, both ways."""
    return rules.dateline_links(v("g_tevent"), v("g_timex_day"), v("g_dct"), v("g_token"), v("g_dep"))


@query("event_tense_from_auxiliaries", """WITH x AS (SELECT doc_id, head_tok AS a, dep_tok AS b FROM g_dep_words WHERE type IN ('aux','auxpass') AND head_tok <> dep_tok), y AS (SELECT doc_id, a AS tok, b AS other FROM x UNION ALL SELECT doc_id, b, a FROM x),
w AS (SELECT y.doc_id, y.tok, list(lower(t.text)) AS words FROM y JOIN g_token t ON t.doc_id = y.doc_id AND t.tok_index_doc = y.other GROUP BY 1, 2)
SELECT e.doc_id, e.id, CASE WHEN w.words IS NULL THEN e.tense WHEN list_has_any(w.words, ['was','were','had','did','been']) THEN 'PAST' WHEN list_has_any(w.words, ['will','shall','would','could']) THEN 'FUTURE' ELSE coalesce(e.tense, 'PRESENT') END AS tense,
CASE WHEN w.words IS NULL THEN e.aspect WHEN list_has_any(w.words, ['is','are','am','was','were','be','been']) AND k.text LIKE '%ing' THEN 'PROGRESSIVE' WHEN list_has_any(w.words, ['has','have','had']) THEN 'PERFECTIVE' ELSE coalesce(e.aspect, 'NONE') END AS aspect
FROM g_tevent e JOIN g_token k ON k.doc_id = e.doc_id AND k.tok_index_doc = e.start_tok LEFT JOIN w ON w.doc_id = e.doc_id AND w.tok = e.start_tok""")
def event_tense_from_auxiliaries(v: Views) -> DataFrame:
    """MORPH-TENSE: tense and aspect from auxiliaries."""
    return rules.tense_and_aspect(v("g_tevent"), v("g_token"), v("g_dep_words"))


# Relations, scorecards, runs

_REL = "SELECT DISTINCT src, dst, upper(rel_type) AS rel FROM g_tlink WHERE NOT suppressed AND l_linenumber % 2 = {k}"


@query("relation_scores", f"""WITH g AS ({_REL.format(k=0)}), p AS ({_REL.format(k=1)}), r AS (SELECT coalesce(g.rel, p.rel) AS rel, count(CASE WHEN g.src IS NOT NULL AND p.src IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN g.src IS NULL THEN 1 END) AS fp, count(CASE WHEN p.src IS NULL THEN 1 END) AS fn FROM g FULL JOIN p ON g.src = p.src AND g.dst = p.dst AND g.rel = p.rel GROUP BY 1)
SELECT * FROM r""")
def relation_scores(v: Views) -> DataFrame:
    """EVAL-REL-STRICT: relations of two halves matched as sets, by type."""
    half = lambda k, name: v("g_tlink").where(~F.col("suppressed") & (F.col("l_linenumber") % 2 == k)).select("src", "dst", F.upper("rel_type").alias("rel")).distinct().withColumn(name, F.lit(1))
    both = half(0, "g").join(half(1, "p"), ["src", "dst", "rel"], "full")
    return both.groupBy("rel").agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))


@query("head_matches", "SELECT g.doc_id, count(*) AS matches FROM g_gold g JOIN g_pred p ON p.doc_id = g.doc_id AND p.start_tok BETWEEN g.start_tok AND g.end_tok + 1 GROUP BY 1")
def head_matches(v: Views) -> DataFrame:
    """EVAL-HEAD: predictions whose head lies in a gold span widened by one token."""
    g = v("g_gold").select("doc_id", F.explode(F.sequence(F.col("start_tok"), F.col("end_tok") + 1)).alias("tok"))
    return g.join(v("g_pred").select("doc_id", F.col("start_tok").alias("tok")), ["doc_id", "tok"]).groupBy("doc_id").agg(F.count("*").alias("matches"))


@query("layer_scorecard", """WITH c AS (SELECT CAST((SELECT count(*) FROM g_tevent WHERE tense IS NOT NULL) AS DOUBLE) / (SELECT count(*) FROM g_tevent) AS event, CAST((SELECT count(*) FROM g_timex WHERE type <> 'SET') AS DOUBLE) / (SELECT count(*) FROM g_timex) AS timex, CAST((SELECT count(*) FROM g_mention WHERE kb_id IS NOT NULL) AS DOUBLE) / (SELECT count(*) FROM g_mention) AS entity)
SELECT round(event, 9) AS event, round(timex, 9) AS timex, round(entity, 9) AS entity, round(0.40 * event + 0.30 * timex + 0.30 * entity, 9) AS composite FROM c""")
def layer_scorecard(v: Views) -> DataFrame:
    """EVAL-SCORECARD: weighted composite of three layer rates."""
    rate = lambda df, ok, name: df.agg(scores.ratio(F.count(F.when(ok, 1)), F.count("*")).alias(name)).withColumn("one", F.lit(1))
    rows = rate(v("g_tevent"), F.col("tense").isNotNull(), "event").join(rate(v("g_timex"), F.col("type") != "SET", "timex"), "one").join(rate(v("g_mention"), F.col("kb_id").isNotNull(), "entity"), "one")
    composite = 0.40 * F.col("event") + 0.30 * F.col("timex") + 0.30 * F.col("entity")
    return rows.select(*(F.round(c, 9).alias(c) for c in ("event", "timex", "entity")), F.round(composite, 9).alias("composite"))


@query("run_severity", """WITH h AS (SELECT phase, hour, avg(duration) AS d FROM g_phase_run GROUP BY 1, 2), l AS (SELECT phase, hour, d - lag(d) OVER (PARTITION BY phase ORDER BY hour) AS delta FROM h)
SELECT phase, CASE WHEN delta >= 0 THEN 'IMPROVEMENT' WHEN delta >= -0.02 THEN 'ACCEPTABLE' WHEN delta >= -0.05 THEN 'WARNING' ELSE 'CRITICAL' END AS severity, count(*) AS n FROM l WHERE delta IS NOT NULL GROUP BY 1, 2""")
def run_severity(v: Views) -> DataFrame:
    """QL-SEVERITY: hourly changes of each phase by severity."""
    from pyspark.sql import Window

    hourly = v("g_phase_run").groupBy("phase", "hour").agg(F.avg("duration").alias("d"))
    delta = F.col("d") - F.lag("d").over(Window.partitionBy("phase").orderBy("hour"))
    return hourly.select("phase", delta.alias("delta")).where("delta is not null").groupBy("phase", quality.severity(F.col("delta")).alias("severity")).agg(F.count("*").alias("n"))


@query("bottlenecks", "SELECT phase, round(avg(duration), 6) AS mean_duration, max(duration) AS max_duration, rank() OVER (ORDER BY round(avg(duration), 6) DESC) AS place FROM g_phase_run GROUP BY 1")
def bottlenecks(v: Views) -> DataFrame:
    """QA-PROFILE: phases ranked by mean duration; a row for each phase is ranked, not each run."""
    from pyspark.sql import Window

    per = v("g_phase_run").groupBy("phase").agg(F.round(F.avg("duration"), 6).alias("mean_duration"), F.max("duration").alias("max_duration"))
    return per.withColumn("place", F.rank().over(Window.orderBy(F.col("mean_duration").desc())).cast("long"))


@query("improvement_significance", "SELECT phase, count(duration) AS n, round(avg(duration), 6) AS mean, count(duration) >= 3 AND avg(duration) - 40 > 1.96 * stddev_samp(duration) / sqrt(count(duration)) AS improved FROM g_phase_run GROUP BY 1")
def improvement_significance(v: Views) -> DataFrame:
    """QL-SIGNIF: phases whose mean exceeds a baseline."""
    return quality.significant(v("g_phase_run").withColumn("value", F.col("duration")), "phase", 40.0).withColumn("mean", F.round("mean", 6))
