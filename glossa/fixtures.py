"""Annotation tables derived from plain tables, for queries and tests.

Each view is one SQL text that Spark and DuckDB both read; only the split into words differs.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .plans.pointers import checkpointed

_TOK = {
    # Texts are dealt out by document before they are split, so that windows and joins within documents move no tokens.
    # Of large tables the number of parts is given: parts sized by their texts would be too large to sort once they are split.
    "spark": r"SELECT doc_id, p AS pos, text FROM (SELECT doc_id, posexplode(split(text, '[ \\n]+')) AS (p, text) FROM (SELECT /*+ REPARTITION(<PARTS>doc_id) */ doc_id, text FROM {documents}) d) y",
    "duckdb": r"SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS a FROM {documents}) y",
}

# A tag is worked out wherever a filter that reads it is pushed to: Spark looks it up, as branches make code too long to compile.
_TAG = """CASE (length(text)*7+pos) % 10 WHEN 0 THEN 'NN' WHEN 1 THEN 'VBD' WHEN 2 THEN 'IN' WHEN 3 THEN 'DT' WHEN 4 THEN 'NNP' WHEN 5 THEN 'JJ'
   WHEN 6 THEN 'VBG' WHEN 7 THEN 'NNS' WHEN 8 THEN 'PRP' ELSE 'CD' END"""
_TAG_LOOKUP = "element_at(array('NN', 'VBD', 'IN', 'DT', 'NNP', 'JJ', 'VBG', 'NNS', 'PRP', 'CD'), CAST((length(text)*7+pos) % 10 AS INT) + 1)"

#: View name -> SQL over {tables} and {views}; a view comes after those it reads.
VIEWS: dict[str, str] = {
    "g_token": """SELECT doc_id, CAST(pos AS BIGINT) AS tok_index_doc, CAST(floor(pos/20) AS INT) AS sent_idx, CAST(pos % 20 AS INT) AS tok_index_sent, text,
 lower(text) AS lemma,
 CASE (length(text)*7+pos) % 10 WHEN 0 THEN 'NN' WHEN 1 THEN 'VBD' WHEN 2 THEN 'IN' WHEN 3 THEN 'DT' WHEN 4 THEN 'NNP' WHEN 5 THEN 'JJ'
   WHEN 6 THEN 'VBG' WHEN 7 THEN 'NNS' WHEN 8 THEN 'PRP' ELSE 'CD' END AS pos
FROM (<TOK>) x WHERE text <> ''""",
    "g_dep": """SELECT doc_id, tok_index_doc - CASE WHEN tok_index_sent % 4 = 0 THEN tok_index_sent ELSE 1 END AS head_tok, tok_index_doc AS dep_tok,
 CASE WHEN tok_index_sent = 0 THEN 'ROOT' WHEN pos='DT' THEN 'det' WHEN pos='IN' THEN 'prep' WHEN pos='VBG' THEN 'pcomp'
  WHEN pos IN ('NN','NNS') AND tok_index_sent % 3 = 0 THEN 'dobj' WHEN pos IN ('NN','NNS') THEN 'pobj' WHEN pos='NNP' THEN 'appos' WHEN pos='PRP' THEN 'nsubj' ELSE 'advmod' END AS type
FROM {g_token}""",
    "g_dep_words": """SELECT doc_id, head_tok, dep_tok, CASE WHEN type = 'advmod' AND dep_tok % 7 = 0 THEN 'neg' WHEN type = 'advmod' AND dep_tok % 3 = 0 THEN 'aux' WHEN type = 'det' AND dep_tok % 4 = 0 THEN 'auxpass' ELSE type END AS type FROM {g_dep}""",
    "g_tevent": """SELECT doc_id, concat('e', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, tok_index_doc AS start_tok, tok_index_doc AS end_tok, sent_idx, lemma AS pred, pos,
 CASE tok_index_doc % 5 WHEN 0 THEN 'PAST' WHEN 1 THEN 'PRESENT' WHEN 2 THEN 'FUTURE' WHEN 3 THEN 'INFINITIVE' ELSE NULL END AS tense,
 CASE WHEN tok_index_doc % 7 = 0 THEN 'PROGRESSIVE' WHEN tok_index_doc % 11 = 0 THEN NULL ELSE 'NONE' END AS aspect,
 CASE WHEN tok_index_doc % 13 = 0 THEN 'NEG' ELSE 'POS' END AS polarity,
 tok_index_doc % 17 = 0 AS low_confidence, tok_index_doc % 19 = 0 AS merged, CASE tok_index_doc % 15 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_timeml_core
FROM {g_token} WHERE pos='VBD' OR (pos='NN' AND tok_index_doc % 6 = 0)""",
    "g_timex": """SELECT doc_id, concat('t', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, tok_index_doc AS start_tok, tok_index_doc AS end_tok, sent_idx,
 CASE tok_index_doc % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIME' WHEN 2 THEN 'DURATION' ELSE 'SET' END AS type,
 CASE WHEN tok_index_doc % 4 = 2 THEN concat('PY', CAST(tok_index_doc % 9 AS STRING)) ELSE concat('2024-0', CAST(1 + tok_index_doc % 9 AS STRING)) END AS value
FROM {g_token} WHERE pos='CD'""",
    "g_timex_day": "SELECT doc_id, id, start_tok, end_tok, sent_idx, type, concat(value, '-10') AS value FROM {g_timex} WHERE type IN ('DATE', 'TIME')",
    "g_dct": "SELECT DISTINCT doc_id, concat('2024-0', CAST(1 + doc_id % 9 AS STRING), '-10') AS value FROM {documents}",
    "g_frame": """SELECT doc_id, concat('f', CAST(doc_id AS STRING), '_', CAST(start_tok AS STRING)) AS id, start_tok AS head_tok, sent_idx, pred,
 CASE WHEN pos='VBD' THEN 'PROPBANK' ELSE 'NOMBANK' END AS framework, CAST((start_tok % 10) AS DOUBLE)/10 AS confidence
FROM {g_tevent}""",
    "g_frame_argument": """SELECT f.doc_id, f.id AS frame_id, concat('a', CAST(f.doc_id AS STRING), '_', CAST(f.head_tok AS STRING), '_', CAST(t.tok_index_doc AS STRING)) AS id,
 t.tok_index_doc AS head_tok, t.text AS head, t.pos AS head_pos,
 CASE t.tok_index_doc % 6 WHEN 0 THEN 'ARG0' WHEN 1 THEN 'ARG1' WHEN 2 THEN 'ARG2' WHEN 3 THEN 'ARGM-TMP' WHEN 4 THEN 'ARGM-CAU' ELSE 'ARGM-NEG' END AS role
FROM {g_frame} f JOIN {g_token} t ON t.doc_id = f.doc_id AND t.sent_idx = f.sent_idx AND t.tok_index_doc BETWEEN f.head_tok + 1 AND f.head_tok + 3""",
    "g_tlink": """SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey % (SELECT count(*) FROM {part} WHERE p_partkey % 2 = 0) AS src, (l_orderkey + l_suppkey) % (SELECT count(*) FROM {part} WHERE p_partkey % 2 = 0) AS dst,
 CASE CAST(l_quantity AS INT) % 13 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'AFTER' WHEN 2 THEN 'INCLUDES' WHEN 3 THEN 'IS_INCLUDED' WHEN 4 THEN 'BEGINS' WHEN 5 THEN 'BEGUN_BY'
  WHEN 6 THEN 'ENDS' WHEN 7 THEN 'ENDED_BY' WHEN 8 THEN 'SIMULTANEOUS' WHEN 9 THEN 'IDENTITY' WHEN 10 THEN 'overlap' WHEN 11 THEN 'measure' ELSE '' END AS rel_type,
 l_discount AS confidence, concat('rule_', l_returnflag) AS rule_id,
 CASE WHEN l_linestatus='O' THEN 'tlinks_recognizer' ELSE NULL END AS evidence_source, l_tax > 0.07 AS suppressed
FROM {lineitem}""",
    "g_mention": """SELECT e.event_id AS id, e.user_id AS doc_id, concat('u', CAST(e.user_id % 50 AS STRING)) AS surface, e.event_type AS type,
 CASE WHEN e.event_id % 3 = 0 THEN concat('Q', CAST(e.user_id % 40 AS STRING)) ELSE NULL END AS kb_id, CAST(e.event_id % 12 AS INT) AS sent_idx, e.value/100 AS confidence
FROM {events} e""",
    "g_event_mention": """SELECT doc_id, concat('em_', id) AS id, id AS tevent_id, start_tok, CASE start_tok % 4 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'SUBORDINATE' WHEN 2 THEN 'COMPLEMENT' ELSE NULL END AS clause_type,
 CASE start_tok % 3 WHEN 0 THEN 'LOCAL_SCOPE' WHEN 1 THEN 'TEMPORAL_SCOPE' ELSE NULL END AS scope_type, CASE start_tok % 5 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'negated' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE 'REPORTED' END AS factuality,
 CASE WHEN start_tok % 7 = 0 THEN NULL WHEN start_tok % 11 = 0 THEN ' ' ELSE 'event_enrichment' END AS factuality_source, CASE WHEN start_tok % 6 = 0 THEN NULL ELSE 0.7 END AS factuality_confidence,
 CASE start_tok % 4 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN NULL ELSE 'NEGATED' END AS event_factuality, start_tok % 13 = 0 AS conflict_flag, CASE WHEN start_tok % 9 = 0 THEN concat('r', CAST(start_tok AS STRING)) WHEN start_tok % 8 = 0 THEN '' ELSE NULL END AS external_ref
FROM {g_tevent} WHERE NOT merged""",
    "g_glink": """SELECT * FROM (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id, sent_idx ORDER BY start_tok) AS dst, CASE start_tok % 7 WHEN 0 THEN 'begin' WHEN 1 THEN 'End' WHEN 2 THEN 'continue' WHEN 3 THEN 'happen' ELSE pred END AS lemma,
 CASE start_tok % 3 WHEN 0 THEN 'INITIATES' WHEN 1 THEN 'TERMINATES' ELSE NULL END AS rel_type FROM {g_tevent}) x WHERE dst IS NOT NULL""",
    "g_elink": """SELECT * FROM (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY start_tok) AS dst, CASE start_tok % 5 WHEN 2 THEN 'BEFORE' WHEN 3 THEN 'INCLUDES' WHEN 4 THEN 'SIMULTANEOUS' ELSE 'IDENTITY' END AS rel_type,
 CAST(start_tok % 10 AS DOUBLE) / 10 AS confidence, start_tok % 17 = 0 AS suppressed FROM {g_tevent}) x WHERE dst IS NOT NULL""",
    "g_signal": "SELECT doc_id, CASE WHEN tok_index_doc % 9 = 0 THEN NULL ELSE text END AS text, tok_index_doc AS start_tok, CASE WHEN tok_index_doc % 14 = 0 THEN NULL ELSE tok_index_doc END AS end_tok FROM {g_token} WHERE pos = 'IN'",
    "g_timex_mention": """SELECT CASE WHEN start_tok % 29 = 0 THEN NULL ELSE doc_id END AS doc_id, concat('tm_', id) AS id, CASE WHEN start_tok % 31 = 0 THEN NULL ELSE start_tok END AS start_tok, end_tok, CASE WHEN start_tok % 23 = 0 THEN 'none' ELSE id END AS refers_to,
 CASE WHEN start_tok % 37 = 0 THEN ' t0' WHEN start_tok % 41 = 0 THEN 'dct' ELSE id END AS tid FROM {g_timex}""",
    "g_timex_candidate": """SELECT a.id AS argument_id, CASE WHEN a.head_tok % 5 = 0 THEN NULL ELSE concat('t', CAST(a.doc_id AS STRING), '_', CAST(a.head_tok AS STRING)) END AS timex_id, CASE WHEN a.head_tok % 7 = 0 THEN '' ELSE '2024-01' END AS value FROM {g_frame_argument} a WHERE a.role = 'ARGM-TMP'""",
    "g_entity_mention": """SELECT id, doc_id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 5 = 0 THEN '' ELSE 'SPC' END AS ent_class, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN ' ' ELSE 'ill' END AS entity_state, CASE WHEN id % 2 = 0 THEN ' ' ELSE ' ROLE' END AS state_type,
 id % 10 = 0 AS numeric_label, id % 10 = 1 AS value_label, id % 20 = 1 AS value_tagged FROM {g_mention}""",
    "g_gold": "SELECT doc_id, id, start_tok, end_tok, tense FROM {g_tevent} WHERE NOT merged",
    "g_pred": """SELECT doc_id, id, CASE WHEN start_tok % 5 = 0 THEN start_tok + 1 ELSE start_tok END AS start_tok, CASE WHEN start_tok % 5 = 0 THEN end_tok + 1 ELSE end_tok END AS end_tok, tense
FROM {g_tevent} WHERE start_tok % 11 <> 0""",
    "g_lemma": """SELECT doc_id, sent_idx, tok_index_doc, pos, CASE tok_index_doc % 17 WHEN 0 THEN 'say' WHEN 1 THEN 'make' WHEN 2 THEN 'cause' WHEN 3 THEN 'allow' WHEN 4 THEN 'prevent' WHEN 5 THEN 'know' WHEN 6 THEN 'want' WHEN 7 THEN 'begin' WHEN 8 THEN 'remain' WHEN 9 THEN 'price' ELSE lemma END AS lemma FROM {g_token}""",
    "g_place": "SELECT doc_id, tok_index_doc, CASE WHEN pos = 'IN' AND tok_index_doc % 4 <> 0 THEN 'in' ELSE lemma END AS lemma FROM {g_token}",
    "g_dep_times": "SELECT doc_id, head_tok, dep_tok, CASE WHEN type = 'advmod' AND dep_tok % 3 = 0 THEN 'pobj' WHEN type = 'advmod' AND dep_tok % 3 = 1 THEN 'npadvmod' ELSE type END AS type FROM {g_dep}",
    "g_timex_week": "SELECT doc_id, id, start_tok, end_tok, CASE WHEN start_tok % 2 = 0 THEN 'Last week' ELSE 'this week' END AS text, CASE WHEN start_tok % 5 = 0 THEN value ELSE '2024-W12' END AS value FROM {g_timex}",
    "g_merge": "SELECT doc_id, id, merged, CASE WHEN merged THEN lead(id) OVER (PARTITION BY doc_id ORDER BY start_tok) END AS merged_into FROM {g_tevent}",
    "g_link": """SELECT doc_id, id AS src, dst FROM (SELECT doc_id, id, start_tok, lead(id) OVER (PARTITION BY doc_id ORDER BY start_tok) AS dst FROM (SELECT doc_id, id, start_tok FROM {g_tevent} UNION ALL SELECT doc_id, id, start_tok FROM {g_timex}) u) x WHERE dst IS NOT NULL AND start_tok % 5 = 0""",
    "g_relation": """SELECT * FROM (SELECT doc_id, kind AS src_kind, start_tok AS src_tok, lag(kind) OVER (PARTITION BY doc_id ORDER BY start_tok) AS dst_kind, lag(start_tok) OVER (PARTITION BY doc_id ORDER BY start_tok) AS dst_tok,
 CASE start_tok % 7 WHEN 0 THEN 'before' WHEN 1 THEN 'AFTER' WHEN 2 THEN 'INCLUDES' WHEN 3 THEN 'BEGUN_BY' WHEN 4 THEN ' during' WHEN 5 THEN 'SIMULTANEOUS' ELSE NULL END AS rel_type FROM (SELECT doc_id, start_tok, 'event' AS kind FROM {g_tevent} UNION ALL SELECT doc_id, start_tok, 'timex' FROM {g_timex}) u) x WHERE dst_tok IS NOT NULL""",
    "g_aligned": "SELECT concat('f', CAST(doc_id AS STRING), '_', CAST(head_tok AS STRING)) AS verb_frame, concat('f', CAST(doc_id AS STRING), '_', CAST(dep_tok AS STRING)) AS noun_frame FROM {g_dep} WHERE type = 'dobj'",
    "g_syntax": "SELECT id, doc_id, CASE id % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'NOMINAL' WHEN 2 THEN 'nom' ELSE 'NAM' END AS syntactic_type FROM {g_mention}",
    "g_coref": "SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (PARTITION BY doc_id, type ORDER BY id) AS dst FROM {g_mention} WHERE kb_id IS NOT NULL) x WHERE dst IS NOT NULL",
    "g_char": """SELECT doc_id, tok_index_doc, sent_idx, text, lemma, pos, start_char, start_char + length(text) AS end_char FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY tok_index_doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM {g_token}) x""",
    "g_ttk_event": """SELECT c.doc_id, c.tok_index_doc AS tok, concat('e', CAST(c.tok_index_doc AS STRING)) AS eid, CASE WHEN c.tok_index_doc % 11 = 0 THEN NULL ELSE concat('ei', CAST(c.tok_index_doc AS STRING)) END AS eiid, c.start_char - CASE WHEN c.tok_index_doc % 3 = 1 THEN 1 ELSE 0 END AS begin_char,
 c.end_char + CASE c.tok_index_doc % 4 WHEN 0 THEN 9 WHEN 1 THEN -1 ELSE 0 END AS end_char, CASE WHEN c.tok_index_doc % 13 = 0 THEN 'was' WHEN c.tok_index_doc % 14 = 0 THEN 'statement' ELSE c.lemma END AS form, CASE WHEN c.tok_index_doc % 9 = 0 THEN 'JJ' ELSE c.pos END AS pos,
 CASE WHEN c.tok_index_doc % 5 = 2 THEN 'past' WHEN c.tok_index_doc % 5 = 3 THEN 'odd' ELSE e.tense END AS tense, e.aspect, CASE WHEN c.tok_index_doc % 7 = 0 THEN NULL ELSE e.polarity END AS polarity FROM {g_tevent} e JOIN {g_char} c ON c.doc_id = e.doc_id AND c.tok_index_doc = e.start_tok""",
    "g_ttk_timex": """SELECT c.doc_id, c.tok_index_doc AS tok, concat('t', CAST(c.tok_index_doc AS STRING)) AS tid, c.start_char AS begin_char, c.end_char + CASE WHEN c.tok_index_doc % 3 = 0 THEN 12 ELSE 0 END AS end_char, t.type, t.value, c.text, CASE WHEN c.tok_index_doc % 8 = 0 THEN 'CREATION_TIME' ELSE NULL END AS function_in_document FROM {g_timex} t JOIN {g_char} c ON c.doc_id = t.doc_id AND c.tok_index_doc = t.start_tok""",
    "g_ttk_signal": "SELECT doc_id, tok_index_doc AS tok, CASE WHEN tok_index_doc % 5 = 0 THEN NULL ELSE concat('s', CAST(tok_index_doc AS STRING)) END AS sid, start_char AS begin_char, end_char - CASE WHEN tok_index_doc % 7 = 0 THEN 1 ELSE 0 END AS end_char, text FROM {g_char} WHERE pos = 'IN'",
    "g_ttk_link": """SELECT doc_id, concat('l', CAST(tok AS STRING)) AS lid, kind, name, lead(kind) OVER w AS next_kind, lead(name) OVER w AS next_name, CASE tok % 6 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'IS_INCLUDED' WHEN 2 THEN 'DURING' WHEN 3 THEN 'measure' WHEN 4 THEN 'ENDS' ELSE 'SIMULTANEOUS' END AS rel_type
 FROM (SELECT doc_id, tok, 'event' AS kind, coalesce(eiid, concat('e_', eid, '_', CAST(begin_char AS STRING))) AS name FROM {g_ttk_event} UNION ALL SELECT doc_id, tok, 'timex', tid FROM {g_ttk_timex}) x WHERE tok % 2 = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY tok, kind)""",
    "g_ttk": """SELECT doc_id, concat('<ttk>', string_agg(x, ''), '</ttk>') AS xml FROM (
 SELECT doc_id, concat('<EVENT eid="', eid, '"', CASE WHEN eiid IS NULL THEN '' ELSE concat(' eiid="', eiid, '"') END, ' begin="', CAST(begin_char AS STRING), '" end="', CAST(end_char AS STRING), '" form="', replace(replace(replace(replace(form, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '" pos="', pos, '" tense="', coalesce(tense, ''), '" aspect="', coalesce(aspect, ''), '" polarity="', coalesce(polarity, ''), '"/>') AS x FROM {g_ttk_event}
 UNION ALL SELECT doc_id, concat('<ns:TIMEX3 tid="', tid, '" begin="', CAST(begin_char AS STRING), '" end="', CAST(end_char AS STRING), '" type="', type, '" value="', value, '"', CASE WHEN function_in_document IS NULL THEN '' ELSE concat(' functionInDocument="', function_in_document, '"') END, '>', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</ns:TIMEX3>') FROM {g_ttk_timex}
 UNION ALL SELECT doc_id, concat('<SIGNAL', CASE WHEN sid IS NULL THEN '' ELSE concat(' sid="', sid, '"') END, ' begin="', CAST(begin_char AS STRING), '" end="', CAST(end_char AS STRING), '">', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</SIGNAL>') FROM {g_ttk_signal}
 UNION ALL SELECT doc_id, concat('<TLINK lid="', lid, '" relType="', rel_type, '" ', CASE kind WHEN 'event' THEN 'eventInstanceID' ELSE 'timeID' END, '="', name, '" ', CASE next_kind WHEN 'event' THEN 'relatedToEventInstance' ELSE 'relatedToTime' END, '="', next_name, '"/>') FROM {g_ttk_link} WHERE next_name IS NOT NULL
 UNION ALL SELECT doc_id, concat('<GLINK relType="', rel_type, '" sourceEventInstance="', name, '" relatedToEventInstance="', next_name, '"/>') FROM {g_ttk_link} WHERE kind = 'event' AND next_kind = 'event') y GROUP BY doc_id""",
    "g_frame_kind": """SELECT doc_id, id, head_tok, pred, framework, confidence, CASE head_tok % 4 WHEN 0 THEN '01' WHEN 1 THEN '02' ELSE NULL END AS sense, confidence AS sense_conf, head_tok % 23 = 0 AS provisional, head_tok % 6 = 5 AS is_light_verb_host FROM {g_frame}""",
    "g_align": """SELECT verb_frame AS canonical, noun_frame AS secondary FROM {g_aligned} UNION SELECT canonical, secondary FROM (SELECT id AS canonical, lead(id) OVER (PARTITION BY doc_id, sent_idx ORDER BY head_tok) AS secondary, head_tok FROM {g_frame}) x WHERE secondary IS NOT NULL AND head_tok % 5 <> 0
 UNION SELECT secondary, canonical FROM (SELECT id AS canonical, lead(id) OVER (PARTITION BY doc_id, sent_idx ORDER BY head_tok) AS secondary, head_tok FROM {g_frame}) x WHERE secondary IS NOT NULL AND head_tok % 9 = 4""",
    "g_event_field": """SELECT id, doc_id, start_tok, CASE WHEN start_tok % 4 = 0 THEN NULL ELSE polarity END AS polarity, CASE start_tok % 5 WHEN 0 THEN 'spacy' WHEN 1 THEN ' TTK ' WHEN 2 THEN 'refinement' ELSE NULL END AS polarity_source, CASE WHEN start_tok % 3 = 0 THEN NULL ELSE CAST(start_tok % 10 AS DOUBLE) / 10 END AS polarity_confidence FROM {g_tevent}""",
    "g_said_field": """SELECT id AS event_id, CASE start_tok % 6 WHEN 0 THEN 'NEG' WHEN 1 THEN 'POS' WHEN 2 THEN NULL ELSE polarity END AS polarity FROM {g_tevent} UNION ALL SELECT id, 'neg' FROM {g_tevent} WHERE start_tok % 7 = 0""",
    "g_particle": "SELECT doc_id, sent_idx, tok_index_doc, text, lemma, CASE WHEN pos = 'IN' THEN 'RP' ELSE pos END AS pos FROM {g_token}",
    "g_dep_wide": "SELECT doc_id, head_tok, dep_tok, CASE WHEN dep_tok > head_tok THEN 'prt' ELSE 'amod' END AS type FROM (SELECT doc_id, head_tok, dep_tok FROM {g_dep} WHERE type IN ('prep', 'advmod') UNION ALL SELECT doc_id, dep_tok + 2, dep_tok FROM {g_dep} WHERE type = 'det') x WHERE head_tok <> dep_tok",
    "g_token_nom": "SELECT t.doc_id, t.sent_idx, t.tok_index_doc, t.text, l.lemma, CASE WHEN t.tok_index_doc % 16 = 0 THEN ',' ELSE t.pos END AS pos FROM {g_token} t JOIN {g_lemma} l ON l.doc_id = t.doc_id AND l.tok_index_doc = t.tok_index_doc",
    "g_dep_nom": """SELECT doc_id, tok_index_doc - CASE WHEN tok_index_sent % 4 = 0 THEN tok_index_sent ELSE 1 END AS head_tok, tok_index_doc AS dep_tok, CASE WHEN pos = 'DT' THEN 'det' WHEN pos IN ('NN', 'NNS', 'NNP') THEN CASE tok_index_doc % 3 WHEN 0 THEN 'appos' WHEN 1 THEN 'conj' ELSE 'attr' END ELSE 'dep' END AS type FROM {g_token}""",
    "g_nom_entity": "SELECT DISTINCT concat('n', text) AS id, CASE WHEN length(text) % 2 = 0 THEN 'NOMINAL' ELSE 'NAM' END AS syntactic_type, text, text AS head, CAST(NULL AS BIGINT) AS head_tok FROM {g_token}",
    "g_nom_argument": "SELECT doc_id, id, CASE WHEN head_tok % 5 = 0 THEN NULL ELSE head END AS text, head, CASE WHEN head_tok % 7 = 0 THEN NULL ELSE head_tok END AS head_tok, head_tok AS start_tok, head_tok + head_tok % 3 AS end_tok, concat('n', head) AS entity_id FROM {g_frame_argument} WHERE head_tok % 4 <> 0",
    "g_eval_gold": """SELECT doc_id * 100000 + sent_idx AS doc_id, 'event' AS kind, start_tok, start_tok + start_tok % 3 AS end_tok, concat('tense=', coalesce(tense, 'NONE')) AS attr FROM {g_tevent} UNION ALL SELECT doc_id * 100000 + sent_idx, 'timex', start_tok, start_tok + start_tok % 2, concat('type=', type) FROM {g_timex}
 UNION ALL SELECT doc_id * 100000 + sent_idx, 'entity', tok_index_doc, tok_index_doc + CASE WHEN tok_index_doc % 5 = 0 THEN 6 ELSE tok_index_doc % 3 END, CASE WHEN tok_index_doc % 5 = 0 THEN 'syntactic_type=CONJ' ELSE 'syntactic_type=NAM' END FROM {g_token} WHERE pos IN ('NNP', 'NNS')""",
    "g_eval_pred": """SELECT doc_id, kind, CASE WHEN start_tok % 5 = 1 THEN start_tok + 1 ELSE start_tok END AS start_tok, CASE WHEN start_tok % 4 = 1 THEN end_tok + 2 ELSE end_tok + CASE WHEN start_tok % 5 = 1 THEN 1 ELSE 0 END END AS end_tok, CASE WHEN start_tok % 7 = 0 THEN concat(attr, 'X') ELSE attr END AS attr FROM {g_eval_gold} WHERE start_tok % 6 <> 2 AND NOT attr LIKE '%CONJ'
 UNION ALL SELECT doc_id, kind, start_tok - 1, end_tok, attr FROM {g_eval_gold} WHERE start_tok % 9 = 4""",
    "g_eval_gold_rel": """SELECT doc_id, kind, source_kind, ss, se, target_kind, ts, te, attr FROM (SELECT doc_id, CASE WHEN start_tok % 4 = 3 THEN 'glink' ELSE 'tlink' END AS kind, kind AS source_kind, start_tok AS ss, end_tok AS se, lead(kind) OVER w AS target_kind, lead(start_tok) OVER w AS ts, lead(end_tok) OVER w AS te,
 CASE start_tok % 5 WHEN 0 THEN 'reltype=BEFORE' WHEN 1 THEN 'reltype=includes' WHEN 2 THEN 'reltype=AFTER' WHEN 3 THEN 'reltype=SIMULTANEOUS' ELSE 'reltype=ENDS' END AS attr FROM {g_eval_gold} WHERE kind <> 'entity' WINDOW w AS (PARTITION BY doc_id ORDER BY start_tok, kind)) x WHERE ts IS NOT NULL""",
    "g_eval_pred_rel": """SELECT doc_id, kind, source_kind, CASE WHEN ss % 6 = 1 THEN ss + 1 ELSE ss END AS ss, CASE WHEN ss % 6 = 1 THEN se + 1 ELSE se END AS se, target_kind, ts, te, CASE WHEN ts % 4 = 1 THEN 'reltype=IDENTITY' ELSE attr END AS attr FROM {g_eval_gold_rel} WHERE ss % 8 <> 5
 UNION ALL SELECT doc_id, kind, target_kind, ts, te, source_kind, ss, se, CASE attr WHEN 'reltype=BEFORE' THEN 'reltype=AFTER' ELSE attr END FROM {g_eval_gold_rel} WHERE ss % 7 = 3""",
    "g_frame_token": "SELECT doc_id, id AS frame_id, head_tok AS tok FROM {g_frame} UNION SELECT doc_id, id, head_tok + 1 FROM {g_frame}",
    "g_time_argument": """SELECT a.doc_id, a.id, a.frame_id, a.role, a.head_tok, CASE CAST(floor(a.head_tok / 6) AS INT) % 8 WHEN 0 THEN 'after' WHEN 1 THEN 'before' WHEN 2 THEN 'following' WHEN 3 THEN 'Since' WHEN 4 THEN 'while' WHEN 5 THEN 'upon' ELSE NULL END AS signal, CASE WHEN a.head_tok % 4 <> 1 THEN n.text ELSE a.head END AS complement, CASE WHEN a.head_tok % 5 <> 0 THEN 'EVENTIVE' ELSE 'NOM' END AS syntactic_type
 FROM {g_frame_argument} a LEFT JOIN {g_token} n ON n.doc_id = a.doc_id AND n.tok_index_doc = a.head_tok + 1""",
    "g_time_argument_token": "SELECT a.id AS argument_id, a.doc_id, t.tok_index_doc AS tok, t.text, CASE WHEN t.tok_index_doc % 5 < 3 THEN 'VBG' ELSE t.pos END AS pos FROM (SELECT id, doc_id, head_tok AS tok FROM {g_frame_argument} UNION ALL SELECT id, doc_id, head_tok + 1 FROM {g_frame_argument} UNION ALL SELECT id, doc_id, head_tok + 2 FROM {g_frame_argument}) a JOIN {g_token} t ON t.doc_id = a.doc_id AND t.tok_index_doc = a.tok",
    "g_time_signal": "SELECT doc_id, tok_index_doc AS start_tok, tok_index_doc AS end_tok, CASE tok_index_doc % 7 WHEN 0 THEN 'When' WHEN 1 THEN 'until' WHEN 2 THEN 'prior' WHEN 3 THEN 'after' WHEN 4 THEN NULL ELSE 'of' END AS text FROM {g_token} WHERE pos IN ('IN', 'DT', 'JJ')",
    "g_dep_family": "SELECT doc_id, head_tok, dep_tok, CASE WHEN type IN ('appos', 'conj', 'attr') AND dep_tok % 4 = 3 THEN 'nsubj' ELSE type END AS type FROM {g_dep_nom}",
    "g_sag_node": "SELECT doc_id, id, pred AS label FROM {g_frame} WHERE head_tok % 31 <> 0 UNION ALL SELECT doc_id, id, head FROM {g_frame_argument} WHERE head_tok % 37 <> 0",
    "g_sag_edge": """SELECT doc_id, frame_id AS src, id AS dst, role FROM {g_frame_argument} UNION ALL SELECT a.doc_id, a.id, f.id, 'IS' FROM {g_frame_argument} a JOIN {g_frame} f ON f.doc_id = a.doc_id AND f.head_tok = a.head_tok
 UNION ALL SELECT doc_id, id, frame_id, 'BACK' FROM {g_frame_argument} WHERE doc_id % 3 = 0 AND head_tok % 29 = 0""",
    "g_sag_wanted": "SELECT doc_id, start_id, end_id FROM (SELECT doc_id, id AS start_id, lead(id) OVER (PARTITION BY doc_id, sent_idx ORDER BY head_tok) AS end_id FROM {g_frame}) x WHERE end_id IS NOT NULL",
    "g_rival": """SELECT doc_id, concat('s', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, tok_index_doc AS head_tok, CASE tok_index_doc % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'CARDINAL' WHEN 2 THEN 'PERSON' ELSE 'TIME' END AS type, 'spacy' AS source, CAST(NULL AS STRING) AS kb_id, CASE WHEN tok_index_doc % 7 = 0 THEN 0.5 ELSE NULL END AS score, false AS is_mention FROM {g_token} WHERE pos = 'CD' AND tok_index_doc % 11 <> 0
 UNION ALL SELECT doc_id, concat('d', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)), tok_index_doc, CASE tok_index_doc % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'CARDINAL' WHEN 2 THEN 'PERSON' ELSE 'MONEY' END, 'dbpedia', CASE WHEN tok_index_doc % 3 = 0 THEN concat('Q', CAST(tok_index_doc AS STRING)) ELSE NULL END, 0.25, true FROM {g_token} WHERE pos = 'CD' AND tok_index_doc % 2 = 0
 UNION ALL SELECT doc_id, concat('e', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)), tok_index_doc, 'DATE', NULL, concat('R', CAST(tok_index_doc AS STRING)), 0.75, NULL FROM {g_token} WHERE pos = 'CD' AND tok_index_doc % 4 = 0 AND tok_index_doc % 5 <> 0""",
    "g_rival_link": "SELECT id, concat('E', CAST(head_tok % 10 AS STRING)) AS entity_id FROM {g_rival} WHERE head_tok % 3 <> 1",
    "g_bare_entity": """SELECT doc_id, concat('b', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, tok_index_doc AS start_tok, tok_index_doc + tok_index_doc % 4 AS end_tok, CASE WHEN tok_index_doc % 5 = 0 THEN text ELSE NULL END AS head, CASE WHEN tok_index_doc % 10 = 0 THEN tok_index_doc ELSE NULL END AS head_tok FROM {g_token} WHERE pos = 'NNP'""",
    "g_metric": """SELECT event_type AS metric, user_id % 2 AS side, CAST(count(*) AS DOUBLE) AS value FROM {events} WHERE event_id % 7 < 5 + user_id % 2 GROUP BY 1, 2 UNION ALL SELECT concat('same_', event_type), s.side, CAST(count(*) AS DOUBLE) FROM {events} CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) s GROUP BY 1, 2
 UNION ALL SELECT concat('only_', event_type), 1, CAST(count(*) AS DOUBLE) FROM {events} GROUP BY 1""",
    "g_attr_mention": """SELECT doc_id, concat('em_', id) AS id, id AS event_id, start_tok, CASE start_tok % 9 WHEN 0 THEN 'JJ' WHEN 1 THEN 'VERB' ELSE pos END AS pos, CASE start_tok % 13 WHEN 0 THEN 'will go' WHEN 1 THEN NULL ELSE pred END AS form, CASE WHEN start_tok % 4 = 0 THEN 'Fear' ELSE pred END AS pred,
 CASE start_tok % 11 WHEN 0 THEN 'might' WHEN 1 THEN 'would' WHEN 2 THEN 'will' WHEN 3 THEN 'must' ELSE NULL END AS modality, CASE WHEN start_tok % 10 = 4 THEN 'PRESPART' ELSE tense END AS tense, CASE start_tok % 6 WHEN 0 THEN NULL WHEN 1 THEN 'odd' WHEN 2 THEN 'HABITUAL' ELSE aspect END AS aspect, CASE WHEN start_tok % 5 = 0 THEN NULL ELSE polarity END AS polarity,
 CASE WHEN start_tok % 12 = 0 THEN 'UNCERTAIN' ELSE NULL END AS certainty, CASE WHEN start_tok % 10 = 1 THEN 'UNDERSPECIFIED' ELSE NULL END AS time, CASE WHEN start_tok % 17 = 3 THEN 'REPORTED_SPEECH' ELSE NULL END AS special_cases, CASE WHEN start_tok % 14 = 0 THEN 'COMPLEMENT' ELSE NULL END AS clause_type, CAST(NULL AS STRING) AS scope_type FROM {g_tevent}""",
    "g_attr_event": "SELECT id, doc_id, CASE WHEN start_tok % 7 = 1 THEN 'PERFECTIVE' ELSE aspect END AS aspect, CASE WHEN start_tok % 10 = 5 THEN NULL ELSE polarity END AS polarity, CASE WHEN start_tok % 3 = 0 THEN 'NON_FUTURE' ELSE NULL END AS time FROM {g_tevent}",
    "g_attr_frame": "SELECT id AS frame_id, concat('em_e', substr(id, 2, 100)) AS mention_id FROM {g_frame} WHERE head_tok % 8 <> 0",
    "g_attr_argument": "SELECT frame_id, CASE WHEN head_tok % 11 = 0 THEN 'ARGM-DSP' WHEN head_tok % 13 = 0 THEN 'ARGM-ADV' ELSE role END AS role, CASE head_tok % 7 WHEN 0 THEN 'Before' WHEN 1 THEN 'if' WHEN 2 THEN NULL ELSE head END AS head FROM {g_frame_argument}",
    "g_attr_token": "SELECT doc_id, sent_idx, tok_index_doc, CASE tok_index_doc % 6 WHEN 0 THEN 'to' WHEN 1 THEN 'add' WHEN 2 THEN 'be' WHEN 3 THEN 'That' ELSE lemma END AS lemma, CASE WHEN pos = 'IN' THEN 'TO' WHEN pos = 'VBD' AND tok_index_doc % 2 = 0 THEN 'VBG' ELSE pos END AS pos FROM {g_token}",
    "g_step_link": "SELECT doc_id, src, dst, rel_type, CASE rel_type WHEN 'BEFORE' THEN 'xml_e2e_seed' WHEN 'INCLUDES' THEN 'case6_dct_anchor' WHEN 'IDENTITY' THEN 'ga01_included_before' ELSE 'other' END AS rule_id, confidence FROM {g_elink} UNION ALL SELECT doc_id, dst, src, 'AFTER', NULL, confidence FROM {g_elink} WHERE rel_type = 'BEFORE' UNION ALL SELECT doc_id, src, dst, 'IS_INCLUDED', 'inverse_consistency', confidence FROM {g_elink} WHERE rel_type = 'IDENTITY'",
    "g_parse": """SELECT c.doc_id, c.sent_idx, c.tok_index_doc, c.start_char AS idx, c.text, c.lemma, c.pos AS tag, 'X' AS pos, d.type AS dep, d.head_tok AS head, length(c.text) < 3 AS is_stop, c.tok_index_doc % 12 = 5 AS is_punct, c.tok_index_doc % 17 = 6 AS is_space FROM {g_char} c JOIN {g_dep} d ON d.doc_id = c.doc_id AND d.dep_tok = c.tok_index_doc""",
    "g_parse_chunk": "SELECT doc_id, tok_index_doc AS start_tok, tok_index_doc + 1 + tok_index_doc % 3 AS end_tok, tok_index_doc AS root, CASE WHEN tok_index_doc % 4 = 0 THEN '' ELSE 'NP' END AS label, concat('chunk ', text) AS text FROM {g_token} WHERE pos IN ('NN', 'NNP', 'PRP')",
    "g_parse_span": """SELECT doc_id, tok_index_doc AS start_tok, tok_index_doc + 1 + CASE WHEN tok_index_doc % 10 < 6 THEN 1 ELSE 0 END AS end_tok, tok_index_doc AS root, CASE tok_index_doc % 7 WHEN 0 THEN 'MONEY' WHEN 1 THEN 'DATE' WHEN 2 THEN 'GPE' WHEN 3 THEN 'PERSON' WHEN 4 THEN 'TIME' WHEN 5 THEN 'CARDINAL' ELSE 'ORG' END AS label, text,
 CASE WHEN tok_index_doc % 3 = 0 THEN concat('Q', CAST(tok_index_doc AS STRING)) ELSE '' END AS kb_id, 0.5 AS score FROM {g_token} WHERE tok_index_doc % 4 = 1""",
    "g_ent_argument": """SELECT a.doc_id, a.id, a.role, a.head_tok, CASE WHEN a.head_tok % 5 = 0 THEN 'PRP' ELSE a.head_pos END AS head_pos, a.head, CASE a.head_tok % 4 WHEN 0 THEN 'PRO' WHEN 1 THEN NULL ELSE 'NOMINAL' END AS syntactic_type, CASE WHEN a.head_tok % 3 = 0 THEN a.head_tok + 1 ELSE NULL END AS complement_tok, concat('c', a.head) AS complement, concat('The ', a.head, '!') AS complement_text,
 CASE WHEN a.head_tok % 7 = 0 THEN NULL ELSE a.head_tok - 1 END AS start_tok, CASE WHEN a.head_tok % 7 = 0 THEN NULL ELSE a.head_tok + 1 END AS end_tok FROM {g_frame_argument} a""",
    "g_ent_named": "SELECT doc_id, concat('n', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, CASE tok_index_doc % 5 WHEN 0 THEN 'MONEY' WHEN 1 THEN 'PERCENT' ELSE 'ORG' END AS type, tok_index_doc AS head_tok, tok_index_doc - 1 AS start_tok, tok_index_doc + 1 AS end_tok FROM {g_token} WHERE pos IN ('CD', 'NNP')",
    "g_ent_link": "SELECT a.id AS argument_id, n.id AS target_id, CASE WHEN a.head_tok % 6 = 0 THEN 'Entity' ELSE 'NamedEntity' END AS target_kind FROM {g_ent_argument} a JOIN {g_ent_named} n ON n.doc_id = a.doc_id AND n.head_tok = a.head_tok UNION ALL SELECT id, concat('ev', id), 'TEvent' FROM {g_ent_argument} WHERE head_tok % 9 = 0",
    "g_ent_coref": "SELECT doc_id, concat('m', CAST(doc_id AS STRING), '_', CAST(tok_index_doc AS STRING)) AS id, tok_index_doc AS head_tok, concat('x', CAST(doc_id AS STRING), '_', CAST(tok_index_doc - 10 - tok_index_doc % 2 AS STRING)) AS antecedent_id, tok_index_doc - 10 - tok_index_doc % 2 AS antecedent_tok FROM {g_token} WHERE tok_index_doc % 5 = 0 AND tok_index_doc > 10",
    "g_phase_run": """SELECT event_id AS id, event_type AS phase, date_trunc('hour', ts) AS hour, value AS duration, user_id AS doc_id, event_id % 9 = 0 AS failed FROM {events}""",
}
_REF = re.compile(r"\{(\w+)\}")
#: Bytes of a file of texts that go into one part: about half a million tokens, which a task sorts in memory.
_PART_BYTES = 2 << 20


def parts(texts: DataFrame) -> int:
    """Into how many parts ``texts`` are dealt out: by the size of their files, and one for each core if there are several."""
    spark, size = texts.sparkSession, 0
    for file in texts.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return 1 if size <= _PART_BYTES else max(spark.sparkContext.defaultParallelism, -(-size // _PART_BYTES))


class Loader:
    """Tables of a folder and the views over them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        # Sides that are both dealt out by document also meet on document and token as they lie.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.held: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.held:
            if name in VIEWS:
                sql = VIEWS[name].replace("<TOK>", _TOK["spark"]).replace(_TAG, _TAG_LOOKUP)
                if "<PARTS>" in sql:
                    n = parts(self("documents"))
                    sql = sql.replace("<PARTS>", f"{n}, " if n > 1 else "")
                self.held[name] = self.spark.sql(sql, **{r: self(r) for r in set(_REF.findall(sql))})
            else:
                self.held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.held[name]

    def written(self, *names: str) -> None:
        """Write views that a query reads often as tables; views that are built later over them read these, not the texts."""
        for name in names:
            self.held[name] = checkpointed(self(name))


def with_views(sql: str) -> str:
    """DuckDB text with the views that ``sql`` reads, by name, as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)
    need(sql)
    ctes = [f"{name} AS MATERIALIZED ({_REF.sub(r'\1', VIEWS[name].replace('<TOK>', _TOK['duckdb']))})" for name in needed]
    body = sql.strip()
    if own := re.match(r"WITH (RECURSIVE )?", body, re.IGNORECASE):
        return f"WITH {(own[1] or '').upper()}" + ", ".join([*ctes, body[own.end():].lstrip()])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
