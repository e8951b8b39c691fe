"""Registered queries on parser rows and on links from arguments to entities, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import entity_links
from .registry import Views, query
from .sources import parses

_TOKENS = "tk AS MATERIALIZED (SELECT doc_id, sent_idx, concat(CAST(doc_id AS STRING), '_', CAST(sent_idx AS STRING), '_', CAST(idx AS STRING)) AS id, idx AS start_char, idx + length(text) AS end_char, text, lemma, tag AS pos, tok_index_doc, tok_index_doc - min(tok_index_doc) OVER (PARTITION BY doc_id, sent_idx) AS tok_index_sent, is_stop OR is_punct AS is_stop, is_space FROM g_parse), tz AS (SELECT *, doc_id * 10000000 + tok_index_doc AS k FROM tk WHERE NOT is_space)"
_UID = "concat('ne_', CAST(doc_id AS STRING), '_', substr(sha1(concat_ws('|', CAST(doc_id AS STRING), regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), CAST(head_tok AS STRING))), 1, 20))"


def _tokens(v: Views) -> DataFrame:
    return parses.tokens(v("g_parse"))


def _spans(v: Views, name: str) -> DataFrame:
    return v(name).withColumnsRenamed({"start_tok": "start", "end_tok": "end"})


@query("parsed_tokens", f"WITH {_TOKENS} SELECT doc_id, sent_idx, id, start_char, end_char, text, lemma, pos, tok_index_doc, tok_index_sent, is_stop FROM tz")
def parsed_tokens(v: Views) -> DataFrame:
    """SRC-TOK: tokens of a parse."""
    return _tokens(v).drop("upos")


@query("parsed_token_order", f"WITH {_TOKENS} SELECT * FROM (SELECT doc_id, sent_idx, id AS src, lead(id) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_index_doc) AS dst FROM tz) x WHERE dst IS NOT NULL")
def parsed_token_order(v: Views) -> DataFrame:
    """SRC-TOK: each token and the next one."""
    return parses.next_tokens(_tokens(v))


@query("parsed_lemma_links", f"WITH {_TOKENS} SELECT id AS token_id, lemma FROM tz WHERE NOT is_stop")
def parsed_lemma_links(v: Views) -> DataFrame:
    """SRC-TOK: lemmas of tokens that carry meaning."""
    return parses.lemma_links(_tokens(v))


@query("parsed_dependencies", "SELECT d.doc_id, d.head AS head_tok, d.tok_index_doc AS dep_tok, concat(CAST(d.doc_id AS STRING), '_', CAST(d.sent_idx AS STRING), '_', CAST(h.idx AS STRING)) AS src, concat(CAST(d.doc_id AS STRING), '_', CAST(d.sent_idx AS STRING), '_', CAST(d.idx AS STRING)) AS dst, d.dep AS type FROM g_parse d JOIN g_parse h ON h.doc_id = d.doc_id AND h.tok_index_doc = d.head WHERE NOT d.is_space")
def parsed_dependencies(v: Views) -> DataFrame:
    """SRC-DEP: dependencies of a parse."""
    return parses.dependencies(v("g_parse"))


_PLACED = "{0} AS (SELECT s.*, s.end_tok - 1 AS last_tok, a.start_char, b.end_char, h.text AS head, h.pos AS head_tag, s.root AS head_tok FROM {1} s JOIN tz a ON a.k = s.doc_id * 10000000 + s.start_tok JOIN tz b ON b.k = s.doc_id * 10000000 + s.end_tok - 1 JOIN tz h ON h.k = s.doc_id * 10000000 + s.root)"


@query("noun_chunks", f"""WITH {_TOKENS}, {_PLACED.format('p', 'g_parse_chunk')} SELECT doc_id, concat('nc_', CAST(doc_id AS STRING), '_', CAST(start_tok AS STRING), '_', CAST(last_tok AS STRING), '_', CAST(head_tok AS STRING)) AS id, text AS value, CASE label WHEN '' THEN 'NOUN_CHUNK' ELSE label END AS type, start_tok, last_tok AS end_tok, start_char, end_char, head, head_tok,
CASE head_tag WHEN 'NN' THEN 'NOMINAL' WHEN 'NNP' THEN 'NAM' WHEN 'PRP' THEN 'PRO' ELSE 'OTHER' END AS syntactic_type FROM p""")
def noun_chunks(v: Views) -> DataFrame:
    """SRC-NC: noun chunks of a parse."""
    return parses.noun_chunks(_spans(v, "g_parse_chunk"), _tokens(v))


#: Spans of the view are at most two tokens long and four apart, so none meets another.
_ENTITIES = f"WITH {_TOKENS}, {_PLACED.format('p', 'g_parse_span')}, e AS (SELECT *, {_UID} AS uid FROM p)"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY uid ORDER BY start_tok, end_tok) = 1"


@query("parsed_entities", f"{_ENTITIES} SELECT doc_id, uid, concat(CAST(doc_id AS STRING), '_', CAST(start_tok AS STRING), '_', CAST(last_tok AS STRING), '_', label) AS id, text AS value, label AS type, CASE label WHEN 'GPE' THEN 'LOC' WHEN 'PERSON' THEN 'PER' ELSE label END AS ent_class, start_tok, last_tok AS end_tok, start_char, end_char, head, head_tok, nullif(kb_id, '') AS kb_id, CAST(CASE WHEN kb_id <> '' THEN score END AS DOUBLE) AS score FROM e WHERE label IN ('GPE','PERSON','ORG') {_FIRST}")
def parsed_entities(v: Views) -> DataFrame:
    """SRC-NE: named entities of a parse."""
    return parses.named_entities(_spans(v, "g_parse_span"), _tokens(v)).drop("token_id").withColumn("score", F.col("score").cast("double"))


@query("parsed_values", f"{_ENTITIES} SELECT doc_id, uid, label AS type, text AS value, start_tok, last_tok AS end_tok, start_char, end_char, head, head_tok FROM e WHERE label IN ('MONEY','CARDINAL') {_FIRST}")
def parsed_values(v: Views) -> DataFrame:
    """SRC-NE: amounts and numbers of a parse."""
    return parses.value_mentions(_spans(v, "g_parse_span"), _tokens(v)).drop("source", "confidence")


@query("parsed_timex_candidates", f"{_ENTITIES} SELECT doc_id, uid, label AS type, text AS value, start_tok, last_tok AS end_tok, start_char, end_char FROM e WHERE label IN ('DATE','TIME') {_FIRST}")
def parsed_timex_candidates(v: Views) -> DataFrame:
    """SRC-STIMEX: dates and times of a parse."""
    return parses.timex_candidates(_spans(v, "g_parse_span"), _tokens(v)).drop("source", "confidence")


_CORE = "role IN ('ARG0','ARG1','ARG2')"
_COMPLEMENTS = f"f AS (SELECT a.*, concat('entity_', regexp_replace(lower(complement_text), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS target_id FROM g_ent_argument a WHERE {_CORE} AND complement_tok IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_ent_named n WHERE n.doc_id = a.doc_id AND n.head_tok = a.complement_tok) AND a.id NOT IN (SELECT argument_id FROM g_ent_link WHERE target_kind = 'NamedEntity'))"


@query("complement_entities", f"WITH {_COMPLEMENTS} SELECT target_id AS id, 'NOMINAL' AS type, complement AS head, complement_tok AS head_tok FROM f QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY doc_id, complement_tok, complement) = 1")
def complement_entities(v: Views) -> DataFrame:
    """LNK-FA-POBJ-ENT: entities made of complements."""
    return entity_links.complement_entities(v("g_ent_argument"), v("g_ent_named"), v("g_ent_link"))[0]


@query("complement_entity_links", f"WITH {_COMPLEMENTS} SELECT id AS argument_id, target_id, 'Entity' AS target_kind FROM f")
def complement_entity_links(v: Views) -> DataFrame:
    """LNK-FA-POBJ-ENT: arguments and the entities of their complements."""
    return entity_links.complement_entities(v("g_ent_argument"), v("g_ent_named"), v("g_ent_link"))[1]


@query("pronoun_links", "SELECT DISTINCT a.id AS argument_id, n.id AS target_id, 'NamedEntity' AS target_kind FROM g_ent_argument a JOIN g_ent_coref c ON c.doc_id = a.doc_id AND c.head_tok = a.head_tok JOIN g_ent_named n ON n.doc_id = c.doc_id AND n.head_tok = c.antecedent_tok WHERE a.head_pos = 'PRP'")
def pronoun_links(v: Views) -> DataFrame:
    """LNK-FA-PRO, LNK-ANT-NE: pronouns and the entities of their antecedents."""
    c = v("g_ent_coref")
    antecedents = entity_links.antecedent_links(c.select("doc_id", F.col("antecedent_id").alias("id"), F.col("antecedent_tok").alias("head_tok")).distinct(), v("g_ent_named"))
    return entity_links.pronoun_links(v("g_ent_argument"), c, c.select(F.col("id").alias("mention_id"), "antecedent_id"), antecedents)


_NEW = f"f AS (SELECT a.*, coalesce(start_tok, head_tok) AS s, coalesce(end_tok, head_tok) AS e FROM g_ent_argument a WHERE {_CORE} AND syntactic_type <> 'PRO' AND head_pos <> 'IN' AND NOT EXISTS (SELECT 1 FROM g_ent_named n WHERE n.doc_id = a.doc_id AND n.head_tok = a.head_tok)), k AS (SELECT *, concat('nominal_', CAST(doc_id AS STRING), '_', CAST(s AS STRING), '_', CAST(e AS STRING)) AS target_id FROM f)"


@query("new_nominal_entities", f"WITH {_NEW} SELECT target_id AS id, 'NOMINAL' AS type, doc_id, head, head_tok, s AS start_tok, e AS end_tok, id AS source_argument FROM k QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY id) = 1")
def new_nominal_entities(v: Views) -> DataFrame:
    """LNK-FA-NEWENT: entities made of arguments."""
    return entity_links.new_entities(v("g_ent_argument"), v("g_ent_named"))[0]


@query("new_nominal_links", f"WITH {_NEW} SELECT id AS argument_id, target_id, 'Entity' AS target_kind FROM k")
def new_nominal_links(v: Views) -> DataFrame:
    """LNK-FA-NEWENT: arguments and the entities made of them."""
    return entity_links.new_entities(v("g_ent_argument"), v("g_ent_named"))[1]


@query("numeric_links", """WITH t AS (SELECT doc_id, id, unnest(range(start_tok, end_tok + 1)) AS tok, head_tok % 2 = 0 AS has_value FROM g_ent_named WHERE type IN ('MONEY','QUANTITY','PERCENT'))
SELECT DISTINCT a.id AS argument_id, CASE WHEN has_value THEN concat('v', t.id) ELSE t.id END AS target_id, CASE WHEN has_value THEN 'VALUE' ELSE 'NamedEntity' END AS target_kind FROM g_ent_argument a JOIN t ON t.doc_id = a.doc_id AND t.tok = a.head_tok WHERE a.id NOT IN (SELECT argument_id FROM g_ent_link WHERE target_kind = 'Entity')""")
def numeric_links(v: Views) -> DataFrame:
    """LNK-FA-NUM: arguments and the amounts that their heads are part of."""
    values = v("g_ent_named").where("head_tok % 2 = 0").select("id", F.concat(F.lit("v"), "id").alias("value_id"))
    return entity_links.numeric_links(v("g_ent_argument"), v("g_ent_named"), values, v("g_ent_link"))


_FLAT = "fl AS (SELECT DISTINCT argument_id, target_id, target_kind FROM g_ent_link UNION SELECT l.argument_id, concat('E', CAST(n.head_tok % 20 AS STRING)), 'Entity' FROM g_ent_link l JOIN g_ent_named n ON n.id = l.target_id AND n.head_tok % 4 = 0 WHERE l.target_kind = 'NamedEntity')"


def _flat(v: Views) -> DataFrame:
    return entity_links.flattened(v("g_ent_link"), v("g_ent_named").where("head_tok % 4 = 0").select("id", F.concat(F.lit("E"), (F.col("head_tok") % 20).cast("string")).alias("entity_id")))


@query("flattened_links", f"WITH {_FLAT} SELECT * FROM fl")
def flattened_links(v: Views) -> DataFrame:
    """LNK-FA-VIA-NE: links handed on to entities."""
    return _flat(v)


@query("cleaned_links", f"WITH {_FLAT} SELECT * FROM fl WHERE target_kind <> 'NamedEntity' OR argument_id NOT IN (SELECT argument_id FROM fl WHERE target_kind IN ('Entity','TEvent','TIMEX'))")
def cleaned_links(v: Views) -> DataFrame:
    """LNK-CLEAN: links without the steps between."""
    return entity_links.cleaned(_flat(v))
