"""Registered queries on argument graphs, snapshots of metrics, fused entities and families of rules, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registry
from .operators import argument_graph, entity_fusion, families, regressions
from .registry import Views, query


def _wanted(v: Views) -> DataFrame:
    return v("g_sag_wanted").select("doc_id", F.col("start_id").alias("start"), F.col("end_id").alias("end"))


@query("argument_paths", """WITH RECURSIVE w AS (SELECT DISTINCT doc_id, start_id, end_id FROM g_sag_wanted), p AS (SELECT doc_id, start_id, end_id, start_id AS node, start_id AS nodes, '' AS roles, 0 AS length FROM w
UNION ALL SELECT p.doc_id, p.start_id, p.end_id, e.dst, concat(p.nodes, '>', e.dst), concat(p.roles, '>', e.role), p.length + 1 FROM p JOIN g_sag_edge e ON e.doc_id = p.doc_id AND e.src = p.node WHERE p.length < 4 AND (p.length = 0 OR p.node <> p.end_id))
SELECT doc_id, start_id, end_id, length, nodes, roles FROM p WHERE length > 0 AND node = end_id""")
def argument_paths(v: Views) -> DataFrame:
    """ING-SAG: ways from each frame to the next one of its sentence."""
    p = argument_graph.paths(v("g_sag_edge"), _wanted(v), max_depth=4)
    return p.select("doc_id", F.col("start").alias("start_id"), F.col("end").alias("end_id"), "length", F.array_join("nodes", ">").alias("nodes"), F.concat(F.lit(">"), F.array_join("roles", ">")).alias("roles"))


@query("role_chains", """WITH RECURSIVE r AS (SELECT DISTINCT doc_id, start_id, start_id AS node, 0 AS hop FROM g_sag_wanted UNION SELECT r.doc_id, r.start_id, e.dst, r.hop + 1 FROM r JOIN g_sag_edge e ON e.doc_id = r.doc_id AND e.src = r.node WHERE r.hop < 2)
SELECT DISTINCT r.doc_id, r.start_id, e.role, n.label FROM r JOIN g_sag_edge e ON e.doc_id = r.doc_id AND e.src = r.node JOIN g_sag_node n ON n.doc_id = e.doc_id AND n.id = e.dst""")
def role_chains(v: Views) -> DataFrame:
    """ING-SAG: what the roles around a frame lead to."""
    return argument_graph.role_chains(v("g_sag_node"), v("g_sag_edge"), _wanted(v)).withColumnRenamed("start", "start_id")


@query("argument_graph_violations", """SELECT e.doc_id, count(*) FILTER (WHERE s.id IS NULL) AS dangling_sources, count(*) FILTER (WHERE t.id IS NULL) AS dangling_targets, bool_or(e.role = 'BACK') AS has_cycle FROM g_sag_edge e
LEFT JOIN g_sag_node s ON s.doc_id = e.doc_id AND s.id = e.src LEFT JOIN g_sag_node t ON t.doc_id = e.doc_id AND t.id = e.dst GROUP BY 1""")
def argument_graph_violations(v: Views) -> DataFrame:
    """ING-SAG: edges without ends and cycles of every document; only edges back make cycles here."""
    return argument_graph.violations(v("g_sag_node"), v("g_sag_edge"))


def _snapshots(v: Views) -> tuple[DataFrame, DataFrame]:
    return tuple(v("g_metric").where(f"side = {s}").select("metric", "value") for s in (0, 1))


_BOTH = "a AS (SELECT metric, value FROM g_metric WHERE side = 0), b AS (SELECT metric, value FROM g_metric WHERE side = 1)"


@query("run_differences", f"WITH {_BOTH} SELECT coalesce(a.metric, b.metric) AS metric, a.value AS value1, b.value AS value2, abs(a.value - b.value) AS absolute_diff, round(CASE WHEN a.value <> 0 THEN 100 * abs(a.value - b.value) / abs(a.value) END, 9) AS relative_diff_percent FROM a FULL JOIN b ON a.metric = b.metric WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 0.01 * greatest(a.value, b.value)")
def run_differences(v: Views) -> DataFrame:
    """QL-DETERM: metrics in which two runs differ by more than a hundredth."""
    return regressions.determinism(*_snapshots(v), tolerance=0.01).withColumn("relative_diff_percent", F.round("relative_diff_percent", 9))


@query("run_determinism", f"WITH {_BOTH}, n AS (SELECT count(*) AS n FROM a FULL JOIN b ON a.metric = b.metric WHERE a.value IS NULL OR b.value IS NULL OR a.value <> b.value) SELECT n = 0 AS conclusive, n AS num_violations, CASE n WHEN 0 THEN 'Deterministic' ELSE concat('Non-deterministic: ', CAST(n AS STRING), ' metric(s) differ') END AS summary FROM n")
def run_determinism(v: Views) -> DataFrame:
    """QL-DETERM: the verdict on two runs."""
    return regressions.determinism_verdict(regressions.determinism(*_snapshots(v)))


#: Limits of the registered gate: of every kind of event at most a number of rows, and at most so many more.
_LIMITS = {m: regressions.Limit(total, increase) for m, total, increase in (("click", 100, 5), ("view", None, 0), ("purchase", 0, None), ("login", 10**9, 10**9), ("only_click", None, 0), ("nowhere", 0, 0))}
_LIMIT_ROWS = ", ".join(f"('{m}', {'NULL' if x.total is None else x.total}, {'NULL' if x.increase is None else x.increase})" for m, x in _LIMITS.items())
_BROKEN = f"k AS (SELECT col0 AS metric, CAST(col1 AS DOUBLE) AS most, CAST(col2 AS DOUBLE) AS more FROM (VALUES {_LIMIT_ROWS})), x AS (SELECT k.*, coalesce(a.value, 0) AS va, coalesce(b.value, 0) AS vb FROM k LEFT JOIN a ON a.metric = k.metric LEFT JOIN b ON b.metric = k.metric), br AS (SELECT metric, metric AS reason, va AS baseline, vb AS current, vb - va AS increase FROM x WHERE vb > most UNION ALL SELECT metric, concat(metric, '_increase'), va, vb, vb - va FROM x WHERE vb - va > more)"


@query("gate_violations", f"WITH {_BOTH}, {_BROKEN} SELECT * FROM br")
def gate_violations(v: Views) -> DataFrame:
    """QA-DELTA: limits that a snapshot breaks."""
    return regressions.gate(*_snapshots(v), _LIMITS)


_PHASES = "f AS (SELECT phase, doc_id % 2 AS side, avg(duration) AS score FROM g_phase_run GROUP BY 1, 2), qa AS (SELECT avg(score) AS q FROM f WHERE side = 0), qb AS (SELECT avg(score) AS q FROM f WHERE side = 1)"


def _phases(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    f = v("g_phase_run").groupBy("phase", (F.col("doc_id") % 2).alias("side")).agg(F.avg("duration").alias("score"))
    a, b = f.where("side = 0"), f.where("side = 1")
    return a, b, a.agg(F.avg("score").alias("quality")), b.agg(F.avg("score").alias("quality"))


@query("gate_verdict", f"WITH {_BOTH}, {_BROKEN}, {_PHASES}, r AS (SELECT DISTINCT reason FROM br UNION ALL SELECT 'overall_quality' FROM qa, qb WHERE qb.q < qa.q - 0.01) SELECT (SELECT count(*) FROM r) = 0 AS passed, round(qa.q, 9) AS baseline_quality, round(qb.q, 9) AS current_quality, round(qb.q - qa.q, 9) AS delta, coalesce((SELECT string_agg(reason, ',' ORDER BY reason) FROM r), '') AS reasons FROM qa, qb")
def gate_verdict(v: Views) -> DataFrame:
    """QA-DELTA: the verdict of the gate, mean durations standing for quality."""
    _, _, qa, qb = _phases(v)
    d = regressions.gate_verdict(qa, qb, regressions.gate(*_snapshots(v), _LIMITS), tolerance=0.01)
    return d.withColumns({c: F.round(c, 9) for c in ("baseline_quality", "current_quality", "delta")})


@query("phase_regressions", f"WITH {_PHASES} SELECT b.phase, round(coalesce(a.score, 0), 9) AS baseline, round(b.score, 9) AS current, round(b.score - coalesce(a.score, 0), 9) AS delta FROM f b LEFT JOIN f a ON a.phase = b.phase AND a.side = 0 WHERE b.side = 1 AND b.score - coalesce(a.score, 0) < 0")
def phase_regressions(v: Views) -> DataFrame:
    """QL-REGRESS: phases whose score fell."""
    a, b, *_ = _phases(v)
    return regressions.phase_regressions(a, b).withColumns({c: F.round(c, 9) for c in ("baseline", "current", "delta")})


@query("quality_regression", f"WITH {_PHASES} SELECT round(qa.q, 9) AS baseline_quality, round(qb.q, 9) AS current_quality, round(qb.q - qa.q, 9) AS quality_delta, round((qb.q - qa.q) / qa.q * 100, 9) AS percent_change, qb.q - qa.q < -0.001 AS is_regression, abs((qb.q - qa.q) / qa.q * 100) > 1 AS is_significant FROM qa, qb")
def quality_regression(v: Views) -> DataFrame:
    """QL-REGRESS: whether quality fell, and by more than allowed."""
    *_, qa, qb = _phases(v)
    return regressions.regression(qa, qb).withColumns({c: F.round(c, 9) for c in ("baseline_quality", "current_quality", "quality_delta", "percent_change")})


_RIVALS = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head_tok, type ORDER BY coalesce(source <> 'spacy', true), kb_id IS NULL, id) AS k, first_value(id) OVER (PARTITION BY doc_id, head_tok, type ORDER BY coalesce(source <> 'spacy', true), kb_id IS NULL, id) AS winner FROM g_rival WHERE type IN ('CARDINAL','DATE','ORDINAL','MONEY','TIME','QUANTITY','PERCENT')),
ls AS MATERIALIZED (SELECT id AS loser, winner FROM o WHERE k > 1)"""


@query("fused_entities", f"""WITH {_RIVALS}, g AS (SELECT ls.winner AS id, arg_min(r.kb_id, r.id) FILTER (WHERE r.kb_id IS NOT NULL) AS kb_id, arg_min(r.score, r.id) FILTER (WHERE r.score IS NOT NULL) AS score, bool_or(coalesce(r.is_mention, false)) AS is_mention FROM ls JOIN g_rival r ON r.id = ls.loser GROUP BY 1)
SELECT r.doc_id, r.id, r.head_tok, r.type, r.source, coalesce(r.kb_id, g.kb_id) AS kb_id, CAST(coalesce(r.score, g.score) AS DOUBLE) AS score, coalesce(r.is_mention, false) OR coalesce(g.is_mention, false) AS is_mention FROM g_rival r LEFT JOIN g ON g.id = r.id WHERE r.id NOT IN (SELECT loser FROM ls)""")
def fused_entities(v: Views) -> DataFrame:
    """ING-FUSE-NUM: numbers and times after rival mentions are fused."""
    e = v("g_rival").withColumn("score", F.col("score").cast("double"))
    return entity_fusion.fused(e, entity_fusion.rivals(e)).select("doc_id", "id", "head_tok", "type", "source", "kb_id", "score", "is_mention")


@query("fused_entity_links", f"WITH {_RIVALS} SELECT DISTINCT coalesce(ls.winner, l.id) AS id, l.entity_id FROM g_rival_link l LEFT JOIN ls ON ls.loser = l.id")
def fused_entity_links(v: Views) -> DataFrame:
    """ING-FUSE-NUM: links of fused mentions."""
    return entity_fusion.relinked(v("g_rival_link"), entity_fusion.rivals(v("g_rival")))


@query("filled_entity_heads", """WITH t AS (SELECT b.id, b.doc_id, b.start_tok, b.end_tok, unnest(range(b.start_tok, b.end_tok + 1)) AS tok FROM g_bare_entity b WHERE b.head IS NULL OR b.head_tok IS NULL),
a AS (SELECT t.id, d.head_tok, d.dep_tok FROM t JOIN g_dep d ON d.doc_id = t.doc_id AND d.dep_tok = t.tok AND d.head_tok <> d.dep_tok AND d.head_tok BETWEEN t.start_tok AND t.end_tok),
f AS (SELECT t.id, t.tok, k.text, EXISTS (SELECT 1 FROM a WHERE a.id = t.id AND a.head_tok = t.tok) AS governs FROM t JOIN g_token k ON k.doc_id = t.doc_id AND k.tok_index_doc = t.tok WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = t.id AND a.dep_tok = t.tok)),
h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY governs DESC, tok) = 1) SELECT b.doc_id, b.id, b.start_tok, b.end_tok, coalesce(b.head, h.text) AS head, coalesce(b.head_tok, h.tok) AS head_tok FROM g_bare_entity b LEFT JOIN h ON h.id = b.id""")
def filled_entity_heads(v: Views) -> DataFrame:
    """ING-FUSE-HEAD: heads of mentions that had none."""
    return entity_fusion.filled_heads(v("g_bare_entity"), v("g_token"), v("g_dep")).select("doc_id", "id", "start_tok", "end_tok", "head", "head_tok")


def _family_tables(v: Views) -> dict[str, DataFrame]:
    # Every rule reads the words and dependencies several times.
    v.written("g_token_nom", "g_dep_family", "g_tevent", "g_timex")
    mentions = v("g_tevent").where("start_tok % 3 = 0").select("doc_id", "id", "start_tok", (F.col("end_tok") + 1).alias("end_tok"), F.col("start_tok").alias("head_tok"), F.col("pred").alias("value"), F.lit("NOM").alias("syntactic_type"), F.lit("given").alias("source"))
    entities = v("g_timex").select("doc_id", "start_tok", "end_tok", (F.col("start_tok") % 2 == 1).alias("stale"))
    return {"tokens": v("g_token_nom"), "deps": v("g_dep_family"), "entities": entities, "mentions": mentions, "events": v("g_tevent")}


def _family_sql() -> str:
    rule = lambda name: "(" + registry.REGISTRY[name].sql.replace("g_dep_nom", "g_dep_family") + ")"
    dependents = lambda types, prefix: f"SELECT DISTINCT d.doc_id, concat('{prefix}_', CAST(d.doc_id AS STRING), '_', CAST(d.dep_tok AS STRING)) AS id, d.dep_tok AS start_tok, d.dep_tok AS end_tok FROM g_dep_family d JOIN g_token_nom t ON t.doc_id = d.doc_id AND t.tok_index_doc = d.dep_tok AND t.pos IN ('NN','NNS','NNP') WHERE d.type IN {types} AND d.head_tok <> d.dep_tok"
    free = lambda c: f"NOT EXISTS (SELECT 1 FROM {c} c WHERE c.doc_id = d.doc_id AND c.tok = d.dep_tok)"
    cover = lambda *names: " UNION ".join(f"SELECT doc_id, unnest(range(start_tok, end_tok + 1)) AS tok FROM {n}" for n in names)
    return f"""WITH gv AS (SELECT doc_id, id, start_tok, end_tok + 1 AS end_tok FROM g_tevent WHERE start_tok % 3 = 0 UNION ALL SELECT doc_id, id, start_tok, end_tok FROM g_timex WHERE start_tok % 2 = 0),
pn AS MATERIALIZED (SELECT doc_id, id, head_tok AS start_tok, head_tok AS end_tok FROM {rule('predicate_nominals')}), c1 AS MATERIALIZED ({cover('gv', 'pn')}), ap AS MATERIALIZED ({dependents("('appos')", 'app')} AND {free('c1')}),
wa AS MATERIALIZED (SELECT doc_id, id, start_tok, end_tok FROM {rule('wider_appositions')}), wc AS MATERIALIZED (SELECT doc_id, id, start_tok, end_tok FROM {rule('wider_conjunctions')}), c2 AS MATERIALIZED ({cover('gv', 'pn', 'ap', 'wa', 'wc')}), ea AS ({dependents("('nsubj','dobj','obj')", 'evarg')} AND {free('c2')})
SELECT *, 'pred_nominal' AS source FROM pn UNION ALL SELECT *, 'appositive' FROM ap UNION ALL SELECT *, 'wider_appositive' FROM wa UNION ALL SELECT *, 'wider_conjunction' FROM wc UNION ALL SELECT *, 'event_argument' FROM ea"""


@query("nominal_family_mentions", _family_sql())
def nominal_family_mentions(v: Views) -> DataFrame:
    """REF-FAMILY: mentions that the family of nominal rules adds, run in its order."""
    return families.BOOK.run_family(_family_tables(v), "nominal_mentions")["mentions"].where("source <> 'given'").select("doc_id", "id", "start_tok", "end_tok", "source")
