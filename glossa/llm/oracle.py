"""DuckDB texts for the queries that SQL can express."""
from __future__ import annotations

from . import quality


def quality_sql(limits: quality.QualityLimits | None = None) -> str:
    """The quality rules: base counts by unnesting words, distances by joining histograms with language sums."""
    limits = limits or quality.QualityLimits()
    vocabulary = sorted({w for ws in limits.languages.values() for w in ws})
    words = ", ".join(f"('{w}')" for w in vocabulary)
    languages = ", ".join(f"'{x}'" for x in limits.languages)
    strip = ["coalesce(text, '')"]
    for c in quality.CLASSES:
        quoted = c.replace("'", "''")
        strip.append(f"regexp_replace({strip[-1]}, '{quoted}', '', 'g')")
    stages = ", ".join(f"{x} AS t{i}" for i, x in enumerate(strip))
    n = len(strip)
    lengths = ", ".join(f"length(t{i}) - length(t{i + 1})" for i in range(n - 1)) + f", length(t{n - 1})"
    term = "CASE WHEN h.p > 0 THEN h.p * log2(h.p / ((h.p + r.q) / 2)) ELSE 0 END + CASE WHEN r.q > 0 THEN r.q * log2(r.q / ((h.p + r.q) / 2)) ELSE 0 END"

    def distance(name: str, table: str, guard: str, limit: float) -> str:
        return f"""{name} AS (SELECT doc_id, min(sqrt(greatest(0, s))) > {limit} AS far FROM (SELECT h.doc_id, r.lang, sum({term}) / 2 AS s FROM {table} h JOIN {table}_ref r USING (k) GROUP BY 1, 2) JOIN base USING (doc_id) WHERE {guard} GROUP BY 1)"""

    return rf"""WITH s AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS text, {stages} FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM s)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT doc_id, i FROM w WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1), (VALUES (0), (1), (2)) v(d) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM s) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
nw AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
base AS MATERIALIZED (SELECT s.doc_id, s.lang, coalesce(nw.n, 0) AS n_words, length(t0) - (length(t1) - length(t2)) AS word_chars, length(t0) - length(regexp_replace(t0, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(t0) AS n_chars,
  coalesce(nw.n, 0) < {limits.min_words} OR 100 * coalesce(rep.n, 0) > 50 * coalesce(nw.n, 0) AS base_failed, [{lengths}] AS classes FROM s LEFT JOIN nw USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
cc AS (SELECT doc_id, unnest(range({n})) AS k, unnest(classes) AS c FROM base),
v AS (SELECT col0 AS k FROM (VALUES {words})),
wc AS (SELECT b.doc_id, v.k, coalesce(m.c, 0) AS c FROM base b CROSS JOIN v LEFT JOIN (SELECT doc_id, lower(w) AS k, count(*) AS c FROM w GROUP BY 1, 2) m ON m.doc_id = b.doc_id AND m.k = v.k),
good AS (SELECT * FROM base WHERE NOT base_failed AND lang IN ({languages})),
ch AS (SELECT doc_id, k, c / nullif(n_chars, 0) AS p FROM cc JOIN base USING (doc_id)),
ch_ref AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM cc JOIN good USING (doc_id) GROUP BY 1, 2),
wh AS (SELECT doc_id, k, c / nullif(n_words, 0) AS p FROM wc JOIN base USING (doc_id) UNION ALL SELECT doc_id, '', 1 - sum(c) / nullif(any_value(n_words), 0) FROM wc JOIN base USING (doc_id) GROUP BY 1),
wr AS (SELECT lang, k, sum(c) / sum(n_words) AS q FROM wc JOIN good USING (doc_id) GROUP BY 1, 2),
wh_ref AS (SELECT * FROM wr UNION ALL SELECT lang, '', 1 - sum(q) FROM wr GROUP BY 1),
{distance('cd', 'ch', f'n_chars >= {limits.min_chars}', limits.max_char_distance)},
{distance('wd', 'wh', f'n_words >= {limits.min_judged_words}', limits.max_word_distance)}
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(cd.far, false) AND NOT coalesce(wd.far, false) AS kept
FROM base b LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)"""


DEDUP_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS i, count(*) OVER (PARTITION BY text) AS n, max(doc_id) OVER (PARTITION BY text) AS keep_id FROM t)
SELECT doc_id, keep_id, n AS group_size, i = 1 AS kept, sha256(text) AS text_sha256 FROM r"""

SEARCH_SQL = r"""WITH tk AS MATERIALIZED (SELECT doc_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT doc_id, text, row_number() OVER () AS i FROM documents)),
dn AS (SELECT i, any_value(doc_id) AS doc_id, count(*) AS n FROM tk GROUP BY i),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dn),
f AS MATERIALIZED (SELECT i, t, count(*) AS tf FROM tk GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY t, n_docs),
s AS (SELECT item_id, dn.doc_id, f.i, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN dn ON dn.i = f.i, g GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


def codes_sql(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """Codes of vectors: every part against every entry, round by round."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS i, vec_id, label, x, len(x) // {parts} AS d FROM (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)),
pt AS MATERIALIZED (SELECT i, p, x[p * d + 1:(p + 1) * d] AS x FROM v, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, x FROM pt WHERE i <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT i, p, min(s).e AS e, min(s).s AS s, any_value(x) AS x FROM (SELECT pt.i, pt.p, pt.x, {{'s': CAST(list_sum(list_transform(list_zip(pt.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': b.e}} AS s FROM pt JOIN b{r} b USING (p)) GROUP BY i, p)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {', '.join(steps)},
c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{rounds} GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (i), h"""
