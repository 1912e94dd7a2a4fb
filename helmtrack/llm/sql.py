"""The queries that SQL can express, in DuckDB's dialect over the whole tables."""

from __future__ import annotations

from . import curriculum, divergence, quality, runs, warc

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS t FROM (SELECT r, w, unnest(range(greatest(0, len(w) - 34))) AS i FROM d)),
s AS (SELECT md5(t) AS h FROM p GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM p JOIN s ON md5(p.t) = s.h) GROUP BY r),
u AS (SELECT r, unnest(range(len(w))) AS k, unnest(w) AS x FROM d),
n AS (SELECT DISTINCT r, unnest(gone) AS k FROM g),
k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.k) AS t, count(*) AS c FROM u ANTI JOIN n ON n.r = u.r AND n.k = u.k GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_ITEM = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

CONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_ITEM} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS t FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM} AS w FROM documents),
z AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(greatest(0, len(w) - n + 1))) AS k FROM d, z)),
m AS (SELECT doc_id, p.n, k, item FROM p JOIN i ON p.n = i.n AND p.t = i.t),
h AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)"""

_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'row ' || row_number() OVER ()) AS who, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT r, who, source, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, who, source, line, {_WORDS.replace("coalesce(text, '')", 'line')} AS w FROM l),
o AS (SELECT r, who, source, line, len(w) AS words, array_to_string({_WORDS.replace("coalesce(text, '')", f"regexp_replace({_LOWER}, '[0-9]', '0', 'g')")}, ' ') AS norm FROM n WHERE len(w) > 0),
hosts AS (SELECT source, count(DISTINCT who) AS docs FROM d GROUP BY source),
often AS (SELECT o.source, norm FROM o JOIN hosts ON o.source IS NOT DISTINCT FROM hosts.source GROUP BY o.source, norm HAVING count(DISTINCT who) >= {quality.LEAST} AND count(DISTINCT who) > {quality.SHARE}::DOUBLE * any_value(docs)),
gone AS (SELECT r, sum(words)::BIGINT AS g FROM o JOIN often ON o.source IS NOT DISTINCT FROM often.source AND o.norm = often.norm GROUP BY r),
dup AS (SELECT r, sum(c - 1)::BIGINT AS n FROM (SELECT r, line, count(*) AS c FROM o GROUP BY ALL) GROUP BY r),
v AS (SELECT r, k, array_to_string(w[k + 1 : k + 5], ' ') AS t FROM (SELECT r, w, unnest(range(greatest(0, len(w) - 4))) AS k FROM d)),
rep AS (SELECT r, count(DISTINCT x)::BIGINT AS n FROM (SELECT r, unnest(range(k, k + 5)) AS x FROM (SELECT *, count(*) OVER (PARTITION BY r, t) AS c FROM v) WHERE c > 1) GROUP BY r),
q AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(g, 0) AS n_boilerplate_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT *, NOT base_failed AND n_words - n_boilerplate_words >= {quality.KEEP}::DOUBLE * n_words AS kept FROM f"""

_SHINGLE_WORDS = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
h AS (SELECT DISTINCT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(greatest(0, len(w) - 1)), lambda i: w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d)),
z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id JOIN z y ON y.doc_id = a.doc_id JOIN z v ON v.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, y.n, v.n HAVING 100 * count(*) >= 80 * (y.n + v.n - count(*))),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a),
m AS (SELECT a AS doc_id, min(r) AS component_id FROM c GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN z USING (doc_id)"""

ORACLES = {
    "op1_substring": SUBSTRING, "op2_warc": warc.WARC_SQL, "op4_near_dedup": NEAR, "op7_quality": QUALITY, "op9_decontaminate": CONTAMINATION,
    "op11_divergence": divergence.DIVERGENCE_SQL, "op12_mix": curriculum.MIX_SQL, "op13_runs": runs.RUNS_SQL,
}
