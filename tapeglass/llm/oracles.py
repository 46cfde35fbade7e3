"""SQL (DuckDB's) of those training-data queries that SQL can express."""

from __future__ import annotations

#: Words as the contracts define them, and the lower-casing of A-Z only.
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.y FROM reach JOIN sym ON sym.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
OP6 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], chr(1))) AS h FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) t(j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n_words, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL), '') AS t FROM x LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""

OP8 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS s FROM w),
dl AS (SELECT r, count(*) AS n, count(DISTINCT s) AS k FROM l WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY r),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 7], chr(1))) AS h FROM g),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM h), range(8) t(j) WHERE c > 1 GROUP BY r),
st AS (SELECT w.r, doc_id, source, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dl.n - dl.k, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
ru AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 5 * n_dup_lines > n_words AS f4 FROM st),
ho AS (SELECT source, count(*) AS n, [sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)] AS f FROM ru WHERE source IS NOT NULL GROUP BY source),
lo AS (SELECT source, n, unnest(f)::DOUBLE AS f, generate_subscripts(f, 1) AS rule FROM ho),
me AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS alln, count(*) AS hosts FROM lo GROUP BY rule),
sp AS (SELECT lo.rule, m, m * (1 - m) AS own, sum(n * pow(f / n - m, 2)) / any_value(alln) - m * (1 - m) * any_value(hosts) / any_value(alln) AS btw FROM lo JOIN me USING (rule) GROUP BY lo.rule, m),
pr AS (SELECT rule, m, least(greatest(CASE WHEN btw > 0 THEN own / btw - 1 ELSE 1e6 END, 1.0), 1e6) AS k FROM sp),
ve AS (SELECT source, bool_or((f + k * m) / (n + k) > 0.5) AS bad FROM lo JOIN pr USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT coalesce(bad, false) AS kept FROM ru LEFT JOIN ve USING (source)
"""

_ESC = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || '<'), '[', chr(92) || '['), ']', chr(92) || ']')"
OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(5 + 2 * length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
"""

_LINE_WORDS = "list_filter(string_split(translate(s, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '')"
OP10 = f"""
WITH l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, i, s, {_LINE_WORDS} AS w FROM l0),
f AS (SELECT w, len(w) AS n, min(doc_id * 10000000 + i) AS o FROM l WHERE len(w) >= 4 GROUP BY w),
v AS (SELECT w, n, o, p, md5(array_to_string(w[1 : p - 1] || w[p + 1 : n], chr(1))) AS h FROM (SELECT w, n, o, unnest(range(1, n + 1)) AS p FROM f WHERE n >= 8)),
sub AS (SELECT v.w FROM v JOIN (SELECT h, p, min(o) AS m FROM v GROUP BY h, p) x USING (h, p) WHERE m < v.o),
long AS (SELECT v.w AS lw, v.o AS lo, f.w AS sw, f.o AS so FROM v JOIN (SELECT *, md5(array_to_string(w, chr(1))) AS h FROM f WHERE n >= 8) f USING (h)),
near AS (SELECT w FROM sub UNION SELECT lw FROM long WHERE so < lo UNION SELECT sw FROM long WHERE lo < so),
d AS (SELECT l.doc_id, l.i, l.s, len(l.w) >= 4 AND (l.doc_id * 10000000 + l.i <> f.o OR near.w IS NOT NULL) AS gone FROM l LEFT JOIN f USING (w) LEFT JOIN near USING (w))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""

ORACLES = {"op5_jaccard_join": OP5, "op6_substring_dedup": OP6, "op8_host_rules": OP8, "op9_chat_format": OP9, "op10_line_dedup": OP10}
