"""SQL, in DuckDB's dialect, of the operators that SQL can say."""

from __future__ import annotations

from quillgraph.llm.mixing import CLOSING, PER_STEP

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH RECURSIVE sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, len({WORDS})::BIGINT AS size, row_number() OVER () AS rid FROM documents),
u AS (SELECT *, (('0x' || substr(md5('mix:' || doc_id || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM sized),
src AS (SELECT skey, n, size::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS weight FROM (SELECT skey, count(*) AS n, sum(size) AS size FROM sized GROUP BY skey)),
lev AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
FROM src WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, skey)),
aims AS (SELECT skey, n, source_size, coalesce(least(cap, (SELECT max(level) FROM lev WHERE level * weight <= cap) * weight), cap) AS target FROM lev),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, greatest(1, n // {PER_STEP}) AS steps FROM aims),
parts AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p, target - floor(rate)::BIGINT * source_size AS rest FROM rates),
d AS (SELECT u.*, rest, (u / (1 - u)) / (p / (1 - p)) AS q, floor(u * steps)::BIGINT AS step FROM u JOIN parts USING (skey) WHERE p > 0),
cells AS (SELECT skey, step, rest, words, m, sum(words) OVER r AS e, sum(m) OVER r AS docs_e FROM (SELECT skey, step, rest, sum(size) AS words, count(*) AS m FROM d GROUP BY ALL) WINDOW r AS (PARTITION BY skey ORDER BY step)),
first AS (SELECT skey, step, docs_e, (rest - e + words)::DOUBLE AS gap FROM cells WHERE e > rest QUALIFY row_number() OVER (PARTITION BY skey ORDER BY step) = 1),
cut AS (SELECT f.skey, f.step, f.gap, coalesce(max(c.step), f.step) AS last FROM first f LEFT JOIN cells c ON c.skey = f.skey AND c.step > f.step AND c.docs_e - c.m < f.docs_e + {CLOSING} GROUP BY f.skey, f.step, f.gap),
zone AS (SELECT d.skey, d.rid, d.size, row_number() OVER (PARTITION BY d.skey ORDER BY q, doc_id, d.rid) AS k FROM d JOIN cut c ON d.skey = c.skey AND d.step BETWEEN c.step AND c.last),
fold AS (SELECT skey, 0::BIGINT AS k, gap AS gap, NULL::BIGINT AS rid FROM cut UNION ALL
SELECT z.skey, z.k, CASE WHEN z.size <= f.gap THEN f.gap - z.size ELSE f.gap END, CASE WHEN z.size <= f.gap THEN z.rid END FROM fold f JOIN zone z ON z.skey = f.skey AND z.k = f.k + 1)
SELECT u.doc_id, u.size, pt.source_size, pt.target, u.size * c.copies AS taken, c.copies FROM u JOIN parts pt USING (skey) LEFT JOIN cut USING (skey),
LATERAL (SELECT whole + CASE WHEN p <= 0 THEN 0 WHEN cut.step IS NULL THEN 1 WHEN floor(u.u * steps) < cut.step THEN 1 WHEN u.rid IN (SELECT rid FROM fold WHERE rid IS NOT NULL) THEN 1 ELSE 0 END AS copies) c"""

OP5 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, range(1, len(w) - 33) r(i)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN rep USING (k), range(0, 35) s(j)),
pos AS (SELECT doc_id, p, w[p] AS x FROM d, range(1, len(w) + 1) r(p)), kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("text", LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM d, range(1, greatest(len(w), CASE WHEN len(w) > 0 THEN 2 ELSE 0 END)) r(i)), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT reach.v, y FROM reach JOIN both_ways ON reach.r = x), root AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r AS component_id, r = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN root ON v = d.doc_id"""


OP11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS g, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || g[1:8])::BIGINT AS h1, ('0x' || g[9:16])::BIGINT AS h2, ('0x' || g[17:24])::BIGINT AS h3, ('0x' || g[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

OP13 = rf"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
long AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS text FROM documents), run AS (SELECT doc_id, {LOWER} AS w FROM long), counted AS (SELECT doc_id, w, count(*) AS m FROM run GROUP BY ALL),
bytes AS (SELECT w, m, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM counted),
crc AS (SELECT w, m, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h FROM bytes, tab),
v AS (SELECT word, sum(m)::BIGINT AS n FROM (SELECT m, CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM crc) WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
del AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS k FROM v, range(1, length(word) + 1) r(i)),
near AS (SELECT a.word, b.word AS x FROM del a JOIN del b USING (i, k) WHERE a.word <> b.word UNION SELECT word, k FROM del SEMI JOIN v ON k = v.word UNION SELECT k, del.word FROM del SEMI JOIN v ON k = v.word),
best AS (SELECT near.word, x AS form, v.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN v ON x = v.word QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, x) = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
far AS (SELECT word, word AS root FROM f UNION ALL SELECT far.word, f.form FROM far JOIN f ON f.word = far.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, far.root, f.n, f.n_near, f.form_n FROM f JOIN far USING (word) JOIN f e ON e.word = far.root WHERE e.form IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op5_substring": OP5, "op10_neardup": OP10, "op11_fim": OP11, "op13_variants": OP13}
