"""Parts of the SQL that stands for the queries: common tables in DuckDB's dialect."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
EDGES_OF_NAME = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

PAGES = rf"""pg AS (SELECT d.doc_id AS page_id, d.source AS ws, CASE WHEN d.doc_id >= 10 THEN d.doc_id // 10 END AS parent_id, array_to_string(list_slice(regexp_extract_all(d.text, '{WORD}'), 1, 5), ' ') AS title,
d.text, sha256(d.text) AS hash, coalesce(l.toxic = 1, false) AS archived, d.n_chars AS updated_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LIVE_CHUNKS = "live_chunks AS (SELECT DISTINCT ws, hash FROM pg WHERE NOT archived)"
EMBEDDED = "embedded AS (SELECT DISTINCT hash FROM pg JOIN embeddings ON page_id = vec_id)"
BLOCKS = "bl AS (SELECT page_id, i - 1 AS block_index, lines[i] AS text FROM (SELECT page_id, string_split(text, chr(10)) AS lines FROM pg), range(1, len(lines) + 1) r(i))"
NAMES = rf"""{PAGES}, named AS (SELECT DISTINCT ws, hash, list_filter(list_transform(list_filter(regexp_extract_all(text, '{WORD}'), lambda w: regexp_matches(w, '^\p{{Lu}}')), lambda w: regexp_replace(w, '{EDGES_OF_NAME}', '', 'g')), lambda w: w <> '') AS names FROM pg)"""


def key(name: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(array_to_string(regexp_extract_all({name}, '{WORD}'), ' ')), '{EDGES_OF_NAME}', '', 'g'), '(''s|'')$', '')"


def plausible(name: str) -> str:
    return rf"trim({name}) <> '' AND regexp_matches({name}, '\p{{L}}') AND NOT regexp_matches({name}, '[,;]') AND length({name}) <= 64 AND len(regexp_extract_all({name}, '{WORD}')) <= 6"


EDGES = f"""{NAMES}, ends AS (SELECT ws, hash, names[i] AS s, names[i + 1] AS t FROM named, range(1, len(names)) r(i)),
edges AS (SELECT DISTINCT ws, {key('s')} AS source, {key('t')} AS target, hash, 1.0::DOUBLE AS weight FROM ends WHERE {plausible('s')} AND {plausible('t')})"""
CLUSTERABLE = f"{EDGES}, {LIVE_CHUNKS}, clusterable AS (SELECT e.* FROM edges e SEMI JOIN live_chunks USING (ws, hash))"
PAIRS = f"{CLUSTERABLE}, pairs AS (SELECT ws, least(source, target) AS a, greatest(source, target) AS b, sum(weight) AS weight FROM clusterable GROUP BY ALL)"
NEIGHBOURS = f"""{CLUSTERABLE}, neighbours AS (SELECT ws, name, neighbour, sum(weight) AS weight FROM (SELECT ws, source AS name, target AS neighbour, weight FROM clusterable UNION ALL SELECT ws, target, source, weight FROM clusterable)
WHERE name <> neighbour GROUP BY ALL)"""
WALK = """both_ways AS (SELECT ws, source, target, hash, weight FROM clusterable UNION ALL SELECT ws, target, source, hash, weight FROM clusterable),
sd AS (SELECT ws, hash, min(rank) AS rank FROM seeds GROUP BY ALL),
w0 AS (SELECT ws, name, min(rank) AS rank FROM (SELECT c.ws, unnest([source, target]) AS name, rank FROM clusterable c JOIN sd USING (ws, hash)) GROUP BY ALL),
s1 AS (SELECT b.ws, b.target AS name, b.hash, rank, least(1.0, b.weight) AS width FROM w0 JOIN both_ways b ON b.ws = w0.ws AND b.source = w0.name),
w1 AS (SELECT ws, name, rank, max(width) AS width FROM s1 GROUP BY ALL),
s2 AS (SELECT b.ws, b.hash, rank, least(w1.width, b.weight) AS width FROM w1 JOIN both_ways b ON b.ws = w1.ws AND b.source = w1.name),
ev AS (SELECT ws, hash, 0 AS hops, 1 / (60.0::DOUBLE + rank) AS score FROM sd UNION ALL SELECT ws, hash, 1, 1 / (60.0::DOUBLE + rank) * 0.5::DOUBLE * width FROM s1 UNION ALL SELECT ws, hash, 2, 1 / (60.0::DOUBLE + rank) * 0.25::DOUBLE * width FROM s2),
walked AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY ws, hash ORDER BY score DESC, hops) = 1)"""
ACCESS = """acl AS (SELECT doc_id AS page_id, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 1 THEN 'read' END AS access FROM labels),
tree AS (SELECT p.page_id, coalesce(a.access, 'read') AS access FROM pg p LEFT JOIN acl a ON p.page_id = a.page_id WHERE p.parent_id IS NULL
UNION ALL SELECT p.page_id, coalesce(a.access, tree.access) FROM tree JOIN pg p ON p.parent_id = tree.page_id LEFT JOIN acl a ON a.page_id = p.page_id), readable AS (SELECT * FROM tree WHERE access <> 'none')"""
HITS = "hits AS (SELECT DISTINCT p.page_id, w.hash, w.hops, w.score FROM walked w JOIN pg p ON p.ws = w.ws AND p.hash = w.hash SEMI JOIN readable r ON p.page_id = r.page_id WHERE NOT p.archived)"
TRIGRAMS = r"list_distinct(flatten(list_transform(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i::INTEGER, 3)))))"
TITLES = f"{PAGES}, titled AS (SELECT page_id, title, {TRIGRAMS.format('title')} AS g, {TRIGRAMS.format("'the and'")} AS h FROM pg WHERE NOT archived)"
SIMILARITY = "CASE WHEN len(list_distinct(list_concat(g, h))) = 0 THEN 0 ELSE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) END"
RANK = f"CASE WHEN lower(title) = 'the and' THEN 1.0 WHEN starts_with(lower(title), 'the and') THEN 0.9 ELSE 0.8 * ({SIMILARITY}) END"
CANDIDATE = f"(contains(lower(title), 'the and') OR ({SIMILARITY}) >= 0.3)"
