"""Queries of streams with state, of tables written by key, of JSON from outside and of summaries' lives, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.catalogue import HASHES, LABELLED, _by_length, _clusterable, query
from quillgraph.functions import wire
from quillgraph.operators import collections as co
from quillgraph.operators import communities as cm
from quillgraph.operators import extraction, materialise
from quillgraph.operators import graph as gr
from quillgraph.operators import summaries as su
from quillgraph.plans import oracle as o
from quillgraph.plans.settle import settled, shared_folder, written
from quillgraph.sources import tables as t
from quillgraph.sources.store import Keyed
from quillgraph.streaming import hub, log, partition


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


QUIET_MS = 6 * 3_600_000
SESSIONS = """e AS (SELECT user_id AS page_id, 's' || (event_id % 3) AS session, CASE event_type WHEN 'signup' THEN 'attach' WHEN 'error' THEN 'detach' ELSE 'update' END AS kind, epoch_us(ts) // 1000 AS at_ms, event_id AS place FROM events),
ups AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY at_ms, place) AS seq FROM e WHERE kind = 'update'),
steps AS (SELECT *, lag(kind) OVER w AS prev FROM e WINDOW w AS (PARTITION BY page_id, session ORDER BY at_ms, place)),
next AS (SELECT *, lead(kind) OVER w AS nk, lead(at_ms) OVER w AS na, lead(place) OVER w AS np FROM e WHERE kind <> 'attach' WINDOW w AS (PARTITION BY page_id, session ORDER BY at_ms, place)),
ends AS (SELECT *, sum(CASE kind WHEN 'detach' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY at_ms, place) AS open FROM steps WHERE CASE kind WHEN 'detach' THEN prev IS NOT NULL AND prev <> 'detach' ELSE prev IS NULL OR prev = 'detach' END)"""


@query(f"""WITH {SESSIONS}, told AS (SELECT page_id, 'quiet' AS kind, at_ms + {QUIET_MS} AS at_ms, -1 AS place, session FROM next WHERE kind = 'update' AND (nk IS NULL OR na >= at_ms + {QUIET_MS}) AND at_ms + {QUIET_MS} <= (SELECT max(at_ms) FROM e)
UNION ALL SELECT page_id, 'left', na, np, session FROM next WHERE kind = 'update' AND nk = 'detach' AND na < at_ms + {QUIET_MS}
UNION ALL SELECT page_id, CASE kind WHEN 'detach' THEN 'closed' ELSE 'opened' END, at_ms, place, session FROM ends WHERE open = CASE kind WHEN 'detach' THEN 0 ELSE 1 END)
SELECT page_id, kind, at_ms, session, (SELECT count(*) FROM ups u WHERE u.page_id = told.page_id AND (u.at_ms < told.at_ms OR u.at_ms = told.at_ms AND u.place < told.place)) AS seq FROM told
UNION ALL SELECT page_id, 'update', at_ms, session, seq FROM ups""")
def page_hubs(s, d):
    """Sessions over the events, ten days at a time: each part is a new query that goes on from the state of the last."""
    e = t.table(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "attach").when(F.col("event_type") == "error", "detach").otherwise("update")
    e = e.select(F.col("user_id").alias("page_id"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("session"), kind.alias("kind"), F.col("props").alias("update"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"))
    folder, third = _folder(s, "hubs"), F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for k in range(3):
        e.where(third == k).write.mode("append").parquet(f"{folder}/events")
        hub.kept(hub.hubs(log.read(s, f"{folder}/events", e.schema, 1_000), QUIET_MS, None, "0 seconds"), f"{folder}/out", f"{folder}/state")
    return s.read.schema(hub.OUTPUT).parquet(f"{folder}/out/batch=*").select("page_id", "kind", F.col("at").alias("at_ms"), "session", "seq")


PARTS = ("5", "a")


@query(f"""WITH RECURSIVE {o.CLUSTERABLE}, parts AS (SELECT *, CASE WHEN hash < '{PARTS[0]}' THEN 0 WHEN hash < '{PARTS[1]}' THEN 1 ELSE 2 END AS b FROM clusterable), c AS (SELECT ws, b, count(*) AS changed FROM parts GROUP BY ALL),
first AS (SELECT ws, least(source, target) AS x, greatest(source, target) AS y, min(b) AS b FROM parts GROUP BY ALL), e AS (SELECT ws, k.b, count(*) AS edges FROM first JOIN range(3) k(b) ON first.b <= k.b GROUP BY ALL),
st AS (SELECT DISTINCT ws, -1::BIGINT AS b, 0::BIGINT AS changed, NULL::BIGINT AS run FROM c UNION ALL
SELECT st.ws, st.b + 1, CASE WHEN c.changed IS NULL THEN st.changed WHEN st.changed + c.changed >= ceil(edges * 0.5) THEN 0 ELSE st.changed + c.changed END, CASE WHEN st.changed + c.changed >= ceil(edges * 0.5) THEN st.b + 1 ELSE st.run END
FROM st LEFT JOIN c ON c.ws = st.ws AND c.b = st.b + 1 LEFT JOIN e ON e.ws = st.ws AND e.b = st.b + 1 WHERE st.b < 2) SELECT ws, changed, run FROM st WHERE b = 2""")
def stream_communities(s, d):
    """Three batches of changed edges, each a restart: what is owed to the next full run, and the batch of the last."""
    folder, sink = _communities(s, d)
    return partition.churn(s, folder).join(partition.last_runs(s, folder).select("ws", "run"), "ws", "left").select("ws", "changed", "run")


def _communities(s: SparkSession, d: str) -> tuple[str, partition.Communities]:
    folder = _folder(s, "communities")
    edges = written(_clusterable(s, d).withColumn("place", F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")))
    sink = partition.Communities(f"{folder}/kept", lambda spark, n: spark.read.schema(edges.schema).parquet(f"{folder}/edges"), 0.5)
    h = F.col("hash")
    for part in (h < PARTS[0], (h >= PARTS[0]) & (h < PARTS[1]), h >= PARTS[1]):
        edges.where(part).write.mode("append").parquet(f"{folder}/edges")
        partition.followed(log.read(s, f"{folder}/edges", edges.schema, 10_000), sink, f"{folder}/state")
    return f"{folder}/kept", sink


@query()
def stream_members(s, d):
    """Who is in which community after these batches."""
    return partition.members(s, _communities(s, d)[0])


@query(f"WITH {o.PAGES}, {o.BLOCKS} SELECT page_id, block_index, sha256('paragraph' || chr(31) || text || CASE WHEN page_id % 10 = 0 THEN '!' ELSE '' END) AS hash FROM bl WHERE page_id % 10 <> 5")
def replaced_blocks(s, d):
    """All pages' blocks, then those of every fifth page twice in place of the first: of half of these there are none any more."""
    b = t.blocks(t.pages(s, d)).select("page_id", "block_index", "kind", "text", "hash")
    table = Keyed(s, _folder(s, "blocks"), "page_id long, block_index int, kind string, text string, hash string", "page_id")
    table.replace(b, b)
    scope = t.pages(s, d).where(F.col("page_id") % 5 == 0)
    text = F.concat("text", F.lit("!"))
    new = b.where(F.col("page_id") % 10 == 0).select("page_id", "block_index", "kind", text.alias("text"), F.sha2(F.concat("kind", F.lit("\x1f"), text), 256).alias("hash"))
    for _ in range(2):
        table.replace(scope, new)
    return table.read().select("page_id", "block_index", "hash")


LETTER = r"\p{L}"


@query(f"""WITH {o.PAGES}, lg AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN text || chr(10) || 'a last line' ELSE text END AS text FROM pg WHERE NOT archived AND page_id % 11 <> 0), n AS (SELECT page_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS blocks, len(regexp_extract_all(text, '{LETTER}')) AS letters FROM lg)
SELECT page_id, coalesce(blocks, 0) AS blocks, coalesce(letters, 0) AS letters FROM pg LEFT JOIN n USING (page_id) WHERE NOT archived""")
def reprojected_pages(s, d):
    """Live pages from a log of their texts, some with a second update and some without any: blocks, and letters of the chunks."""
    p = t.pages(s, d)
    first = p.where(F.col("page_id") % 11 != 0).select("page_id", F.lit(1).alias("seq"), F.col("text").alias("update"))
    second = first.where(F.col("page_id") % 3 == 0).select("page_id", F.lit(2).alias("seq"), F.concat("update", F.lit("\na last line")).alias("update"))
    store = materialise.Store(s, _folder(s, "store"))
    done = materialise.reproject(store, first.unionByName(second), p.select("page_id", "ws", "archived"))
    letters = store.chunk_texts().groupBy("page_id").agg(F.sum(F.regexp_count("text", F.lit(LETTER))).alias("letters"))
    return done.join(letters, "page_id", "left").select("page_id", "blocks", F.coalesce("letters", F.lit(0)).cast("long").alias("letters"))


@query("""SELECT doc_id AS page_id, CASE doc_id % 7 WHEN 1 THEN 'title: no string' WHEN 2 THEN 'page_id: no string' WHEN 3 THEN 'not JSON' WHEN 4 THEN 'score: no number' WHEN 5 THEN 'not an object' END AS fault,
CASE WHEN doc_id % 7 IN (0, 6) THEN n_chars::DOUBLE END AS score, CASE WHEN doc_id % 7 IN (0, 6) THEN source END AS title FROM documents""")
def wire_hits(s, d):
    """Search hits as JSON, five of seven kinds of them broken, told apart and read."""
    doc = t.table(s, d, "documents")
    whole = {"page_id": F.col("doc_id").cast("string"), "title": F.col("source"), "snippet": F.substring("text", 1, 40), "score": F.col("n_chars"), "more": F.array(F.lit(1))}
    made = lambda **other: F.to_json(F.struct(*[c.alias(n) for n, c in (whole | other).items()]))
    k = F.col("doc_id") % 7
    raw = F.when(k == 1, made(title=F.lit(5))).when(k == 2, made(page_id=F.col("doc_id"))).when(k == 3, F.concat(made(), F.lit(" and more")))
    raw = raw.when(k == 4, F.replace(made(score=F.lit("@")), F.lit('"@"'), F.lit("1e999"))).when(k == 5, F.concat(F.lit("["), made(), F.lit("]"))).otherwise(made())
    good, bad = wire.read(doc.select(F.col("doc_id").alias("page_id"), raw.alias("raw")), "raw", wire.RECORDS["search_hit"])
    kept = good.select("page_id", F.lit(None).cast("string").alias("fault"), "record.score", "record.title")
    return kept.unionByName(bad.select("page_id", "fault"), allowMissingColumns=True)


def _answers(s: SparkSession, d: str) -> DataFrame:
    """A model's answer as JSON for each chunk: capitalised words, each linked with the next; one in sixteen is cut off."""
    names = gr.extracted(t.pages(s, d)).where(F.size("names") >= 2).dropDuplicates(["ws", "hash"])
    entities = F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("CONCEPT").alias("entity_type")))
    ends = lambda i: F.struct(F.get("names", i - 1).alias("source"), F.get("names", i).alias("target"), F.lit("mentions_with").alias("relation"), (i % 3).alias("weight"))
    raw = F.to_json(F.struct(entities.alias("entities"), F.transform(F.sequence(F.lit(1), F.size("names") - 1), ends).alias("edges")))
    raw = F.when(F.substring("hash", 1, 1) == "0", F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    return names.withColumn("raw", F.to_json(F.struct(entities.alias("entities"), F.transform(F.sequence(F.lit(1), F.size("names") - 1), ends).alias("edges")))).select("ws", "hash", F.lit("stub").alias("model"), F.lit(0).alias("seq"), raw.alias("raw"))


LINKED = f"""linked AS (SELECT ws, hash, i, {o.key("names[i]")} AS s, {o.key("names[i + 1]")} AS t, least(1, i % 3)::DOUBLE AS weight FROM named, range(1, len(names)) r(i) WHERE hash[1:1] <> '0' AND {o.plausible("names[i]")} AND {o.plausible("names[i + 1]")})"""


@query(f"""WITH {o.NAMES}, {LINKED}, n AS (SELECT ws, hash, count(*) AS edges FROM linked GROUP BY ALL), ends AS (SELECT ws, hash, name, min(p) AS p FROM (SELECT ws, hash, unnest([s, t]) AS name, unnest([2 * i, 2 * i + 1]) AS p FROM linked) GROUP BY ALL),
a AS (SELECT ws, hash, count(*) AS touched, sha256(string_agg(name, chr(31) ORDER BY p)) AS touched_hash FROM ends GROUP BY ALL)
SELECT ws, hash, coalesce(edges, 0) AS edges, coalesce(touched, 0) AS touched, touched_hash FROM (SELECT ws, hash FROM named WHERE len(names) >= 2 AND hash[1:1] <> '0') LEFT JOIN n USING (ws, hash) LEFT JOIN a USING (ws, hash)""")
def extraction_changes(s, d):
    """What each answer that can be read writes and touches."""
    x = _applied(s, d)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda e: e["name"])
    a = x.affected.groupBy("ws", "hash").agg(F.count(F.lit(1)).alias("touched"), F.sha2(F.array_join(names, "\x1f"), 256).alias("touched_hash"))
    return x.counts.select("ws", "hash", "edges").join(a, ["ws", "hash"], "left").select("ws", "hash", "edges", F.coalesce("touched", F.lit(0)).cast("long").alias("touched"), "touched_hash")


def _applied(s: SparkSession, d: str) -> extraction.ChangeSet:
    # few bytes and much work a row: dealt to all cores, and read as JSON once for all that is made of it
    answers = _answers(s, d).repartition(max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions"))), "hash")
    good = written(wire.extractions(answers, "raw")[0])
    none = s.createDataFrame([], "ws string, name string, entity_type string, description string")
    edges = s.createDataFrame([], "ws string, source string, target string, relation string, hash string, model string, weight double")
    return extraction.applied(none, edges, good)


@query(f"WITH {o.NAMES}, {LINKED} SELECT ws, s AS source, t AS target, hash, arg_max(weight, i) AS weight FROM linked GROUP BY ALL")
def extraction_edges(s, d):
    """The graph after these answers."""
    return _applied(s, d).edges.select("ws", "source", "target", "hash", "weight")


class _Stub(su.StubSummariser):
    model_id = "stub"


def _summaries(c: DataFrame) -> DataFrame:
    """Of the second community a valid summary, of the first one of members that it had."""
    old = c.where(F.col("community").isin(1, 2))
    made = F.expr("timestamp '2026-01-01'")
    return old.select("ws", "community", F.lit("stub").alias("model"), F.lit("as it was").alias("summary"), F.lit("valid").alias("state"), F.when(F.col("community") == 2, F.col("member_hash")).otherwise("old").alias("member_hash"), made.alias("created_at"))


@query(f"""WITH {o.CLUSTERABLE}, {LABELLED}, {HASHES}, k AS (SELECT *, row_number() OVER (PARTITION BY ws, community ORDER BY name) AS k FROM m), five AS (SELECT ws, community, string_agg(name, ', ' ORDER BY k) AS names FROM k WHERE k <= 5 GROUP BY ALL)
SELECT ws, community, CASE WHEN community = 2 OR community = 1 AND n_members >= 20 THEN 'as it was' ELSE n_members || ' entities: ' || names END AS summary, CASE WHEN community = 1 AND n_members >= 20 THEN 'stale_usable' ELSE 'valid' END AS state FROM h JOIN five USING (ws, community)""")
def summary_pass(s, d):
    """One pass of the summariser: what is missing or small is written, what is large and behind is marked."""
    members = settled(_by_length(s, d))
    c = settled(cm.member_hashes(members))
    return su.run_once(c, members, _summaries(c), _Stub()).summaries.select("ws", "community", "summary", "state")


@query(f"""WITH {o.CLUSTERABLE}, {LABELLED}, {HASHES}, r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n_members DESC, community) AS k, count(*) FILTER (community % 2 = 1) OVER (PARTITION BY ws) AS skipped FROM h)
SELECT ws, community, n_members, skipped FROM (SELECT ws, community, n_members, skipped, row_number() OVER (PARTITION BY ws ORDER BY n_members DESC, community) AS place FROM r WHERE community % 2 = 0) WHERE place <= 2""")
def themes_for_search(s, d):
    """The two largest communities with a summary of each workspace, and how many have none."""
    c = settled(cm.member_hashes(_by_length(s, d)))
    have = c.where(F.col("community") % 2 == 0).select("ws", "community", F.lit("stub").alias("model"), F.lit("x").alias("summary"), F.lit("valid").alias("state"), F.lit(0).alias("created_at"))
    top, skipped = su.for_search(c, have, "stub", 2)
    return top.join(skipped, "ws").select("ws", "community", "n_members", "skipped")


@query(f"""WITH {o.CLUSTERABLE}, {LABELLED}, {HASHES} SELECT ws, min(n_members) AS oldest FROM h WHERE NOT (community % 2 = 0 OR n_members % 3 > 0) GROUP BY ws ORDER BY oldest, ws LIMIT 3""")
def workspaces_to_embed(s, d):
    """The first workspaces with a summary that has no vector, or one of another text. A community's size stands for its age."""
    c = settled(cm.member_hashes(_by_length(s, d))).withColumn("created_at", F.col("n_members"))
    text = F.concat_ws(" ", "member_hash", "community")
    have = c.select("ws", "community", F.lit("stub").alias("model"), text.alias("summary"))
    done = c.where((F.col("community") % 2 == 0) | (F.col("n_members") % 3 > 0) | (F.col("community") == 3))
    done = done.select("ws", "community", F.when((F.col("community") == 3) & (F.col("n_members") % 3 == 0), F.lit("of another text")).otherwise(F.md5(text)).alias("summary_hash"))
    return su.workspaces_to_embed(c, have, done, "stub", 3)


@query("SELECT p_brand AS ws, count(*) AS edges FROM (SELECT p_brand, p_size, unnest(string_split(p_type, ' ')) FROM part) WHERE p_size > 3 GROUP BY p_brand")
def property_edge_counts(s, d):
    """Edges of the parts' types by brand, small parts being archived."""
    p = t.table(s, d, "part").select(F.col("p_brand").alias("ws"), F.col("p_partkey").alias("page_id"), (F.col("p_size") <= 3).alias("archived"), "p_type")
    return co.property_edge_counts(p.select("ws", "page_id", F.explode(F.split("p_type", " ")).alias("target")), p)


@query(f"""WITH {o.CLUSTERABLE}, ent AS (SELECT DISTINCT ws, {o.key('name')} AS name FROM (SELECT ws, unnest(names) AS name FROM named) WHERE {o.plausible('name')}), used AS (SELECT DISTINCT ws, unnest([source, target]) AS name FROM clusterable)
SELECT (SELECT count(*) FROM edges ANTI JOIN live_chunks USING (ws, hash)) AS edges, (SELECT count(*) FROM ent ANTI JOIN used USING (ws, name)) AS entities""")
def reap_counts(s, d):
    p = t.pages(s, d)
    return gr.reap_counts(gr.edges(p), gr.entities(p), p)
