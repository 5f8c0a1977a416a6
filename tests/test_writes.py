"""Tables written by key, the way from log to chunks, JSON from outside, extracted answers, and summaries' lives."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import wire
from quillgraph.operators import communities as cm
from quillgraph.operators import extraction as ex
from quillgraph.operators import ingest, materialise
from quillgraph.operators import summaries as su
from quillgraph.sources.store import Added, Folder, Keyed

ROW = "page_id long, block_index int, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_keys_are_replaced_whole_and_others_stay(spark, tmp_path):
    t = Keyed(spark, str(tmp_path / "t"), ROW, "page_id", buckets=3)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "page_id long")
    make = lambda *r: spark.createDataFrame(list(r), ROW)
    assert rows_of(t.read()) == []
    t.replace(keys(1, 2, 3, None), make((1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, None), (9, 0, "not in scope"), (None, 0, "no key")))
    want = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, None)]
    assert sorted(rows_of(t.read()), key=str) == sorted(want, key=str)
    for _ in range(2):  # twice is once
        t.replace(keys(1, 4), make((1, 0, "new"), (4, 0, "d")))
        assert sorted(rows_of(t.read()), key=str) == sorted([(1, 0, "new"), (2, 0, "c"), (3, 0, None), (4, 0, "d")], key=str)
    t.replace(keys(2, 5), make())
    t.replace(keys(), make((1, 0, "no scope")))
    assert sorted(rows_of(t.read()), key=str) == sorted([(1, 0, "new"), (3, 0, None), (4, 0, "d")], key=str)
    t.replace(keys(1, 3, 4), make())  # nothing is left in any bucket
    assert rows_of(t.read()) == []


def test_replacements_equal_a_plain_table(spark, tmp_path):
    r, t, plain = random.Random(2), Keyed(spark, str(tmp_path / "t"), ROW, "page_id", buckets=4), {}
    for _ in range(6):
        scope = r.sample(range(30), 8)
        rows = [(k, i, f"{r.random()}") for k in scope if r.random() < 0.7 for i in range(r.randint(1, 40 if k == 7 else 3))]
        t.replace(spark.createDataFrame([(k,) for k in scope], "page_id long"), spark.createDataFrame(rows, ROW))
        plain = {k: v for k, v in plain.items() if k not in scope}
        for row in rows:
            plain.setdefault(row[0], []).append(row)
        assert rows_of(t.read()) == sorted(x for v in plain.values() for x in v)


def test_a_writer_lost_between_its_two_steps_is_made_up_for(spark, tmp_path, monkeypatch):
    t = Keyed(spark, str(tmp_path / "t"), ROW, "page_id", buckets=2)
    first, second = (spark.createDataFrame([(k, 0, s) for k in range(6)], ROW) for s in ("old", "new"))
    t.replace(first, first)
    with monkeypatch.context() as m:
        m.setattr(Keyed, "_put", lambda self: None)  # the driver goes before the table is touched
        t.replace(second.where("page_id < 3"), second.where("page_id < 3"))
    assert Folder(spark, str(tmp_path / "t/stage")).complete()
    for path in list((tmp_path / "t/data").glob("bucket=0")):  # or in the middle of it
        for f in path.iterdir():
            f.unlink()
    again = Keyed(spark, str(tmp_path / "t"), ROW, "page_id", buckets=2)
    assert rows_of(again.read()) == [(k, 0, "new" if k < 3 else "old") for k in range(6)]
    assert not Folder(spark, str(tmp_path / "t/stage")).complete()


def test_known_keys_are_not_written_again(spark, tmp_path):
    t = Added(spark, str(tmp_path / "t"), "hash string, text string", "hash")
    make = lambda *r: spark.createDataFrame(list(r), "hash string, text string, more int")
    t.add(make(("a", "1", 0), ("b", "2", 0), ("b", "2", 1), (None, "x", 0)))
    t.add(make(("a", "other", 0), ("c", "3", 0)))
    t.add(make())
    assert rows_of(t.read()) == [("a", "1"), ("b", "2"), ("c", "3")]


LONG = "word " * 60 + "end."


def test_chunks_follow_their_blocks(spark, tmp_path):
    store = materialise.Store(spark, str(tmp_path / "s"))
    pages = lambda *ids: spark.createDataFrame([(i, "w", False) for i in ids], "page_id long, ws string, archived boolean")
    log = lambda *r: spark.createDataFrame(list(r), "page_id long, seq long, update string")
    texts = {1: f"short\n{LONG}\n\n{LONG}", 2: "one line", 3: ""}
    got = materialise.reproject(store, log((1, 1, "older"), (1, 2, texts[1]), (2, 5, texts[2]), (3, 1, texts[3]), (9, 1, "archived")), pages(1, 2, 3, 4))
    assert {r.page_id: (r.blocks, r.chunks) for r in got.collect()} == {p: (len([x for x in t.split("\n") if x]), len(ingest.chunks_of(t.split("\n")))) for p, t in texts.items()} | {4: (0, 0)}
    chunk = {(r.page_id, r.chunk_index): r.text for r in store.chunk_texts().collect()}
    assert chunk == {(p, i): c for p, t in texts.items() for i, c in enumerate(ingest.chunks_of(t.split("\n")))}
    assert sorted(r.block_index for r in store.blocks.read().where("page_id = 1").collect()) == [0, 1, 3]
    before = store.chunks.read().count()
    assert {r.page_id: r.chunks for r in materialise.reproject(store, log((1, 3, "")), pages(1)).collect()} == {1: 0}
    assert {r.page_id for r in store.page_chunks.read().collect()} == {2} and store.chunks.read().count() == before  # orphans stay
    again = materialise.reproject(store, log((1, 4, texts[1]), (2, 6, "one line")), pages(1, 2))
    assert {r.page_id: r.chunks for r in again.collect()} == {1: 2, 2: 1} and store.chunks.read().count() == before


BAD = [
    None, "", "nope", "[]", '"x"', "3", "{", "{} x", "{}] x", "{},{}", '{"id":NaN}', '{"a":1,"a":2}', '{"id":"1"}', '{"id":1,"parent_id":null,"rank":1}', '{"id":"1","rank":1}', '{"id":"1","parent_id":2,"rank":1}',
    '{"id":"1","parent_id":null,"rank":"1"}', '{"id":"1","parent_id":null,"rank":1e999}', '{"id":"1","parent_id":null,"rank":-1e999}', '{"id":"1","parent_id":null,"rank":null}', '{"id":null,"parent_id":null,"rank":1}',
    '{"id":["1"],"parent_id":null,"rank":1}',
]
GOOD = ['{"id":"1","parent_id":null,"rank":1}', ' {"id":"","parent_id":"é","rank":-0.5e3,"more":{"x":[1]}} ', '{"rank":12345678901234567890123,"parent_id":"]","id":"}"}']


def test_records_are_taken_whole_or_not_at_all(spark):
    fields = {"id": "string", "parent_id": "string|null", "rank": "number"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BAD + GOOD)], "k long, raw string")
    good, bad = wire.read(df, "raw", fields)
    assert sorted(r.k for r in bad.collect()) == list(range(len(BAD)))
    assert {r.raw: tuple(r.record) for r in good.collect()} == {GOOD[0]: ("1", None, 1.0), GOOD[1]: ("", "é", -500.0), GOOD[2]: ("}", "]", 1.2345678901234568e22)}
    faults = {r.raw: r.fault for r in bad.collect()}
    assert faults["nope"] == faults["{} x"] == faults["{}] x"] == "not JSON" and faults["[]"] == "not an object" and faults[BAD[-1]] == "id: no string" and faults[BAD[17]] == "rank: no number"
    with pytest.raises(ValueError):
        wire.has(F.col("x"), "id", "date")


def test_lists_are_refused_for_one_bad_item(spark):
    hit = '{"page_id":"1","title":"t","rank":0.5}'
    df = spark.createDataFrame([(f"[{hit},{hit}]",), ("[]",), (f'[{hit},{{"page_id":"1"}}]',), (hit,), ("[1]",)], "raw string")
    got = df.select(wire.accepts_list(wire.parsed(F.col("raw")), wire.RECORDS["quick_hit"]).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False]


ANSWERS = {
    '{"entities":[{"name":" Ann Lee ","entity_type":" PERSON ","description":"  "},{"name":"","entity_type":"X"},{"name":"a, b","entity_type":"X"}],"edges":[{"source":"Ann Lee","target":" Bob","relation":" knows ","weight":7},{"source":"?!","target":"Bob","relation":"r","weight":1}]}': (
        [("Ann Lee", "PERSON", None)], [("Ann Lee", "Bob", "knows", 1.0)]),
    '{"entities":[{"name":"X","entity_type":"T","description":" d "}],"other":1}': ([("X", "T", " d ")], []),
    "{}": ([], []),
    '{"edges":[{"source":"A","target":"B","relation":"r","weight":-3}]}': ([], [("A", "B", "r", 0.0)]),
    '{"entities":null}': None, '{"entities":{}}': None, '{"entities":[1]}': None, '{"entities":[{"name":"A"}]}': None, '{"entities":[{"name":"A","entity_type":1}]}': None,
    '{"entities":[{"name":"A","entity_type":"T","description":5}]}': None, '{"edges":[{"source":"A","target":"B","relation":"r"}]}': None, '{"edges":[{"source":"A","target":"B","relation":"r","weight":"1"}]}': None,
    '{"edges":[{"source":"A","target":"B","relation":"r","weight":1e999}]}': None, '{"edges":[{"source":"A","target":"B","relation":"r","weight":NaN}]}': None, "Sure! {}": None, "{} there you are": None,
}


def test_answers_are_cleaned_or_refused(spark):
    df = spark.createDataFrame([(k,) for k in ANSWERS], "raw string")
    good, bad = wire.extractions(df, "raw")
    assert {r.raw: ([tuple(e) for e in r.entities], [tuple(e) for e in r.edges]) for r in good.collect()} == {k: v for k, v in ANSWERS.items() if v is not None}
    assert {r.raw for r in bad.collect()} == {k for k, v in ANSWERS.items() if v is None}


ENTITY, EDGE = "name string, entity_type string, description string", "source string, target string, relation string, weight double"
ANSWER = f"ws string, hash string, model string, seq long, entities array<struct<{ENTITY}>>, edges array<struct<{EDGE}>>"


def one_by_one(entities, edges, answers):
    """Each answer over the store that the ones before it left."""
    norm = lambda n: " ".join(n.split()).lower()
    entities, edges, affected, counts = dict(entities), dict(edges), {}, {}

    def resolve(ws, name, kind, text):
        old = entities.get((ws, name))
        entities[ws, name] = (kind or (old[0] if old else "CONCEPT"), text if text is not None else old[1] if old else None)

    for ws, h, model, seq, named, linked in sorted(answers, key=lambda a: a[3]):
        for name, kind, text in named:
            resolve(ws, norm(name), kind, text)
        for k in [k for k in edges if (k[0], k[4], k[5]) == (ws, h, model)]:
            del edges[k]
        touched = {}
        for a, b, relation, w in linked:
            for end in (norm(a), norm(b)):
                if (ws, end) not in entities:
                    resolve(ws, end, None, None)
                touched[end] = True
            edges[ws, norm(a), norm(b), relation, h, model] = w
        affected[ws, h, model, seq], counts[ws, h, model, seq] = list(touched), len(linked)
    return entities, edges, affected, counts


def test_a_change_set_equals_answers_one_by_one(spark):
    r = random.Random(8)
    names = ["Ann", "Bob Lee", "bob  lee", "Cy", "Dee", "Eve"]
    answers = []
    for seq in range(40):
        named = [(n, r.choice(["PERSON", "ORG"]), r.choice([None, f"d{seq}"])) for n in r.sample(names, r.randrange(4))]
        linked = [(r.choice(names), r.choice(names), r.choice("rs"), r.random()) for _ in range(r.randrange(5))]
        answers.append((r.choice("pq"), r.choice(["h1", "h2", "h3"]), r.choice(["m", "n"]), seq, named, linked))
    known = {("p", "ann"): ("PLACE", "first"), ("p", "zoe"): ("PERSON", None)}
    old = {("p", "ann", "zoe", "r", "h1", "m"): 0.5, ("p", "ann", "zoe", "r", "h9", "m"): 0.5, ("q", "x", "y", "r", "h1", "zz"): 0.1}
    e = spark.createDataFrame([(*k, *v) for k, v in known.items()], "ws string, name string, entity_type string, description string")
    g = spark.createDataFrame([(*k, w) for k, w in old.items()], "ws string, source string, target string, relation string, hash string, model string, weight double")
    got = ex.applied(e, g, spark.createDataFrame(answers, ANSWER))
    entities, edges, affected, counts = one_by_one(known, old, answers)
    assert {(x.ws, x.name): (x.entity_type, x.description) for x in got.entities.collect()} == entities
    assert {(x.ws, x.source, x.target, x.relation, x.hash, x.model): x.weight for x in got.edges.collect()} == edges
    touched = defaultdict(dict)
    for x in got.affected.collect():
        touched[x.ws, x.hash, x.model, x.seq][x.place] = x.name
    assert {k: [v[i] for i in range(len(v))] for k, v in touched.items()} == {k: v for k, v in affected.items() if v}
    assert {(x.ws, x.hash, x.model, x.seq): x.edges for x in got.counts.collect()} == counts


MEMBER = "ws string, name string, community int"


def moody(name="moody"):
    class Moody(su.Summariser):
        model_id = name

        def summarise(self, names, members):
            if "boom" in names:
                raise RuntimeError("no")
            return "  \n" if "blank" in names else f"{members}: {names[0]}"

    return Moody()


def setting(spark, communities):
    m = spark.createDataFrame([("w", n, c) for c, names in communities.items() for n in names], MEMBER)
    return cm.member_hashes(m), m


def state_of(df):
    return {r.community: (r.summary, r.state) for r in df.collect()}


def test_summaries_from_state_to_state(spark):
    big = [f"n{i:02}" for i in range(20)]
    small = {1: ["a", "b"], 2: big, 3: ["boom"], 4: ["blank", "c"]}
    c, m = setting(spark, small)
    first = su.run_once(c, m, spark.createDataFrame([], su.SUMMARIES), moody())
    assert state_of(first.summaries) == {1: ("2: a", "valid"), 2: ("20: n00", "valid")} and tuple(first.counts.first()) == (0, 2, 2)
    quiet = su.run_once(c, m, first.summaries, moody())
    assert state_of(quiet.summaries) == state_of(first.summaries) and tuple(quiet.counts.first()) == (0, 0, 2)  # only what failed is tried again

    c, m = setting(spark, small | {1: ["a", "b", "z"], 2: [*big, "more"]})
    later = su.run_once(c, m, first.summaries, moody())
    assert state_of(later.summaries) == {1: ("3: a", "valid"), 2: ("20: n00", "stale_usable")} and tuple(later.counts.first()) == (1, 1, 2)
    again = su.run_once(c, m, later.summaries, moody())
    assert state_of(again.summaries) == state_of(later.summaries) and tuple(again.counts.first()) == (1, 0, 2)

    asked = spark.createDataFrame([("w", 2), ("w", 1), ("w", 3)], "ws string, community int")
    fresh = su.refresh(c, m, later.summaries, asked, moody())
    assert state_of(fresh) == {1: ("3: a", "valid"), 2: ("21: more", "valid")}
    assert su.refresh(c, m, fresh, asked.where("community < 3"), moody()).exceptAll(fresh).count() == 0  # current: no model is asked

    changed = su.run_once(c, m, fresh, moody("other"))  # another model: large or not, it is written at once
    assert {r.community: r.model for r in changed.summaries.collect()} == {1: "other", 2: "other"} and tuple(changed.counts.first()) == (0, 2, 2)
    assert cm.summary_progress(c, changed.summaries, "other").first().asDict() == {"done": 2, "total": 4}


def test_a_failure_keeps_the_summary_there_was(spark):
    c, m = setting(spark, {1: ["boom", "x"]})
    old = spark.createDataFrame([("w", 1, "moody", "of old", "valid", "hash of others", None)], su.SUMMARIES)
    got = su.run_once(c, m, old, moody())
    assert state_of(got.summaries) == {1: ("of old", "valid")} and tuple(got.counts.first()) == (0, 0, 1)


def test_themes_and_what_was_not_read(spark):
    c = spark.createDataFrame([("w", i, n) for i, n in enumerate([5, 9, 5, 2, 1])] + [("v", 0, 1)], "ws string, community int, n_members long")
    s = [("w", 0, "m", "a", "valid", "h", "2026-01-01"), ("w", 1, "m", "b", "valid", "h", "2026-01-02"), ("w", 2, "m", "c", "stale_usable", "h", "2026-01-03"), ("w", 3, "m", "d", "valid", "h", "2026-01-04"), ("w", 4, "old", "e", "valid", "h", "2026-01-05")]
    s = spark.createDataFrame([(*x[:-1],) for x in s], "ws string, community int, model string, summary string, state string, member_hash string").withColumn("created_at", F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, community)"))
    top, skipped = su.for_search(c, s, "m", 3)
    assert {r.community for r in top.collect()} == {0, 1, 2}
    assert {r.ws: r.skipped for r in skipped.collect()} == {"w": 1, "v": 1}
    vectors = spark.createDataFrame([("w", 0, 0.9, "x"), ("w", 3, 0.1, None), ("w", 1, 0.5, None), ("w", 4, 0.0, None)], "ws string, community int, d double, summary_hash string")
    top, skipped = su.by_similarity(c, s, vectors, F.col("d"), "m", 2)
    assert {r.community: r.distance for r in top.collect()} == {3: 0.1, 1: 0.5} and {r.ws: r.skipped for r in skipped.collect()} == {"w": 2, "v": 1}


def test_workspaces_wait_by_age(spark):
    c = spark.createDataFrame([("a", 1, 30), ("b", 1, 10), ("c", 1, 20), ("d", 1, 5)], "ws string, community int, created_at long")
    s = spark.createDataFrame([(w, 1, "m", w) for w in "abcd"], "ws string, community int, model string, summary string")
    v = spark.createDataFrame([("d", 1, "d"), ("c", 1, "was")], "ws string, community int, summary string").select("ws", "community", F.md5("summary").alias("summary_hash"))
    assert [r.ws for r in su.workspaces_to_embed(c, s, v, "m", 2).collect()] == ["b", "c"]
    assert [r.ws for r in su.workspaces_to_embed(c, s, v, "other", 2).collect()] == []


def test_answers_are_taken_and_refused_item_by_item_and_read_once(spark, sf):
    from quillgraph import catalogue_live as cl
    from quillgraph.functions import wire

    e, bare = '{"name":"Ann","entity_type":"P","description":" x "}', '{"name":"Bob","entity_type":"P"}'
    edge = lambda w: f'{{"source":"Ann","target":"Bob","relation":"r","weight":{w}}}'
    raw = {
        f'{{"entities":[{e},{bare}],"edges":[{edge(1)},{edge(0.25)}]}}': (2, [1.0, 0.25]), f'{{"entities":[{bare}],"edges":[{edge(7)}]}}': (1, [1.0]), '{}': (0, []), '{"entities":[],"edges":[]}': (0, []),
        f'{{"entities":[{e},{{"name":"Cy"}}]}}': None, f'{{"entities":[{e},{{"name":null,"entity_type":"P"}}]}}': None, f'{{"entities":[{e},null]}}': None, f'{{"entities":[{e},5]}}': None, f'{{"entities":[{bare},{{"name":5,"entity_type":"P"}}]}}': None,
        f'{{"entities":[{bare},{{"name":"Cy","entity_type":"P","description":null,"more":[1]}}]}}': (2, []), f'{{"edges":[{edge(1)},{edge("null")}]}}': None, f'{{"edges":[{edge(1)},{edge(chr(34) + "1" + chr(34))}]}}': None, f'{{"edges":[{edge(1)},{edge("1e999")}]}}': None, f'{{"edges":{edge(1)}}}': None,
    }
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    good, bad = wire.extractions(df, "raw")
    assert {r.raw: (len(r.entities), [x.weight for x in r.edges]) for r in good.collect()} == {x: want for x, want in raw.items() if want is not None}
    assert {r.raw for r in bad.collect()} == {x for x, want in raw.items() if want is None}
    assert "parse_json" not in cl.extraction_changes(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
