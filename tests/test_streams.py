"""Keyed state of pages, and communities kept up over a stream: restarts, replays, a clock set by hand."""

import random
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import communities, graph
from quillgraph.streaming import hub, partition

KINDS = ("attach", "update", "detach")


def played(events, delay, idle):
    page = hub.Page({}, 0, delay, idle)
    for kind, name, at in events:
        page.event(kind, name, None, at)
    page.until(10**9)
    return page


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.sampled_from("abc"), st.integers(0, 9)), max_size=40), st.sampled_from([None, 25]))
def test_each_quiet_period_projects_once(steps, idle):
    at, events = 0, []
    for kind, name, wait in steps:
        at += wait
        events.append((kind, name, at))
    page = played(events, 5, idle)
    out = page.out
    edits = [(name, t) for kind, name, t in events if kind == "update"]
    assert [o[2] for o in out if o[0] == "update"] == list(range(1, len(edits) + 1)) and page.seq == len(edits)
    for name in "abc":
        projected = [(o[0], o[1]) for o in out if o[0] in ("quiet", "left") and o[3] == name]
        mine = [t for n, t in edits if n == name]
        for k, t in projected:
            last = max(x for x in mine if x < t or k == "left" and x == t)
            assert (t == last + 5) if k == "quiet" else (t < last + 5)
        # after each burst one projection, and between two of them an edit
        times = [t for _, t in projected]
        assert all(any(a <= x <= b for x in mine) for a, b in zip(times, times[1:], strict=False))
        assert bool(mine) <= bool(times) and (not mine or times[-1] >= mine[-1])
    states = [o[0] for o in out if o[0] in ("opened", "closed")]
    assert states == ["opened", "closed"] * (len(states) // 2) + ["opened"] * (len(states) % 2)
    assert not page.sessions if idle else len(states) % 2 == bool(page.sessions)


class Handle:
    """State and timers of one key, as the processor sees them."""

    def __init__(self):
        self.map, self.value, self.timers = {}, None, set()

    def getMapState(self, *_):
        return SimpleNamespace(iterator=lambda: iter(list(self.map.items())), updateValue=self.map.__setitem__, removeKey=self.map.pop)

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Clock:
    def __init__(self, delay=400, idle=None):
        self.handle, self.now, self.hub = Handle(), 0, hub.Hubs(delay, idle)
        self.hub.init(self.handle)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def rows(self, *events):
        got = self.hub.handleInputRows((1,), iter([{"kind": k, "session": s, "update": k, "at": 0, "place": i} for i, (k, s) in enumerate(events)]), self)
        return [(r["kind"], r["at"], r["seq"]) for r in got]

    def to(self, now):
        out = []
        while self.handle.timers and min(self.handle.timers) <= now:
            self.now = min(self.handle.timers)
            self.handle.timers.remove(self.now)
            expired = SimpleNamespace(getExpiryTimeInMs=lambda: self.now)
            out += [(r["kind"], r["at"], r["seq"]) for r in self.hub.handleExpiredTimer((1,), self, expired)]
        self.now = now
        return out


def test_a_burst_projects_when_it_settles_by_a_clock_set_by_hand():
    c = Clock()
    c.to(1000)
    assert c.rows(("attach", "a"), ("update", "a")) == [("opened", 1000, 0), ("update", 1000, 1)]
    for now in (1300, 1600, 1900):
        assert c.to(now) == []
        c.rows(("update", "a"))
    assert c.to(2299) == [] and c.to(2300) == [("quiet", 2300, 4)] and c.to(9000) == [] and not c.handle.timers
    c.rows(("update", "a"))
    assert c.rows(("detach", "a")) == [("left", 9000, 5), ("closed", 9000, 5)]  # an edit is never left behind
    assert c.handle.map == {} and c.handle.value == (5,) and not c.handle.timers


def test_sessions_owe_for_themselves_and_silent_ones_end():
    c = Clock(400, 5000)
    c.rows(("attach", "a"), ("attach", "b"), ("update", "a"))
    c.to(100)
    c.rows(("update", "b"), ("detach", "b"))
    assert set(c.handle.map) == {("a",)} and c.to(400) == [("quiet", 400, 2)]
    assert c.to(4999) == [] and c.to(5000) == [("closed", 5000, 2)] and c.handle.map == {} and not c.handle.timers


def made_events(seed, n):
    r = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += r.choice([10, 100, 300, 700])
        rows.append((r.randrange(4), r.choice("xyz"), r.choice((*KINDS, "update")), f"u{i}", t, i))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, session string, kind string, update string, ms long, place long")
    return df.withColumn("ts", F.timestamp_millis("ms")).select("page_id", "session", "kind", "update", "ts", "place").coalesce(1)


def test_state_outlives_restarts_and_equals_a_fold_of_the_log(spark, tmp_path):
    rows = made_events(7, 240)
    events, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    for part in (rows[:80], rows[80:81], rows[81:]):  # a new query each time, from the checkpoint of the last
        frame(spark, part).write.mode("append").parquet(events)
        hub.kept(hub.hubs(spark.readStream.schema(hub.EVENTS).parquet(events), 400, None, "0 seconds"), out, state)
    got = spark.read.parquet(out).collect()
    want, end = Counter(), rows[-1][4]
    for p in range(4):
        page = hub.Page({}, 0, 400, None)
        for _, s, k, u, t, _ in (r for r in rows if r[0] == p):
            page.event(k, s, u, t)
        page.until(end)
        want.update((p, *o) for o in page.out)
    assert Counter((r.page_id, r.kind, r["at"], r.seq, r.session, r.update) for r in got) == want
    fold = defaultdict(list)
    for r in rows:
        if r[2] == "update":
            fold[r[0]].append(r[3])
    assert {p: [r.update for r in sorted((x for x in got if x.page_id == p and x.kind == "update"), key=lambda x: x.seq)] for p in fold} == fold


def test_numbers_go_on_from_a_log_that_is_there(spark, tmp_path):
    events, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    log = spark.createDataFrame([(0, 1), (0, 2), (0, 41), (3, 7)], "page_id long, seq long")
    frame(spark, [(0, "x", "update", "u", 5, 0), (1, "x", "update", "u", 6, 1), (0, "x", "update", "v", 7, 2), (None, "x", "update", "v", 8, 3)]).write.parquet(events)
    hub.kept(hub.hubs(spark.readStream.schema(hub.EVENTS).parquet(events), 400, None, "0 seconds", log), out, state)
    got = spark.read.parquet(out).where("kind = 'update'").collect()
    assert sorted((r.page_id, r.seq, r.update) for r in got) == [(0, 42, "u"), (0, 43, "v"), (1, 1, "u")]


def test_projection_by_the_clock_of_the_machine(spark, tmp_path):
    events, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    frame(spark, [(1, "x", "attach", None, 5, 0), (1, "x", "update", "u", 6, 1)]).write.parquet(events)
    stream = hub.hubs(spark.readStream.schema(hub.EVENTS).parquet(events), 1)
    with hub.provider(spark):
        q = stream.writeStream.foreachBatch(hub.sink(out)).outputMode("append").option("checkpointLocation", state).start()
    got, end = [], time.time() + 60
    while len(got) < 3 and time.time() < end:
        time.sleep(1)
        got = [(r.page_id, r.kind, r.seq) for r in spark.read.schema(hub.OUTPUT).parquet(f"{out}/batch=*").collect()] if list(tmp_path.glob("out/batch=*/_SUCCESS")) else []
    q.stop()
    assert sorted(got) == [(1, "opened", 0), (1, "quiet", 1), (1, "update", 1)]


SCHEMA = "ws string, source string, target string, weight double, place long"


class Replayed:
    """What the sink should come to, one edge after the other in plain Python."""

    def __init__(self, share):
        self.share, self.edges, self.home, self.changed, self.runs = share, defaultdict(list), defaultdict(dict), Counter(), {}

    def batch(self, rows, number):
        for ws in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == ws]
            self.edges[ws] += mine
            weight = defaultdict(Counter)
            for _, a, b, w, _ in self.edges[ws]:
                if a != b:
                    weight[a][b] += w
                    weight[b][a] += w
            touched = list(dict.fromkeys(n for _, a, b, _, _ in mine for n in (a, b)))
            self.home[ws] = communities.reassigned(touched, {n: list(c.items()) for n, c in weight.items()}, self.home[ws])
            self.changed[ws] += len(mine)
            pairs = Counter()
            for _, a, b, w, _ in self.edges[ws]:
                pairs[min(a, b), max(a, b)] += w
            if self.changed[ws] >= -(-len(pairs) * self.share // 1):
                names = sorted({n for p in pairs for n in p})
                at = {n: i for i, n in enumerate(names)}
                self.home[ws] = dict(zip(names, communities.louvain(len(names), [(at[a], at[b], w) for (a, b), w in sorted(pairs.items())]), strict=True))
                self.changed[ws], self.runs[ws] = 0, number


def made_batches(seed, sizes):
    r = random.Random(seed)
    place = 0
    for n in sizes:
        rows = []
        for _ in range(n):
            k = r.randrange(3)
            a, b = (f"n{k}{r.randrange(8)}" for _ in range(2))
            rows.append((r.choice("pq"), a, b if r.random() < 0.9 else f"n{(k + 1) % 3}0", float(r.randint(1, 3)), place))
            place += 1
        yield rows


def test_batches_equal_edge_by_edge_work_and_count_once(spark, tmp_path):
    folder, state = str(tmp_path / "c"), defaultdict(list)
    seen = []

    def edges(s, number):
        return s.createDataFrame([r for n in range(number + 1) for r in state[n]], SCHEMA)

    sink = partition.Communities(folder, edges, 0.5, now=lambda: "2026-01-01 00:00:00")
    plain = Replayed(0.5)
    for number, rows in enumerate(made_batches(3, [30, 6, 5, 40, 2])):
        state[number] = rows
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if number in (1, 3) else 1):  # a batch that is run again
            sink(batch, number)
        plain.batch(rows, number)
        got = defaultdict(dict)
        for r in partition.members(spark, folder).collect():
            got[r.ws][r.name] = r.community
        assert {w: h for w, h in got.items()} == {w: h for w, h in plain.home.items() if h}
        churn = {r.ws: (r.changed, r.last_full_run is not None) for r in partition.churn(spark, folder).collect()}
        assert churn == {w: (plain.changed[w], w in plain.runs) for w in plain.home}
        seen.append(churn)
    assert {r.ws: r.run for r in partition.last_runs(spark, folder).collect()} == plain.runs
    assert any(c > 0 for s in seen for c, _ in s.values()) and any(c == 0 for s in seen for c, _ in s.values())


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "c", "cp"))
    sink = partition.Communities(folder, lambda s, n: s.read.schema(SCHEMA).parquet(source), 0.05)
    plain = Replayed(0.05)
    for number, rows in enumerate(made_batches(9, [20, 1, 15])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        partition.followed(spark.readStream.schema(SCHEMA).parquet(source), sink, checkpoint)
        plain.batch(rows, number)
    got = {(r.ws, r.name): r.community for r in partition.members(spark, folder).collect()}
    assert got == {(w, n): c for w, h in plain.home.items() for n, c in h.items()}
    partition.followed(spark.readStream.schema(SCHEMA).parquet(source), sink, checkpoint)  # nothing new
    assert {r.ws: r.changed for r in partition.churn(spark, folder).collect()} == dict(plain.changed)


def test_without_any_batch_there_is_nothing(spark, tmp_path):
    assert partition.members(spark, str(tmp_path)).count() == 0 and partition.churn(spark, str(tmp_path)).count() == 0


def test_moves_need_a_clustered_neighbour(spark):
    edges = spark.createDataFrame([("w", "a", "b", 2.0), ("w", "b", "c", 1.0), ("w", "x", "y", 9.0), ("w", "b", "b", 99.0)], "ws string, source string, target string, weight double")
    touched = spark.createDataFrame([("w", "b", 0), ("w", "c", 1), ("w", "x", 2), ("w", "y", 3)], "ws string, name string, place long")
    home = spark.createDataFrame([("w", "a", 5)], partition.MEMBERS)
    assert {(r.name, r.community) for r in partition.moved(edges, touched, home).collect()} == {("b", 5), ("c", 5)}
    assert graph.neighbour_weights(edges).count() == 6


def test_workspaces_without_members_or_due_in_full_take_no_quick_way(spark, tmp_path, monkeypatch):
    schema = "ws string, source string, target string, weight double, place long"
    first, more = [("w", "a", "b", 1.0, 0), ("w", "b", "c", 1.0, 1)], [("v", "x", "y", 1.0, 2), ("w", "d", "a", 1.0, 3)]
    sink = partition.Communities(str(tmp_path), lambda s, n: s.createDataFrame(first + more * n, schema), 0.5)
    quick = []
    moved = partition.moved
    monkeypatch.setattr(partition, "moved", lambda edges, touched, home: quick.append({r.ws for r in touched.collect()}) or moved(edges, touched, home))
    sink(spark.createDataFrame(first, schema), 0)
    assert quick == []
    sink(spark.createDataFrame(more, schema), 1)
    assert quick == [{"w"}]
    found = {(r.ws, r.name): r.community for r in partition.members(spark, str(tmp_path)).collect()}
    assert found["w", "d"] == found["w", "a"] and found["v", "x"] == found["v", "y"] and len(found) == 6
