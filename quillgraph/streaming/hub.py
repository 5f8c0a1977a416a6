"""Pages in use as keyed state: sessions counted, updates numbered, and one projection owed once a session's edits settle.

The stream has rows (page_id, session, kind, update, ts, place) of the kinds attach, update and detach. State by page is
the number of its last update, and for each session when it was seen and when a projection is due. A session that ends
leaves no state, and one that is silent for too long ends; what stays of a page without sessions is one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: So long after a session's last edit its page is projected.
DELAY_MS = 400
EVENTS = "page_id long, session string, kind string, update string, ts timestamp, place long"
#: kind is opened or closed (the page's first session came, its last one went), update (seq is its number in the log), quiet
#: or left (the page is to be projected up to seq, as a session's edits settled, or as it went with a projection owed).
OUTPUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("session", T.StringType()), T.StructField("update", T.StringType())])


@dataclass
class Session:
    seen: int
    due: int = 0  # when a projection is owed, 0 if none is


class Page:
    """One page's state, and what each event and the time bring about. Times are in milliseconds."""

    def __init__(self, sessions: dict[str, Session], seq: int, delay: int, idle: int | None):
        self.sessions, self.seq, self.delay, self.idle = sessions, seq, delay, idle
        self.out: list[tuple[str, int, int, str, str | None]] = []

    def tell(self, kind: str, at: int, session: str, update: str | None = None) -> None:
        self.out.append((kind, at, self.seq, session, update))

    def next_due(self) -> tuple[int, int, str] | None:
        owed = [(s.due, 0, name) for name, s in self.sessions.items() if s.due]
        silent = [(s.seen + self.idle, 1, name) for name, s in self.sessions.items()] if self.idle else []
        return min(owed + silent, default=None)

    def until(self, now: int) -> None:
        """All that is due by now, in its order."""
        while (due := self.next_due()) and due[0] <= now:
            at, silent, name = due
            if silent:
                self.left(name, at)
            else:
                self.sessions[name].due = 0
                self.tell("quiet", at, name)

    def left(self, name: str, at: int) -> None:
        if self.sessions.pop(name).due:
            self.tell("left", at, name)
        if not self.sessions:
            self.tell("closed", at, name)

    def event(self, kind: str, name: str, update: str | None, at: int) -> None:
        """An edit of an unknown session attaches it; the end of one is nothing."""
        self.until(at)
        if kind == "detach":
            if name in self.sessions:
                self.left(name, at)
            return
        if not self.sessions:
            self.tell("opened", at, name)
        session = self.sessions.setdefault(name, Session(at))
        session.seen = at
        if kind == "update":
            self.seq += 1
            session.due = at + self.delay
            self.tell("update", at, name, update)


class Hubs(StatefulProcessor):
    """Page over keyed state. With event time an event's own time counts, and timers follow the watermark; else the clock's."""

    def __init__(self, delay_ms: int = DELAY_MS, idle_ms: int | None = None, event_time: bool = False):
        self.delay, self.idle, self.event_time = delay_ms, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "seen long, due long")
        self.seq = handle.getValueState("seq", "seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """(page_id, seq) of a log that is there already: numbers go on from it."""
        self.seq.update((initialState["seq"],))

    def loaded(self) -> Page:
        held = self.seq.get()
        return Page({k[0]: Session(v[0], v[1]) for k, v in self.sessions.iterator()}, held[0] if held else 0, self.delay, self.idle)

    def saved(self, key, page: Page, before: dict[str, Session], fired: int | None = None) -> Iterator[Row]:
        """Writes what has changed, keeps a timer for each time that something is due, and gives out what was told."""
        times = lambda ss: {s.due for s in ss.values() if s.due} | ({s.seen + self.idle for s in ss.values()} if self.idle else set())
        old, new = times(before), times(page.sessions)
        for t in old - new - {fired}:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)
        for name in before.keys() - page.sessions.keys():
            self.sessions.removeKey((name,))
        for name, s in page.sessions.items():
            if before.get(name) != s:
                self.sessions.updateValue((name,), (s.seen, s.due))
        if page.seq:
            self.seq.update((page.seq,))
        for kind, at, seq, session, update in page.out:
            yield Row(page_id=key[0], kind=kind, at=at, seq=seq, session=session, update=update)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        page = self.loaded()
        before = {k: Session(s.seen, s.due) for k, s in page.sessions.items()}
        for r in sorted(rows, key=lambda r: (r["at"], r["place"])):
            page.event(r["kind"], r["session"], r["update"], r["at"] if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        yield from self.saved(key, page, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        page, at = self.loaded(), expiredTimerInfo.getExpiryTimeInMs()
        before = {k: Session(s.seen, s.due) for k, s in page.sessions.items()}
        page.until(at)
        yield from self.saved(key, page, before, at)

    def close(self) -> None:
        pass


def hubs(events: DataFrame, delay_ms: int = DELAY_MS, idle_ms: int | None = None, late: str | None = None, log: DataFrame | None = None) -> DataFrame:
    """What becomes of the events of a stream, as OUTPUT tells. late is how long events may be late, then their own time counts;
    else the clock's. log has (page_id, seq) of the updates so far. Rows without a page or a time are left out.
    """
    rows = events.where(F.col("page_id").isNotNull() & F.col("ts").isNotNull())
    if late is not None:
        rows = rows.withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    initial = None if log is None else log.groupBy("page_id").agg(F.max("seq").alias("seq")).groupBy("page_id")
    mode = "processingTime" if late is None else "eventTime"
    return rows.groupBy("page_id").transformWithState(Hubs(delay_ms, idle_ms, late is not None), OUTPUT, "Append", mode, initial)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def sink(out: str):
    """For foreachBatch: what comes of each batch under its number; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


@contextmanager
def provider(spark: SparkSession) -> Iterator[None]:
    """The state store that has timers, for queries started within."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def kept(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Takes all that is there, by event time, and ends. (By the clock there is no end while a timer waits.)"""
    with provider(stream.sparkSession):
        stream.writeStream.foreachBatch(sink(out)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
