"""Sessions from messages that arrive out of order, with bounded state.

``transformWithStateInPandas`` on event time.  Messages wait in a reorder
buffer until the watermark has passed them; then they are applied in (time,
seq) order to their session's scalars by the algebra of
``streaming.sessions``, so a control message that arrives after frames it
precedes still governs them.

A call of the state operator and each of its state accesses are exchanges with
the JVM, some 30 ms of CPU together, while a session has a few messages in a
micro-batch.  So the operator's key is a bucket of sessions (by their hash):
calls and accesses are per bucket, and within it each session is advanced for
itself.  Before the exchange the messages of a bucket are packed into Arrow
bytes, so the exchange and the operator's input have few rows.  State per bucket:

* ``position``: its sessions' scalars, their last applied messages, how many
  messages wait, and whether history lines do (Arrow bytes); the slots in use
  with their first times; the bucket's timer;
* ``waiting``: the reorder buffer, a map from time slots to the slot's messages
  (Arrow bytes, sorted).  It holds what the watermark has not passed, and is
  read and written a slot at a time, a passed slot once;
* ``unsent``: history lines of sets completed since their session was last idle.

A session is idle when no message follows one for ``idle``; then the lines of
the sets completed so far that were not sent yet are sent (T5).  A timer on
event time finds it where no later message shows it, so a replay ends with the
same lines as the live stream.  A session without a message for more than
``expire`` has ended: its state is dropped (T1), and a later message begins it
anew, whether the timer or that message comes first.

Every input message is accounted for: it is applied, or comes out with the
reason of its rejection.  ``late``: at or before the watermark, or not after
the last applied message; ``duplicate``: of the (time, seq) of one that waits.

All results leave as one stream; ``kind`` tells them apart: ``message`` (one
per applied message), ``frame`` (the kept frames, as ``session_stream``),
``reject`` and ``history``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.exercises import REGISTRY
from .sessions import INITIAL_STATE, STATE_FIELDS, advance_rows
from .sessions import OUTPUT_SCHEMA as FRAME_SCHEMA

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "clock"  # a message that only moves the watermark, as at the end of a replay

MESSAGE_COLUMNS = ["session_id", "seq", "ts_us", "type", "value", "angle", "form"]
NUMBERS = MESSAGE_COLUMNS[:3]
_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
_WAITING = pa.schema([
    ("session_id", pa.int64()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("type", pa.string()), ("value", pa.string()),
    ("angle", pa.float64()), ("form", pa.bool_()),
])
_SESSIONS = pa.schema(
    [("session_id", pa.int64())] + [(n, _ARROW[t]) for n, t in STATE_FIELDS]
    + [("last_us", pa.int64()), ("last_seq", pa.int64()), ("waiting", pa.int64()), ("unsent", pa.bool_())]
)
_LINES = pa.schema([("session_id", pa.int64()), ("series_number", pa.int64()), ("line", pa.string())])
POSITION = "sessions binary, slots array<bigint>, firsts array<bigint>, timer_ms bigint"
PACKED = "bucket int, messages binary"
OUTPUT_SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("note", T.StringType())]
    + FRAME_SCHEMA.fields
)
_FRAME_COLUMNS = [f.name for f in FRAME_SCHEMA.fields]
_DONE = _FRAME_COLUMNS.index("done")
_SET = [n for n, _ in STATE_FIELDS].index("set_no")
_NEVER = -(2**62)
_LEAST = -(2**63)  # a null session, seq or time within the operator
PACK_ROWS = 1 << 17  # messages that are packed, put into the buffer or applied at a time


def _bytes(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _batch(data: Any, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(data)), schema)


def _of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (batch.column(c).to_numpy() for c in NUMBERS)


def _values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_numpy(zero_copy_only=False).tolist()


def _typed(kind: str, rows: int, columns: dict[str, Any]) -> pd.DataFrame:
    """Rows of the output schema, held in Arrow; columns not given are null, and so are the least numbers."""
    columns["kind"] = pa.repeat(kind, rows)
    found = []
    for f in OUTPUT_SCHEMA.fields:
        given, kind_of = columns.get(f.name), _ARROW[f.dataType]
        if given is None:
            given = pa.nulls(rows, kind_of)
        elif f.name in NUMBERS:
            given = np.asarray(given, np.int64)
            given = pa.array(given, kind_of, mask=given == _LEAST)
        found.append(given if isinstance(given, pa.Array) else pa.array(given, kind_of))
    return pa.table(found, names=OUTPUT_SCHEMA.names).to_pandas(types_mapper=pd.ArrowDtype)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with their bucket -> the messages of a bucket as Arrow bytes, ``PACK_ROWS`` messages at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _packed(held)
            held, rows = [], 0
    if rows:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    table = table.filter(pc.fill_null(pc.not_equal(table["type"], CLOCK), True))
    bucket = table["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    rows = table.select(MESSAGE_COLUMNS).cast(_WAITING).take(order).combine_chunks()
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    whole = _joined(rows.to_batches()) if len(order) else None
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[first], pa.int32()),
        pa.array([_bytes(whole.slice(i, j - i)) for i, j in zip(first, [*first[1:], len(order)])], pa.binary()),
    ], names=["bucket", "messages"])


class Place:
    """Where a session is: its scalars, its last applied message and what waits."""

    __slots__ = ("scalars", "last_us", "last_seq", "waiting", "unsent")

    def __init__(self, scalars: tuple = INITIAL_STATE, last_us: int | None = None, last_seq: int | None = None,
                 waiting: int = 0, unsent: bool = False):
        self.scalars, self.last_us, self.last_seq, self.waiting, self.unsent = scalars, last_us, last_seq, waiting, unsent


class Bucket:
    """The state of a bucket within one call."""

    def __init__(self, value: tuple | None):
        self.places: dict[int, Place] = {}
        self.slots: dict[int, int] = {}  # slot in use -> its first time
        self.timer_ms: int | None = None
        self.lines: dict[int, list] | None = None  # stored unsent lines by session, once they are read
        self.fresh: dict[int, list] = {}  # those of this call
        self.history: list[tuple] = []  # (session, series_number, line, sent at)
        if value is not None:
            rows = _batch(value[0], _SESSIONS)
            for one in zip(*(c.to_pylist() for c in rows.columns)):
                self.places[one[0]] = Place(one[1:-4], *one[-4:])
            self.slots, self.timer_ms = dict(zip(value[1], value[2])), value[3]

    def value(self) -> tuple:
        rows = [(s, *p.scalars, p.last_us, p.last_seq, p.waiting, p.unsent) for s, p in self.places.items()]
        return _bytes(_of(rows, _SESSIONS)), list(self.slots), list(self.slots.values()), self.timer_ms


class SessionProcessor(StatefulProcessor):
    """See the module's text; times in microseconds, ``expire`` None keeps a session for ever."""

    def __init__(self, idle_us: int, expire_us: int | None, slot_us: int, known: tuple[str, ...]):
        if expire_us is not None and expire_us < idle_us:
            raise ValueError("a session must be idle before it expires")
        self.idle_us, self.expire_us, self.slot_us, self.known = idle_us, expire_us, slot_us, known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION)
        self.waiting = handle.getMapState("waiting", "slot long", "messages binary")
        self.unsent = handle.getListState("unsent", "lines binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed, held = self._passed(timerValues), Bucket(self.position.get())
        for part in self._parts(rows):
            yield from self._admit(part, held, passed)
        yield from self._advance(held, passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = Bucket(self.position.get())
        held.timer_ms = None
        yield from self._advance(held, self._passed(timerValues))

    @staticmethod
    def _passed(timer_values: Any) -> int:
        """Event time up to which no message is accepted any more, in microseconds."""
        ms = timer_values.getCurrentWatermarkInMs()
        return ms * 1000 if ms > 0 else _NEVER

    @staticmethod
    def _parts(rows: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        """The packed messages, about ``PACK_ROWS`` at a time."""
        held, n = [], 0
        for pdf in rows:
            for data in pdf["messages"]:
                held.append(_batch(data, _WAITING))
                n += held[-1].num_rows
                if n >= PACK_ROWS:
                    yield _joined(held)
                    held, n = [], 0
        if n:
            yield _joined(held)

    def _read(self, slot: int) -> pa.RecordBatch:
        return _batch(self.waiting.getValue((slot,))[0], _WAITING)

    def _write(self, slot: int, rows: pa.RecordBatch, held: Bucket) -> None:
        if rows.num_rows:
            self.waiting.updateValue((slot,), (_bytes(rows),))
            held.slots[slot] = int(rows.column("ts_us").to_numpy().min())
        else:
            self.waiting.removeKey((slot,))
            del held.slots[slot]

    def _admit(self, part: pa.RecordBatch, held: Bucket, passed: int) -> Iterator[pd.DataFrame]:
        """Put messages into the reorder buffer; yields the rejected ones."""
        session, seq, us = _numbers(part)
        ids, which = np.unique(session, return_inverse=True)
        places = [held.places.get(i) for i in ids.tolist()]
        last_us, last_seq = (
            np.array([_LEAST if p is None or p.last_us is None else getattr(p, name) for p in places], np.int64)[which]
            for name in ("last_us", "last_seq")
        )
        late = (us <= passed) | (us < last_us) | ((us == last_us) & (seq <= last_seq))
        if late.any():
            yield self._rejected(part.filter(pa.array(late)), "late")
            part, us = part.filter(pa.array(~late)), us[~late]
        slots = us // self.slot_us
        for slot in np.unique(slots).tolist():
            fresh = part.filter(pa.array(slots == slot))
            rows = pa.concat_batches([self._read(slot), fresh]) if slot in held.slots else fresh
            session, seq, us = _numbers(rows)
            order = np.lexsort((seq, us, session))  # stable: what waits comes before what repeats it
            session, seq, us = session[order], seq[order], us[order]
            again = np.zeros(len(order), bool)
            again[1:] = (session[1:] == session[:-1]) & (us[1:] == us[:-1]) & (seq[1:] == seq[:-1])
            if again.any():
                yield self._rejected(rows.take(pa.array(order[again])), "duplicate")
            new = ~again & (order >= len(order) - fresh.num_rows)
            for i, n in zip(*(a.tolist() for a in np.unique(session[new], return_counts=True))):
                held.places.setdefault(i, Place()).waiting += n
            if new.any():
                self._write(slot, rows.take(pa.array(order[~again])), held)

    @staticmethod
    def _rejected(rows: pa.RecordBatch, why: str) -> pd.DataFrame:
        n = rows.num_rows
        return _typed("reject", n, {c: rows.column(c) for c in NUMBERS} | {"note": pa.repeat(why, n)})

    def _advance(self, held: Bucket, passed: int) -> Iterator[pd.DataFrame]:
        """Apply what the watermark has passed, slot by slot; then idle lines, expiry and the next timer."""
        for slot in sorted(held.slots):
            if held.slots[slot] > passed:
                break
            rows = self._read(slot)
            ready = rows.column("ts_us").to_numpy() <= passed
            due = rows if ready.all() else rows.filter(pa.array(ready))
            for i in range(0, due.num_rows, PACK_ROWS):
                yield from self._apply(due.slice(i, PACK_ROWS), held)
            self._write(slot, rows.filter(pa.array(~ready)), held)
        due = [*held.slots.values()]
        for session, place in [*held.places.items()]:
            last = place.last_us
            if last is None:
                continue
            if place.unsent:
                if passed >= last + self.idle_us:
                    self._send(session, place, last + self.idle_us, held)
                else:
                    due.append(last + self.idle_us)
            if self.expire_us is not None:
                if not place.waiting and passed > last + self.expire_us:
                    del held.places[session]
                else:
                    due.append(last + self.expire_us + 1)
        if held.history:
            session, number, line, at = zip(*held.history)
            yield _typed("history", len(at), {"session_id": session, "series_number": number, "note": line, "ts_us": at})
        self._settle(held, min(due, default=None), passed)

    def _apply(self, rows: pa.RecordBatch, held: Bucket) -> Iterator[pd.DataFrame]:
        """Advance the sessions by their messages, sorted by (session, time, seq); a session that expires between two
        messages is cut there."""
        session, seq, us = _numbers(rows)
        yield _typed("message", len(us), {"ts_us": us, "session_id": session, "seq": seq})
        gap = np.diff(us)
        cut = np.diff(session) != 0
        if self.expire_us is not None:
            cut |= gap > self.expire_us
        bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), len(us)]
        idle = np.flatnonzero(~cut & (gap > self.idle_us)).tolist()  # messages after which their session is idle
        back = np.flatnonzero(~cut & (np.diff(seq) < 0)).tolist()
        columns = [_values(rows, c) for c in ("type", "value", "angle", "form")]
        ends = self._unknown(rows)
        at, ids, numbers = us.tolist(), session.tolist(), seq.tolist()
        frames = []
        for i, j in zip(bounds, bounds[1:]):
            sid = ids[i]
            place = held.places[sid]
            last, k = place.last_us, bisect_left(idle, i)
            if self.expire_us is not None and last is not None and at[i] - last > self.expire_us:
                self._send(sid, place, last + self.idle_us, held)
                place.scalars, last = INITIAL_STATE, None
            if last is not None and at[i] - last > self.idle_us:
                self._send(sid, place, last + self.idle_us, held)
            elif k < len(idle) and idle[k] < j:
                self._send(sid, place, at[idle[k]] + self.idle_us, held)
            if place.scalars[2] is None or place.scalars[2] in self.known:  # else the session has ended
                e, b = bisect_left(ends, i), bisect_left(back, i)
                stop = ends[e] + 1 if e < len(ends) and ends[e] < j else j
                if b < len(back) and back[b] < stop - 1:
                    order = sorted(range(i, stop), key=numbers.__getitem__)
                    found = ([c[x] for x in order] for c in columns)
                else:
                    order, found = range(i, stop), (c[i:stop] for c in columns)
                sets = place.scalars[_SET]
                kept, place.scalars = advance_rows(zip(repeat(sid), order, *found), place.scalars)
                frames += kept
                if place.scalars[_SET] != sets:
                    for row in kept:
                        if row[_DONE]:
                            self._line(row, at, idle, j, place, held)
            place.last_us, place.last_seq = at[j - 1], numbers[j - 1]
            place.waiting -= j - i
        if frames:
            found = dict(zip(_FRAME_COLUMNS, zip(*frames)))
            index = np.array(found["seq"], np.int64)  # a frame's place among the messages
            yield _typed("frame", len(frames), found | {"seq": seq[index], "ts_us": us[index]})

    def _unknown(self, rows: pa.RecordBatch) -> list[int]:
        """The ``workout`` messages of unknown exercises, which end their sessions; a missing value is the default."""
        kind, value = rows.column("type"), rows.column("value")
        other = pc.and_(pc.is_valid(value), pc.invert(pc.is_in(value, pa.array(self.known, pa.string()))))
        found = pc.and_(pc.fill_null(pc.equal(kind, "workout"), False), other)
        return np.flatnonzero(found.to_numpy(zero_copy_only=False)).tolist()

    def _line(self, row: tuple, at: list[int], idle: list[int], end: int, place: Place, held: Bucket) -> None:
        """The line of a completed set: sent at the first idle moment from the completion on, kept if none is seen yet."""
        done = dict(zip(_FRAME_COLUMNS, row))
        line = (done["series_number"], f"{done['exercise']}: {done['reps']} reps")
        k = bisect_left(idle, done["seq"])
        if k < len(idle) and idle[k] < end:
            held.history.append((done["session_id"], *line, at[idle[k]] + self.idle_us))
        else:
            held.fresh.setdefault(done["session_id"], []).append(line)
            place.unsent = True

    def _send(self, session: int, place: Place, at: int, held: Bucket) -> None:
        """Send the session's lines that wait."""
        if not place.unsent:
            return
        if held.lines is None:
            held.lines = {}
            for (data,) in self.unsent.get():
                for one, *line in zip(*(c.to_pylist() for c in _batch(data, _LINES).columns)):
                    held.lines.setdefault(one, []).append(line)
        for line in held.lines.pop(session, []) + held.fresh.pop(session, []):
            held.history.append((session, *line, at))
        place.unsent = False

    def _settle(self, held: Bucket, due: int | None, passed: int) -> None:
        """Store the state and set the next timer, or drop a bucket without sessions."""
        if held.lines is not None:
            self.unsent.clear()
        rows = [(s, *line) for part in (held.lines or {}, held.fresh) for s, lines in part.items() for line in lines]
        if rows:
            self.unsent.appendValue((_bytes(_of(rows, _LINES)),))
        # behind the watermark, as one that has expired already would be forgotten
        timer = None if due is None else max(-(-due // 1000), passed // 1000 + 1, 1)
        if timer != held.timer_ms:
            if held.timer_ms is not None:
                self.handle.deleteTimer(held.timer_ms)
            if timer is not None:
                self.handle.registerTimer(timer)
            held.timer_ms = timer
        if held.places:
            self.position.update(held.value())
        else:
            self.position.clear()


def ordered_sessions(
    messages: DataFrame, delay: str, idle: int, expire: int | None = None, slot: int = 3600, buckets: int = 256
) -> DataFrame:
    """Stream of ``OUTPUT_SCHEMA`` rows from messages (``MESSAGE_COLUMNS``) in any order within ``delay``.

    ``idle``, ``expire`` and ``slot`` in seconds; a task holds one slot of a
    bucket's messages at a time, so the slot follows their rate, and the number
    of ``buckets`` that of the sessions (some hundred each).  It must stay as it
    is when a stream is restarted.  The watermark's column does not reach
    the stateful operator, which would drop the late rows unseen; the operator
    compares with the watermark itself.
    """
    timed = messages.withColumn("__ts", F.timestamp_micros("ts_us")).withWatermark("__ts", delay)
    expire_us = None if expire is None else expire * 1_000_000
    processor = SessionProcessor(idle * 1_000_000, expire_us, slot * 1_000_000, tuple(REGISTRY))
    columns = [F.coalesce(F.col(c), F.lit(_LEAST)).alias(c) if c in NUMBERS else F.col(c) for c in MESSAGE_COLUMNS]
    dealt = timed.select(F.pmod(F.hash("session_id"), F.lit(buckets)).alias("bucket"), *columns)
    return dealt.mapInArrow(pack, PACKED).groupBy("bucket").transformWithStateInPandas(
        processor, OUTPUT_SCHEMA, "append", "eventTime"
    )


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one is left as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own
