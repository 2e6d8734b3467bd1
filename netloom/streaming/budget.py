"""A budget over a rolling time as a stream with state: what each event has spent of it, in the order of the events' times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .events import drain

# the state store that transformWithState needs
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
#: Groups of keys that share state, for each stretch of time: one for each key would be as many calls as there are keys and days.
GROUPS = 128
COLUMNS = ["name", "at", "id", "value", "own"]
KINDS = pa.schema([("name", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("value", pa.float64()), ("own", pa.bool_())])


def _packed(rows: list[tuple]) -> tuple[bytes]:
    """Events as one value of a state."""
    batch = pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), KINDS)], schema=KINDS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, KINDS) as file:
        file.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _unpacked(state) -> list[tuple]:
    """The events of all values of a state."""
    found = []
    for (block,) in state.get() if state.exists() else ():
        for batch in pa.ipc.open_stream(block):
            found += zip(*[column.to_pylist() for column in batch.columns])
    return found


def _order(x: tuple) -> tuple:
    return x[1], x[2] is None, x[2]


def _by_name(rows: list[tuple]) -> dict:
    found: dict = {}
    for x in rows:
        found.setdefault(x[0], []).append(x)
    return found


class Rolling(StatefulProcessor):
    """Of a group of keys and a stretch of time as long as the span: keeps events until the watermark has passed them, then gives each own one with its key's sum.

    Events of the stretch before come too, as what own ones reach back to. A timer goes off at the earliest waiting
    event, and at the end of the stretch, when its state goes.
    """

    def __init__(self, out: list[str], span: int):
        self.out, self.span = out, span

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.given = handle.getListState("given", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if frame.empty:
                continue
            columns = [frame[n].tolist() for n in COLUMNS]
            for k in (0, 2, 3):
                columns[k] = [None if x is None or x != x else x for x in columns[k]]
            columns[2] = [None if x is None else int(x) for x in columns[2]]
            self.waiting.appendValue(_packed(list(zip(*columns))))
            low = min(columns[1])
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer at the millisecond behind ``at``, in place of a later one."""
        due, others = at // 1000 + 1, list(self.handle.listTimers())
        if all(t > due for t in others):
            for t in others:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(self.waiting)
        later = [x for x in waiting if x[1] >= until]
        self.waiting.put([_packed(later)]) if later else self.waiting.clear()
        end = key[1] + self.span
        before, out, kept = _by_name(_unpacked(self.given)), [], []
        ready = _by_name([x for x in waiting if x[1] < until])
        for name in before.keys() | ready.keys():
            window = sorted(before.get(name, []), key=_order)
            n = len(window)
            window += sorted(ready.get(name, []), key=_order)
            out += self._sums(window, n)
            kept += [x for x in window if x[1] >= until - self.span] if until <= end else []
        self.given.put([_packed(kept)]) if kept else self.given.clear()
        if later or kept:
            self.handle.registerTimer((min(x[1] for x in later) if later else max(end, until)) // 1000 + 1)
        if out:
            yield pd.DataFrame({self.out[0]: pd.Series([x[0] for x, _ in out], dtype=object), "id": pd.Series([x[2] for x, _ in out], dtype="Int64"), "at": [x[1] for x, _ in out], "spent": pd.Series([t for _, t in out], dtype="float64")})

    def _sums(self, window: list[tuple], n: int) -> list[tuple]:
        """The own events of a key's ``window`` from the ``n``-th on, with their sums. A running sum would carry the rounding of events that are gone: each sum is of its own events."""
        start, peers, found = 0, 0, []
        for k in range(n, len(window)):
            at = window[k][1]
            while window[start][1] < at - self.span:
                start += 1
            peers = max(peers, k)
            while peers + 1 < len(window) and window[peers + 1][1] == at:
                peers += 1
            if window[k][4]:
                known = [x[3] for x in window[start : peers + 1] if x[3] is not None]
                found.append((window[k], sum(known) if known else None))
        return found

    def close(self) -> None:
        pass


def rolling_budget(events: DataFrame, key: str, time: str, seq: str, value: str, span: int = DAY, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(key, id, at, spent) of each event of a stream: the sum of ``value`` over its key's events of the ``span`` microseconds up to it, those of its own time included.

    An event is answered when the watermark, ``late`` behind the newest event, has passed it, so events may come in any
    order within that; what comes later still is dropped. Keys share the state of their group, so that many keys with few
    events each cost few calls, and events are kept by stretches of the span, so that a key with many of them is spread
    over tasks. A group holds a stretch's events over ``groups``. ``seq`` is the event's number. Needs the session's state
    store to be ``PROVIDER``. Null values add nothing, a sum of nulls is null; events without a time are left out.
    """
    kind = events.schema[key].dataType
    binary = kind == T.BinaryType()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.where(F.col(time).isNotNull()).withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    stretch = at - F.pmod(at, F.lit(span).cast("bigint"))
    both = F.explode(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.struct((stretch + span).alias("stretch"), F.lit(False).alias("own"))))
    name = F.hex(key) if binary else F.col(key).cast("string")
    rows = rows.withColumn("part", both).select(name.alias("name"), F.pmod(F.hash(name), F.lit(groups)).alias("group"), "part.stretch", "part.own", at.alias("at"), F.col(seq).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"), "event_time")
    out = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("spent", T.DoubleType())])
    found = rows.groupBy("group", "stretch").transformWithStateInPandas(Rolling(["name"], span), out, "Append", "EventTime")
    return found.select((F.unhex("name") if binary else F.col("name").cast(kind)).alias(key), "id", "at", "spent")


def spent(events: DataFrame, path: str, key: str, time: str, seq: str, value: str, span: int = DAY, late: str = "1 hour") -> DataFrame:
    """``rolling_budget`` of all that a stream holds now, the newest events included, by files under ``path``.

    A first run answers what the watermark passes; then one event of the year 2200 without a key, of which there is no
    answer, moves the watermark past all others. That ends the stream: runs over the same ``path`` take nothing more.
    """
    spark, folder = events.sparkSession, f"{path}/end"
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(folder)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(folder))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        answers = rolling_budget(both, key, time, seq, value, span, late)
        drain(answers, path)
        end = lambda f: (F.lit("2200-01-01 00:00:00") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name)
        spark.range(1).select(*map(end, events.schema)).write.mode("append").parquet(folder)
        return drain(answers, path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
