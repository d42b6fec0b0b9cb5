"""Data sets that grow with a stream: points are appended to signals, and new signals join late.

A point is (series_id, ts, signal, x).  The signals of a series share its
times: a row is complete when the watermark has passed its time, and then
has a number k and every signal known so far, with null for those without
a point.  A signal whose first point comes after the first row is filled
back with nulls, as if it had been there from the start.

State is typed and kept in the state store.  Each call for state, timer or
output is a message between processes, so many series share a key, their
bucket, and an entry of state holds the arrays of a whole batch: points that
wait for their time (a list), the series with their number of rows, end and
known signals (a value).  Only the times of the rows so far have entries for
each series, since a signal that joins late reads those of its series alone.
A timer of the bucket stands at the first waiting time or end.  It makes all
rows that are complete by then, and ends the series that have had no point
for `idle`: their state is dropped, and they begin anew with their next
point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that series are dealt to; points in an entry of state, and rows of an output.
BUCKETS, ENTRY, ROWS = 1024, 20_000, 20_000

Points = dict[tuple[str | None, int, str], float | None]


def _ms(us: int) -> int:
    """The first whole millisecond that isn't before."""
    return -(-us // 1000)


@dataclass
class Series:
    """What is kept of a series: rows, the time (ms) of its end, entries of times, known signals."""

    rows: int = 0
    end: int = 0
    parts: int = 0
    signals: list[str] = field(default_factory=list)


class Appender(StatefulProcessor):
    """Points in, rows out (see the module)."""

    def __init__(self, idle: timedelta) -> None:
        self.idle_ms = int(idle / timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "name array<string>, us array<bigint>, signal array<string>, x array<double>")
        self.series = handle.getValueState("series", "due bigint, timer bigint, name array<string>, n array<bigint>, last array<bigint>, parts array<bigint>, signals array<array<string>>")
        self.times = handle.getMapState("times", "name string, part bigint", "us array<bigint>")

    def _load(self) -> tuple[int, int, dict[str | None, Series]]:
        """The first waiting time (ms; 0: none), the timer and the series."""
        due, timer, *columns = self.series.get() or (0, 0, [], [], [], [], [])
        return due, timer, {name: Series(n, end, parts, list(known)) for name, n, end, parts, known in zip(*columns, strict=True)}

    def _save(self, due: int, timer: int, series: dict[str | None, Series]) -> None:
        new = min([s.end for s in series.values()] + [due] * (due > 0))
        if new != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new)
        every = list(series.values())
        self.series.update((due, new, list(series), [s.rows for s in every], [s.end for s in every], [s.parts for s in every], [s.signals for s in every]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        more: Points = {}
        for pdf in rows:
            for name, us, signal, x in zip(*(pdf[c].tolist() for c in ("name", "us", "signal", "x")), strict=True):
                more.setdefault((name if name == name else None, us, signal), None if x is None or x != x else float(x))
        if more:
            due, timer, series = self._load()
            for name, us, _ in more:
                own = series.setdefault(name, Series())
                own.end = max(own.end, _ms(us) + self.idle_ms)
            for entry in self._entries(more):
                self.waiting.appendValue(entry)
            first = min(_ms(us) for _, us, _ in more)
            self._save(min(due or first, first), timer, series)
        return iter(())

    def _entries(self, points: Points) -> list[tuple]:
        """Points as entries of the list of those that wait."""
        every = list(points.items())
        parts = [every[i : i + ENTRY] for i in range(0, len(every), ENTRY)]
        return [([p[0] for p, _ in part], [p[1] for p, _ in part], [p[2] for p, _ in part], [x for _, x in part]) for part in parts]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, timer, series = self._load()
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        points: dict[str | None, dict[int, dict[str, float | None]]] = {}
        left: Points = {}
        # A point that came again stands later, and the first stays.
        for entry in self.waiting.get() if due else ():
            for name, us, signal, x in zip(*entry, strict=True):
                if _ms(us) <= until:
                    points.setdefault(name, {}).setdefault(us, {}).setdefault(signal, x)
                else:
                    left.setdefault((name, us, signal), x)
        out: list[tuple] = []
        for name, mine in points.items():
            out += self._rows(name, mine, series[name])
            if len(out) >= ROWS:
                yield self._out(out)
                out = []
        if out:
            yield self._out(out)
        if points:
            if left:
                self.waiting.put(self._entries(left))
            else:
                self.waiting.clear()
        busy = {name for name, _, _ in left}
        for name in [n for n, s in series.items() if until >= s.end and n not in busy]:
            for part in range(series.pop(name).parts):
                self.times.removeKey((name, part))
        if series:
            self._save(min((_ms(us) for _, us, _ in left), default=0), 0 if timer <= until else timer, series)
        else:
            for state in (self.waiting, self.series, self.times):
                state.clear()

    def _rows(self, name: str | None, points: dict[int, dict[str, float | None]], own: Series) -> list[tuple]:
        """(name, k, us, signal, x) of new complete rows of a series, and the rows that new signals are filled back with."""
        new, past, out = sorted(points), None, []
        for i, us in enumerate(new):
            for signal in sorted(points[us].keys() - own.signals):
                if past is None:
                    past = [t for part in range(own.parts) for t in self.times.getValue((name, part))[0]]
                out += [(name, k, t, signal, None) for k, t in enumerate([*past, *new[:i]])]
                own.signals.append(signal)
            out += [(name, own.rows + i, us, s, points[us].get(s)) for s in own.signals]
        self.times.updateValue((name, own.parts), (new,))
        own.rows, own.parts = own.rows + len(new), own.parts + 1
        return out

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        name, k, us, signal, x = zip(*rows, strict=True)
        ts = np.array(us, "int64").view("datetime64[us]")
        return pd.DataFrame({"name": list(name), "k": np.array(k, "int64"), "ts": ts, "signal": list(signal), "x": np.array(x, float)})

    def close(self) -> None:
        pass


def appended(stream: DataFrame, delay: str = "10 minutes", idle: timedelta = timedelta(days=365), buckets: int = BUCKETS) -> DataFrame:
    """series_id, k, ts, signal, x of a stream (series_id, ts, signal, x).

    Points may come out of order by `delay`.  Those behind the watermark
    are left out by Spark before they get here, which counts them (see
    ``left_out``).  Of several points of a signal at one time the first
    stays; points without a time or a signal are left out.  A series_id
    goes as text, from which its type must come back by a cast.  The
    session is set to keep its state in RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema["series_id"].dataType
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    points = stream.select(F.col("series_id").cast("string").alias("name"), us.alias("us"), "signal", F.col("x").cast("double").alias("x")).where("us is not null and signal is not null")
    points = points.withColumns({"at": F.timestamp_micros("us"), "bucket": F.pmod(F.xxhash64("name"), F.lit(buckets))})
    rows = points.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(
        Appender(idle), "name string, k bigint, ts timestamp_ntz, signal string, x double", "Append", "EventTime"
    )
    return rows.select(F.col("name").cast(kind).alias("series_id"), "k", "ts", "signal", "x")


def left_out(query: StreamingQuery) -> int:
    """Points that came behind the watermark, by the progress that `query` still keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
