"""Series of a stream that share a bucket: calls for state, ends, null ids."""

from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest

from sigmill.streaming import dataset

START = datetime(2024, 1, 1)


class Kept:
    """State of one key that counts the calls for it."""

    def __init__(self, calls):
        self.calls, self.value, self.entries, self.named = calls, None, [], {}

    def __getattr__(self, name):
        doing = {
            "exists": lambda: bool(self.value or self.entries or self.named), "get": lambda: self.value or iter(list(self.entries)), "update": lambda v: self.__dict__.update(value=v),
            "clear": lambda: self.__dict__.update(value=None, entries=[], named={}), "appendValue": lambda v: self.entries.append(v), "appendList": lambda v: self.entries.extend(v),
            "put": lambda v: self.__dict__.update(entries=list(v)), "containsKey": lambda k: k in self.named, "getValue": lambda k: self.named[k], "keys": lambda: iter(list(self.named)),
            "updateValue": lambda k, v: self.named.update({k: v}), "removeKey": lambda k: self.named.pop(k, None), "iterator": lambda: iter(list(self.named.items())),
        }[name]

        def called(*args):
            self.calls[name] += 1
            return doing(*args)

        return called


class Value(Kept):
    def get(self):
        self.calls["get"] += 1
        return self.value


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), []
        self.getListState = self.getMapState = lambda *_: Kept(self.calls)
        self.getValueState = lambda *_: Value(self.calls)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_calls_for_state_do_not_grow_with_the_points():
    calls = {}
    for n in (10, 1000):
        handle, app = Handle(), dataset.Appender(timedelta(days=365))
        app.init(handle)
        us = [1_000_000 * (i + 1) for i in range(n)]
        rows = pd.DataFrame({"name": "a", "us": us, "signal": ["uv"[i % 2] for i in range(n)], "x": [float(i) for i in range(n)]})
        list(app.handleInputRows((1,), iter([rows]), Now(0)))
        due = min(handle.timers)
        assert due == 1000
        handle.timers.remove(due)  # an expired timer is gone
        out = pd.concat(list(app.handleExpiredTimer((1,), Now(1000 * n), Now(due))))
        assert len(out) == 2 * n and sorted(set(out["k"])) == list(range(n))
        calls[n] = sum(handle.calls.values())
    assert calls[10] == calls[1000] <= 12


@pytest.mark.parametrize("buckets", [1, dataset.BUCKETS])
def test_series_of_a_bucket_end_and_begin_by_themselves(spark, tmp_path, buckets):
    batches = [
        [(1, 0, "u", 1.0), (1, 1, "v", 2.0), (2, 0, "u", 3.0), (None, 5, "w", 4.0), (2**60 + 1, 2, "u", 6.0)],
        [(2, 55, "u", 5.0), (1, 1, "v", 9.0)],  # the point of 1 stands twice while it waits
        [(2, 200, "u", 7.0)],  # after this the others have ended, while 2 goes on
        [(1, 210, "w", 8.0), (2, 210, "y", 1.0), (None, 211, "w", None)],
        [(2, 400, "u", 0.0)],
    ]
    data, schema = f"{tmp_path}/data", "series_id bigint, ts timestamp_ntz, signal string, x double"
    for rows in batches:
        spark.createDataFrame([(s, START + timedelta(minutes=m), signal, x) for s, m, signal, x in rows], schema).coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schema).parquet(data)
        out = dataset.appended(stream, idle=timedelta(minutes=60), buckets=buckets)
        assert out.schema["series_id"].dataType.simpleString() == "bigint"
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = [(r.series_id, r.k, int((r.ts - START) / timedelta(minutes=1)), r.signal, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = [
        (1, 0, 0, "u", 1.0), (1, 0, 0, "v", None), (1, 1, 1, "u", None), (1, 1, 1, "v", 2.0), (1, 0, 210, "w", 8.0),
        (None, 0, 5, "w", 4.0), (None, 0, 211, "w", None), (2**60 + 1, 0, 2, "u", 6.0),
        (2, 0, 0, "u", 3.0), (2, 1, 55, "u", 5.0), (2, 2, 200, "u", 7.0), (2, 3, 210, "u", None),
        (2, 0, 0, "y", None), (2, 1, 55, "y", None), (2, 2, 200, "y", None), (2, 3, 210, "y", 1.0),
    ]
    assert Counter(got) == Counter(want)
