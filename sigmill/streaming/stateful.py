"""Streaming forms of the stateful operators.

A state machine for each series lives in the state store; samples of a
micro-batch go through it in time order.  Samples that aren't later than
the last one of their series are rejected, as the batch operators do when
they append, and counted: `dropped` is their number so far.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recursive import Machine, RunningMean, low_pass_of, missing
from ..plans.models import PidController, PidParameters
from ..sources.shared import new_place

OUT = "series_id {}, ts timestamp_ntz, x double, y double, dropped bigint"


class Frozen:
    """1 for a sample equal to the one before, else 0."""

    def __init__(self) -> None:
        self.last = None

    def step(self, x: float) -> float:
        same = self.last is not None and x == self.last
        self.last = x
        return float(same)


class LowPassStep:
    def __init__(self, tc_s: float, time_base_s: float = 1.0, order: int = 1) -> None:
        self.filter, self.last = Machine(low_pass_of(tc_s, time_base_s, order)), None

    def step(self, x: float) -> float:
        if missing(x):
            x = self.last
        self.last = x
        return float("nan") if x is None else self.filter.step(x)


class PidStep:
    """Output of a PID whose measurement is the sample and whose set point is fixed."""

    def __init__(self, p: PidParameters, yset: float, dt: float = 1.0) -> None:
        self.pid, self.yset = PidController(p, dt), yset

    def step(self, x: float) -> float:
        return self.pid.step(x, self.yset)


def stateful(stream: DataFrame, make: Callable[[], object]) -> DataFrame:
    """(series_id, ts, x) -> series_id, ts, x, y, dropped: a machine with step(x) over each series."""
    kind = stream.schema["series_id"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw, last, dropped = state.get
            machine, last = pickle.loads(raw), pd.Timestamp(last)
        else:
            machine, last, dropped = make(), None, 0
        came = pd.concat(list(parts)).sort_values("ts")
        rows = came.drop_duplicates("ts")
        if last is not None:
            rows = rows[rows["ts"] > last]
        dropped += len(came) - len(rows)
        if len(rows):
            rows["y"] = [machine.step(float("nan") if v is None else float(v)) for v in rows["x"]]
            last = rows["ts"].iloc[-1]
        state.update((pickle.dumps(machine), last.to_pydatetime(), dropped))
        yield rows.assign(dropped=dropped)[["series_id", "ts", "x", "y", "dropped"]] if len(rows) else pd.DataFrame(columns=["series_id", "ts", "x", "y", "dropped"])

    return stream.select("series_id", "ts", "x").groupBy("series_id").applyInPandasWithState(
        run, OUT.format(kind), "machine binary, last timestamp_ntz, dropped bigint", "append", GroupStateTimeout.NoTimeout
    )


def low_pass(stream: DataFrame, tc_s: float, time_base_s: float = 1.0) -> DataFrame:
    return stateful(stream, lambda: LowPassStep(tc_s, time_base_s))


def running_mean(stream: DataFrame) -> DataFrame:
    return stateful(stream, RunningMean)


def frozen(stream: DataFrame) -> DataFrame:
    return stateful(stream, Frozen)


def pid(stream: DataFrame, p: PidParameters, yset: float, dt: float = 1.0) -> DataFrame:
    return stateful(stream, lambda: PidStep(p, yset, dt))


def windowed_mean(stream: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Means by time window; later samples than `delay` are left out."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy("series_id", F.window("at", width)).agg(F.avg("x").alias("mean"), F.count("x").alias("n")).select(
        "series_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "mean", "n"
    )


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into files in the shared folder, and read them."""
    spark: SparkSession = stream.sparkSession
    place = new_place(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
