"""Data sets that grow with a stream, batch by batch, with restarts from the checkpoint."""

from datetime import datetime, timedelta

import pytest

from sigmill.streaming import dataset

START = datetime(2024, 1, 1)


def point(series, minute, signal, x):
    return series, START + timedelta(minutes=minute), signal, x


BATCHES = [
    [point("a", 0, "u", 1.0), point("a", 1, "u", 2.0), point("b", 0, "v", 5.0), point("a", 1, "u", 9.0)],
    [point("a", 3, "y", 7.0), point("a", 2, "u", None), point("b", 30, "v", 6.0)],
    [point("a", 90, "u", 4.0), point("b", 90, "w", 8.0)],
    [point("c", 2000, "z", 0.0), point("a", 4, "u", 1.0), point("a", 5, "u", 3.0)],
    [point("c", 3000, "z", 0.0)],
]


@pytest.mark.parametrize("restart", [True, False])
def test_signals_grow_by_batches(spark, tmp_path, restart):
    data, schema = f"{tmp_path}/data", "series_id string, ts timestamp_ntz, signal string, x double"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        query = dataset.appended(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return dataset.left_out(query)

    gone = 0
    for rows in BATCHES:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
        if restart:
            gone += run()  # each batch by a query of its own, which reads the state of the one before
    if not restart:
        gone = run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    rows = {(g.series_id, g.signal, g.k): g.x for g in got}
    assert len(rows) == len(got) == 10 + 6 + 1
    times = {(g.series_id, g.k): g.ts for g in got}
    assert [times["a", k] for k in range(5)] == [START + timedelta(minutes=m) for m in (0, 1, 2, 3, 90)]
    a_u = [rows["a", "u", k] for k in range(5)]
    a_y = [rows["a", "y", k] for k in range(5)]
    assert a_u == [1.0, 2.0, None, None, 4.0] and a_y == [None, None, None, 7.0, None]  # y is filled back
    assert [rows["b", s, k] for s in "vw" for k in range(3)] == [5.0, 6.0, None, None, None, 8.0]
    # Minutes 4 and 5 came when the rows up to minute 20 were made.
    assert gone == 2
