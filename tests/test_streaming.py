"""The stream path: windows close once the watermark has passed them, and hold what a batch over the same rows holds."""

import datetime as dt

from pyspark.sql import functions as F

from circlet.streaming.windows import event_stream, windowed_counts


def test_windows_of_a_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(hours=5 * i), "ab"[i % 2], float(i)) for i in range(20)]
    early, late = rows[:12], [*rows[12:], (day, "a", 99.0)]
    folder = str(tmp_path / "in")
    for i, part in enumerate((early, late)):
        spark.createDataFrame(part, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        stream = windowed_counts(event_stream(spark, folder, schema))
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive, i
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of the first day that came after its window had closed is left out.
    batch = windowed_counts(spark.createDataFrame(rows, "ts timestamp, event_type string, value double"))
    want = {(r.window_start, r.event_type): (r.n, r.total) for r in batch.collect()}
    closed = {k: v for k, v in want.items() if k[0] + dt.timedelta(days=1) <= rows[-1][0] - dt.timedelta(hours=1)}
    assert got == closed and len(got) == 6
    assert windowed_counts(spark.createDataFrame(rows, "ts timestamp, event_type string, value double").where(F.lit(False))).count() == 0
