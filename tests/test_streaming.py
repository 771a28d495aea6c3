"""Streaming assessment equals the batch assessment on the same readings."""

import tempfile

from cellscope.streaming import start_assessment
from cellscope.sources import read_table, telemetry
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    import __spark_entry__ as E
    ck = tempfile.mkdtemp(prefix="cellscope-stream-", dir="/tmp")
    q = start_assessment(spark, SF_SMALL, telemetry(spark, SF_SMALL), "memory", query_name="assessed_test",
                         checkpoint=ck, glob="events.parquet")
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from assessed_test")
    ref = E.queries()["health_status"](spark, SF_SMALL)
    assert got.count() == ref.count() == read_table(spark, SF_SMALL, "events").count()
    diff = got.selectExpr("battery_id", "seq", "round(health_score, 6) as h", "status") \
        .exceptAll(ref.selectExpr("battery_id", "seq", "health_score as h", "status"))
    assert diff.count() == 0


def test_stream_soc_range_across_batches_equals_window(spark):
    """Three micro-batches (files split by seq range): the stateful stream equals the plain
    per-battery trailing window over all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cellscope.sources.telemetry import telemetry_from_events
    from cellscope.streaming import stream_soc_range
    src = tempfile.mkdtemp(prefix="cellscope-events-", dir="/tmp")
    ev = read_table(spark, SF_SMALL, "events")
    n = ev.count()
    for i in range(3):
        ev.where((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3)) \
            .coalesce(1).write.parquet(f"{src}/part{i}")
    files = sorted(__import__("glob").glob(f"{src}/part*/*.parquet"))
    flat = tempfile.mkdtemp(prefix="cellscope-flat-", dir="/tmp")
    import shutil
    import os
    import time as _time
    base = _time.time() - 1000
    for i, f in enumerate(files):  # the file source orders by modification time
        shutil.copy(f, f"{flat}/b{i}.parquet")
        os.utime(f"{flat}/b{i}.parquet", (base + 10 * i, base + 10 * i))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    out = stream_soc_range(telemetry_from_events(stream))
    ck = tempfile.mkdtemp(prefix="cellscope-ck-", dir="/tmp")
    q = out.writeStream.outputMode("append").format("memory").queryName("soc_stream") \
        .option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from soc_stream")
    t = telemetry(spark, SF_SMALL)
    w = Window.partitionBy("battery_id").orderBy("seq").rowsBetween(-9, 0)
    ref = t.select("battery_id", "seq", F.when(F.count("SOC").over(w) == 10,
                                               F.max("SOC").over(w) - F.min("SOC").over(w)).alias("r2"))
    j = got.join(ref, ["battery_id", "seq"])
    assert got.count() == n and j.count() == n
    assert j.where(~F.col("soc_range_rolling").eqNullSafe(F.col("r2"))).count() == 0
