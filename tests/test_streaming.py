import numpy as np
from pyspark.sql import functions as F
from tests.test_detectors import drops

from tidewater.functions import detectors as D
from tidewater.streaming import frames as S


def _run(spark, df, name, **options):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    for k, v in options.items():
        q = q.option(k, v)
    q = q.start()
    q.awaitTermination(180)
    return spark.table(name)


def test_tracker_in_batches_equals_the_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(1)
    rows = [(u, i, float(rng.gamma(2, 50))) for u in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    for k in range(3):
        df.where(f"event_id >= {20 * k} AND event_id < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.user_id, r.event_id): r.baseline for r in _run(spark, S.baseline_stream(stream), "baselines").collect()}
    for u in range(3):
        want = D.quantile_baseline(np.array([v for x, _, v in rows if x == u]), 0.2, 30, 1.0)
        np.testing.assert_allclose([got[u, i] for i in range(60)], want)


def test_band_noise_stream_equals_the_clip(spark, tmp_path):
    x = drops(2)
    n = len(x) // 512
    df = spark.createDataFrame([("d", t, x[t * 512 : (t + 1) * 512].tolist()) for t in range(n)], "device string, frame_no long, samples array<double>")
    for k in range(2):
        df.where(f"frame_no {'<' if k == 0 else '>='} 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.frame_no: r.noise for r in _run(spark, S.band_noise_stream(stream), "noises").collect()}
    np.testing.assert_allclose([got[t] for t in range(n)], [r["noise"] for r in D.band_noise(x)[0]])


def test_telemetry_emits_closed_intervals(spark, tmp_path):
    df = spark.range(240).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "in"))
    assert S.telemetry(df).count() == 8
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, S.telemetry(stream, late="0 seconds"), "minutes")
    assert got.count() == 6 and got.agg(F.sum("n")).first()[0] == 180  # the last minute is still open
