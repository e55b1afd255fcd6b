import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_detectors import RATE, drops

from tidewater.operators import detectors as O
from tidewater.plans import batch
from tidewater.sources import containers, keys, sinks


@pytest.fixture
def folder(tmp_path):
    x = (np.clip(drops(2), -1, 1) * 32767).astype(np.int16)
    (tmp_path / "true").mkdir()
    (tmp_path / "False").mkdir()
    files = {
        "true/pcm.bin": containers.pack_header(1_700_000_000, RATE, device="dev1", depth=0) + x.astype("<i2").tobytes() + b"\0",
        "False/big.bin": containers.pack_header(1_700_000_060, RATE, big=True) + x.astype(">i2").tobytes(),
        "raw.bin": x.astype("<i2").tobytes(),
        "alac.bin": containers.pack_header(5, RATE, version=1) + b"xyz",
        "depth.bin": containers.pack_header(5, RATE, depth=12) + b"xyzw",
        "short.bin": containers.pack_header(5, RATE) + x[:100].tobytes(),
        "empty.bin": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    containers.write_wav(str(tmp_path / "a.wav"), x)
    return str(tmp_path), x


def test_recordings(spark, folder):
    path, x = folder
    rows = {r.source_file.split("/")[-1]: r for r in containers.read_recordings(spark, path).collect()}
    assert len(rows) == 7  # Spark lists no empty files
    for name in ("pcm.bin", "big.bin", "raw.bin", "a.wav"):
        assert rows[name].signal == x.tolist() and rows[name].error is None and rows[name].duration == 2.0
    assert rows["pcm.bin"].device_id == "dev1" and rows["pcm.bin"].bit_depth == 16
    assert rows["pcm.bin"].time.replace(tzinfo=None) == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert "decoder" in rows["alac.bin"].error and "12 bits" in rows["depth.bin"].error
    assert containers.decode("empty.bin", b"")["signal"].tolist() == []
    assert containers.headers(spark, path).where("source_file LIKE '%alac.bin'").first().version == 1


def test_clips_and_processors(spark, folder):
    path, x = folder
    labels = keys.from_folder(spark, path)
    assert {r.source_file.split("/")[-1]: r.raining for r in labels.collect()}["big.bin"] is False
    clips = containers.to_clips(containers.read_recordings(spark, path), seconds=2.0).join(labels, "source_file")
    rows = {r.source_file.split("/")[-1]: r for r in batch.process(clips, [batch.rain_processor(), batch.noise_processor()]).collect()}
    assert rows["pcm.bin"].predicted and rows["pcm.bin"].mismatch is False and rows["big.bin"].mismatch
    assert rows["raw.bin"].mismatch is None and rows["short.bin"].rain__rain_drops is None and "samples" in rows["short.bin"].error
    with pytest.raises(ValueError):
        batch.process(clips, [batch.rain_processor(), batch.rain_processor()])


def test_frames_agree_with_metrics_for_any_partitioning(spark):
    clips = spark.createDataFrame([(f"c{i}", drops(2, 0.1 + 0.1 * i).tolist()) for i in range(4)], "source_file string, clip array<double>")
    want = None
    for n in (1, 4, 16):
        states = O.rain_frames(clips.repartition(n), confirm=True)
        got = sorted(map(tuple, O.rain_metrics(states).collect()))
        want = want or got
        assert got == want
    by_rows = O.exploded(states).groupBy("source_file").agg(F.count_if(F.col("frame_class") == 2).alias("n")).collect()
    assert {r.source_file: r.n for r in by_rows} == {r[0]: r[2] for r in want}


def test_minutes_grid_and_increments(spark):
    wet = np.tile(drops(10), 7)
    clips = spark.createDataFrame([("a", wet.tolist(), True, dt.datetime(2024, 1, 1)), ("b", [0.0] * len(wet), False, dt.datetime(2024, 1, 1))], "source_file string, clip array<double>, raining boolean, time timestamp")
    rows = O.minute_rows(clips).orderBy("source_file", "until").collect()
    assert [(r.source_file, r.until.minute, sum(r.dsd) > 0) for r in rows] == [("a", 1, True), ("a", 2, True), ("b", 1, False)]
    old = O.minute_rows(clips.where("source_file = 'b'")).withColumn("weighted_dsd_sum", F.lit(0.0))
    assert sorted(r.source_file for r in batch.incremental_histograms(old, clips).collect()) == ["a", "a", "b"]
    got = batch.grid_search(spark, clips, {"level": [1e-6, 10.0]}, lambda x, p: bool((x**2).mean() > p["level"]))
    assert {(r.level, r.tp, r.tn, r.fp, r.fn, r.accuracy) for r in got.collect()} == {(1e-6, 1, 1, 0, 0, 1.0), (10.0, 0, 1, 0, 1, 0.5)}
    left = batch.grid_search(spark, clips, {"level": [1e-6, 10.0]}, lambda x, p: None, done=got.select("param_hash"))
    assert left.count() == 0


def test_keys_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("raw_audio/d1/2024/01/02/20240102_03_04_05_000000_rain_ab.bin",), ("audio/d2/loc/1700000000",)], "source_file string")
    rows = containers.with_key_fields(df).orderBy("device_id").collect()
    assert rows[0].device_id == "d1" and rows[0].time == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[1].location == "loc"
    with pytest.raises(Exception, match="unknown key layout"):
        containers.with_key_fields(spark.createDataFrame([("x/y",)], "source_file string")).collect()
    with pytest.raises(ValueError):
        keys.discover(spark, "disc")
    assert keys.discover(spark, "list", most=1, keys=["b", "a"]).first().source_file == "a"
    wide = sinks.spread_matrix(spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0], None])], "k int, m array<array<double>>"), "m", 2)
    assert {r.k: r.m for r in sinks.restore_matrix(wide, "m").collect()} == {1: [[1.0], [2.0]], 2: None}
    path = f"file://{tmp_path}/table"
    sinks.upsert_parquet(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.upsert_parquet(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, sinks.read_current(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "table" / "version=9").mkdir()  # a writer that was cut off
    sinks.upsert_parquet(spark, spark.createDataFrame([(4, "e")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, sinks.read_current(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert sinks.read_current(spark, path + "x") is None
    for _ in range(2):  # a batch that is written again
        sinks.write_results(spark.createDataFrame([(1, "a")], "file_key int, v string"), f"{path}_results", batch="b1")
    assert spark.read.parquet(f"{path}_results").count() == 1
    sinks.write_json(spark.createDataFrame([(0.5, 1), (0.9, 2)], "accuracy double, k int"), f"{path}_json")
    assert [r.k for r in sinks.read_results_json(spark, f"{path}_json", "accuracy").collect()] == [2, 1]
    assert sinks.param_hash({"a": 1, "b": sinks.param_hash}) == sinks.param_hash({"b": sinks.param_hash, "a": 1})


def test_upsert_statement():
    import sqlite3

    c = sqlite3.connect(":memory:")
    c.execute("CREATE TABLE t (a INT, b INT, v TEXT, PRIMARY KEY (a, b))")
    c.execute("CREATE TABLE t_staged (a INT, b INT, v TEXT)")
    c.execute("INSERT INTO t VALUES (1, 1, 'old'), (1, 2, 'stays')")
    c.execute("INSERT INTO t_staged VALUES (1, 1, 'new'), (2, 1, 'added')")
    for _ in range(2):
        c.execute(sinks.upsert_sql("t", "t_staged", ["a", "b", "v"], ["a", "b"]))
    assert sorted(c.execute("SELECT * FROM t")) == [(1, 1, "new"), (1, 2, "stays"), (2, 1, "added")]
    assert sinks.upsert_sql("t", "s", ["a"], ["a"]).endswith("DO NOTHING")


def test_equal_keys_stay_apart(spark):
    clips = spark.createDataFrame([("a", drops(2).tolist(), True), ("a", drops(2).tolist(), False)], "source_file string, clip array<double>, raining boolean")
    assert batch.process(clips, [batch.rain_processor()]).count() == 2
    wet = clips.withColumn("clip", F.flatten(F.array_repeat("clip", 40))).withColumn("time", F.lit(dt.datetime(2024, 1, 1)))
    assert O.minute_rows(wet).count() == 2 * O.minute_rows(wet.limit(1)).count()
