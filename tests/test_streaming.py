import numpy as np

from modeloom.streaming import online


def test_modes_sum_to_the_signal():
    t = np.arange(1500) / 1500
    x = np.cos(2 * np.pi * 60 * t) + np.cos(2 * np.pi * 9 * t) + t
    for chunk in (1500, 50, 7):
        modes = online.online_emd(x, chunk)
        assert np.allclose(modes.sum(0), x, atol=1e-9)
        assert np.corrcoef(modes[0], np.cos(2 * np.pi * 60 * t))[0, 1] > 0.95


def test_chunks_do_not_change_the_result():
    x = np.random.default_rng(4).normal(size=400).cumsum()
    assert np.allclose(online.online_emd(x, 400), online.online_emd(x, 23))


def test_stream(spark, tmp_path):
    t = np.arange(300)
    x = np.sin(t) + 0.01 * t
    source = tmp_path / "in"
    for i in range(0, 300, 100):
        rows = [("a", int(k), float(x[k])) for k in t[i : i + 100]]
        spark.createDataFrame(rows, "series_id string, t bigint, value double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("series_id string, t bigint, value double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    q = online.stream_emd(stream, 6, 2).writeStream.format("memory").queryName("online_modes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT mode, t, value FROM online_modes").toPandas()
    stages, want = [], {}
    for i in range(0, 300, 100):
        for k, at, values in online.advance(stages, x[i : i + 100], 6, 2):
            want |= {(k, at + j): v for j, v in enumerate(values)}
    assert len(got) == len(want) and all(abs(want[r.mode, r.t] - r.value) < 1e-9 for r in got.itertuples())
