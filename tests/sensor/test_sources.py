"""Device logs by offsets, whole and as they grow; lines that hold nothing; bucketed tables; sessions."""

import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import CompactParams, DipParams
from dipfleet.operators import features, segment
from dipfleet.sources import devicelog, files
from dipfleet.streaming import live

COMPACT = CompactParams(calibration_samples=5, capacity=6)


def offsets(text):
    at, out = 0, []
    for line in text.split(b"\n"):
        out.append((at, line.decode("utf-8", "replace").rstrip("\r")))
        at += len(line) + 1
    return out[:-1] if text.endswith(b"\n") else out


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_every_line_once_in_pieces(spark, tmp_path, piece):
    rnd = random.Random(piece)
    want = []
    for name in ("a.txt", "b.log"):
        lines = [rnd.choice([b"10,20.5", b"", b"7 8", b"x" * rnd.randint(0, 90), "é日".encode(), b"1,2\r"]) for _ in range(60)]
        text = b"\n".join(lines) + rnd.choice([b"", b"\n"])
        (tmp_path / name).write_bytes(text)
        want += [(name[0], at, line) for at, line in offsets(text)]
    (tmp_path / "_SUCCESS").write_bytes(b"no log\n")
    got = devicelog.log_lines(spark, str(tmp_path), piece=piece).collect()
    assert sorted((r.sensor_id, r["at"], r.line) for r in got) == sorted(want)


def test_bad_lines(spark, tmp_path):
    text = "10,20.5\nrestarted\n\n 11 7\n12\n99999999999999999999,1\n13,4 tail\n"
    (tmp_path / "s.txt").write_text(text)
    lines = devicelog.log_lines(spark, str(tmp_path))
    assert [tuple(r) for r in devicelog.log_samples(lines).orderBy("seq").collect()] == [("s", 0, 10, 20.5), ("s", 19, 11, 7.0), ("s", 51, 13, 4.0)]
    bad = devicelog.bad_lines(lines).orderBy("at").collect()
    assert [(r["at"], r.line, r.reason) for r in bad] == [(8, "restarted", "not a time and a distance"), (25, "12", "not a time and a distance"), (28, "99999999999999999999,1", "a number out of range")]
    assert devicelog.log_lines(spark, str(tmp_path / "none")).count() == 0


def test_bad_frame_counts(spark, tmp_path):
    good = "0.0,0,1,0,0,1,0,0,0,0,0,\"[]\",1"
    (tmp_path / "f.csv").write_text(",".join(c.split(" ")[0] for c in files.FRAME_COUNTS.split(", ")) + f"\n{good}\n0.25,one,1,0,0,1,0,0,0,0,0,\"[]\",1\nshort\n{good}\n")
    bad = files.bad_frame_counts(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in bad) == ["0.25,one,1,0,0,1,0,0,0,0,0,\"[]\",1", "short"] and all(r.file.endswith("f.csv") for r in bad)
    assert any("frame_number" in r.reason for r in bad)


def comparable(df, columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_a_log_that_grows_is_read_once(spark, tmp_path):
    """Lines come in pieces that end within a line; the stream is stopped and started anew between them."""
    rnd, logs = random.Random(51), {}
    for k in range(3):
        t, low, text = 0, False, ""
        for i in range(150):
            t += rnd.choice([40, 50, 90, 150, 260])
            low = not low if rnd.random() < (0.15 if i > 8 else 0) else low
            text += f"{t},{float(rnd.randint(50, 190) if low else rnd.randint(224, 226))}\n"
        logs[f"s{k}"] = text.encode()
    live.use_rocksdb(spark)
    (tmp_path / "log").mkdir()
    for part in range(4):
        for name, text in logs.items():
            a, b = len(text) * part // 4, len(text) * (part + 1) // 4
            with open(tmp_path / "log" / f"{name}.txt", "ab") as out:
                out.write(text[a:b])
        samples = devicelog.log_samples(devicelog.log_lines(spark, f"{tmp_path}/log", stream=True, piece=500))
        feed = samples.withColumn("sensor_id", F.substring("sensor_id", 2, 9).cast("long")).withColumn("kind", F.lit(live.SAMPLE))
        live.run_to_end(live.compact_live_detector(feed, COMPACT), str(tmp_path))
        raw = samples.select("sensor_id", "seq").writeStream.format("parquet").option("path", f"{tmp_path}/raw").option("checkpointLocation", f"{tmp_path}/raw_state").trigger(availableNow=True).start()
        raw.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == spark.read.parquet(f"{tmp_path}/raw").distinct().count() == 450
    batch = files.read_sensor_log(spark, f"{tmp_path}/log").withColumn("sensor_id", F.substring("sensor_id", 2, 9).cast("long"))
    columns = ["sensor_id", "time_ms", "close_ms", "samples", "duration_ms", "variance", "type"]
    want = comparable(segment.segment_events_compact(batch, COMPACT), columns)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert len(want) > 5 and got.where("late").count() == 0 and comparable(got, columns) == want


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    rows = [(k, i, i * 50, 100.0 + i % 7 if i % 40 < 9 else 230.0) for k in range(9) for i in range(200)]
    samples = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
    files.write_bucketed(samples, "samples_by_sensor", f"{tmp_path}/table", buckets=4)
    stored = spark.table("samples_by_sensor")
    dips = features.dip_features(segment.dip_slices(stored, DipParams()), DipParams())
    columns = ["sensor_id", "dip_id", "frame_count", "depth_variance", "shape_category"]
    assert comparable(dips, columns) == comparable(features.dip_features(segment.dip_slices(samples, DipParams()), DipParams()), columns)
    assert "Exchange" not in dips._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table samples_by_sensor")


def test_sessions(spark, tmp_path):
    rnd, rows = random.Random(52), []
    for k in range(5):
        t = 1000
        for i in range(120):
            t += rnd.choice([40, 100, 299, 300, 301, 700])
            rows.append((k, i, t, float(rnd.choice([100, 150, 230]))))
    samples = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
    want = []
    for k in range(5):
        held = []
        for _, _, t, d in (r for r in rows if r[0] == k and r[3] < 215):
            if held and t - held[-1] > 300:
                want.append((k, held[0], held[-1], len(held)))
                held = []
            held.append(t)
        want.append((k, held[0], held[-1], len(held)))
    columns = ["sensor_id", "start_ms", "last_ms", "samples"]
    assert comparable(segment.session_events(samples, 215.0), columns) == sorted(want)
    last = spark.createDataFrame([(-1, 0, 10**9, 100.0)], samples.schema)
    for part in (samples.where("seq < 50"), samples.where("seq >= 50"), last):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = live.reordered(live.sample_feed(spark, f"{tmp_path}/in", samples.schema), 60_000)
    got = live.run_to_end(segment.session_events(feed, 215.0), str(tmp_path))
    assert comparable(got.where("sensor_id >= 0"), columns) == sorted(want)


def test_small_logs_share_tasks_and_batches(spark, tmp_path):
    """A thousand logs were a thousand tasks."""
    rows = [(f"s{k}", t, t % 20, 40 * t, 200.0 + t) for k in range(1000) for t in range(3)]
    df = spark.createDataFrame(rows, "sensor_id string, n long, seq long, time_ms long, distance double").drop("n")
    files.write_sensor_log(df, f"{tmp_path}/log")
    assert len(list(tmp_path.glob("log/sensor_id=*/*.txt"))) == 1000 and not list(tmp_path.glob("log/*/_*"))
    reader = devicelog.LogReader(f"{tmp_path}/log", devicelog.PIECE)
    assert len(reader.partitions()) == 8
    assert sum(b.num_rows for b in devicelog.read_bundle(reader.partitions()[0])) == 384 and len(list(devicelog.read_bundle(reader.partitions()[0]))) == 1
    assert sorted(files.read_sensor_log(spark, f"{tmp_path}/log").collect()) == sorted(df.select("sensor_id", "seq", "time_ms", "distance").collect())


def test_logs_of_awkward_sensors_and_values(spark, tmp_path):
    df = spark.createDataFrame([("a b/c=d", 0, 0, 1.5), ("a b/c=d", 1, 40, None), (None, 0, 0, 2.5), ("é", 0, 7, 1e-7)], "sensor_id string, seq long, time_ms long, distance double")
    files.write_sensor_log(df, f"{tmp_path}/log")
    got = {tuple(r) for r in files.read_sensor_log(spark, f"{tmp_path}/log").collect()}
    assert got == {("a b%2Fc%3Dd", 0, 0, 1.5), ("a b%2Fc%3Dd", 1, 40, None), ("__HIVE_DEFAULT_PARTITION__", 0, 0, 2.5), ("é", 0, 7, 1e-7)}
