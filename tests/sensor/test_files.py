"""Round trips of the sources and sinks."""

import pytest

from dipfleet.sources import files


def test_sensor_logs(spark, tmp_path):
    (tmp_path / "a7.txt").write_text("0,230\n\n40,100\n40,101\n")
    assert [tuple(r) for r in files.read_sensor_log(spark, str(tmp_path / "a7.txt")).orderBy("seq").collect()] == [("a7", 0, 0, 230.0), ("a7", 1, 40, 100.0), ("a7", 2, 40, 101.0)]
    (tmp_path / "b.txt").write_text("0,230\n40 100.5\nhello\n,5\n80\n 90 , 7 \n")
    assert [tuple(r)[2:] for r in files.read_sensor_log_lenient(spark, str(tmp_path / "b.txt")).orderBy("seq").collect()] == [(0, 230.0), (40, 100.5), (90, 7.0)]


def test_frame_counts(spark, tmp_path):
    detected = [{"class": "car", "confidence": 0.9, "bbox": [1, 2, 3, 4]}]
    columns = [c.split(" ")[0] for c in files.FRAME_COUNTS.split(", ")]
    row = [0.5, 2, 0, 0, 1, 1, 0, 0, 1, 1, 1, detected, 1]
    types = files.FRAME_COUNTS.replace("detected_objects string", f"detected_objects {files.DETECTED}")
    files.write_csv(spark.createDataFrame([tuple(row)], types), str(tmp_path / "f"))
    back = files.read_frame_counts(spark, str(tmp_path / "f")).first()
    assert [back[c] for c in columns if c != "detected_objects"] == [x for x in row if x is not detected]
    assert back.detected_objects[0].bbox == [1, 2, 3, 4]


def test_dips_and_tables(spark, tmp_path):
    columns = [c.split(" ")[0] for c in files.DIP_FEATURES.split(", ")]
    values = {c: 1.5 for c in columns} | {"object": "V", "frame_count": 3, "start_frame_idx": 0, "end_frame_idx": 2, "dip_array": [1.0, 2.0], "shape_category": "Noise"}
    df = spark.createDataFrame([tuple(values[c] for c in columns)], files.DIP_FEATURES.replace("dip_array string", "dip_array array<double>"))
    files.write_csv(df, str(tmp_path / "d"))
    assert files.read_dip_features(spark, str(tmp_path / "d")).first() == df.first()
    files.write_table(df, str(tmp_path / "t"), ("object",))
    assert spark.read.parquet(str(tmp_path / "t")).where("object = 'V'").first().dip_array == [1.0, 2.0]


def test_column_mapping(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0, 0, 1)], "t double, ultrawide_depth_m double, vehicles_in_frame int, bicycles_in_frame int, people_in_frame int")
    assert files.with_column_mapping(df, {"time": "t"}).columns == ["time", "depth", "vehicles", "bicycles", "people"]
    with pytest.raises(ValueError, match="time_seconds"):
        files.with_column_mapping(df)


def test_logs_to_results(spark, tmp_path, caplog):
    """A log and frame counts to merged tables and dips; a log without dips warns and writes none."""
    from dipfleet.jobs import files as jobs

    for name, depth in (("7", 100.0), ("8", 230.0)):
        line = [(t, depth if 2000 <= t < 3500 else 230.0) for t in range(0, 6000, 50)]
        folder = tmp_path / f"log{name}"
        folder.mkdir()
        (folder / f"{name}.txt").write_text("".join(f"{t},{d}\n" for t, d in line))
    frames = spark.createDataFrame([(int(s), f, f / 4.0, 0, 0, int(8 <= f < 14)) for s in "78" for f in range(24)], "sensor_id long, frame_number long, time_seconds double, people_in_frame long, bicycles_in_frame long, vehicles_in_frame long")
    assert jobs.merge_and_dips(spark, str(tmp_path / "log7"), frames.where("sensor_id = 7"), str(tmp_path / "out7"), 0.0)
    dips = spark.read.csv(str(tmp_path / "out7" / "dips"), header=True).collect()
    assert [(r.object, float(r.min_depth)) for r in dips] == [("V", 100.0)]
    assert spark.read.parquet(str(tmp_path / "out7" / "frames_with_depth")).count() == 24
    assert not jobs.merge_and_dips(spark, str(tmp_path / "log8"), frames.where("sensor_id = 8"), str(tmp_path / "out8"), 0.0)
    assert "no dips found" in caplog.text and not (tmp_path / "out8" / "dips").exists()
    report = jobs.log_to_report(spark, str(tmp_path / "log7")).collect()
    assert [(r.sensor_id, r.events) for r in report] == [("7", 1)]


def test_the_log_is_read_once(spark, tmp_path, monkeypatch):
    """Neither table of the alignment job, nor the dips, go back to the log."""
    from dipfleet.jobs import files as jobs

    (tmp_path / "7.txt").write_text("".join(f"{t},{100.0 if 2000 <= t < 3500 else 230.0}\n" for t in range(0, 6000, 50)))
    plans, write_table, write_csv = [], files.write_table, files.write_csv
    told = lambda write: lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *more)
    monkeypatch.setattr(files, "write_table", told(write_table))
    monkeypatch.setattr(files, "write_csv", told(write_csv))
    frames = spark.createDataFrame([(7, f, f / 4.0, 0, 0, 1) for f in range(24)], "sensor_id long, frame_number long, time_seconds double, people_in_frame long, bicycles_in_frame long, vehicles_in_frame long")
    assert jobs.merge_and_dips(spark, str(tmp_path / "7.txt"), frames, str(tmp_path / "out"), 0.0)
    assert len(plans) == 3 and all("device_log" not in p and "python" not in p.lower() for p in plans)
    assert "Window" not in plans[2]
