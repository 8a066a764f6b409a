"""Crowded videos without gaps against the sequential model, and regions of any number."""

import random

from pyspark.sql import functions as F

from dipfleet.functions.graph import linked_parts
from dipfleet.functions.params import TrackParams
from dipfleet.operators import detections as det
from dipfleet.operators import tracking
from tests.sensor import machines

BOXES = "video_id long, frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long"


def crowd(rnd, videos, frames, walkers, wide=1200):
    rows = []
    for v in range(videos):
        at = [[rnd.uniform(0, wide), rnd.uniform(0, 600), rnd.uniform(-9, 9), rnd.uniform(-4, 4), rnd.choice([12, 25, 40]), rnd.randint(0, 2)] for _ in range(walkers)]
        for f in range(frames):
            seen = 0
            for w in at:
                w[0], w[1] = w[0] + w[2], w[1] + w[3]
                if rnd.random() < 0.7:
                    side = w[4] + rnd.randint(-3, 3)
                    x, y = int(w[0] + rnd.gauss(0, 2)), int(w[1] + rnd.gauss(0, 2))
                    rows.append((v, f, seen, w[5], x, y, x + side, y + (0 if rnd.random() < 0.01 else side + rnd.randint(-2, 9))))
                    seen += 1
                if rnd.random() < 0.02:
                    w[0], w[1] = rnd.uniform(0, wide), rnd.uniform(0, 600)
    return rows


def model(rows, params):
    want = {}
    for v in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == v), key=lambda r: r[:2])
        want.update({(v, r[0], r[1]): out for r, out in zip(mine, machines.track(mine, params))})
    return want


def test_crowded_videos(spark):
    for seed, params in ((1, TrackParams(fps=4.0, retention_frames=6)), (2, TrackParams(fps=4.0, retention_frames=2, similarity=0.45)), (3, TrackParams(fps=4.0, retention_frames=4, similarity=0.3))):
        rows = crowd(random.Random(seed), 2, 40, 14)
        got = tracking.track_crowded(spark.createDataFrame(rows, BOXES).repartition(3), params).collect()
        assert {(r.video_id, r.frame_number, r.det_idx): (r.object_id, r.is_new) for r in got} == model(rows, params) and len(got) == len(rows)


def test_one_video_is_many_parts(spark, monkeypatch):
    """A video without any gap is tracked in many bundles, with the same result."""
    params, rows = TrackParams(fps=4.0, retention_frames=6), crowd(random.Random(4), 1, 80, 12, 4000)
    df = spark.createDataFrame(rows, BOXES)
    assert df.select("frame_number").distinct().count() == 80
    monkeypatch.setattr(tracking, "BUNDLE", 100)
    parts = tracking.reachable_parts(df, params)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < len(rows) / 3 and parts.first()["_bundles"] > 5
    got = tracking.track_crowded(df, params).collect()
    assert {(r.video_id, r.frame_number, r.det_idx): (r.object_id, r.is_new) for r in got} == model(rows, params)


def test_no_boxes(spark):
    assert tracking.track_crowded(spark.createDataFrame([], BOXES)).count() == 0


def test_linked_parts(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)] + [(7, 7), (None, 3)]
    best = {n: n for pair in links for n in pair if None not in pair}
    while any(best[a] != best[b] for a, b in links if None not in (a, b)):
        for a, b in links:
            if None not in (a, b):
                best[a] = best[b] = min(best[a], best[b])
    got = {r.node: r.part for r in linked_parts(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: p for n, p in best.items() if any(n in (a, b) and a != b for a, b in links if None not in (a, b))}


def test_regions(spark):
    rnd = random.Random(6)
    boxes = [(v, f, i, 0, x, y, x + rnd.randint(0, 40), y + rnd.randint(0, 40)) for v in range(5) for f in range(30) for i in range(4) for x, y in [(rnd.randint(-50, 900), rnd.randint(-50, 700))]]
    boxes += boxes[:20]
    regions = [(v, rnd.randint(-20, 800), rnd.randint(-20, 600), rnd.choice([0, 20, 60, 90]), rnd.choice([0, 30, 70])) for v in range(3) for _ in range(12)]
    regions += [(0, 0, 0, 40_000, 50), (1, 100, 100, -5, 50), (3, None, 0, 10, 10)]
    holds = lambda b, r: None not in r and r[3] >= 0 and r[1] <= (b[4] + b[6]) / 2 <= r[1] + r[3] and r[2] <= (b[5] + b[7]) / 2 <= r[2] + r[4]
    want = sorted(b for b in boxes if b[0] == 4 or any(r[0] == b[0] and holds(b, r) for r in regions))
    df, rois = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(regions, "video_id long, x double, y double, w double, h double".replace("double", "long"))
    for small in (100_000, 0):
        out = det.roi_filter(df, rois, small=small)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert det.roi_filter(df, rois.limit(0)).count() == len(boxes) == det.roi_filter(df).count()
    assert out.columns == df.columns and out.where(F.col("video_id") == 3).count() == 0


def test_videos_of_one_bundle_are_tracked_as_they_are(spark, monkeypatch):
    """Parts are looked for in crowded videos alone; numbers of both kinds of video are the same as ever."""
    params, rows = TrackParams(fps=4.0, retention_frames=6), crowd(random.Random(7), 3, 40, 3, 4000) + [(9, *r[1:]) for r in crowd(random.Random(8), 1, 60, 12, 4000)]
    small = len([r for r in rows if r[0] != 9])
    monkeypatch.setattr(tracking, "BUNDLE", small)
    seen, search = [], tracking.reachable_parts
    monkeypatch.setattr(tracking, "reachable_parts", lambda df, *more: seen.append({r.video_id for r in df.select("video_id").distinct().collect()}) or search(df, *more))
    df = spark.createDataFrame(rows, BOXES)
    for wanted, mine in (([], df.where("video_id <> 9")), ([{9}], df)):
        got = tracking.track_crowded(mine, params).collect()
        assert {(r.video_id, r.frame_number, r.det_idx): (r.object_id, r.is_new) for r in got} == model([r for r in rows if wanted or r[0] != 9], params)
        assert seen == wanted


def test_parts_are_tracked_once(spark):
    """A part is stepped through in one pass, across batches; gaps cut, and numbers go on behind them."""
    params = TrackParams(fps=4.0, retention_frames=6)
    rows = [(v, f + 100 * (f // 20), *more) for v, f, *more in crowd(random.Random(9), 3, 80, 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = tracking.track_objects(spark.createDataFrame([*rows, (None, *rows[0][1:])], BOXES), params)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan.split("== Initial Plan ==")[0].count("InPandas") == 1
    assert {(r.video_id, r.frame_number, r.det_idx): (r.object_id, r.is_new) for r in got} == model(rows, params) and len(got) == len(rows)
