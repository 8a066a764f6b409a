"""Multi-object tracking per video: sequential over frames, in parallel over videos and over parts of them that cannot meet."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import hypot, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.functions.graph import linked_parts
from dipfleet.functions.params import CLASS_NAMES, TrackParams
from dipfleet.functions.series import numbered, so_far
from dipfleet.functions.storage import checkpointed

COLUMNS = "frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long, object_id long, is_new boolean"


def reach(params: TrackParams) -> float | None:
    """Boxes whose centres are so many mean sizes apart, or more, never match; None where any distance may."""
    return 2.0 * (1.0 - (params.similarity - 0.4) / 0.6) if params.similarity >= 0.4 else None


class Tracker:
    """The active tracks of one video, in the order of their ids. Only running sums of a track's history are kept, so a long track
    costs no more. Plain numbers: a video has few tracks at a time, and most are out of reach of a box."""

    FIELDS = ("id", "first", "last", "n", "x1", "y1", "x2", "y2", "area", "ratios", "ratio_sum", "area_sum", "area_m2", "counted")

    def __init__(self, params: TrackParams, state: Iterable[Sequence[float]] = (), next_id: int = 1):
        self.params, self.next_id = params, next_id
        self.tracks = [list(t) for t in state]
        far = reach(params)
        self.far = float("inf") if far is None else far * far * (1 + 1e-9)

    def expire(self, frame: int) -> None:
        self.tracks = [t for t in self.tracks if frame - t[2] <= self.params.retention_frames]

    def match(self, box: Sequence[float], area: float) -> list | None:
        """The track most similar to a box, if it is so beyond the threshold; the first created wins ties."""
        cx, cy, best, found, far = box[0] + box[2], box[1] + box[3], self.params.similarity, None, self.far
        for t in self.tracks:
            dx, dy, other = t[4] + t[6] - cx, t[5] + t[7] - cy, t[8]
            size = (area + other) / 2  # the square of the mean size
            if (dx * dx + dy * dy) / 4 > far * (0.0 if size < 0.0 else size):
                continue
            most = area if area > other else other
            like = (other if area > other else area) / most * 0.4 if most > 0 else 0.0
            if size > 0:
                close = 1 - hypot(dx, dy) / 2 / sqrt(size) / 2
                if close > 0:
                    like += close * 0.6
            if like > best:
                best, found = like, t
        return found

    def observe(self, frame: int, box: Sequence[float], class_id: int) -> tuple[int, bool]:
        """The track of a detection, and whether it is counted here for the first time."""
        w, h = box[2] - box[0], box[3] - box[1]
        area = w * h
        t = self.match(box, area)
        if t is None:
            t = [self.next_id, frame, frame, 0, *box, area, 0, 0, 0, 0, 0]
            self.tracks.append(t)
            self.next_id += 1
        t[2], t[4:8], t[8] = frame, box, area
        if h > 0:
            t[9], t[10] = t[9] + 1, t[10] + w / h
        t[3] += 1
        before = t[11] / (t[3] - 1) if t[3] > 1 else 0.0
        t[11] += area
        t[12] += (area - before) * (area - t[11] / t[3])
        new = not t[13] and self.counts(t, frame, class_id)
        t[13] = float(bool(t[13]) or new)
        return int(t[0]), new

    def counts(self, t: Sequence[float], frame: int, class_id: int) -> bool:
        p, seconds = self.params, (frame - t[1]) / self.params.fps
        kind = CLASS_NAMES.get(class_id)
        if kind == "person":
            return seconds >= p.person_seconds
        if kind != "car":
            return seconds > p.other_seconds
        if seconds < p.vehicle_seconds or not t[9] or not p.min_aspect <= t[10] / t[9] <= p.max_aspect:
            return False
        mean = t[11] / t[3]
        return not (t[3] > 2 and mean > 0 and (max(t[12], 0.0) / t[3]) ** 0.5 / mean > p.max_area_cv)


def stepped(tracker: Tracker, frames: Sequence[int], classes: Sequence[int], boxes: Sequence[Sequence[float]]) -> tuple[list[int], list[bool]]:
    """Step through detections in order: the track of each, and whether it is counted there for the first time."""
    ids, news, last = [], [], None
    for frame, class_id, box in zip(frames, classes, boxes, strict=True):
        if frame != last:
            tracker.expire(frame)
            last = frame
        i, new = tracker.observe(frame, box, class_id)
        ids.append(i)
        news.append(new)
    return ids, news


def plain(rows: pd.DataFrame) -> tuple[list, list, list]:
    return rows["frame_number"].tolist(), rows["class_id"].tolist(), rows[["x1", "y1", "x2", "y2"]].to_numpy(float).tolist()


WANTED = ("frame_number", "det_idx", "class_id", "x1", "y1", "x2", "y2")


def track_parts(parts: DataFrame, params: TrackParams, keys: Sequence[str]) -> DataFrame:
    """Track every `_part` of a video by itself; ids count from 1 in each, and `_born` marks the rows that make a track.

    A task takes its parts one after the other, as they come in batches of sorted rows: many small parts share a batch, and of a long
    one only its tracks are held.
    """
    by = [*keys, "_part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, part = None, None
        for rows in batches:
            frames, classes, boxes = plain(rows)
            begins = np.flatnonzero(rows[by].ne(rows[by].shift()).any(axis=1).to_numpy()).tolist()
            ids, news, born = [], [], []
            for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
                if (here := tuple(rows[c].iloc[a] for c in by)) != part:
                    tracker, part = Tracker(params), here
                most = tracker.next_id
                i, new = stepped(tracker, frames[a:b], classes[a:b], boxes[a:b])
                ids += i
                news += new
                for k in i:  # a new track has the next number
                    born.append(int(k == most))
                    most += k == most
            yield rows.assign(object_id=np.array(ids, "int64"), is_new=np.array(news, bool), _born=np.array(born, "int32"))

    schema = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys) + ", _part long, " + COLUMNS + ", _born int"
    placed = parts.select(*by, *WANTED).repartition(*by).sortWithinPartitions(*by, "frame_number", "det_idx")
    return placed.mapInPandas(run, schema)


def track_objects(detections: DataFrame, params: TrackParams = TrackParams(), keys: Sequence[str] = ("video_id",)) -> DataFrame:  # noqa: B008
    """Track the boxes of every video; ids count from 1 in each. Rows without a video are left out.

    Tracks live in small state, but frames follow each other. Long videos are therefore cut where no detection comes
    for longer than the retention: every track has expired there, so parts are independent and track in parallel; ids
    are renumbered afterwards, by a running sum of the tracks made in the parts before.
    """
    w = Window.partitionBy(*keys).orderBy("frame_number", "det_idx")
    cut = F.coalesce(F.col("frame_number") - F.lag("frame_number").over(w) > params.retention_frames, F.lit(False))
    named = detections.na.drop(subset=list(keys))
    parts = named.withColumn("_cut", cut.cast("int")).withColumn("_part", F.sum("_cut").over(so_far(w)))
    before = Window.partitionBy(*keys).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    tracked = track_parts(parts, params, keys).withColumn("object_id", F.col("object_id") + F.coalesce(F.sum("_born").over(before), F.lit(0)))
    return tracked.drop("_part", "_born")


#: Detections that are tracked in one call, about: parts are small, so several go together.
BUNDLE = 4_096


def reachable_parts(detections: DataFrame, params: TrackParams, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Detections with `_part`, and `_bundles` for each video: those of different parts of a video can never come to one track, nor
    vie for one.

    A track is matched by its last box, at most the retention before, within `reach` mean sizes. Boxes are dealt into cells of a
    quarter of that reach (of the video's largest box) and of the retention's frames; a cell keeps the bounds of its centres and
    frames and its largest area. Cells link if boxes within these bounds might match, and linked cells are one part. Cells
    meet by an equi-join on the neighbourhood, so a crowd costs its occupied cells, not its pairs of boxes.
    """
    far, span = reach(params), params.retention_frames + 1
    area = F.greatest((F.col("x2") - F.col("x1")).cast("double") * (F.col("y2") - F.col("y1")), F.lit(0.0))
    boxes = detections.withColumns({"_cx": (F.col("x1") + F.col("x2")) / 2.0, "_cy": (F.col("y1") + F.col("y2")) / 2.0, "_area": area})
    sides = boxes.groupBy(*keys).agg(F.greatest(F.sqrt(F.max("_area")) * far, F.lit(1.0)).alias("_side"), F.ceil(F.count("*") / BUNDLE).alias("_bundles"))  # a row for each video
    cell = {"_fx": F.floor(F.col("_cx") * 4 / F.col("_side")), "_fy": F.floor(F.col("_cy") * 4 / F.col("_side")), "_fb": F.floor(F.col("frame_number") / span)}
    boxes = boxes.join(sides, list(keys)).withColumns(cell).withColumn("_node", F.xxhash64(*keys, *cell))  # equal hashes only join parts
    bounds = [f(c).alias(f"{n}{e}") for c, n in (("_cx", "x"), ("_cy", "y"), ("frame_number", "f")) for f, e in ((F.min, "0"), (F.max, "1"))]
    nodes = boxes.groupBy(*keys, "_node", "_fx", "_fy", "_fb").agg(*bounds, F.max("_area").alias("area"))
    nodes = checkpointed(nodes.withColumns({"_bx": F.floor(F.col("_fx") / 4), "_by": F.floor(F.col("_fy") / 4)}).drop("_fx", "_fy"))
    kept = ["_node", "x0", "x1", "y0", "y1", "f0", "f1", "area"]
    there = nodes.select(*keys, "_bx", "_by", "_fb", *[F.col(c).alias(f"o_{c}") for c in kept])
    steps = lambda *by: F.explode(F.array(*[F.lit(k) for k in by]))
    here = nodes.withColumn("_dx", steps(-1, 0, 1)).withColumn("_dy", steps(-1, 0, 1)).withColumn("_df", steps(0, 1))
    here = here.select(*keys, (F.col("_bx") + F.col("_dx")).alias("_bx"), (F.col("_by") + F.col("_dy")).alias("_by"), (F.col("_fb") + F.col("_df")).alias("_fb"), *kept)
    apart = lambda n: F.greatest(F.col(f"{n}0") - F.col(f"o_{n}1"), F.col(f"o_{n}0") - F.col(f"{n}1"), F.lit(0)).cast("double")
    near = (F.hypot(apart("x"), apart("y")) <= F.sqrt((F.col("area") + F.col("o_area")) / 2) * far * (1 + 1e-9)) & (apart("f") <= params.retention_frames)
    links = here.join(there, [*keys, "_bx", "_by", "_fb"]).where(near & (F.col("_node") != F.col("o__node")))
    parts = linked_parts(links.select(F.col("_node").alias("a"), F.col("o__node").alias("b")))
    return boxes.join(parts, boxes["_node"] == parts["node"], "left").withColumn("_part", F.coalesce("part", "_node")).drop("_cx", "_cy", "_area", "_side", *cell, "_node", "node", "part")


def track_crowded(detections: DataFrame, params: TrackParams = TrackParams(), keys: Sequence[str] = ("video_id",)) -> DataFrame:  # noqa: B008
    """`track_objects` for videos without gaps: parts of a video that cannot reach each other are tracked in parallel.

    Tracks never leave their part and are created in the same order, so only their numbers differ: they are counted anew by
    the first detection of each, in stretches of frames. Parts are tracked in bundles of some thousand detections; a video of no more than one
    bundle is tracked as it is, without a search for its parts. A threshold below 0.4 lets any two boxes match: then gaps alone cut.
    """
    if reach(params) is None:
        return track_objects(detections, params, keys)
    boxes = detections.select(*keys, *WANTED)
    sizes = checkpointed(boxes.groupBy(*keys).agg((F.count("*") > BUNDLE).alias("_crowded")))  # a row for each video
    crowded = lambda yes: boxes.join(sizes.where(F.col("_crowded") == yes).drop("_crowded"), list(keys))
    columns = [*keys, *WANTED, "object_id", "is_new"]
    few = track_parts(crowded(False).withColumn("_part", F.lit(0).cast("long")), params, keys).select(columns)
    if sizes.where("_crowded").isEmpty():
        return few
    parts = reachable_parts(checkpointed(crowded(True)), params, keys).withColumn("_part", F.pmod(F.xxhash64("_part"), F.col("_bundles")))
    tracked = checkpointed(track_parts(parts, params, keys).drop("_born"))
    tracks = tracked.groupBy(*keys, "_part", F.col("object_id").alias("_own")).agg(F.min(F.struct("frame_number", "det_idx")).alias("_first"))
    tracks = tracks.withColumn("_video", F.struct(*keys))
    ids = numbered(tracks, "_video", F.floor(F.col("_first.frame_number") / (params.retention_frames + 1)), ["_first"], "_id").select(*keys, "_part", "_own", "_id")
    joined = tracked.withColumnRenamed("object_id", "_own").join(ids, [*keys, "_part", "_own"])
    return joined.withColumn("object_id", F.col("_id")).select(columns).unionByName(few)
