"""Live detectors as keyed state machines; their output equals the batch operators on the same rows. Null distances arrive as NaN;
both are samples that enter no depth, variance or step.

State lives in the RocksDB state store: a few values and the open event per sensor, and the rows that wait. With a watermark
(`reordered`) rows wait until it has passed them, and are then stepped in order of (time, seq), by an event-time timer if
nothing else arrives for their key: rows may come in any order within the allowed delay, and a frame in any number of pieces.
Without one, rows are stepped as they come, in order within a micro-batch. Rows at or before the last step of their key are
late: they are not stepped, but come out as rows that are marked `late`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from dipfleet.functions.params import CompactParams, LiveParams, TrackParams
from dipfleet.operators.tracking import Tracker, plain, stepped

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE, TRIGGER = "sample", "trigger"
EVENTS = "sensor_id long, time_ms long, close_ms long, samples long, duration double, min_depth double, variance double, avg_gradient double, baseline double, type string, late boolean"
COMPACT = "sensor_id long, time_ms long, close_ms long, samples long, duration_ms long, variance double, type string, late boolean"
_FIRST_BATCH = -(1 << 62)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store of every stream here. It does not track its number of rows, a metric that costs a lookup for each write and removal."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def sample_feed(spark: SparkSession, path: str, schema: str = "sensor_id long, seq long, time_ms long, distance double, kind string", files_per_batch: int = 1) -> DataFrame:
    """Samples and trigger messages that arrive as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_triggers(samples: DataFrame, triggers: DataFrame) -> DataFrame:
    """One feed of samples and of external messages that start a sensor's calibration."""
    control = triggers.select("sensor_id", F.lit(-1).cast("long").alias("seq"), "time_ms", F.lit(None).cast("double").alias("distance"), F.lit(TRIGGER).alias("kind"))
    return samples.select("sensor_id", "seq", "time_ms", "distance", F.lit(SAMPLE).alias("kind")).unionByName(control)


class LiveMachine:
    """WAIT_FOR_TRIGGER -> CALIBRATING -> IDLE -> IN_DIP <-> WAITING_FOR_MERGE of one sensor."""

    def __init__(self, params: LiveParams):
        self.p, self.phase, self.baseline, self.t0, self.last_dip = params, "WAIT_FOR_TRIGGER", 0.0, 0, 0
        self.prev: tuple[int, float] | None = None
        self.bins: dict[int, int] = {}
        self.buffer: list[tuple[int, float]] = []

    def trigger(self, time_ms: int) -> None:
        if self.phase == "WAIT_FOR_TRIGGER":
            self.phase, self.t0, self.bins = "CALIBRATING", time_ms, {}

    def hold(self, point: tuple[int, float]) -> None:
        if len(self.buffer) < self.p.buffer:
            self.buffer.append(point)

    def step(self, t: int, d: float) -> dict | None:
        out, below = None, d < self.baseline - self.p.offset
        if self.phase == "CALIBRATING":
            if t - self.t0 < self.p.calibration_ms:
                if d == d and 0 <= (k := int(d + 0.5)) < self.p.bins:
                    self.bins[k] = min(self.bins.get(k, 0) + 1, self.p.bin_limit)
            else:
                self.baseline = float(min(self.bins, key=lambda k: (-self.bins[k], k), default=0))
                self.phase, self.bins = "IDLE", {}
        elif self.phase == "IDLE":
            if below:
                self.phase, self.buffer, self.last_dip = "IN_DIP", [], t
                if self.prev is not None:
                    self.hold(self.prev)
                self.hold((t, d))
        elif self.phase in ("IN_DIP", "WAITING_FOR_MERGE"):
            self.hold((t, d))
            if below:
                self.phase, self.last_dip = "IN_DIP", t
            elif self.phase == "IN_DIP":
                self.phase = "WAITING_FOR_MERGE"
            elif t - self.last_dip > self.p.gap_ms:
                out, self.phase, self.buffer = self.judged(), "IDLE", []
        self.prev = (t, d)
        return out

    def judged(self) -> dict | None:
        times, depths = self.buffer[0][0], np.array([x[1] for x in self.buffer])
        duration, least = (self.buffer[-1][0] - times) / 1000.0, float(np.nanmin(depths))
        if not (self.p.min_seconds <= duration <= self.p.max_seconds and least < self.baseline - self.p.min_height):
            return None
        steps = np.abs(np.diff(depths))
        variance, gradient = float(np.nanvar(depths)), float(np.nanmean(steps)) if (steps == steps).any() else 0.0
        # to six digits, as `classify_events`
        kind = "Vehicle" if round(variance + 3e-8, 6) < self.p.max_variance and round(gradient + 3e-8, 6) < self.p.max_gradient else "Person/Bike"
        return {"time_ms": times, "close_ms": self.buffer[-1][0], "samples": len(depths), "duration": duration, "min_depth": least, "variance": variance, "avg_gradient": gradient, "baseline": self.baseline, "type": kind}


class CompactMachine:
    """Calibration by a mean, then events of samples below the line; the event is kept as count, mean and squares."""

    def __init__(self, params: CompactParams):
        self.p, self.calibrated, self.total, self.seen, self.good = params, float("nan"), 0.0, 0, 0
        self.n, self.mean, self.m2, self.start = 0, 0.0, 0.0, 0

    def step(self, t: int, d: float) -> dict | None:
        if self.seen < self.p.calibration_samples:
            self.seen += 1
            if d == d:
                self.good, self.total = self.good + 1, self.total + d
                self.calibrated = self.total / self.good
            return None
        if d < self.calibrated - self.p.offset:
            if self.n == self.p.capacity:
                self.n = 0
                return None
            if not self.n:
                self.mean, self.m2, self.start = 0.0, 0.0, t
            self.n += 1
            delta = d - self.mean
            self.mean += delta / self.n
            self.m2 += delta * (d - self.mean)
            return None
        n, self.n = self.n, 0
        if not n or t - self.start < self.p.min_duration_ms:
            return None
        variance = self.m2 / n
        return {"time_ms": self.start, "close_ms": t, "samples": n, "duration_ms": t - self.start, "variance": variance, "type": "VEHICLE" if variance <= self.p.max_variance else "OTHER"}


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _moved(handle: StatefulProcessorHandle, timer: int | None, due: int | None) -> int | None:
    """The timer of a key, from then to now."""
    if due != timer:
        if timer is not None and timer in list(handle.listTimers()):
            handle.deleteTimer(timer)
        if due is not None:
            handle.registerTimer(due)
    return due


class Ordered(StatefulProcessor):
    """Steps the rows of a key in the order of `ORDER`; `waits` until the watermark is past their `event_ms`.

    A subclass names what it holds of a row (`ROW`), what it gives out (`OUT`), and how it is stepped: `restore` its state, `consume`
    rows in order, `store` it. Late rows come out with the columns that they share with `OUT`.
    """

    ORDER: tuple[str, str] = ("time_ms", "seq")
    KEY, ROW, OUT = "", "", ""

    def __init__(self, params, waits: bool = False):
        self.params, self.waits = params, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "first long, second long, late long, timer long")
        if self.waits:
            self.waiting = handle.getListState("waiting", self.ROW + ", event_ms long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        yield from self.advance(key, frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.advance(key, None, timerValues)

    def advance(self, key, frame: pd.DataFrame | None, timers) -> Iterator[pd.DataFrame]:
        """Plain tuples in the order of `ROW`, which begins with `ORDER`: a key has few rows in a micro-batch, so tables cost more than they do."""
        first, second, late, timer = self.place.get() or (_FIRST_BATCH, _FIRST_BATCH, 0, None)
        held = [tuple(x) for x in self.waiting.get()] if self.waits else []
        waited = bool(held)
        if frame is not None:
            arrived = list(zip(*[frame[c].tolist() for c in _names(self.ROW) + ["event_ms"] * self.waits], strict=True))
            behind = [row[:2] <= (first, second) for row in arrived]
            if any(behind):
                late += sum(behind)
                told = frame[np.array(behind)].reset_index(drop=True).assign(**{self.KEY: key[0], "late": True})
                nothing = pd.Series([None] * len(told), dtype=object)
                yield pd.DataFrame({c: told[c] if c in told else nothing for c in _names(self.OUT)})
            held += [row for row, b in zip(arrived, behind, strict=True) if not b]
        rest = []
        if self.waits:
            watermark = timers.getCurrentWatermarkInMs()
            held, rest = [x for x in held if x[-1] < watermark], [x for x in held if x[-1] >= watermark]
        if held:
            now = sorted(held, key=itemgetter(0, 1))
            self.restore()
            stepped = self.consume(key, now)
            self.store()
            first, second = int(now[-1][0]), int(now[-1][1])
            if len(stepped):
                yield pd.DataFrame(stepped).assign(late=False).reindex(columns=_names(self.OUT))
        if self.waits:
            if waited:
                self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            timer = _moved(self.handle, timer, int(min(x[-1] for x in rest)) + 1 if rest else None)
        self.place.update((first, second, late, timer))

    def close(self) -> None:
        pass


class LiveDetector(Ordered):
    """`LiveMachine` over the state store: scalars in one value, calibration counts in a map, the open event in a list."""

    KEY, ROW, OUT = "sensor_id", "time_ms long, seq long, distance double, kind string", EVENTS

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "phase string, baseline double, t0 long, last_dip long, prev_t long, prev_d double")
        self.bins = handle.getMapState("bins", "bin int", "n int")
        self.buffer = handle.getListState("buffer", "time_ms long, distance double")

    def restore(self) -> None:
        m = self.machine = LiveMachine(self.params)
        if (state := self.core.get()) is not None:
            m.phase, m.baseline, m.t0, m.last_dip, prev_t, prev_d = state
            m.prev = None if prev_t is None else (prev_t, float("nan") if prev_d is None else prev_d)
            m.bins = {int(k[0]): int(v[0]) for k, v in self.bins.iterator()} if m.phase == "CALIBRATING" else {}
            m.buffer = [tuple(x) for x in self.buffer.get()] if m.phase in ("IN_DIP", "WAITING_FOR_MERGE") else []
        self.kept = bool(m.bins), bool(m.buffer)

    def consume(self, key, rows: list[tuple]) -> list[dict]:
        out = []
        for t, _, d, kind, *_ in rows:
            if kind == TRIGGER:
                self.machine.trigger(int(t))
            elif (event := self.machine.step(int(t), float("nan") if d is None else float(d))) is not None:
                out.append({"sensor_id": key[0], **event})
        return out

    def store(self) -> None:
        m = self.machine
        prev_t, prev_d = m.prev or (None, None)
        self.core.update((m.phase, float(m.baseline), int(m.t0), int(m.last_dip), prev_t, prev_d))
        if self.kept[0]:
            self.bins.clear()
        for k, v in m.bins.items():
            self.bins.updateValue((k,), (v,))
        if self.kept[1]:
            self.buffer.clear()
        if m.buffer:
            self.buffer.put(m.buffer)


class CompactDetector(Ordered):
    KEY, ROW, OUT = "sensor_id", "time_ms long, seq long, distance double, kind string", COMPACT

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "calibrated double, total double, seen long, good long, n long, mean double, m2 double, start long")

    def restore(self) -> None:
        m = self.machine = CompactMachine(self.params)
        if (state := self.core.get()) is not None:
            m.calibrated, m.total, m.seen, m.good, m.n, m.mean, m.m2, m.start = state
            m.calibrated = float("nan") if m.calibrated is None else m.calibrated

    def consume(self, key, rows: list[tuple]) -> list[dict]:
        out = []
        for t, _, d, kind, *_ in rows:
            if kind != TRIGGER and (event := self.machine.step(int(t), float("nan") if d is None else float(d))) is not None:
                out.append({"sensor_id": key[0], **event})
        return out

    def store(self) -> None:
        m = self.machine
        self.core.update((float(m.calibrated), float(m.total), int(m.seen), int(m.good), int(m.n), float(m.mean), float(m.m2), int(m.start)))


class LiveTracker(StatefulProcessor):
    """`Tracker` over the state store. A frame may come in pieces: its detections are stepped in order, whenever they arrive.

    A key is a bundle of videos, not one, and its rows come as packed tables (`in_bundles`): a video has some hundred rows in a micro-batch,
    and calls, state and tables of so few cost more than their tracking. A bundle keeps two kinds of packed tables: where each of its videos
    stands, with its tracks, and the rows that wait, a table for each micro-batch until some of them are due.
    """

    KEY, VIDEO, ORDER = "bundle", "video_id", ("frame_number", "det_idx")
    ROW = "video_id long, frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long"
    OUT = ROW + ", object_id long, is_new boolean, late boolean"

    def __init__(self, params: TrackParams, waits: bool = False):
        self.params, self.waits = params, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.videos = handle.getValueState("videos", "packed binary")
        if self.waits:
            self.timer = handle.getValueState("timer", "ms long")
            self.waiting = handle.getListState("waiting", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.advance([_unpacked(x) for frame in rows for x in frame["packed"]], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.advance([], timerValues)

    def advance(self, tables: list[pa.Table], timers) -> Iterator[pd.DataFrame]:
        places, changed = self.restore(), False
        arrived = [pa.concat_tables(tables).to_pandas()] if tables else []
        for rows in arrived:
            behind = self.behind(places, rows)
            if behind.any():
                told, changed = rows[behind], True
                for video, n in told[self.VIDEO].value_counts().items():
                    places[video]["late"] += n
                yield told.assign(object_id=pd.array([None] * len(told), "Int64"), is_new=pd.array([None] * len(told), "boolean"), late=True)[_names(self.OUT)]
            arrived = [rows[~behind]]
        now = pd.concat(due, ignore_index=True) if (due := self.due(arrived, timers.getCurrentWatermarkInMs()) if self.waits else arrived) else None
        if now is not None and len(now):
            changed = True
            yield self.consume(places, now.take(np.lexsort([now[c] for c in (*self.ORDER[::-1], self.VIDEO)])).reset_index(drop=True))
        if changed:
            self.videos.update((_packed(pa.Table.from_pylist(list(places.values()), _PLACES)),))

    def restore(self) -> dict[int, dict]:
        """By video, the detection that was stepped last, the number of late ones, the next id and the tracks."""
        table = self.videos.get()
        return {} if table is None else {place[self.VIDEO]: place for place in _unpacked(table[0]).to_pylist()}

    def behind(self, places: dict[int, dict], rows: pd.DataFrame) -> np.ndarray:
        """Which rows come at or before the last step of their video."""
        videos, of = np.unique(rows[self.VIDEO].to_numpy(), return_inverse=True)
        frame, index = (np.array([places[v][c] if v in places else _FIRST_BATCH for v in videos.tolist()], "int64")[of] for c in self.ORDER)
        there, place = rows[self.ORDER[0]].to_numpy(), rows[self.ORDER[1]].to_numpy()
        return (there < frame) | ((there == frame) & (place <= index))

    def due(self, arrived: list[pd.DataFrame], watermark: int) -> list[pd.DataFrame]:
        """Rows that the watermark has passed. The others wait; those that wait are read only when the timer says that some are due."""
        timer = (self.timer.get() or (None,))[0]
        expired = timer is not None and timer <= watermark
        held = [_unpacked(x[0]).to_pandas() for x in self.waiting.get()] + arrived if expired else arrived
        ready, rest = ([rows[(rows["event_ms"] < watermark) == passed] for rows in held] for passed in (True, False))
        rest = [rows for rows in rest if len(rows)]
        if expired:
            self.waiting.clear()
        if rest:
            kept = pa.Table.from_pandas(pd.concat(rest), pa.schema([(c, pa.int64()) for c in rest[0]]), preserve_index=False)
            self.waiting.appendValue((_packed(kept),))
        least = [int(rows["event_ms"].min()) + 1 for rows in rest] + [timer] * (timer is not None and not expired)
        if (moved := _moved(self.handle, timer, min(least, default=None))) != timer:
            self.timer.update((moved,))
        return ready

    def consume(self, places: dict[int, dict], rows: pd.DataFrame) -> pd.DataFrame:
        videos, (frames, classes, boxes), indices = rows[self.VIDEO].to_numpy(), plain(rows), rows[self.ORDER[1]].tolist()
        begins = np.flatnonzero(np.diff(videos, prepend=videos[0] - 1)).tolist()
        ids, news = [], []
        for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
            video = int(videos[a])
            place = places.setdefault(video, {self.VIDEO: video, "late": 0, "next": 1, "tracks": []})
            tracker = Tracker(self.params, place["tracks"], place["next"])
            i, new = stepped(tracker, frames[a:b], classes[a:b], boxes[a:b])
            ids += i
            news += new
            place.update({self.ORDER[0]: frames[b - 1], self.ORDER[1]: indices[b - 1], "next": tracker.next_id, "tracks": tracker.tracks})
        return rows.assign(object_id=np.array(ids, "int64"), is_new=np.array(news, bool), late=False)[_names(self.OUT)]


_PLACES = pa.schema([(c, pa.int64()) for c in (LiveTracker.VIDEO, *LiveTracker.ORDER, "late", "next")] + [("tracks", pa.list_(pa.list_(pa.float64())))])


def _packed(table: pa.Table | pa.RecordBatch, compression: str | None = "lz4") -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
        writer.write(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


#: Rows that a task packs at once.
PACKED = 1 << 18


def in_bundles(feed: DataFrame, bundles: int) -> DataFrame:
    """Detections dealt into bundles of videos, as packed tables: of each bundle one for a task of a micro-batch, or for `PACKED` of its rows.

    Rows without a video are left out. The watermark's column, if the feed has one, is the newest of those that were packed together.
    """
    names, timed = [*_names(LiveTracker.ROW), *[c for c in ("event_ms",) if c in feed.columns]], "event_ms" in feed.columns
    schema = StructType([StructField(LiveTracker.KEY, LongType()), StructField("packed", BinaryType())])
    if timed:
        schema = schema.add(feed.schema["at"])  # it says that it is the watermark's

    def dealt(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        table = table.filter(pc.is_valid(table[LiveTracker.VIDEO])).sort_by(LiveTracker.KEY).combine_chunks()
        keys = table[LiveTracker.KEY].to_numpy()
        bounds = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)).tolist()
        rows, begins = table.select(names), bounds[:-1]
        columns = [pa.array(keys[begins], pa.int64()), pa.array([_packed(rows.slice(a, b - a), None) for a, b in zip(begins, bounds[1:], strict=True)], pa.binary())]
        if timed:
            columns.append(pa.array([pc.max(table["at"]).as_py()] * len(begins), table.schema.field("at").type))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    whole = [F.col(c).cast("long").alias(c) for c in names]
    bundle = F.pmod(F.xxhash64(LiveTracker.VIDEO), F.lit(bundles)).alias(LiveTracker.KEY)
    return feed.select(bundle, *whole, *["at"] * timed).mapInArrow(packed, schema)


def reordered(feed: DataFrame, delay_ms: int, event_ms: Column | str = "time_ms", grace_ms: int = 86_400_000) -> DataFrame:
    """A feed whose rows wait for others that are up to `delay_ms` behind the newest row seen, of whatever key.

    Adds `event_ms` (positive milliseconds) and the watermark's column. That lies `grace_ms` after the event, with as much
    more delay: the watermark is then the newest event less the delay, but rows that come later than it still reach
    the operator, which gives them out as late; only those later by the grace are dropped by Spark, which counts them.
    """
    event = (F.col(event_ms) if isinstance(event_ms, str) else event_ms).cast("long")
    return feed.withColumn("event_ms", event).withColumn("at", F.timestamp_millis(F.col("event_ms") + grace_ms)).withWatermark("at", f"{delay_ms + grace_ms} milliseconds")


def _stepped(feed: DataFrame, processor: type[Ordered] | type[LiveTracker], params, waits: bool | None = None) -> DataFrame:
    waits = "event_ms" in feed.columns if waits is None else waits
    return feed.groupBy(processor.KEY).transformWithStateInPandas(processor(params, waits), processor.OUT, "append", "eventTime" if waits else "none")


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where("not late").drop("late")


def late_counts(rows: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Late rows of each key."""
    return rows.where("late").groupBy(key).agg(F.count("*").alias("late_rows"))


def live_detector(feed: DataFrame, params: LiveParams = LiveParams()) -> DataFrame:  # noqa: B008
    """Gated and classified events of every sensor, as they close, and late rows."""
    return _stepped(feed, LiveDetector, params)


def compact_live_detector(feed: DataFrame, params: CompactParams = CompactParams()) -> DataFrame:  # noqa: B008
    return _stepped(feed, CompactDetector, params)


def track_objects_live(detections: DataFrame, params: TrackParams = TrackParams(), bundles: int = 256) -> DataFrame:  # noqa: B008
    """Detections with their tracks, and late ones. Rows without a video are left out.

    Videos are dealt into `bundles` that share state. A task holds a bundle's rows of a micro-batch and those that wait, so the more videos
    there are, the more bundles there should be: some ten thousand rows each.
    """
    return _stepped(in_bundles(detections, bundles), LiveTracker, params, "event_ms" in detections.columns)


def frame_counts_live(detections: DataFrame, event_time: str, late: str = "10 seconds", keys: Sequence[str] = ("video_id",), together: int = 4) -> DataFrame:
    """Detections per class and frame; a frame's row is final once the watermark has passed it.

    Neighbouring frames of a second, up to `together`, are one row of state with counts for each: what a state store costs goes by its rows.
    """
    place = F.pmod("frame_number", F.lit(together))
    here = lambda i: F.coalesce(place, F.lit(0)) == i
    kinds = {"people_in_frame": F.col("class_id") == 0, "bicycles_in_frame": F.col("class_id") == 1, "vehicles_in_frame": F.col("class_id") == 2, "total_in_frame": F.lit(True)}
    counts = [F.count_if(here(i) & kind).alias(f"{name}_{i}") for i in range(together) for name, kind in kinds.items()]
    first = (F.col("frame_number") - place).alias("first_frame")
    bundles = detections.withWatermark(event_time, late).groupBy(*keys, first, F.window(event_time, "1 second")).agg(*counts)
    frame = lambda i: F.struct((F.col("first_frame") + i).alias("frame_number"), *[F.col(f"{name}_{i}").alias(name) for name in kinds])
    return bundles.select(*keys, F.inline(F.array(*[frame(i) for i in range(together)]))).where("total_in_frame > 0")


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run over all that has arrived, into Parquet in `folder`, and read that."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
