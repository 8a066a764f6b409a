"""Logs that devices append to, as a data source of lines with their byte offsets: read whole, or as a stream that restarts where
it stopped."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: One line of a log: its sensor, its file, the offset of its first byte, and the line itself.
LINES = "sensor_id string, file string, at long, line string"
#: Bytes that one task reads, about, and as how many at least a log counts: small logs are read many to a task.
PIECE, OPENED = 32 << 20, 1 << 18
#: Lines of small logs that go into one batch, about.
BATCH = 10_000


def _filesystem(path: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """The logs below a folder, or the one log, and their sizes."""
    from pyarrow import fs

    files, root = _filesystem(path)
    if files.get_file_info(root).type == fs.FileType.File:
        return {root: files.get_file_info(root).size}
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


def _sensor(file: str) -> str:
    """The folder `sensor_id=..` that a log lies in, or else its name."""
    of = re.search(r"/sensor_id=([^/]+)/", file)
    return of[1] if of else re.sub(r"\.[^./]*$", "", file.rsplit("/", 1)[-1])


@dataclass
class Piece(InputPartition):
    """Lines of `file` that begin from `start` on and before `end`; `first` and `stop` bound what may be read at all."""

    path: str
    file: str
    start: int
    end: int
    first: int
    stop: int


def _pieces(path: str, file: str, first: int, stop: int, size: int) -> list[Piece]:
    return [Piece(path, file, a, min(a + size, stop), first, stop) for a in range(first, stop, size)]


@dataclass
class Bundle(InputPartition):
    """Pieces that one task reads one after the other."""

    pieces: list[Piece]


def _bundles(pieces: list[Piece], size: int) -> list[Bundle]:
    bundles, cost = [], size
    for p in pieces:
        if cost >= size:
            bundles.append(Bundle([]))
            cost = 0
        bundles[-1].pieces.append(p)
        cost += max(p.end - p.start, OPENED)
    return bundles


def read_bundle(bundle: Bundle) -> Iterator[pa.RecordBatch]:
    """The lines of all pieces; those of small logs share a batch."""
    held, n = [], 0
    for piece in bundle.pieces:
        for batch in read_lines(piece):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def read_lines(piece: Piece, block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of whole lines. A line belongs to the piece in which it begins, and is read to its end."""
    files, _ = _filesystem(piece.path)
    sensor, broken = _sensor(piece.file), piece.start > piece.first  # the first line may have begun before
    at, rest = piece.start - broken, b""

    def batch(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        keep = at + starts < piece.end
        lines = [data[a:b].decode("utf-8", "replace").rstrip("\r") for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([sensor] * n, pa.string()), pa.array([piece.file] * n, pa.string()), pa.array(at + starts[keep], pa.int64()), pa.array(lines, pa.string())], ["sensor_id", "file", "at", "line"])

    with files.open_input_file(piece.file) as log:
        log.seek(at)
        while at < piece.end:
            more = log.read(min(block, piece.stop - at - len(rest)))
            data = rest + more
            cut = data.rfind(b"\n") + 1
            if not more:  # a last line without an end
                if data and not broken:
                    yield batch(data, np.array([0]), np.array([len(data)]))
                return
            ends = np.flatnonzero(np.frombuffer(data, np.uint8, cut) == 10)
            starts = np.append(0, ends[:-1] + 1)[: len(ends)]
            if len(ends):
                yield batch(data, starts[broken:], ends[broken:])
                broken = False
            at, rest = at + cut, data[cut:]


class LogReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Bundle]:
        return _bundles([p for f, n in sorted(_sizes(self.path).items()) for p in _pieces(self.path, f, 0, n, self.size)], self.size)

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        return read_bundle(partition) if partition else iter(())  # a folder without logs has no pieces


class LogStream(DataSourceStreamReader):
    """Offsets are, for each log, where its last complete line ends: a line that is still being written waits."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f: self.complete(f, n) for f, n in sorted(_sizes(self.path).items())}

    def complete(self, file: str, size: int, block: int = 1 << 16) -> int:
        files, _ = _filesystem(self.path)
        with files.open_input_file(file) as log:
            while size > 0:
                start = max(0, size - block)
                log.seek(start)
                cut = log.read(size - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        return _bundles([p for f, n in sorted(end.items()) if n > start.get(f, 0) for p in _pieces(self.path, f, start.get(f, 0), n, self.size)], self.size)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        return read_bundle(partition)


class LogWriter(DataSourceArrowWriter):
    """A folder for each sensor, and one log in it. A task's rows lie together by sensor, and a sensor in one task. Logs get their names once they are
    whole, so of a task that runs twice one log stays."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _filesystem(self.path)
        sensor, log, draft, final = None, None, "", ""

        def end() -> None:
            if log is not None:
                log.close()
                files.move(draft, final)

        for batch in iterator:
            sensors, lines = batch.column("sensor_id").to_pylist(), batch.column("value").to_pylist()
            cuts = [k for k in range(1, len(sensors)) if sensors[k] != sensors[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(sensors)], strict=True):
                if a == b:
                    continue
                if log is None or sensors[a] != sensor:
                    end()
                    sensor = sensors[a]
                    folder = f"{root}/sensor_id={_escaped(sensor)}"
                    draft, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/part-{self.run}.txt"
                    files.create_dir(folder, recursive=True)
                    log = files.open_output_stream(draft)
                log.write("".join(f"{line or ''}\n" for line in lines[a:b]).encode())
        end()
        return WriterCommitMessage()


def _escaped(sensor: str | None) -> str:
    """As Spark names folders of partitions."""
    if not sensor:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", sensor)


class DeviceLog(DataSource):
    """`spark.read` or `spark.readStream` with `.format("device_log").option("path", folder)`; `piece`: bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "device_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("piece", PIECE)))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])

    def streamReader(self, schema) -> LogStream:  # noqa: N802
        return LogStream(self.options["path"], int(self.options.get("piece", PIECE)))


def log_lines(spark: SparkSession, path: str, stream: bool = False, piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(DeviceLog)
    return (spark.readStream if stream else spark.read).format("device_log").option("path", path).option("piece", str(piece)).load()


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("time_ms", "seq")) -> None:
    """`sensor_id, value` in `order` as logs, a folder for each sensor. The files of a cluster's own writers cost some ten milliseconds each,
    which logs of many small sensors pay for each of them."""
    lines.sparkSession.dataSource.register(DeviceLog)
    placed = lines.repartition("sensor_id").sortWithinPartitions("sensor_id", *order)
    placed.select(F.col("sensor_id").cast("string").alias("sensor_id"), F.col("value").cast("string").alias("value")).write.format("device_log").mode("append").save(path)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with `time_ms, distance`, and for those that hold no sample the `reason`; blank lines have neither."""
    pattern = r"^\s*([-+]?\d+)\s*[,\s]\s*([-+]?\d*\.?\d+)"
    time, distance = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    rows = lines.withColumns({"time_ms": time.try_cast("long"), "distance": distance.try_cast("double"), "_whole": F.regexp_like("line", F.lit(pattern))})
    bad = F.col("time_ms").isNull() | F.col("distance").isNull()
    reason = F.when(F.trim("line") == "", None).when(~F.col("_whole"), "not a time and a distance").when(bad, "a number out of range")
    return rows.withColumn("reason", reason).drop("_whole")


def log_samples(lines: DataFrame) -> DataFrame:
    """Samples of lines; `seq` is the offset of the line, so samples of one time keep the order of the log."""
    return parsed(lines).where("time_ms is not null and distance is not null").select("sensor_id", F.col("at").alias("seq"), "time_ms", "distance")


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold no sample, for a side table: where they lie and why."""
    return parsed(lines).where("reason is not null").select("sensor_id", "file", "at", "line", "reason")
