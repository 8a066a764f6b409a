"""Helpers shared by the training-data operators: Arrow text as flat byte arrays, checkpoints, numbering."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D, the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder := tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written and is no longer read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def crc_mod3(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `limit` bytes each, so that arrays made from them stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def release_memory() -> None:
    """Give memory that arrays no longer use back to the system: Python workers live on from task to task, and share an
    executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def parts(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut into runs of whole texts: the rows, their bytes and their offsets."""
    for batch in batches:
        buf, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(offsets, limit):
            yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        del batch, buf, offsets
        release_memory()


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word; words never cross texts."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    ink = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~ink[:-1]
    after[:-1] |= ~ink[1:]
    starts = np.flatnonzero(ink & before)
    return starts, np.flatnonzero(ink & after) + 1, np.searchsorted(offsets, starts, "right") - 1


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n + 1, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_hash(buf: np.ndarray, salt: int = 1) -> np.ndarray:
    """Wrapping sums of byte times power: `span_hash` reads the hash of any span from two of them."""
    up, _ = _up_to(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(salt)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    _, down = _up_to(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts], seed)


def joined_classes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (each node's smallest member) after the links a-b, and those of the links that joined two of them: a forest."""
    label, left, right = label.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, high, low = a[apart], b[apart], np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        label[high[first]] = low[first]
        left.append(a[first])
        right.append(b[first])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label, np.concatenate(left), np.concatenate(right)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links a-b among n nodes."""
    return joined_classes(np.arange(n), a, b)[0]


def numbered(written: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without sorting a group in one task and however often rows repeat: rows are numbered
    within the partitions that they lie in, and prefix sums of the counts put one partition after the other. The table must
    be a checkpoint, so that its partitions stay as they are."""
    placed = written.withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # a row for each partition
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return placed.join(offsets, [*group, "_part"]).withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_part", "_o")


#: A key with more than a `HOT`-th of all rows is hot: there are at most so many.
HOT = 10_000


def joined_by_key(rows: DataFrame, of_keys: DataFrame, key: str, count: str) -> DataFrame:
    """Rows joined with the one row of their key, where it has one; `count` says how many rows a key has at least and is dropped.

    Keys that hold more than a ten-thousandth of all counted rows are at most 10,000, whatever the size of the table: those are
    broadcast, so that the rows of a hot key stay where they lie. All others meet by a shuffle, where no key is large.
    """
    total = of_keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > F.lit(total)
    few = F.broadcast(of_keys.where(hot).drop(count))
    here = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(of_keys.where(~hot).drop(count), key)
    return here.unionByName(rest)
