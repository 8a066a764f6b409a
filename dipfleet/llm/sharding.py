"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed, joined_by_key, numbered


def difference(partials: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions into one, always the two with the largest spread, oppositely ordered.

    Each partial is the byte sums of k parts. Returns the k sums of the whole, and for each partial the part of the
    whole that each of its own parts went to.
    """
    k = len(partials[0])
    # a node: sums in falling order, and for each part of it the members (partial, part) as nested pairs
    heap = []
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda p: (-sums[p], p))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[p] for p in order], [(i, p) for p in order]))
    heapq.heapify(heap)
    fresh = len(partials)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        joined = sorted(((x + y, p, q) for x, p, y, q in zip(a, in_a, reversed(b), reversed(in_b), strict=True)), key=lambda t: -t[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], fresh, [t[0] for t in joined], [(None, t[1], t[2]) for t in joined]))
        fresh += 1
    _, _, sums, members = heap[0]
    place = [[0] * k for _ in partials]
    for part, node in enumerate(members):
        stack = [node]
        while stack:
            x = stack.pop()
            if x[0] is None:
                stack += x[1:]
            else:
                place[x[0]][x[1]] = part
    return sums, place


#: Items that a task differences at a time, the bundles that they leave, and items of a task.
BATCH, BUNDLES, TASK = 256, 64, 8_192
#: The driver differences so many items at most; tasks bundle all items first, and again while there are more.
ITEMS = 20_000


def bundled(sums: Sequence[int], bundles: int) -> list[int]:
    """A bundle for each item, of `bundles` near equal ones. An item above an even share of those not yet set apart is
    a bundle of its own, so no bundle of several items is larger than about a share."""
    order = sorted(range(len(sums)), key=lambda i: (-sums[i], i))
    rest, alone = sum(sums), 0
    while alone < min(len(order), bundles - 1) and sums[order[alone]] * (bundles - alone) >= rest:
        rest -= sums[order[alone]]
        alone += 1
    out = [0] * len(sums)
    for n, i in enumerate(order[:alone]):
        out[i] = n
    if small := order[alone:]:
        k = bundles - alone
        _, place = difference([[sums[i]] + [0] * (k - 1) for i in small])
        for i, at in zip(small, place, strict=True):
            out[i] = alone + at[0]
    return out


def _local(batch_rows: int, bundles: int):
    """Name the bundle of each item of a task, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fresh = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                mine = pa.array([(task << 32) + fresh + n for n in bundled(part.column(1).to_pylist(), bundles)], pa.int64())
                fresh += bundles
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), mine], ["item", "bytes", "bundle"])

    return run


def shard(docs: DataFrame, shards: int = 8, *, doc_id: str = "doc_id", text: str = "text", batch_rows: int = BATCH, bundles: int = BUNDLES, items: int = ITEMS) -> DataFrame:
    """Deal documents into shards of near equal bytes; documents with equal texts stay together.

    Groups are summed by a digest of their text before they are shuffled, so a text with any number of copies is one
    row. Tasks of some thousand items difference them in batches into a quarter as many bundles, a large group being a bundle of its
    own, and do so again while there are more than `items`; the driver differences what is left, each a single item, so that a
    large group is offset by all others. A group larger than an equal share fills a shard by itself: the balance is then as near as
    whole groups allow. Slots count from 0 in each shard and are numbered where the rows lie, not in one task; rows of
    a group that holds very many never meet.

    A null text counts as the empty text (size 1, checksum 0); null ids are kept; repeated rows are documents of their
    own; an empty table gives an empty result; other columns are ignored.
    Returns `doc_id, size, text_crc32, gkey, shard, slot`.
    """
    spark: SparkSession = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("gkey")
    )
    keyed = checkpointed(keyed)
    groups = checkpointed(keyed.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    levels, left = [], groups.select(F.col("gkey").alias("item"), "bytes")
    n, before = groups.count(), None
    while n and (not levels or n > items):
        if n == before:
            raise RuntimeError(f"{n} items are not fewer for being bundled; at most {items} may go to the driver")
        # tasks of many batches: whatever the number of partitions, items become fewer
        spread = left.repartition(-(-n // TASK), "item")
        levels.append(checkpointed(spread.mapInArrow(_local(batch_rows, bundles), f"item {left.dtypes[0][1]}, bytes long, bundle long")))
        left = checkpointed(levels[-1].groupBy("bundle").agg(F.sum("bytes").alias("bytes")).select(F.col("bundle").alias("item"), "bytes"))
        n, before = left.count(), n
    last = left.orderBy("item").collect()  # at most `items`
    _, place = difference([[r.bytes] + [0] * (shards - 1) for r in last]) if last else ([], [])
    where = spark.createDataFrame([(r[0], p[0]) for r, p in zip(last, place, strict=True)], f"item {left.dtypes[0][1]}, shard int")
    for up in reversed(levels):
        where = up.join(where.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    where = where.withColumnRenamed("item", "gkey").join(groups.select("gkey", "rows"), "gkey")
    dealt = checkpointed(joined_by_key(keyed, where, "gkey", "rows").select("doc_id", "size", "text_crc32", "gkey", "shard"))
    return numbered(dealt, ["shard"], ["doc_id", "gkey"], "slot").select("doc_id", "size", "text_crc32", "gkey", "shard", F.col("slot").cast("long").alias("slot"))
