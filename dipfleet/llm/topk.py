"""Exact top-k search: tiled matrix products, partial selection in each tile, tree merging of the lists of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor holds a null, NaN or infinite component; an empty one passes."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, short rows filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten().cast(pa.float64()))
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles only while these hold every sum exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def tile_top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (query, column) of the k best columns of each query but its own, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    scores = scores[:, order]
    open_ = ids[order][None, :] != own[:, None]
    if scores.shape[1] > 4 * k:  # everything that reaches the k-th best score, then an exact order among it
        least = np.iinfo(np.int64).min
        kth = -np.partition(-np.where(open_, scores, least + 1), k - 1, axis=1)[:, k - 1]
        open_ &= scores >= kth[:, None]
    q, c = np.nonzero(open_)
    rank = np.lexsort((c, -scores[q, c], q))
    q, c = q[rank], c[rank]
    first = np.searchsorted(q, np.arange(len(own)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], order[c[keep]]


def topk(vectors: DataFrame, queries: Column, k: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, query_block: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """For each row that `queries` selects, the k rows of highest integer inner product, every other row considered.

    Components are turned into floor(scale * x). Rows are dealt into shards, queries into blocks, and each (block,
    shard) tile is one matrix product that keeps k rows a query; lists then merge in two levels, groups of tiles first.
    A tile holds `query_block` queries and about `shard_rows` rows, whatever the size of the table.

    Rows with a null id, a null vector or one with null or non-finite components take no part. Vectors of unequal
    length are compared over their common components. Repeated rows are candidates each (a row is no candidate of a
    query with its own id); a repeated query is asked once, and an id with different vectors once for each, ranked together. Fewer
    than k candidates: all. Empty tables give an empty result; other columns are ignored.
    Returns `query_id, rank, vec_id, score`.
    """
    rows = vectors.where(finite(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // query_block))
    scaled = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    salt = F.xxhash64("id", "v")
    shared = scaled.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = scaled.where("q").select("id", "v").distinct().withColumn("block", F.pmod(salt, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def tile(queries_: pa.Table, rows_: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])
        if queries_.num_rows and rows_.num_rows:
            ids, own = np.asarray(rows_.column("id")), np.asarray(queries_.column("id"))
            right = matrix(rows_.column("v"))
            shard = rows_.column("shard")[0].as_py()
            for a in range(0, len(own), 256):
                part = queries_.slice(a, 256)
                scores = inner(matrix(part.column("v")), right)
                q, c = tile_top(scores, ids, own[a : a + 256], k)
                found.append(pa.table([pa.array(own[a : a + 256][q]), pa.array(ids[c]), pa.array(scores[q, c]), pa.array(np.full(len(q), shard, np.int32))], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    keys = ["block", "shard"]
    lists = asking.select(*keys, "id", "v").groupBy(*keys).cogroup(shared.select(*keys, "id", "v").toDF(*keys, "id", "v").groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score long, shard int")
    best = [F.desc("score"), F.asc("vec_id")]
    branch = Window.partitionBy("query_id", F.pmod("shard", F.lit(max(1, int(shards**0.5))))).orderBy(*best)
    merged = lists.withColumn("_r", F.row_number().over(branch)).where(F.col("_r") <= k)
    root = Window.partitionBy("query_id").orderBy(*best)
    return merged.withColumn("rank", F.row_number().over(root)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
