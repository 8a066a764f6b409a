"""Embedding near-duplicates by an exact metric range join: pivots, triangle inequality, independent cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed, local_components
from dipfleet.llm.components import components
from dipfleet.llm.topk import finite, matrix


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    x = x / big
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


#: Pivots at least, where there are as many vectors: however small the table, it is joined cell by cell.
PIVOTS = 32
#: Pivots whose distances leave out pairs within a tile: those nearest to the tile's own.
REFERENCES = 32


def pivot_vectors(reps: DataFrame, n: int, cell_rows: int, most: int) -> np.ndarray:
    """Unit vectors of the pivots: of `n` different vectors one in `cell_rows`, from PIVOTS to `most`, by the order of a hash."""
    chosen = reps.orderBy(F.xxhash64("v"), "id").limit(min(n, most, max(PIVOTS, n // cell_rows))).select(F.col("v").cast("array<double>").alias("v")).collect()
    width = max((len(r.v) for r in chosen), default=1)
    return _unit(np.array([list(r.v) + [0.0] * (width - len(r.v)) for r in chosen])) if chosen else np.zeros((1, 1))


def in_reach(block: np.ndarray, others: np.ndarray, reach: float) -> np.ndarray:
    """Which of `others` may lie within `reach` of a vector of the block, given the distances of both to the same pivots: by
    the triangle inequality the distances of a near pair differ by `reach` at most, whatever the pivot."""
    low, high = block.min(0) - reach - 1e-6, block.max(0) + reach + 1e-6
    return np.flatnonzero(((others >= low) & (others <= high)).all(1))


def pruned_blocks(d: np.ndarray, others: np.ndarray, reach: float, rows: int = 256, fine: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of vectors, each with those of `others` that pivots do not keep away from it. Vectors with the same nearest pivot
    follow each other; where pivots keep any away at all, a block is cut into fine ones if these see less than half as much."""
    if not len(d) or not len(others):
        return
    order = np.lexsort((d.min(1), d.argmin(1)))
    for at in range(0, len(order), rows):
        block = order[at : at + rows]
        some = in_reach(d[block], others, reach)
        parts = [block[k : k + fine] for k in range(0, len(block), fine)] if len(some) < 0.95 * len(others) else []
        seen = [in_reach(d[part], others[some], reach) for part in parts]
        if parts and 2 * sum(len(part) * len(s) for part, s in zip(parts, seen, strict=True)) < len(block) * len(some):
            yield from ((part, some[s]) for part, s in zip(parts, seen, strict=True))
        else:
            yield block, some


def near_vectors(vectors: DataFrame, threshold: float = 0.95, *, vec_id: str = "vec_id", vector: str = "embedding", cell_rows: int = 16384, most_pivots: int = 8192, tile: int = 16384) -> DataFrame:
    """Link all pairs of vectors with cosine >= threshold, in double precision, and join links to classes.

    Equal vectors are one row with a multiplicity. Of the different vectors one in `cell_rows`, from 32 up to `most_pivots`, by the
    order of a hash, are pivots: each vector lives in the cell of its nearest pivot and is copied to those cells where, by the
    triangle inequality, a vector within range may live. A cell joins its own vectors with all it holds, in tiles of
    at most `tile` x `tile` vectors that go to different tasks, and gives link counts and local classes, never all pairs.
    Within a tile the distances to further pivots leave out what cannot be near before any product.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and are classes of their own.
    Vectors of different lengths never link. A null id is kept as a class without id; repeated rows count as vectors of
    their own; other columns are ignored; an empty table gives an empty result.
    Returns `vec_id, n_links, component_id, kept`.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    usable = finite("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    live, rest = rows.where(usable), rows.where(~F.coalesce(usable, F.lit(False)))
    reps = checkpointed(live.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    n = reps.count()
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) * (1 + 1e-9) + 1e-9
    pivots = pivot_vectors(reps, n, cell_rows, most_pivots)
    shared = spark.sparkContext.broadcast(pivots)  # `most_pivots` rows

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of a batch and their distances to the pivots; longer and shorter rows are padded."""
        p = shared.value
        x = matrix(batch.column(batch.schema.get_field_index("v")))
        w = max(x.shape[1], p.shape[1])
        x = _unit(np.pad(x, ((0, 0), (0, w - x.shape[1]))))
        return x, _distances(x, np.pad(p, ((0, 0), (0, w - p.shape[1]))))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(shared.value), -1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                _, d = split(batch.slice(at, 2048))
                np.maximum.at(far, d.argmin(1), d.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(far), dtype=np.int32)), pa.array(far)], ["cell", "radius"])

    doubles = reps.select("id", "copies", F.col("v").cast("array<double>").alias("v"))
    radius = np.full(len(pivots), -1.0)
    for r in doubles.mapInArrow(radii, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # a row for each pivot
        radius[r.cell] = r.radius

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of vectors for each cell: those that live there (home) and all that it has to see."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                _, d = split(part)
                x, home, own = matrix(part.column(2)), d.argmin(1), d.min(1)
                ids, copies, sizes = np.asarray(part.column(0)), np.asarray(part.column(1)), np.diff(np.asarray(part.column(2).offsets)).astype(np.int32)
                single = x.astype(np.float32)
                x = single if (single == x).all() else x  # half the bytes where nothing is lost
                seen = d <= np.minimum(own[:, None] + 2 * reach, radius[None, :] + reach) + 1e-9
                seen[np.arange(len(home)), home] = True
                rows = []
                for cell in np.flatnonzero(seen.any(0)):
                    for is_home, at_ in ((True, np.flatnonzero(home == cell)), (False, np.flatnonzero(seen[:, cell]))):
                        if len(at_):
                            rows.append((int(cell), is_home, len(at_), x.shape[1], ids[at_].tobytes(), copies[at_].tobytes(), sizes[at_].tobytes(), x[at_].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), pack, strict=True)], schema=pack)

    pack = pa.schema([("cell", pa.int32()), ("home", pa.bool_()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("sizes", pa.binary()), ("v", pa.binary())])
    placed = checkpointed(doubles.mapInArrow(dealt, "cell int, home boolean, n long, width int, ids binary, copies binary, sizes binary, v binary"))
    sizes = placed.groupBy("cell").agg(F.sum(F.when(F.col("home"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("home"), 0).otherwise(F.col("n"))).alias("held")).collect()  # a row for each pivot
    tiles = spark.createDataFrame([(r.cell, -(-r.own // tile), -(-r.held // tile)) for r in sizes if r.own] or [(0, 1, 1)], "cell int, left int, right int")
    placed = placed.join(F.broadcast(tiles), "cell")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    salt = F.xxhash64("ids")
    columns = ["width", "ids", "copies", "sizes", "v"]
    lefts = placed.where("home").select("cell", F.pmod(salt, F.col("left")).cast("int").alias("i"), F.explode(upto("right")).alias("j"), *columns)
    rights = placed.where("not home").select("cell", F.explode(upto("left")).alias("i"), F.pmod(salt, F.col("right")).cast("int").alias("j"), *columns)
    names = ["cell", "i", "j", *columns]
    lefts, rights = lefts.toDF(*names), rights.toDF(*names)  # two sides of one table need columns of their own
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def unpacked(packs: pa.Table) -> tuple[np.ndarray, ...]:
        ids, copies, sizes = (np.concatenate([np.frombuffer(b.as_py(), t) for b in packs.column(c)]) for c, t in (("ids", np.int64), ("copies", np.int64), ("sizes", np.int32)))
        x, at, width = np.zeros((len(ids), max(packs.column("width").to_pylist()))), 0, packs.column("width").to_pylist()
        for b, i, w in zip(packs.column("v"), packs.column("ids"), width, strict=True):
            b, n = b.as_py(), len(i.as_py()) // 8
            x[at : at + n, :w] = np.frombuffer(b, np.float32 if len(b) == 4 * n * w else np.float64).reshape(n, w)
            at += n
        return ids, copies, sizes, _unit(x)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (ids_a, _, size_a, a), (ids_b, copies, size_b, b) = unpacked(left), unpacked(right)
        w = min(a.shape[1], b.shape[1])
        fits_a, fits_b = size_a <= w, size_b <= w
        a, b = a[:, :w], b[:, :w]
        # products in single precision leave out what is surely below; what is near or above is decided in double
        p = np.pad(shared.value, ((0, 0), (0, max(0, w - shared.value.shape[1]))))[:, :w]
        p = _unit(p[np.argsort(_distances(p[left.column("cell")[0].as_py()][None], p)[0], kind="stable")[:REFERENCES]])
        from_a, from_b = _distances(a, p), _distances(b, p)
        fast_a, fast_b, margin = a.astype(np.float32), b.astype(np.float32), 1e-6 * (w + 16)
        links, pairs = np.zeros(len(ids_a), np.int64), []
        for block, some in pruned_blocks(from_a, from_b, reach):
            i, j = np.nonzero(fast_a[block] @ (fast_b if len(some) == len(fast_b) else fast_b[some]).T >= threshold - margin)
            i, j = block[i], some[j]
            for k in range(0, len(i), 1 << 18):
                x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                near = (np.einsum("ij,ij->i", a[x], b[y]) >= threshold) & (size_a[x] == size_b[y]) & fits_a[x] & fits_b[y]
                x, y = x[near], y[near]
                links += np.bincount(x, copies[y], len(links)).astype(np.int64)
                pairs.append((x, y))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        nodes, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        label = local_components(len(nodes), at[: len(ids_a)][i], at[len(ids_a) :][j])
        met = np.unique(at[len(ids_a) :][j])
        counts = pa.table([pa.array(ids_a), pa.array(links), pa.array(nodes[label[at[: len(ids_a)]]])], schema=schema)
        others = pa.table([pa.array(nodes[met]), pa.array(np.zeros(len(met), np.int64)), pa.array(nodes[label[met]])], schema=schema)
        return pa.concat_tables([counts, others])

    keys = ["cell", "i", "j"]
    found = checkpointed(lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(joined, "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select("id", "root").where("id <> root"), "id", "root")
    per_rep = reps.join(linked, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
    per_rep = per_rep.select("v", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = live.join(per_rep, "v").select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
