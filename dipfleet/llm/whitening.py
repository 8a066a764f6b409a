"""Whitening of embeddings: exact integer centring, the Gramian of a distributed row matrix, projection by a broadcast basis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed

OUT = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONG = 1 << 63


@dataclass(frozen=True)
class Basis:
    """What whitens vectors of one length: number and sums of the fitted ones, `projection` (a column for each component, over
    the root of its eigenvalue; NaN where there is no variance), shares of the variance, and the largest deviation from the identity."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray
    explained: tuple[float | None, ...]
    exact: bool
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: 64-bit integers where all fit, or else Python's."""
        kind = np.int64 if self.exact else object
        return x.astype(kind) * (self.n if self.exact else int(self.n)) - np.array(self.sums, kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ self.projection


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _projected(rows: DataFrame, basis: Basis) -> DataFrame:
    """`w`: the whitened components of each `x`."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)  # a number for each dimension and component

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = shared.value
                w = b.whitened(b.deviations(np.stack(batch["x"].to_list())))
                yield pd.DataFrame({f"w{k}": w[:, k] for k in range(w.shape[1])})

    return rows.select("x").mapInPandas(run, ", ".join(f"w{k} double" for k in range(basis.projection.shape[1])))


def fit(distinct: DataFrame, components: int) -> Basis:
    """The basis of different vectors `x` of one length: all are centred exactly (n * x - S is whole, and is divided once) before
    anything is multiplied. Only sums, the Gramian and the covariances of the components come to the driver: their size
    depends on the number of dimensions alone."""
    summed = distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs(F.col("v").cast("decimal(38,0)"))).alias("most"))
    per = summed.orderBy("at").collect()  # a row for each dimension
    n, sums, d = per[0]["n"], tuple(int(r["s"]) for r in per), len(per)
    largest = 2 * n * max(int(r["most"]) for r in per)
    exact = d * largest**2 < LONG
    if largest < LONG:
        centred = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: (x * F.lit(n).cast("long") - s).cast("double") / float(n))
    else:
        centred = F.zip_with("x", F.array(*[F.lit(s / n) for s in sums]), lambda x, m: x.cast("double") - m)
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("row")), "row")
    covariance = RowMatrix(rows, n, d).computeGramianMatrix().toArray() / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    vector = vector * np.where(np.take_along_axis(vector, np.abs(vector).argmax(0)[None], 0) < 0, -1.0, 1.0)  # the largest entry is positive
    k, trace = min(components, d), float(np.trace(covariance))
    alive = value[:k] > max(value[0], 0.0) * 1e-12
    projection = np.where(alive, vector[:, :k] / np.sqrt(np.where(alive, value[:k], 1.0)), np.nan)
    explained = tuple(float(v) / trace if trace > 0 else None for v in value[:k])
    basis = Basis(n, sums, projection, explained, exact)
    pairs = [(i, j) for i in range(k) for j in range(i + 1) if alive[i] and alive[j]]
    if not pairs:
        return basis
    # the covariance of the components over the same list, centred as it is summed
    seen = _projected(distinct, basis).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return Basis(n, sums, projection, explained, exact, float(error))


def whiten(vectors: DataFrame, components: int = 4, *, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first principal components of every vector at unit variance: a row for each vector and component.

    Entries are multiplied by `scale` and rounded down to whole numbers x (beyond 64 bits to the nearest that fits). The fit takes every
    different x once, so copies have no weight. Vectors that are null or hold null or non-finite entries are left out; each
    length of vectors is a space of its own; empty vectors have no component; null ids and repeated rows are whitened like
    any other; other columns are ignored; an empty table gives an empty result. Components without variance have a null
    `whitened`; `deviation` is null where it does not fit into 64 bits.
    Returns `vec_id, component, n, deviation, whitened, explained, identity_error`.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("_v")).where(usable(F.col("_v"))).select("vec_id", F.transform("_v", lambda c: F.floor(c * float(scale))).alias("x"))
    distinct = checkpointed(rows.select("x").dropDuplicates(["x"]))
    lengths = sorted(r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect() if r["d"])  # lengths of vectors
    out = None
    for d in lengths:
        same = lambda df, d=d: df.where(F.size("x") == d) if len(lengths) > 1 else df.where(F.size("x") > 0)
        one = _rows(same(rows), fit(same(distinct), components))
        out = one if out is None else out.unionByName(one)
    out = vectors.sparkSession.createDataFrame([], OUT) if out is None else out
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def _rows(rows: DataFrame, basis: Basis) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(basis)  # a number for each dimension and component

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            b = shared.value
            dev = b.deviations(np.stack(batch["x"].to_list()))
            squares = (dev * dev).sum(1).tolist()
            w = b.whitened(dev)
            k = w.shape[1]
            whitened = w.reshape(-1).astype(object)
            whitened[np.isnan(w.reshape(-1))] = None
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": b.n,
                "deviation": pd.array([s if s < LONG else None for s in squares], "Int64").repeat(k), "whitened": whitened,
                "explained": pd.Series(list(b.explained) * len(batch), dtype=object), "identity_error": pd.Series([b.identity_error] * (k * len(batch)), dtype=object),
            })

    # ids as text: a column of numbers with nulls would come as floats
    return rows.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(run, OUT)
