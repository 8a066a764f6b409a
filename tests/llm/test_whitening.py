"""Whitening against exact integers and a plain decomposition."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from dipfleet.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def plain(rows, components):
    """Rows (id, component) -> n, deviation, whitened (but for its sign), explained."""
    x = {n: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for n, (_, v) in enumerate(rows)}
    distinct = sorted(set(x.values()))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in distinct])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for row, v in x.items():
        dev = [n * a - s for a, s in zip(v, sums)]
        w = np.array([float(Fraction(d, n)) for d in dev]) @ vector[:, :components] / np.sqrt(value[:components])
        for k in range(components):
            out[(rows[row][0], k + 1, row)] = (n, sum(d * d for d in dev), w[k], value[k] / value.sum())
    return out


def test_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(12)
    data = [(i, np.float32(rng.normal(0, [3, 2, 1, 0.7, 0.4, 0.2], 6) + 5)) for i in range(400)]
    data += [(1000 + i, data[7][1]) for i in range(150)]  # copies have no weight
    awkward = [(2000, None), (2001, [1, None, 1, 1, 1, 1]), (2002, [float("nan")] * 6), (2003, [float("inf"), 0, 0, 0, 0, 0]), (2004, [])]
    got = whitening.whiten(vectors(spark, data + awkward).repartition(5).withColumn("x", F.lit(1)), 4).collect()
    want = plain(data, 4)
    assert len(got) == 4 * len(data) == len(want)
    want = {(i, k): v for (i, k, _), v in want.items()}
    sign = {k: np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == k) * want[(0, k)][2]) for k in range(1, 5)}
    for r in got:
        n, deviation, w, explained = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened * sign[r.component] - w) < 1e-9 and abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_awkward_tables(spark):
    assert whitening.whiten(vectors(spark, []), 4).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])]), 4).count() == 0
    one = whitening.whiten(vectors(spark, [(None, [1, 2]), (5, [1, 2])]), 4).collect()  # one different vector: no variance
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == sorted((i, k, 1, 0, None, None, None) for i in ("None", "5") for k in (1, 2))
    flat = whitening.whiten(vectors(spark, [(1, [0, 1]), (2, [2, 1]), (3, [4, 1])]), 4).collect()  # variance along one axis alone
    assert {r.component for r in flat if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in flat)
    assert sorted(round(abs(r.whitened), 6) for r in flat if r.component == 1) == [0.0, 1.224745, 1.224745]


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(13)
    a, b = [(i, rng.normal(size=3).tolist()) for i in range(40)], [(100 + i, rng.normal(size=5).tolist()) for i in range(30)]
    both = whitening.whiten(vectors(spark, a + b), 2).collect()
    for part, n in ((a, 40), (b, 30)):
        alone = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, part), 2).collect()}
        assert all(r.n == n and abs(r.whitened - alone[(r.vec_id, r.component)]) < 1e-9 for r in both if r.vec_id in dict(part))


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [3e16, 0.0]), (2, [-3e16, 1.0]), (3, [0.0, 2.0])]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, rows), 1).collect()}
    assert got[1].deviation is None and got[3].deviation == sum((3 * x - s) ** 2 for x, s in ((0, 256 * (int(np.float32(3e16)) - int(np.float32(3e16)))), (512, 768)))
    assert abs(abs(got[1].whitened) - 1.224745) < 1e-5
