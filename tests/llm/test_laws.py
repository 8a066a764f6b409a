"""What the laws of sharding and the cells of the metric join promise, at any size and under repeats."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipfleet.llm import common, metricjoin, sharding
from tests.llm.test_operators import DATA, frame


def plain_difference(sizes, k):
    """Karmarkar-Karp by lists of sets: the two partitions of largest spread are joined, largest part to smallest."""
    held = [sorted([(s, [i])] + [(0, [])] * (k - 1), key=lambda p: -p[0])[:k] for i, s in enumerate(sizes)]
    while len(held) > 1:
        held.sort(key=lambda parts: -(parts[0][0] - parts[-1][0]))
        a, b = held.pop(0), held.pop(0)
        held.append(sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda p: -p[0]))
    return sorted(s for s, _ in held[0])


def test_differencing_equals_a_plain_version_where_no_ties_decide():
    rnd = random.Random(81)
    for k in (2, 3, 8):
        for _ in range(40):
            sizes = [rnd.randint(1, 10**9) for _ in range(rnd.randint(1, 40))]
            sums, place = sharding.difference([[s] + [0] * (k - 1) for s in sizes])
            load = [0] * k
            for s, p in zip(sizes, place):
                load[p[0]] += s
            assert sorted(load) == sorted(sums) == plain_difference(sizes, k)


def test_differencing_is_near_the_optimum_of_small_sets():
    rnd, worst = random.Random(82), 0.0
    for _ in range(60):
        sizes = [rnd.randint(50, 100) for _ in range(8)]
        best = min(abs(sum(s if side else -s for s, side in zip(sizes, sides))) for sides in itertools.product((0, 1), repeat=8))
        sums, _ = sharding.difference([[s, 0] for s in sizes])
        worst = max(worst, (max(sums) - min(sums) - best) / sum(sizes))
    assert worst < 0.05


def test_the_driver_gets_few_items_whatever_the_partitions(spark, monkeypatch):
    """3,000 groups over 64 partitions, no adaptive execution: at most 500 items are differenced by the driver."""
    seen, plain = [], sharding.difference
    monkeypatch.setattr(sharding, "difference", lambda p: seen.append(len(p)) or plain(p))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        docs = spark.range(3_000).selectExpr("id as doc_id", "rpad(id, 5 + id % 90, 'x') as text")
        load = [r["sum(size)"] for r in sharding.shard(docs.repartition(64), 8, items=500).groupBy("shard").agg({"size": "sum"}).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert seen and max(seen) <= 500 and len(load) == 8 and max(load) - min(load) < 0.01 * sum(load) / 8


def test_repeats_are_numbered_where_they_lie(spark):
    """200,000 exact repeats: slots are gapless, and no task numbers more than its share."""
    rows = common.checkpointed(spark.range(200_000).repartition(16).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("shard")))
    out = common.numbered(rows, ["shard"], ["doc_id"], "slot")
    assert out.agg(F.countDistinct("slot"), F.min("slot"), F.max("slot")).first()[0:3] == (200_000, 0, 199_999)
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 16 and max(parts) < 20_000


def test_a_hot_text_keeps_its_shard_and_slots(spark):
    texts = ["same"] * 4_000 + [f"text {i}" for i in range(2_000)]
    rows = sharding.shard(frame(spark, texts, ids=[1] * 4_000 + list(range(2_000))).repartition(8), 8).toPandas()
    assert rows[rows["size"] == 5]["shard"].nunique() == 1 and len(rows) == 6_000
    for _, slots in rows.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_small_tables_are_joined_in_cells(spark):
    """At the size of the smallest bench table there are 32 pivots, and vectors live in most of their cells."""
    vectors = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    reps = vectors.groupBy(F.col("embedding").alias("v")).agg(F.min("vec_id").alias("id"))
    pivots = metricjoin.pivot_vectors(reps, reps.count(), 16_384, 8_192)
    x = metricjoin._unit(np.array(vectors.toPandas()["embedding"].to_list(), float))
    assert len(pivots) == metricjoin.PIVOTS and len(np.unique(metricjoin._distances(x, pivots).argmin(1))) > 16
    assert len(metricjoin.pivot_vectors(reps.limit(3), 3, 16_384, 8_192)) == 3


@pytest.mark.parametrize("noise", [0.05])
def test_clustered_vectors_reach_few_products(spark, monkeypatch, noise):
    """5,000 vectors in 60 clusters: below a tenth of all pairs reach a product, and the links are those of all pairs."""
    rng = np.random.default_rng(83)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 5_000)] + rng.normal(size=(5_000, 24)) * noise
    unit = metricjoin._unit(x)
    reach = float(np.sqrt(0.1))
    pivots = unit[:32]
    d = metricjoin._distances(unit, pivots)
    home, own = d.argmin(1), d.min(1)
    radius = np.array([own[home == c].max(initial=-1.0) for c in range(32)])
    products = 0
    for c in range(32):
        seen = (d[:, c] <= np.minimum(own + 2 * reach, radius[c] + reach)) | (home == c)
        products += sum(len(b) * len(s) for b, s in metricjoin.pruned_blocks(d[home == c], d[seen], reach))
    assert products < 0.1 * 5_000**2
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in metricjoin.near_vectors(df, 0.95).collect()}
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert got == dict(enumerate(want.tolist()))
