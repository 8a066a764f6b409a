"""Sharding with one hot group among several batches and tasks."""

import random

import pytest

from dipfleet.llm import sharding
from tests.llm.test_operators import frame, sentence


@pytest.mark.parametrize("items", [sharding.ITEMS, 2000])
@pytest.mark.parametrize("share", [0.05, 0.125, 0.33])
def test_a_hot_group_is_offset_by_all_batches_and_tasks(spark, share, items):
    """items=2000: groups are bundled twice before the driver sees them."""
    rnd = random.Random(41)
    texts = [f"{i} {sentence(rnd, rnd.randint(1, 12))}" for i in range(9000)]
    total = sum(len(t) + 1 for t in texts)
    texts.append("x" * int(total * share / (1 - share)))
    rows = sharding.shard(frame(spark, texts).repartition(4), 8, items=items).toPandas()
    load = rows.groupby("shard")["size"].sum()
    hot, mean = len(texts[-1]) + 1, load.sum() / 8
    assert len(rows) == len(texts) and len(load) == 8
    assert load.max() <= 1.01 * max(hot, mean)


def test_bundles_keep_large_groups_apart():
    rnd = random.Random(42)
    sums = [rnd.randint(1, 100) for _ in range(500)] + [10_000, 3_000]
    place = sharding.bundled(sums, 16)
    assert [place.count(place[i]) for i in (-1, -2)] == [1, 1] and set(place) == set(range(16))


@pytest.mark.parametrize("items", [sharding.ITEMS, 1000])
def test_heavy_tails_are_as_tight_as_differencing_of_all_groups(spark, items):
    """Pareto sizes: many small groups and a few large ones; items=1000: most are bundled by tasks first."""
    rnd = random.Random(43)
    sizes = [min(int(30 * rnd.paretovariate(1.1)), 200_000) for _ in range(12_000)]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").selectExpr("doc_id", "rpad(concat(doc_id, ' '), n, 'x') as text").repartition(6)
    load = sharding.shard(docs, 8, items=items).groupBy("shard").agg({"size": "sum"}).toPandas()["sum(size)"]
    mean = load.sum() / 8
    real = [r.size for r in docs.selectExpr("octet_length(text) + 1 as size").collect()]
    whole, _ = sharding.difference([[n] + [0] * 7 for n in real])
    assert sum(whole) == load.sum()
    assert load.max() - load.min() <= max(0.001 * mean, 2 * (max(whole) - min(whole)))
