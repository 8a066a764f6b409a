"""Votes and latent space of the quality score against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipfleet.llm import quality
from tests.llm.test_operators import sentence

SETTINGS = quality.Settings(neighbours=7, rank=12)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(61)
    texts = [sentence(rnd, rnd.randint(1, 50)) if i % 3 else " ".join("$$" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 40))) for i in range(120)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")


def test_votes_equal_a_plain_count(corpus):
    """Every document against every labelled one, one pair at a time."""
    docs, labels = corpus
    rows = docs.select("text", "doc_id")
    model = quality.fit(rows, labels, SETTINGS, "doc_id", "quality")
    got = {r.doc_id: (r.score, r.nearest) for r in quality.score(docs, labels, SETTINGS).collect()}
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        counts = quality.term_counts(raw, np.array([0, len(raw)]))
        v = (quality.weighted(counts, model.idf) @ model.axes)[0]
        pairs = sorted(((float(np.dot(v, k) / max(np.linalg.norm(v), 1e-12)), float(y)) for k, y in zip(model.known, model.label)), reverse=True)[: SETTINGS.neighbours]
        weight = sum(max(c, 0) ** SETTINGS.sharpness for c, _ in pairs)
        want = sum(max(c, 0) ** SETTINGS.sharpness * y for c, y in pairs) / weight if weight else float(model.label.mean())
        assert got[r.doc_id] == pytest.approx((want, max(pairs[0][0], 0)), abs=1e-9)


def test_terms_and_rarity_equal_plain_counts(corpus):
    docs, _ = corpus
    seen, n = quality.document_frequencies(docs.select("text"))
    texts = [(r.text or "") for r in docs.collect()]
    assert n == len(texts)
    shapes = [{tuple(quality._KIND[list(t.encode()[i : i + 3])].tolist()) for i in range(len(t.encode()) - 2)} for t in texts]
    for run in {s for x in shapes for s in x}:
        at = (run[0] * quality.KINDS + run[1]) * quality.KINDS + run[2]
        assert seen[at] == sum(run in x for x in shapes)
    words = quality.term_counts(np.frombuffer(b"The cat the CAT sat", np.uint8), np.array([0, 19]))[0, quality.SHAPES :]
    assert sorted(words[words > 0].tolist()) == [1, 2, 2]


def test_latent_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(62)
    x = (rng.normal(size=(80, 6)) @ rng.normal(size=(6, 200)) * 5 + rng.normal(size=(80, 200)) * 0.1).astype(np.float32)
    axes = quality.latent_axes(x, 6)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.linalg.svd(right[:6] @ axes)[1] - 1).max() < 1e-3


def test_repeated_ids_bound_what_the_driver_sees(spark, corpus):
    docs, labels = corpus
    many = docs.unionByName(docs.withColumn("text", F.concat(F.lit("x "), "text"))).unionByName(docs)
    known = quality.counted(many.join(labels, "doc_id").select("text", F.col("doc_id").alias("_doc"), F.col("quality").alias("_label")))
    assert known.count() == 120
