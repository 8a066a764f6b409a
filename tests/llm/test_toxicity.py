"""The whole toxicity score against plain Python over words as texts, and the stage on rows without or with repeated ids."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from dipfleet.llm import stages, toxicity
from tests.llm.test_operators import DOCS, sentence
from tests.llm.test_pure import brute_segments

FOUL = ["grubble", "snarkwit", "oafling", "drossel"]
SETTINGS = toxicity.Settings()


def corpus(rnd, n):
    """Texts, ids and labels; a third is toxic."""
    rows, labels = [], []
    for i in range(n):
        words = sentence(rnd, rnd.randint(0, 60)).split()
        toxic = i % 3 == 0
        if toxic:
            at = rnd.randint(0, len(words))
            words[at:at] = [rnd.choice(FOUL) + rnd.choice(["", "s", "!"]) for _ in range(rnd.randint(3, 6))]
        rows.append((i, " ".join(words).replace("er", "Er")))
        labels.append((i, int(toxic)))
    return rows, labels


def words_of(text):
    """Words in lower case with their places in bytes: runs of ASCII letters and of bytes beyond ASCII."""
    out, at, raw = [], 0, (text or "").encode()
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
    for w in folded.split(b" "):
        if w:
            out.append((w, at, at + len(w)))
        at += len(w) + 1
    return out


def plain_scores(rows, labels):
    known = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    counts, totals = {k: Counter() for k in "nyx"}, Counter()
    for d, text in rows:
        different = {w for w, _, _ in words_of(text)}
        of = ["n"] + (["y" if known[d] else "x"] if d in known else [])
        for k in of:
            totals[k] += 2 * len(different)
            for w in different:
                counts[k][("word", w)] += 1
                counts[k][("stem", w[:6])] += 1
    mass = SETTINGS.prior * (totals["y"] + totals["x"])
    worth = {}
    for t in counts["y"]:
        prior = mass * counts["n"][t] / totals["n"]
        y, x = counts["y"][t] + prior, counts["x"][t] + prior
        delta = math.log(y / (totals["y"] + mass - y)) - math.log(x / (totals["x"] + mass - x))
        if delta / math.sqrt(1 / y + 1 / x) >= SETTINGS.least_z:
            worth[t] = min(delta, 8.0)
    found = {}
    for d, text in rows:
        spoken, before, values = words_of(text), None, []
        for w, _, _ in spoken:
            v = max(worth.get(("word", w), SETTINGS.drift), worth.get(("stem", w[:6]), SETTINGS.drift))
            values.append(min(v, SETTINGS.drift) if w == before else v)
            before = w
        segments = [(a, b, sum(values[a:b])) for a, b in brute_segments(values)]
        found[d] = (len(spoken), max((s for *_, s in segments), default=0.0), [(spoken[a][1], spoken[b - 1][2]) for a, b, s in segments if s >= SETTINGS.least])
    law = toxicity.calibrate(pd.DataFrame([(found[d][1], found[d][0], y) for d, y in known.items()], columns=["best", "tokens", "_label"]))
    return {d: (n, best, 1 / (1 + math.exp(-(law.bits(float(n), best, np) * law.slope + law.offset))) if best > 0 else law.empty, spans) for d, (n, best, spans) in found.items()}


def test_the_whole_score_equals_plain_python(spark):
    rows, labels = corpus(random.Random(51), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = plain_scores(rows, labels)
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        tokens, best, score, spans = want[r.doc_id]
        assert r.tokens == tokens and r.best == pytest.approx(best, abs=1e-9) and r.score == pytest.approx(score, abs=1e-6)
        assert [(p.start, p.end) for p in r.passages] == spans
    assert any(r.score >= 0.7 for r in got)


def test_the_stage_judges_every_row_by_its_own_text(spark, tmp_path):
    """Toxic rows go with or without an id; clean rows of the same id stay."""
    rnd = random.Random(52)
    rows, labels = corpus(rnd, 150)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    foul, clean = " ".join(FOUL) + " " + sentence(rnd, 20), sentence(rnd, 24)
    extra = [(None, foul), (None, clean), (1000, foul), (1000, clean), (1000, clean), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows + extra], DOCS)
    kept = [(r.doc_id, r.text) for r in stages.drop_toxic(spark, docs, str(tmp_path)).collect()]
    assert Counter(x for x in kept if x[0] in (None, 1000)) == Counter([(None, clean), (1000, clean), (1000, clean), (None, None)])
    assert {d for d, _ in kept if d is not None and d < 1000} >= {d for d, y in labels if not y}


def test_tokens_beyond_one_pass_count_too(spark):
    """With 40 tokens a pass there are many passes, and every score is that of one pass; the rarest toxic word still scores."""
    rows, labels = corpus(random.Random(53), 150)
    rows = [(i, t + (" zzrare" if i % 3 == 0 and i % 5 else "")) for i, t in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    columns = ["doc_id", "score", "best", "tokens", "passages"]
    one = {r.doc_id: r for r in toxicity.score(docs, marks).select(*columns).collect()}
    many = {r.doc_id: r for r in toxicity.score(docs, marks, toxicity.Settings(tokens=40)).select(*columns).collect()}
    assert one == many and any(r.best > 0 for r in one.values())
    lone = spark.createDataFrame([(5000, "zzrare")], "doc_id long, text string")
    scored = toxicity.score(docs.unionByName(lone), marks, toxicity.Settings(tokens=40)).where("doc_id = 5000").first()
    assert scored.best > 0
