"""The near-copy stage against brute force over all pairs, on planted copies."""

import random

import numpy as np

from dipfleet.llm import nearcopies, stages
from tests.llm.test_operators import DATA, DOCS, frame, roots


def text(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def similarity(a, b):
    x, y = nearcopies.shingles(a.encode()), nearcopies.shingles(b.encode())
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rnd, words, times):
    words = list(words)
    for at in rnd.sample(range(len(words)), times):
        words[at] = f"e{rnd.randrange(10**6)}"
    return words


def planted(rnd, families, sizes=(40, 200)):
    """Pairs of a text and its copy with a few words changed."""
    out = []
    for _ in range(families):
        base = text(rnd, rnd.randint(*sizes))
        out.append((" ".join(base), " ".join(edited(rnd, base, rnd.randint(1, max(1, len(base) // 30))))))
    return out


def test_planted_copies_from_08_to_095_go(spark):
    """Candidates are found with a probability: of pairs at 0.8 and above at least 95 of 100 go, from 0.85 on 98 of 100."""
    pairs = [p for p in planted(random.Random(31), 600) if 0.8 <= similarity(*p) <= 0.95]
    assert len(pairs) > 150 and any(similarity(*p) < 0.83 for p in pairs)
    docs = frame(spark, [t for p in pairs for t in p])
    kept = {r.doc_id for r in stages.drop_near_copies(spark, docs, DATA).collect()}
    assert kept >= set(range(0, 2 * len(pairs), 2))
    gone = [2 * i + 1 not in kept for i in range(len(pairs))]
    close = [g for g, p in zip(gone, pairs) if similarity(*p) >= 0.85]
    assert sum(gone) >= 0.95 * len(gone) and sum(close) >= 0.98 * len(close)


def test_texts_below_08_stay_and_chains_are_one_class(spark):
    """Chains: neighbours are similar, ends are not; the smallest key of a class need not be similar to all. No text goes
    without a similar one of its class; nearly all that should go do."""
    rnd = random.Random(32)
    texts = [t for p in planted(rnd, 150, (20, 60)) for t in p]
    for _ in range(6):
        words = text(rnd, 120)
        for _ in range(12):
            texts.append(" ".join(words))
            words = edited(rnd, words, 2)
    texts += ["", None, " \n", "one two", "ONE  two", "one two three"]
    rnd.shuffle(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i] or "", texts[j] or "") >= 0.8]
    want = set(roots(range(len(texts)), near).values())
    kept = {r.doc_id for r in stages.drop_near_copies(spark, frame(spark, texts), DATA).collect()}
    assert kept >= want and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_no_unlike_text_is_lost_under_one_id_or_none(spark):
    rnd = random.Random(33)
    a, b, c = (" ".join(text(rnd, 50)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, a), (3, c.upper()), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in stages.drop_near_copies(spark, docs, DATA).collect()]
    assert sorted(kept[:], key=str) in [sorted([(1, a), (1, b), (3, c.upper()), (None, x)], key=str) for x in (None, "")]


def test_wide_fingerprints_equal_a_plain_version_whatever_lies_beside():
    rnd = random.Random(34)
    texts = [b"a b c d e f g", b"", b"A  b C d\ne F g ", b"a b", b"a b c d e f h", " ".join(text(rnd, 70_000)).encode(), b"x y z " * 50]
    joined = np.frombuffer(b"".join(texts), np.uint8)
    found = nearcopies.wide_fingerprints(joined, np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        assert (nearcopies.wide_fingerprints(np.frombuffer(t, np.uint8), np.array([0, len(t)])) == found[i]).all()
    assert (found[0] == found[2]).all() and not found[1].any() and (found[0] != found[3]).any()


def test_masks_are_the_same_everywhere():
    masks = nearcopies.sampled_masks()
    assert (np.bitwise_count(masks).sum(1) == nearcopies.BITS).all() and (masks == nearcopies.sampled_masks()).all()


def families(rnd, n, size, least, most):
    """Texts of 300 words, each family around one base that is no text itself."""
    out = []
    for _ in range(n):
        base = text(rnd, 300)
        out += [" ".join(edited(rnd, base, rnd.randint(least, most))) for _ in range(size)]
    return out


def test_families_on_both_sides_of_the_threshold(spark):
    """Families whose pairs lie at 0.65 to 0.95: no text goes without a chain of similar pairs to the one that stays, and at least
    98 of 100 that should go do."""
    for seed, least, most in ((35, 1, 6), (36, 3, 9), (37, 5, 12)):
        texts = families(random.Random(seed), 60, 8, least, most)
        sets = [nearcopies.shingles(t.encode()) for t in texts]
        near = [(i, j) for i in range(len(texts)) for j in range(i - i % 8, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        want = set(roots(range(len(texts)), near).values())
        kept = {r.doc_id for r in stages.drop_near_copies(spark, frame(spark, texts), DATA).collect()}
        assert kept >= want and len(kept - want) <= 0.02 * (len(texts) - len(want)) + 1


def test_every_link_is_a_similar_pair(spark):
    """Also in one large family at the threshold, where most candidates fail."""
    texts = families(random.Random(38), 3, 150, 3, 8)
    docs = frame(spark, texts + texts[:50])
    named = nearcopies._named(docs.select("doc_id", "text"), 5)
    key = {bytes(r.key): r.name for r in named.select("key", "name").collect()}
    words = {key[nearcopies._digest(t.lower().encode())]: t for t in texts}
    assert len(words) == len(set(texts)) == named.count()
    found = nearcopies.links(named, docs).distinct().collect()
    assert len(found) > 50 and all(similarity(words[r.a], words[r.b]) >= 0.8 for r in found)
