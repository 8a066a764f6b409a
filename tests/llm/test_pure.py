"""Helpers without Spark, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from dipfleet.llm import common, metricjoin, mixing, packing, quality, sharding, simhash, suffixes, tokencount, topk, toxicity
from dipfleet.llm.queries import tokenizer_path


def pack_bytes(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_word_spans_stay_in_their_text():
    buf, offsets = pack_bytes(["ab c", "d", "", " \t", "e\nf"])
    starts, ends, text = common.word_spans(buf, offsets)
    assert [(bytes(buf[a:b]), int(t)) for a, b, t in zip(starts, ends, text)] == [(b"ab", 0), (b"c", 0), (b"d", 1), (b"e", 4), (b"f", 4)]


def test_span_hash_depends_on_bytes_alone():
    buf, _ = pack_bytes(["xabcabc"])
    prefix = common.prefix_hash(buf)
    h = common.span_hash(prefix, np.array([1, 4, 0]), np.array([4, 7, 3]))
    assert h[0] == h[1] != h[2]


def test_local_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 30
        a, b = rng.integers(0, n, 20), rng.integers(0, n, 20)
        label = common.local_components(n, a, b)
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert (label == want).all()


def test_token_counts_equal_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.Pieces(path)
    rnd = random.Random(3)
    alphabet = "aabcdefthen  ▁ é\n\t\r(){};\"'=,.<s>日本語😀\x0001²ſ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, "ab" * 1500, " " * 700, "the" * 900, "=-" * 800, "e, s. t!", "<s></s><unk><0x41>"]
    assert model.count(texts) == [len(x) for x in sp.encode(texts)]


def test_pack_ids_equal_the_library():
    ids = packing.Ids(tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    alphabet = "aabcdefthen  \x1c\x85\xa0　 é\n\t\r(){};\"'s=日本語😀\x0001ſ²Ⅷ×÷"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["", "a<|endoftext|>b", "don't  stop", "x" * 2000]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 7, 2047, 2048, 2049, 5000, 65537])
def test_powers(n):
    got = packing.powers(n, 2048)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got) and sum(x < 2048 for x in got) == (n % 2048).bit_count()


def test_difference_is_tight_and_keeps_every_group():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 10_000) for _ in range(500)]
    sums, place = sharding.difference([[s] + [0] * 7 for s in sizes])
    again = [0] * 8
    for s, p in zip(sizes, place):
        again[p[0]] += s
    assert again == sums and max(sums) - min(sums) < 0.001 * sum(sizes)
    # the classic two-way example: 8, 7, 6, 5, 4 differ by 2
    sums, _ = sharding.difference([[s, 0] for s in (8, 7, 6, 5, 4)])
    assert max(sums) - min(sums) == 2


def brute_segments(scores):
    """Maximal segments by definition: split at the best segment, again and again."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_maximal_segments():
    rnd = random.Random(6)
    for _ in range(300):
        scores = [rnd.choice([-3.5, -2.25, -1.125, 1.0625, 2.03125, 3.015625]) + rnd.random() * 1e-3 for _ in range(rnd.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == brute_segments(scores)


def test_fingerprints_equal_a_plain_version():
    import xxhash

    rnd = random.Random(7)
    for _ in range(60):
        text = "".join(rnd.choice("aB c\té\n ") for _ in range(rnd.randint(0, 200)))
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode(), 3) == want


def test_index_classes_are_those_of_every_pair():
    """Also of several words, in chunks of any size."""
    rng = np.random.default_rng(8)
    for most, chunk in ((0, 64), (2, 64), (5, 1 << 20), (3, 9)):
        centres = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
        flips = np.zeros((45, 2), np.uint64)
        for n, row in enumerate(flips):
            for bit in rng.integers(0, 128, (1, 2, 2, 3, 4)[n % 5]):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        f = np.unique(np.concatenate([centres, *[centres[rng.integers(0, 12, 3)] ^ x for x in flips]]), axis=0)
        group = rng.integers(0, 2, len(f))
        order = np.lexsort((*simhash.gray_rank(f).T[::-1], group))
        f, group = f[order], group[order]
        apart = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
        a, b = np.nonzero((apart <= most) & (group[:, None] == group[None]))
        want = common.local_components(len(f), a, b)
        sure, left, right = simhash.index_classes(f, group, [most // 2, most], fanout=3, chunk=chunk)
        i, j = np.nonzero((apart <= most // 2) & (group[:, None] == group[None]))
        assert (sure == common.local_components(len(f), i, j)).all() and (apart[left, right] <= most).all()
        assert (common.joined_classes(sure, left, right)[0] == want).all() and len(left) == len(set(sure)) - len(set(want))


def test_tile_top_with_ties():
    rng = np.random.default_rng(9)
    for _ in range(100):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        ids, scores = rng.permutation(n * 2)[:n], rng.integers(0, 4, (3, n))
        own = rng.choice(ids, 3)
        q, c = topk.tile_top(scores.astype(np.int64), ids, own, k)
        for i in range(3):
            want = sorted((-s, v) for s, v in zip(scores[i], ids) if v != own[i])[:k]
            assert [(-scores[i][j], ids[j]) for j in c[q == i]] == want


def test_inner_is_exact_beyond_doubles():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]])
    assert topk.inner(a, b)[0, 0] == 2**60 + 1


def test_sort_windows():
    rng = np.random.default_rng(10)
    for length in (50, 20, 9):
        base = rng.integers(97, 99, 300).astype(np.uint8)
        blob = np.concatenate([base, base[:200], rng.integers(97, 100, 300).astype(np.uint8), base[100:]])
        starts = np.arange(len(blob) - length + 1)
        order, new = suffixes.sort_windows(blob, starts, length)
        strings = [blob[s : s + length].tobytes() for s in starts[order]]
        assert strings == sorted(strings)
        assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_anchored_runs_cover_every_window_once_and_depend_on_its_bytes():
    rng = np.random.default_rng(11)
    shared = rng.integers(97, 123, 90).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() + shared + rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 10, 333)] + [b"", b"x" * 49, b"y" * 120]
    buf, offsets = pack_bytes(texts)
    first, windows, h, text = suffixes.anchored_runs(buf, offsets, 50, 20)
    got = {}
    for s, n, a, t in zip(first, windows, h, text):
        for i in range(n):
            got[int(s + i - offsets[t]), int(t)] = (buf[s + i : s + i + 50].tobytes(), int(a))
    assert set(got) == {(i, t) for t, x in enumerate(texts) for i in range(len(x) - 49)}
    anchors = {}
    for window, anchor in got.values():
        assert anchors.setdefault(window, anchor) == anchor


def test_term_counts_do_not_depend_on_neighbours():
    texts = ["The the the", "", "a | b | c", "É!! X"]
    whole = quality.term_counts(*pack_bytes(texts))
    for i, t in enumerate(texts):
        assert (quality.term_counts(*pack_bytes([t]))[0] == whole[i]).all()
    shapes = whole[0][: quality.SHAPES]  # the columns of words follow
    assert shapes[-1] == 3 and shapes[-3] == 1 and shapes[-2] == 1
    assert mixing.BROADCAST_SOURCES


def test_other_piece_models_are_refused():
    import sentencepiece

    from dipfleet.llm.queries import tokenizer_path

    raw = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")).serialized_model_proto()
    tokencount.require_plain_bpe(raw)

    def message(field, body):
        return bytes([field << 3 | 2, len(body)]) + body

    for extra, why in ((message(1, b"\x0a\x01x\x18\x04"), "user-defined"), (message(2, b"\x18\x01"), "merges"), (message(3, b"\x12\x02ab\x20\x00"), "normalizer"), (message(3, b""), "normalizer")):
        with pytest.raises(ValueError, match=why):
            tokencount.require_plain_bpe(raw + extra)


def test_pivots_leave_out_most_pairs_of_clustered_vectors():
    """No near pair is left out, and on clusters less than a tenth of all pairs would reach a product."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(60, 24))
    x = metricjoin._unit(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.1)
    d = metricjoin._distances(x, x[:32])
    reach, tried, seen = float(np.sqrt(0.1)), 0, []
    for block, some in metricjoin.pruned_blocks(d, d, reach):
        tried += len(block) * len(some)
        seen.append(block)
        near = np.flatnonzero((x[block] @ x.T >= 0.95).any(0))
        assert np.isin(near, some).all()
    assert sorted(np.concatenate(seen)) == list(range(6000)) and tried < 0.1 * 6000**2


@pytest.mark.parametrize("blocks", [16, 1_000, 100_000])
def test_messages_of_anchors_grow_with_the_root_of_the_table(blocks):
    """Anchors of four blocks reach their buckets by stations and come back: those that two ids share, and no others."""
    rnd = np.random.default_rng(5)
    steps = suffixes.Exchange(50, 20, blocks, blocks // 2, blocks, 8192)
    shared = rnd.integers(97, 123, 500, np.uint8).tobytes().decode()
    texts = [[rnd.integers(97, 123, 20_000, np.uint8).tobytes().decode() + (shared if b in (1, 2) else "")] for b in range(4)]
    docs = [pa.table({"_block": [b], "_id": [b], "_text": t}) for b, t in enumerate(texts)]
    sent = [steps.anchors(d) for d in docs]
    root = int(blocks**0.5)
    assert max(m.num_rows for m in sent) <= root + 3

    def by(messages, column):
        keys = np.asarray(messages.column(column))
        return {k: messages.filter(pa.array(keys == k)) for k in np.unique(keys).tolist()}

    stations = by(pa.concat_tables(sent), "bucket")
    routed = [steps.routed(m) for m in stations.values()]
    assert max(m.num_rows for m in routed) <= root + 3
    called = by(pa.concat_tables([steps.shared(m) for m in by(pa.concat_tables(routed), "bucket").values()]), "block")
    back = by(pa.concat_tables([steps.delivered(m, called[k]) for k, m in stations.items() if k in called]), "block")
    assert set(back) == {1, 2}
    raw = np.frombuffer(shared.encode(), np.uint8)

    def places(h):
        return {(int(k), int(x) & 0xFFFFFFFF | 1) for k, x in zip(steps._bucket(h, steps.buckets), h, strict=True)}

    begin = np.arange(len(raw) - 19)
    grams = common.span_hash(common.prefix_hash(raw), begin, begin + 20)
    for told in back.values():
        key, near, source = steps._arrived(told)
        got = {(int(k), int(x) | 1) for k, x in zip(np.asarray(told.column("bucket"))[source] + near, key, strict=True)}
        assert places(suffixes.anchored_runs(raw, np.array([0, len(raw)]), 50, 20)[2]) <= got <= places(grams)
        assert not (key & 1).any() and len(key) == len(got)
