"""Operators on small tables, against brute force; then on awkward tables: nulls, empty tables, repeats, odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipfleet.llm import components, metricjoin, mixing, packing, quality, sharding, simhash, stages, suffixes, tokencount, topk, toxicity
from dipfleet.llm.queries import OP5_SQL, tokenizer_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("er", "tion", "the", "an", "re", "ou", "st", "ing") for b in ("ha", "nd", "ly", "on", "es", "ti", "wh", "or")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def corpus(rnd, n=60):
    """Texts with copies, near copies and shared passages."""
    shared = sentence(rnd, 20)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(rnd.choice(texts))
        elif kind == 2:
            texts.append(f"{sentence(rnd, rnd.randint(0, 10))} {shared} {sentence(rnd, rnd.randint(0, 30))}")
        elif kind == 3 and texts:
            words = rnd.choice(texts).split()
            words[rnd.randrange(len(words)) if words else 0 :][:1] = []
            texts.append(" ".join(words) + " é" * rnd.randint(0, 3))
        else:
            texts.append(sentence(rnd, rnd.randint(0, 80)))
    return texts


def frame(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", (sources[i] if sources else f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, one very long text, columns with names of our own."""
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a", sentence(rnd, 40), sentence(rnd, 30_000), "Ünï 日本 😀 " * 20, None, "x" * 5000]
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[1], (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    odd = ["size", "score", "f", "node", "component", "bucket", "block", "_b", "_n", "_key", "_size", "_source", "_row", "_text", "_id", "_block", "_doc", "_label", "shard", "gkey", "rank", "tokens", "kept", "ids", "_copies", "_gone", "_stays"]
    return df.withColumns({c: F.lit(7) for c in odd}).withColumn("_target", F.lit("x"))


# --- against brute force ---------------------------------------------------------------------------------------------


def brute_repeats(rows, length=50):
    """(id, text) -> (bytes, removed, spans, digest of the rest)."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < (1 << 61 if i is None else i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [64, 1])
def test_repeats(spark, hot):
    """hot=1: every shared anchor goes window by window."""
    rnd = random.Random(2)
    texts = corpus(rnd, 80) + ["ab" * 200, "ab" * 90, "x" * 49, "x" * 50, "x" * 51, None, "é" * 60, "a" + "é" * 60]
    ids = rnd.sample(range(-50, 1000), len(texts))
    ids[7] = None
    rows = list(zip(ids, texts)) + [(ids[3], texts[3]), (ids[2], texts[9])]
    passage = sentence(rnd, 25)  # in every document of one id, and of none
    rows += [(500, f"{sentence(rnd, 12)} {passage}") for _ in range(60)] + [(None, f"{passage} {sentence(rnd, 12)}") for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.without_repeats(docs, 50, hot=hot, fan=2, block_bytes=1 << 12).withColumn("d", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "d").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_names_only_bring_strings_together():
    """However many strings share a name, each is held against the bytes of the first and named anew if it differs."""
    rnd = random.Random(12)
    strings = [rnd.choice([b"abc", b"abd", b"ab", b"xyz", b""]) for _ in range(300)]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    group = np.array([rnd.randrange(3) for _ in strings])
    order, new = suffixes.named_strings(buf, np.cumsum(lengths) - lengths, lengths, np.zeros(300, np.uint64), group)
    seen = [[(int(group[i]), strings[i]) for i in c] for c in np.split(order, np.flatnonzero(new)[1:])]
    assert all(len(set(c)) == 1 for c in seen) and len({c[0] for c in seen}) == len(seen)


def roots(nodes, links):
    label = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not changed:
            return label


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 40)]
    rnd.shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_texts(spark):
    rnd = random.Random(4)
    base = [sentence(rnd, 200) for _ in range(8)]
    texts = base + [b + " " + rnd.choice(WORDS) for b in base] + [b.upper() for b in base] + ["", " ", None] + [sentence(rnd, 3) for _ in range(10)]
    got = {r.doc_id: r for r in simhash.near_texts(frame(spark, texts)).collect()}
    prints = {i: simhash.fingerprint((t or "").encode(), 3) for i, t in enumerate(texts)}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = roots(prints, links)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("slicing", [{}, {"slice_rows": 40, "every": 1}])
def test_links_below_a_hot_pattern(spark, slicing):
    """Most fingerprints share two blocks: one node, whole or dealt in pairs of slices, finds the same classes."""
    rnd = random.Random(14)
    values = {(0xABCD1234 << 32 | rnd.getrandbits(20)) for _ in range(250)} | {rnd.getrandbits(64) for _ in range(50)}
    values |= {v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in list(values)[:60]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(v,) for v in signed], "f long"), 2, **slicing).collect()]
    want = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert roots(values, found) == roots(values, want)


@pytest.mark.parametrize("tile", [2048, 16])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), [float(x) for x in centres[i % 12] * rng.uniform(0.5, 3) + rng.normal(size=8) * rng.choice([0.02, 0.2, 0.6])]) for i in range(240)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [0.0] * 8), (503, None), (504, [float("nan")] + [1.0] * 7), (505, [1.0, None] + [1.0] * 6), (506, [float("inf")] * 8), (507, []), (508, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metricjoin.near_vectors(df, 0.95, cell_rows=20, tile=tile).collect()}
    good = [(i, np.array(v)) for i, v in rows if i < 502]
    x = np.stack([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want = roots([i for i, _ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    counts = dict(zip(ids, near.sum(1).tolist()))
    assert got == {i: (counts.get(i, 0), want[i], want[i] == i) for i, _ in rows}


def test_topk(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(150)] + [(200, None), (300, [float("nan")] * 4), (400, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.topk(df, F.col("vec_id") % 20 == 0, 10, query_block=3, shard_rows=16).orderBy("query_id", "rank").collect()]
    v = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows[:150]}
    want = []
    for q in sorted(i for i in v if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:10]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == want


def test_mixing_equals_sql_on_awkward_rows(spark, awkward):
    pdf = awkward.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("raw", pdf)
    con.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from raw")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(OP5_SQL).df()[columns]
    got = mixing.mix(awkward).select(columns).toPandas()
    key = lambda d: sorted(str([None if pd.isna(x) else float(x) for x in r]) for r in d.itertuples(index=False))
    assert key(got) == key(want)


def test_mixing_targets(spark):
    rnd = random.Random(7)
    sources = ["a"] * 500 + ["b"] * 60 + ["c"] * 15 + [None] * 100
    texts = [sentence(rnd, rnd.randint(1, 40)) for _ in sources]
    rows = mixing.mix(frame(spark, texts, sources), per_task=64).toPandas()
    sizes = rows.groupby("source", dropna=False)["size"].sum()
    total = int(sizes.sum())
    targets = rows.groupby("source", dropna=False)["target"].first()
    assert abs(targets.sum() - total) < 1e-6 * total and (targets.values <= 3 * sizes.values + 1e-6).all()
    taken = rows.groupby("source", dropna=False)["taken"].sum()
    assert (np.abs(taken.values - targets.values) <= 20).all()  # half of the longest text
    assert (rows["taken"] <= 3 * rows["size"]).all()
    repeated = Counter(r.doc_id for r in mixing.mixed(frame(spark, texts, sources), per_task=64).collect())
    assert repeated == Counter({int(r.doc_id): int(r.copies) for r in rows.itertuples() if r.copies})


@pytest.mark.parametrize("kind", ["null", "three", "repeats", "junk"])
def test_mixing_meets_targets_whatever_the_ids(spark, kind):
    """Null ids, few ids, exact repeats (a third of all rows and more), and texts full of marks."""
    rnd = random.Random(17)
    texts, sources, ids = [], [], []
    for i in range(900):
        texts.append("one text of six words here" if kind == "repeats" and i % 3 else sentence(rnd, rnd.randint(1, 30)) + (" #$%&| *" * 9 if kind == "junk" else ""))
        sources.append("a" if i % 9 else "b")
        ids.append({"null": None, "three": i % 3, "repeats": i if i % 3 == 0 else 7}.get(kind, i))
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in zip(ids, texts, sources)], DOCS).repartition(5)
    rows = mixing.mix(docs, per_task=50).toPandas()
    assert len(rows) == 900 and (rows["taken"] <= 3 * rows["size"]).all()
    for _, of in rows.groupby("source"):
        assert abs(of["taken"].sum() - of["target"].iloc[0]) <= of["size"].max() / 2 + 1e-6
    copies = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(docs, per_task=50).collect())
    want = Counter()
    for r in rows.itertuples():
        want[(None if pd.isna(r.doc_id) else int(r.doc_id), r.source, r.size)] += r.copies
    assert copies == +want


def test_mixing_ranges_are_even(spark):
    """Ranges of keys hold about as many rows each, also where all texts are full of marks."""
    rnd = random.Random(18)
    docs = frame(spark, [sentence(rnd, 5) + " #" * rnd.randint(0, 60) for _ in range(4000)], ["a"] * 4000)
    keyed = mixing.with_keys(docs, "doc_id", "text", "source", 17).groupBy("_source", "_key", "_size").count().repartitionByRange(20, "_source", "_key", "_size")
    counts = keyed.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert counts.max() <= 3 * counts.mean()


def test_sharding(spark):
    rnd = random.Random(8)
    texts = [sentence(rnd, rnd.randint(0, 60)) for _ in range(700)] + ["same text"] * 40 + ["", None, ""]
    rows = sharding.shard(frame(spark, texts), 8).toPandas()
    assert len(rows) == len(texts) and rows.groupby("text_crc32")["shard"].nunique().max() == 1
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows.itertuples()} == want
    load = rows.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() < 0.02 * load.mean()
    for _, slots in rows.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_packing(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    texts = [sentence(rnd, rnd.randint(0, 4000)) for _ in range(12)] + ["", None]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy(F.desc(F.length("text"))).limit(60).collect()]
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(frame(spark, texts), path).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    encode = Tokenizer.from_file(path).encode  # of the library, not our own
    for i, t in enumerate(texts):
        pieces = sorted(of[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length and r.offset == 0 for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist() and {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_number = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number)  # numbers run within a length


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    texts = [*corpus(random.Random(10), 30), None, ""]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.token_counts(frame(spark, texts), path).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}


def accuracy(scored, labels, column, at):
    rows = scored.join(labels, "doc_id").where("held_out").select("score", column).toPandas()
    return ((rows["score"] >= at) == (rows[column] == 1)).mean(), len(rows)


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got, n = accuracy(quality.score(docs, known), known, "quality", 0.5)
    assert n > 100 and got > 0.93
    got, n = accuracy(toxicity.score(docs, known), known, "toxic", 0.7)
    assert n > 100 and got > 0.93


def test_toxic_passages_are_found(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, known).where("score >= 0.7").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert rows
    for r in rows:
        for p in r.passages:
            part = r.text.encode()[p.start : p.end]
            assert 0 <= p.start < p.end <= len(r.text.encode()) and not part[:1].isspace() and not part[-1:].isspace()


# --- awkward tables --------------------------------------------------------------------------------------------------

OPERATORS = {
    "quality": lambda d, k: quality.score(d, k),
    "sharding": lambda d, k: sharding.shard(d),
    "toxicity": lambda d, k: toxicity.score(d, k),
    "mixing": lambda d, k: mixing.mix(d),
    "simhash": lambda d, k: simhash.near_texts(d),
    "tokens": lambda d, k: tokencount.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
    "repeats": lambda d, k: suffixes.without_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward(spark, awkward, labels, name):
    """A row for every row, whatever it holds, and none for none."""
    n = awkward.count()
    assert OPERATORS[name](awkward, labels).count() == n
    assert OPERATORS[name](awkward.limit(0), labels.limit(0)).count() == 0
    assert OPERATORS[name](awkward, labels.limit(0)).count() == n


def test_awkward_pack(spark, awkward):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(awkward, path).collect()
    assert sum(r.start == 0 for r in rows) == awkward.count() and sum(r.doc_tokens == 1 for r in rows) == 5
    assert packing.pack(awkward.limit(0), path).count() == 0


def test_awkward_scores_are_defined(spark, awkward, labels):
    for scored in (quality.score(awkward, labels), toxicity.score(awkward, labels)):
        rows = scored.collect()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "cut_repeats", "mix_sources"])
def test_awkward_stages(spark, awkward, stage):
    """Stages return the columns of documents, and nothing for nothing."""
    run = getattr(stages, stage)
    docs = awkward.select(*stages.COLUMNS)
    out = run(spark, docs, DATA)
    assert out.columns == stages.COLUMNS and out.count() > 0
    assert run(spark, docs.limit(0), DATA).count() == 0
    if stage in ("drop_toxic", "cut_repeats"):
        assert out.count() == docs.count()  # nothing here is toxic, and cutting drops no document


def test_awkward_vectors(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [])], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "q", "cell", "copies", "home", "score", "rank", "shard", "block", "node")})
    rows = metricjoin.near_vectors(odd).collect()
    assert len(rows) == 6 and sorted(r.n_links for r in rows) == [0, 0, 0, 0, 1, 1]
    assert metricjoin.near_vectors(odd.limit(0)).count() == 0
    assert topk.topk(odd.limit(0), F.col("vec_id") == 1).count() == 0
    found = topk.topk(odd, F.col("vec_id").isin(1, 3), 3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(1, 1, 3, 0), (1, 2, 4, 0), (3, 1, 1, 0), (3, 2, 1, 0), (3, 3, 4, 0)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, DATA).count() > 0
