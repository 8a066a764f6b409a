"""Every registered query of the training-data operators, and the pipeline against the composition of plain versions."""

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from dipfleet.llm import nearcopies, queries, stages
from tests.llm.test_operators import DOCS, roots, sentence
from tests.llm.test_toxicity import FOUL, plain_scores

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows_are_those_of_the_contract(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    have = dict(out.dtypes)
    assert {c: have.get(c) for c, _ in (p.split(" ") for p in COLUMNS[name].split(", "))} == dict(p.split(" ") for p in COLUMNS[name].split(", "))
    rows = out.toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name == "op1_topk":
        assert (rows.groupby("query_id")["rank"].max() == 10).all()
    elif name == "op7_near_vectors":
        assert len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    elif name == "op12_whitening":
        assert len(rows) == 4 * spark.read.parquet(f"{DATA}/embeddings.parquet").count() and rows["identity_error"].max() <= 1e-4
    elif name == "op8_packing":
        assert rows["doc_id"].nunique() == docs and (rows["doc_tokens"] == rows.groupby("doc_id")["length"].transform("sum")).all()
    else:
        assert len(rows) == docs
    if "predicted" in have:
        assert (rows["predicted"] == (rows["score"] >= (0.5 if name == "op2_quality" else 0.7)).astype(int)).all()


def cut(rows, length=50):
    """(id, text) with every byte gone that a string of `length` bytes covers which a smaller id holds too."""
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
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def plain_pipeline(rows, labels, encode):
    """Rows (id, text, source), stage by stage in plain Python (the mix by its SQL): pieces (id, start, ids) and counts between."""
    scores = plain_scores([(n, t) for n, (_, t, _) in enumerate(rows)], [(n, dict(labels)[d]) for n, (d, _, _) in enumerate(rows) if d in dict(labels)])
    clean = [r for n, r in enumerate(rows) if scores[n][2] < 0.7 or scores[n][1] <= 0]
    sets = [nearcopies.shingles((t or "").encode()) for _, t, _ in clean]
    near = [(i, j) for i in range(len(clean)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    classes = roots(range(len(clean)), near)
    best = {}
    for n, (d, t, s) in enumerate(clean):
        best.setdefault(classes[n], []).append((d is None, d or 0, n))
    single = [clean[min(of)[2]] for of in best.values()]
    texts = cut([(d, t) for d, t, _ in single])
    con = duckdb.connect()
    con.register("raw", pd.DataFrame([(d, t, s) for (d, t), (_, _, s) in zip(texts, single)], columns=["doc_id", "text", "source"]))
    con.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from raw")
    taken = {r.doc_id: int(r.taken // r.size) if r.size else None for r in con.execute(queries.OP5_SQL).df().itertuples()}
    pieces = Counter()
    for d, t in texts:
        ids = encode(t, add_special_tokens=False).ids + [1]
        if taken[d]:
            pieces[(d, tuple(ids))] += taken[d]
    return pieces, len(clean), len(single)


def test_pipeline_equals_the_composition_of_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(71)
    rows, labels = [], []
    shared = sentence(rnd, 25)
    for i in range(160):
        words = sentence(rnd, rnd.randint(8, 60))
        toxic = i % 4 == 0
        if toxic:
            words += " " + " ".join(rnd.choice(FOUL) for _ in range(4))
        elif i % 4 == 1:
            words += " " + shared
        elif i % 8 == 2 and i > 20:
            words = rows[i - 1][1]
        rows.append((i, words, f"s{i % 3}"))
        if i % 5:
            labels.append((i, int(toxic)))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], DOCS)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want, clean, single = plain_pipeline(rows, labels, Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")).encode)
    assert single < clean < len(rows)
    got, at = Counter(), {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        at.setdefault((r.doc_id, r.start), []).append(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    for d in {d for d, _ in at}:
        starts = sorted(s for e, s in at if e == d)
        assert len({len(at[(d, s)]) for s in starts}) == 1 and all(len(set(at[(d, s)])) == 1 for s in starts)
        got[(d, sum((at[(d, s)][0] for s in starts), ()))] += len(at[(d, 0)])
    assert {k: v for k, v in got.items() if len(k[1]) > 1} == {k: v for k, v in want.items() if len(k[1]) > 1}


def test_stages_keep_what_no_rule_takes(spark, tmp_path):
    """Clean, unlike documents with null ids or one id for all pass every filtering stage."""
    rnd = random.Random(72)
    texts = [sentence(rnd, 40) for _ in range(30)]
    spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for one in (None, 7):
        docs = spark.createDataFrame([(one, t, "en", "s", 1) for t in texts], DOCS)
        for stage in (stages.drop_toxic, stages.drop_near_copies, stages.cut_repeats):
            docs = stage(spark, docs, str(tmp_path))
        assert sorted(r.text for r in docs.collect()) == sorted(texts)
