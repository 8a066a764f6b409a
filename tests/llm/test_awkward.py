"""Values, not counts: what operators and stages give for nulls, empty and blank texts, repeats, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dipfleet.llm import components, mixing, packing, quality, secrets, sharding, simhash, stages, suffixes, tokencount, toxicity
from dipfleet.llm.middle import fill_in_middle
from dipfleet.llm.queries import tokenizer_path
from tests.llm.test_operators import DATA, DOCS, sentence

TEXTS = [None, "", " \n\t", "one two three four five six seven", "one two three four five six seven", "é 日本"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 2 else None, t, "en", None if i == 1 else "s", None) for i, t in enumerate(TEXTS)]
    rows.append(rows[3])  # an exact repeat
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "name", "block", "key", "f", "token", "_row", "component", "shard")})


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_simhash(docs):
    got = by_row(simhash.near_texts(docs), "doc_id", "fingerprint", "component_id")
    zero = "0" * 16
    assert [g for g in got if g[1] == zero] == sorted([(0, zero, 0), (1, zero, 0), (None, zero, 0)], key=str)
    assert [(d, c) for d, f, c in got if d in (3, 4)] == [(3, 3), (3, 3), (4, 3)] and [c for d, _, c in got if d == 5] == [5]


def test_tokens_and_sizes(docs):
    counts = {d: (b, n) for d, b, n in by_row(tokencount.token_counts(docs, tokenizer_path("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_tokens")}
    assert counts[0] == counts[1] == (0, 0) and counts[3] == counts[4] and counts[5][0] == len("é 日本".encode())
    mixed = {d: (s, t) for d, s, t in by_row(mixing.mix(docs), "doc_id", "size", "source_size")}
    assert mixed[0] == (0, 23) and mixed[1] == (0, 0) and mixed[3] == (7, 23) and mixed[5] == (2, 23)


def test_sharding(docs):
    rows = by_row(sharding.shard(docs), "doc_id", "size", "text_crc32", "shard", "slot")
    assert [r[1:3] for r in rows if r[0] in (0, 1)] == [(1, 0), (1, 0)] and len({r[3] for r in rows if r[0] in (0, 1)}) == 1
    assert len({r[3] for r in rows if r[0] in (3, 4)}) == 1 and len({r[3:] for r in rows}) == len(rows) == 7


def test_repeats(docs):
    """Short texts have no window of 50 bytes; a text again under a larger id goes whole, a blank character and all."""
    got = {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect()}
    assert got == {(d, len((t or "").encode()), 0, (t or "").encode()) for d, t in zip([0, 1, None, 3, 4, 5], TEXTS)}
    long = docs.where("doc_id in (3, 4)").withColumn("text", F.repeat("text", 3))
    assert by_row(suffixes.without_repeats(long), "doc_id", "n_removed", "n_spans") == [(3, 0, 0), (3, 0, 0), (4, 99, 1)]


def test_scores(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert all(r.score < 0.5 and r.best == 0 and r.passages == [] for r in toxicity.score(docs, none).collect())


def test_packing(docs):
    pieces = by_row(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")), "doc_id", "start", "length", "doc_tokens")
    assert [p for p in pieces if p[0] in (0, 1)] == [(0, 0, 1, 1), (1, 0, 1, 1)]
    assert [p for p in pieces if p[0] == 3] == sorted(2 * [p[:1] + p[1:] for p in {p for p in pieces if p[0] == 3}]) and sum(p[2] for p in pieces if p[0] == 4) == next(p[3] for p in pieces if p[0] == 4)


def test_secrets_and_middle(docs):
    assert all((r.base, r.spans) == ("", "") for r in secrets.find_secrets(docs).collect())
    got = {r.doc_id: (r.n, r.form, r.output) for r in fill_in_middle(docs).collect()}
    assert got[0] == got[1] == (0, "plain", "") and got[5][0] == 1 and len(got) == 6


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, None), (None, 4), (5, 5), (7, 6), (7, 6), (6, 2)], "a long, b long")
    assert by_row(components.components(links), "node", "component") == [(1, 1), (2, 1), (6, 1), (7, 1)]
    assert components.components(links.limit(0)).count() == 0


def test_stages(spark, docs):
    """Near copies: of equal texts the least id stays, once; blank texts are one class. The other stages drop nothing here."""
    table = docs.select(*stages.COLUMNS)
    assert by_row(stages.drop_near_copies(spark, table, DATA), "doc_id", "text")[0::1] in [sorted([(3, TEXTS[3]), (5, TEXTS[5]), (0, None)], key=str)]
    assert by_row(stages.drop_toxic(spark, table, DATA), *stages.COLUMNS) == by_row(table, *stages.COLUMNS)
    cut = by_row(stages.cut_repeats(spark, table, DATA), "doc_id", "text", "n_chars")
    assert cut == sorted([(d, t or "", len(t or "")) for d, t in [*zip([0, 1, None, 3, 4, 5], TEXTS), (3, TEXTS[3])]], key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_very_many_times(spark):
    """A row 3,000 times is one class, one shard and one text to each operator."""
    rnd = random.Random(91)
    rows = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(sentence(rnd, 30)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert stages.drop_near_copies(spark, rows, DATA).count() == 1
    assert {r.component_id for r in simhash.near_texts(rows).collect()} == {7}
    shards = sharding.shard(rows).toPandas()
    assert shards["shard"].nunique() == 1 and (np.sort(shards["slot"]) == np.arange(3_000)).all()
    assert suffixes.without_repeats(rows).agg(F.sum("n_removed")).first()[0] == 0
    others = spark.range(3).select((F.col("id") + 8).alias("doc_id"), F.concat(F.lit("x "), F.lit(rows.first().text)).alias("text"))
    cut = suffixes.without_repeats(rows.select("doc_id", "text").unionByName(others)).groupBy("doc_id", "n_removed").count()
    size = len(rows.first().text)
    assert by_row(cut, *cut.columns) == sorted([(7, 0, 3_000), (8, size, 1), (9, size + 2, 1), (10, size + 2, 1)], key=str)


def test_repeats_are_one_row_a_batch_and_unlike_rows_stay_apart(spark):
    """A row 50,000 times in 16 partitions reaches the blocks as a row for each batch; rows that differ in id, text or another column stay."""
    rows = spark.range(50_000).select(F.lit(7).cast("long").alias("_id"), F.lit("a").alias("_text"), F.struct(F.lit("s").alias("source")).alias("_row")).repartition(16)
    unlike = spark.createDataFrame([(7, "b", ("s",)), (None, "a", ("s",)), (7, None, ("s",)), (7, "a", ("t",)), (7, "a", (None,))], "_id long, _text string, _row struct<source string>").coalesce(1)
    got = suffixes.once_a_batch(rows.unionByName(unlike)).collect()
    alike = [r._n for r in got if (r._id, r._text, r._row.source) == (7, "a", "s")]
    assert sum(alike) == 50_000 and len(alike) <= 16 and len(got) - len(alike) == 5 and all(r._n == 1 for r in got if r._row.source != "s")
