"""The stages of the corpus pipeline: each takes the documents its predecessor kept and hands on the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfleet.llm.common import table
from dipfleet.llm.mixing import mixed
from dipfleet.llm.nearcopies import without_near_copies
from dipfleet.llm.packing import pack
from dipfleet.llm.queries import tokenizer_path
from dipfleet.llm.suffixes import without_repeats
from dipfleet.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity reaches 0.7 go, each by its own text, with or without an id; labels, priors and calibration are
    learned on this stage's own input. Rows whose text has no toxic passage always stay."""
    others = tuple(c for c in COLUMNS if c != "text")
    scored = score(docs, table(spark, sf_dir, "labels"), keep=others, carry_text=True)
    return scored.where("score < 0.7 or best <= 0").select(*["text" if c == "text" else f"_row.{c}" for c in COLUMNS])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts of similarity 0.8 and more (Jaccard, shingles of five words) stays, the one of
    smallest id; rows without an id are judged like any other."""
    return without_near_copies(docs, shingle=5, least=0.8, keep=("lang", "source", "n_chars")).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id holds are cut from the text; a character cut in
    half goes whole, null texts become empty, n_chars is counted anew, and no document is dropped."""
    cleaned = without_repeats(docs, 50, keep=("lang", "source"), as_text=True)
    return cleaned.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: whole epochs first, then a weighted sample. A null source is a source of
    its own; documents without words belong to no target and are taken by no epoch of an empty source, else like any other;
    rows without an id are sampled by their texts, exact repeats as many as come nearest; an empty table gives an empty result."""
    return mixed(docs, weights=(1, 2, 3), epochs=3).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces of documents with their ids, each a power of two long. A null or empty text is its end mark
    alone; rows without an id are packed like any other; repeated rows give their pieces again; texts of any length are cut
    whole; an empty table gives an empty result."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), longest=2048)
