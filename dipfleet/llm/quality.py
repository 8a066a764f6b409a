"""Quality by nearest-neighbour voting: exact blocked cosine products with labelled latent-semantic vectors.

Terms are the words of a text (hashed into a fixed number of columns) and the shape of its writing (runs of three kinds
of bytes, repeated words); a truncated singular value decomposition of the labelled rows gives the latent space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed, crc_mod3, parts, prefix_hash, span_hash, word_spans
from dipfleet.llm.toxicity import training_labels


@dataclass(frozen=True)
class Settings:
    """`labelled`: at most so many labelled documents are neighbours (by the order of a hash of their ids). `rank`:
    dimensions of the latent space. `neighbours`: votes for each document. `sharpness`: power of the similarity."""

    labelled: int = 4_096
    rank: int = 48
    neighbours: int = 31
    sharpness: float = 8.0


#: Kinds of bytes: lower case, upper case, digit, blank, line end, full stop or comma, quote or bracket, dash or slash,
#: symbol, bar, exclamation or question mark, byte of a longer character, other control.
KINDS = 13
_KIND = np.full(256, 8, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:", b"\"'()[]{}<>", b"-/\\_", b"", b"|", b"!?", range(128, 256), [*range(9), 11, 12, *range(14, 32), 127])):
    _KIND[list(_bytes)] = _k
#: Besides every run of three kinds: words that repeat the one before, words seen before in their text, and all words.
SHAPES = KINDS**3 + 3
#: Columns that words (in lower case) are hashed into.
COLUMNS = 1 << 12
TERMS = SHAPES + COLUMNS
#: Texts whose dense term rows are held at a time.
BLOCK = 256


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of at most `BLOCK` whole texts."""
    for part, buf, offsets in parts(batches, text):
        for a in range(0, part.num_rows, BLOCK):
            b = min(a + BLOCK, part.num_rows)
            yield part.slice(a, b - a), buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term counts for each text: shapes first, then words."""
    n = len(offsets) - 1
    kind = _KIND[buf].astype(np.int64)
    counts = np.zeros(n * TERMS, np.int64)
    if len(buf) > 2:
        text = np.repeat(np.arange(n), np.diff(offsets))
        inside = text[2:] == text[:-2]
        counts += np.bincount((text[2:] * TERMS + (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:])[inside], minlength=n * TERMS)
    low = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    starts, ends, of = word_spans(low, offsets)
    if len(starts):
        column = (span_hash(prefix_hash(low), starts, ends, seed=4) % np.uint64(COLUMNS)).astype(np.int64)
        counts += np.bincount(of * TERMS + SHAPES + column, minlength=n * TERMS)
    counts = counts.reshape(n, TERMS)
    counts, all_counts = counts[:, :SHAPES], counts
    if len(starts):
        words = span_hash(prefix_hash(buf), starts, ends)
        same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        counts[:, -3] = np.bincount(of[1:][same], minlength=n)
        counts[:, -1] = np.bincount(of, minlength=n)
        _, first = np.unique(words ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        counts[:, -2] = counts[:, -1] - np.bincount(of[first], minlength=n)
    return all_counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of share of the text times rarity, roots taken; shapes and words of length 1 each (0 for a text without)."""
    out = np.zeros(counts.shape)
    for part in (slice(0, SHAPES), slice(SHAPES, TERMS)):
        x = np.sqrt(counts[:, part] / np.maximum(counts[:, part].sum(1, keepdims=True), 1)) * idf[part]
        out[:, part] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return out


def latent_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors of the rows, by iterating a random subspace that is somewhat larger."""
    width = min(rank + 16, *x.shape)
    axes = np.random.default_rng(0).normal(size=(x.shape[1], width)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    return axes @ turn[:rank].T


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many there are, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for part, buf, offsets in blocks(batches, "text"):
            seen += (term_counts(buf, offsets) > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(TERMS), -1).astype(np.int32)), pa.array(np.append(seen, n))], ["term", "n"])

    found = rows.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    n = {r.term: r.n for r in found}
    return np.array([n.get(t, 0) for t in range(TERMS)]), n.get(-1, 0)


def counted(rows: DataFrame) -> DataFrame:
    """The labelled rows with their term counts (pairs of term and count), for the fit; of texts of one id the first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text"):
            counts = term_counts(buf, offsets)
            pairs = [np.stack([at := np.flatnonzero(c), c[at]]).astype("<u4").tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(pairs, pa.binary())], ["_doc", "_label", "counts"])

    found = rows.select("text", "_doc", "_label").mapInArrow(run, "_doc long, _label int, counts binary")
    return found.groupBy("_doc").agg(F.min("_label").alias("_label"), F.min("counts").alias("counts"))


@dataclass(frozen=True)
class Model:
    """Rarity of the terms, axes of the latent space, and the labelled vectors in it with their labels. Texts are placed, and cosines
    taken, in double precision."""

    idf: np.ndarray
    axes: np.ndarray
    known: np.ndarray
    label: np.ndarray

    def place(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return unit(weighted(term_counts(buf, offsets), self.idf) @ self.axes)

    def votes(self, at: np.ndarray, neighbours: int, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
        """Score and largest cosine of each vector: every labelled one is held against it, and the nearest vote."""
        cosine, k = at @ self.known.T, min(neighbours, len(self.label))
        top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(cosine, top, 1), 0)
        votes = near**sharpness
        weight = votes.sum(1)
        scores = np.full(len(at), float(self.label.mean()))
        some = weight > 0
        scores[some] = (votes * self.label[top]).sum(1)[some] / weight[some]
        return np.clip(scores, 0, 1), near.max(1)


def fit(rows: DataFrame, labels: DataFrame, settings: Settings, doc_id: str, label: str) -> Model:
    """Learn from rows `text, doc_id`: rarity from all of them, the space and the neighbours from the labelled ones."""
    train = F.broadcast(checkpointed(training_labels(labels.select(F.col(doc_id), F.col(label)), label, settings.labelled, doc_id)))
    seen, n = document_frequencies(rows)
    idf = np.log((n + 1) / (seen + 1)) + 1
    known = sorted((r._label, bytes(r.counts)) for r in counted(rows.join(train, rows["doc_id"] == train["_doc"])).collect())  # `labelled` rows at most
    if not known:
        return Model(idf, np.zeros((TERMS, 1)), np.zeros((1, 1)), np.full(1, 0.5))

    def block(a: int) -> np.ndarray:
        counts = np.zeros((len(known[a : a + BLOCK]), TERMS))
        for row, (_, pairs) in zip(counts, known[a : a + BLOCK], strict=True):
            term, count = np.frombuffer(pairs, "<u4").reshape(2, -1)
            row[term] = count
        return weighted(counts, idf)

    x = np.zeros((len(known), TERMS), np.float32)  # for the axes alone
    for a in range(0, len(known), BLOCK):
        x[a : a + BLOCK] = block(a)
    axes = latent_axes(x, settings.rank).astype(np.float64)
    at = np.concatenate([block(a) @ axes for a in range(0, len(known), BLOCK)])
    return Model(idf, axes, unit(at), np.array([y for y, _ in known], np.float64))


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:  # noqa: B008
    """Score every whole text for quality by the votes of its nearest labelled neighbours.

    Term rarity is counted over all documents; the latent space and the neighbours come from at most
    `settings.labelled` labelled ids outside the held-out third, broadcast as arrays of that fixed size. Every document
    is held against every neighbour in blocks; the nearest vote with the power of their cosine. Null and empty texts
    have no direction and get the share of good labels; null ids are scored and never held out; repeated rows are
    scored each (of several texts under a labelled id one is learned from); other columns are ignored; without labels
    every score is one half; an empty table gives an empty result.
    Returns `doc_id, held_out, score, nearest` (the largest cosine).
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, settings, doc_id, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, buf, offsets in blocks(batches, "text"):
            scores, nearest = model.votes(model.place(buf, offsets), settings.neighbours, settings.sharpness)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(scores), pa.array(nearest)], ["doc_id", "score", "nearest"])

    scored = rows.mapInArrow(run, "doc_id long, score double, nearest double")
    return scored.select("doc_id", F.coalesce(crc_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "nearest")
