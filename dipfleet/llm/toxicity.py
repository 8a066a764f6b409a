"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dipfleet.llm.common import checkpointed, crc_mod3, mix, parts, prefix_hash, span_hash, word_spans

#: Lower case for the ASCII letters, and a blank for ASCII punctuation, digits and controls: words are what is left.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class Settings:
    """Bounds and constants of the model; none depends on the size of the input.

    `labelled`: at most so many labelled documents are fitted on, taken by the order of a hash of their ids. `tokens`: so many
    different tokens of toxic ones are counted in a pass over the corpus; where there are more, in as many passes as they need. `stem`: a word also counts as its first so many
    bytes. `prior`: prior belief, spread like the corpus, as a share of all labelled tokens. `least_z`: a token counts as
    toxic beyond so many standard errors. `drift`: score of every other token. `least`: a passage is reported from this
    score on.
    """

    labelled: int = 20_000
    tokens: int = 1 << 20
    stem: int = 6
    prior: float = 0.1
    least_z: float = 3.0
    drift: float = -0.05
    least: float = 3.0


def token_hashes(buf: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Hashes of every word and of its stem (its first bytes), its text, start and end byte."""
    folded = FOLD[buf]
    starts, ends, text = word_spans(folded, offsets)
    prefix = prefix_hash(folded)
    return span_hash(prefix, starts, ends), span_hash(prefix, starts, np.minimum(ends, starts + settings.stem), seed=1), text, starts, ends


def _once(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the different words of each text."""
    return np.unique(word ^ mix(text.astype(np.uint64), 5), return_index=True)[1]


def _at(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among sorted ones, and whether it is one of them."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def training_labels(labels: DataFrame, column: str, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """At most `bound` labelled ids outside the held-out third, a label of 0 or 1 each; repeated ids count once."""
    known = labels.where(F.col(column).isin(0, 1) & (crc_mod3(doc_id) != 1)).groupBy(F.col(doc_id).cast("long").alias("_doc")).agg(F.max(F.col(column).cast("int")).alias("_label"))
    return known.orderBy(F.xxhash64("_doc"), "_doc").limit(bound)


def toxic_tokens(toxic: DataFrame, settings: Settings) -> DataFrame:
    """Hashes (`token`) of all words and stems of toxic training documents: only these can score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in parts(batches, "text"):
            word, stem, *_ = token_hashes(buf, offsets, settings)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([word, stem])).view(np.int64))], ["token"])

    return checkpointed(toxic.select("text").mapInArrow(run, "token long").distinct())


def toxic_scores(marked: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of all tokens that are toxic beyond doubt, by counts over all of `marked` (texts with `_label`).

    Tokens of toxic training documents are counted `settings.tokens` at a time: what a task or the driver holds is bounded, and
    none is left out.
    """
    found = toxic_tokens(marked.where("_label = 1"), settings)
    passes = max(1, -(-found.count() // settings.tokens))
    known, worth = [], []
    for k in range(passes):
        some = found.where(F.pmod("token", F.lit(passes)) == k).toPandas()["token"]  # about `settings.tokens`
        tokens = np.sort(some.to_numpy(np.int64).view(np.uint64))
        scores = log_odds(*token_counts_by_label(marked, tokens, settings), settings)
        known.append(tokens[scores > 0])
        worth.append(scores[scores > 0])
    tokens, scores = np.concatenate(known), np.concatenate(worth)
    order = np.argsort(tokens)
    return tokens[order], scores[order]


def token_counts_by_label(docs: DataFrame, tokens: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each token lies (in the whole corpus, in toxic and in other labelled ones), and the same summed over
    all tokens whatever.

    Each different word of a document counts once, as itself and as its stem. Counted over every document, summed within
    tasks, then by token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)  # `tokens` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros((3, len(known) + 1), np.int64)  # the last for all tokens
        for rows, buf, offsets in parts(batches, "text"):
            word, stem, text, _, _ = token_hashes(buf, offsets, settings)
            if not len(word):
                continue
            once = _once(word, text)
            label = np.asarray(rows.column(1).fill_null(-1))[text[once]]
            for k, of in enumerate((np.ones(len(once), bool), label == 1, label == 0)):
                counts[k, -1] += 2 * of.sum()
            for hashes in (word[once], stem[once]):
                at, hit = _at(known, hashes)
                for k, of in enumerate((hit, hit & (label == 1), hit & (label == 0))):
                    if of.any():
                        counts[k, :-1] += np.bincount(at[of], minlength=len(known))
        seen = np.flatnonzero(counts[0])
        for i in range(0, len(seen), 50_000):
            at = seen[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in counts)], ["token", "n", "toxic", "clean"])

    counted = docs.select("text", "_label").mapInArrow(run, "token long, n long, toxic long, clean long")
    summed = counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")]).toPandas()  # `tokens` + 1 rows
    out = np.zeros((3, len(tokens) + 1), np.int64)
    out[:, summed["token"].to_numpy(np.int64)] = summed[["n", "toxic", "clean"]].to_numpy(np.int64).T
    return out[:, :-1], out[:, -1]


def log_odds(counts: np.ndarray, total: np.ndarray, settings: Settings) -> np.ndarray:
    """Log-odds ratio of each token under a Dirichlet prior shaped like the corpus, where it is beyond doubt, and else 0."""
    mass = settings.prior * (total[1] + total[2])
    prior = mass * counts[0] / max(total[0], 1)
    y, x = counts[1] + prior, counts[2] + prior
    n_y, n_x = total[1] + mass, total[2] + mass
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(y / (n_y - y)) - np.log(x / (n_x - x))
        sure = delta / np.sqrt(1 / y + 1 / x) >= settings.least_z
    return np.where(sure, np.minimum(delta, 8.0), 0.0)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time: disjoint, each with a positive sum that no longer or shorter
    extension of it exceeds. Returns (first, past the last, sum)."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum up to its end, first, past the last
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, first = before, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= total:
                found.append((left, total, first, i + 1))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for low, high, a, b in found]


def passages(docs: DataFrame, tokens: np.ndarray, scores: np.ndarray, settings: Settings, carry_text: bool = False) -> DataFrame:
    """Every document (`doc_id, text, _row`; the text comes back only if it is to be carried) with its number of tokens, its best passage score and all passages of at least
    `settings.least`. Tokens of score 0 count as any other word."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens[scores > 0], scores[scores > 0]))
    least = settings.least
    row = docs.schema["_row"]
    found = "doc_id long, tokens long, best double, passages array<struct<start:long,end:long,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worth = shared.value
        for rows, buf, offsets in parts(batches, "text"):
            word, stem, text, starts, ends = token_hashes(buf, offsets, settings)
            value = np.full(len(word), settings.drift)
            for hashes in (word, stem):
                at, hit = _at(known, hashes)
                value[hit] = np.maximum(value[hit], worth[at[hit]])
            again = np.zeros(len(word), bool)
            again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
            value[again] = np.minimum(value[again], settings.drift)  # a word said over and over is said once
            tokens = np.bincount(text, minlength=rows.num_rows)
            best, spans = np.zeros(rows.num_rows), [[] for _ in range(rows.num_rows)]
            # only toxic tokens need single steps: the tokens between two of them are one step of their sum
            toxic = np.flatnonzero(value > 0)
            if len(toxic):
                summed = np.append(0.0, np.cumsum(value))
                cut = np.flatnonzero(np.diff(text[toxic], prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(toxic)), strict=True):
                    at = toxic[a:b]
                    steps = np.zeros(2 * len(at) - 1)
                    steps[::2] = value[at]
                    steps[1::2] = summed[at[1:]] - summed[at[:-1] + 1]
                    of, base = int(text[at[0]]), int(offsets[text[at[0]]])
                    for first, past, score in maximal_segments(steps.tolist()):
                        best[of] = max(best[of], score)
                        if score >= least:
                            spans[of].append({"start": int(starts[at[first // 2]]) - base, "end": int(ends[at[(past - 1) // 2]]) - base, "score": score})
            yield pa.RecordBatch.from_arrays(
                [*([rows.column(0)] if carry_text else []), rows.column(1), rows.column(2), pa.array(tokens, pa.int64()), pa.array(best), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                [*(["text"] if carry_text else []), "doc_id", "_row", "tokens", "best", "passages"],
            )

    fields = StructType.fromDDL(found).fields
    return docs.select("text", "doc_id", "_row").mapInArrow(run, StructType([*([docs.schema["text"]] if carry_text else []), fields[0], row, *fields[1:]]))


@dataclass(frozen=True)
class Calibration:
    """Gumbel law of the best score by chance, P(best > s) = 1 - exp(-k n exp(-lambda s)), and a logistic on its bit score."""

    rate: float
    log_k: float
    slope: float
    offset: float
    empty: float

    def bits(self, tokens, best, lib=F):
        return best * self.rate - self.log_k - lib.log(tokens + 1.0)


def calibrate(sample: pd.DataFrame) -> Calibration:
    """Fit the chance law to clean training documents by moments, then the logistic by Newton steps with a weak ridge."""
    label = sample["_label"].to_numpy(float)
    base = float(np.clip(label.mean() if len(label) else 0.0, 1e-3, 1 - 1e-3))
    hit = sample["best"].to_numpy() > 0
    chance = sample.loc[hit & (label == 0)]
    # one stray word in a clean document: the law of single-token passages
    rate = float(np.pi / (np.sqrt(6) * max(chance["best"].std(ddof=0), 1.0))) if len(chance) > 1 else 1.0
    log_k = float(rate * chance["best"].mean() - 0.5772 - np.log(chance["tokens"] + 1.0).mean()) if len(chance) > 1 else 0.0
    law = Calibration(rate, log_k, 1.0, 0.0, base)
    if not hit.any() or label[hit].min(initial=1) == label[hit].max(initial=0):
        return Calibration(rate, log_k, 1.0, float(np.log(base / (1 - base))), base)
    x, y = law.bits(sample.loc[hit, "tokens"].to_numpy(float), sample.loc[hit, "best"].to_numpy(), np), label[hit]
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    empty = float((label[~hit].sum() + base) / (len(label[~hit]) + 1))
    return Calibration(rate, log_k, float(max(w[0], 0.0)), float(w[1]), empty)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = (), carry_text: bool = False) -> DataFrame:  # noqa: B008
    """Score every whole text for toxicity. No text is shuffled.

    Labels are learned from at most `settings.labelled` ids outside the held-out third (of repeated ids all texts count, and
    the calibration takes the one of the best passage); token counts are taken over all documents. Null and empty texts
    have no passage and get the rate at which documents without one are toxic; null ids are scored and never held out; repeated rows are
    scored each, by their own text; columns in `keep` are handed through, others ignored; without labels the score is a
    constant below one half; an empty table gives an empty result.
    Returns `doc_id, held_out, score, tokens, best, passages`, `_row` (a struct of `keep`) and, if it is carried, `text`.
    """
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row.alias("_row"))
    train = checkpointed(training_labels(labels.select(F.col(doc_id), F.col(label)), label, settings.labelled, doc_id))
    known = F.broadcast(train)  # `labelled` rows at most
    marked = rows.join(known, rows["doc_id"] == known["_doc"], "left")
    tokens, scores = toxic_scores(marked, settings)
    sample = passages(marked.where("_label is not null").select("text", "doc_id", F.col("_label").alias("_row")), tokens, scores, settings)
    sample = sample.groupBy("doc_id").agg(F.max(F.struct("best", "tokens", F.col("_row").alias("_label"))).alias("_most"))
    law = calibrate(sample.select("_most.*").toPandas())  # a row for each labelled id
    logit = law.bits(F.col("tokens").cast("double"), F.col("best")) * law.slope + law.offset
    value = F.when(F.col("best") > 0, 1 / (1 + F.exp(-logit))).otherwise(F.lit(law.empty))
    scored = passages(rows, tokens, scores, settings, carry_text)
    return scored.select(*(["text"] if carry_text else []), "doc_id", F.coalesce(crc_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), value.alias("score"), "tokens", "best", "passages", "_row")
