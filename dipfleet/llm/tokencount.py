"""Token counts of whole texts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import release_memory

_NONE = np.iinfo(np.int32).max


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            at += 1
            n |= (raw[at - 1] & 127) << shift
            shift += 7
            if raw[at - 1] < 128:
                return n

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            at += size
            yield key >> 3, raw[at - size : at]


#: Numbers of the fields read from a piece model: pieces (and their type), trainer (type, blanks at the end), normalizer.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TYPE, USER_DEFINED, MODEL_TYPE, BPE, BLANK_AT_END, CHARACTER_MAP, DUMMY_PREFIX, FEWER_BLANKS = 3, 4, 3, 2, 24, 2, 3, 4


def require_plain_bpe(raw: bytes) -> None:
    """Raise where a model does what `Pieces` does not count: another algorithm, a normalizer, pieces defined by users."""
    trainer, normalizer, wrong = {}, {}, []
    for field, value in _fields(raw):
        if field == TRAINER:
            trainer = dict(_fields(value))
        elif field == NORMALIZER:
            normalizer = dict(_fields(value))
        elif field == PIECE and dict(_fields(value)).get(PIECE_TYPE, 1) == USER_DEFINED and "user-defined pieces" not in wrong:
            wrong.append("user-defined pieces")
    if trainer.get(MODEL_TYPE, 1) != BPE:
        wrong.append("not byte-pair merges")
    if trainer.get(BLANK_AT_END, 0):
        wrong.append("blanks at the end of pieces")
    if normalizer.get(CHARACTER_MAP) or not normalizer.get(DUMMY_PREFIX, 1) or normalizer.get(FEWER_BLANKS, 1):
        wrong.append("a normalizer")
    if wrong:
        raise ValueError(f"cannot count with this piece model: {', '.join(wrong)}")


class Pieces:
    """The merges of a byte-fallback piece model as arrays: a pair of symbols that joins to a piece, and its rank."""

    #: Pre-tokens remembered in each of two generations; the memory of a worker stays bounded.
    REMEMBERED = 150_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        require_plain_bpe(sp.serialized_model_proto())
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in plain]
        ids = {t: k for k, t in enumerate(texts)}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        rank = [order[sp.get_score(i)] for i in plain]
        for c in sorted({c for t in texts for c in t}):
            ids.setdefault(c, len(ids))
        self.unknown = len(ids)  # and one symbol for each byte length of a character outside the model
        self.bytes_of = np.ones(self.unknown + 5, np.int64)
        self.bytes_of[self.unknown :] = np.arange(5)
        self.bytes_of[len(texts) : self.unknown] = [len(c.encode()) for c, k in ids.items() if k >= len(texts)]
        points = np.arange(0x110000)
        self.symbol_of = (self.unknown + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int32)
        for t, k in ids.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = k
        self.symbol_of[ord(" ")] = self.symbol_of[0x2581]
        self.step = np.int64(self.unknown + 5)
        pairs = sorted((ids[t[:i]] * int(self.step) + ids[t[i:]], k) for k, t in enumerate(texts) for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids)
        self.keys = np.array([p for p, _ in pairs], np.int64)
        self.joined = np.array([k for _, k in pairs], np.int32)
        self.rank = np.array([rank[k] for _, k in pairs], np.int32)
        # A piece from which a pair of lower rank can arise must be joined one place at a time.
        self.alone = np.zeros(self.unknown + 5, bool)
        own = np.full(self.unknown + 5, -1, np.int64)
        own[: len(rank)] = rank
        for side in (self.keys // self.step, self.keys % self.step):
            self.alone[side[self.rank <= own[side]]] = True
        # No piece crosses from another character to a blank, or holds one of `cut`: texts split there.
        held = {c for t in texts if len(t) > 1 for c in t}
        cut = "".join(c for c in "\n\t\x0b\x0c" if c not in held)
        letter = re.compile(r"[^\W\d_]")
        after = {b for t in texts for a, b in zip(t, t[1:], strict=False) if letter.match(a)}
        stops = re.escape("".join(c for c in "!#$%&*,.:;?|" if c not in after))  # nor one from a letter to these
        word = (rf"[ ▁]*[^\W\d_]+(?=[{stops}])|" if stops else "") + f"[ ▁]*[^ ▁{cut}]+|[ ▁]+"
        self.splits = re.compile(word + (f"|[{cut}]" if cut else ""))
        if any("▁" in t.lstrip("▁") for t in texts):
            self.splits = re.compile(f"[^{cut}]+|[{cut}]" if cut else "(?s:.+)")
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        dealt = [self.splits.findall(" " + t) if t else [] for t in texts]
        words_ = set().union(*dealt)
        if len(self.known) > self.REMEMBERED:
            self.older, self.known = self.known, {}
        fresh = words_ - self.known.keys()
        again = fresh & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        fresh = list(fresh - again)
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            self.known.update(zip(some, self.merge(some).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in dealt]

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word: in each round every word joins its pair of lowest rank, the leftmost first."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        rank, at = self._ranks(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            if (done := best == _NONE).any():
                over = np.repeat(done, sizes)
                counts += np.bincount(word[over], self.bytes_of[symbols[over]], len(words)).astype(np.int64)
                symbols, word, rank, at = symbols[~over], word[~over], rank[~over], at[~over]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = word[hit]
            new = np.diff(owner, prepend=-1) != 0
            run = np.flatnonzero(new | (np.diff(hit, prepend=-9) != 1))  # of places that overlap, every second one
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2
            take = new | ((odd == 0) & ~np.repeat(self.alone[self.joined[at[hit[new]]]], np.diff(np.append(np.flatnonzero(new), len(hit)))))
            hit = hit[take]
            symbols[hit] = self.joined[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            stale = np.zeros(len(symbols), bool)
            stale[hit] = True
            stale[np.maximum(hit - 1, 0)] = True
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            stale = np.flatnonzero(stale[keep])
            rank[stale], at[stale] = self._ranks(symbols, word, stale)
        return counts

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and table place of the pair that starts at each place; `_NONE` where none does."""
        places = np.arange(len(symbols)) if places is None else places
        rank, at = np.full(len(places), _NONE, np.int32), np.zeros(len(places), np.int64)
        nexts = np.minimum(places + 1, len(symbols) - 1)
        inner = np.flatnonzero((word[places] == word[nexts]) & (nexts > places))
        keys = symbols[places[inner]].astype(np.int64) * self.step + symbols[nexts[inner]]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        real = self.keys[found] == keys
        rank[inner[real]], at[inner[real]] = self.rank[found[real]], found[real]
        return rank, at


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Count the tokens of every whole text, without begin, end or added special tokens.

    Map-only. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are each counted;
    columns other than the two named are ignored; an empty table gives an empty result. Texts are never cut.
    Returns `doc_id, n_bytes, n_tokens, over_limit`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = pieces(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                n = pa.array(model_.count(part.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], ["doc_id", "n_bytes", "n_tokens"])
            release_memory()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
