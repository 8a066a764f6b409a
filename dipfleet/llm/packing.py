"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own whose length is a power of two."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import release_memory

#: How a byte-level model splits a text into pre-tokens: a fixed pattern of the public vocabulary, and the same pattern
#: for texts of ASCII and Latin letters alone, which the standard library matches faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _S = "A-Za-zÀ-ÖØ-öø-ſ", "\\t-\\r "
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+"
BEYOND_LATIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")


class Ids(dict):
    """Pre-token -> its ids as little-endian bytes. Bounded: of two generations the older one is dropped when the newer is full.

    A pre-token not yet known goes to the faster of two public byte-pair encoders over the same vocabulary, if the
    merges are in the order of their ids (then lowest id and lowest rank agree), and else to the tokenizer itself.
    """

    REMEMBERED = 120_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.latin, self.any = re.compile(LATIN).findall, regex.compile(PATTERN).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        split = parts.get("pre_tokenizer") or {}
        self.whole = bool(parts.get("normalizer")) or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        self.quick = self._quick(parts["model"])

    def _quick(self, model: dict):
        import tiktoken

        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", ())]
        if self.whole or model["type"] != "BPE" or made != sorted(made):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as they are
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        return tiktoken.Encoding("vocabulary", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(token) or self._fresh(token)
        self[token] = ids
        return ids

    def _fresh(self, token: str) -> bytes:
        return struct.pack(f"<{len(a)}I", *a) if self.quick and (a := self.quick(token)) else self.ask(token)

    def of(self, text: str) -> bytes:
        if self.whole or any(a in text for a in self.added):
            return self.ask(text)
        return b"".join(map(self.__getitem__, self.any(text) if BEYOND_LATIN.search(text) else self.latin(text)))


def powers(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: as many of the longest as fit, then the binary digits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if (n % longest) >> b & 1]


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Tokenize every whole text, append `end_id` and cut the ids into pieces whose lengths are powers of two.

    Every piece is a sequence by itself, so no sequence crosses documents and none is padded; `bucket` (log2 of the
    length) says which sequences batch together, and sequence numbers run within a bucket: all those of one length lie
    between bucket << 56 and the next, counted up from a base for each input partition. Map-only.
    A null or empty text gives the single id `end_id`; repeated rows are packed each; a null id stays null; an empty
    table gives an empty result; other columns are ignored. `longest` is a power of two.
    Returns `doc_id, start, length, bucket, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset`.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the task alone: workers live on, and would hold the vocabulary while they run other stages
        ids, base = Ids(tokenizer), TaskContext.get().partitionId() << 32
        fresh = [(bucket << 56) + base for bucket in range(longest.bit_length())]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, starts, lengths, pieces, totals, numbers = [], [], [], [], [], []
                for k, text_ in enumerate(part.column(1).to_pylist()):
                    of = ids.of(text_ or "") + end
                    at = 0
                    for n in powers(len(of) // 4, longest):
                        rows.append(k)
                        starts.append(at)
                        lengths.append(n)
                        pieces.append(of[4 * at : 4 * (at + n)])
                        totals.append(len(of) // 4)
                        numbers.append(fresh[n.bit_length() - 1])
                        fresh[n.bit_length() - 1] += 1
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([n.bit_length() - 1 for n in lengths], pa.int32()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64()), pa.array(numbers, pa.int64())],
                    ["doc_id", "start", "length", "bucket", "ids", "doc_tokens", "sequence_id"],
                )
            release_memory()
        del ids
        release_memory()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = source.mapInArrow(run, "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long, sequence_id long")
    return pieces.withColumn("offset", F.lit(0).cast("long"))
