"""Secrets in texts: patterns find candidates, and how many owners hold the same value tells copied examples from live ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed, joined_by_key, parts

#: Kinds of spans, in the order in which spans that start together are listed. The last two are found by ownership.
KINDS = ("assign", "access", "hex", "owned", "copied")
OWNED, COPIED = 3, 4
#: On bytes with A-Z in lower case, as letters count in either case there.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # of a whole run of such bytes, as matches begin at its first
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")


@dataclass(frozen=True)
class Settings:
    """A value in the hands of `owners` different owners, or in `repositories` different repositories of any, is a copied
    example. Another one is an owner's own if it looks live: `least` characters or more, with a letter, a digit and at least
    `different` different characters."""

    owners: int = 3
    repositories: int = 100
    least: int = 16
    different: int = 8


def looks_live(value: bytes, settings: Settings = Settings()) -> bool:  # noqa: B008
    return len(value) >= settings.least and bool(_LETTER.search(value)) and bool(_DIGIT.search(value)) and len(set(value)) >= settings.different


def scan(text: bytes, settings: Settings = Settings()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes, bool]]]:  # noqa: B008
    """Base spans `(start, kind, end)` in order, and the candidate values `(start, end, value, looks live)`, each place once: the
    values of base spans, and live-looking runs of 20 characters or more that touch none of these. Positions are bytes."""
    low = text.lower()  # of bytes: A-Z alone
    assigned = [m for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    base, values = [(m.start(), 0, m.end()) for m in assigned], {m.span(1) for m in assigned}
    for kind, pattern, least in ((1, _ACCESS, 20), (2, _HEX, 24)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                base.append((m.start(), kind, m.end()))
                values.add(m.span())
    base.sort()
    found = [(a, b, text[a:b], looks_live(text[a:b], settings)) for a, b in sorted(values)]
    taken = sorted((a, b) for a, _, b in base)
    k = most = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            most = max(most, taken[k][1])
            k += 1
        if most <= a and looks_live(m.group(), settings):
            found.append((a, b, m.group(), True))
    return base, found


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """The position in code points of each place in bytes."""
    if text.isascii():
        return {p: p for p in places}
    out, at, before = {}, 0, 0
    for p in sorted(set(places)):
        before += len(text[at:p].decode())
        at = out[p] = p
        out[p] = before
    return out


def candidates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Each row of `doc_id, owner, repository, text` without its text, but with its base spans and its candidate values; values leave
    the task as 128-bit digests alone."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.binary()), ("live", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in parts(batches, "text"):
            raw, spans, values = buf.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b]
                base, found = scan(text, settings)
                at = code_points(text, [p for s in base for p in s[::2]] + [p for s in found for p in s[:2]])
                spans.append([{"start": at[s], "kind": k, "end": at[e]} for s, k, e in base])
                values.append([{"start": at[s], "end": at[e], "name": hashlib.blake2b(v, digest_size=16).digest(), "live": live} for s, e, v, live in found])
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(spans, pa.list_(span)), pa.array(values, pa.list_(value))], ["doc_id", "owner", "repository", "base", "found"])

    return docs.select("doc_id", "owner", "repository", "text").mapInArrow(run, "doc_id long, owner string, repository string, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,name:binary,live:boolean>>")


def ownership(held: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """For each value (`name`) the rows, different owners and different repositories that hold it, and what that makes of it:
    `copied`, `owned` or, for neither, null.

    `held` has `name, live, owner, repository`. Values are combined by repository, then by owner, then by themselves, each time before
    rows are shuffled: a value that everyone holds is a few rows a task. No owner, or no repository, counts as one.
    """
    by_repository = held.groupBy("name", "owner", "repository").agg(F.max("live").alias("live"), F.count("*").alias("places"))
    by_owner = by_repository.groupBy("name", "owner").agg(F.max("live").alias("live"), F.sum("places").alias("places"), F.count("*").alias("repositories"))
    of = by_owner.groupBy("name").agg(F.max("live").alias("live"), F.sum("places").alias("places"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") >= settings.owners) | (F.col("repositories") >= settings.repositories)
    return of.withColumn("kind", F.when(copied, COPIED).when(F.col("live"), OWNED))


def _listed(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:  # noqa: B008
    """Secrets of every whole text, with what the ownership of their values in the whole corpus makes of them.

    Returns `doc_id`, the numbers `n_assign, n_access, n_hex, n_owned, n_copied`, `base` (spans of the patterns, as text), `spans`
    (all of them: values that an owner holds for itself, and values that are copied widely, are spans of the kinds `owned` and
    `copied` besides). Positions are code points, ends exclusive; spans go by start, then kind.

    No text is shuffled, and values only as digests. A null text is empty; a row without an id, an owner or a repository is scanned
    like any other; repeated rows each give their row, and are one repository; other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(text).cast("string").alias("text"))
    scanned = checkpointed(candidates(rows, settings).withColumn("row", F.monotonically_increasing_id()))  # written once: the numbers stay
    held = scanned.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    verdicts = checkpointed(ownership(held, settings).where("kind is not null").select("name", "kind", F.col("places").alias("rows")))
    judged = joined_by_key(held.select("row", "name", "start", "end"), verdicts, "name", "rows")
    added = judged.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))  # as many as one text holds
    both = scanned.join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    both = both.select("doc_id", "base", spans.alias("spans"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return both.select("doc_id", *counts, _listed(F.col("base")).alias("base"), _listed(F.col("spans")).alias("spans"))
