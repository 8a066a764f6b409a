"""Fill-in-the-middle: documents cut at unit ends into prefix, middle and suffix, put in an order that a seed decides."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines with their ends; the last one may have none.
LINES = r"[^\n]*\n|[^\n]+"
OUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Settings:
    """`unit`: pattern of the units that cuts respect, in the syntax of the regex library. `share`: per cent of the documents
    that are transformed. `suffix_first`: per cent of those whose suffix comes first. `marks`: of prefix, suffix and middle."""

    unit: str = LINES
    share: int = 100
    suffix_first: int = 50
    seed: int = 7
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        ends = {m[i:] for m in self.marks for i in range(1, len(m))}
        if len(set(self.marks)) < 3 or "" in self.marks or any(m.startswith(e) for m in self.marks for e in ends) or any(a != b and a in b for a in self.marks for b in self.marks):
            raise ValueError("marks must differ, and none may begin with the end of another or lie in it")


@lru_cache(maxsize=16)
def _units(pattern: str):
    import regex

    return regex.compile(pattern)


def unit_ends(text: str, pattern: str = LINES) -> array:
    """Where each unit of a text ends, in code points: eight bytes a unit."""
    return array("Q", (m.end() for m in _units(pattern).finditer(text)))


def chances(doc_id: int | str | None, seed: int) -> tuple[int, ...]:
    """The first four 32-bit words of the SHA-256 of `seed:doc_id`; no id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def transformed(text: str, doc_id: int | str | None, settings: Settings) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle, and the text in its new order."""
    ends = unit_ends(text, settings.unit)
    n = len(ends)
    h1, h2, h3, h4 = chances(doc_id, settings.seed)
    if not text or any(m in text for m in settings.marks) or h3 % 100 >= settings.share:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    p, s, m = settings.marks
    if h4 % 100 < settings.suffix_first:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def restore(output: str, form: str, marks: tuple[str, str, str] = Settings.marks) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def restored(output: Column, form: Column, marks: tuple[str, str, str] = Settings.marks) -> Column:
    """`restore` as an expression of Spark."""
    piece = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), 4)
    order = F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).otherwise(F.concat(piece[2], piece[3], piece[1]))
    return F.when(form == "plain", output).otherwise(order)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", limit: int = 1 << 22) -> DataFrame:  # noqa: B008
    """Every document in its new order: `doc_id, n` (units), `form` (plain, psm or spm), `prefix_chars, middle_chars` (null if
    plain), `output`, its SHA-256 and that of the text rebuilt from it.

    Map-only; results leave in runs of about `limit` characters. A null text is an empty one and stays plain, like a text that
    holds a mark; rows without an id share one seed; repeated rows give the same row again; other columns are ignored; an
    empty table gives an empty result.
    """

    @F.pandas_udf(OUT)
    def transform(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple]) -> pd.DataFrame:
            n, form, prefix, middle, output, now, was = zip(*rows, strict=True) if rows else [()] * 7
            return pd.DataFrame({"n": pd.array(n, "Int64"), "form": pd.Series(form, dtype=object), "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": pd.Series(output, dtype=object), "output_sha256": pd.Series(now, dtype=object), "restored_sha256": pd.Series(was, dtype=object)})

        for ids, texts in columns:
            rows, held = [], 0
            for i, t in zip(ids, texts, strict=True):
                one = transformed(t, i, settings)
                rows.append((*one, _sha256(one[4]), _sha256(restore(one[4], one[1], settings.marks))))
                held += len(one[4])
                if held > limit:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # ids as text: a column of numbers with nulls would come as floats
    return rows.select("doc_id", transform(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("_made")).select("doc_id", "_made.*")
