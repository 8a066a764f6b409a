"""Fill-in-the-middle: exact round trips, and a plain version by lists of lines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dipfleet.llm import middle
from tests.llm.test_operators import frame


def plain(text, doc_id):
    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(13)
    pieces = ["a", "é", "日本", "😀", "\n", "\n", "\n\n", "\r\n", " ", "<", "<S", "<M", " ", "word word", "\x0b"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", "\n", "x<P>y\nz", "line\n" * 50_000, "no end" * 10_000]


def test_equals_a_plain_version_and_goes_back(spark, texts):
    ids = [None if i % 50 == 3 else i for i in range(len(texts))]
    docs = frame(spark, texts, None, ids).withColumn("form", F.lit("x")).withColumn("_made", F.lit(1)).repartition(3)
    out = middle.fill_in_middle(docs, limit=5_000)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in out.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((str(i), *(p := plain(t or "", i)), sha(p[4]), sha(t or "")) for i, t in zip(ids, texts))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in texts)


def test_settings(spark, texts):
    words = middle.Settings(unit=r"\S+\s*|\s+", share=40, suffix_first=0, seed=3, marks=("[[p]]", "[[s]]", "[[m]]"))
    out = middle.fill_in_middle(frame(spark, texts), words).collect()
    forms = [r.form for r in out]
    assert 0.3 < forms.count("psm") / len(forms) < 0.5 and "spm" not in forms
    assert sorted(middle.restore(r.output, r.form, words.marks) for r in out) == sorted(t or "" for t in texts)
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "ba", "c"), ("", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            middle.Settings(marks=marks)


def test_empty_table(spark):
    assert middle.fill_in_middle(frame(spark, [])).count() == 0
