"""Secret spans against patterns on code points and plain sets of owners."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from dipfleet.llm import common, secrets
from tests.llm.test_operators import frame

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
KINDS = ["assign", "access", "hex", "owned", "copied"]


def base_spans(text):
    spans, values = [], set()
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
            values.add(m.span(2))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                spans.append((m.start(), kind, m.end()))
                values.add(m.span())
    return sorted(spans), values


def live(v):
    return len(v) >= 16 and re.search("[A-Za-z]", v) and re.search("[0-9]", v) and len(set(v)) >= 8


def plain(rows):
    """Spans of each row (id, text, source) as lists of (start, kind, end): base and all."""
    found, owners, repositories = [], defaultdict(set), defaultdict(set)
    for i, text, source in rows:
        text = text or ""
        base, values = base_spans(text)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            if live(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
                values.add(m.span())
        found.append((text, base, values))
        for a, b in values:
            owners[text[a:b]].add(source)
            repositories[text[a:b]].add((source, i))
    out = []
    for text, base, values in found:
        spans = list(base)
        for a, b in values:
            v = text[a:b]
            if len(owners[v]) >= 3 or len(repositories[v]) >= 100:
                spans.append((a, 4, b))
            elif live(v):
                spans.append((a, 3, b))
        out.append((base, sorted(spans)))
    return out


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus(rnd, n):
    """Texts around keywords in every form, with values that are held by one, some or all sources."""
    key = lambda r, size, letters: "".join(r.choice(letters) for _ in range(size))
    shared = [key(rnd, 30, "abcdef0123456789") for _ in range(4)] + [key(rnd, 22, "ABCDEFGHXYZ0123456789abcxyz") for _ in range(4)] + ["changeme", "AKIA" + key(rnd, 16, "ABCDEF0123")]
    rows = []
    for i in range(n):
        bits = []
        for _ in range(rnd.randint(0, 6)):
            word = rnd.choice(["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "ſecret", "toKen", "note"])
            value = rnd.choice([*shared, *shared, key(rnd, rnd.randint(3, 26), "abcdef0123456789"), key(rnd, rnd.randint(3, 40), "abcXYZ019+/_.=-"), "token", "AKIAABC", ""])
            bits.append(word + rnd.choice(["", '"', "'"]) + " " * rnd.randint(0, 2) + rnd.choice([":", "=", "=", ""]) + rnd.choice(["", " ", ' "', "'"]) + value)
            bits.append(rnd.choice(["é", " 日本 ", "\n", " plain words ", "=", "😀", value]))
        rows.append((i, "".join(bits), f"s{rnd.randint(0, 5)}" if i % 7 else None))
    return rows


def test_spans_equal_a_plain_version(spark):
    rows = corpus(random.Random(111), 500)
    rows += [(None, rows[3][1], "s1"), (3, *rows[3][1:]), (900, None, "s1"), (901, "", None), (902, "x" * 200_000 + " token = " + "a1b2c3d4" * 4, "s2")]
    docs = frame(spark, [t for _, t, _ in rows], [s for _, _, s in rows], [i for i, _, _ in rows]).withColumn("row", F.lit(1)).withColumn("name", F.lit("x")).repartition(5)
    got = sorted((str(r.doc_id), r.base, r.spans, r.n_assign, r.n_access, r.n_hex, r.n_owned, r.n_copied) for r in secrets.find_secrets(docs).collect())
    want = [(str(i), listed(base), listed(spans), *(sum(k == kind for _, k, _ in spans) for kind in range(5))) for (i, _, _), (base, spans) in zip(rows, plain(rows))]
    assert got == sorted(want)
    assert all(sum(w[k] for w in want) > 20 for k in range(3, 8))


def test_matches_that_fail_still_take_their_bytes():
    assert secrets.scan(b"token=token = abcdefgh")[0] == []
    assert secrets.scan(b"token==abcde")[0] == [(0, 0, 12)]
    assert secrets.scan("ſecret=abcdefgh".encode())[0] == []
    assert secrets.scan(b"AKIA" + b"A" * 15)[0] == [] and len(secrets.scan(b"AKIA" + b"A" * 16)[0]) == 1
    assert secrets.scan(b"a" * 23)[0] == [] and secrets.scan(b"A" + b"a" * 24)[0] == [(1, 2, 25)]


def test_a_value_in_many_repositories_of_one_owner_is_copied(spark):
    rows = [(i, "password = changeme", "s") for i in range(100)] + [(200, "password = hunter22", "s")]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(frame(spark, [t for _, t, _ in rows], ["s"] * 101, [i for i, _, _ in rows])).collect()}
    assert got[0] == "assign:0:19,copied:11:19" and got[200] == "assign:0:19"


def test_empty_table_and_values_that_are_digests(spark):
    assert secrets.find_secrets(frame(spark, [])).count() == 0
    docs = frame(spark, ["token = 0123456789abcdef01234567"]).select("doc_id", F.col("source").alias("owner"), F.col("doc_id").cast("string").alias("repository"), "text")
    name = secrets.candidates(docs).first().found[0]["name"]
    assert bytes(name) == hashlib.blake2b(b"0123456789abcdef01234567", digest_size=16).digest()


def test_joined_by_key_keeps_every_row(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 = 0").withColumn("v", F.col("k") * 2)
    got = common.joined_by_key(rows, keys, "k", "n")
    assert got.count() == rows.where("k % 3 = 0").count() and got.where("v <> 2 * k").count() == 0 and set(got.columns) == {"k", "row", "v"}
