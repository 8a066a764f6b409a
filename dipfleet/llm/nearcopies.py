"""Near copies by wide SimHash fingerprints: the Gray-order index finds candidates, an exact Jaccard check links them."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from dipfleet.llm.common import checkpointed, mix, parts, prefix_hash, span_hash, word_spans
from dipfleet.llm.components import components
from dipfleet.llm.simhash import pattern_links

#: 64-bit words of a fingerprint. Texts of similarity 0.8 differ in some 39 +- 6 of its 256 bits, unlike ones in 128 +- 8.
WORDS = 4
#: The index links texts by rising distance of their fingerprints; every link is checked on the words. Unlike texts never come
#: near the last tier.
TIERS = (30, 36, 42, 48, 60)
#: 64-bit words of the filter by which tasks leave out texts without a link. Its size is fixed: with very many linked texts it lets
#: more of the others through.
FILTER = 1 << 17
#: Rounds in which each class has its nearest link checked; then all links are that are still between classes.
ROUNDS = 2
#: Upper nodes of the index: every fingerprint lies under MASKS patterns of BITS bits each. A pair of similarity 0.8 agrees on
#: one of them with probability 0.95, at 0.85 with 0.99, at 0.9 with more than 0.999. Beyond some billions of different
#: texts, add two bits and 1.4 times the masks for each fourfold growth, so that patterns stay as rare.
MASKS, BITS = 96, 20
#: So many pairs with the same text meet in one task; more are dealt on.
PAIRS = 256


def sampled_masks(masks: int = MASKS, bits: int = BITS, words: int = WORDS) -> np.ndarray:
    """Rows of 64-bit words with `bits` bits set, the same everywhere."""
    rng = np.random.default_rng(20)
    out = np.zeros((masks, words), np.uint64)
    for row in out:
        for bit in rng.choice(64 * words, bits, replace=False):
            row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    return out


def shingles(text: bytes, shingle: int = 5) -> set[bytes]:
    """Runs of `shingle` words; fewer words are one shingle, and no word is none."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similar(a: bytes, b: bytes, shingle: int, least: float) -> bool:
    """Whether the Jaccard similarity of two texts reaches `least`; two texts without words are alike."""
    x, y = shingles(a, shingle), shingles(b, shingle)
    return len(x & y) >= least * len(x | y)


def wide_fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int = 5) -> np.ndarray:
    """A bit of a text is set if it is set in over half the hashes of its different shingles; zeros for a text without words."""
    out = np.zeros((len(offsets) - 1, WORDS), np.uint64)
    low = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    starts, ends, owner = word_spans(low, offsets)
    if not len(starts):
        return out
    word = span_hash(prefix_hash(low), starts, ends)
    n = len(word)
    h, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(min(shingle, n)):
        inside = owner[: n - j] == owner[j:]
        h[: n - j] += np.where(inside, mix(word[j:], j + 2), np.uint64(0))
        if j == shingle - 1:
            whole[: n - j] = inside
    whole |= np.diff(owner, prepend=-1) != 0
    h, owner = mix(h[whole]), owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
    h, owner = h[once], owner[once]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(owner)))
    for k in range(WORDS):
        votes = np.zeros((len(first), 64), np.int64)
        for a in range(0, len(h), 1 << 16):
            part = mix(h[a : a + (1 << 16)], 200 + k)
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.searchsorted(first, [a, a + len(part)], "left")
            cuts = np.unique(np.append(0, first[inside[0] : inside[1]] - a))
            votes[np.searchsorted(first, a + cuts, "right") - 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        out[owner[first], k] = ((2 * votes > sizes[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def _words(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = buf.tobytes()
    return [b" ".join(raw[a:b].lower().split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _slot(key: bytes, doc_id: int | None) -> bytes:
    return key if doc_id is None else key + struct.pack("<q", doc_id)


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """`doc_id, key` (128 bits of the words of the text; `h0, h1` are its halves), `slot` (words and id), `worded` and the fingerprint."""
    names = [f"f{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in parts(batches, "text"):
            words = _words(buf, offsets)
            keys = [_digest(w) for w in words]
            slots = [_slot(k, d) for k, d in zip(keys, part.column(0).to_pylist(), strict=True)]
            f = wide_fingerprints(buf, offsets, shingle).view(np.int64)
            halves = _halves(keys)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(slots, pa.binary()), pa.array([bool(w) for w in words]), *(pa.array(halves[:, k].copy()) for k in (0, 1)), *(pa.array(f[:, k].copy()) for k in range(WORDS))], ["doc_id", "key", "slot", "worded", "h0", "h1", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, slot binary, worded boolean, h0 long, h1 long, " + ", ".join(f"{n} long" for n in names))


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """A row for each different text: a `name` (a number of its own), its `key` and fingerprint, `worded`, and the `slot` of its
    row of least id. Rows of one text are one before they are shuffled."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "slot")).alias("least")
    print_ = F.max(F.struct("worded", "h0", "h1", *[f"f{k}" for k in range(WORDS)])).alias("f")
    once = _marked(docs, shingle).groupBy("key").agg(least, print_)
    # written once: the numbers stay
    return checkpointed(once.select(F.monotonically_increasing_id().alias("name"), "key", "least", "f.*"))


def _nodes(distinct: DataFrame) -> DataFrame:
    """A row for each fingerprint and each pattern that it lies under."""
    masks, names = sampled_masks(), [f"f{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                f = np.stack([np.asarray(c).view(np.uint64) for c in part.columns[1:]], 1)
                node = np.zeros((len(f), len(masks)), np.uint64)
                for m, mask in enumerate(masks):
                    key = np.full(len(f), m, np.uint64)
                    for k in range(WORDS):
                        key = mix(key ^ (f[:, k] & mask[k]), 1)
                    node[:, m] = key
                lists = pa.FixedSizeListArray.from_arrays(pa.array(node.reshape(-1).view(np.int64)), len(masks)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([lists, *part.columns], ["nodes", "name", *names])

    listed = distinct.select("name", *names).mapInArrow(run, "nodes array<long>, name long, " + ", ".join(f"{n} long" for n in names))
    return listed.select(F.explode("nodes").alias("node"), "name", *names)


def _filter(wanted: DataFrame, words: int = FILTER) -> np.ndarray:
    """A Bloom filter of the halves of the wanted keys: `words` numbers, whatever their number."""
    places = wanted.select(F.explode(F.array("h0", "h1")).alias("h")).select(F.pmod("h", F.lit(64 * words)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    out = np.zeros(words, np.int64)
    for r in places.select((F.col("at") / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most `words`
        out[r.word] = r.bits
    return out.view(np.uint64)


def _may_hold(bits: np.ndarray, halves: np.ndarray) -> np.ndarray:
    at = halves % (64 * len(bits))
    return ((bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).all(1)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`name, text` (words) of the wanted texts (`name, key, h0, h1`), each once. Copies of a task are one row before any shuffle, and most
    other texts never leave it."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests of a task's texts
        for _, buf, offsets in parts(batches, "text"):
            words = list({_digest(w): w for w in _words(buf, offsets) if w}.items())
            may = _may_hold(shared.value, _halves([k for k, _ in words])) if words else []
            words = [(k, w) for (k, w), m in zip(words, may, strict=True) if m and k not in seen]
            seen.update(k for k, _ in words)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in words], pa.binary()), pa.array([w for _, w in words], pa.binary())], ["_key", "text"])

    texts = docs.select("text").mapInArrow(run, "_key binary, text binary")
    return texts.join(wanted, F.col("_key") == F.col("key")).select("name", "text").dropDuplicates(["name"])


def _with_text(pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """The text of one side of each pair; a text in very many pairs is copied to as many tasks as they need."""
    counts = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_n"))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(counts, side).withColumn("_s", F.pmod(F.xxhash64(other), F.col("_n")).cast("int")).drop("_n")
    copies = texts.join(counts, texts["name"] == counts[side]).select(F.col("name").alias(side), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"), F.col("text").alias(f"text_{side}"))
    return dealt.join(copies, [side, "_s"]).drop("_s")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs `a, b` whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                near = [similar(x, y, shingle, least) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = _with_text(_with_text(pairs, texts, "b"), texts, "a").select("a", "b", "text_a", "text_b")
    return checkpointed(both.mapInArrow(run, "a long, b long"))


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different classes, with these as `_a` and `_b`."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs.where("_a <> _b")


def _rough_classes(held: DataFrame) -> DataFrame:
    """`node, component` after three steps towards the smallest node reachable. Classes may still be in pieces: what is left between
    them is asked for once more, so that costs a few pairs and no result."""
    both = held.select(F.col("a").alias("node"), F.col("b").alias("n")).unionByName(held.select(F.col("b").alias("node"), F.col("a").alias("n")))
    least = both.groupBy("node").agg(F.min("n").alias("n")).select("node", F.least("node", "n").alias("component"))
    for _ in range(2):
        up = least.select(F.col("node").alias("component"), F.col("component").alias("up"))
        least = least.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return checkpointed(least)


def links(named: DataFrame, docs: DataFrame, *, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Links `a, b` between names whose components are the classes of similar texts: each was checked on the words.

    The index finds pairs of close fingerprints below every shared pattern, a forest of about least distances, so a family of copies of any size gives pairs in proportion to it. Of those, each class has its nearest link to another class
    checked, classes are joined by what holds, and so again; at last every pair that still lies between two classes is
    checked. So no pair is believed, none is given up, and few are read.
    """
    fingerprints = [f"f{k}" for k in range(WORDS)]
    found = pattern_links(_nodes(named.where("worded").select("name", *fingerprints)), WORDS, TIERS, direct=True)
    open_pairs = checkpointed(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").where("a <> b").groupBy("a", "b").agg(F.min("bits").alias("bits")))
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    texts = checkpointed(_texts(docs, checkpointed(named.select("name", "key", "h0", "h1").join(wanted, "name", "left_semi"))))
    held, classes = None, None
    for round_ in range(ROUNDS + 1):
        if classes is not None:
            open_pairs = checkpointed(_between(open_pairs, classes).select("a", "b", "bits", "_a", "_b"))
        else:
            open_pairs = open_pairs.withColumns({"_a": F.col("a"), "_b": F.col("b")})
        asked = open_pairs.select("a", "b")
        if round_ < ROUNDS:
            sides = open_pairs.select(F.col("_a").alias("c"), "bits", "a", "b").unionByName(open_pairs.select(F.col("_b").alias("c"), "bits", "a", "b"))
            asked = checkpointed(sides.groupBy("c").agg(F.min(F.struct("bits", "a", "b")).alias("m")).select("m.a", "m.b").distinct())
            open_pairs = open_pairs.join(asked, ["a", "b"], "left_anti").select("a", "b", "bits")
        true = _verified(asked, texts, shingle, least)
        held = true if held is None else held.unionByName(true)
        if round_ < ROUNDS:
            classes = _rough_classes(held)
    return held


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of each class of similar texts stays: the one of smallest id (none counts as larger than any), once. Returns
    the id, the text and the columns in `keep`.

    Texts of equal words are one class whatever their number, and so are texts without words. Rows are chosen by id and
    words together, so unlike texts under one id, or under none, are judged each by itself; of rows whose texts differ in case
    or white space alone under one id any one stays. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("row"))
    named = _named(rows, shingle)
    classes = components(links(named, rows, shingle=shingle, least=least))
    of = named.join(classes, named["name"] == classes["node"], "left").select("least", F.coalesce("component", "name").alias("component"))
    stays = of.groupBy("component").agg(F.min("least").alias("_least")).select(F.col("_least.slot").alias("_stays"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in parts(batches, "text"):
            slots = [_slot(_digest(w), d) for w, d in zip(_words(buf, offsets), part.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), *part.columns], ["slot", *part.schema.names])

    slotted = rows.mapInArrow(run, StructType([StructField("slot", BinaryType()), *rows.schema.fields]))
    once = slotted.dropDuplicates(["slot"])  # copies of a task are one row before the shuffle, which serves the join too
    return once.join(stays, once["slot"] == stays["_stays"], "left_semi").select(F.col("doc_id").alias(doc_id), F.col("text").alias(text), *[F.col(f"row.{c}").alias(c) for c in keep])
