"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed, flat, joined_by_key, joined_classes, release_memory
from dipfleet.llm.components import components


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit b is set if it is set in over half the XXH64 values (seed 42) of the word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    votes = np.zeros(64, np.int64)
    ends = (ends - 1).tolist()
    for at in range(0, n, 1 << 16):
        some = min(n, at + (1 << 16))
        h = np.array([digest(view[a:b], 42) for a, b in zip(starts[at:some], ends[at + shingle - 1 : some + shingle - 1], strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(((2 * votes > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 3, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, f` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                buf, offsets = flat(part.column(1))
                raw = buf.tobytes()
                f = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])
            release_memory()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, f long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code: neighbours in this order differ in few bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def index_classes(f: np.ndarray, group: np.ndarray, tiers: Sequence[int], fanout: int = 8, chunk: int = 1 << 17, direct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each fingerprint (the first place in it): those of a group that are linked at `tiers[0]` or fewer bits.
    And the links that join these classes further as the distance rises from tier to tier: a forest, about that of least distances.

    `f` holds a row of 64-bit words for each fingerprint and comes sorted by group and Gray rank. Each node of the index
    covers up to `fanout` nodes below it and keeps the bits on which all of them agree (mask) and their values (pattern).
    A pair of nodes is dropped as soon as the bits fixed in both differ in too many places, with everything below it, and also when all below it is one class already: a large family of copies is joined by few of its pairs.
    With `direct` no pair is taken for granted: links of the first tier come out as well, each a pair that lies that close.
    """
    patterns, masks, owners, lows = [f], [np.full(f.shape, ~np.uint64(0))], [group], [np.arange(len(f))]
    while len(owners[-1]) > len(np.unique(owners[-1])):
        own = owners[-1]
        first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        inside = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        cut = np.flatnonzero(inside % fanout == 0)
        ones, zeros = np.bitwise_and.reduceat(patterns[-1] & masks[-1], cut), np.bitwise_and.reduceat(~patterns[-1] & masks[-1], cut)
        lows.append(cut)
        masks.append(ones | zeros)
        patterns.append(ones)
        owners.append(own[cut])
    top, step = np.arange(len(owners[-1])), max(1, chunk // fanout**2)
    label = np.arange(len(f))
    least, largest = [label] * len(lows), [label] * len(lows)  # of the classes below each node

    def refresh() -> None:
        least[0] = largest[0] = label
        for level in range(1, len(lows)):
            least[level], largest[level] = np.minimum.reduceat(least[level - 1], lows[level]), np.maximum.reduceat(largest[level - 1], lows[level])

    refresh()
    sure, left, right = label, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for tier, most in enumerate(tiers):
        work = [(len(lows) - 1, top, top)]
        while work:
            level, a, b = work.pop()
            if level == 0:
                label, x, y = joined_classes(label, a, b)
                if len(x):
                    refresh()
                    left.append(x)
                    right.append(y)
                continue
            if len(a) > step:
                work.append((level, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            one = (least[level][a] == largest[level][a]) & (least[level][b] == largest[level][b]) & (least[level][a] == least[level][b])
            a, b = a[~one], b[~one]
            below, down = np.append(lows[level], len(owners[level - 1])), level - 1
            wide, broad = below[a + 1] - below[a], below[b + 1] - below[b]
            i = np.repeat(below[a] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
            times = np.repeat(broad, wide)
            j = np.repeat(np.repeat(below[b], wide) - (np.cumsum(times) - times), times) + np.arange(times.sum())
            i = np.repeat(i, times)
            keep = i <= j
            i, j = i[keep], j[keep]
            near = np.bitwise_count((patterns[down][i] ^ patterns[down][j]) & masks[down][i] & masks[down][j]).sum(1, dtype=np.int64) <= most
            i, j = i[near], j[near]
            same = i == j  # what lies close in Gray order first
            work += [(down, i[~same], j[~same]), (down, i[same], j[same])]
        if tier == 0 and not direct:
            sure, left, right = label, left[:1], right[:1]
    return sure, np.concatenate(left), np.concatenate(right)


#: Patterns shared by very many fingerprints that are broadcast at most; more are joined by a shuffle.
LARGE = 200_000
#: So many fingerprints below one shared pattern meet in a task; more are dealt in pairs of slices.
SLICE = 1 << 17


def pattern_links(dealt: DataFrame, words: int, tiers: Sequence[int], slice_rows: int = SLICE, every: int = 64, direct: bool = False) -> DataFrame:
    """Links `a, b` below each shared pattern: `sure` ones join the classes at `tiers[0]` bits, others go on (`index_classes`). With
    `direct` none is sure, and `bits` are the differing ones of each link.

    `dealt` has a row `node, name, f0, f1, ..` for each fingerprint and each node (shared pattern) that it lies under; names
    and nodes are longs. Tasks sort them by Gray rank and search the hierarchy. A node of more than `slice_rows`, judged
    by one fingerprint in `every`, is dealt into slices, and every pair of slices meets in a task of its own: no node is one
    task, and none is cut short.
    """
    columns = [f"f{k}" for k in range(words)]
    some = dealt.where(F.pmod(F.xxhash64("name"), F.lit(every)) == 0)
    large = some.groupBy("node").agg(F.ceil(F.count("*") * every / slice_rows).cast("int").alias("_slices")).where("_slices > 1")
    large = checkpointed(large)  # a row for each `slice_rows` fingerprints at most: broadcast while these are few
    dealt = dealt.join(F.broadcast(large) if large.count() <= LARGE else large, "node", "left")
    n = F.coalesce("_slices", F.lit(1))
    dealt = dealt.withColumn("_i", F.pmod(F.xxhash64(*columns), n).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), n - 1)))
    tile = F.when(n == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("_i", "_j"), F.greatest("_i", "_j")))
    tiles = dealt.select(tile.alias("node"), "name", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a node that may go on in the next batch

        def classes(table: pa.Table) -> Iterator[pa.RecordBatch]:
            node = np.asarray(table.column("node"))
            group = np.cumsum(np.append(True, node[1:] != node[:-1]))
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(many):
                return
            f, group = np.stack([np.asarray(table.column(c)).view(np.uint64)[many] for c in columns], 1), group[many]
            order = np.lexsort((*gray_rank(f).T[::-1], group))
            label, a, b = index_classes(f[order], group[order], tiers, direct=direct)
            name = np.asarray(table.column("name"))[many[order]]
            if direct:
                bits = np.bitwise_count(f[order[a]] ^ f[order[b]]).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b]), pa.array(bits)], ["a", "b", "bits"])
                return
            root = name.copy()  # the least name of a class: the same below many patterns, so that links repeat and fall together
            np.minimum.at(root, label, name)
            root = root[label]
            linked = np.flatnonzero(root != name)
            sure = np.append(np.ones(len(linked), bool), np.zeros(len(a), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(name[linked], name[a])), pa.array(np.append(root[linked], name[b])), pa.array(sure)], ["a", "b", "sure"])

        for batch in batches:
            node = np.asarray(batch.column(0))
            new = np.flatnonzero(node[1:] != node[:-1]) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut or (held and len(node) and held[-1].column(0)[-1].as_py() != node[0]):
                yield from classes(pa.Table.from_batches(held + [batch.slice(0, cut)]))
                held = []
            if len(node):
                held.append(batch.slice(cut))
        if held:
            yield from classes(pa.Table.from_batches(held))

    return tiles.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long, " + ("bits int" if direct else "sure boolean"))


def near_links(distinct: DataFrame, most: int = 2, blocks: int = 4, **slicing) -> DataFrame:
    """Links among different fingerprints (`f`) at `most` or fewer differing bits, as a forest for each shared pattern.

    The upper nodes of the index are shared masked patterns: of `blocks` equal blocks of bits, two fingerprints within
    `most` agree on some `blocks - most` of them. Every fingerprint is dealt to each such masked pattern, so none is missed.
    """
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * k) for k in kept) for kept in combinations(range(blocks), blocks - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = F.array(*[F.xxhash64(F.lit(k), F.col("f").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    dealt = distinct.select(F.explode(nodes).alias("node"), F.col("f").alias("name"), F.col("f").alias("f0"))
    return pattern_links(dealt, 1, [most], **slicing).select("a", "b")


def near_texts(docs: DataFrame, *, shingle: int = 3, most: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents whose SimHash fingerprints are linked at `most` or fewer differing bits.

    Equal fingerprints are one node, so copies cost nothing beyond their own row. A null, empty or blank text has the
    fingerprint zero and is linked like any other; fewer words than a shingle are one shingle. A null id never becomes
    a class; repeated rows share a class; other columns are ignored; an empty table gives an empty result.
    Returns `doc_id, fingerprint (16 hex digits), component_id`.
    """
    marked = checkpointed(fingerprints(docs, shingle, doc_id=doc_id, text=text))
    nodes = marked.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = checkpointed(nodes)
    classes = components(near_links(nodes.select("f"), most))
    joined = nodes.join(classes, nodes["f"] == classes["node"], "left").select("f", "least", "rows", F.coalesce("component", "f").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(joined.join(smallest, "component").select("f", "component_id", "rows"))
    return joined_by_key(marked, named, "f", "rows").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
