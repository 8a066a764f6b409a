"""Repeated passages by sorting suffixes: shallow multikey sorting, then blind tries for long common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from dipfleet.llm.common import flat, mix, prefix_hash, release_memory, slices, span_hash

_NO_ID = np.iinfo(np.int64).max  # of a document without id: larger than every id
_ONE = np.uint64(1)

MESSAGE = "bucket long, block long, kind int, keys binary, counts binary, ids binary, body binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("body", pa.binary())])


# --- sorting ---------------------------------------------------------------------------------------------------------


def _refine(order: np.ndarray, new: np.ndarray, open_: np.ndarray, key_of) -> None:
    """Sort the members of every open class of several by a further key, in place; `new` marks where classes begin."""
    at = np.flatnonzero(open_)
    if not len(at):
        return
    classes = np.cumsum(new)[at]
    key = key_of(at, classes)
    by = np.lexsort((key, classes))
    order[at] = order[at][by]
    key, classes = key[by], classes[by]
    new[at[1:]] |= (key[1:] != key[:-1]) & (classes[1:] == classes[:-1])


def _several(new: np.ndarray) -> np.ndarray:
    """Members of classes of at least two."""
    follows = ~new
    return follows | np.append(follows[1:], False)


def sort_windows(blob: np.ndarray, starts: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings of `length` bytes at `starts`, and mark where a string differs from the one before.

    Down to `shallow` bytes, eight bytes at a time split every class into smaller ones (multikey quicksort with eight
    bytes for a character). Classes left have long common prefixes; their blind tries are built level by level, all
    classes at once: a node skips to the first byte at which its strings part and branches on that byte alone.
    """
    m = len(starts)
    new = np.zeros(m, bool)
    if not m:
        return np.zeros(0, np.int64), new
    new[0] = True
    order = np.arange(m)
    eight = np.lib.stride_tricks.sliding_window_view(np.append(blob, np.zeros(8, np.uint8)), 8)
    for depth in range(0, min(shallow, length - 7), 8):
        _refine(order, new, _several(new) if depth else np.ones(m, bool), lambda at, _, d=depth: eight[starts[order[at]] + d].copy().view(">u8").ravel().astype(np.uint64))
    rest = np.lib.stride_tricks.sliding_window_view(blob, length)
    done = np.zeros(m, bool)
    while (open_ := _several(new) & ~done).any():
        at = np.flatnonzero(open_)
        tails = rest[starts[order[at]]]
        head = np.flatnonzero(new[at])
        sizes = np.diff(np.append(head, len(at)))
        apart = tails != np.repeat(tails[head], sizes, axis=0)
        skip = np.minimum.reduceat(np.where(apart.any(1), apart.argmax(1), length), head)
        done[at[np.repeat(skip == length, sizes)]] = True
        branch = np.zeros(m, np.int64)
        branch[at] = np.repeat(np.minimum(skip, length - 1), sizes)
        _refine(order, new, open_ & ~done, lambda at, _, b=branch: blob[starts[order[at]] + b[at]])
    return order, new


# --- anchors ---------------------------------------------------------------------------------------------------------


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of `length` bytes with the same anchor: first window, windows, hash, text.

    The anchor of a window is its gram of least hash (the first, of several): it depends on the bytes of the window
    alone, so equal windows anywhere have equal anchors. Windows never cross texts.
    """
    found = []
    for i, j in slices(offsets, 1 << 19):
        base = offsets[i]
        part, ends = buf[base : offsets[j]], offsets[i : j + 1] - base
        if len(part) < length:
            continue
        places = np.arange(len(part) - gram + 1)
        h = span_hash(prefix_hash(part), places, places + gram)
        bits = np.uint64(32)  # for places; the same in every slice, so that equal windows break ties alike
        best = ((h >> bits) << bits) | places.astype(np.uint64)
        span, have = length - gram + 1, 1
        while 2 * have <= span:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < span:
            best = np.minimum(best[: len(best) - (span - have)], best[span - have :])
        anchor = (best & ((_ONE << bits) - _ONE)).astype(np.int64)
        text = np.repeat(np.arange(i, j), np.diff(ends))
        inside = np.flatnonzero(text[: len(anchor)] == text[length - 1 :][: len(anchor)])
        if not len(inside):
            continue
        anchor, text = anchor[inside], text[inside]
        first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        found.append((inside[first] + base, np.diff(np.append(first, len(inside))), h[anchor[first]], text[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_order(docs: pa.Table) -> pa.Table:
    """The rows of a block by id and text: a shuffle may hand them over in another order each time it is read."""
    return docs.sort_by([("_id", "ascending"), ("_text", "ascending")]) if docs.num_rows else docs


def _ids(docs: pa.Table) -> np.ndarray:
    return np.asarray(docs.column("_id").fill_null(_NO_ID))


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA) if rows else _SCHEMA.empty_table()


def _array(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(np.asarray(table.column("kind")) == kind)) if table.num_rows else table


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in as few bytes as their range needs: a base, a width and the differences."""
    base, top = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    width = next((w for w in (2, 4) if top - base < 1 << 8 * w), 8)
    base = base if width < 8 else 0
    return struct.pack("<qB", base, width) + (ids - base).astype(f"<{'u' if width < 8 else 'i'}{width}").tobytes()


def _ids_of(table: pa.Table, column: str = "ids") -> list[np.ndarray]:
    out = []
    for cell in table.column(column):
        raw = cell.as_py()
        base, width = struct.unpack_from("<qB", raw)
        out.append(np.frombuffer(raw, f"<{'u' if width < 8 else 'i'}{width}", offset=9).astype(np.int64) + base)
    return out


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    if len(first):
        yield from zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist(), strict=True)


def _gathered(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    return buf[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def _runs(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, then the same of the next, and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def named_strings(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, name: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order strings by (group, name) and mark where a string differs from the one before, in groups of their own.

    Names are hashes and only bring equal strings together: every string is held against the bytes of the first of its
    name, and what differs from it is named anew until each name has one string.
    """
    name = name.copy()
    while True:
        order = np.lexsort((name, group))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (group[order][1:] != group[order][:-1]))[: len(order)]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        at = np.flatnonzero(~new)
        differs = np.zeros(len(order), bool)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            a, b = order[some], lead[some]
            same = lengths[a] == lengths[b]
            size = np.where(same, lengths[a], 0)
            unlike = _gathered(buf, starts[a], size) != _gathered(buf, starts[b], size)
            of = np.repeat(np.arange(len(some)), size)
            differs[some] = ~same | (np.bincount(of[unlike], minlength=len(some)) > 0)
        if not differs.any():
            return order, new
        name[order[differs]] = mix(name[order[differs]], 7)


def names_of(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of each span; spans come in the order of the texts that they lie in."""
    name = np.zeros(len(starts), np.uint64)
    for i, j in slices(offsets, 1 << 19):  # powers and sums over a slice of whole texts at a time
        of = slice(*np.searchsorted(text, [i, j]))
        name[of] = span_hash(prefix_hash(buf[offsets[i] : offsets[j]]), starts[of] - offsets[i], ends[of] - offsets[i], seed=3)
    return name


class Exchange:
    """The steps of a search. Blocks of documents and buckets of anchors exchange packed arrays; each step is a
    function of one group whose size is set by parameters, not by the size of the corpus.

    Anchors pass a station between a group of blocks and a range of buckets, so a block sends about as many messages as the square
    root of the number of buckets. Kinds of messages. 0 to a bucket: strings; 0 to a block: anchors that it shares. 1 to a block: windows of its strings
    that a smaller id holds. A bucket number of `first` or more is a first level for windows that very many blocks hold:
    it combines `fan` blocks and stands for them at the bucket proper.
    """

    #: An anchor is told once for so many of its runs in a block.
    STEP = 16

    def __init__(self, length: int, gram: int, blocks: int, buckets: int, fine: int, hot: int, fan: int = 64):
        self.length, self.gram, self.buckets, self.fine, self.hot = length, gram, buckets, fine, hot
        self.groups, self.first = -(-blocks // fan), max(blocks, fine)
        # anchors pass a station for each group of blocks and range of buckets: about the square root of either
        self.range = max(1, isqrt(buckets))  # buckets in a range
        self.of_blocks = max(1, isqrt(blocks))  # groups of blocks

    # --- which anchors are shared

    def anchors(self, docs: pa.Table) -> pa.Table:
        """Block to stations: the different anchors of the block; the lowest bit says that two ids of the block share one.
        Four bytes tell the anchors of a bucket apart: a confusion only costs work."""
        buf, offsets = flat(docs.column("_text"))
        _, _, h, text = anchored_runs(buf, offsets, self.length, self.gram)
        if not len(h):
            return _SCHEMA.empty_table()
        ids, bucket, key = _ids(docs)[text], self._bucket(h, self.buckets), h.astype(np.uint32) | np.uint32(1)
        order = np.lexsort((ids, key, bucket))
        key, bucket, ids = key[order], bucket[order], ids[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
        last = np.append(first[1:], len(key)) - 1
        key = key[first] ^ (ids[first] == ids[last]).astype(np.uint32)
        times = -(-(last + 1 - first) // self.STEP)  # so that very many strings in few blocks are noticed too
        key, bucket = np.repeat(key, times), np.repeat(bucket[first], times)
        block = docs.column("_block")[0].as_py()
        return self._listed(bucket, key, lambda k: (k * self.of_blocks + block % self.of_blocks, block))

    def _listed(self, bucket: np.ndarray, key: np.ndarray, ends) -> pa.Table:
        """A message for each range of buckets: the keys, and the bucket of each as its place in the range. Buckets come in order."""
        near = (bucket % self.range).astype(np.uint16)
        return _messages([(*ends(k), 0, key[a:b].tobytes(), near[a:b].tobytes(), None, None) for k, a, b in _cuts(bucket // self.range)])

    def _arrived(self, messages: pa.Table) -> tuple[np.ndarray, ...]:
        """What a station received: key, place in the range, message."""
        keys, near = _array(messages, "keys", np.uint32), _array(messages, "counts", np.uint16)
        return np.concatenate(keys), np.concatenate(near).astype(np.int64), np.repeat(np.arange(len(keys)), [len(k) for k in keys])

    def routed(self, messages: pa.Table) -> pa.Table:
        """Station to buckets: each different anchor once, how often it was told, and by the lowest bit whether its blocks share it."""
        key, near, source = self._arrived(messages)
        block = np.asarray(messages.column("block"))[source]
        order = np.lexsort((block, key | np.uint32(1), near))
        key, near, block = key[order], near[order], block[order]
        first = np.flatnonzero(np.append(True, ((key[1:] | 1) != (key[:-1] | 1)) | (near[1:] != near[:-1])))
        last = np.append(first[1:], len(key)) - 1
        shared = (np.bitwise_or.reduceat(key & np.uint32(1), first) > 0) | (block[first] != block[last])
        key = (key[first] | np.uint32(1)) ^ (~shared).astype(np.uint32)
        times, me = (last + 1 - first).astype(np.uint32), messages.column("bucket")[0].as_py()
        base = me // self.of_blocks * self.range
        return _messages([(base + k, me, 0, key[a:b].tobytes(), times[a:b].tobytes(), None, None) for k, a, b in _cuts(near[first])])

    def shared(self, messages: pa.Table) -> pa.Table:
        """Bucket to stations: those of their anchors that blocks share; the lowest bit says that very many strings lie under it."""
        arrays, one = _array(messages, "keys", np.uint32), np.uint32(1)
        keys, times = np.concatenate(arrays), np.concatenate(_array(messages, "counts", np.uint32)).astype(np.int64)
        source = np.repeat(np.asarray(messages.column("block")), [len(a) for a in arrays])
        order = np.argsort(keys | one, kind="stable")
        keys, times, source = keys[order], times[order], source[order]
        first = np.flatnonzero(np.append(True, (keys[1:] | one) != (keys[:-1] | one)))
        sizes = np.diff(np.append(first, len(keys)))  # a station tells an anchor once
        keep = np.repeat((sizes > 1) | (np.bitwise_or.reduceat(keys & one, first) > 0), sizes)
        keys = (keys | one) ^ np.repeat((np.add.reduceat(times, first) <= self.hot).astype(np.uint32), sizes)
        keys, source = keys[keep], source[keep]
        order = np.argsort(source, kind="stable")
        keys, bucket = keys[order], messages.column("bucket")[0].as_py()
        return _messages([(bucket, k, 0, keys[a:b].tobytes(), None, None, None) for k, a, b in _cuts(source[order])])

    def delivered(self, messages: pa.Table, told: pa.Table) -> pa.Table:
        """Station to blocks: those of their anchors that the buckets call shared."""
        if not messages.num_rows or not told.num_rows:
            return _SCHEMA.empty_table()
        arrays, me = _array(told, "keys", np.uint32), messages.column("bucket")[0].as_py()
        base = me // self.of_blocks * self.range
        shared = np.sort((np.repeat(np.asarray(told.column("bucket")) - base, [len(a) for a in arrays]).astype(np.uint64) << np.uint64(32)) | np.concatenate(arrays))
        key, near, source = self._arrived(messages)
        own = (near.astype(np.uint64) << np.uint64(32)) | (key | np.uint32(1))
        at = np.minimum(np.searchsorted(shared | _ONE, own), len(shared) - 1)
        hit = np.flatnonzero((shared[at] | _ONE) == own)
        told_, near, source = shared[at[hit]], near[hit], source[hit]
        once = np.append(True, (told_[1:] != told_[:-1]) | (source[1:] != source[:-1]))[: len(hit)]  # keys of a message come in order
        told_, near, source = told_[once].astype(np.uint32), near[once].astype(np.uint16), source[once]
        blocks = np.asarray(messages.column("block"))
        return _messages([(base, int(blocks[k]), 0, told_[a:b].tobytes(), near[a:b].tobytes(), None, None) for k, a, b in _cuts(source)])

    @staticmethod
    def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    # --- strings of windows under shared anchors

    def candidates(self, docs: pa.Table, told: pa.Table, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Strings of windows under shared anchors, in the order of their messages: first byte, windows, id, bucket, and where
        a string differs from the one before. Windows of an anchor with very many strings stand alone and go where
        their own bytes send them, to the first level of this block's group."""
        shared = _of_kind(told, 0)
        if not docs.num_rows or not shared.num_rows:
            return None
        key, near, source = self._arrived(shared)
        keys = np.sort(key.astype(np.uint64) | (np.asarray(shared.column("bucket"))[source] + near).astype(np.uint64) << np.uint64(32))
        first, windows, h, text = anchored_runs(buf, offsets, self.length, self.gram)
        if not len(h):
            return None
        own = (self._bucket(h, self.buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)) | _ONE
        at = np.minimum(np.searchsorted(keys | _ONE, own), len(keys) - 1)
        hit = (keys[at] | _ONE) == own
        first, windows, h, text, hot = first[hit], windows[hit], h[hit], text[hit], (keys[at[hit]] & _ONE) > 0
        spread = np.where(hot, windows, 1)
        inner = _runs(spread, np.zeros(len(spread), np.int64))
        first, windows, h, text, hot = (np.repeat(x, spread) for x in (first, windows, h, text, hot))
        first, windows = first + np.where(hot, inner, 0), np.where(hot, 1, windows)
        name = names_of(buf, offsets, first, first + windows + self.length - 1, text)
        group = docs.column("_block")[0].as_py() % self.groups
        bucket = np.where(hot, self.first + self._bucket(name, self.fine) * self.groups + group, self._bucket(h, self.fine))
        order, new = named_strings(buf, first, windows + self.length - 1, name, bucket)
        return first[order], windows[order], _ids(docs)[text][order], bucket[order], new

    def strings(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Block to buckets: each different string once, with the smallest id of the block that holds it."""
        docs = _in_order(docs)
        buf, offsets = flat(docs.column("_text")) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        if (found := self.candidates(docs, told, buf, offsets)) is None:
            return _SCHEMA.empty_table()
        first, windows, ids, bucket, new = found
        lead = np.flatnonzero(new)
        return self._sent(buf, first[lead], windows[lead], np.minimum.reduceat(ids, lead), bucket[lead], docs.column("_block")[0].as_py())

    def _sent(self, buf: np.ndarray, first: np.ndarray, windows: np.ndarray, ids: np.ndarray, bucket: np.ndarray, sender: int) -> pa.Table:
        out = []
        for k, a, b in _cuts(bucket):
            body = _gathered(buf, first[a:b], windows[a:b] + self.length - 1).tobytes()
            out.append((k, sender, 0, struct.pack("<q", len(body)), windows[a:b].astype(np.uint16).tobytes(), _narrow(ids[a:b]), pa.compress(body, "zstd", asbytes=True)))
        return _messages(out)

    def _received(self, messages: pa.Table) -> tuple[np.ndarray, ...]:
        """Bytes of the strings, where each begins, windows, smallest id, which message and which place in it."""
        counts, ids, sizes = _array(messages, "counts", np.uint16), _ids_of(messages), [s[0] for s in _array(messages, "keys", np.int64)]
        blob = np.frombuffer(b"".join(pa.decompress(x.as_py(), int(n), "zstd", asbytes=True) for x, n in zip(messages.column("body"), sizes, strict=True)), np.uint8)
        many = np.array([len(c) for c in counts])
        windows = np.concatenate(counts).astype(np.int64)
        long = windows + self.length - 1
        return blob, np.cumsum(long) - long, windows, np.concatenate(ids), np.repeat(np.arange(len(many)), many), _runs(many, np.zeros(len(many), np.int64))

    def _lowest(self, messages: pa.Table) -> tuple[np.ndarray, ...]:
        """What was received, with the different string of each, and of those the first, and for all their windows the smallest id."""
        blob, at, windows, own, source, place = self._received(messages)
        ends = at + windows + self.length - 1
        name = np.zeros(len(at), np.uint64)
        for i, j in slices(np.append(at, len(blob)), 1 << 19):
            name[i:j] = span_hash(prefix_hash(blob[at[i] : ends[j - 1]]), at[i:j] - at[i], ends[i:j] - at[i], seed=3)
        order, new = named_strings(blob, at, ends - at, name, np.zeros(len(at), np.int64))
        lead = np.flatnonzero(new)
        of = np.zeros(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        rep, least = order[lead], np.minimum.reduceat(own[order], lead)
        # the windows of every different string are the suffixes to sort
        string = np.repeat(np.arange(len(rep)), windows[rep])
        sorted_, starts_class = sort_windows(blob, _runs(windows[rep], at[rep]), self.length)
        smallest = np.minimum.reduceat(least[string[sorted_]], np.flatnonzero(starts_class))
        lowest = np.zeros(len(string), np.int64)
        lowest[sorted_] = smallest[np.cumsum(starts_class) - 1]
        return blob, at, windows, own, source, place, of, rep, string, lowest

    def answers(self, messages: pa.Table, combined: pa.Table) -> pa.Table:
        """Bucket to senders: the windows of their strings that a document with a smaller id than theirs also holds."""
        messages = pa.concat_tables([messages.select(_SCHEMA.names).cast(_SCHEMA), combined.select(_SCHEMA.names).cast(_SCHEMA)])
        _, _, windows, own, source, place, of, rep, string, lowest = self._lowest(messages)
        # runs of windows of a string with one smallest id below that of some sender
        run = np.flatnonzero(np.append(True, (string[1:] != string[:-1]) | (lowest[1:] != lowest[:-1])))
        begin = np.cumsum(windows[rep]) - windows[rep]
        run_string, run_id, run_size = string[run], lowest[run], np.diff(np.append(run, len(string)))
        run_inner = run - begin[run_string]
        first_run = np.searchsorted(run_string, np.arange(len(rep) + 1))
        many = np.diff(first_run)[of]
        sender = np.repeat(np.arange(len(own)), many)
        which = _runs(many, first_run[of])
        told = run_id[which] < own[sender]
        return self._told(messages, source, place, sender[told], run_inner[which[told]], run_size[which[told]], run_id[which[told]])

    def _told(self, messages: pa.Table, source: np.ndarray, place: np.ndarray, sender: np.ndarray, inner: np.ndarray, size: np.ndarray, ids: np.ndarray) -> pa.Table:
        bucket, blocks = messages.column("bucket")[0].as_py(), np.asarray(messages.column("block"))
        return _messages([
            (bucket, int(blocks[k]), 1, place[sender[a:b]].astype(np.uint32).tobytes(), np.stack([inner[a:b], size[a:b]]).astype(np.uint16).tobytes(), _narrow(ids[a:b]), None)
            for k, a, b in _cuts(source[sender])
        ])

    # --- the first level of windows that very many blocks hold

    def combined(self, messages: pa.Table) -> pa.Table:
        """First level to buckets: each different window once, with the smallest id of the group of blocks."""
        messages = messages.sort_by("block")
        blob, at, windows, own, _, _, of, rep, _, lowest = self._lowest(messages)
        me = messages.column("bucket")[0].as_py()
        return self._sent(blob, at[rep], windows[rep], lowest, np.full(len(rep), (me - self.first) // self.groups), me)

    def relayed(self, messages: pa.Table, answers: pa.Table) -> pa.Table:
        """First level to blocks: their windows that a smaller id holds, in this group of blocks or beyond. What a bucket
        proper answered to a block goes on to it."""
        if not messages.num_rows:
            return answers.select(_SCHEMA.names)
        messages = messages.sort_by("block")
        _, _, _, own, source, place, of, _, _, lowest = self._lowest(messages)
        if answers.num_rows:
            lowest = lowest.copy()
            np.minimum.at(lowest, np.concatenate(_array(answers, "keys", np.uint32)), np.concatenate(_ids_of(answers)))
        sender = np.flatnonzero(lowest[of] < own)
        return self._told(messages, source, place, sender, np.zeros(len(sender), int), np.ones(len(sender), int), lowest[of[sender]])

    # --- the verdict

    def covered(self, docs: pa.Table, told: pa.Table, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which bytes of a block go: strings that a smaller id of the block holds, and what the buckets say of the others."""
        if (found := self.candidates(docs, told, buf, offsets)) is None:
            return np.zeros(len(buf), bool)
        first, windows, ids, bucket, new = found
        lead, string = np.flatnonzero(new), np.cumsum(new) - 1
        gone = ids > np.minimum.reduceat(ids, lead)[string]
        cover = np.zeros(len(buf) + 1, np.int32)
        spans = [(first[gone], (first + windows + self.length - 1)[gone])]
        answers = _of_kind(told, 1)
        if answers.num_rows:
            open_ = np.flatnonzero(~gone)
            held = np.searchsorted(string[open_], np.arange(len(lead) + 1))  # of each string the places still open
            base = np.searchsorted(bucket[lead], np.asarray(answers.column("bucket")))
            keys = _array(answers, "keys", np.uint32)
            of = np.concatenate([k.astype(np.int64) + b for k, b in zip(keys, base, strict=True)])
            inner, size = np.concatenate([np.frombuffer(x.as_py(), np.uint16).reshape(2, -1) for x in answers.column("counts")], axis=1).astype(np.int64)
            many = held[of + 1] - held[of]
            places, run = open_[_runs(many, held[of])], np.repeat(np.arange(len(of)), many)
            begin = first[places] + inner[run]
            spans.append((begin, begin + size[run] + self.length - 1))
        for begin, end in spans:
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
        return np.cumsum(cover)[:-1] > 0


def once_a_batch(rows: DataFrame) -> DataFrame:
    """Rows `_id, _text, _row` that are equal throughout are one row for each batch of a partition, and `_n` says how many they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = np.asarray(batch.column(batch.schema.get_field_index("_mark")))
            part = batch.select([0, 1, 2])
            times = np.ones(len(mark), np.int32)
            order = np.argsort(mark, kind="stable")
            first = np.flatnonzero(np.append(True, mark[order][1:] != mark[order][:-1])) if len(mark) else np.zeros(0, np.int64)
            lead = np.repeat(order[first], np.diff(np.append(first, len(mark))))
            for i, j in zip(lead[lead != order].tolist(), order[lead != order].tolist(), strict=True):  # marks only bring rows together
                if part.slice(i, 1).equals(part.slice(j, 1)):
                    times[i] += 1
                    times[j] = 0
            kept = part.append_column("_n", pa.array(times))
            yield kept.filter(pa.array(times > 0)) if (times == 0).any() else kept

    schema = StructType([*rows.schema.fields, StructField("_n", IntegerType())])
    return rows.withColumn("_mark", F.xxhash64("_id", "_text", "_row")).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = 50, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), as_text: bool = False, gram: int = 20, block_bytes: int = 4 << 20, hot: int = 8192, fan: int = 64) -> DataFrame:
    """Remove from every whole text each byte covered by a string of `length` bytes that also starts in a document with a smaller id.

    Every window of `length` bytes has an anchor that depends on its bytes alone. Blocks of documents send the hashes
    of their anchors by way of stations to buckets and learn which are shared among documents: windows under other anchors occur once and
    are left out. The strings of windows under shared anchors go to buckets with their bytes, each different one once
    a block, and there their suffixes are sorted (`sort_windows`): equal windows end up in one class, and its smallest
    id decides. Hashes only route and bring candidates together; no byte goes without a comparison of bytes.

    Blocks are dealt by id, text and the partition that a row lies in, and rows that are equal throughout are one row with a count for each
    batch of it, so neither an id nor a row repeated any number of times makes a large block; repeats are rows again at the end. An anchor told more than `hot` times (once for each
    block and 16 runs there) is spread over all buckets window by window, and such windows are combined over `fan` blocks at a time before they reach their bucket.
    All windows of whole texts are judged on the input.

    A null text counts as empty. A null id counts as larger than every id. Documents with the same id never remove
    each other's bytes; repeated rows get a row each. Texts shorter than `length` are kept whole. Columns in `keep` are
    handed through; others are ignored. An empty table gives an empty result.
    Returns `doc_id, n_bytes, n_removed, n_spans, kept` and `keep`; `kept` is binary, or with `as_text` a string, without what a cut
    left of characters.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    blocks = max(8, -(-total // block_bytes))
    steps = Exchange(length, gram, blocks, max(8, total // (2 * block_bytes)), max(8, total // block_bytes), hot, fan)
    tasks = max(8, -(-total // (4 * block_bytes)))  # so many bytes a task, whatever the size of the table
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    names = ["_block", "_id", "_text", "_row", "_n"]
    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), row.alias("_row"))
    kept_type = named.schema["_row"].dataType
    block = F.pmod(F.xxhash64("_id", "_text", F.spark_partition_id()), F.lit(blocks))
    rows = once_a_batch(named).select(block.alias("_block"), "_id", "_text", "_row", "_n").repartition(tasks, "_block")

    def step(name: str):
        """A step of one group, after which its memory is given back."""

        def run(*groups: pa.Table) -> pa.Table:
            out = finish(*groups) if name == "finish" else getattr(steps, name)(*groups)
            release_memory()
            return out

        return (lambda a, b: run(a, b)) if name in ("delivered", "strings", "answers", "relayed", "finish") else (lambda t: run(t))

    def side() -> GroupedData:  # the same plan each time, so that one shuffle of the texts serves all steps
        return rows.toDF(*names).groupBy("_block")

    def to(messages: DataFrame, whom: str) -> GroupedData:
        return messages.toDF(*_SCHEMA.names).repartition(tasks, whom).groupBy(whom)

    def finish(docs_: pa.Table, told: pa.Table) -> pa.Table:
        docs_ = _in_order(docs_)
        if not docs_.num_rows:
            return empty
        buf, offsets = flat(docs_.column("_text"))
        gone = steps.covered(docs_, told, buf, offsets)
        removed = np.append(0, np.cumsum(gone))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
        spans = np.append(0, np.cumsum(begins))
        kept = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if as_text:
            kept = [b.decode("utf-8", "ignore") for b in kept]
        counts = [np.diff(offsets), removed[offsets[1:]] - removed[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]]
        return pa.table([docs_.column("_id"), *map(pa.array, counts), pa.array(kept, empty.schema.field("kept").type), docs_.column("_row"), docs_.column("_n")], names=empty.schema.names)

    empty = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary()), ("_row", to_arrow_type(kept_type)), ("_n", pa.int32())]).empty_table()
    hashes = side().applyInArrow(step("anchors"), MESSAGE)
    routed = to(hashes, "bucket").applyInArrow(step("routed"), MESSAGE)
    called = to(routed, "bucket").applyInArrow(step("shared"), MESSAGE)
    shared = to(hashes, "bucket").cogroup(to(called, "block")).applyInArrow(step("delivered"), MESSAGE)
    strings = side().cogroup(to(shared, "block")).applyInArrow(step("strings"), MESSAGE)

    def received(low: int, past: int) -> GroupedData:
        """Strings for some buckets. A condition that is not deterministic stays above the shuffle, so one serves all uses."""
        wanted = F.when(F.spark_partition_id() >= 0, F.col("bucket").between(low, past - 1))
        return strings.toDF(*_SCHEMA.names).repartition(tasks, "bucket").where(wanted).groupBy("bucket")

    combined = received(steps.first, 1 << 62).applyInArrow(step("combined"), MESSAGE)
    answers = received(0, steps.first).cogroup(to(combined, "bucket")).applyInArrow(step("answers"), MESSAGE)
    relayed = received(steps.first, 1 << 62).cogroup(to(answers, "block")).applyInArrow(step("relayed"), MESSAGE)
    told = shared.unionByName(relayed)
    schema = StructType([StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField("kept", StringType() if as_text else BinaryType()), StructField("_row", kept_type), StructField("_n", IntegerType())])
    out = side().cogroup(to(told, "block")).applyInArrow(step("finish"), schema)
    out = out.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))  # at most the rows of a batch
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col(f"_row.{c}").alias(c) for c in keep])
