"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a MIN_LENGTH-byte string that also starts in a document with a smaller key.

Which strings meet: every MIN_LENGTH-byte window has a minimizer, the ANCHOR-byte substring of the smallest
hash, so equal windows have equal minimizers. Documents are cut into chunks of about CHUNK_BYTES; a chunk sends one row
for each distinct minimizer, and a minimizer that occurs twice in the corpus is sent back to the chunks that hold it. They send
the segments (the runs of windows of one minimizer) to the minimizer's partition. A minimizer with more than HOT
places is split by the windows themselves: each of them is then a segment with a key of its own, so no
partition grows with a frequent phrase. A chunk sends a segment once, with the smallest and the largest key
of its documents, so a passage that a third of all documents share costs a row a chunk.

The transform: distinct segments of one minimizer are joined with separators, about BLOCK_BYTES at a time,
and their suffixes are sorted. From the interval of all suffixes, breadth first, intervals are extended
backwards by one byte through the transform; an interval of length k that ends where no common prefix is known
fixes that common prefix as k - 1. Values come in increasing order, and the expansion stops at MIN_LENGTH: the suffixes between
two fixed places are those that share MIN_LENGTH bytes or more. The smallest key of such a group removes
its string from the documents with larger keys.

Memory: a chunk, or what one of the parts that minimizers are dealt to receives, is held at a time; a part
gets about as much as BUCKET_BYTES of text send, and no minimizer has more than HOT places in it. What chunks and parts
exchange are compressed columns. Documents are written once, in buckets by chunk, and read there three
times; their texts are never shuffled.

Defined results: null and empty texts have no bytes; repeated rows and different rows with one key remove
nothing from each other; a null key counts as larger than every other, and such rows remove nothing from each
other; an empty table gives an empty result; further columns are ignored. Keys are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked

MIN_LENGTH = 50
ANCHOR = 24
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
#: Text for each part that minimizers are dealt to; what a part receives is of the same order.
BUCKET_BYTES = 4 << 20
#: Text for each task that takes such parts, one after another.
TASK_BYTES = 16 << 20
#: Places of a minimizer above which its windows are dealt out one by one.
HOT = 10_000
_NONE = (1 << 63) - 1
_MASK48 = np.uint64((1 << 48) - 1)


def _u(x: int) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _u(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``width`` bytes, from the words of eight bytes that cover it."""
    n = len(b) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width < 8:
        words, at = b, range(width)
    else:
        words, at = np.ndarray(len(b) - 7, "<u8", b, 0, (1,)), sorted({*range(0, width - 7, 8), width - 8})
    out = np.full(n, _u(0xBF58476D1CE4E5B9))
    for k in at:
        out *= _u(0x9E3779B97F4A7C15)
        out += words[k : k + n]
        out = _mix(out)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: -(width - have)], x[width - have :]) if width > have else x


def _groups(texts: list[bytes], length: int, part: int = 1 << 20) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, rows, places, begins): texts joined to about ``part`` bytes, a long text in parts that share the windows' overlap."""
    held, rows, places, size = [], [], [], 0

    def flush():
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        return b"".join(held), np.array(rows), np.array(places), np.append(np.cumsum(lengths) - lengths, lengths.sum())

    for row, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), part):
            held.append(t[a : a + part + length - 1])
            rows.append(row)
            places.append(a)
            size += len(held[-1])
            if size >= part:
                yield flush()
                held, rows, places, size = [], [], [], 0
    if held:
        yield flush()


def anchors(hashes: np.ndarray, begins: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer as 48 bits, first window, windows, item) of the runs of windows, inside one item of a buffer, that have one minimizer.

    ``hashes`` are those of the buffer's grams, ``begins`` the places where its items begin, and its end. A run
    ends after as many windows as one place of a minimizer can serve; on periodic text further runs follow it.
    """
    low = _sliding_min(hashes, length - gram + 1)
    item = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(low)]
    beyond = begins[item + 1] - length + 1  # the first place from which no window fits
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (item[1:] != item[:-1])))
    start = np.flatnonzero(new & (np.arange(len(low)) < beyond))
    stop = np.minimum(np.append(start[1:], len(low)), beyond[start])
    most = length - gram + 1
    if len(start) and (stop - start).max() > most:
        pieces = -(-(stop - start) // most)
        stop, piece = np.repeat(stop, pieces), np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + piece * most
        stop = np.minimum(stop, start + most)
    return (low[start] & _MASK48).astype(np.int64), start, stop - start, item[start]


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``x`` (uint8, 0 separates) by their first ``depth`` bytes at least, by doubling from 8 bytes."""
    n = len(x)
    padded = np.concatenate((x, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    have = 8
    while have < depth:
        group = np.cumsum(new)
        rank = np.zeros(n + have, np.int64)
        rank[order] = group
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)  # places in the order that share their group with another
        if not len(at):
            break
        who = order[at]
        second = (group[at].astype(np.uint64) << np.uint64(32)) | rank[who + have].astype(np.uint64)
        by = np.argsort(second)
        order[at] = who[by]
        second = second[by]
        new[at] |= np.concatenate(([True], second[1:] != second[:-1]))
        have *= 2
    return order


def common_prefix_bounds(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at place i of the order if suffixes i - 1 and i share fewer than ``length`` bytes before a separator.

    Breadth-first backward extension on the transform: ``low`` and ``high`` are the intervals of one length.
    """
    n = len(x)
    bwt = x[order - 1]  # the byte before each suffix; before the first stands the last, a separator
    to = np.empty(n, np.int64)  # where a suffix goes when it is extended by the byte before it
    to[np.argsort(bwt, kind="stable")] = np.arange(n)
    first = x[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        skip = np.cumsum(size) - size
        inside = np.repeat(low - skip, size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(low)), size)
        real = bwt[inside] != 0
        place, owner = to[inside[real]], owner[real]
        if not len(place):
            break
        if len(place) > n // 8:
            held = np.full(n, -1, np.int64)
            held[place] = owner
            place = np.flatnonzero(held >= 0)
            owner = held[place]
        else:
            by = np.argsort(place)
            place, owner = place[by], owner[by]
        cut = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (first[place[1:]] != first[place[:-1]])))
        begin = place[cut]
        end = place[np.append(np.flatnonzero(cut)[1:], len(place)) - 1] + 1
        fresh = ~known[end]
        low, high = begin[fresh], end[fresh]
        known[high] = True
    # A suffix that meets its separator earlier shares less than ``length`` with whatever follows.
    stops = np.append(np.flatnonzero(x == 0), n)
    left = stops[np.searchsorted(stops, order)] - order
    short = left < length
    bounds = known[:n]
    bounds |= short
    bounds[1:] |= short[:-1]
    return bounds


def smallest_holder(segments: list[bytes], holders: list[int], length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For every window of every segment the smallest of the ``holders`` of the segments that have it."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    x = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, which becomes 0
    order = suffix_order(x, length)
    bounds = common_prefix_bounds(x, order, length)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    segment = np.searchsorted(ends, order, side="right")
    value = np.array(holders, np.int64)[segment]
    start = np.flatnonzero(bounds)
    least = np.minimum.reduceat(value, start)
    by_place = np.empty(len(x), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.append(start, len(x))))
    return [by_place[a : a + n - length + 1] for a, n in zip(begins.tolist(), sizes.tolist())]


def _chunks(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The documents as (t, row, k, id, b): chunk, place in it, key as given and as a number, bytes; and their bytes in all."""
    if not isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{key} must be an integer column: what is smaller is decided by number")
    chunks, total = chunked(docs, key, text, chunk_bytes)
    return chunks.select("t", "row", "k", F.coalesce(F.col("k").cast("long"), F.lit(_NONE)).alias("id"), "b"), total


_COLUMNS = {"h": "<i8", "n": "<u2", "key": "<i8", "mark": "<i8", "sid": "<i4", "lo": "<i8", "hi": "<i8", "a": "<i4", "b": "<i4", "m": "<i8"}


def _packed(segments: pa.Array | None = None, **columns: np.ndarray) -> bytes:
    """Columns of one length (and segments behind them), compressed: what goes from chunks to parts and back.

    The lengths of segments fit in 16 bits, as anchors() ends runs and dedup() checks the bound. Without names or types, so that a blob of a single row is small as well.
    """
    import zstandard

    raw = [v.astype(_COLUMNS[k]).tobytes() for k, v in columns.items()]
    if segments is not None:
        raw += [pc.binary_length(segments).to_numpy().astype("<u2").tobytes(), b"".join(segments.to_pylist())]
    return zstandard.compress(len(next(iter(columns.values()))).to_bytes(4, "little") + b"".join(raw), 1)


def _unpacked(blob: bytes, *names: str) -> pa.Table:
    """The columns ``names`` of a blob, which are all but the segments; these are called seg."""
    import zstandard

    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, {}
    for name in names:
        if name == "seg":
            ends = np.cumsum(np.frombuffer(raw, "<u2", n, at), dtype=np.int32)
            out[name] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(np.int32(0), ends).astype(np.int32)), pa.py_buffer(raw[at + 2 * n :])])
        else:
            column = np.frombuffer(raw, _COLUMNS[name], n, at)
            at += column.nbytes
            out[name] = pa.array(column)
    return pa.table(out)


def _dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parts that occur, where each begins and the last ends) that deals ``key`` to ``parts``; minimizers are small, so they are mixed first."""
    part = (_mix(key.astype(np.uint64) + _u(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    return order, found, np.append(begin, len(key))


_DEALT = "part bigint, t bigint, blob binary"


def _batch(part: np.ndarray, t: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(t, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "t", "blob"])


def _minimizers(chunks: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(part, t, blob): for each chunk and part the distinct minimizers h of the chunk, rising, and the number n of their places."""

    def run(batches):
        at, hs, texts, size, n_hs = None, [], [], 0, 0

        def take():
            hs.extend(anchors(gram_hashes(np.frombuffer(buffer, np.uint8), gram), begins, length, gram)[0] for buffer, _, _, begins in _groups(texts, length))
            texts.clear()
            return sum(map(len, hs))

        def flush():
            h, n = np.unique(np.concatenate(hs), return_counts=True)
            hs.clear()
            order, found, begin = _dealt(h, parts)
            h, n = h[order], np.minimum(n[order], 65535).astype(np.uint16)
            return _batch(found, np.full(len(found), at), [_packed(h=h[a:b], n=n[a:b]) for a, b in zip(begin, begin[1:])])

        for batch in batches:
            for t, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t != at:
                    if take():
                        yield flush()
                    at, size, n_hs = t, 0, 0
                texts.append(b.as_py())
                size += len(texts[-1])
                if size > 1 << 20:
                    n_hs, size = take(), 0
                    if n_hs > 1_000_000:
                        yield flush()
        if take():
            yield flush()

    return chunks.select("t", "b").mapInArrow(run, _DEALT)


def _by_part(dealt: DataFrame, tasks: int, names: tuple[str, ...], work, schema: str) -> DataFrame:
    """``work(t, tables)`` for all blobs of each part; it yields batches. A part is held at a time, a task has several."""

    def run(batches):
        at, ts, blobs = None, [], []
        for batch in batches:
            for part, t, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and ts:
                    yield from work(np.array(ts), [_unpacked(b, *names) for b in blobs])
                    ts, blobs = [], []
                    pa.default_memory_pool().release_unused()
                at = part
                ts.append(t)
                blobs.append(blob)
        if ts:
            yield from work(np.array(ts), [_unpacked(b, *names) for b in blobs])

    return dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _wanted(minimizers: DataFrame, tasks: int, hot: int) -> DataFrame:
    """(t, blob): minimizers h with two places or more, for the chunks that hold them; h is negative if it is split by windows."""

    def work(ts, tables):
        sizes = np.array([x.num_rows for x in tables])
        h = np.concatenate([x.column("h").to_numpy() for x in tables])
        n = np.concatenate([x.column("n").to_numpy() for x in tables]).astype(np.int64)
        _, back = np.unique(h, return_inverse=True)
        total = np.bincount(back, n).astype(np.int64)[back]
        h = np.where(total > hot, -1 - h, h)
        ends = np.cumsum(sizes)
        kept = [(t, h[a:b][total[a:b] > 1]) for t, a, b in zip(ts.tolist(), ends - sizes, ends)]
        kept = [x for x in kept if len(x[1])]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.int64()), pa.array([_packed(h=x) for _, x in kept], pa.binary())], names=["t", "blob"])

    return _by_part(minimizers, tasks, ("h", "n"), work, "t bigint, blob binary")


def _member(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


#: Segments whose bytes are gathered at a time: a place takes eight bytes and more for each of theirs.
_GATHER = 10_000


class _Segments:
    """The segments of the wanted minimizers of a chunk, the distinct ones in an order that the chunk's content alone decides.

    Segment k has key[k], mark[k], its number sid[k] among those of its key, and the places first[k]:first[k + 1] of
    row and place. A minimizer is its own mark and key; that of a hot one is negative, and the key is then the
    negative hash of a window. Segments of one key are sorted by a 64-bit hash, and equal hashes are compared by bytes.
    """

    def __init__(self, texts: list[bytes], wanted: np.ndarray, length: int, gram: int):
        plain, hot = np.sort(wanted[wanted >= 0]), np.sort(-1 - wanted[wanted < 0])
        found, buffers, base = [], [], 0
        most = -(-(2 * length - gram) // gram)  # grams side by side that cover the longest segment
        for buffer, rows, places, begins in _groups(texts, length):
            hashes = gram_hashes(np.frombuffer(buffer, np.uint8), gram)
            h, start, n, item = anchors(hashes, begins, length, gram)
            parts = []
            if len(on := np.flatnonzero(_member(h, plain))):
                parts.append((h[on], h[on], start[on], n[on] + length - 1, item[on]))
            if len(on := np.flatnonzero(_member(h, hot))):
                count = n[on]
                at = np.repeat(start[on] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                whole = gram_hashes(np.frombuffer(buffer, np.uint8), length)[at] >> np.uint64(1)
                parts.append((-1 - whole.astype(np.int64), np.repeat(-1 - h[on], count), at, np.full(len(at), length), np.repeat(item[on], count)))
            for key, mark, at, size, it in parts:
                own = np.zeros(len(at), np.uint64)
                for k in range(most):
                    own = _mix(own * _u(0x9E3779B97F4A7C15) + hashes[at + np.minimum(k * gram, size - gram)])
                own = _mix(own * _u(0x9E3779B97F4A7C15) + size.astype(np.uint64))
                found.append((key, mark, own, at + base, size, rows[it], at - begins[it] + places[it]))
            buffers.append(buffer)
            base += len(buffer)
        self.pool = np.frombuffer(b"".join(buffers), np.uint8)
        key, mark, own, at, size, row, place = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 7
        order = np.lexsort((own, key))
        key, own, self.row, self.place = key[order], own[order], row[order], place[order]
        mark, at, size = mark[order], at[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        if not self._equal(np.flatnonzero(~new), at, size):
            # Different segments share a hash: their bytes decide.
            held = [self.pool[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())]
            order = np.array(sorted(range(len(key)), key=lambda k: (key[k], held[k])))
            key, mark, at, size, self.row, self.place = (c[order] for c in (key, mark, at, size, self.row, self.place))
            new[1:] = [key[k] != key[k - 1] or held[order[k]] != held[order[k - 1]] for k in range(1, len(key))]
        at_first = np.flatnonzero(new)
        self.first = np.append(at_first, len(key))
        self.key, self.mark, self.at, self.size = key[at_first], mark[at_first], at[at_first], size[at_first]
        self.keys, begin = np.unique(self.key, return_index=True)
        self.begin = begin
        self.sid = np.arange(len(self.key)) - np.repeat(begin, np.diff(np.append(begin, len(self.key))))

    def _equal(self, again: np.ndarray, at: np.ndarray, size: np.ndarray) -> bool:
        """Whether the segments ``again`` have the bytes of those before them."""
        for a in range(0, len(again), _GATHER):
            k = again[a : a + _GATHER]
            n = size[k]
            if (n != size[k - 1]).any():
                return False
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if (self.pool[np.repeat(at[k], n) + inside] != self.pool[np.repeat(at[k - 1], n) + inside]).any():
                return False
        return True

    def texts(self) -> pa.Array:
        ends = np.cumsum(self.size)
        flat = np.empty(int(self.size.sum()), np.uint8)
        for a in range(0, len(self.size), _GATHER):
            n = self.size[a : a + _GATHER]
            begin = np.cumsum(n) - n
            flat[ends[a] - n[0] : ends[a] - n[0] + int(n.sum())] = self.pool[np.repeat(self.at[a : a + _GATHER] - begin, n) + np.arange(int(n.sum()))]
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def find(self, key: np.ndarray, sid: np.ndarray) -> np.ndarray:
        return self.begin[np.searchsorted(self.keys, key)] + sid


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places of the given ranges."""
    n = end - begin
    return np.repeat(np.arange(len(n)), n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _send(chunks: DataFrame, wanted: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(part, t, blob): the segments that a chunk sends to each part, with the least and largest id of their documents."""
    names, kinds = ["part", "t", "blob"], [pa.int64(), pa.int64(), pa.binary()]

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the chunk before
        nothing = pa.table([pa.array([], k) for k in kinds], names=names)
        if not docs.num_rows or not marks.num_rows:
            return nothing
        h = np.concatenate([x.column("h").to_numpy() for x in (_unpacked(b, "h") for b in marks.column("blob").to_pylist())])
        found = _Segments(docs.column("b").to_pylist(), np.unique(h), length, gram)
        if not len(found.key):
            return nothing
        own = docs.column("id").to_numpy()[found.row]
        lo, hi = np.minimum.reduceat(own, found.first[:-1]), np.maximum.reduceat(own, found.first[:-1])
        order, part, begin = _dealt(found.key, parts)
        texts, sid = found.texts(), found.sid.astype(np.int32)
        t = docs.column("t")[0].as_py()
        blobs = []
        for a, b in zip(begin, begin[1:]):
            at = order[a:b]
            blobs.append(_packed(texts.take(pa.array(at)), key=found.key[at], mark=found.mark[at], sid=sid[at], lo=lo[at], hi=hi[at]))
        return pa.Table.from_batches([_batch(part, np.full(len(part), t), blobs)])

    return chunks.select("t", "id", "b").groupBy("t").cogroup(wanted.groupBy("t")).applyInArrow(run, _DEALT)


def _may_match(segments: list[bytes], keys: np.ndarray, length: int, gram: int) -> np.ndarray:
    """False for distinct segments that share no window with another one.

    A window reaches at least half of what it has beside its minimizer to one side of it, so segments with a
    common window agree in that many bytes before the minimizer, or behind it. Every place of the minimizer
    counts, those in segments that have it several times included. These segments, and those of other keys,
    are not decided here.
    """
    half = -(-(length - gram) // 2)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    x = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = (gram_hashes(x, gram) & _MASK48).astype(np.int64)
    at = np.flatnonzero((h == keys[owner[: len(h)]]) & (np.arange(len(h)) + gram <= ends[owner[: len(h)]]))
    times = np.bincount(owner[at], minlength=len(sizes))
    out = times != 1
    who = owner[at]
    wide = gram_hashes(x, gram + half)
    for place in (at - half, at):
        fits = (place >= ends[who] - sizes[who]) & (place + gram + half <= ends[who])
        _, back, count = np.unique(wide[place[fits]], return_inverse=True, return_counts=True)
        out[who[fits]] |= count[back] > 1
    return out


def _match_block(rows: pa.Table, length: int, gram: int, block_bytes: int) -> pa.Table | None:
    """The matches of all rows of some keys."""
    from xxhash import xxh3_64_intdigest

    key, mark, t, sid, lo, hi = (rows.column(c).to_numpy() for c in ("key", "mark", "t", "sid", "lo", "hi"))
    segs = rows.column("seg").to_pylist()
    own = np.fromiter(map(xxh3_64_intdigest, segs), np.uint64, len(segs))
    order = np.lexsort((own, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
    if not all(segs[order[k]] == segs[order[k - 1]] for k in np.flatnonzero(~new).tolist()):
        # Different segments share a hash: their bytes decide.
        order = np.array(sorted(range(len(segs)), key=lambda k: (key[k], segs[k])))
        new[1:] = [key[a] != key[b] or segs[a] != segs[b] for a, b in zip(order, order[1:])]
    distinct = order[new]  # a row of each distinct segment
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(lo[order], np.flatnonzero(new))
    n_windows = np.fromiter((len(segs[k]) for k in distinct), np.int64, len(distinct)) - length + 1
    _, back, count = np.unique(key[distinct], return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[back] > 1)
    run_at, run_a, run_b, run_m = [], [], [], []
    if len(several):
        several = several[_may_match([segs[k] for k in distinct[several]], key[distinct[several]], length, gram)]
    plain = np.ones(len(distinct), bool)
    plain[several] = False
    alone = np.flatnonzero(plain)
    run_at.append(alone)
    run_a.append(np.zeros(len(alone), np.int64))
    run_b.append(n_windows[alone])
    run_m.append(least[alone])
    # Blocks end between keys, so that what can match stands in one block.
    sizes = np.cumsum(n_windows[several] + length)
    same_key = np.append(key[distinct[several]][1:] == key[distinct[several]][:-1], False) if len(several) else several
    begin = 0
    while begin < len(several):
        end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + block_bytes, side="right"))
        end = max(end, begin + 1)
        while end < len(several) and same_key[end - 1]:
            end += 1
        part = several[begin:end]
        by_window = smallest_holder([segs[k] for k in distinct[part]], least[part], length)
        flat = np.concatenate(by_window)
        edge = np.cumsum(n_windows[part])
        cut = np.ones(len(flat), bool)
        cut[1:] = flat[1:] != flat[:-1]
        cut[edge[:-1]] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(flat))
        who = np.searchsorted(edge, a, side="right")
        shift = (edge - n_windows[part])[who]
        run_at.append(part[who])
        run_a.append(a - shift)
        run_b.append(b - shift)
        run_m.append(flat[a])
        begin = end
    at, a, b, m = (np.concatenate(c) for c in (run_at, run_a, run_b, run_m))
    by = np.argsort(at, kind="stable")
    at, a, b, m = at[by], a[by], b[by], m[by]
    first = np.searchsorted(at, np.arange(len(distinct) + 1))
    row, run = _expand(first[index], first[index + 1])
    on = m[run] < hi[row]
    row, run = row[on], run[on]
    if not len(row):
        return None
    return pa.table([t[row], key[row], mark[row], sid[row].astype(np.int32), a[run].astype(np.int32), b[run].astype(np.int32), m[run]], names=["t", "key", "mark", "sid", "a", "b", "m"])


#: Rows that are matched at a time, apart from what their last key adds.
MATCH_ROWS = 40_000


def _match(segments: DataFrame, tasks: int, length: int, gram: int, block_bytes: int) -> DataFrame:
    """(t, blob): windows a to b of the segment (key, mark, sid) start in a document of id m, the smallest."""

    def work(ts, tables):
        rows = pa.concat_tables([x.append_column("t", pa.array(np.full(x.num_rows, t, np.int64))) for t, x in zip(ts.tolist(), tables)])
        key = rows.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        sorted_key, begin = key[order], 0
        while begin < len(order):
            end = min(begin + MATCH_ROWS, len(order))
            end = int(np.searchsorted(sorted_key, sorted_key[end - 1], side="right"))
            found = _match_block(rows.take(pa.array(order[begin:end])), length, gram, block_bytes)
            begin = end
            if found is None:
                continue
            t = found.column("t").to_numpy()
            by = np.argsort(t, kind="stable")
            who, edge = np.unique(t[by], return_index=True)
            found, edge = found.drop_columns(["t"]).take(pa.array(by)), np.append(edge, len(by))
            columns = {c: found.column(c).to_numpy() for c in found.column_names}
            blobs = [_packed(**{c: v[x:y] for c, v in columns.items()}) for x, y in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(blobs, pa.binary())], names=["t", "blob"])

    return _by_part(segments, tasks, ("key", "mark", "sid", "lo", "hi", "seg"), work, "t bigint, blob binary")


def _spans(docs: pa.Table, marks: pa.Table, texts: list[bytes], length: int, gram: int) -> dict[int, list[int]]:
    """The removed runs of each row of a chunk as start, end, ..."""
    found = _Segments(texts, np.unique(marks.column("mark").to_numpy()), length, gram)
    key, sid, a, b, m = (marks.column(c).to_numpy() for c in ("key", "sid", "a", "b", "m"))
    at = found.find(key, sid)
    mark, place = _expand(found.first[at], found.first[at + 1])
    row = found.row[place]
    on = m[mark] < docs.column("id").to_numpy()[row]
    row, mark, place = row[on], mark[on], found.place[place[on]]
    # Rows and places in one number each: runs of different rows never touch.
    start, end = (row << 40) + place + a[mark], (row << 40) + place + b[mark] + length - 1
    by = np.argsort(start)
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1] if len(end) else end
    out: dict[int, list[int]] = {}
    for x, y in zip(start.tolist(), end.tolist()):
        out.setdefault(x >> 40, []).extend((x & (1 << 40) - 1, y & (1 << 40) - 1))
    return out


def _remove(chunks: DataFrame, found: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """(k, n_bytes, n_removed, spans, kept) for every document: spans are the removed runs, flattened to (start, end, ...)."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the chunk before
        texts = docs.column("b").to_pylist()
        gone = _spans(docs, pa.concat_tables([_unpacked(b, "key", "mark", "sid", "a", "b", "m") for b in marks.column("blob").to_pylist()]), texts, length, gram) if docs.num_rows and marks.num_rows else {}
        n_removed, spans, kept = [], [], []
        for row, t in enumerate(texts):
            runs = gone.get(row, [])
            if runs:
                edges = [0, *runs, len(t)]
                left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            else:
                left = t
            n_removed.append(len(t) - len(left))
            spans.append(runs)
            kept.append(left)
        return pa.table([docs.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "spans", "kept"])

    return chunks.select("t", "row", "k", "id", "b").groupBy("t").cogroup(found.groupBy("t")).applyInArrow(run, f"k {kind}, n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = MIN_LENGTH, gram: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, spans (removed runs of bytes as start, end, ...), kept (the bytes that stay)."""
    if not 0 < gram <= length:
        raise ValueError("gram must be positive and at most length")
    if 2 * length - gram > 65535:
        raise ValueError("segments have 2 * length - gram bytes, 65,535 at most")
    chunks, total = _chunks(docs, key, text, chunk_bytes)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts, tasks = max(cores, -(-total // BUCKET_BYTES)), max(cores, -(-total // TASK_BYTES))
    sent = _send(chunks, _wanted(_minimizers(chunks, length, gram, parts), tasks, hot), length, gram, parts)
    return _remove(chunks, _match(sent, tasks, length, gram, block_bytes), docs.schema[key].dataType.simpleString(), length, gram).withColumnRenamed("k", key)


def op3_interval_expansion(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
win AS (SELECT r, id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
least_id AS (SELECT g, min(id) AS m FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i FROM win JOIN least_id USING (g) WHERE id > m),
step AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM step) GROUP BY r, k),
sums AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
edges AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT r, max(b), max(n) FROM runs JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS k FROM edges JOIN d USING (r) WHERE e > s GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
