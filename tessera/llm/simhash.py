"""SimHash near-duplicate linking through covering locality-sensitive hashing.

Fingerprints: lower-cased (A-Z) text, words ``[^\\x20\\x09-\\x0D]+``, shingles of consecutive words with
repeats, XXH64 with seed 42; a bit is set if it is set in over half of the hashes. Two fingerprints are
linked if they differ in at most RADIUS = 3 bits.

Covering tables: every bit position gets a non-zero vector of F_2^4, and table v (one of the 15 non-zero
vectors) keeps the positions whose vector has odd inner product with v. Up to three differing positions
span at most three dimensions, so some v is orthogonal to all of them: every pair within the radius agrees
in that table. No pair is missed and no parameter is left to chance.

Buckets: equal fingerprints are one entry. A bucket of at most BUCKET entries is linked inside its task and
only a spanning forest of its links leaves it. The entries of a larger bucket are split again by a covering
family over the bits that are still free, about half of which are fixed at each level; a bucket with f
free bits has at most 2**f entries, so the descent ends with small buckets for any input.

Components come from alternating large-star and small-star steps over the forest edges, each written to
the shared folder. Nothing is collected to the driver.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated
rows appear as often as they are given; a null doc_id has a component but is never its name unless the
component has no other; rows of one key with different texts are documents of their own; an empty table gives
an empty result; further columns are ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_name, in_chunks, map_rows, materialize, n_rows

RADIUS = 3
BITS = 64
#: Entries of a bucket that are compared directly; larger buckets are split over their free bits.
BUCKET = 1024
_TABLES = range(1, 1 << (RADIUS + 1))
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 text."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < width:
        hashes = [xxh(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh(flat[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]
    planes = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (the fingerprint as a signed long)."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text] + ["fp bigint"])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(fps.view(np.int64))], names=[*rest, "fp"])

        return work

    return map_rows(docs, schema, make)


def _family(free: int) -> list[int]:
    """For each table the bits it fixes among ``free``: positions get the non-zero vectors in turn."""
    masks = [0] * len(_TABLES)
    turn = 0
    for bit in range(BITS):
        if free >> bit & 1:
            vector = 1 + turn % len(_TABLES)
            turn += 1
            for k, v in enumerate(_TABLES):
                if (vector & v).bit_count() & 1:
                    masks[k] |= 1 << bit
    return masks


def _fixed(path: int) -> int:
    """The bits fixed by a path of tables, one base-16 digit a level, the first level highest."""
    digits = []
    while path:
        digits.append(path & 15)
        path >>= 4
    fixed = 0
    for v in reversed(digits):
        fixed |= _family(~fixed & (1 << BITS) - 1)[v - 1]
    return fixed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints ``x`` (uint64)."""
    left = np.ones(len(x), bool)
    edges = []
    for seed in range(len(x)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(x ^ x[at]) <= RADIUS))
            if len(near):
                left[near] = False
                edges += [(at, int(k)) for k in near]
                queue += near.tolist()
    return edges


def _link_buckets(entries: DataFrame, n_parts: int | None = None) -> DataFrame:
    """(path, a, b): links with path -1, and with another path the entries ``a`` of buckets that are too large.

    ``entries`` has (path, key, fp); rows of a bucket arrive together and in order, so a bucket is held only
    until it is known to be too large.
    """

    def run(batches):
        held: list[np.ndarray] = []
        n_held, at, large = 0, None, False
        out: list[np.ndarray] = []

        def emit(path, a, b):
            a = np.asarray(a, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), path, np.int64)), pa.array(a), pa.array(np.asarray(b, np.int64))], names=["path", "a", "b"])

        def close():
            if n_held > 1 and not large:
                x = np.concatenate(held)
                if edges := _forest(x.view(np.uint64)):
                    e = np.array(edges)
                    out.append(np.stack([x[e[:, 0]], x[e[:, 1]]]))

        for batch in batches:
            path, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(fp)]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if (path[a], key[a]) != at:
                    close()
                    held, n_held, at, large = [], 0, (path[a], key[a]), False
                held.append(fp[a:b])
                n_held += b - a
                if n_held > BUCKET:
                    large = True
                    x = np.concatenate(held)
                    yield emit(path[a], x, x)
                    held = []
            if len(out) > 1000:
                e = np.concatenate(out, axis=1)
                out = []
                yield emit(-1, e[0], e[1])
        close()
        if out:
            e = np.concatenate(out, axis=1)
            yield emit(-1, e[0], e[1])

    grouped = entries.repartition("path", "key") if n_parts is None else entries.repartition(n_parts, "path", "key")
    return grouped.sortWithinPartitions("path", "key", "fp").mapInArrow(run, "path bigint, a bigint, b bigint")


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect the same components as all pairs of ``fps`` (``n`` distinct, column fp) within the radius."""
    found = None
    todo, paths = fps.select(F.lit(0).cast("long").alias("path"), "fp"), [0]
    while True:
        # Keys of each open path, chosen by a map from path to the masks of its tables.
        masks = {p: [_fixed(p << 4 | v) for v in _TABLES] for p in paths}
        tables = F.create_map(*[x for p, ms in masks.items() for x in (F.lit(p).cast("long"), F.array(*[F.lit(_signed(m)).cast("long") for m in ms]))])
        entries = todo.select("path", "fp", F.posexplode(tables[F.col("path")]).alias("v", "mask"))
        entries = entries.select((F.shiftleft("path", 4) + F.col("v") + 1).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        done = materialize(_link_buckets(entries), n * len(_TABLES))
        edges = done.where("path = -1").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        paths = [r[0] for r in done.where("path >= 0").select("path").distinct().collect()]  # at most 15 a level and path
        if not paths:
            return found
        # An entry goes on once for each path, however many of its buckets were large.
        todo = done.where("path >= 0").select("path", F.col("a").alias("fp")).distinct()


def _contract(edges: DataFrame) -> DataFrame:
    """Each task replaces its own edges by stars around the smallest member of what they connect."""

    def run(batches):
        parent: dict[int, int] = {}

        def top(x):
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while (p := parent.get(x, x)) != root:
                parent[x], x = root, p
            return root

        def flush():
            rows = [(x, top(x)) for x in list(parent)]
            rows = [r for r in rows if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
                    parent.setdefault(a, a)
            if len(parent) > 1_000_000:  # what is connected stays so across the parts that leave
                yield flush()
                parent.clear()
        if parent:
            yield flush()

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, n: int) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) over at most ``n`` nodes: root is the smallest node reachable."""
    at = materialize(_contract(edges.select("a", "b")).distinct(), n)
    last = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), n)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(low, "u")
        after = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n)
        discard(at, least, large, low)
        at = after
        mark = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = mark


def _prints(docs: DataFrame, keep: list[str], text: str, width: int, rows: int) -> DataFrame:
    """``keep`` and fp for every one of the ``rows``; dealt out by them so that the table has few files, however many the texts had."""
    return materialize(with_fingerprint(docs.select(*keep, text), text, width).repartition(F.xxhash64(*keep, "fp")), rows)


def _roots(prints: DataFrame, key: str, rows: int) -> DataFrame:
    """(fp, rep, root) for the distinct fingerprints of ``prints``: its smallest key, and a name of its component."""
    reps = materialize(prints.groupBy("fp").agg(F.min(key).alias("rep")), rows)
    n = n_rows(reps)
    edges = links(reps.select("fp"), n)
    return materialize(reps.join(components(edges, n).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), n)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row a document: key, fingerprint (16 hex digits), component_id (smallest key reachable)."""
    n = n_rows(docs)
    prints = _prints(docs, [key], text, width, n)
    rooted = _roots(prints, key, n)
    names = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), n)
    groups = materialize(rooted.join(names, "root").select("fp", "component_id"), n)
    out = prints.join(groups, "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Text of a chunk, whose kept rows travel back to it together.
CHUNK_BYTES = 8 << 20


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of its smallest key (null last).

    If the smallest key stands in several rows of a component, it is that of the smallest fingerprint, and of rows
    that agree in both that of the text with the smallest hash. Rows of one key with unlike texts belong to
    different components and are kept or dropped apart. Rows are written once, in buckets by chunk, and known by
    their place; the places that stay travel to their chunks, and no text is shuffled.
    """
    t, row, h = fresh_name(docs, "chunk"), fresh_name(docs, "place"), fresh_name(docs, "hash")
    table, _ = in_chunks(docs, text, CHUNK_BYTES, t, row)
    n = n_rows(table)
    body = table.select(t, row, F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(h), F.col(text).alias("body"))
    prints = _prints(body, [t, row, "key", h], "body", width, n)
    rooted = _roots(prints, "key", n)
    # Of each fingerprint one row, then of each component: both are combined before they are shuffled.
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("fp"), F.col(h), F.col(t), F.col(row))
    firsts = materialize(prints.groupBy("fp").agg(F.min(F.struct(order.alias("order"), F.col(t).alias("t"), F.col(row).alias("row"))).alias("first")), n)
    best = firsts.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = best.groupBy(F.col("first.t").alias("__t")).agg(F.array_sort(F.collect_list("first.row")).alias("__rows"))
    kept = materialize(kept, n)
    out = table.join(kept, F.col(t) == F.col("__t"))
    return out.where(F.array_contains("__rows", F.col(row))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash_covering(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
