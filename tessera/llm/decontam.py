"""Benchmark decontamination by a prefix-filtered set join.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all non-ASCII characters. A
window is WINDOW = 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Shingles of three words are ordered by their count over all documents; a window's rarest shingle is
its prefix: a document that contains the window contains that shingle, so only places where a prefix shingle
occurs are looked at. Length and place bounds then drop places where no whole window can fit, and the match
is verified by comparing words outwards, which finds every window around the place at once.

The benchmark is the stated query set. One pass over the documents counts the shingles of all items, in a table of
fixed size: a shingle's count is that of its slot, which is its own or larger, and any order finds the same windows.
Items are then taken in blocks of at most BLOCK_BYTES of text: the driver holds a block, and its index travels to
the executors. One block needs one more pass. For several, the documents are written once with a row number; each
block is a pass that writes the rows with a hit, and a last pass joins these: passes grow with the blocks alone.

Defined results: null and empty texts have no words; items without words match nothing; rows with the same
item_id count as one item, and a null item_id is listed as the empty string; repeated documents are judged
one by one; an empty benchmark leaves every document clean; further columns are ignored by ``scan`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_name, map_rows, materialize, opened, ship

WINDOW = 10
SHINGLE = 3
#: UTF-8 bytes of the items indexed at a time; their index takes some twenty times as much in each Python worker.
BLOCK_BYTES = 4_000_000
#: Slots of the table of shingle counts, a power of two.
SLOTS = 1 << 22
#: Words whose slot a worker remembers.
_HELD_WORDS = 1_000_000
#: Tables of hits that are joined to one.
_TABLES = 64

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Lists of (item id as string, words), each of at most BLOCK_BYTES of text; larger single items are alone."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        body = (row[1] or "").encode()
        words = words_of(body)
        if words:
            if block and size + len(body) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((row[0] or "", words))
            size += len(body)
    if block:
        yield block


def _shingles(words: list[bytes]) -> list[tuple]:
    width = min(SHINGLE, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def _slot(words: list[bytes] | tuple, slots: int) -> int:
    return zlib.crc32(b" ".join(words)) & (slots - 1)


def _texts(batch: pa.RecordBatch, name: str):
    for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield t.as_py() or b""


def _corpus_counts(docs: DataFrame, text: str, benchmark: DataFrame, item_text: str) -> dict[int, int]:
    """How often shingles fall into each slot of the benchmark's shingles, over all documents: SLOTS numbers at most.

    Slots of first words, a table of the same size, tell at once where no shingle of the benchmark begins.
    """
    spark, slots = docs.sparkSession, SLOTS

    def of_items(batches):
        seen = set()
        for batch in batches:
            for t in _texts(batch, item_text):
                for s in _shingles(words_of(t)):
                    seen.add((_slot(s, slots), len(s)))
                    seen.add((_slot(s[:1], slots), 0))
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.int32())], names=["slot", "width"])

    known = benchmark.select(item_text).mapInArrow(of_items, "slot int, width int").groupBy("width").agg(F.collect_set("slot").alias("slots")).collect()
    if not known:
        return {}
    marks = {}
    for r in known:  # a row a width, 0 for first words
        marks[r["width"]] = bytearray(slots)
        for s in r["slots"]:
            marks[r["width"]][s] = 1
    held = ship(spark, {k: bytes(v) for k, v in marks.items()})

    def run(batches):
        own = opened(held)
        first, widths = own[0], [(k, m) for k, m in sorted(own.items()) if k]
        begins: dict[bytes, int] = {}
        seen: Counter = Counter()
        for batch in batches:
            for t in _texts(batch, text):
                w = words_of(t)
                if len(begins) > _HELD_WORDS:
                    begins.clear()
                for x in set(w).difference(begins):
                    begins[x] = first[zlib.crc32(x) & (slots - 1)]
                for i in [i for i, x in enumerate(w) if begins[x]]:
                    for k, m in widths:
                        s = zlib.crc32(b" ".join(w[i : i + k])) & (slots - 1)
                        if m[s]:
                            seen[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    rows = docs.select(text).mapInArrow(run, "s int, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r["s"]: r["n"] for r in rows}


class _Index:
    """Prefix shingles of a block's windows, each with its places in the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[int, int]):
        self.items = items
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            sh = _shingles(words)
            size = min(WINDOW, len(words))
            each = size - len(sh[0]) + 1
            ranked = [(counts.get(_slot(s, SLOTS), 0), s, i) for i, s in enumerate(sh)]
            for i in sorted({min(ranked[a : a + each])[2] for a in range(len(words) - size + 1)}):
                self.places[sh[i]].append((k, i))
        self.first = {s[0] for s in self.places}
        self.widths = sorted({len(s) for s in self.places})

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (start, end) and the ids of the items with an occurring window."""
        runs, ids, n = [], set(), len(w)
        at = [i for i, x in enumerate(w) if x in self.first]
        if not at:
            return runs, ids
        reached: dict[tuple[int, int], int] = {}
        for i in at:
            for width in self.widths:
                for k, p in self.places.get(tuple(w[i : i + width]), ()):
                    name, item = self.items[k]
                    m = len(item)
                    size = min(WINDOW, m)
                    # Place bound: what fits before and after both places must make a whole window.
                    if min(i, p) + min(n - i, m - p) < size or reached.get((k, i - p), -1) > i:
                        continue
                    a, b = 0, width
                    while a < p and a < i and item[p - a - 1] == w[i - a - 1]:
                        a += 1
                    while p + b < m and i + b < n and item[p + b] == w[i + b]:
                        b += 1
                    reached[k, i - p] = i + b
                    if a + b >= size:
                        runs.append((i - a, i + b))
                        ids.add(name)
        return runs, ids


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", mark: str = "found", keep_text: bool = True, clean_only: bool = False) -> DataFrame:
    """``docs`` with a column ``mark``: n_words, the hit runs flattened to (start, end, ...) and the item ids, sorted.

    With ``clean_only`` the rows with a hit are left out.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    counts = _corpus_counts(docs, text, benchmark, item_text)
    fields = [f for f in docs.schema.fields if f.name != mark and (f.name != text or keep_text)]
    if size <= BLOCK_BYTES:
        index = ship(spark, _Index(next(_blocks(benchmark, item, item_text), []), counts))
        return _marked(docs, fields, text, mark, clean_only, index)
    row, before = fresh_name(docs, "row"), fresh_name(docs, "before")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    hits: list[DataFrame] = []
    for block in _blocks(benchmark, item, item_text):
        index = ship(spark, _Index(block, counts))
        del block
        hits.append(materialize(_hits(docs, row, text, index)))
        index.unpersist()
        if len(hits) == _TABLES:
            together = materialize(reduce(DataFrame.unionByName, hits))
            discard(*hits)
            hits = [together]
    found = reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.struct(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).alias(before))
    return _marked(docs.join(found, row, "left"), fields, text, mark, clean_only, None, before)


_MARK = "struct<n_words: bigint, runs: array<bigint>, items: array<string>>"


def _hits(docs: DataFrame, row: str, text: str, index) -> DataFrame:
    """(row, runs, items) for the rows with a window of the block."""

    def make():
        own = opened(index)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, runs, items = [], [], []
            for k, t in zip(batch.column(batch.schema.get_field_index(row)).to_pylist(), _texts(batch, text)):
                found, ids = own.find(words_of(t))
                if found:
                    at.append(k)
                    runs.append([x for r in _merge(found) for x in r])
                    items.append(sorted(ids))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[row, "runs", "items"])

        return work

    return map_rows(docs.select(row, text), f"`{row}` bigint, runs array<bigint>, items array<string>", make)


def _marked(docs: DataFrame, fields: list, text: str, mark: str, clean_only: bool, index=None, before: str | None = None) -> DataFrame:
    """``fields`` of ``docs`` and ``mark``, from the windows of ``index`` or from the hits in the column ``before``."""
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{mark}` {_MARK}"])

    def make():
        own = opened(index) if index is not None else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(batch.schema.get_field_index(before)).to_pylist() if before else [None] * batch.num_rows
            rows = []
            for t, held in zip(_texts(batch, text), old):
                w = words_of(t)
                if own is not None:
                    runs, ids = own.find(w)
                else:
                    runs, ids = (list(zip(held["runs"][::2], held["runs"][1::2])), held["items"]) if held else ([], [])
                rows.append({"n_words": len(w), "runs": [x for r in _merge(runs) for x in r], "items": sorted(ids)})
            out = pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(rows, _FOUND)], names=[*names, mark])
            return out.filter(pa.array([not r["runs"] for r in rows])) if clean_only else out

        return work

    return map_rows(docs, schema, make)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_hit, n_items, items_sha256, contaminated, items (ids, sorted as strings)."""
    found = find_windows(docs.select(key, text), benchmark, text, keep_text=False)
    runs = F.col("found.runs")
    n_hit = F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.when(a["s"] < 0, F.struct(a["n"].alias("n"), x.alias("s"))).otherwise(F.struct((a["n"] + x - a["s"]).alias("n"), F.lit(-1).cast("long").alias("s"))), lambda a: a["n"])
    items = F.col("found.items")
    return found.select(
        key,
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(runs) > 0).alias("contaminated"),
        items.alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with the columns of ``docs``."""
    return find_windows(docs, benchmark, text, mark=fresh_name(docs, "found"), clean_only=True).select(*docs.columns)


def op6_prefix_filter(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scan(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
pos AS (
  SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hit AS (SELECT r, i, m, item_id FROM pos JOIN win USING (m, g)),
nh AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, range(10) AS o(k) WHERE k < m GROUP BY r),
ni AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(ni.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ni.ids, '')) AS items_sha256, nh.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""
