"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Tokens come from the given byte-level BPE file. A document that is longer than a sequence is cut into
pieces of the full length, its first piece taking the rest; full pieces are sequences of their own. The
others are dealt into blocks of about BLOCK_ITEMS pieces, and of a block only the lengths take part in the
search, so a block is some tens of kilobytes whatever the texts are.

Search: an individual is a partition of a block into bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that then hold a piece twice, and best-fits the displaced pieces: in
falling length, or up to three at a time that together leave least room, which bit sets of lengths find at once.
The first individuals are best fit decreasing, that completion, and shaken orders. Every block evolves on ISLANDS islands with seeds of their own; after each epoch the elite
of an island migrates to the next one in the ring. A block is finished when it reaches a lower bound or
after EPOCHS epochs. Then the bins that are not nearly full are dissolved, and their pieces, gathered from
all blocks, are packed again in fewer blocks, until one block holds what is left.

Defined results: null and empty texts are the end token alone; repeated rows are packed once each; an empty
table gives an empty result; further columns are ignored. Ids follow the tokenizer file exactly: a faster
engine with the same vocabulary encodes texts within U+0000..U+024F, where the two were compared on every
code point; all other texts go to the reference engine.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, n_rows, per_worker

SEQUENCE = 1024
END_ID = 2
BLOCK_ITEMS = 16_384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
#: Tasks of the search, at most; each takes whole (block, island) pairs.
_MOST_TASKS = 50_000
#: A bin with less room than this stays as it is when the others are dissolved.
NEARLY_FULL = 4
_ROUNDS = 6


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to a uint32 array of ids, without special tokens; text that spells one is ordinary text."""
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    full.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(spelt[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    wide = re.compile("[^\x00-ɏ]")
    # The fast engine holds long unbroken runs in quadratic time.
    run = re.compile(r"[^\s]{2000}|\s{2000}")

    def encode(text: str) -> np.ndarray:
        if wide.search(text) or (len(text) >= 2000 and run.search(text)):
            return np.array(full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` > 0 tokens; only the first may be shorter than ``size``."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        encode = per_worker(f"encoder {tokenizer}", lambda: encoder(tokenizer))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, at, piece, start, length, crc = batch.column(0), [], [], [], [], []
            for row, t in enumerate(batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            cols = [keys.take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            return pa.RecordBatch.from_arrays(cols, names=["k", "piece", "start", "length", "ids_crc32"])

        return work

    return map_rows(docs.select(key, text), f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def lower_bound(lengths: np.ndarray, size: int = SEQUENCE) -> int:
    """Martello and Toth's bound: large pieces take a bin each, and what fits beside them is limited."""
    counts = np.bincount(lengths, minlength=size + 1)
    number = np.cumsum(counts)
    total = np.cumsum(counts * np.arange(size + 1))
    best = -(-int(total[-1]) // size)
    half = size // 2
    for k in range(0, half + 1):
        large = int(number[-1] - number[size - k])  # longer than size - k
        mid = int(number[size - k] - number[half])  # over half, up to size - k
        mid_sum = int(total[size - k] - total[half])
        small_sum = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, large + mid + max(0, -(-(small_sum - (mid * size - mid_sum)) // size)))
    return best


class _Bins:
    """Bins under best fit: for each amount of free room the bins that have it, and a bit set of the amounts in use."""

    def __init__(self, size: int = SEQUENCE):
        self.size, self.items, self.room = size, [], []
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.used = 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        if not self.by_room[r]:
            self.used |= 1 << r
        self.by_room[r].append(b)

    def add(self, items: list[int], filled: int) -> None:
        self.items.append(items)
        self.room.append(self.size - filled)
        self._file(len(self.items) - 1)

    def fit(self, order: list[int], lengths: list[int]) -> None:
        """Put the items of ``order`` where they leave least room."""
        by_room, room, items = self.by_room, self.room, self.items
        for i in order:
            n = lengths[i]
            above = self.used >> n
            if above:
                r = n + (above & -above).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    self.used &= ~(1 << r)
                items[b].append(i)
                room[b] = r - n
                self._file(b)
            else:
                self.add([i], n)


class _Stock:
    """Pieces by length, with bit sets of the lengths there are and of what they leave of a sequence."""

    def __init__(self, items: list[int], lengths: list[int], size: int):
        self.size, self.n = size, len(items)
        self.by: dict[int, list[int]] = {}
        for i in items:
            self.by.setdefault(lengths[i], []).append(i)
        self.has = sum(1 << n for n in self.by)
        self.mirror = sum(1 << (size - n) for n in self.by)

    def take(self, n: int) -> int:
        held = self.by[n]
        self.n -= 1
        if len(held) == 1:
            del self.by[n]
            self.has ^= 1 << n
            self.mirror ^= 1 << (self.size - n)
        return held.pop()

    def largest(self, room: int) -> int:
        return (self.has & ((2 << room) - 1)).bit_length() - 1

    def _two(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths of sum ``total``, the larger as large as can be up to ``most``."""
        both = self.has & (self.mirror >> (self.size - total)) & ((2 << most) - 1)
        while both:
            n = both.bit_length() - 1
            if 2 * n < total:
                return None
            if 2 * n > total or len(self.by[n]) > 1:
                return n, total - n
            both ^= 1 << n
        return None

    def exact(self, total: int, tries: int) -> tuple[int, ...] | None:
        """Up to three lengths of sum ``total``; of triples those with one of the ``tries`` largest lengths are looked at."""
        if self.has >> total & 1:
            return (total,)
        if two := self._two(total, total):
            return two
        low = self.has & ((1 << total) - 1)
        for _ in range(tries):
            n = low.bit_length() - 1
            if 3 * n < total:
                return None
            if two := self._two(total - n, n):
                if (n, *two).count(n) <= len(self.by[n]):
                    return n, *two
            low ^= 1 << n
        return None

    def fill(self, room: int) -> list[int]:
        """Pieces for ``room``, taken out: three or fewer that leave hardly any, after the largest as long as there are none."""
        out: list[int] = []
        while self.n and room and (n := self.largest(room)) > 0:
            for left in range(min(_SLACK, room - 1) + 1):
                if found := self.exact(room - left, _TRIES if left < 2 else 0):
                    return out + [self.take(x) for x in found]
            out.append(self.take(n))
            room -= n
        return out


#: Room that a completed bin may keep, and lengths tried as the largest of three.
_SLACK, _TRIES = 8, 10


def _complete(bins: _Bins, order: list[int], lengths: list[int], rng: random.Random) -> _Bins:
    """Best fit by several pieces at a time: the rooms of ``bins`` are filled as exactly as can be, then new bins."""
    stock, out = _Stock(order, lengths, bins.size), _Bins(bins.size)
    for k in sorted((k for k, r in enumerate(bins.room) if r), key=lambda k: (bins.room[k], rng.random())):
        r = bins.room[k]
        for left in range(min(_SLACK, r - 1) + 1):
            if found := stock.exact(r - left, _TRIES if left < 2 else 0) if stock.n else None:
                bins.items[k] += [stock.take(x) for x in found]
                bins.room[k] = left
                break
    for items, r in zip(bins.items, bins.room):
        out.add(items, bins.size - r)
    left = []
    while stock.n:
        n = stock.largest(bins.size)
        items = [stock.take(n), *stock.fill(bins.size - n)]
        filled = sum(lengths[i] for i in items)
        if stock.n:
            out.add(items, filled)
        else:
            left = items  # the last bin's pieces may fit beside others
    out.fit(sorted(left), lengths)
    return out


def _cost(bins: _Bins) -> tuple[int, int]:
    """Fewer bins first, then the fuller ones: Falkenauer's square measure."""
    return len(bins.items), -sum((bins.size - r) ** 2 for r in bins.room)


def _cross(a: _Bins, b: _Bins, lengths: list[int], rng: random.Random) -> _Bins:
    """A child with well-filled bins of ``b`` injected into ``a``; what is displaced goes where it fits best, one by one or by several."""
    ranked = sorted(range(len(b.items)), key=lambda k: (b.room[k], rng.random()))
    share = rng.choice((0.3, 0.7, 0.95))
    inject = [k for k in ranked[: max(1, len(ranked) * 2 // 3)] if rng.random() < share]
    child, taken = _Bins(a.size), bytearray(len(lengths))
    for k in inject:
        child.add(list(b.items[k]), b.size - b.room[k])
        for i in b.items[k]:
            taken[i] = 1
    displaced = []
    keep = rng.choice((0.0, 0.3, 0.7))
    for items, room in zip(a.items, a.room):
        kept = [i for i in items if not taken[i]]
        if len(kept) == len(items) and (room == 0 or rng.random() < (0.9 if room <= NEARLY_FULL else keep)):
            child.add(list(items), a.size - room)
        else:
            displaced += kept
    displaced.sort()  # items are numbered in falling length
    if rng.random() < 0.25:
        child.fit(displaced, lengths)
        return child
    return _complete(child, displaced, lengths, rng)


def _from_labels(labels: list[int], lengths: list[int], size: int) -> _Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(labels):
        groups.setdefault(b, []).append(i)
    bins = _Bins(size)
    for items in groups.values():
        bins.add(items, sum(lengths[i] for i in items))
    return bins


def _labels(bins: _Bins, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins.items):
        for i in items:
            out[i] = b
    return out


def evolve(lengths: list[int], elites: list[list[int]], seed: int, size: int = SEQUENCE, generations: int = GENERATIONS, population: int = POPULATION) -> _Bins:
    """The best partition of ``lengths`` (falling) found from best fit decreasing, shaken orders and ``elites``."""
    rng, n = random.Random(seed), len(lengths)
    bound = lower_bound(np.array(lengths), size)
    pop = [_from_labels(e, lengths, size) for e in elites]
    first = _Bins(size)
    first.fit(list(range(n)), lengths)
    pop.append(first)
    if len(first.items) > bound:
        pop.append(_complete(_Bins(size), list(range(n)), lengths, rng))
        while len(pop) < population:
            # Falling order, each length shaken a little: other near-perfect pairs are found first.
            shaken = sorted(range(n), key=lambda i: -lengths[i] * (1 + 0.06 * rng.random()))
            other = _Bins(size)
            other.fit(shaken, lengths)
            pop.append(other)
    pop.sort(key=_cost)
    for _ in range(generations):
        if len(pop[0].items) <= bound:
            break
        a, b = rng.sample(range(len(pop)), 2)
        child = _cross(pop[min(a, b)], pop[max(a, b)], lengths, rng)
        pop[-1] = min(pop[-1], child, key=_cost)
        child = _cross(pop[max(a, b)], pop[0], lengths, rng)
        pop[-1] = min(pop[-1], child, key=_cost)
        pop.sort(key=_cost)
    return pop[0]


_EVOLVED = "block bigint, island int, lengths array<int>, labels array<int>, n_bins int, squares bigint, done boolean"


def _epoch(islands: DataFrame, tasks: int, epoch: int, size: int, generations: int, population: int) -> DataFrame:
    """One epoch of every island: (block, island, lengths, elites) to its best individual."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for r in batch.to_pylist():
                best = evolve(r["lengths"], r["elites"], r["block"] * 1009 + r["island"] * 31 + epoch, size, generations, population)
                n_bins, squares = _cost(best)
                rows.append({"block": r["block"], "island": r["island"], "lengths": r["lengths"], "labels": _labels(best, len(r["lengths"])), "n_bins": n_bins, "squares": squares, "done": n_bins <= lower_bound(np.array(r["lengths"]), size)})
            schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("n_bins", pa.int32()), ("squares", pa.int64()), ("done", pa.bool_())])
            return pa.RecordBatch.from_pylist(rows, schema)

        return work

    # A stated number of partitions: by their bytes, which say nothing of the work, they would be joined to one.
    dealt = islands.repartitionByRange(tasks, "block", "island")
    return map_rows(dealt, _EVOLVED, make)


def _search(blocks: DataFrame, n_blocks: int, size: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(block, labels) for every (block, lengths), ``n_blocks`` of them: the best individual of its islands after ``epochs`` epochs."""
    found = None
    at = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.expr("CAST(array() AS array<array<int>>)").alias("elites"))
    for epoch in range(epochs):
        each = materialize(_epoch(at, min(n_blocks * islands, _MOST_TASKS), epoch, size, generations, population))
        best = each.groupBy("block").agg(
            F.min_by("labels", F.struct("n_bins", "squares", "island")).alias("labels"),
            F.max("done").alias("done"),
            F.first("lengths").alias("lengths"),
            F.map_from_entries(F.collect_list(F.struct("island", "labels"))).alias("all"),
        )
        best = materialize(best, n_blocks)
        last = epoch + 1 == epochs
        over = best.select("block", "labels") if last else best.where("done").select("block", "labels")
        found = over if found is None else found.unionByName(over)
        if last:
            break
        rest = best.where("NOT done")
        # Ring migration: an island goes on with its own elite and that of its neighbour.
        at = rest.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", "all")
        at = at.select("block", "island", "lengths", F.array(F.col("all")[F.col("island")], F.col("all")[F.pmod(F.col("island") + F.lit(islands - 1), F.lit(islands))]).alias("elites"))
    return found


def pack(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cutting = pieces(docs, tokenizer or default_tokenizer(), key, text, size)
    cutting = materialize(cutting.repartition(F.xxhash64("k", "piece", "ids_crc32")), n_rows(docs))
    full = cutting.where(F.col("length") == size)
    full = full.select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("offset"))
    # Pieces that agree in all they have are told apart by a number, so that each has a place of its own.
    todo = materialize(cutting.where(F.col("length") < size).groupBy("k", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("copies")).select("k", "piece", "start", "length", "ids_crc32", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), n_rows(cutting))
    out, n = full, n_rows(todo)
    for turn in range(1, _ROUNDS + 1):
        n_blocks = max(1, -(-n // block_items))
        order = Window.partitionBy("block").orderBy(F.col("length").desc(), "k", "piece", "ids_crc32", "copy")
        dealt = materialize(todo.withColumn("block", F.pmod(F.xxhash64("k", "piece", "ids_crc32", "copy", F.lit(turn)), F.lit(n_blocks))).withColumn("item", F.row_number().over(order) - 1), n)
        blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))
        placed = _search(blocks, n_blocks, size, ISLANDS, EPOCHS, GENERATIONS, POPULATION).select("block", F.posexplode("labels").alias("item", "bin"))
        inside = Window.partitionBy("block", "bin").orderBy("item")
        placed = dealt.join(placed, ["block", "item"]).withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        placed = materialize(placed.withColumn("filled", F.sum("length").over(Window.partitionBy("block", "bin"))).withColumn("round", F.lit(turn)), n)
        last = n_blocks == 1 or turn == _ROUNDS
        over = placed if last else placed.where(F.col("filled") > size - NEARLY_FULL)
        out = out.unionByName(over.select(*full.columns))
        if last:
            break
        todo = placed.where(F.col("filled") <= size - NEARLY_FULL).select("k", "piece", "start", "length", "ids_crc32", "copy")
        left = n_rows(todo)
        if left == 0:
            break
        n = left
    number = F.when(F.col("round") == 0, F.col("bin")).otherwise(-(F.col("round") + 8 * (F.col("block") * block_items * 2 + F.col("bin"))))
    return out.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", number.cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op9_island_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
