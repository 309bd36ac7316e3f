"""Sharding by jump consistent hashing (native DataFrame expressions only).

A stable integer key and the number of shards decide a row's shard; no ring table is kept. Going from n to
n + 1 shards moves a row only into the new shard, and does so for one row in n + 1. The generator is the
published 64-bit linear congruence; its product is formed from 32-bit limbs, because SQL integers neither
wrap nor are unsigned.

Defined results: a null key counts as key 0; null text has no bytes and checksum 0; repeated rows each get
a slot of their own; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_rows

_M32 = 0xFFFFFFFF
_MULT = 2862933555777941757
_M_HI, _M_LO = _MULT >> 32, _MULT & _M32
#: Steps taken before the loop looks whether anything is left; a key needs about ln(shards) of them.
_STEPS = 64
#: Rows that one task numbers at most, on average; larger shards are numbered in blocks.
SLOT_BLOCK_ROWS = 2_000_000
#: Copies of a row that are given their slots together; more are numbered in pieces of so many.
COPIES = 100_000


def _mul32(a: Column, const: int) -> Column:
    """(a * const) mod 2**32 for 0 <= a < 2**32, without leaving 63 bits."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(const)
    high = (F.shiftright(a, 16) * F.lit(const)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_M32))


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The limbs of key * _MULT + 1 modulo 2**64."""
    t0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M_LO)
    t1 = F.shiftright(lo, 16) * F.lit(_M_LO)
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(t1, 16) + _mul32(hi, _M_LO) + _mul32(lo, _M_HI)
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def jump_shards(key: Column, shards: list[int]) -> Column:
    """Struct with fields s0, s1, ...: the shard of ``key`` for each count in ``shards``, from one pass of the jumps."""
    if not shards or min(shards) < 1:
        raise ValueError("shard counts must be positive")
    most = max(shards)
    names = [f"s{i}" for i in range(len(shards))]
    key = F.coalesce(key.cast("long"), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next_key(acc["hi"], acc["lo"])
        jump = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            ((acc["j"] + 1).cast("double") * jump).cast("long").alias("j"),
            *[F.when(acc["j"] < n, acc["j"]).otherwise(acc[s]).alias(s) for s, n in zip(names, shards)],
        )
        return F.when(acc["j"] < most, moved).otherwise(acc)

    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_M32)).alias("lo"),
        F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(s) for s in names],
    )
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, _STEPS))), state, step)
    if most > _STEPS:
        # A key that has not come to its end goes on; each step raises j, so ``most`` of them always suffice.
        rest = F.transform(F.array(state), lambda s: F.when(s["j"] < most, F.aggregate(F.sequence(F.lit(_STEPS + 1), F.lit(most)), s, step)).otherwise(s))
        state = rest[0]
    return F.transform(F.array(state), lambda s: F.struct(*[s[n].cast("int").alias(n) for n in names]))[0]


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", slot_block_rows: int = SLOT_BLOCK_ROWS) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    Rows that agree in key, size and checksum are counted before the shuffle and given their slots as ranges
    of at most COPIES, so a key that a third of the rows share costs few rows, and no array holds all its slots.
    Slots follow (block, key, size, checksum, piece); a shard has one block per ``slot_block_rows`` rows of the
    table, so no task numbers a whole large shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).cast("long").alias("k"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    counted = slim.groupBy("k", "size", "crc").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("at", jump_shards(F.col("k"), [n_shards, n_shards + 1]))
    n = n_rows(docs)
    last = F.expr(f"(copies - 1) div {COPIES}")
    counted = counted.select("k", "size", "crc", "copies", F.col("at.s0").alias("shard"), F.col("at.s1").alias("grown"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    counted = counted.withColumn("copies", F.least(F.col("copies") - F.col("piece") * COPIES, F.lit(COPIES).cast("long")))
    counted = materialize(counted, n)
    blocks = max(1, -(-n // slot_block_rows))
    counted = counted.withColumn("block", F.pmod(F.xxhash64("k", "size", "crc", "piece"), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("shard", "block").orderBy(F.col("k").asc_nulls_first(), "size", "crc", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    if blocks > 1:
        totals = counted.groupBy("shard", "block").agg(F.sum("copies").alias("held"))
        before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("shard", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skip"))
        placed = placed.join(totals, ["shard", "block"]).withColumn("first", F.col("first") + F.col("skip"))
    return placed.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def op4_jump_hash(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 40)


_CRC_TABLE = []
for _n in range(256):
    for _ in range(8):
        _n = (_n >> 1) ^ 0xEDB88320 if _n & 1 else _n >> 1
    _CRC_TABLE.append(_n)

ORACLE = f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
hexed AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS h FROM slim),
sized AS (
  SELECT doc_id, n + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(range(0, n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, ([{", ".join(map(str, _CRC_TABLE))}]::BIGINT[])[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS text_crc32
  FROM hexed),
jumps AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS id, coalesce(doc_id, 0)::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT id, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT id, j, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jumps WHERE j < 41)),
shards AS (
  SELECT id, max(b) FILTER (b < 40) AS shard, max(b) AS grown FROM jumps GROUP BY id)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'key' AS law, h.shard::INT AS shard,
  row_number() OVER (PARTITION BY h.shard ORDER BY s.doc_id NULLS FIRST, s.size, s.text_crc32) - 1 AS slot, h.grown::INT AS grown_shard
FROM sized s JOIN shards h ON h.id = coalesce(s.doc_id, 0)
"""
