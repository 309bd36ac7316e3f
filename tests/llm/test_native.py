"""Sharding and quality rules: results against plain Python, and nothing but native expressions in the plans."""

import collections
import random
import re
import zlib

from tessera.llm import quality_rules as qr
from tessera.llm import sharding as sd


def jump(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def plan(df):
    return df._jdf.queryExecution().toString()


def test_jump_against_the_loop(spark):
    rng = random.Random(0)
    keys = [0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1] + [rng.getrandbits(63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sd.jump_shards(df_col("k"), [1, 2, 40, 41, 1000]).alias("s"))
    for r in df.collect():
        assert list(r["s"]) == [jump(r["k"], n) for n in (1, 2, 40, 41, 1000)]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_assign(docs, rows):
    out = sd.assign_shards(docs, 40, slot_block_rows=4)
    got = out.collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = collections.Counter((x[0], len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert not re.search("Python|Pandas|Arrow", plan(out))


def test_many_copies_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "COPIES", 7)
    rows = [(5, "same")] * 100 + [(5, "other")] * 7 + [(None, None)] * 15 + [(k, "x") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (10, 1_000):
        slots = collections.defaultdict(list)
        got = sd.assign_shards(df, 4, slot_block_rows=block).collect()
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(t or "") + 16) for i, t in rows)


def test_growth_moves_rows_only_into_the_new_shard():
    moved = [k for k in range(4000) if jump(k, 40) != jump(k, 41)]
    assert all(jump(k, 41) == 40 for k in moved) and 60 < len(moved) < 140


def measures(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def rejected(t):
    t = t or ""
    n, chars, symbols, dup, _ = measures(t)
    lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    caps, small = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    return symbols * 5 > n or caps > small or t.count("!") * 10 > n * 3 or dup * 10 > lines * 6 or chars > n * 20 or chars < n * 2


def test_judge(spark, docs, rows):
    extra = [(100, "# * $ " * 60), (101, "SHOUTING LOUDLY AT ALL " * 20 + "q"), (102, "wow! oh! " * 30 + "fine words in here"), (103, "\n".join(f"line {i % 3} with {i % 3} words" for i in range(40))), (104, "a b c d e f g h i j " * 7)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = qr.judge(df).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        m = measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not rejected(r["text"]))


def test_exact_path_agrees(spark, docs, monkeypatch):
    monkeypatch.setattr(qr, "_PLACE_BITS", 3)  # every text is then too long to be packed
    for r in qr.measure(docs.select("doc_id", "text")).collect():
        assert r["n_repeat_words"] == measures(r["text"])[4]


def test_cascade_order_and_plan(docs):
    order = qr.plan_cascade(docs)
    assert {f["rule"].name for f in order} == {r.name for r in qr.RULES}
    assert [f["rejects"] / f["seconds"] for f in order] == sorted((f["rejects"] / f["seconds"] for f in order), reverse=True)
    assert not re.search("Python|Pandas|Arrow", plan(qr.judge(docs)))


def test_columns_named_like_measures(spark):
    rows = [(1, "fine words in a row here " * 20, "own", 7), (2, None, "own", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = {r["doc_id"]: r for r in qr.judge(df).collect()}
    assert got[1]["n_words"] == 120 and got[2]["n_words"] == 0 and got[2]["kept"] is False
    varied = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(80)), "own", 7)], "doc_id long, text string, kept string, n_words int")
    assert [tuple(r) for r in qr.keep_passing(varied).collect()] == [tuple(r) for r in varied.collect()]


def test_sample_comes_from_the_whole_table(spark):
    """A table sorted so that its first rows break no rule still tells the rules apart."""
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 2000 THEN repeat('fine words here ', 20) ELSE repeat('# * ', 60) END AS text").coalesce(4)
    found = {f["rule"].name: f["rejects"] for f in qr.plan_cascade(df)}
    assert 0.3 < found["symbol_share"] < 0.7


def test_keep_passing(docs, rows):
    got = qr.keep_passing(docs)
    assert got.columns == docs.columns
    want = collections.Counter(r[0] for r in rows if not (measures(r[1])[0] < 50 or 100 * measures(r[1])[4] > 50 * measures(r[1])[0] or rejected(r[1])))
    assert collections.Counter(r["doc_id"] for r in got.collect()) == want


def test_empty(empty):
    assert sd.assign_shards(empty, 40).collect() == [] and qr.judge(empty.select("doc_id", "text")).collect() == [] and qr.keep_passing(empty).collect() == []
