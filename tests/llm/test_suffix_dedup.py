import hashlib
import random

import pytest

from tessera.llm import suffix_dedup as sd

LAST = (1 << 63) - 1


def brute(rows, length):
    """(id, bytes, removed runs) for each row."""
    least: dict[bytes, int] = {}
    docs = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in docs:
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            least[w] = min(least.get(w, LAST), i)
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if least[b[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        runs = []
        for k, g in enumerate(gone):
            if g and (k == 0 or not gone[k - 1]):
                runs += [k, k + 1]
            elif g:
                runs[-1] = k + 1
        out.append((i, b, runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def compare(spark, rows, schema, **params):
    length = params.get("length", sd.MIN_LENGTH)
    got = sd.dedup(spark.createDataFrame(rows, schema), **params).collect()
    key = lambda r: (r[0], r[1], r[2], r[3])
    have = sorted((LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], tuple(r["spans"]), bytes(r["kept"])) for r in got)
    want = sorted((i, len(b), tuple(runs), kept) for i, b, runs, kept in brute([(r[0], r[1]) for r in rows], length))
    assert sorted(have, key=key) == sorted(want, key=key)
    assert all(r["n_removed"] == r["n_bytes"] - len(r["kept"]) for r in got)


def test_intervals_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        length, letters = rng.choice([3, 5, 8, 50]), rng.choice([b"ab", b"abcd", b"a"])
        segs = list(dict.fromkeys(bytes(rng.choice(letters) for _ in range(rng.randint(length, length + 40))) for _ in range(rng.randint(1, 25))))
        hold = [rng.randint(0, 9) for _ in segs]
        best: dict[bytes, int] = {}
        for s, h in zip(segs, hold):
            for i in range(len(s) - length + 1):
                best[s[i : i + length]] = min(best.get(s[i : i + length], 99), h)
        for s, g in zip(segs, sd.smallest_holder(segs, hold, length)):
            assert g.tolist() == [best[s[i : i + length]] for i in range(len(s) - length + 1)]


def test_expansion_stops_at_the_threshold():
    import numpy as np

    x = np.frombuffer(b"abcabcabcabc\xffabcabc\xff", np.uint8) + np.uint8(1)
    order = sd.suffix_order(x, 16)
    for length in (1, 2, 4, 6):
        bounds = sd.common_prefix_bounds(x, order, length)
        for i in range(1, len(x)):
            a, b = x[order[i - 1] :].tolist(), x[order[i] :].tolist()
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n] != 0:
                n += 1
            assert bounds[i] == (n < length)


def test_awkward_documents(spark, rows, docs):
    compare(spark, rows, docs.schema)


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_small_letters_small_chunks_and_hot_minimizers(spark, hot):
    rng = random.Random(hot)
    base = "".join(rng.choice("abc") for _ in range(300))
    rows = []
    for i in range(30):
        a = rng.randrange(250)
        rows.append((rng.randrange(20), base[a : a + rng.randrange(60)] + "".join(rng.choice("ab") for _ in range(rng.randrange(40))) + "é"))
    compare(spark, rows, "doc_id long, text string", length=8, gram=4, chunk_bytes=200, block_bytes=300, hot=hot)


def test_long_text_in_parts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range((1 << 20) + 500))
    cut = (1 << 20) - 20
    rows = [(1, long), (2, "x" * 30 + long[cut - 40 : cut + 40] + "y" * 30)]
    got = {r["doc_id"]: r for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["spans"] == [30, 110]


def test_empty_table(spark, empty):
    assert sd.dedup(empty).collect() == []


def test_query_columns(spark):
    out = sd.op3_interval_expansion(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    row = out.where("n_removed = n_bytes AND n_bytes > 0").first()
    assert row is None or row["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_minimizer_once_and_several_times(spark):
    """A segment that has its minimizer once shares windows with one that has it several times."""
    rng = random.Random(11)
    rows = []
    for k in range(150):
        text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))  # noqa: B023, E731
        head, unit = text(26), text(rng.choice([1, 2, 5]))
        rows += [(2 * k, head + (unit * 30)[:26] + text(60)), (2 * k + 1, head + (unit * 60)[: rng.randrange(30, 60)] + text(60))]
    compare(spark, rows, "doc_id long, text string")


def test_tails_behind_periodic_text(spark):
    """Segments that agree in their first bytes and in their size are not the same segment."""
    import numpy as np

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(60):
        head, unit = text(30), text(rng.choice([1, 3, 7]))
        rows += [(2 * k + j, head + (unit * 140)[:140] + text(60)) for j in (0, 1)]
    compare(spark, rows, "doc_id long, text string")
    for _, t in rows:
        b = np.frombuffer(t.encode(), np.uint8)
        h, start, n, item = sd.anchors(sd.gram_hashes(b, sd.ANCHOR), np.array([0, len(b)]), sd.MIN_LENGTH, sd.ANCHOR)
        assert n.max() <= sd.MIN_LENGTH - sd.ANCHOR + 1 and start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and (start + n)[-1] == len(b) - sd.MIN_LENGTH + 1


def test_long_periodic_text(spark):
    """Runs of one minimizer longer than 16 bits can count, among unrelated repeats in the same parts."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [text(200) for _ in range(40)]
    rows = [(i, text(20) + s) for i, s in enumerate(shared * 2)]
    rows += [(100, text(30) + "spam " * 20_000 + text(30)), (101, text(40) + "spam " * 20_000 + text(40)), (102, "-" * 100_000), (103, text(5) + "-" * 100_000)]
    compare(spark, rows, "doc_id long, text string")
    with pytest.raises(ValueError):
        sd.dedup(spark.createDataFrame(rows[:1], "doc_id long, text string"), length=40_000)


def test_few_buckets_are_enough(spark):
    """More chunks than Spark allows buckets."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    rows = [(k, base[(a := rng.randrange(400)) : a + 90] + str(k) * 30) for k in range(60)]
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        compare(spark, rows, "doc_id long, text string", chunk_bytes=100)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_keys_must_be_integers(spark):
    with pytest.raises(ValueError):
        sd.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_segments_of_one_hash_are_compared_by_bytes(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import xxhash

    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    monkeypatch.setattr(sd, "_mix", lambda x: x & np.uint64(3))
    h = np.unique(np.concatenate([sd.anchors(sd.gram_hashes(np.frombuffer(b, np.uint8), 4), np.array([0, len(b)]), 8, 4)[0] for b in texts]))
    found = sd._Segments(texts, h, 8, 4)
    held = found.texts().to_pylist()
    assert len(set(zip(found.key.tolist(), held))) == len(held)
    for k, b in enumerate(held):
        for r, p in zip(found.row[found.first[k] : found.first[k + 1]], found.place[found.first[k] : found.first[k + 1]]):
            assert texts[r][p : p + len(b)] == b
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    segs = [b"abcdefghi", b"bcdefghij", b"abcdefghi", b"zzzzzzzzz"]
    n = len(segs)
    rows = pa.table({"key": pa.array([1] * n), "mark": pa.array([1] * n), "t": pa.array(range(n)), "sid": pa.array([0] * n), "lo": pa.array([5, 3, 7, 1]), "hi": pa.array([5, 3, 7, 1]), "seg": pa.array(segs, pa.binary())})
    got = sd._match_block(rows, 8, 4, 1000).to_pylist()
    assert sorted((r["t"], r["a"], r["b"], r["m"]) for r in got) == [(0, 1, 2, 3), (2, 0, 1, 5), (2, 1, 2, 3)]
