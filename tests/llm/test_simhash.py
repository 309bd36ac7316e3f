import random

import numpy as np
import xxhash

from tessera.llm import simhash as sh

from .conftest import SCHEMA


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def expected(rows):
    prints = [brute_print(r[1]) for r in rows]
    comp = brute_components(prints)
    names = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            names[c] = min(r[0], names.get(c, r[0]))
    return sorted((str(r[0]), f"{p:016x}", str(names.get(c))) for r, p, c in zip(rows, prints, comp))


def test_link_against_all_pairs(docs, rows):
    got = sh.link(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected(rows)


def test_every_pair_within_the_radius_collides():
    rng = random.Random(0)
    masks = sh._family((1 << 64) - 1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_chains_and_full_buckets(spark, monkeypatch):
    """Fingerprints in a few chains and one crowded bucket, with buckets that have to be split."""
    monkeypatch.setattr(sh, "BUCKET", 16)
    rng = random.Random(2)
    xs = {rng.getrandbits(64) for _ in range(60)}
    at = rng.getrandbits(64)
    for _ in range(60):
        at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        xs.add(at)
    base = rng.getrandbits(64)
    xs |= {base ^ (k * 0x0101) for k in range(200)}
    xs = sorted(xs)
    signed = np.array(xs, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = sh.components(sh.links(fps, len(xs)), len(xs)).collect()
    got = {r["node"]: r["root"] for r in found}
    comp = brute_components(xs)
    least = {}
    for x, c in zip(signed, comp):
        least[c] = min(x, least.get(c, x))
    assert [got.get(x, x) for x in signed] == [least[c] for c in comp]


def brute_keep(rows):
    """(id, text) of the row that stays of each component, with texts told apart by fingerprint alone."""
    prints = [brute_print(r[1]) for r in rows]
    comp = brute_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    first = {}
    for r, c, p in zip(rows, comp, signed):
        order = (r[0] is None, r[0] or 0, p)
        if c not in first or order < first[c][0]:
            first[c] = (order, r[0], p)
    return sorted((str(k), p) for _, k, p in first.values())


def kept_pairs(got):
    def signed(p):
        return p - (1 << 64) if p >> 63 else p

    return sorted((str(r["doc_id"]), signed(brute_print(r["text"]))) for r in got)


def test_keep_one(docs, rows):
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert kept_pairs(got) == brute_keep(rows)
    have = {tuple(r) for r in rows}
    assert all(tuple(r) in have for r in got)


def test_keep_one_goes_by_row_and_not_by_id(spark):
    """One id with several texts, in either order: unlike texts stay apart, copies under another id go."""
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white"
    cases = [[(2, b), (5, b), (5, a)], [(5, a), (5, b)], [(5, a), (5, b), (7, a), (7, c)], [(None, a), (None, b), (3, a)], [(5, a), (5, a), (5, b), (5, b)]]
    for case in cases:
        want = {(brute_print(t), min((i for i, x in case if x == t and i is not None), default=None), t) for _, t in case}
        for order in (case, case[::-1]):
            got = sh.keep_one(spark.createDataFrame(list(order), "doc_id long, text string").coalesce(1)).collect()
            assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for _, i, t in want), order


def test_nulls_only(spark):
    df = spark.createDataFrame([(None, "a b c d", *[None] * 7), (None, "a b c d", *[None] * 7), (None, "quite other words are here", *[None] * 7)], SCHEMA)
    assert {r["component_id"] for r in sh.link(df).collect()} == {None} and sh.keep_one(df).count() == 2


def test_empty(empty):
    assert sh.link(empty).collect() == [] and sh.keep_one(empty).collect() == []
