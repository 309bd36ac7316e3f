import hashlib
import math
import random
import re
import weakref
from collections import Counter, defaultdict

import pytest

from tessera.llm import decontam as dc
from tessera.llm import pii

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(text, items):
    w = WORD.findall(low(text))
    hit, ids = set(), set()
    for name, t in items:
        own = WORD.findall(low(t))
        size = min(10, len(own))
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                ids.add("" if name is None else str(name))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def bench_rows(rows):
    first = rows[0][1].split()
    return [(10, " ".join(first[5:25])), (9, " ".join(first[20:31]) + " new words follow here"), (2, "one TWO"), (7, None), (8, ""), (11, "é à, ü"), (None, "same same same"), (9, "one"), (30, words(random.Random(9), 40))]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_scan_against_brute_force(spark, docs, rows, bench_rows, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    got = dc.scan(docs, bench).collect()
    want = Counter()
    for r in rows:
        n, hit, ids = brute_hits(r[1], bench_rows)
        want[r[0], n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0] += 1
    assert Counter(tuple(r[:6]) for r in got) == want


def test_passes_grow_with_the_blocks(spark, monkeypatch):
    """Fifty blocks: one pass that counts, one a block, one that joins; the driver holds a block at a time."""
    rng = random.Random(2)
    items = [(i, words(rng, 25)) for i in range(50)]
    texts = [(i, words(rng, 30) + " " + items[i % 60][1] if i % 60 < 50 and i % 3 else words(rng, 40)) for i in range(120)]
    calls, alive = Counter(), []

    class Block(list):
        pass

    def watched(name):
        real = getattr(dc, name)

        def call(*args):
            calls[name] += 1
            return real(*args)

        return call

    def blocks(*args):
        for b in real_blocks(*args):
            assert all(x() is None for x in alive)
            held = Block(b)
            b.clear()
            alive.append(weakref.ref(held))
            yield held
            del held

    real_blocks = dc._blocks
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    monkeypatch.setattr(dc, "_TABLES", 16)
    monkeypatch.setattr(dc, "_blocks", blocks)
    for name in ("_corpus_counts", "_hits", "_marked"):
        monkeypatch.setattr(dc, name, watched(name))
    got = {r["doc_id"]: r for r in dc.scan(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)).collect()}
    assert calls == {"_corpus_counts": 1, "_hits": 50, "_marked": 1}
    for i, t in texts:
        n, hit, ids = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == (n, hit, ids)


def test_few_slots_change_nothing(spark, docs, rows, bench_rows, monkeypatch):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    want = sorted(map(str, dc.scan(docs, bench).collect()))
    monkeypatch.setattr(dc, "SLOTS", 4)
    assert sorted(map(str, dc.scan(docs, bench).collect())) == want


def test_repetitive_texts(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 25)))) for i in range(8)]
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = {r["doc_id"]: r for r in dc.scan(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in texts:
        n, hit, ids = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == (n, hit, ids)


def test_drop_contaminated(spark, docs, rows, bench_rows, empty):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if not brute_hits(r[1], bench_rows)[1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.drop_contaminated(docs, none).count() == len(rows)
    assert dc.scan(empty, bench).collect() == []


# PII ------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


FIXED = ["a@b.c", "x.y+z%q@host-1.example.co.uk.", "a@b", "@b.c", "a@b@c.d", "a@@b.c", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "11.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "++49 30 1234567", "+1", "4111111111111111 4111111111111111", "é@b.c a..b@c.d", "1.1.1.1 1.1.1.1@a.b"]


def test_base_spans_against_patterns():
    rng = random.Random(1)
    for t in FIXED:
        assert pii.base_spans(t) == brute_base(t), t
    for alphabet in ("ab@.-+1 ", "0123.. -", "+12 (). -@a"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert pii.base_spans(t) == brute_base(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a." * 200_000, "@" * 300_000, "1.1." * 100_000, "+1 " + "1 " * 200_000):
        pii.base_spans(t)
    for w in ("." * 300_000 + "a" + "." * 300_000, "." * 600_000):
        assert pii._term(w) == ("a" if "a" in w else "")


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(6)
    rows = [(i, f"{words(rng, 12)} Zebulon from {words(rng, 1)} writes to zeb@corp.example about {words(rng, 12)}") for i in range(6)]
    rows += [(10 + i, f"{words(rng, 6)} help@desk.example or the manual {words(rng, 20)} the {i}") for i in range(8)]
    rows += [(30 + i, f"the {words(rng, 30)}") for i in range(30)] + [(70, None), (71, ""), (72, "no data " * 30), (0, rows[0][1])]
    return rows


ASCII_SPACE = " \t\n\v\f\r"


def brute_words(t):
    """(start, end) of the words of a text, character by character."""
    out, start = [], None
    for i, c in enumerate(t + " "):
        if c in ASCII_SPACE:
            if start is not None:
                out.append((start, i))
            start = None
        elif start is None:
            start = i
    return out


def brute_core(t, a, b):
    """The word without what is neither letter, digit nor underscore at its ends."""
    while a < b and not re.match(r"\w", t[a]):
        a += 1
    while a < b and not re.match(r"\w", t[b - 1]):
        b -= 1
    return a, b


def brute_spans(rows, support=1, disclosure=0.9, width=5):
    """All spans of each row, from sets of documents alone."""
    n, cores, values, beside = len(rows), [], [], []
    for _, t in rows:
        t = t or ""
        ws, base = brute_words(t), brute_base(t)
        cores.append([(*brute_core(t, a, b), a, b) for a, b in ws])
        inside = {k for k, (a, b) in enumerate(ws) for _, x, y in base if a < y and x < b}
        mine = []
        for kind, x, y in base:
            value = t[x:y].casefold() if kind == "email" else t[x:y] if kind == "ip" else "".join(c for c in t[x:y] if c in "0123456789")
            left = [k for k, (a, b) in enumerate(ws) if b <= x][-width:]
            right = [k for k, (a, b) in enumerate(ws) if a >= y][:width]
            near = [k for k in left + right if k not in inside]
            context = tuple(t[slice(*ws[k])] for k in near)
            mine.append(((kind, value), {t[slice(*brute_core(t, *ws[k]))].casefold() for k in near} - {""}, context))
        values.append({e for e, _, _ in mine})
        beside.append(mine)
    in_text = [{(t or "")[a:b].casefold() for a, b, _, _ in c} for (_, t), c in zip(rows, cores)]
    bad = defaultdict(set)
    for e in set().union(*values):
        holders = sum(e in v for v in values)
        terms = set().union(*(ts for m in beside for x, ts, _ in m if x == e))
        for term in terms:
            both = sum(any(x == e and term in ts for x, ts, _ in m) for m in beside)
            contexts = {c for m in beside for x, ts, c in m if x == e and term in ts}
            ic, pmi = math.log2(n / holders), math.log2(n * both / (sum(term in w for w in in_text) * holders))
            if ic > 0 and pmi >= disclosure * ic and len(contexts) >= support:
                bad[e].add(term)
    out = []
    for (_, t), c, held in zip(rows, cores, values):
        t = t or ""
        base, terms = brute_base(t), set().union(*(bad[e] for e in held)) if held else set()
        extra = [("term", a, b) for a, b, _, _ in c if a < b and t[a:b].casefold() in terms and not any(a < y and x < b for _, x, y in base)]
        out.append(sorted(base + extra, key=lambda s: (s[1], ["email", "ip", "card", "phone", "term"].index(s[0]))))
    return out


def brute_masked(t, spans):
    out, at = "", 0
    for kind, a, b in spans:
        if b > at:
            if a >= at:
                word = t[a]
                out += t[at:a] + f"<{kind.upper() if kind != 'term' else 'NUMBER' if word.isdigit() else 'NAME' if word.isupper() else 'WORD'}>"
            at = b
    return out + t[at:]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.mark.parametrize("held", [200_000, 0])
@pytest.mark.parametrize("support", [1, 3])
def test_find_against_brute_force(spark, leaky, support, held, monkeypatch):
    """With the sets held in workers, and with what takes their place when they grow too large."""
    monkeypatch.setattr(pii, "_HELD_TERMS", held)
    monkeypatch.setattr(pii, "_HELD_TEXTS", held)
    monkeypatch.setattr(pii, "_SLOTS", 64 if held == 0 else 1 << 22)
    got = pii.find(spark.createDataFrame(leaky, "doc_id long, text string"), support=support).collect()
    want = Counter()
    for (i, t), spans in zip(leaky, brute_spans(leaky, support)):
        base = [s for s in spans if s[0] != "term"]
        want[(i, *(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert any("term:" in r["spans"] for r in got)


def test_words_end_at_ascii_white_space(spark):
    """A term counts where it is marked: what other white space joins is another word."""
    for glue in ("\u00a0", "\u3000", "\x85", "\x1c", "/"):
        rows = [(i, f"a{i} secretx wrote to boss@corp.example about b{i}") for i in range(6)]
        rows += [(10 + i, f"some secretx{glue}filler and other words {i}") for i in range(30)] + [(50 + i, f"nothing here {i}") for i in range(9)]
        got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), support=3).collect()}
        want = {i: joined(s) for (i, _), s in zip(rows, brute_spans(rows, 3))}
        assert got == want and "term:" in got[0], repr(glue)


def test_prefilter_misses_no_base_span():
    rng = random.Random(7)
    maybe = re.compile(pii._MAYBE)
    for alphabet in ("ab@.-+1 ", "0123.. -", "+12 (). -@a", "4 1-"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert not brute_base(t) or maybe.search(t), t


def test_mask(spark, leaky, docs, rows, empty):
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "k") for i, t in leaky], "doc_id long, text string, n_chars long, terms string")
    out = pii.mask(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(leaky)
    for r in got:
        if r["text"] is not None:
            assert "@" not in r["text"] and "Zebulon" not in r["text"] and r["n_chars"] == len(r["text"])
    assert {r["doc_id"]: r["text"] for r in got}[72] == "no data " * 30
    same = pii.mask(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in same) == Counter((r[0], r[1]) for r in rows)
    assert pii.mask(empty).collect() == [] and pii.find(empty).collect() == []
