import collections
import os
import random
import re

import pytest
import xxhash

from tessera.llm import license_scan as ls
from tessera.llm import sentence_spans as ss

MIT = ls.TEMPLATES["MIT"][0]


@pytest.fixture(scope="module")
def scanned(spark, docs):
    return ls.scan(docs)


def test_scan_keeps_every_row(scanned, rows):
    got = scanned.collect()
    assert len(got) == len(rows) and all(r["license"] is None for r in got)


def test_scan_finds_whole_changed_and_embedded_texts(spark):
    changed = MIT.replace("copies or substantial portions", "all copies or considerable portions").upper()
    inside = "Some words before it. " * 20 + "\n\n" + MIT + "\n\n" + "And words behind. " * 30
    rows = [(1, MIT), (2, changed), (3, inside), (4, "nothing of the kind " * 50), (5, None), (6, "intro\nLicensed under CC BY-SA 4.0.\nmore"), (7, "Licence: see file")]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, "CC-BY-SA-4.0", None]
    assert got[1]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1.0


def test_dice_and_bounds_against_all_templates():
    """Pruning loses no template that reaches the threshold on a whole segment."""
    built = ls.build()
    for text in (MIT, MIT[: len(MIT) * 7 // 10], MIT + " and some further words here" * 4, ls.TEMPLATES["Zlib"][0], "Released under the MIT License."):
        grams = ls.bigrams(ls.normalize(text))
        bag = collections.Counter(grams)
        want = {}
        for name, own, size in zip(built.names, built.bags, built.sizes):
            s = 2 * sum((bag & own).values()) / (len(grams) + size)
            if s >= 0.8:
                want[name] = max(s, want.get(name, 0))
        got = built.best(grams, [i for i, g in enumerate(grams) if g in built.holders])
        assert {k: got[k] for k in want} == pytest.approx(want)


def brute_words(text):
    """Lower-cased runs of letters and digits, joined by single stops, apostrophes or hyphens inside."""
    out, cur = [], ""
    t = text.lower().replace("licence", "license") + "  "
    for i, c in enumerate(t[:-1]):
        if c.isalnum():
            cur += c
        elif cur and c in ".'-" and t[i + 1].isalnum() and cur[-1].isalnum():
            cur += c
        else:
            out += [cur] if cur else []
            cur = ""
    return out


def brute_version_words(ws):
    return {b[:-2] if b.endswith(".0") else b for a, b in zip(ws, ws[1:]) if a in ("version", "v") and b[0].isdigit()}


def brute_agrees(ws, own):
    digits = lambda x: {w for w in x if any(c.isdigit() for c in w)}
    if len(own) <= ls.NOTICE:
        needed = {w for w in own if w not in ("this", "work", "project", "is", "the", "terms", "of", "license")}
        return needed <= set(ws) and digits(ws) == digits(own) and not {w for w in ws if w in ls.FAMILY} - set(own)
    near = all(abs(ws.count(w) - own.count(w)) <= max(ws.count(w), own.count(w)) // 3 for w in ls.FAMILY)
    return near and brute_version_words(ws) <= brute_version_words(own)


def brute_best(text, texts, threshold=0.8):
    """The best (score, name) over all segments, all templates and, in segments too long for one, all windows of its length."""
    segments = {text}
    for paragraph in re.split(r"\n[ \t]*\n", text):
        segments.add(paragraph)
        for line in paragraph.split("\n"):
            segments |= {line, *re.split(r"(?<=[.!?])[ \t\n\v\f\r]+", line)}
    best = (0.0, "")
    for segment in segments:
        ws = brute_words(segment)
        for name, own_texts in texts.items():
            for own in map(brute_words, own_texts):
                n = len(own) - 1
                wins = [ws] if (len(ws) - 1) <= n * (2 - threshold) / threshold + 1e-9 else [ws[a : a + n + 1] for a in range(len(ws) - 1)]
                for win in wins:
                    a, b = collections.Counter(zip(win, win[1:])), collections.Counter(zip(own, own[1:]))
                    if n < 1 or not a:
                        continue
                    s = 2 * sum((a & b).values()) / (sum(a.values()) + n)
                    if s >= threshold - 1e-12 and brute_agrees(win, own):
                        best = max(best, (s, name), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1]]))
    return best if best[1] else None


def test_scan_against_brute_force():
    """No prefilter, no index, no bounds: every template against every segment and window."""
    names = ("MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-4.0", "MPL-2.0")
    texts = {n: [t for t in ls.TEMPLATES[n] if len(t) < 3000][:8] for n in names}
    built = ls.build(texts)
    rng = random.Random(12)
    filler = ["some", "words", "of", "the", "under", "license", "version", "2", "3.0", "gnu", "public", "software", "terms.", "any\n", "released"]
    seen = collections.Counter()
    for case in range(150):
        ws = rng.choice(texts[rng.choice(names)]).split(" ")
        for _ in range(rng.choice((0, 0, 1, 3, 8))):
            k = rng.randrange(len(ws)) if ws else 0
            ws[k : k + 1] = rng.choice(([], [rng.choice(filler)], [*ws[k : k + 1], rng.choice(filler)]))
        around = lambda: " ".join(rng.choice(filler) for _ in range(rng.choice((0, 0, 5, 30))))
        text = rng.choice((" ", "\n", "\n\n")).join((around(), " ".join(ws), around()))
        want = brute_best(text, texts)
        got = ls.scan_text(text, built)
        if want is None:
            assert got == {}, (text, got)
        else:
            top = min(got.items(), key=lambda x: (-round(x[1], 12), x[0]))
            assert top[0] == want[1] and top[1] == pytest.approx(want[0]), (text, want, got)
        seen[want is None] += 1
    assert min(seen.values()) > 10


def test_ties_go_to_the_first_name():
    built = ls.build({"b": ["Given under rules of the house"], "a": ["Given under rules of the house"], "c": ["Other words altogether here now"]})
    assert ls.scan_text("given under rules of the house", built) == {"a": 1.0}
    assert ls.scan_text("", built) == {}


def test_versions_and_families_decide():
    built = ls.build()
    for text in ("Released under the Apache License, Version 1.1.", "licensed under the CC BY 3.0", "Licensed under CC BY-NC 2.0.", "distributed under the GNU Library General Public License, version 9"):
        assert ls.scan_text(text, built) == {}, text
    for text, name in (("Distributed under the MIT license.", "MIT"), ("Available under the terms of the CC BY 4.0.", "CC-BY-4.0"), ("This project is licensed under the GPL 2.0.", "GPL-2.0"), ("Licensed under GNU Lesser General Public License, version 3.", "LGPL-3.0")):
        assert ls.scan_text(text, built) == {name: 1.0}, text
    for name, other in (("GPL-2.0", "3"), ("GPL-3.0", "2"), ("AGPL-3.0", "1")):
        notice = ls.TEMPLATES[name][0]
        assert name in ls.scan_text(notice, built) and name not in ls.scan_text(notice.replace(f"version {name[-3]}", f"version {other}"), built)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="a system without licence files")
def test_licence_files_of_the_system_are_named_rightly():
    built = ls.build()
    right = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "GFDL": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    for f in os.listdir("/usr/share/common-licenses"):
        with open(f"/usr/share/common-licenses/{f}", encoding="utf-8") as text:
            whole = text.read()
        assert set(ls.scan_text(whole, built)) <= {right.get(f, f)}, f
        # With its middle gone a text is another one, or still this one.
        assert set(ls.scan_text(whole[: len(whole) // 3] + whole[len(whole) * 2 // 3 :], built)) <= {right.get(f, f)}, f


def test_scan_empty(empty):
    assert ls.scan(empty).collect() == []


SPACE = " \t\n\v\f\r"


def brute_cut(t):
    """(start, end) of sentences, character by character."""
    out, start, i = [], 0, 0
    while i < len(t):
        j = i
        if t[i] in "\r\n":
            while j < len(t) and t[j] in "\r\n":
                j += 1
        elif t[i] in SPACE and i and t[i - 1] in ".!?":
            while j < len(t) and t[j] in SPACE:
                j += 1
        if j > i:
            out.append((start, i))
            start = i = j
        else:
            i += 1
    return [(a, b) for a, b in [*out, (start, len(t))] if t[a:b].strip()]


def brute_norm(s):
    for c in SPACE:
        s = s.replace(c, " ")
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    return tuple(x for w in s.split(" ") if (x := w.strip(".,;:!?\"'()[]")))


def text_hash(t):
    h = xxhash.xxh64_intdigest(t.encode())
    return h - (1 << 64) if h >> 63 else h


def brute_dedup(rows, most=3, words=40):
    """(id, n_sentences, n_removed, kept text, ids of first places) of each row, spans compared as lists of words."""
    docs = {}
    for i, t in rows:
        t = t or ""
        cuts = brute_cut(t)
        norm = [(k, w) for k, (a, b) in enumerate(cuts) if (w := brute_norm(t[a:b]))]
        found = []
        for x in range(len(norm)):
            for y in range(x + 2, len(norm) + 1):
                run = [w for _, w in norm[x:y]]
                if len(run) == most or sum(map(len, run)) >= words or (x == 0 and y == len(norm)):
                    found.append((norm[x][0], norm[y - 1][0] + 1, tuple(run)))
                    break
        docs[i, t] = (cuts, found)
    places = collections.defaultdict(list)
    for (i, t), (_, found) in docs.items():
        for a, b, run in found:
            places[run].append((i is not None, i or 0, text_hash(t), a, i))
    first = {run: min(p) for run, p in places.items()}
    out = []
    for i, t in rows:
        t = t or ""
        cuts, found = docs[i, t]
        gone, ids = set(), set()
        for a, b, run in found:
            if first[run][:4] != (i is not None, i or 0, text_hash(t), a):
                gone |= set(range(a, b))
                ids.add(first[run][4])
        drop = set()
        for k in gone:
            drop |= set(range(cuts[k][0], cuts[k + 1][0] if k + 1 < len(cuts) else len(t)))
        out.append((str(i), len(cuts), len(gone), "".join(c for n, c in enumerate(t) if n not in drop), str(sorted(ids, key=lambda x: (x is not None, x)))))
    return sorted(out)


def found_by(df, **params):
    return sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"], r["kept_text"], str(list(r["first_in"]))) for r in ss.dedup(df, **params).collect())


def test_spans_against_brute_force(spark):
    s = [f"This is sentence number {k} with some words of its own kind" for k in range(30)]
    para = ". ".join(s[:4]) + "."
    long = " ".join(f"word{k}" for k in range(45)) + "."
    rows = [(1, para + " " + s[10] + "."), (2, s[11] + ". " + para), (3, ". ".join(s[12:20]) + "."), (4, para + "\n" + para), (5, None), (6, ""), (8, ". ".join(s[1:4]).upper() + ".")]
    rows += [(9, s[20] + ". " + s[1] + ". " + s[2] + ". " + s[21] + "."), (10, long), (11, long), (12, long + " Short one."), (13, "short one!\n" + long), (14, long + " Short one. More of it here."), (15, "Yes. No. Maybe."), (16, "yes, no. Yes! NO?\nmaybe"), (17, "A b. C d."), (18, "a B!\n c D")]
    # One id with two texts, copies of a row, null ids, and a text that repeats itself.
    rows += [(20, para + " One more."), (20, "Other begin. " + para), (20, para + " One more."), (None, para), (None, para), (None, para + " x"), (21, "Again and again. " * 9), (22, "x\u3000y. \u3000 . z?  \r\n\x0b q. ... --- . w.")]
    got = found_by(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == brute_dedup(rows)
    by = {r[0]: r for r in got}
    assert by["10"][2] == by["11"][2] == 0 and by["18"][3] == "" and by["16"][2] == 3 and by["1"][2] == 4
    assert found_by(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=200, most=2) == brute_dedup(rows, most=2)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "B", "c.", "d!", "e\n", "f,", "é", "...", "\t", "g?"]
    rows = [(rng.randrange(40), " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_by(df, words=6) == brute_dedup(rows, words=6)
    named = [(f"k{i}", t) for i, t in rows]
    got = {r["doc_id"]: 0 for r in ss.dedup(spark.createDataFrame(named, "doc_id string, text string")).collect()}
    assert set(got) == {k for k, _ in named}


def test_few_buckets_are_enough(spark):
    rows = [(k, f"Sentence {k % 7} here. Then another {k % 3}. And a third one. ") for k in range(60)]
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert found_by(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), chunk_bytes=100) == brute_dedup(rows)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_sentences_keep_rows_and_ids(docs, rows):
    got = ss.dedup(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (0, 12, 13)}
    assert by[0]["n_removed"] == 0


def test_sentences_empty(empty):
    assert ss.dedup(empty).collect() == []


def test_spans_of_short_sentences(spark):
    """Runs of sentences of one to three words are compared as well; lines without words stay cheap."""
    short = "\n".join(f"Item {k}." if k % 3 else f"Stop{k}!" for k in range(60))
    rows = [(1, short), (2, "Other words stand before this list of things here.\n" + short), (3, short), (6, "...\n" * 50_000 + "One. Two."), (7, "A b. " * 3 + "...\n" * 50_000)]
    got = {r["doc_id"]: r for r in ss.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 60 and got[3]["kept_text"] == ""
    assert got[2]["kept_text"] == "Other words stand before this list of things here.\n"
    assert all(got[k]["n_removed"] == 0 for k in (6, 7))


def test_scan_finds_all_licenses_of_a_notice():
    built = ls.build()
    long = {n: ls.TEMPLATES[n][0] for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0")}
    for a in long:
        for b in long:
            if a != b:
                got = ls.scan_text(f"{long[a]}\n\n{long[b]}\n", built)
                assert {a, b} <= set(got) and got[a] >= 0.8 and got[b] >= 0.8, (a, b, got)
    assert {"MIT", "ISC", "Zlib", "Apache-2.0"} <= set(ls.scan_text("\n\n".join(["Third parties.", *long.values()]), built))
    assert all(set(ls.scan_text(t, built)) == {n} for n, own in long.items() for t in (own, f"{own}\n\n{own}"))


def test_copyright_notice_keeps_the_rest_of_its_line():
    built = ls.build()
    flat = " ".join(MIT.split())
    for head in ("Copyright 2024 X. ", "Copyright (c) 2019-2024 Some Holder, Inc. All rights reserved. ", "© 2024 J. Doe and others ", "Copyright 2024 X, "):
        assert ls.scan_text(head + flat, built).get("MIT", 0) > 0.9, head
    assert ls.scan_text("Copyright 2024 X, released under the MIT License.", built) == {"MIT": 1.0}
    for notice in ("Copyright (c) 2024 The Regents of the University of California. All rights reserved.", "(c) 1999, 2001 J. Doe <j@doe.org>, Acme Ltd. and contributors", "Copyright 2024 X", "© 2024 A. B. Holder."):
        assert ls.normalize(f"{notice}\nGiven freely") == ["given", "freely"], notice
    assert ls.normalize("the above\ncopyright notice shall") == ["the", "above", "copyright", "notice", "shall"]
