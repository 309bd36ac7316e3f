"""Cleaned words of lower-cased texts, for Arrow functions: each different piece between white space is cleaned once.

Every step of the cleaning looks at a piece alone: abbreviations and dropped characters never reach over white space.
What is a letter, a number or white space is asked from the JVM's regular expressions, so both ways of cleaning agree.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext

#: Pieces whose words are remembered in a process; beyond that it begins anew.
HELD_PIECES = 500_000
#: Words that are Python objects at one time.
FLUSH = 200_000
#: Words whose runs are counted at one time, and rows of counts that leave at one time.
CHUNK, ROWS = 2_000_000, 200_000


@lru_cache(maxsize=None)
def char_class(drop: str) -> str:
    """Ranges, as inside brackets, of the characters that the JVM's pattern ``drop`` does not match."""
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    left = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(drop).matcher(text).replaceAll("")
    ranges: list[list[int]] = []
    for c in map(ord, left):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=None)
def odd_spaces(space: str) -> str:
    """The characters that only one of ``str.split`` and the class ``space`` takes for white space."""
    match = re.compile(f"[{space}]").match
    return "".join(c for c in map(chr, range(0x110000)) if c.isspace() and not match(c)) + "".join(c for c in _members(space) if not c.isspace())


def _members(ranges: str) -> str:
    return "".join(chr(c) for a, b in re.findall(r"\\U(.{8})-\\U(.{8})", ranges) for c in range(int(a, 16), int(b, 16) + 1))


class Chars(dict):
    """A table for ``str.translate`` that asks ``value`` once for each character."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, code: int):
        self[code] = v = self.value(chr(code))
        return v


class Words(dict):
    """The words of each piece; ``rules`` is (table or None, word class, kept class or None, dropped characters, stop words, space class, odd spaces)."""

    def __init__(self, rules: tuple):
        super().__init__()
        table, word, kept, dropped, stop, space, odd = rules
        self.plain = {k: v for k, v in table or () if k.isalnum()}
        self.spanning = [(k, re.compile(rf"(?<![{word}]){re.escape(k)}(?![{word}])"), v) for k, v in table or () if not k.isalnum()]
        self.runs = re.compile(f"[{word}]+")
        in_word, in_kept = re.compile(f"[{word}]").match, re.compile(f"[{kept}]").match if kept is not None else bool
        self.apart = Chars(lambda c: c if in_word(c) else " ")
        self.left = Chars(lambda c: c if in_kept(c) and c not in dropped else None)
        self.stop = frozenset(stop)
        self.space = re.compile(f"[{space}]+")
        self.odd = re.compile(f"[{re.escape(odd)}]") if odd else None
        # The same for bytes, which ASCII pieces are.
        self.raw_plain = frozenset(k.encode() for k in self.plain)
        self.raw_apart = bytes(c if c > 127 or in_word(chr(c)) else 32 for c in range(256))
        self.raw_gone = bytes(c for c in range(128) if self.left[c] is None)

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if piece.isascii() and not any(k in piece for k, _, _ in self.spanning):
            raw = piece.encode()
            if self.raw_plain.isdisjoint(raw.translate(self.raw_apart).split()):  # nothing to replace
                text = raw.translate(None, self.raw_gone).decode()
                self[piece] = words = (text,) if len(text) > 1 and text not in self.stop else ()
                return words
        text = piece
        for k, pattern, v in self.spanning:
            if k in text:
                text = pattern.sub(lambda m, v=v: v, text)
        if self.plain and not self.plain.keys().isdisjoint(text.translate(self.apart).split(" ")):
            text = self.runs.sub(lambda m: self.plain.get(m[0], m[0]), text)
        text = text.translate(self.left)
        words = tuple(w for w in (text.split(" ") if " " in text else (text,)) if (len(w) > 1 or w > "\x7f") and w not in self.stop)
        self[piece] = words
        return words

    def pieces(self, text: str) -> list[str]:
        return list(filter(None, self.space.split(text))) if self.odd and self.odd.search(text) else text.split()

    def of(self, text: str) -> chain:
        if len(self) > HELD_PIECES:
            self.clear()
        return chain.from_iterable(map(self.__getitem__, self.pieces(text)))


class Sizes(Words):
    """Of each piece the number of its words, and ``KEY`` for each that is a keyword."""

    KEY = 1 << 32

    def __init__(self, rules: tuple, keywords: tuple):
        super().__init__(rules)
        self.keywords = frozenset(keywords)

    def __missing__(self, piece: str) -> int:
        found = super().__missing__(piece)
        self[piece] = size = len(found) + self.KEY * sum(w in self.keywords for w in found)
        return size


class Ids(Words):
    """The words of each piece as numbers, their places in ``known``."""

    def __init__(self, rules: tuple):
        super().__init__(rules)
        self.known: dict[str, int] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = super().__missing__(piece)
        self[piece] = ids = tuple(self.known.setdefault(w, len(self.known)) for w in found)
        return ids

    def renew(self) -> None:
        if len(self) > HELD_PIECES:
            self.clear()
            self.known.clear()


def words(rules: tuple, kind: type = Words, *more) -> Words:
    """``kind(rules, *more)``, made once in each Python worker, although this function comes to it by value."""
    held = sys.modules.setdefault("tessera_words", types.ModuleType("tessera_words")).__dict__
    key = (kind.__name__, rules, *more)
    if key not in held:
        held[key] = kind(rules, *more)
    return held[key]


def word_lists(texts: pa.Array, rules: tuple) -> pa.Array:
    """A list of words for each text, null for null."""
    held, parts, flat, done, ends = words(rules), [], [], 0, [0]
    for t in texts:
        if t.is_valid:
            flat.extend(held.of(t.as_py()))
        ends.append(done + len(flat))
        if len(flat) >= FLUSH:
            parts.append(pa.array(flat, pa.string()))
            done, flat = done + len(flat), []
    parts.append(pa.array(flat, pa.string()))
    values = pa.concat_arrays(parts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=texts.is_null())


def text_sizes(texts: pa.Array, rules: tuple, keywords: tuple) -> pa.Array:
    """Numbers of words, keywords, pieces and sentences of each text, and the bytes of its white space; null for null."""
    held = words(rules, Sizes, keywords)
    rows = np.zeros((5, len(texts)), np.int64)
    for i, t in enumerate(texts):
        if not t.is_valid:
            continue
        text = t.as_py()
        if len(held) > HELD_PIECES:
            held.clear()
        pieces = held.pieces(text)
        keys, n = divmod(sum(map(held.__getitem__, pieces)), held.KEY)
        bare = "".join(pieces)
        space = len(text) - len(bare) if text.isascii() else len(text.encode()) - len(bare.encode())
        rows[:, i] = n, keys, len(pieces), text.count(".") + 1, space
    return pa.StructArray.from_arrays([pa.array(r) for r in rows], names=["tokens", "keywords", "words", "sentences", "space"], mask=texts.is_null())


def run_counts(batches: Iterable[pa.RecordBatch], rules: tuple, n: int) -> Iterator[pa.RecordBatch]:
    """(gram, n): the runs of ``n`` words of the texts in the first column, counted over chunks of texts."""
    held = words(rules, Ids)
    parts, ends, done = [], [0], 0
    for b in batches:
        for t in b.column(0):
            if t.is_valid:
                parts.append(np.fromiter(chain.from_iterable(map(held.__getitem__, held.pieces(t.as_py()))), np.int64))
                done += len(parts[-1])
                ends.append(done)
            if done >= CHUNK:
                yield from _counted(parts, ends, held, n)
                parts, ends, done = [], [0], 0
    yield from _counted(parts, ends, held, n)


def _counted(parts: list[np.ndarray], ends: list[int], held: Ids, n: int) -> Iterator[pa.RecordBatch]:
    ids = np.concatenate([*parts, np.zeros(0, np.int64)])
    text = np.repeat(np.arange(len(parts)), np.diff(ends))
    starts = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(ids) >= n else np.zeros(0, np.int64)
    code, levels = ids[starts], []
    for k in range(1, n):
        if k > 1:  # so that a number and a word fit into 64 bits again
            before, code = np.unique(code, return_inverse=True)
            levels.append(before)
        code = code << 32 | ids[starts + k]
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    times = np.diff(first, append=len(code))
    names = pa.array(list(held.known), pa.string())
    for i in range(0, len(first), ROWS):
        left, columns = code[first[i : i + ROWS]], []
        for before in [None, *levels[::-1]][: n - 1]:
            left = left if before is None else before[left]
            columns.append(left & 0xFFFFFFFF)
            left = left >> 32
        grams = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in (left, *columns[::-1])), " ")
        yield pa.RecordBatch.from_arrays([grams, pa.array(times[i : i + ROWS])], names=["gram", "n"])
    held.renew()
