"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased, copyright notices at the begin of a line (sign, years and holder, up to a sentence end, a word
that begins a grant, or HOLDER_WORDS words) and punctuation are dropped, and what is left is words. A text is
compared as a whole, by paragraph, by line and by sentence, each a segment; the score of a segment and a
template is 2 * |A n B| / (|A| + |B|) over bigrams with repeats. As the common part is at most the smaller side,
a score of t needs |A| between |B| * t / (2 - t) and |B| * (2 - t) / t: templates outside these size bounds
are pruned, and of the others only those that share a bigram with the segment are compared. A segment that
holds more than a licence is also searched by windows of each template's own length around shared bigrams. The
best licence of a segment is cut out where it stands, and what is left before, between and behind is searched again.

Wordings of two versions of a licence, or of two of a family, may be alike beyond the threshold. So numbers and
family names decide: a notice of at most NOTICE words must have the template's numbers and no others; in a longer
text every number behind "version" must be one of the template's, and each family name stand about as often. Of
the other words of a notice only the fixed FILLER may be missing, so that a line that merely mentions a licence, or
grants one of another name, is none.

Defined results: null and empty texts match nothing; equal scores go to the template that comes first by
name; repeated rows are scanned one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, opened, ship
from .license_texts import TEMPLATES

THRESHOLD = 0.8

#: Words of a copyright notice that are dropped at most; what stands behind them on the line is compared.
HOLDER_WORDS = 16
# A grant begins with one of these words; a sentence ends at a stop that is not that of an initial or of a company's form.
_GRANT = r"(?:permission|permitted|redistribution|redistributed|distributed|licen[sc]ed?|under|released|available|published|provided|this|these|the[ \t]+(?:software|above)|use|unless|you|see)\b"
_GOES_ON = r"(?:[^\s]*[^\s.!?]|[^\W\d_]\.|(?:inc|ltd|co|corp|llc|jr|sr|al|dr|st|etc|no)\.)(?=\s|$)"
_COPYRIGHT = re.compile(
    r"(?im)^[ \t]*+(?:copyright(?![ \t]++(?:notices?|holders?|owners?)\b)|\(c\)|©)"
    rf"(?:[^\s]*+(?:[ \t]++(?![^\w\s]{{0,3}}{_GRANT}){_GOES_ON}){{0,{HOLDER_WORDS}}}(?:[ \t]++(?![^\w\s]{{0,3}}{_GRANT})[^\s]+[.!?](?=\s|$))?)"
    r"(?:[ \t]*+all[ \t]++rights[ \t]++reserved\b\.?)?"
)
#: Words of a template up to which it is a one-line notice.
NOTICE = 20
#: Fixed words that tell the licences of one family apart.
FAMILY = ("affero", "documentation", "lesser", "library", "noderivatives", "noncommercial", "sharealike")
FILLER = frozenset(("this", "work", "project", "is", "the", "terms", "of", "license"))
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_CUT = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")


def normalize(text: str) -> list[str]:
    return _WORD.findall(_COPYRIGHT.sub(" ", text).lower().replace("licence", "license"))


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def numbers(words: list[str]) -> frozenset[str]:
    return frozenset(w for w in words if any(c.isdigit() for c in w))


def versions(words: list[str]) -> frozenset[str]:
    """The numbers behind the word version, those of one zero and none being one: 2.0 is 2."""
    return frozenset(re.sub(r"\.0$", "", b) for a, b in zip(words, words[1:]) if a in ("version", "v") and b[0].isdigit())


class Templates:
    """Templates with their bigram counts, an index from bigram to templates, and the size bounds."""

    def __init__(self, texts: dict[str, list[str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        made = []
        for name in sorted(texts):
            for t in texts[name]:
                words = normalize(t)
                if bag := bigrams(words):
                    made.append((name, Counter(bag), len(bag), words))
        self.names, self.bags, self.sizes = ([m[k] for m in made] for k in range(3))
        self.notice = [len(m[3]) <= NOTICE for m in made]
        self.numbers = [numbers(m[3]) if n else versions(m[3]) for m, n in zip(made, self.notice)]
        self.needed = [frozenset(m[3]) - FILLER for m in made]
        self.family = [Counter(w for w in m[3] if w in FAMILY) for m in made]
        self.least = [math.ceil(n * threshold / (2 - threshold) - 1e-9) for n in self.sizes]
        self.most = [math.floor(n * (2 - threshold) / threshold + 1e-9) for n in self.sizes]
        # Templates of a bigram by falling need of size: a small segment meets those for small texts only.
        self.holders: dict[tuple, list[int]] = defaultdict(list)
        for k in sorted(range(len(made)), key=lambda k: self.least[k]):
            for g in self.bags[k]:
                self.holders[g].append(k)

    def agrees(self, grams: list[tuple[str, str]], k: int) -> bool:
        """Whether the numbers and family names of a range of bigrams are those of template ``k``."""
        if not grams:
            return False
        words = [a for a, _ in grams] + [grams[-1][1]]
        if self.notice[k]:
            return self.needed[k].issubset(words) and numbers(words) == self.numbers[k] and all(w in self.family[k] for w in words if w in FAMILY)
        own = Counter(w for w in words if w in FAMILY)
        return versions(words) <= self.numbers[k] and all(abs(own[w] - self.family[k][w]) <= max(own[w], self.family[k][w]) // 3 for w in FAMILY)

    def dice(self, bag: Counter, size: int, k: int) -> float:
        own = self.bags[k]
        small, other = (bag, own) if len(bag) < len(own) else (own, bag)
        return 2 * sum(min(n, other[g]) for g, n in small.items() if g in other) / (size + self.sizes[k])

    def best(self, grams: list[tuple[str, str]], shared: list[int]) -> dict[str, float]:
        """Scores from the threshold up by template name for one segment; ``shared`` are places of known bigrams."""
        out: dict[str, float] = {}
        if not shared:
            return out
        size, whole = len(grams), None
        near: Counter = Counter()
        for i in shared:
            for k in self.holders[grams[i]]:
                if self.least[k] > size:
                    break
                near[k] += 1
        words = {w for g in (grams[0], *grams) for w in g}
        for k, common in near.items():
            if common < self.sizes[k] * self.threshold / 2 or (self.notice[k] and not self.needed[k] <= words):
                continue  # too few shared places for the threshold, or a notice without its words
            if size <= self.most[k]:
                whole = whole or Counter(grams)
                s = self.dice(whole, size, k)
                if s < self.threshold - 1e-12 or not self.agrees(grams, k):
                    continue
            else:
                s = self._window(grams, [i for i in shared if k in self._of(grams[i])], k)
            if s >= self.threshold - 1e-12:
                out[self.names[k]] = max(s, out.get(self.names[k], 0.0))
        return out

    def _of(self, gram: tuple[str, str]) -> frozenset[int]:
        """The templates of a bigram, for membership."""
        held = self.__dict__.setdefault("_sets", {})
        if gram not in held:
            held[gram] = frozenset(self.holders.get(gram, ()))
        return held[gram]

    def _window(self, grams: list[tuple[str, str]], places: list[int], k: int) -> float:
        """Best score of the windows of the template's length that begin at a shared bigram and agree with it."""
        scores = self._windows(grams, places, k)
        for s, start in sorted(((s, p) for s, p in zip(scores, places) if s >= self.threshold - 1e-12), key=lambda x: (-x[0], x[1])):
            if self.agrees(grams[start : start + self.sizes[k]], k):
                return s
        return 0.0

    def _windows(self, grams: list[tuple[str, str]], places: list[int], k: int) -> list[float]:
        """The score of each window of the template's length that begins at one of ``places``, the shared bigrams."""
        n, own, out = self.sizes[k], self.bags[k], []
        bag: Counter = Counter()
        common = hi = 0
        for lo, start in enumerate(places):  # two pointers over the shared places
            while hi < len(places) and places[hi] < start + n:
                g = grams[places[hi]]
                bag[g] += 1
                common += bag[g] <= own[g]
                hi += 1
            out.append(2 * common / (min(n, len(grams) - start) + n))
            g = grams[start]
            common -= bag[g] <= own[g]
            bag[g] -= 1
        return out

    def stands(self, grams: list[tuple[str, str]], shared: list[int], names: set[str], name: str) -> list[tuple[int, int]]:
        """Where the licence ``name`` of the ``names`` that ``best`` has found stands: disjoint ranges of bigrams, rising.

        These are its windows from the threshold up where no other of the ``names`` scores higher, each to the end that
        scores highest, so that common words of a text behind it are left to that. If there is none, it is the range from
        the first to the last shared bigram.
        """
        found = []
        for k in (k for k, own in enumerate(self.names) if own in names):
            if len(places := [i for i in shared if k in self._of(grams[i])]) >= self.sizes[k] * self.threshold / 2:
                found += [(-s, places[j], k, j, places) for j, s in enumerate(self._windows(grams, places, k)) if s >= self.threshold - 1e-12 and self.agrees(grams[places[j] : places[j] + self.sizes[k]], k)]
        taken, out = bytearray(len(grams)), []
        for _, start, k, j, places in sorted(found, key=lambda x: x[:3]):
            limit = min(start + self.sizes[k], len(grams))
            if taken[start] or taken[limit - 1] or 1 in taken[start:limit]:
                continue
            bag: Counter = Counter()
            common, top, end = 0, 0.0, start + 1
            while j < len(places) and places[j] < limit:
                g = grams[places[j]]
                bag[g] += 1
                common += bag[g] <= self.bags[k][g]
                if (s := 2 * common / (places[j] + 1 - start + self.sizes[k])) >= top:
                    top, end = s, places[j] + 1
                j += 1
            taken[start:end] = b"\1" * (end - start)
            if self.names[k] == name:
                out.append((start, end))
        return sorted(out) or [(shared[0], shared[-1] + 1)]

    def all(self, grams: list[tuple[str, str]]) -> dict[str, float]:
        """The best score of each licence of one segment that is left when the better-scored ones are cut out."""
        out: dict[str, float] = {}
        todo = [(0, len(grams), frozenset())]
        while todo:
            lo, hi, before = todo.pop()
            part = grams[lo:hi]
            shared = [i for i, g in enumerate(part) if g in self.holders]
            # A licence that was cut out is not looked for again, so there are at most as many levels as licences.
            scores = {n: s for n, s in self.best(part, shared).items() if n not in before}
            if scores:
                name, s = min(scores.items(), key=lambda x: (-x[1], x[0]))
                out[name] = max(s, out.get(name, 0.0))
                edges = [0, *(x for ab in self.stands(part, shared, set(scores), name) for x in ab), hi - lo]
                todo += [(lo + a, lo + b, before | {name}) for a, b in zip(edges[::2], edges[1::2]) if a < b]
        return out


def scan_text(text: str, templates: Templates) -> dict[str, float]:
    """Best score of each licence in a segment of ``text``, apart from those that stand where a better-scored one does."""
    found: dict[str, float] = {}
    low = text.lower().replace("licence", "license")
    if not any(w in low for w in templates.rare) and not (len(low) >= templates.long and any(w in low for w in templates.rare_long)):
        return found
    segments, seen = [text], set()
    for paragraph in re.split(r"\n[ \t]*\n", text):
        segments.append(paragraph)
        for line in paragraph.split("\n"):
            segments += [line, *_CUT.split(line)]
    for segment in segments:
        if segment in seen:
            continue
        seen.add(segment)
        for name, s in templates.all(bigrams(normalize(segment))).items():
            found[name] = max(s, found.get(name, 0.0))
    return found


#: Bigrams from which a template is long: only texts that are long enough are searched for its words.
_LONG = 600


def build(texts: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> Templates:
    out = Templates(texts or TEMPLATES, threshold)
    short, long = ([k for k, n in enumerate(out.sizes) if (n >= _LONG) == big] for big in (False, True))
    out.rare, out.rare_long = _cover(out, short), _cover(out, long)
    # A bigram takes two characters at least: a letter and what parts it from the next.
    out.long = 2 * min((out.least[k] for k in long), default=0)
    return out


def _cover(templates: Templates, which: list[int]) -> list[str]:
    """Words such that every match with a template of ``which`` has one of them: texts without any are not cut into segments.

    To score t, a segment shares at least half of t times the template's bigrams; if the template's bigrams
    without a set of words number fewer than that, one bigram with a word of the set is shared.
    """
    chosen: list[str] = []
    for bag, size in sorted(((templates.bags[k], templates.sizes[k]) for k in which), key=lambda x: x[1]):
        need = size * templates.threshold / (2 - templates.threshold) * (1 - 1e-9)
        need = max(need * templates.threshold / 2 + size * templates.threshold / 2, 1)
        left = Counter({g: n for g, n in bag.items() if not any(w in x for w in chosen for x in g)})
        while sum(left.values()) >= need:
            weight = Counter()
            for g, n in left.items():
                for w in set(g):
                    weight[w] += n * max(len(w) - 3, 1e-3)  # long words are rarer in other texts
            word = max(weight, key=lambda w: (weight[w], w))
            chosen.append(word)
            left = Counter({g: n for g, n in left.items() if word not in g[0] and word not in g[1]})
    return chosen


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: key, license (best, or null), score, licenses (all, by name), scores."""
    held = ship(docs.sparkSession, build(texts, threshold))
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def make():
        own = opened(held)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, score, names, scores = [], [], [], []
            for t in batch.column(1):
                found = sorted(scan_text(t.as_py(), own).items())
                top = max(found, key=lambda x: x[1], default=(None, None))
                best.append(top[0])
                score.append(top[1])
                names.append([n for n, _ in found])
                scores.append([s for _, s in found])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64()))], names=["k", "license", "score", "licenses", "scores"])

        return work

    return map_rows(slim, f"k {kind}, license string, score double, licenses array<string>, scores array<double>", make).withColumnRenamed("k", key)


def op1_license_dice(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
