"""Document quality rules as a short-circuit cascade (native DataFrame expressions only).

``measure`` adds the word, symbol, line and repetition counts of each text. ``plan_cascade`` estimates, on a
random sample of the whole table, what share of documents each rule rejects and what it costs, and orders the rules by
rejections per cost; ``verdict`` is the nested CASE of that order, so a rejected document never pays for
the rules behind. The order changes only the cost: a document is kept if no rule rejects it.

Defined results: null and blank texts have no words and every count 0; an empty table gives an empty
result; repeated rows are judged one by one. Where a column of the input has the name of a measure or verdict,
``measure`` and ``judge`` put theirs in its place, and ``keep_passing`` keeps the input's.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: Rows, on average, on which the cascade's order is estimated, drawn from the whole table; it never changes a verdict.
SAMPLE_ROWS = 400
#: Passes over the sample for each rule; the fastest is its cost.
_TIMES = 3
_SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a window's place in a packed sort key; texts of more words take the exact path over strings.
_PLACE_BITS = 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the text column to a condition that is true for documents to reject."""

    name: str
    rejects: "callable" = field(compare=False)


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _n_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def _count_of(text: Column, drop: str) -> Column:
    """Code points of ``text`` that stay after ``drop`` is taken out."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _count_of(text, r"[^#*$%&|<>]+")


#: Thresholds leave a wide margin to ordinary prose, where each of these shares is near zero.
RULES: tuple[Rule, ...] = (
    Rule("symbol_share", lambda t: n_symbols(t) * 5 > _n_words(t)),
    Rule("shouting", lambda t: _count_of(t, "[^A-Z]+") > _count_of(t, "[^a-z]+")),
    Rule("exclamations", lambda t: _count_of(t, "[^!]+") * 10 > _n_words(t) * 3),
    Rule("repeated_lines", lambda t: n_dup_lines(t) * 10 > F.size(F.filter(F.split(t, "\n"), _has_word)) * 6),
    Rule("word_length", lambda t: (F.length(F.regexp_replace(t, _SPACE, "")) > _n_words(t) * 20) | (F.length(F.regexp_replace(t, _SPACE, "")) < _n_words(t) * 2)),
)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), _has_word)
    return F.transform(F.array(lines), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))[0].cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Places covered by runs of ``width`` places from ascending ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(s - a["last"], F.lit(width))).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )


def _repeat_words_exact(words: Column, width: int) -> Column:
    """The same count from sorted (window text, place) pairs: slower, exact whatever the hashes do."""
    pairs = F.sort_array(
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(F.slice(words, i + 1, width).alias("w"), i.cast("long").alias("i")))
    )
    twice = F.transform(
        F.array(pairs),
        lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["w"] == x["w"]) | (F.get(p, k + 1)["w"] == x["w"])),
    )[0]
    return _covered(F.sort_array(F.transform(twice, lambda x: x["i"])), width)


def with_repeat_words(df: DataFrame, words: str, out: str, width: int = 3) -> DataFrame:
    """Add the number of words in ``width``-word windows that occur twice or more in their text, the first included.

    Windows are sorted inside the row as one long each, hash above place, so nothing is exploded or shuffled.
    Neighbours of equal hash are compared by their words; if ever two different windows share a hash, or the
    text has too many words to pack, that row is counted from the window texts themselves.
    """
    w = F.col(words)
    packed, twice = fresh_name(df, "packed"), fresh_name(df, "twice")
    mask = (1 << _PLACE_BITS) - 1
    # The sort key stays non-negative: 43 bits of hash over 20 bits of place.
    key = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + d) for d in range(width)]), 1 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(i.cast("long"))
    df = df.withColumn(
        packed,
        F.when((F.size(w) >= 2 * 1 + width - 1) & (F.size(w) <= mask), F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), key))).otherwise(F.expr("CAST(array() AS array<bigint>)")),
    )
    p = F.col(packed)
    df = df.withColumn(
        twice,
        F.filter(p, lambda x, k: (F.shiftright(F.get(p, k - 1), _PLACE_BITS) == F.shiftright(x, _PLACE_BITS)) | (F.shiftright(F.get(p, k + 1), _PLACE_BITS) == F.shiftright(x, _PLACE_BITS))),
    )
    t = F.col(twice)
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    differs = lambda x, y: F.lit(False) if width == 0 else ~_all_equal(w, place(x), place(y), width)
    clash = F.exists(
        F.transform(t, lambda x, k: F.struct(F.get(t, k - 1).alias("a"), x.alias("b"))),
        lambda ab: ab["a"].isNotNull() & (F.shiftright(ab["a"], _PLACE_BITS) == F.shiftright(ab["b"], _PLACE_BITS)) & differs(ab["a"], ab["b"]),
    )
    counted = (
        F.when((F.size(w) > mask) | ((F.size(t) > 0) & clash), _repeat_words_exact(w, width))
        .when(F.size(t) > 0, _covered(F.sort_array(F.transform(t, lambda x: place(x).cast("long"))), width))
        .otherwise(F.lit(0).cast("long"))
    )
    return df.withColumn(out, counted).drop(packed, twice)


def _all_equal(words: Column, i: Column, j: Column, width: int) -> Column:
    same = F.get(words, i) == F.get(words, j)
    for d in range(1, width):
        same = same & (F.get(words, i + d) == F.get(words, j + d))
    return same


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), in the place of columns so named."""
    body, words = fresh_name(df, "body"), fresh_name(df, "words")
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, split_words(F.col(body)))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace(body, _SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", n_symbols(F.col(body))).withColumn("n_dup_lines", n_dup_lines(F.col(body)))
    return with_repeat_words(df, words, "n_repeat_words").drop(body, words)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in the order of rejections per second on about ``sample_rows`` rows, with the figures found.

    Every row is drawn with the same probability, so a table that is sorted by source misleads no estimate. Cost
    is the wall time of a pass that evaluates the rule alone, the fastest of a few, above that of a pass that
    only reads the sample.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = (sample if share == 1.0 else sample.sample(share, seed=11)).coalesce(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        rates = sample.agg(F.count("*").alias("n"), *[F.sum(r.rejects(F.col("t")).cast("long")).alias(f"r{i}") for i, r in enumerate(rules)]).first()

        def seconds(col: Column) -> float:
            taken = []
            for _ in range(_TIMES):
                began = time.perf_counter()
                sample.agg(F.sum(col.cast("long"))).collect()
                taken.append(time.perf_counter() - began)
            return min(taken)

        floor = seconds(F.length("t") > 0)
        found = [
            {"rule": r, "rejects": (rates[f"r{i}"] or 0) / max(1, rates["n"]), "seconds": max(1e-4, seconds(r.rejects(F.col("t"))) - floor)}
            for i, r in enumerate(rules)
        ]
    finally:
        sample.unpersist()
    return sorted(found, key=lambda f: -f["rejects"] / f["seconds"])


def verdict(text: Column, rules: list[Rule]) -> Column:
    """True if none of ``rules`` rejects; CASE stops at the first that does."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.rejects(text), F.lit(False)).otherwise(kept)
    return kept


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus base_failed and kept, in the place of columns so named."""
    order = [f["rule"] for f in plan_cascade(docs, text, rules)]
    out = measure(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(F.coalesce(F.col(text), F.lit("")), order)))


def keep_passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs`` and no others."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    # The running number, always true, keeps the optimizer from moving the filter below the measures, into whose
    # inner functions it would copy the split of the text.
    judged = judge(inner, "body", rules).select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("kept"))
    return judged.where("kept").select("row.*")


def op5_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS o(k) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 5 > n_words
    OR length(regexp_replace(t, '[^A-Z]+', '', 'g')) > length(regexp_replace(t, '[^a-z]+', '', 'g'))
    OR length(regexp_replace(t, '[^!]+', '', 'g')) * 10 > n_words * 3
    OR n_dup_lines * 10 > n_lines * 6
    OR word_chars > n_words * 20 OR word_chars < n_words * 2) AS kept
FROM b
"""
