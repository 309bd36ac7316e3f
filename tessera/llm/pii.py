"""Personal data: exact patterns, and information-theoretic sanitisation of what gives them away.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and
non-overlapping per kind. Every pattern is searched in time linear in the text.

The method: each distinct base value is a protected entity e. Terms within CONTEXT words of e are its
candidates. With document frequencies over the whole corpus, a term t discloses

    PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e)))   bits of   IC(e) = log2(N / df(e)),

and it is sanitised in the documents that hold e if PMI >= DISCLOSURE * IC(e): who knows the term then knows nearly
all that names the entity. As most values stand in one document, that is mostly a word that hardly any other
document has, such as a key or a name beside an address. With SUPPORT over 1 a term must be seen beside e in
that many different contexts, so that copies of one passage are one piece of evidence. A sanitised term is
generalised to its class: a number, a name (capitalised) or a word.

Words are everywhere the runs between ASCII white space.

Defined results: null and empty texts have no spans; repeated rows count each in the frequencies; an empty
table gives an empty result; ``find`` ignores further columns and ``mask`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, map_rows, materialize, n_rows

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 5
SUPPORT = 1
DISCLOSURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_INNER = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > floor and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
            at = t.find("@", floor)
        else:
            # The next run of local characters cannot reach back over this sign.
            floor = at + 1
            at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, by start and then in the order of KINDS."""
    out = [("email", a, b) for a, b in _emails(t)]
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(int(p) <= 255 if len(p) < 19 else int(p[-18:]) <= 255 and not p[:-18].strip("0") for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _core(word: str) -> tuple[int, int]:
    """(start, end) of a word without what is neither letter, digit nor underscore at its ends."""
    m = _INNER.search(word)
    if m is None:
        return 0, 0
    end = len(word)
    while not (word[end - 1].isalnum() or word[end - 1] == "_"):
        end -= 1
    return m.start(), end


def _term(word: str) -> str:
    a, b = _core(word)
    return word[a:b].casefold()


def contexts(t: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str]]:
    """Distinct (entity, term, context) of a text; an entity is its kind and value, a context the words around it."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    covered = [False] * len(words)
    lo, marks = 0, []
    for kind, a, b in spans:
        while lo < len(words) and words[lo][1] <= a:
            lo += 1
        hi = lo
        while hi < len(words) and words[hi][0] < b:
            covered[hi] = True
            hi += 1
        marks.append((kind, a, b, lo, hi))
    out = set()
    for kind, a, b, i, j in marks:
        beside = [k for k in (*range(max(0, i - CONTEXT), i), *range(j, min(len(words), j + CONTEXT))) if not covered[k]]
        around = " ".join(t[words[k][0] : words[k][1]] for k in beside)
        context = hashlib.blake2b(around.encode(), digest_size=8).hexdigest()
        value = t[a:b].casefold() if kind == "email" else t[a:b] if kind == "ip" else _digits(t[a:b])
        for k in beside:
            if term := _term(t[words[k][0] : words[k][1]]):
                out.add((f"{kind}:{value}", term, context))
    return sorted(out)


def _texts(batch: pa.RecordBatch, name: str):
    for t in batch.column(batch.schema.get_field_index(name)):
        yield t.as_py() or ""


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """What is found depends on the text alone, so the text's hash and length are the key of all joins."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(body).alias("h"), F.length(body).alias("len"), body.alias("t"))


def _terms(t: str) -> set[str]:
    """The different terms of a text; bytes are split at ASCII white space."""
    return {term for w in set(t.encode().split()) if (term := _term(w.decode()))}


def _evidence(docs: DataFrame, text: str) -> DataFrame:
    """(h, len, e, term, context, n): each context of a base span, and without h, len, e and context for each term in
    how many of the documents with a base span it stands; these are counted before they leave a batch."""

    def make():
        def work(batch: pa.RecordBatch):
            h, size = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, seen = [], Counter()
            for k, t in enumerate(_texts(batch, "t")):
                if s := base_spans(t):
                    rows += [(h[k], size[k], *c, None) for c in contexts(t, s)]
                    seen.update(_terms(t))
            rows += [(None, None, None, term, None, n) for term, n in seen.items()]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["h", "len", "e", "term", "context", "n"])

        return work

    return map_rows(_keyed(docs, text), "h bigint, len int, e string, term string, context string, n bigint", make)


#: Terms whose document frequency is counted by a set held in each worker; beyond that, a word is counted if it
#: falls into one of _SLOTS slots that a term falls into, and what is counted is joined with the terms.
_HELD_TERMS = 200_000
_SLOTS = 1 << 22


def _document_frequency(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, df) for ``terms`` over all documents."""
    spark, few = docs.sparkSession, terms.count() <= _HELD_TERMS
    if few:
        held = spark.sparkContext.broadcast(frozenset(r[0] for r in terms.collect()))
    else:
        slots = terms.select(F.pmod(F.xxhash64("term"), F.lit(_SLOTS)).cast("int").alias("s")).distinct().collect()  # _SLOTS at most
        marks = bytearray(_SLOTS)
        for r in slots:
            marks[r[0]] = 1
        held = spark.sparkContext.broadcast(bytes(marks))
    n_slots = _SLOTS

    def make():
        from xxhash import xxh64_intdigest

        want = held.value
        # Spark's xxhash64 is XXH64 with seed 42; a power of two divides signed and unsigned values alike.
        wanted = want.__contains__ if few else lambda term: want[xxh64_intdigest(term.encode(), 42) % n_slots]

        def work(batch: pa.RecordBatch):
            seen: dict[str, int] = {}
            for t in _texts(batch, "t"):
                for term in _terms(t):
                    if wanted(term):
                        seen[term] = seen.get(term, 0) + 1
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

        return work

    rows = map_rows(_keyed(docs, text).select("t"), "term string, df bigint", make).groupBy("term").agg(F.sum("df").alias("df"))
    return rows if few else rows.join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """((h, len, terms) of the texts that hold something to sanitise, (e, term, pmi, ic) of what discloses)."""
    n = docs.count()
    # Copies of one text give the same evidence, which is told apart from others by the text's hash.
    found = materialize(_evidence(docs, text))
    seen = materialize(found.where("e IS NOT NULL").drop("n").distinct(), n)
    pairs = seen.groupBy("e", "term").agg(F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    pairs = materialize(pairs.select("e", "term"), n)
    # Each document once for an entity, and for an entity with a term.
    per_doc = seen.groupBy("h", "len", "e", "term").agg(F.max(F.lit(1)).alias("one"))
    copies = materialize(_keyed(docs, text).groupBy("h", "len").agg(F.count("*").alias("copies")).join(seen.select("h", "len").distinct(), ["h", "len"], "left_semi"), n)
    per_doc = per_doc.join(copies, ["h", "len"])
    per_doc = materialize(per_doc, n)
    df_et = per_doc.join(pairs, ["e", "term"], "left_semi").groupBy("e", "term").agg(F.sum("copies").alias("df_et"))
    df_e = per_doc.join(pairs.select("e").distinct(), "e", "left_semi").select("h", "len", "e", "copies").distinct().groupBy("e").agg(F.sum("copies").alias("df_e"))
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("df_e"))
    pmi = F.log2(F.lit(float(max(n, 1))) * F.col("df_et") / (F.col("df") * F.col("df_e")))
    enough = (F.col("ic") > 0) & (F.col("pmi") >= F.lit(disclosure) * F.col("ic"))
    # A term stands in as many documents at least as hold it and an entity: what even that number rules out, such as
    # common words, is not counted over all texts.
    least = found.where("e IS NULL").groupBy("term").agg(F.sum("n").alias("df"))
    could = df_et.join(df_e, "e").join(least, "term").withColumns({"pmi": pmi, "ic": ic}).where(enough).select("e", "term", "df_et", "df_e")
    could = materialize(could, n)
    df_t = _document_frequency(docs, text, could.select("term").distinct())
    flagged = materialize(could.join(df_t, "term").select("e", "term", pmi.alias("pmi"), ic.alias("ic")).where(enough), n)
    terms = seen.select("h", "len", "e").distinct().join(flagged.select("e", "term"), "e").groupBy("h", "len").agg(F.collect_set("term").alias("terms"))
    return materialize(terms, n), flagged


def all_spans(t: str, terms: set[str]) -> list[tuple[str, int, int]]:
    """Base spans and, outside them, the words of ``terms``; by start, then in the order of KINDS."""
    base = base_spans(t)
    if not terms:
        return base
    extra, at = [], 0
    by_end = sorted((a, b) for _, a, b in base)
    for m in _WORD.finditer(t):
        word = m[0]
        if _term(word) in terms:
            a, b = (m.start() + x for x in _core(word))
            while at < len(by_end) and by_end[at][1] <= a:
                at += 1
            if a < b and not any(x < b and a < y for x, y in by_end[at:]):
                extra.append(("term", a, b))
    return sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Texts with terms, at most, that are broadcast to all documents.
_HELD_TEXTS = 200_000
#: Every text with a base span has a match; others that have one are only joined in vain.
_MAYBE = r"@[A-Za-z0-9-]+\.|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){11}|\+[0-9]"


def _with_terms(docs: DataFrame, text: str, mark: str, **params) -> DataFrame:
    """``docs`` plus ``mark``: the terms to sanitise in each text (null for most)."""
    terms, _ = disclosing_terms(docs, text, **params)
    h, n = fresh_name(docs, "h"), fresh_name(docs, "len")
    body = F.coalesce(F.col(text), F.lit(""))
    few = n_rows(terms) <= _HELD_TEXTS
    terms = terms.select(F.col("h").alias(h), F.col("len").alias(n), F.col("terms").alias(mark))
    keyed = lambda df: df.withColumn(h, F.xxhash64(body)).withColumn(n, F.length(body))
    if few:
        return keyed(docs).join(F.broadcast(terms), [h, n], "left").drop(h, n)
    # Only texts that can hold an entity are shuffled.
    maybe = body.rlike(_MAYBE)
    plain = docs.where(~maybe).withColumn(mark, F.lit(None).cast("array<string>"))
    return plain.unionByName(keyed(docs.where(maybe)).join(terms, [h, n], "left").drop(h, n))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One row a document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")}
            for t, terms in zip(_texts(batch, "t"), batch.column(batch.schema.get_field_index("terms")).to_pylist()):
                spans = all_spans(t, set(terms or ()))
                base = [s for s in spans if s[0] != "term"]
                for k in KINDS[:4]:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_terms"].append(len(spans) - len(base))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("k")), *(pa.array(v, x) for v, x in zip(out.values(), kinds))], names=["k", *out])

        return work

    schema = f"k {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_terms bigint"
    return map_rows(_with_terms(slim, "t", "terms", **params), schema, make).withColumnRenamed("k", key)


def masked(t: str, spans: list[tuple[str, int, int]]) -> str:
    """``t`` with every span replaced by its kind, and every term by its class."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        word = t[max(a, at) : b]
        name = kind.upper() if kind != "term" else "NUMBER" if word[0].isdigit() else "NAME" if word[0].isupper() else "WORD"
        if a >= at:
            out += [t[at:a], f"<{name}>"]
        at = b
    return "".join([*out, t[at:]])


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **params) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; where ``n_chars`` is a column, it follows the new text.

    Null texts stay null.
    """
    mark = fresh_name(docs, "terms")
    fields = docs.schema.fields
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def make():
        def work(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            terms = batch.column(batch.schema.get_field_index(mark)).to_pylist()
            new = [None if t is None else masked(t, all_spans(t, set(w or ()))) for t, w in zip(texts, terms)]
            cols = [pa.array(new, pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in names]
            return pa.RecordBatch.from_arrays(cols, names=names)

        return work

    out = map_rows(_with_terms(docs, text, mark, **params), schema, make)
    if n_chars in names:
        changed = F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType))
        out = out.withColumn(n_chars, changed)
    return out


def op7_information_content(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
