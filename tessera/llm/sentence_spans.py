"""Substring dedup over sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at line ends); a sentence is
compared by its lower-cased words without outer punctuation, so layout and case do not matter. What has no words
belongs to no span. Every run of SPAN_SENTENCES consecutive sentences is a span and is hashed; a run that has
SPAN_WORDS words in fewer sentences, two at least, is a span already. A text of fewer sentences, two at least, is
one span. Spans are joined over the whole corpus by a 128-bit hash; of the places of a repeated span the first,
by (doc_id, text hash, place), stays, and every sentence covered by any other place is removed.

Documents are written once, in buckets by chunk; a chunk sends a row for each of its distinct spans, with the
first and the last of its places, so a passage that a third of the documents hold costs a row a chunk. Where a
span has several places, the first travels back to the chunks that hold it. Texts are never shuffled.

Defined results: null and blank texts have no sentences and nothing is removed; texts of one sentence have no
span; rows that repeat an id and its text are one document and are treated alike; rows of one id with different
texts are different documents; a null doc_id sorts first; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunked

SPAN_SENTENCES = 3
#: Words with which a run of two sentences or more is a span before it has SPAN_SENTENCES.
SPAN_WORDS = 40
CHUNK_BYTES = 8 << 20
#: Text for each partition of the spans; they are about as large as their text.
PART_BYTES = 32 << 20

_CUT = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|[\r\n]+")
_EDGE = b".,;:!?\"'()[]"


def sentences(t: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points; those of white space alone are left out."""
    out, at = [], 0
    for m in _CUT.finditer(t):
        if t[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if t[at:].strip():
        out.append((at, len(t)))
    return out


def spans(t: str, cuts: list[tuple[int, int]], most: int = SPAN_SENTENCES, words: int = SPAN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence behind the last, 16-byte hash) of the spans of a text.

    Sentences without words are passed over: a span covers those between its sentences.
    """
    from xxhash import xxh3_128_digest

    at, norm, sizes = [], [], []
    for k, (a, b) in enumerate(cuts):
        own = [x for w in t[a:b].encode().lower().split() if (x := w.strip(_EDGE))]
        if own:
            at.append(k)
            norm.append(b" ".join(own))
            sizes.append(len(own))
    out, n = [], len(norm)
    for i in range(n - 1):
        j, held = i + 2, sizes[i] + sizes[i + 1]
        while j < n and j - i < most and held < words:
            held += sizes[j]
            j += 1
        if j - i >= most or held >= words or i == 0:
            out.append((at[i], at[j - 1] + 1, xxh3_128_digest(b"\n".join(norm[i:j]))))
    return out


_PLACE = "struct<known: boolean, k: {kind}, th: bigint, place: int>"


def _by_chunk(chunks: DataFrame, kind: str, most: int, words: int) -> DataFrame:
    """(t, h1, h2, first, last) for the distinct spans of each chunk: the first and last of their places in it."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        at = None

        def flush():
            docs = pa.Table.from_batches(held)
            held.clear()
            return _distinct(docs, at, most, words)

        for batch in batches:
            ts = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(ts[1:] != ts[:-1]) + 1).tolist(), len(ts)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if held and ts[a] != at:
                    yield from flush()
                at = int(ts[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    place = _PLACE.format(kind=kind)
    return chunks.select("t", "k", "b").mapInArrow(run, f"t bigint, h1 bigint, h2 bigint, first {place}, last {place}")


def _hashes(found: list[tuple[int, int, bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(h for _, _, h in found), ">i8").reshape(-1, 2)


def _distinct(docs: pa.Table, t: int, most: int, words: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``_by_chunk`` for the documents (t, k, b) of one chunk."""
    from xxhash import xxh64_intdigest

    k, texts = docs.column("k").combine_chunks(), docs.column("b").to_pylist()
    th = np.array([xxh64_intdigest(b) for b in texts], np.uint64).view(np.int64)
    order = pc.sort_indices(pa.table({"k": k, "th": pa.array(th)}), sort_keys=[("k", "ascending"), ("th", "ascending")], null_placement="at_start").to_numpy()
    rows, places, hashes = [], [], []
    for row in order.tolist():
        body = texts[row].decode()
        found = spans(body, sentences(body), most, words)
        if found:
            rows.append(np.full(len(found), row))
            places.append(np.fromiter((a for a, _, _ in found), np.int32, len(found)))
            hashes.append(_hashes(found))
    if not rows:
        return
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes).astype(np.int64)
    by = np.lexsort((np.arange(len(row)), h[:, 1], h[:, 0]))  # of equal spans the order of documents and places stays
    h = h[by]
    new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(by)) - 1

    def where(at: np.ndarray) -> pa.StructArray:
        r = pa.array(row[by[at]])
        own = k.take(r)
        return pa.StructArray.from_arrays([own.is_valid(), own, pa.array(th).take(r), pa.array(place[by[at]])], names=["known", "k", "th", "place"])

    step = 50_000
    for a in range(0, len(first), step):
        f, z = first[a : a + step], last[a : a + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t)), pa.array(h[f, 0]), pa.array(h[f, 1]), where(f), where(z)], names=["t", "h1", "h2", "first", "last"])


def _repeated(found: DataFrame, parts: int) -> DataFrame:
    """(t, h1, h2, first) for the chunks that hold a span with several places: the first of all its places."""
    same = Window.partitionBy("h1", "h2")
    both = found.repartition(parts, "h1", "h2").select("t", "h1", "h2", F.min("first").over(same).alias("first"), F.max("last").over(same).alias("last"))
    return both.where("first <> last").select("t", "h1", "h2", "first")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SPAN_SENTENCES, words: int = SPAN_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: key, n_sentences, n_removed, kept_text, first_in (keys that hold the first places, rising)."""
    if most < 2:
        raise ValueError("a span has two sentences at least")
    kind = docs.schema[key].dataType.simpleString()
    chunks, total = chunked(docs, key, text, chunk_bytes)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    marks = _repeated(_by_chunk(chunks, kind, most, words), parts)

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        from xxhash import xxh64_intdigest

        first = {}
        for batch in marks.to_batches(max_chunksize=100_000):
            for a, b, f in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "first"))):
                first[a, b] = (f["k"], f["th"], f["place"])
        n_sentences, n_removed, kept, firsts = [], [], [], []
        for k, b in zip(docs.column("k").to_pylist(), docs.column("b").to_pylist()):
            t = b.decode()
            cuts = sentences(t)
            gone: set[int] = set()
            sources = set()
            if first:
                th = xxh64_intdigest(b)
                th -= th >> 63 << 64
                found = spans(t, cuts, most, words)
                for (i, j, _), h in zip(found, map(tuple, _hashes(found).tolist())):
                    f = first.get(h)
                    if f is not None and f != (k, th, i):
                        gone.update(range(i, j))
                        sources.add(f[0])
            n_sentences.append(len(cuts))
            n_removed.append(len(gone))
            kept.append(without(t, cuts, gone))
            firsts.append(sorted(sources, key=lambda x: (x is not None, x)))
        own = docs.schema.field("k").type
        return pa.table([docs.column("k"), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(firsts, pa.list_(own))], names=["k", "n_sentences", "n_removed", "kept_text", "first_in"])

    out = chunks.select("t", "k", "b").groupBy("t").cogroup(marks.groupBy("t"))
    return out.applyInArrow(run, f"k {kind}, n_sentences bigint, n_removed bigint, kept_text string, first_in array<{kind}>").withColumnRenamed("k", key)


def without(t: str, cuts: list[tuple[int, int]], gone: set[int]) -> str:
    """``t`` without the sentences ``gone`` and the white space behind each of them."""
    out, at = [], 0
    for i, (a, b) in enumerate(cuts):
        if i in gone:
            out.append(t[at:a])
            at = cuts[i + 1][0] if i + 1 < len(cuts) else len(t)
    return "".join([*out, t[at:]])


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_sentences", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"), "first_in")
