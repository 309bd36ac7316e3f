"""Quality classifier: naive Bayes support vectors (NB-SVM) over n-gram indicators.

Features of a text are indicators, hashed into 2**HASH_BITS slots: words and pairs of words, lower-cased; byte
trigrams of the lower-cased text as it is; and n-grams (1 to 3) of word patterns, where a word's pattern is the
class of its first, second and last byte and whether it equals the word before. Each indicator is scaled by its class log-count ratio
r = log((p / |p|) / (q / |q|)), and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent. Rows are brought to unit length of their indicators, so long texts are not louder.
A logistic curve, fitted on training rows kept aside from the descent, turns the margin into a score.

The model is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash of their id; every text
is scored as a whole. Label 1 is the good class.

Defined results: null and empty texts have no features and get the score of the intercept; labels that are
null, repeated ids with different labels (the larger counts) and labels without a document are harmless;
with no usable label of one class every score is the share of the good class (0.5 without labels); repeated
documents are scored one by one; further columns are never inputs.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled rows, at most, that the model is fitted on.
TRAIN_ROWS = 6_000
HASH_BITS = 18
#: Smoothing of the class counts, weight of a row's loss, passes of the descent.
ALPHA, COST, PASSES = 1.0, 1.0, 40
GOOD_FROM = 0.7
#: Bytes whose features are taken at a time; the indicators of the parts are united.
_PART = 1 << 20

_CLASS = np.full(256, 5, np.int64)
for _chars, _c in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (".,;:?'\"()-", 3), ("!", 4)):
    for _ch in _chars:
        _CLASS[ord(_ch)] = _c
_CLASS[128:] = 6


def _slots(x: np.ndarray, salt: int) -> np.ndarray:
    """Hash int64 codes to slots (multiply and shift)."""
    with np.errstate(over="ignore"):
        return ((x.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


_ODD = np.int64(0x2545F4914F6CDD1D)


def _word_hash(word: bytes) -> int:
    return zlib.crc32(word) << 17 ^ zlib.adler32(word)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct slots of a text's indicators."""
    out, low = [], text.lower()
    for a in range(0, max(len(low) - 2, 0), _PART):
        b = np.frombuffer(low[a : a + _PART + 2], np.uint8).astype(np.int64)
        out.append(np.unique(_slots(b[:-2] << 16 | b[1:-1] << 8 | b[2:], 1)))
    words = text.split()
    if words:
        known = np.fromiter(map(_word_hash, low.split()), np.uint64, len(words)).view(np.int64)
        out.append(np.unique(_slots(np.unique(known), 11)))
        if len(known) > 1:
            out.append(np.unique(_slots(np.unique(known[:-1] * _ODD + known[1:]), 12)))
        same = np.fromiter((x == y for x, y in zip(words, [b"", *words])), np.int64, len(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        flat = np.frombuffer(b"".join(words) + b" ", np.uint8)
        starts = np.concatenate(([0], ends[:-1]))
        c = ((_CLASS[flat[starts]] * 8 + _CLASS[flat[np.minimum(starts + 1, ends - 1)]]) * 8 + _CLASS[flat[ends - 1]]) * 2 + same
        c = c.astype(np.int64)
        for n in (1, 2, 3):
            if len(c) >= n:
                code = c[: len(c) - n + 1].copy()
                for k in range(1, n):
                    code = code << 11 | c[k : len(c) - n + 1 + k]
                out.append(np.unique(_slots(np.unique(code), 1 + n)))
    return np.unique(np.concatenate(out)).astype(np.int32) if out else np.zeros(0, np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (times ``scale``) and intercept of the hinge-loss model; y is -1 or 1.

    Minimises (|w|^2 + b^2) / 2 + cost * sum(max(0, 1 - y (w x + b))) by its dual: one variable a row between 0 and
    ``cost``, visited in a shuffled order until no step is larger than ``tolerance * cost``; the intercept is a
    further feature of value 1.
    """
    w, bias, n = np.zeros(len(scale)), 0.0, len(rows)
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norms = np.array([v @ v for v in values]) + 1
    alpha, order, rng = np.zeros(n), np.arange(n), np.random.default_rng(seed)
    for _ in range(passes):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < tolerance * cost:
            break
    return w * scale, bias


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve for margins ``f`` and labels -1, 1, with smoothed targets."""
    good, bad = float((y > 0).sum()), float((y < 0).sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - t) * f).sum() + 1e-3 * a, (p - t).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * f * f).sum() + 1e-3, (q * f).sum()], [(q * f).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def fit(texts: list[bytes], labels: list[int], alpha: float = ALPHA) -> dict:
    """A model from texts and labels 0, 1."""
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if not len(y) or len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        return {"weights": np.zeros(1 << HASH_BITS, np.float32), "bias": 0.0, "a": 1e-6, "b": float(np.log(min(max(share, 0.01), 0.99) / (1 - min(max(share, 0.01), 0.99))))}
    rows = [features(t) for t in texts]
    aside = np.arange(len(rows)) % 5 == 0
    if any(len(set(y[m].tolist())) < 2 for m in (aside, ~aside)):
        aside = np.zeros(len(rows), bool)
    main = np.flatnonzero(~aside)
    p, q = (alpha + np.bincount(np.concatenate([rows[i] for i in main if y[i] == s] or [np.zeros(0, np.int32)]), minlength=1 << HASH_BITS) for s in (1, -1))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    weights, bias = descend([rows[i] for i in main], y[main], ratio)
    on = np.flatnonzero(aside) if aside.any() else main
    a, b = _platt(np.array([margin(rows[i], weights, bias) for i in on]), y[on])
    return {"weights": weights.astype(np.float32), "bias": float(bias), "a": float(a), "b": float(b)}


def margin(slots: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return float(weights[slots].sum(dtype=np.float64)) / np.sqrt(max(len(slots), 1)) + bias


def score(text: bytes, model: dict) -> float:
    f = model["a"] * margin(features(text), model["weights"], model["bias"]) + model["b"]
    return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``train_rows`` rows outside fold 2, in one task; the model has a fixed size."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 2)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(train_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen.withColumnRenamed(key, "k")), "k")  # train_rows ids at most
    # A repeated id counts once, so the bound holds for rows as well.
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches):
        got = sorted((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
        model = fit([(t or "").encode() for _, _, t in got], [y for _, y, _ in got])
        out = io.BytesIO()
        np.savez_compressed(out, **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    packed = rows.select("k", "y", "t").coalesce(1).mapInArrow(run, "model binary").first()
    if packed is None:
        return fit([], [])
    saved = np.load(io.BytesIO(bytes(packed["model"])))
    return {"weights": saved["weights"], **{c: float(saved[c]) for c in ("bias", "a", "b")}}


def classify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """One row a document: key, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**HASH_BITS floats
    slim = docs.select(F.col(key).alias("k"), (fold(key) == 2).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def make():
        own = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [score(t.as_py(), own) for t in batch.column(2)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= good_from) for x in s], pa.int32())], names=["k", "held_out", "score", "predicted"])

        return work

    return map_rows(slim, f"k {kind}, held_out boolean, score double, predicted int", make).withColumnRenamed("k", key)


def op10_nb_svm(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, train(docs, labels))
