"""Queries over scores, fusion and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.draws import uniform_sql
from ..operators import fusion
from ..operators import models as md
from ..operators import tabular as tab
from ..operators import temporal as ts
from ..operators import text as tx
from ..session import scratch_dir, spread, table
from ..sources import io
from .fixtures import CLINICAL, SCORES, fixture
from .text_queries import _MVOC, _M, _TC

_MODS = fusion.MODALITIES


def _frames(spark, sf_dir):
    """One frame (id, low, high) for each modality, without the ids it lacks."""
    base = fixture(spark, sf_dir, SCORES)
    return {m: base.where(F.col(m).isNotNull()).select("id", (1 - F.col(m)).alias("low"), F.col(m).alias("high")) for m in _MODS}


def _fused(make):
    def run(spark, sf_dir):
        frames = _frames(spark, sf_dir)
        both = fusion.combine(frames, "id").withColumn("f", make([F.col(m) for m in frames]))
        out = both.select("id", F.round(F.get("f", F.lit(0)), 6).alias("low"), F.round(F.get("f", F.lit(1)), 6).alias("high"))
        return out.withColumn("risk", fusion.risk_band(F.col("high")))

    return run


def risk_bands(spark, sf_dir):
    return fixture(spark, sf_dir, SCORES).select("id", fusion.risk_band(F.col("text")).alias("risk"))


def softmax(spark, sf_dir):
    rows = fixture(spark, sf_dir, CLINICAL).select("id", fusion.softmax(F.array(F.col("age") / 10, F.col("glucose") / 50)).alias("p"))
    return rows.select("id", F.round(F.get("p", F.lit(0)), 6).alias("low"), F.round(F.get("p", F.lit(1)), 6).alias("high"))


def boosted_constant(spark, sf_dir):
    return fixture(spark, sf_dir, CLINICAL).select("id", F.round(md.boosted_constant(10, 0.1), 6).alias("score"))


def quantized(spark, sf_dir):
    return md.quantized(fixture(spark, sf_dir, CLINICAL).select("id"))


def softmax_score(spark, sf_dir):
    """Documents scored with the fixed weights (id % 7 - 3) / 2 and (id % 5 - 2) / 2."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = tx.model_tokenize(F.col("text"))
    vocab = tx.model_vocabulary(docs, "doc_id", words, 200)
    weights = spark.range(200).select(F.col("id").cast("int").alias("id"), ((F.col("id") % 7 - 3) / 2).alias("w0"), ((F.col("id") % 5 - 2) / 2).alias("w1"))
    out = md.softmax_scores(docs, "doc_id", words, vocab, weights, (0.1, -0.1))
    return out.select("doc_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def sgd_text(spark, sf_dir):
    model = md.TextClassifier(epochs=5, max_features=200).fit(io.sample_text(spark))
    return model.predict(io.sample_text(spark, 1)).select("doc_id", F.round("high", 3).alias("high"))


def persistence(spark, sf_dir):
    """Scores of a model that was written and read again, next to those of the first."""
    path = f"{scratch_dir(spark)}/models/{uuid.uuid4().hex}"
    model = md.TextClassifier(epochs=2, max_features=100).fit(io.sample_text(spark, 5))
    model.save(spark, path)
    docs = io.sample_text(spark, 1)
    a, b = model.predict(docs), md.TextClassifier.load(spark, path).predict(docs)
    return a.join(b.select("doc_id", F.col("high").alias("again")), "doc_id").select("doc_id", (F.abs(F.col("high") - F.col("again")) < 1e-9).alias("same"))


def tabular_net(spark, sf_dir):
    out = md.tabular_scores(tab.clinical_rules(fixture(spark, sf_dir, CLINICAL)), "id", list(tab.LAYOUT))
    return out.select("id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def predict(spark, sf_dir):
    """Score each modality of the sample patient, fuse, band, and give the rows of the prediction file."""
    given = io.sample_input(spark)
    steps = ts.windows(given["temporal"], ["id"], ["t"], list(io.TEMPORAL), 24)
    flat = steps.select("id", F.flatten(F.transform("values", lambda v: F.array(*[v[c] for c in io.TEMPORAL]))).alias("x"))
    weights = md.temporal_weights()
    text = md.TextClassifier(epochs=2, max_features=100, key="doc_id").fit(io.sample_text(spark, 5))
    frames = {
        "tabular": md.tabular_scores(given["tabular"], "id", list(tab.LAYOUT)),
        "temporal": md.score_rows(flat, "id", "x", (24, 4), lambda x: md.temporal_net(x, weights)),
        "text": text.predict(given["text"].withColumnRenamed("id", "doc_id")).withColumnRenamed("doc_id", "id"),
    }
    fused = fusion.combine(frames, "id").withColumn("f", fusion.late_fusion([F.col(m) for m in frames], mode="positional"))
    return io.prediction_rows(fused.select("id", F.get("f", F.lit(0)).alias("low"), F.get("f", F.lit(1)).alias("high")), "id").drop("timestamp")


QUERIES = {
    "fuse_weighted": _fused(lambda preds: fusion.late_fusion(preds)),
    "fuse_missing_modality": _fused(lambda preds: fusion.late_fusion(preds, mode="positional")),
    "fuse_sum": _fused(fusion.attention_fusion),
    "risk_band": risk_bands,
    "fuse_softmax": softmax,
    "model_gbt_closed_form": boosted_constant,
    "model_quantized": quantized,
    "model_softmax_score": softmax_score,
    "model_sgd_text": sgd_text,
    "model_persistence": persistence,
    "model_tabular_net": tabular_net,
    "model_predict": predict,
    "source_sample_tabular": lambda spark, sf_dir: io.sample_tabular(spark).select("id", *[F.round(c, 9).alias(c) for c in lex.TABULAR_RANGES], "label"),
    "source_sample_temporal": lambda spark, sf_dir: io.sample_temporal(spark).select("series_id", "t", *[F.round(c, 9).alias(c) for c in io.TEMPORAL]),
    "source_sample_text": lambda spark, sf_dir: io.sample_text(spark),
}

_BAND = "CASE WHEN {h} > 0.7e0 THEN 'High' WHEN {h} > 0.3e0 THEN 'Medium' WHEN {h} IS NOT NULL THEN 'Low' END"
_S = f"WITH s AS ({SCORES}), l AS (SELECT id, k, w, v FROM s, LATERAL (VALUES (1, 0.3e0, tabular), (2, 0.3e0, temporal), (3, 0.2e0, image), (4, 0.2e0, text)) AS m(k, w, v) WHERE v IS NOT NULL)"


def _fuse(body):
    return f"{_S}, f AS ({body}) SELECT id, round(low, 6) AS low, round(high, 6) AS high, {_BAND.format(h='round(high, 6)')} AS risk FROM f"


_DRAWN = ", ".join(f"{lo}::DOUBLE + {hi - lo!r}::DOUBLE * {uniform_sql(0, k, 'i')} AS {c}" for k, (c, (lo, hi)) in enumerate(lex.TABULAR_RANGES.items()))
_SIGNS = "(CASE WHEN age > 35 THEN 3 ELSE 0 END + CASE WHEN systolic > 140 OR diastolic > 90 THEN 4 ELSE 0 END + CASE WHEN glucose > 126 THEN 3 ELSE 0 END)"


def _network():
    """The network as list products; its weights are drawn from the seed here as there."""
    rules = "SELECT id, " + ", ".join({"weight": "CASE WHEN age > 35 THEN weight * 1.2e0 ELSE weight END AS weight", "systolic": "CASE WHEN weight / (height * height) > 30 THEN systolic * 1.15e0 ELSE systolic END AS systolic"}.get(c, c) for c in tab.LAYOUT) + " FROM c"
    x = f"SELECT id, [{', '.join(tab.LAYOUT)}]::DOUBLE[] AS x FROM ({rules})"
    layers = md.mlp_weights()
    for k, (w, b) in enumerate(layers):
        rows = ", ".join("[" + ", ".join(repr(float(v)) for v in [*column, bias]) + "]" for column, bias in zip(w.T, b))
        y = "list_dot_product(list_append(x, 1e0), w)"
        x = f"SELECT id, list_transform([{rows}]::DOUBLE[][], lambda w: {y if k + 1 == len(layers) else f'greatest({y}, 0e0)'}) AS x FROM ({x})"
    return f"WITH c AS ({CLINICAL}) SELECT id, round(x[1], 6) AS low, round(x[2], 6) AS high FROM ({x})"


ORACLE = {
    "fuse_weighted": _fuse("SELECT id, sum(w * (1 - v)) / sum(w) AS low, sum(w * v) / sum(w) AS high FROM l GROUP BY 1"),
    "fuse_missing_modality": _fuse("SELECT id, sum(([0.3e0, 0.3e0, 0.2e0, 0.2e0])[r] * (1 - v)) AS low, sum(([0.3e0, 0.3e0, 0.2e0, 0.2e0])[r] * v) AS high FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM l) GROUP BY 1"),
    "fuse_sum": _fuse("SELECT id, sum(1 - v) AS low, sum(v) AS high FROM l GROUP BY 1"),
    "risk_band": f"WITH s AS ({SCORES}) SELECT id, {_BAND.format(h='text')} AS risk FROM s",
    "fuse_softmax": f"WITH c AS ({CLINICAL}) SELECT id, round(1 / (1 + exp(glucose / 50 - age / 10)), 6) AS low, round(1 / (1 + exp(age / 10 - glucose / 50)), 6) AS high FROM c",
    "model_gbt_closed_form": "SELECT c_custkey AS id, 0.5e0 AS score FROM customer",
    "model_quantized": "SELECT c_custkey AS id, true AS quantized FROM customer",
    "model_softmax_score": f"""{_M}, {_MVOC.format(take=200)}, {_TC},
z AS (SELECT r, sum(tc.n * 1e0 / total * idf * ((id % 7 - 3) / 2e0)) AS z0, sum(tc.n * 1e0 / total * idf * ((id % 5 - 2) / 2e0)) AS z1 FROM tc JOIN voc USING (term) GROUP BY 1)
SELECT doc_id, round(1 / (1 + exp(coalesce(z1, 0) - 0.1e0 - coalesce(z0, 0) - 0.1e0)), 6) AS low, round(1 / (1 + exp(coalesce(z0, 0) + 0.1e0 - coalesce(z1, 0) + 0.1e0)), 6) AS high
FROM (SELECT row_number() OVER () AS r, doc_id FROM d) LEFT JOIN z USING (r)""",
    "model_tabular_net": _network(),
    "model_persistence": "SELECT i AS doc_id, true AS same FROM range(10) AS r(i)",
    "source_sample_tabular": f"WITH r AS (SELECT i AS id, {_DRAWN} FROM range(1000) AS n(i)) SELECT id, " + ", ".join(f"round({c}, 9) AS {c}" for c in lex.TABULAR_RANGES) + f", ({_SIGNS} / 10e0 + {uniform_sql(0, 99, 'id')} * 0.2e0 > 0.5e0)::INT AS label FROM r",
    "source_sample_temporal": f"""SELECT s AS series_id, t::INT AS t, round(60 + 40 * {uniform_sql(0, 10, 's')} + 20 * {uniform_sql(0, 0, 's', 't')} - 10, 9) AS heart_rate,
  round(90 + 50 * {uniform_sql(0, 11, 's')} + 40 * {uniform_sql(0, 1, 's', 't')} - 20, 9) AS blood_pressure, round(10 * {uniform_sql(0, 2, 's', 't')}, 9) AS movement,
  CASE WHEN {uniform_sql(0, 3, 's', 't')} < 0.1e0 THEN 1e0 ELSE 0e0 END AS contractions FROM range(500) AS a(s), range(24) AS b(t)""",
    "source_sample_text": "SELECT r * 10 + i AS doc_id, text, label FROM range(100) AS a(r), (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}', {y})" for i, (t, y) in enumerate(lex.SAMPLE_TEXTS)) + ") AS b(i, text, label)",
}
