"""Models: closed-form boosting, a softmax text classifier with its trainer, and small networks with given weights.

The networks are scored with weights from a seed or from the caller; nothing about them is trained here but the
text classifier, whose updates depend on the order of the documents and therefore run in one task over a
bounded training set. ``distributed_text_model`` is the stand-in without that bound.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Documents, at most, that the sequential trainer takes: those with the smallest keys.
TRAIN_DOCS = 50_000


def boosted_constant(n_trees: int, learning_rate: float) -> Column:
    """Sum of ``n_trees`` trees that each predict one half."""
    return F.lit(n_trees * learning_rate * 0.5)


def boosted_trees(features: list[str], label: str, **params) -> Pipeline:
    """Extension: a boosted model that learns."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol=label, **params)])


def quantized(df: DataFrame, on: bool = True) -> DataFrame:
    """A flag column; the numbers stay."""
    return df.withColumn("quantized", F.lit(on))


# Text classifier --------------------------------------------------------------------------------------------


def softmax_scores(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame, weights: DataFrame, bias: tuple[float, float]) -> DataFrame:
    """(key, low, high) for every row of ``docs``, from weights (id, w0, w1). Rows without terms get the bias."""
    known = vocab.select("term", "id", "idf").join(weights, "id")  # one row a vocabulary term
    z = tx.vector_rows(docs, [key], tokens, known, *[(F.coalesce(F.sum(F.col("v") * F.col(w)), F.lit(0.0)) + b).alias(f"__{w}") for w, b in zip(("w0", "w1"), bias)])
    top = F.greatest("__w0", "__w1")
    e0, e1 = F.exp(F.col("__w0") - top), F.exp(F.col("__w1") - top)
    return z.select(key, (e0 / (e0 + e1)).alias("low"), (e1 / (e0 + e1)).alias("high"))


class TextClassifier:
    """Softmax regression on frozen TF-IDF weights, trained document by document in the order of their keys."""

    def __init__(self, key: str = "doc_id", text: str = "text", label: str = "label", max_features: int = 1000, learning_rate: float = 0.01, epochs: int = 100, seed: int = 0, train_docs: int = TRAIN_DOCS):
        self.key, self.text, self.label = key, text, label
        self.max_features, self.learning_rate, self.epochs, self.seed, self.train_docs = max_features, learning_rate, epochs, seed, train_docs
        self.vocab: DataFrame | None = None
        self.weights: np.ndarray | None = None
        self.bias = (0.0, 0.0)

    def fit(self, docs: DataFrame) -> "TextClassifier":
        tokens = tx.model_tokenize(F.col(self.text))
        self.vocab = tx.model_vocabulary(docs, self.key, tokens, self.max_features).cache()
        size = self.vocab.count()
        rows = docs.where(F.col(self.label).isNotNull() & F.col(self.key).isNotNull()).orderBy(self.key).limit(self.train_docs)
        rows = rows.select(F.col(self.key).alias("k"), F.col(self.label).cast("int").alias("y"), tokens.alias("ts"))
        terms = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "v"))))
        data = tx.vector_rows(rows, ["k", "y"], F.col("ts"), self.vocab.select("term", "id", "idf"), terms.alias("terms"))
        lr, epochs, seed = self.learning_rate, self.epochs, self.seed

        def run(batches):
            got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["k"], r["y"], [(t["id"], t["v"]) for t in r["terms"]]))
            w = np.random.default_rng(seed).uniform(-0.1, 0.1, (size, 2))
            b = np.zeros(2)
            docs_ = [(np.array([t["id"] for t in r["terms"]], int), np.array([t["v"] for t in r["terms"]], float), r["y"]) for r in got]
            for _ in range(epochs):
                for ids, vs, y in docs_:
                    z = vs @ w[ids] + b
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[y] -= 1.0
                    w[ids] -= lr * vs[:, None] * p
                    b -= lr * p
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()]), pa.array([b.tolist()])], names=["w", "b"])

        row = data.coalesce(1).mapInArrow(run, "w array<double>, b array<double>").first()
        self.weights, self.bias = np.array(row["w"]).reshape(-1, 2), tuple(row["b"])
        return self

    def weight_table(self, spark: SparkSession) -> DataFrame:
        if self.weights is None:
            raise ValueError("fit before predict")
        return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(self.weights)], "id int, w0 double, w1 double")

    def predict(self, docs: DataFrame) -> DataFrame:
        """(key, low, high)."""
        weights = self.weight_table(docs.sparkSession)
        return softmax_scores(docs, self.key, tx.model_tokenize(F.col(self.text)), self.vocab, weights, self.bias)

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.weight_table(spark).write.mode("overwrite").parquet(f"{path}/weights")
        meta = {k: getattr(self, k) for k in ("key", "text", "label", "max_features", "learning_rate", "epochs", "seed", "train_docs", "bias")}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        bias = meta.pop("bias")
        out = cls(**meta)
        vocab = spark.read.parquet(f"{path}/vocab")
        # At most max_features rows, held apart from their files so that a model can be saved over itself.
        out.bias, out.vocab = tuple(bias), spark.createDataFrame(vocab.collect(), vocab.schema)
        rows = spark.read.parquet(f"{path}/weights").orderBy("id").collect()  # at most max_features rows
        out.weights = np.array([[r["w0"], r["w1"]] for r in rows])
        return out


def sparse_vectors(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features): the boundary to ML vectors."""
    to_vector = F.udf(lambda m: Vectors.sparse(size, {int(k): float(v) for k, v in (m or {}).items()}), VectorUDT())
    return vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", "v"))).alias("m")).select(key, to_vector("m").alias("features"))


def distributed_text_model(vectors: DataFrame, labels: DataFrame, key: str, label: str, size: int, **params):
    """The stand-in for large corpora: another optimiser, hence other weights."""
    return LogisticRegression(labelCol=label, featuresCol="features", **params).fit(sparse_vectors(vectors, key, size).join(labels.select(key, label), key))


# Networks ---------------------------------------------------------------------------------------------------


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def mlp_weights(sizes: tuple[int, ...] = (10, 64, 32, 2), seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k + 1 < len(layers):
            x = _relu(x)
    return x


def temporal_weights(channels: int = 4, hidden: int = 32, seed: int = 0) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), hidden
    draw = lambda *s: rng.normal(0, 0.1, s)
    return {"c1": draw(3, channels, h), "c2": draw(3, h, h), "wz": draw(h, h), "uz": draw(h, h), "wr": draw(h, h), "ur": draw(h, h), "wn": draw(h, h), "un": draw(h, h), "out": draw(h, 2)}


def _conv(x: np.ndarray, w: np.ndarray, dilation: int) -> np.ndarray:
    """Same-length convolution over time: x (n, t, c), w (3, c, h)."""
    padded = np.pad(x, ((0, 0), (dilation, dilation), (0, 0)))
    t = x.shape[1]
    return sum(padded[:, k * dilation : k * dilation + t] @ w[k] for k in range(3))


def temporal_net(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Two dilated convolutions, a gated recurrent unit, and a linear layer on its last step."""
    x = _relu(_conv(_relu(_conv(x, p["c1"], 1)), p["c2"], 2))
    s = lambda v: 1 / (1 + np.exp(-v))
    h = np.zeros((x.shape[0], x.shape[2]))
    for t in range(x.shape[1]):
        z, r = s(x[:, t] @ p["wz"] + h @ p["uz"]), s(x[:, t] @ p["wr"] + h @ p["ur"])
        h = (1 - z) * np.tanh(x[:, t] @ p["wn"] + (r * h) @ p["un"]) + z * h
    return h @ p["out"]


def image_weights(channels: int = 1, widths: tuple[int, ...] = (32, 64, 128, 128, 256, 256), seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    blocks = [(rng.normal(0, 0.3, (3, 3, a)), rng.normal(0, (2 / a) ** 0.5, (a, b))) for a, b in zip(widths, widths[1:])]
    return {"stem": rng.normal(0, 0.3, (3, 3, channels, widths[0])), "blocks": blocks, "out": rng.normal(0, 0.1, (widths[-1], 2))}


def image_net(x: np.ndarray, p: dict) -> np.ndarray:
    """A stem of stride two, five depthwise-separable blocks, a global mean and a linear layer: x (n, h, w, c)."""

    def taps(v):
        pad = np.pad(v, ((0, 0), (1, 1), (1, 1), (0, 0)))
        return [(i, j, pad[:, i : i + v.shape[1], j : j + v.shape[2]]) for i in range(3) for j in range(3)]

    x = _relu(sum(v @ p["stem"][i, j] for i, j, v in taps(x))[:, ::2, ::2])
    for depth, point in p["blocks"]:
        x = _relu(_relu(sum(v * depth[i, j] for i, j, v in taps(x))) @ point)
    return x.mean(axis=(1, 2)) @ p["out"]


def score_rows(df: DataFrame, key: str, inputs: str, shape: tuple[int, ...], net: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, low, high): ``net`` over batches of the array column ``inputs``, each row brought to ``shape``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, *shape)
                y = net(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["k", "low", "high"])

    return df.select(F.col(key).alias("k"), inputs).mapInArrow(run, f"k {kind}, low double, high double").withColumnRenamed("k", key)


def tabular_scores(df: DataFrame, key: str, columns: list[str], seed: int = 0) -> DataFrame:
    layers = mlp_weights((len(columns), 64, 32, 2), seed)
    return score_rows(df.withColumn("__x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])), key, "__x", (len(columns),), lambda x: mlp(x, layers))


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
