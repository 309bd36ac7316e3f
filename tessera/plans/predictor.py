"""The multimodal predictor: score whichever modalities are given, fuse, band, and keep the model on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators import image as im
from ..operators import models as md
from ..operators import tabular as tab
from ..operators import temporal as ts
from ..sources import io

STEPS = 24
#: Side to which images are brought before they are scored.
IMAGE_SIDE = 32


def _mean(scores: DataFrame) -> DataFrame:
    """(id, low, high): the mean over the windows, or images, of an id."""
    return scores.groupBy("id").agg(F.avg("low").alias("low"), F.avg("high").alias("high"))


class Predictor:
    """Frames are keyed by ``id``: tabular (the clinical layout), temporal (id, t, four channels), image (id, pixels,
    height, width, channels) and text (id, text). The text model is trained, the networks have seeded weights.
    Every window of a series and every image of an id is scored, and their mean counts; images of any size are
    brought to ``image_side``. An image whose pixels do not fill its size is broken and has no score.
    """

    def __init__(self, seed: int = 0, mode: str = "named", image_side: int = IMAGE_SIDE):
        self.seed, self.mode, self.quantized, self.image_side = seed, mode, False, image_side
        self.text: md.TextClassifier | None = None

    def train(self, docs: DataFrame, epochs: int = 100, max_features: int = 1000) -> "Predictor":
        """Fit the text model on (doc_id, text, label)."""
        self.text = md.TextClassifier(epochs=epochs, max_features=max_features, seed=self.seed).fit(docs)
        return self

    def scores(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """(id, low, high) of each modality that is given."""
        unknown = set(frames) - set(fusion.MODALITIES)
        if unknown:
            raise ValueError(f"unknown modalities {sorted(unknown)}")
        out = {}
        if "tabular" in frames:
            out["tabular"] = md.tabular_scores(tab.clinical_rules(frames["tabular"]), "id", list(tab.LAYOUT), self.seed)
        if "temporal" in frames:
            wins = ts.windows(frames["temporal"], ["id"], ["t"], list(io.TEMPORAL), STEPS)
            flat = wins.select("id", F.flatten(F.transform("values", lambda v: F.array(*[F.coalesce(v[c], F.lit(0.0)) for c in io.TEMPORAL]))).alias("x"))
            weights = md.temporal_weights(len(io.TEMPORAL), seed=self.seed)
            out["temporal"] = _mean(md.score_rows(flat, "id", "x", (STEPS, len(io.TEMPORAL)), lambda x: md.temporal_net(x, weights)))
        if "image" in frames:
            net, side = md.image_weights(seed=self.seed), self.image_side
            whole = frames["image"].where((F.col("channels") >= 1) & (F.size("pixels") == F.col("channels") * F.col("height") * F.col("width")) & (F.size("pixels") > 0))
            sized = im.resize(whole.select("id", "channels", "height", "width", "pixels"), side)
            # Several channels become their mean; values of one size follow one another by channel.
            grey = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.col("channels") - 1), F.lit(0.0), lambda a, c: a + F.get(F.col("pixels"), (c * side * side + i).cast("int"))) / F.col("channels"))
            out["image"] = _mean(md.score_rows(sized.select("id", grey.alias("x")), "id", "x", (side, side, 1), lambda x: md.image_net(x / 255, net)))
        if "text" in frames:
            if self.text is None:
                raise ValueError("train before predicting from text")
            docs = frames["text"].select(F.col("id").alias(self.text.key), F.col("text").alias(self.text.text))
            out["text"] = self.text.predict(docs).withColumnRenamed(self.text.key, "id")
        return out

    def predict(self, frames: dict[str, DataFrame]) -> DataFrame:
        """(id, low, high, risk, quantized) for every id of any modality."""
        scored = self.scores(frames)
        fused = fusion.combine(scored, "id")
        named = [F.col(m) if m in scored else F.lit(None).cast("array<double>") for m in fusion.MODALITIES]
        fused = fused.withColumn("f", fusion.late_fusion(named, mode=self.mode))
        out = fused.select("id", F.get("f", F.lit(0)).alias("low"), F.get("f", F.lit(1)).alias("high"))
        return md.quantized(out.withColumn("risk", fusion.risk_band(F.col("high"))), self.quantized)

    def quantize(self) -> "Predictor":
        self.quantized = True
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"seed": self.seed, "mode": self.mode, "image_side": self.image_side, "quantized": self.quantized, "text": self.text is not None}
        if self.text is not None:
            self.text.save(spark, f"{path}/text")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/predictor")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Predictor":
        meta = json.loads(spark.read.text(f"{path}/predictor").first()[0])
        out = cls(meta["seed"], meta["mode"], meta.get("image_side", IMAGE_SIDE))
        out.quantized = meta["quantized"]
        if meta["text"]:
            out.text = md.TextClassifier.load(spark, f"{path}/text")
        return out
