"""Late fusion of the scores of whichever modalities are present, and risk bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ("tabular", "temporal", "image", "text")
WEIGHTS = (0.3, 0.3, 0.2, 0.2)


def combine(frames: dict[str, DataFrame], key: str, cls: tuple[str, ...] = ("low", "high")) -> DataFrame:
    """One row a key: an array of scores for each modality in the order of ``frames``, NULL where it is absent."""
    out = None
    for name, df in frames.items():
        part = df.select(key, F.array(*[F.col(c).cast("double") for c in cls]).alias(name))
        out = part if out is None else out.join(part, key, "full")
    if out is None:
        raise ValueError("no modality to fuse")
    return out


def late_fusion(preds: list[Column], weights: tuple[float, ...] = WEIGHTS, mode: str = "named") -> Column:
    """Weighted sum of score arrays; NULL if all are absent.

    named: each modality has its weight, and the weights of those present are brought to sum 1.
    positional: the weights sum to 1 over all and the i-th prediction that is present takes the i-th weight
    (the last one if there are more).
    """
    if mode not in ("named", "positional"):
        raise ValueError("mode must be named or positional")
    total = sum(weights)
    ws = [w / total for w in weights]
    present = F.filter(F.array(*[F.struct(F.lit(ws[min(i, len(ws) - 1)]).alias("w"), p.alias("p")) for i, p in enumerate(preds)]), lambda x: x["p"].isNotNull())
    if mode == "positional":
        table = F.array(*[F.lit(w) for w in ws])
        present = F.transform(present, lambda x, i: F.struct(F.get(table, F.least(i, F.lit(len(ws) - 1))).alias("w"), x["p"].alias("p")))
        scale = F.lit(1.0)
    else:
        scale = F.aggregate(present, F.lit(0.0), lambda a, x: a + x["w"])
    zero = F.transform(F.get(present, F.lit(0))["p"], lambda v: F.lit(0.0))
    fused = F.aggregate(present, zero, lambda a, x: F.zip_with(a, x["p"], lambda s, v: s + v * x["w"]))
    return F.when(F.size(present) > 0, F.transform(fused, lambda v: v / scale))


def attention_fusion(preds: list[Column]) -> Column:
    """Sum of the score arrays that are present: attention over a single element weighs each by 1."""
    present = F.filter(F.array(*preds), lambda p: p.isNotNull())
    zero = F.transform(F.get(present, F.lit(0)), lambda v: F.lit(0.0))
    return F.when(F.size(present) > 0, F.aggregate(present, zero, lambda a, p: F.zip_with(a, p, lambda s, v: s + v)))


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    exps = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def risk_band(high: Column) -> Column:
    return F.when(high > 0.7, "High").when(high > 0.3, "Medium").when(high.isNotNull(), "Low")
