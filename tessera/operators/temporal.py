"""Temporal operators over rows (series, t, values): windows, padding, resampling, smoothing, repair and features.

Row position is time: every operator orders a series by ``order`` (a total order) and numbers it from 0. All
operators over one series share the partitioning by series, so a chain of them shuffles once. Windows are
gathered by (series, window), never by whole series, so the longest series does not have to fit anywhere.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .base import Guarded
from .stats import clean

PADDINGS = ("zero", "forward", "backward", "mean", "linear")


def _w(series: list[str], order: list[str]):
    return Window.partitionBy(*series).orderBy(*order)


def _num(c: str) -> Column:
    return clean(F.col(f"`{c}`").cast("double"))


def numbered(df: DataFrame, series: list[str], order: list[str], pos: str = "pos", n: str = "n_rows") -> DataFrame:
    """Add the 0-based place of each row in its series and the length of the series."""
    return df.withColumns({pos: (F.row_number().over(_w(series, order)) - 1).cast("long"), n: F.count("*").over(Window.partitionBy(*series))})


# Windows ----------------------------------------------------------------------------------------------------


def windows(df: DataFrame, series: list[str], order: list[str], columns: list[str], size: int, stride: int | None = None, padding: str = "forward") -> DataFrame:
    """(series, window_idx, start, values): full windows of ``size`` rows every ``stride`` rows (``size``: tumbling).

    A series shorter than ``size`` gives one window, filled by ``padding``; rows behind the last full window
    are dropped. ``values`` is an array of structs in row order.
    """
    stride = stride or size
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    base = numbered(df.select(*series, *order, *[c for c in columns if c not in series + order]), series, order)
    count = F.when(F.col("n_rows") < size, 1).otherwise(F.floor((F.col("n_rows") - size) / stride) + 1)
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / stride) + 1)
    high = F.least(F.floor(F.col("pos") / stride), count - 1)
    held = base.where(low <= high).select(*series, "n_rows", "pos", F.struct(*[_num(c).alias(c) for c in columns]).alias("v"), F.explode(F.sequence(low, high)).alias("window_idx"))
    rows = held.groupBy(*series, "window_idx").agg(F.first("n_rows").alias("n_rows"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))
    full = F.when(F.size("values") < size, pad(F.col("values"), columns, size, padding)).otherwise(F.col("values"))
    return rows.select(*series, F.col("window_idx").cast("long").alias("window_idx"), (F.col("window_idx") * stride).cast("long").alias("start"), full.alias("values"))


def pad(values: Column, columns: list[str], size: int, padding: str = "forward") -> Column:
    """An array of structs brought to ``size`` elements; longer arrays stay.

    zero, forward (last row), mean (of each column) and linear fill the tail, backward (first row) the head. Linear
    goes on beyond the last row by the whole change of the series, spread over the gap; one row leaves zeros.
    """
    if padding not in PADDINGS:
        raise ValueError(f"padding must be one of {PADDINGS}")
    n = F.size(values)
    short = n < size
    gap = F.greatest(F.lit(size) - n, F.lit(0))
    make = lambda f: F.struct(*[f(c).cast("double").alias(c) for c in columns])
    zero = make(lambda c: F.lit(0.0))
    if padding == "zero":
        out = F.concat(values, F.array_repeat(zero, gap))
    elif padding == "forward":
        out = F.concat(values, F.array_repeat(F.element_at(values, -1), gap))
    elif padding == "backward":
        out = F.concat(F.array_repeat(F.get(values, F.lit(0)), gap), values)
    elif padding == "mean":
        mean = make(lambda c: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x[c], F.lit(0.0))) / F.size(F.filter(values, lambda x: x[c].isNotNull())))
        out = F.concat(values, F.array_repeat(mean, gap))
    else:
        first, last = F.get(values, F.lit(0)), F.element_at(values, -1)
        alpha = lambda i: (i - n + 1).cast("double") / (F.lit(size) - n + 1)
        ahead = F.transform(F.sequence(n, F.lit(size - 1)), lambda i: make(lambda c: last[c] + alpha(i) * (last[c] - first[c])))
        out = F.when(n < 2, F.concat(values, F.array_repeat(zero, gap))).otherwise(F.concat(values, ahead))
    return F.when(short, out).otherwise(values)


def resample(df: DataFrame, series: list[str], order: list[str], columns: list[str], target: int) -> DataFrame:
    """(series, t, values): each series brought to ``target`` rows by linear interpolation at i * n / target."""
    base = numbered(df, series, order).select(*series, "pos", "n_rows", *[_num(c).alias(c) for c in columns])
    # Each source row knows its successor, so one join by (series, place) is enough.
    w = _w(series, ["pos"])
    pairs = base.select(*series, "pos", *columns, *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"next_{c}") for c in columns])
    lengths = base.where("pos = 0").select(*series, "n_rows")
    goals = lengths.select(*series, "n_rows", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("t"))
    at = F.when(F.col("n_rows") == target, F.col("t").cast("double")).otherwise(F.col("t") * (F.col("n_rows") / F.lit(target)))
    goals = goals.select(*series, "t", F.floor(at).alias("pos"), (at - F.floor(at)).alias("frac"))
    out = goals.join(pairs, [*series, "pos"])
    return out.select(*series, "t", *[(F.col(c) + F.col("frac") * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in columns])


# Smoothing, repair, features --------------------------------------------------------------------------------


def smooth(df: DataFrame, series: list[str], order: list[str], columns: list[str], width: int = 3) -> DataFrame:
    """Centred mean over ``width // 2`` rows to both sides; rows without as many neighbours keep their value."""
    h = width // 2
    w = _w(series, order).rowsBetween(-h, h)
    whole = F.count("*").over(w) == 2 * h + 1
    return df.withColumns({c: F.when(whole, F.avg(_num(c)).over(w)).otherwise(_num(c)) for c in columns})


def repair(df: DataFrame, series: list[str], order: list[str], columns: list[str], z: float = 3.0) -> DataFrame:
    """Values over ``z`` sample deviations from their series' mean become the mean of their neighbours (or the one there is)."""
    w, whole = _w(series, order), Window.partitionBy(*series)
    out = {}
    for c in columns:
        x = _num(c)
        before, behind = F.lag(x).over(w), F.lead(x).over(w)
        near = F.coalesce((before + behind) / 2, before, behind)
        far = F.abs(x - F.avg(x).over(whole)) > z * F.stddev_samp(x).over(whole)
        spread = F.stddev_samp(x).over(whole) > 0
        out[c] = F.when(spread & far, near).otherwise(x)
    return df.withColumns(out)


def moving_average(df: DataFrame, series: list[str], order: list[str], columns: list[str], suffix: str = "_ma") -> DataFrame:
    """Mean of a row and the k rows before it, k = min(n div 4, 10); rows with fewer than k before them get 0."""
    base = numbered(df, series, order, "__pos", "__n")
    k = F.least(F.floor(F.col("__n") / 4), F.lit(10)).cast("int")
    w = _w(series, order)
    out = {}
    for c in columns:
        means = F.array(*[F.avg(_num(c)).over(w.rowsBetween(-i, 0)) for i in range(11)])
        out[c + suffix] = F.when(F.col("__pos") < k, 0.0).otherwise(F.get(means, k))
    return base.withColumns(out).drop("__pos", "__n")


def differences(df: DataFrame, series: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add first differences (0 in row 0) as ``_d1`` and second differences (0 in rows 0 and 1) as ``_d2``."""
    w = _w(series, order)
    d1 = {c: _num(c) - F.lag(_num(c)).over(w) for c in columns}
    d2 = {c: (_num(c) - F.lag(_num(c)).over(w)) - (F.lag(_num(c)).over(w) - F.lag(_num(c), 2).over(w)) for c in columns}
    return df.withColumns({f"{c}_d1": F.coalesce(d1[c], F.lit(0.0)) for c in columns} | {f"{c}_d2": F.coalesce(d2[c], F.lit(0.0)) for c in columns})


def features(df: DataFrame, series: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Originals, moving averages, first and second differences: four columns for each one."""
    return differences(moving_average(df, series, order, columns), series, order, columns)


def label(df: DataFrame, series: list[str], heart_rate: str = "heart_rate", contractions: str = "contractions") -> DataFrame:
    """(series, label): 1 if the mean heart rate exceeds 90 or there are more than five contractions."""
    seen = df.groupBy(*series).agg(F.avg(_num(heart_rate)).alias("hr"), F.sum(_num(contractions)).alias("con"))
    return seen.select(*series, F.coalesce((F.col("hr") > 90) | (F.col("con") > 5), F.lit(False)).cast("int").alias("label"))


# Training data ----------------------------------------------------------------------------------------------


def next_step_pairs(df: DataFrame, series: list[str], order: list[str], column: str, context: int, seed: int | None = None) -> DataFrame:
    """(series, start, context, target): ``context`` values and the same shifted by one row.

    Every start that has a whole target is given; with ``seed`` one start is drawn for each series.
    """
    slim = numbered(df.select(*series, *order, _num(column).alias("__v")), series, order)
    wins = windows(slim.select(*series, *order, "__v"), series, order, ["__v"], context + 1, 1, "zero")
    lengths = slim.where("pos = 0").select(*series, "n_rows").where(F.col("n_rows") > context)
    wins = wins.join(lengths, series, "left_semi").withColumn("all", F.transform("values", lambda x: x["__v"]))
    out = wins.select(*series, "start", F.slice("all", 1, context).alias("context"), F.slice("all", 2, context).alias("target"))
    if seed is None:
        return out
    drawn = lengths.select(*series, F.pmod(F.xxhash64(F.lit(seed), *series), F.col("n_rows") - context).alias("start"))
    return out.join(drawn, [*series, "start"])


def ratio_split(df: DataFrame, series: list[str], order: list[str], train: float = 0.8, overlap: bool = False) -> DataFrame:
    """Add ``split``: the first floor(n * train) rows of each series are train, the others validation.

    ``overlap`` gives the validation rows as first written: the first rows, which are training rows as well.
    """
    base = numbered(df, series, order, "__pos", "__n")
    head = F.floor(F.col("__n") * train)
    if not overlap:
        return base.withColumn("split", F.when(F.col("__pos") < head, "train").otherwise("validation")).drop("__pos", "__n")
    parts = [base.where(F.col("__pos") < head).withColumn("split", F.lit("train")), base.where(F.col("__pos") < F.col("__n") - head).withColumn("split", F.lit("validation"))]
    return parts[0].unionByName(parts[1]).drop("__pos", "__n")


# Augmentation -----------------------------------------------------------------------------------------------


def time_warp(df: DataFrame, series: list[str], order: list[str], columns: list[str], sigma: float = 0.1, seed: int = 0) -> DataFrame:
    """Each row is itself or, by a jitter of the index within sigma < 1 that is truncated, its predecessor."""
    w = _w(series, order)
    back = uniform(seed, 0, *[F.col(c) for c in series + order]) < (0.5 if sigma > 0 else 0.0)
    flagged = df.withColumn("__back", back)
    return flagged.withColumns({c: F.when(F.col("__back"), F.coalesce(F.lag(_num(c)).over(w), _num(c))).otherwise(_num(c)) for c in columns}).drop("__back")


def jitter(df: DataFrame, keys: list[str], columns: list[str], noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Each value times a factor within ``noise`` of 1, drawn for the row's ``keys``."""
    return df.withColumns({c: _num(c) * (1 + (uniform(seed, k + 1, *[F.col(x) for x in keys]) * 2 - 1) * noise) for k, c in enumerate(columns)})


def rescale(df: DataFrame, columns: list[str], low: float = 0.9, high: float = 1.1, seed: int = 0) -> DataFrame:
    factor = random.Random(seed).uniform(low, high)
    return df.withColumns({c: _num(c) * factor for c in columns})


def augment(df: DataFrame, series: list[str], order: list[str], columns: list[str], seed: int = 0) -> DataFrame:
    """The rows four times, with ``variant``: original, warped, noisy and scaled."""
    made = {"original": df.withColumns({c: _num(c) for c in columns}), "warped": time_warp(df, series, order, columns, seed=seed), "noisy": jitter(df, series + order, columns, seed=seed), "scaled": rescale(df, columns, seed=seed)}
    out = None
    for name, part in made.items():
        part = part.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Chain ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TemporalConfig:
    series: tuple[str, ...] = ("series_id",)
    order: tuple[str, ...] = ("t",)
    columns: tuple[str, ...] = ("v",)
    size: int = 24
    stride: int | None = 12
    padding: str = "forward"
    z: float = 3.0
    width: int = 3


class TemporalPreprocessor(Estimator):
    """Fit mean and sample deviation on raw series; the model repairs, smooths, standardises and cuts windows."""

    def __init__(self, config: TemporalConfig | None = None):
        super().__init__()
        self.config = config or TemporalConfig()

    def _fit(self, df: DataFrame) -> "TemporalModel":
        row = df.agg(*[f for c in self.config.columns for f in (F.avg(_num(c)), F.stddev_samp(_num(c)))]).first()
        return TemporalModel(self.config, {c: tuple(row[2 * i : 2 * i + 2]) for i, c in enumerate(self.config.columns)})


class TemporalModel(Model, Guarded):
    def __init__(self, config: TemporalConfig, fitted: dict | None = None):
        super().__init__()
        self.config, self.fitted = config, fitted

    def rows(self, df: DataFrame) -> DataFrame:
        """The repaired, smoothed and standardised rows."""
        self.check_fitted(self.fitted)
        c = self.config
        series, order, cols = list(c.series), list(c.order), list(c.columns)
        out = smooth(repair(df, series, order, cols, c.z), series, order, cols, c.width)
        scaled = {x: (F.col(x) - m) / s for x, (m, s) in self.fitted.items() if m is not None and s is not None and s > 1e-8}
        return out.withColumns(scaled) if scaled else out

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        return windows(self.rows(df), list(c.series), list(c.order), list(c.columns), c.size, c.stride, c.padding)


PROFILES = {
    "vital_signs": TemporalConfig(size=60, stride=30, padding="forward"),
    "monitoring": TemporalConfig(size=300, stride=150, padding="linear"),
    "dosage": TemporalConfig(size=24, stride=12, padding="zero"),
}
