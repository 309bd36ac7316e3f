"""Tabular operators: imputation, outlier capping, clinical features, scaling and their chain.

Columns are addressed by name. Missing is NULL, and NaN counts as missing. Fit results are scalars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import TABULAR_RANGES
from . import stats
from .base import Guarded

LAYOUT = tuple(TABULAR_RANGES)


def _num(c: str) -> Column:
    return stats.clean(F.col(f"`{c}`").cast("double"))


def _lit(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


# Imputation -------------------------------------------------------------------------------------------------


def fill_values(df: DataFrame, rules: dict[str, str | float]) -> dict[str, float | None]:
    """The value that fills each column's gaps in this batch; ``rules`` maps a column to mean, median, mode or a number."""
    out: dict[str, float | None] = {c: float(r) for c, r in rules.items() if not isinstance(r, str)}
    means = [c for c, r in rules.items() if r == "mean"]
    if means:
        row = df.agg(*[F.avg(_num(c)) for c in means]).first()
        out |= dict(zip(means, row))
    if medians := [c for c, r in rules.items() if r == "median"]:
        out |= stats.median(df, medians)
    if modal := [c for c, r in rules.items() if r == "mode"]:
        out |= stats.modes(df, modal)
    unknown = set(rules) - set(out)
    if unknown:
        raise ValueError(f"unknown imputation for {sorted(unknown)}")
    return out


def impute(df: DataFrame, rules: dict[str, str | float]) -> DataFrame:
    """Fill gaps from the batch itself. A column without any known value stays NULL, unless it is filled by a constant."""
    return df.withColumns({c: F.coalesce(_num(c), _lit(v)) for c, v in fill_values(df, rules).items()})


def impute_forward(df: DataFrame, columns: list[str], order: list[str], partition: list[str]) -> DataFrame:
    """Last known value in ``order`` within ``partition``; leading gaps take the first known one.

    The order is total only within a partition, which has to be named: a global fill is a partition of one.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    before, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(_num(c), ignorenulls=True).over(before), F.first(_num(c), ignorenulls=True).over(behind)) for c in columns})


# Capping ----------------------------------------------------------------------------------------------------


def cap(df: DataFrame, columns: list[str], factor: float = 1.5, bounds: dict | None = None) -> DataFrame:
    """Clip each column to its quartile bounds in this batch; columns of fewer than four known values stay."""
    bounds = bounds or stats.quartile_bounds(df, columns, factor)
    clipped = {c: F.when(_num(c).isNull(), None).otherwise(F.greatest(F.least(_num(c), _lit(b[1])), _lit(b[0]))) for c, b in bounds.items() if b}
    return df.withColumns(clipped) if clipped else df


# Clinical features ------------------------------------------------------------------------------------------


def bmi(weight: str = "weight", height: str = "height") -> Column:
    return F.when(_num(height) > 0, _num(weight) / (_num(height) * _num(height))).otherwise(0.0)


def bp_category(systolic: str = "systolic", diastolic: str = "diastolic") -> Column:
    s, d = _num(systolic), _num(diastolic)
    return F.when((s >= 140) | (d >= 90), 2.0).when((s >= 120) | (d >= 80), 1.0).otherwise(0.0)


def age_risk(age: str = "age") -> Column:
    return F.when(_num(age) >= 35, 2.0).when(_num(age) < 20, 1.0).otherwise(0.0)


def glucose_category(glucose: str = "glucose") -> Column:
    return F.when(_num(glucose) >= 126, 2.0).when(_num(glucose) >= 100, 1.0).otherwise(0.0)


def clinical_features(df: DataFrame, columns: tuple[str, ...] = LAYOUT, pad_to_10: bool = False) -> DataFrame:
    """Add bmi, bp_category, age_risk and glucose_category, read from the first six places of ``columns``.

    With five columns or fewer there is nothing to derive from; ``pad_to_10`` adds the block of ten columns of
    which the last six (or all) are zero.
    """
    names = ["bmi", "bp_category", "age_risk", "glucose_category"]
    made: dict[str, Column] = {}
    if len(columns) > 5:
        age, weight, height, systolic, diastolic, glucose = columns[:6]
        made = dict(zip(names, (bmi(weight, height), bp_category(systolic, diastolic), age_risk(age), glucose_category(glucose))))
    if pad_to_10:
        made = {n: made.get(n, F.lit(0.0)) for n in names} | {f"reserved_{k}": F.lit(0.0) for k in range(5, 11)}
    return df.withColumns(made) if made else df


def clinical_rules(df: DataFrame, layout: tuple[str, ...] | None = None) -> DataFrame:
    """Adjust rows by three strict rules, addressed by name: age > 35 raises weight by a fifth, bmi > 30 raises
    systolic by 15 %, systolic > 140 sets the flag ``hypertension``.

    With ``layout`` the rules go by place, as first written: place 2 stands for the bmi, 4 for the systolic
    pressure, and the raised and set places are 1, 3 and 5. Rules whose places do not exist are left out.
    """
    if layout is not None:
        at = lambda k: layout[k] if k < len(layout) else None
        out = {}
        for test, limit, target, effect in ((0, 35, 1, 1.2), (2, 30, 3, 1.15), (4, 140, 5, None)):
            if at(test) and at(target):
                new = F.lit(1.0) if effect is None else _num(at(target)) * effect
                out[at(target)] = F.when(_num(at(test)) > limit, new).otherwise(_num(at(target)))
        return df.withColumns(out) if out else df
    body = bmi()
    return df.withColumns(
        {
            "weight": F.when(_num("age") > 35, _num("weight") * 1.2).otherwise(_num("weight")),
            "systolic": F.when(body > 30, _num("systolic") * 1.15).otherwise(_num("systolic")),
            "hypertension": (_num("systolic") > 140).cast("double"),
        }
    )


def risk_label(noise: Column | float = 0.0) -> Column:
    """1 (high) if the weighted signs of age, pressure and glucose, plus ``noise``, exceed one half."""
    score = F.when(_num("age") > 35, 3).otherwise(0) + F.when((_num("systolic") > 140) | (_num("diastolic") > 90), 4).otherwise(0) + F.when(_num("glucose") > 126, 3).otherwise(0)
    noise = noise if isinstance(noise, Column) else F.lit(float(noise))
    return (score / 10 + noise > 0.5).cast("int")


# Scaling ----------------------------------------------------------------------------------------------------

_LEAST = 1e-8


def fit_standard(df: DataFrame, columns: list[str], nan_poison: bool = False) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample deviation of the known values; with ``nan_poison`` one gap leaves a column unscaled."""
    row = df.agg(*[f for c in columns for f in (F.avg(_num(c)), F.stddev_samp(_num(c)), F.count(_num(c)), F.count("*"))]).first()
    out = {}
    for i, c in enumerate(columns):
        mean, std, known, n = row[4 * i : 4 * i + 4]
        out[c] = (None, None) if nan_poison and known < n else (mean, std)
    return out


def fit_minmax(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f for c in columns for f in (F.min(_num(c)), F.max(_num(c)))]).first()
    return {c: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, c in enumerate(columns)}


def fit_robust(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Extension: median and the distance of the positional quartiles."""
    mid = stats.median(df, columns)
    q = stats.order_statistics(df, columns, lambda n: [n // 4, 3 * n // 4])
    return {c: (mid[c], q[c][1][1] - q[c][1][0] if q[c][0] else None) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float | None, float | None]], spread_is_max: bool = False) -> DataFrame:
    """(x - centre) / spread where the spread exceeds 1e-8; other columns stay as they are."""
    out = {}
    for c, (centre, spread) in fitted.items():
        if centre is not None and spread is not None:
            spread = spread - centre if spread_is_max else spread
            if spread > _LEAST:
                out[c] = (_num(c) - centre) / spread
    return df.withColumns(out) if out else df


NORMALIZATIONS = ("standard", "minmax", "robust", "none")


@dataclass
class TabularConfig:
    columns: tuple[str, ...] = LAYOUT
    normalization: str = "standard"
    imputation: dict[str, str | float] = field(default_factory=dict)  # mean where a column is not named
    cap_factor: float = 1.5
    pad_to_10: bool = False
    nan_poison: bool = False

    def __post_init__(self):
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"normalization must be one of {NORMALIZATIONS}")


class TabularPreprocessor(Estimator):
    """Fit scaling statistics on raw rows; the model imputes, caps, derives features and scales."""

    def __init__(self, config: TabularConfig | None = None):
        super().__init__()
        self.config = config or TabularConfig()

    def with_normalization(self, kind: str) -> "TabularPreprocessor":
        self.config = TabularConfig(**{**self.config.__dict__, "normalization": kind})
        return self

    def with_imputation(self, column: str, rule: str | float) -> "TabularPreprocessor":
        self.config.imputation[column] = rule
        return self

    def _fit(self, df: DataFrame) -> "TabularModel":
        cols, kind = list(self.config.columns), self.config.normalization
        if kind == "standard":
            fitted = fit_standard(df, cols, self.config.nan_poison)
        elif kind == "minmax":
            fitted = fit_minmax(df, cols)
        else:
            fitted = fit_robust(df, cols) if kind == "robust" else {}
        return TabularModel(self.config, fitted)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class TabularModel(Model, Guarded):
    """impute -> cap -> derive -> scale. Fills and bounds come from the batch, scaling from the fit."""

    def __init__(self, config: TabularConfig, fitted: dict | None = None):
        super().__init__()
        self.config, self.fitted = config, fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted(self.fitted)
        c = self.config
        full = impute(df, {x: c.imputation.get(x, "mean") for x in c.columns})
        capped = cap(full, list(c.columns), c.cap_factor)
        made = clinical_features(capped, c.columns, c.pad_to_10)
        return scale(made, self.fitted, spread_is_max=c.normalization == "minmax")


PROFILES = {
    "vital_signs": TabularConfig(("systolic", "diastolic", "heart_rate", "temperature"), "standard"),
    "lab_results": TabularConfig(("glucose", "protein", "hemoglobin", "hematocrit"), "minmax"),
    "demographics": TabularConfig(("age", "weight", "height", "gestational_age"), "standard"),
}
