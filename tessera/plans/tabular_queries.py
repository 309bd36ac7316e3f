"""Tabular queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import base
from ..operators import tabular as tab
from .fixtures import CLINICAL, SERIES_NULLS, TAB_NULLS, fixture

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_MEASURES = ["quantity", "price", "discount"]


def _rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[F.round(F.col(c), digits).alias(c) for c in columns])


def _clinical(spark, sf_dir):
    return fixture(spark, sf_dir, CLINICAL)


def _nulls(spark, sf_dir):
    return fixture(spark, sf_dir, TAB_NULLS)


def _impute(rule):
    return lambda spark, sf_dir: _rounded(tab.impute(_nulls(spark, sf_dir), dict.fromkeys(_MEASURES, rule)), _KEY, _MEASURES)


def impute_forward(spark, sf_dir):
    return _rounded(tab.impute_forward(fixture(spark, sf_dir, SERIES_NULLS), ["v"], ["ts", "event_id"], ["series_id"]), ["series_id", "event_id"], ["v"])


def iqr_cap(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return _rounded(tab.cap(orders, ["price"]), ["o_orderkey"], ["price"])


def iqr_cap_bounds(spark, sf_dir):
    from ..operators.stats import quartile_bounds

    lo, hi = quartile_bounds(spark.read.parquet(f"{sf_dir}/events.parquet"), ["value"])["value"]
    return spark.createDataFrame([(lo, hi)], "low double, high double").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _scaled(fit, **how):
    def run(spark, sf_dir):
        df = _nulls(spark, sf_dir)
        return _rounded(tab.scale(df, fit(df, _MEASURES), **how), _KEY, _MEASURES)

    return run


def constant_guard(spark, sf_dir):
    df = _clinical(spark, sf_dir).select("id", F.lit(3.0).alias("fixed"), "age")
    std = tab.scale(df, tab.fit_standard(df, ["fixed", "age"]))
    mm = tab.scale(df, tab.fit_minmax(df, ["fixed", "age"]), spread_is_max=True)
    both = std.select("id", F.col("fixed").alias("std_fixed"), F.round("age", 6).alias("std_age")).join(mm.select("id", F.col("fixed").alias("mm_fixed"), F.round("age", 6).alias("mm_age")), "id")
    return both


def clinical_features(spark, sf_dir):
    return _rounded(tab.clinical_features(_clinical(spark, sf_dir)), ["id"], ["bmi", "bp_category", "age_risk", "glucose_category"])


def _one(name, column):
    return lambda spark, sf_dir: _rounded(_clinical(spark, sf_dir).withColumn(name, column()), ["id"], [name])


def full_transform(spark, sf_dir):
    df = _clinical(spark, sf_dir).withColumns({c: F.when(F.col("id") % k == 0, None).otherwise(F.col(c)) for c, k in (("glucose", 9), ("weight", 13))})
    out = tab.TabularPreprocessor(tab.TabularConfig(imputation={"weight": "median"})).fit_transform(df)
    return _rounded(out, ["id"], [*tab.LAYOUT, "bmi", "bp_category", "age_risk", "glucose_category"], 5)


def clinical_rules(spark, sf_dir):
    return _rounded(tab.clinical_rules(_clinical(spark, sf_dir)), ["id"], ["weight", "systolic", "hypertension"])


def clinical_rules_positional(spark, sf_dir):
    return _rounded(tab.clinical_rules(_clinical(spark, sf_dir), layout=tab.LAYOUT), ["id"], list(tab.LAYOUT))


def label_rule(spark, sf_dir):
    return _clinical(spark, sf_dir).select("id", tab.risk_label().alias("label"))


def robust(spark, sf_dir):
    df = _clinical(spark, sf_dir)
    return _rounded(tab.scale(df, tab.fit_robust(df, ["weight", "glucose"])), ["id"], ["weight", "glucose"])


def all_missing(spark, sf_dir):
    """A column without any value stays without, but for a constant; others are filled beside it."""
    df = _clinical(spark, sf_dir).withColumns({"gap": F.lit(None).cast("double"), "held": F.lit(None).cast("double"), "weight": F.when(F.col("id") % 13 != 0, F.col("weight"))})
    return _rounded(tab.impute(df, {"gap": "mean", "held": 3.0, "weight": "mean"}), ["id"], ["gap", "held", "weight"])


def profile(spark, sf_dir):
    config = tab.PROFILES["demographics"]
    return _rounded(tab.TabularPreprocessor(config).fit_transform(_clinical(spark, sf_dir)), ["id"], list(config.columns), 5)


def builders(spark, sf_dir):
    """A preprocessor changed step by step, held by name and fitted at its first use."""
    df = _clinical(spark, sf_dir).withColumn("weight", F.when(F.col("id") % 13 != 0, F.col("weight")))
    held = base.Profiles({"own": lambda: tab.TabularPreprocessor().with_normalization("minmax").with_imputation("weight", 60.0)})
    before = held.is_fitted("own")
    out = held.apply("own", df)
    return _rounded(out, ["id"], ["weight", "glucose"], 5).withColumn("lazily", F.lit(not before and held.is_fitted("own")))


QUERIES = {
    "tab_impute_all_missing": all_missing,
    "tab_profile_demographics": profile,
    "tab_builders": builders,
    "tab_impute_mean": _impute("mean"),
    "tab_impute_median": _impute("median"),
    "tab_impute_mode": _impute("mode"),
    "tab_impute_constant": _impute(7.5),
    "tab_impute_forward": impute_forward,
    "tab_iqr_cap": iqr_cap,
    "tab_iqr_cap_bounds": iqr_cap_bounds,
    "tab_standardize": _scaled(tab.fit_standard),
    "tab_minmax": _scaled(tab.fit_minmax, spread_is_max=True),
    "tab_robust": robust,
    "tab_constant_column_guard": constant_guard,
    "tab_clinical_features": clinical_features,
    "tab_bmi": _one("bmi", tab.bmi),
    "tab_bp_category": _one("bp_category", tab.bp_category),
    "tab_age_risk": _one("age_risk", tab.age_risk),
    "tab_glucose_category": _one("glucose_category", tab.glucose_category),
    "tab_full_transform": full_transform,
    "tab_clinical_rules": clinical_rules,
    "tab_clinical_rules_positional": clinical_rules_positional,
    "tab_label_rule": label_rule,
}

_T = f"WITH t AS ({TAB_NULLS})"
_C = f"WITH c AS ({CLINICAL})"
_K = ", ".join(_KEY)


def _filled(expr):
    return ", ".join(f"round(coalesce({m}, {expr.format(m=m)}), 6) AS {m}" for m in _MEASURES)


_BMI = "CASE WHEN height > 0 THEN weight / (height * height) ELSE 0 END"
_BP = "CASE WHEN systolic >= 140 OR diastolic >= 90 THEN 2e0 WHEN systolic >= 120 OR diastolic >= 80 THEN 1e0 ELSE 0e0 END"
_AGE = "CASE WHEN age >= 35 THEN 2e0 WHEN age < 20 THEN 1e0 ELSE 0e0 END"
_GLU = "CASE WHEN glucose >= 126 THEN 2e0 WHEN glucose >= 100 THEN 1e0 ELSE 0e0 END"


def _bounds(c, source):
    return f"""(SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM (
      SELECT s[len(s) // 4 + 1] AS q1, s[3 * len(s) // 4 + 1] AS q3 FROM (SELECT list_sort(list({c})) AS s FROM {source} WHERE {c} IS NOT NULL)))"""


def _chain():
    cols = list(tab.LAYOUT)
    gaps = {"glucose": 9, "weight": 13}
    raw = ", ".join(f"CASE WHEN id % {gaps[c]} = 0 THEN NULL ELSE {c} END AS {c}" if c in gaps else c for c in cols)
    fill = ", ".join(f"coalesce({c}, (SELECT {'median' if c == 'weight' else 'avg'}({c}) FROM r)) AS {c}" for c in cols)
    capped = ", ".join(f"greatest(least({c}, (SELECT hi FROM {_bounds(c, 'f')})), (SELECT lo FROM {_bounds(c, 'f')})) AS {c}" for c in cols)
    scaled = ", ".join(f"round(({c} - (SELECT avg({c}) FROM r)) / (SELECT stddev_samp({c}) FROM r), 5) AS {c}" for c in cols)
    return f"""{_C}, r AS (SELECT id, {raw} FROM c), f AS (SELECT id, {fill} FROM r), k AS (SELECT id, {capped} FROM f)
SELECT id, {scaled}, round({_BMI}, 5) AS bmi, {_BP} AS bp_category, {_AGE} AS age_risk, {_GLU} AS glucose_category FROM k"""


def _capped(c, source):
    return f"greatest(least({c}, (SELECT hi FROM {_bounds(c, source)})), (SELECT lo FROM {_bounds(c, source)}))"


_W13 = f"{_C}, r AS (SELECT * REPLACE (CASE WHEN id % 13 <> 0 THEN weight END AS weight) FROM c)"

ORACLE = {
    "tab_impute_all_missing": f"{_W13} SELECT id, NULL::DOUBLE AS gap, 3e0 AS held, round(coalesce(weight, (SELECT avg(weight) FROM r)), 6) AS weight FROM r",
    "tab_profile_demographics": f"{_C} SELECT id, " + ", ".join(f"round(({_capped(c, 'c')} - (SELECT avg({c}) FROM c)) / (SELECT stddev_samp({c}) FROM c), 5) AS {c}" for c in tab.PROFILES["demographics"].columns) + " FROM c",
    "tab_builders": f"{_W13}, f AS (SELECT * REPLACE (coalesce(weight, 60e0) AS weight) FROM r) SELECT id, " + ", ".join(f"round(({_capped(c, 'f')} - (SELECT min({c}) FROM r)) / (SELECT max({c}) - min({c}) FROM r), 5) AS {c}" for c in ("weight", "glucose")) + ", true AS lazily FROM f",
    "tab_impute_mean": f"{_T} SELECT {_K}, {_filled('(SELECT avg({m}) FROM t)')} FROM t",
    "tab_impute_median": f"{_T} SELECT {_K}, {_filled('(SELECT median({m}) FROM t)')} FROM t",
    "tab_impute_mode": f"{_T} SELECT {_K}, {_filled('(SELECT b / 100e0 FROM (SELECT trunc({m} * 100)::BIGINT AS b, count(*) AS n FROM t WHERE {m} IS NOT NULL GROUP BY 1 ORDER BY n DESC, b LIMIT 1))')} FROM t",
    "tab_impute_constant": f"{_T} SELECT {_K}, {_filled('7.5e0')} FROM t",
    "tab_impute_forward": f"""WITH s AS ({SERIES_NULLS})
SELECT series_id, event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM s""",
    "tab_iqr_cap": f"SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 6) AS price FROM orders, {_bounds('o_totalprice', 'orders')}",
    "tab_iqr_cap_bounds": f"SELECT round(lo, 6) AS low, round(hi, 6) AS high FROM {_bounds('value', 'events')}",
    "tab_standardize": f"{_T} SELECT {_K}, " + ", ".join(f"round(({m} - (SELECT avg({m}) FROM t)) / (SELECT stddev_samp({m}) FROM t), 6) AS {m}" for m in _MEASURES) + " FROM t",
    "tab_minmax": f"{_T} SELECT {_K}, " + ", ".join(f"round(({m} - (SELECT min({m}) FROM t)) / (SELECT max({m}) - min({m}) FROM t), 6) AS {m}" for m in _MEASURES) + " FROM t",
    "tab_robust": f"{_C} SELECT id, " + ", ".join(f"round(({m} - (SELECT median({m}) FROM c)) / (SELECT s[3 * len(s) // 4 + 1] - s[len(s) // 4 + 1] FROM (SELECT list_sort(list({m})) AS s FROM c)), 6) AS {m}" for m in ("weight", "glucose")) + " FROM c",
    "tab_constant_column_guard": f"{_C} SELECT id, 3e0 AS std_fixed, round((age - (SELECT avg(age) FROM c)) / (SELECT stddev_samp(age) FROM c), 6) AS std_age, 3e0 AS mm_fixed, round((age - (SELECT min(age) FROM c)) / (SELECT max(age) - min(age) FROM c), 6) AS mm_age FROM c",
    "tab_clinical_features": f"{_C} SELECT id, round({_BMI}, 6) AS bmi, {_BP} AS bp_category, {_AGE} AS age_risk, {_GLU} AS glucose_category FROM c",
    "tab_bmi": f"{_C} SELECT id, round({_BMI}, 6) AS bmi FROM c",
    "tab_bp_category": f"{_C} SELECT id, {_BP} AS bp_category FROM c",
    "tab_age_risk": f"{_C} SELECT id, {_AGE} AS age_risk FROM c",
    "tab_glucose_category": f"{_C} SELECT id, {_GLU} AS glucose_category FROM c",
    "tab_full_transform": _chain(),
    "tab_clinical_rules": f"{_C} SELECT id, round(CASE WHEN age > 35 THEN weight * 1.2e0 ELSE weight END, 6) AS weight, round(CASE WHEN {_BMI} > 30 THEN systolic * 1.15e0 ELSE systolic END, 6) AS systolic, CASE WHEN systolic > 140 THEN 1e0 ELSE 0e0 END AS hypertension FROM c",
    "tab_clinical_rules_positional": f"{_C} SELECT id, age, round(CASE WHEN age > 35 THEN weight * 1.2e0 ELSE weight END, 6) AS weight, round(height, 6) AS height, round(CASE WHEN height > 30 THEN systolic * 1.15e0 ELSE systolic END, 6) AS systolic, diastolic, CASE WHEN diastolic > 140 THEN 1e0 ELSE glucose END AS glucose, gestational_age, hemoglobin, pregnancies, risk_factors FROM c",
    "tab_label_rule": f"{_C} SELECT id, (CASE WHEN age > 35 THEN 3 ELSE 0 END + CASE WHEN systolic > 140 OR diastolic > 90 THEN 4 ELSE 0 END + CASE WHEN glucose > 126 THEN 3 ELSE 0 END > 5)::INT AS label FROM c",
}
