"""Temporal queries over the value series of each user."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..operators import fusion
from ..operators import temporal as ts
from ..session import scratch_dir
from ..streaming import windows as stream
from .fixtures import SERIES, fixture

_S, _O = ["series_id"], ["t"]


def _series(spark, sf_dir):
    return fixture(spark, sf_dir, SERIES)


def _rows(df, *cols, digits=6):
    return df.select("series_id", "t", *[F.round(c, digits).alias(c) for c in cols])


def _flat(wins):
    """Windows as rows (series_id, window_idx, start, i, v)."""
    return wins.select("series_id", "window_idx", "start", F.posexplode("values").alias("i", "x")).select("series_id", "window_idx", "start", "i", F.round("x.v", 8).alias("v"))


def _windows(size, stride=None, padding="forward"):
    return lambda spark, sf_dir: _flat(ts.windows(_series(spark, sf_dir), _S, _O, ["v"], size, stride, padding))


def _count(spark, sf_dir):
    return ts.windows(_series(spark, sf_dir), _S, _O, ["v"], 24, 12).groupBy("series_id").agg(F.count("*").alias("n_windows"), F.max("start").alias("last_start"))


def _pad(padding):
    """Series of fewer than 60 rows and those above it, by one padded window each."""

    def run(spark, sf_dir):
        return _flat(ts.windows(_series(spark, sf_dir), _S, _O, ["v"], 120, 60, padding))

    return run


def resample(spark, sf_dir):
    return _rows(ts.resample(_series(spark, sf_dir), _S, _O, ["v"], 100), "v")


def smooth(spark, sf_dir):
    return _rows(ts.smooth(_series(spark, sf_dir), _S, _O, ["v"], 3), "v")


def outlier_repair(spark, sf_dir):
    return _rows(ts.repair(_series(spark, sf_dir), _S, _O, ["v"]), "v")


def moving_avg(spark, sf_dir):
    return _rows(ts.moving_average(_series(spark, sf_dir), _S, _O, ["v"]), "v_ma")


def diff1(spark, sf_dir):
    return _rows(ts.differences(_series(spark, sf_dir), _S, _O, ["v"]), "v_d1")


def diff2(spark, sf_dir):
    return _rows(ts.differences(_series(spark, sf_dir), _S, _O, ["v"]), "v_d2")


def features(spark, sf_dir):
    return _rows(ts.features(_series(spark, sf_dir), _S, _O, ["v"]), "v", "v_ma", "v_d1", "v_d2")


def full_transform(spark, sf_dir):
    return _flat(ts.TemporalPreprocessor().fit(s := _series(spark, sf_dir)).transform(s))


def profile(name):
    return lambda spark, sf_dir: _flat(ts.TemporalPreprocessor(ts.PROFILES[name]).fit(s := _series(spark, sf_dir)).transform(s))


def label_rule(spark, sf_dir):
    df = _series(spark, sf_dir).select("series_id", F.col("v").alias("heart_rate"), (F.col("t") % 9 == 0).cast("double").alias("contractions"))
    return ts.label(df, _S)


def next_step(spark, sf_dir):
    out = ts.next_step_pairs(_series(spark, sf_dir), _S, _O, "v", 8)
    return out.select("series_id", "start", F.posexplode(F.arrays_zip("context", "target")).alias("i", "x")).select("series_id", "start", "i", F.round("x.context", 6).alias("context"), F.round("x.target", 6).alias("target"))


def split(spark, sf_dir):
    return ts.ratio_split(_series(spark, sf_dir), _S, _O, 0.8).select("series_id", "t", "split")


def augmented(spark, sf_dir):
    return _rows(ts.augment(_series(spark, sf_dir), _S, _O, ["v"], seed=5).withColumn("t", F.concat_ws(":", "t", "variant")), "v")


def risk_bands(spark, sf_dir):
    """Repair, smooth and standardise each user's values, cut windows and band their mean."""
    df = _series(spark, sf_dir)
    wins = ts.TemporalPreprocessor().fit(df).transform(df)
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("values")
    out = wins.select("series_id", "window_idx", F.round(mean, 6).alias("mean_value"))
    return out.withColumn("risk", fusion.risk_band(F.col("mean_value")))


def stream_windows(spark, sf_dir):
    """Daily totals of each event type, from a stream that is run to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = stream.read_events(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern may match a file or a folder
    out = f"{scratch_dir(spark)}/stream/{uuid.uuid4().hex}"
    stream.run_to_end(stream.windowed(events, "event_type", "value", "1 day"), f"{out}/rows", f"{out}/state", "complete")
    return spark.read.parquet(f"{out}/rows").select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


QUERIES = {
    "ts_windows_sliding": _windows(24, 12),
    "ts_windows_tumbling": _windows(24),
    "ts_windows_count": _count,
    **{f"ts_pad_{p}": _pad(p) for p in ts.PADDINGS},
    "ts_resample": resample,
    "ts_smooth": smooth,
    "ts_outlier_repair": outlier_repair,
    "ts_moving_avg": moving_avg,
    "ts_diff1": diff1,
    "ts_diff2": diff2,
    "ts_features": features,
    "ts_full_transform": full_transform,
    "ts_label_rule": label_rule,
    "ts_next_step_pairs": next_step,
    "ts_train_val_split": split,
    "ts_augment": augmented,
    "ts_profile_dosage": profile("dosage"),
    "ts_profile_vital_signs": profile("vital_signs"),
    "ts_risk_bands": risk_bands,
    "stream_daily_windows": stream_windows,
}

_W = f"WITH s AS ({SERIES}), n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1)"
_ORD = "PARTITION BY series_id ORDER BY t"


def _wins(size, stride, source="s"):
    """Full windows of series with ``size`` rows or more."""
    return f"""SELECT series_id, k AS window_idx, k * {stride} AS start, t - k * {stride} AS i, v
  FROM {source} JOIN n USING (series_id), range(0, 100000) AS r(k)
  WHERE n >= {size} AND k <= (n - {size}) // {stride} AND t >= k * {stride} AND t < k * {stride} + {size}"""


def _padded(size, padding, source="s"):
    """The one window of a shorter series."""
    a = {
        "zero": "CASE WHEN i < n THEN a[i + 1] ELSE 0e0 END",
        "forward": "a[least(i, n - 1) + 1]",
        "backward": f"a[greatest(i - ({size} - n), 0) + 1]",
        "mean": "CASE WHEN i < n THEN a[i + 1] ELSE list_sum(a) / n END",
        "linear": f"CASE WHEN i < n THEN a[i + 1] WHEN n < 2 THEN 0e0 ELSE a[n] + ((i - n + 1) * 1e0 / ({size} - n + 1)) * (a[n] - a[1]) END",
    }[padding]
    return f"""SELECT series_id, 0 AS window_idx, 0 AS start, i, {a} AS v
  FROM (SELECT series_id, n, list(v ORDER BY t) AS a FROM {source} JOIN n USING (series_id) WHERE n < {size} GROUP BY 1, 2), range({size}) AS r(i)"""


def _both(size, stride, padding="forward", source="s"):
    return f"SELECT series_id, window_idx::BIGINT AS window_idx, start::BIGINT AS start, i::INT AS i, round(v, 8) AS v FROM ({_wins(size, stride, source)} UNION ALL {_padded(size, padding, source)})"


_MEAN3 = f"CASE WHEN count(*) OVER ({_ORD} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN avg(v) OVER ({_ORD} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE v END"
_REPAIR = f"""SELECT series_id, t, CASE WHEN std > 0 AND abs(v - m) > 3 * std THEN coalesce((lag(v) OVER ({_ORD}) + lead(v) OVER ({_ORD})) / 2, lag(v) OVER ({_ORD}), lead(v) OVER ({_ORD})) ELSE v END AS v
  FROM (SELECT *, avg(v) OVER (PARTITION BY series_id) AS m, stddev_samp(v) OVER (PARTITION BY series_id) AS std FROM s)"""
_CLEAN = f"rep AS ({_REPAIR}), smo AS (SELECT series_id, t, {_MEAN3} AS v FROM rep), nor AS (SELECT series_id, t, (v - (SELECT avg(v) FROM s)) / (SELECT stddev_samp(v) FROM s) AS v FROM smo)"
_D1 = f"coalesce(v - lag(v) OVER ({_ORD}), 0e0)"
_D2 = f"coalesce((v - lag(v) OVER ({_ORD})) - (lag(v) OVER ({_ORD}) - lag(v, 2) OVER ({_ORD})), 0e0)"
_MA_ROWS = f"SELECT series_id, t, v, CASE WHEN t < least(n // 4, 10) THEN 0e0 ELSE list_avg(a[t + 1 - least(n // 4, 10):t + 1]) END AS v_ma FROM s JOIN (SELECT series_id, count(*) AS n, list(v ORDER BY t) AS a FROM s GROUP BY 1) USING (series_id)"

ORACLE = {
    "ts_windows_sliding": f"{_W} {_both(24, 12)}",
    "ts_windows_tumbling": f"{_W} {_both(24, 24)}",
    "ts_windows_count": f"{_W} SELECT series_id, CASE WHEN n < 24 THEN 1 ELSE (n - 24) // 12 + 1 END AS n_windows, CASE WHEN n < 24 THEN 0 ELSE (n - 24) // 12 * 12 END AS last_start FROM n",
    **{f"ts_pad_{p}": f"{_W} {_both(120, 60, p)}" for p in ts.PADDINGS},
    "ts_resample": f"""{_W}, a AS (SELECT series_id, n, list(v ORDER BY t) AS a FROM s JOIN n USING (series_id) GROUP BY 1, 2),
p AS (SELECT series_id, n, a, i::INT AS t, CASE WHEN n = 100 THEN i * 1e0 ELSE i * (n / 100e0) END AS src FROM a, range(100) AS r(i))
SELECT series_id, t, round(a[floor(src)::INT + 1] + (src - floor(src)) * (a[least(floor(src)::INT + 1, n - 1) + 1] - a[floor(src)::INT + 1]), 6) AS v FROM p""",
    "ts_smooth": f"{_W} SELECT series_id, t, round({_MEAN3}, 6) AS v FROM s",
    "ts_outlier_repair": f"{_W} SELECT series_id, t, round(v, 6) AS v FROM ({_REPAIR})",
    "ts_moving_avg": f"{_W} SELECT series_id, t, round(v_ma, 6) AS v_ma FROM ({_MA_ROWS})",
    "ts_diff1": f"{_W} SELECT series_id, t, round({_D1}, 6) AS v_d1 FROM s",
    "ts_diff2": f"{_W} SELECT series_id, t, round({_D2}, 6) AS v_d2 FROM s",
    "ts_features": f"{_W} SELECT series_id, t, round(v, 6) AS v, round(v_ma, 6) AS v_ma, round({_D1}, 6) AS v_d1, round({_D2}, 6) AS v_d2 FROM ({_MA_ROWS})",
    "ts_full_transform": f"{_W}, {_CLEAN} {_both(24, 12, 'forward', 'nor')}",
    "ts_label_rule": f"{_W} SELECT series_id, (avg(v) > 90 OR sum(CASE WHEN t % 9 = 0 THEN 1 ELSE 0 END) > 5)::INT AS label FROM s GROUP BY 1",
    "ts_next_step_pairs": f"""{_W} SELECT x.series_id, x.t AS start, i::INT AS i, round(c.v, 6) AS context, round(g.v, 6) AS target
FROM s x JOIN n USING (series_id), range(8) AS r(i), s c, s g
WHERE x.t + 8 < n.n AND c.series_id = x.series_id AND c.t = x.t + i AND g.series_id = x.series_id AND g.t = x.t + i + 1""",
    "ts_train_val_split": f"{_W} SELECT series_id, t, CASE WHEN t < floor(n * 0.8e0) THEN 'train' ELSE 'validation' END AS split FROM s JOIN n USING (series_id)",
    "ts_augment": f"""{_W} SELECT series_id, t || ':original' AS t, round(v, 6) AS v FROM s
UNION ALL SELECT series_id, t || ':warped' AS t, round(CASE WHEN {uniform_sql(5, 0, 'series_id', 't')} < 0.5e0 THEN coalesce(lag(v) OVER ({_ORD}), v) ELSE v END, 6) AS v FROM s
UNION ALL SELECT series_id, t || ':noisy' AS t, round(v * (1 + ({uniform_sql(5, 1, 'series_id', 't')} * 2 - 1) * 0.05e0), 6) AS v FROM s
UNION ALL SELECT series_id, t || ':scaled' AS t, round(v * {random.Random(5).uniform(0.9, 1.1)!r}::DOUBLE, 6) AS v FROM s""",
    "ts_profile_dosage": f"{_W}, {_CLEAN} {_both(24, 12, 'zero', 'nor')}",
    "ts_profile_vital_signs": f"{_W}, {_CLEAN} {_both(60, 30, 'forward', 'nor')}",
    "ts_risk_bands": f"""{_W}, {_CLEAN}, w AS (SELECT series_id, window_idx, round(avg(v), 6) AS mean_value FROM ({_wins(24, 12, 'nor')} UNION ALL {_padded(24, 'forward', 'nor')}) GROUP BY 1, 2)
SELECT series_id, window_idx::BIGINT AS window_idx, mean_value, CASE WHEN mean_value > 0.7e0 THEN 'High' WHEN mean_value > 0.3e0 THEN 'Medium' ELSE 'Low' END AS risk FROM w""",
    "stream_daily_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
}
