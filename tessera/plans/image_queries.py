"""Image queries over the embedding vectors, read as 8 x 8 grey images."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..operators import image as im
from ..session import spread
from .fixtures import GRIDS_DUCK, GRIDS_SPARK, fixture


def _vectors(spark, sf_dir):
    return spread(fixture(spark, sf_dir, GRIDS_SPARK))


def _placed(df):
    """``df`` with the 64 places of the grid that the SQL reads: NULL where a vector has no value, nothing after the last one."""
    p = F.col("pixels")
    return df.withColumn("pixels", F.when(F.size(p) == 64, p).otherwise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(p, i))))


def _grids(spark, sf_dir):
    return _placed(_vectors(spark, sf_dir))


def _flat(df, digits=8):
    return im.held(df).select("image_id", F.posexplode("pixels").alias("i", "v")).select("image_id", "i", F.round("v", digits).alias("v"))


def _map(column):
    return lambda spark, sf_dir: _flat(_grids(spark, sf_dir).withColumn("pixels", column()))


def _unit():
    return F.transform("pixels", lambda v: v / 255)


def _on_unit(column):
    return lambda spark, sf_dir: _flat(_grids(spark, sf_dir).withColumn("pixels", _unit()).withColumn("pixels", column()))


def sobel(spark, sf_dir):
    out = _grids(spark, sf_dir).select("image_id", F.posexplode(im.sobel()).alias("i", "e"))
    return out.select("image_id", "i", F.round("e.magnitude", 6).alias("magnitude"), F.round("e.direction", 6).alias("direction"))


def feature_stack(spark, sf_dir):
    out = im.feature_stack(_grids(spark, sf_dir))
    return out.select("image_id", "channels", F.size("pixels").alias("n"), F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


def fit(spark, sf_dir):
    mean, std = im.ImagePreprocessor().fit(_vectors(spark, sf_dir)).fitted
    return spark.createDataFrame([(mean, std)], "mean double, std double").select(F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def process(spark, sf_dir):
    grids = _vectors(spark, sf_dir)
    return _flat(im.ImagePreprocessor().fit(grids).transform(grids))


def augment(spark, sf_dir):
    out = im.augment(_grids(spark, sf_dir).withColumn("pixels", _unit()), "image_id", seed=3)
    return _flat(out.withColumn("image_id", F.concat_ws(":", "image_id", "variant")))


def resize(spark, sf_dir):
    return _flat(im.resize(_grids(spark, sf_dir), 4))


def failed_batch(spark, sf_dir):
    """A batch in which every third image has lost pixels: those become zero images."""
    grids = _vectors(spark, sf_dir)
    broken = F.when(F.col("image_id") % 6 == 0, F.slice("pixels", 1, 9)).when(F.col("image_id") % 3 == 0, None).otherwise(F.col("pixels"))
    return _flat(im.ImagePreprocessor().fit(grids).transform(grids.withColumn("pixels", broken)))


def luma(spark, sf_dir):
    p = F.col("pixels")
    return _flat(_grids(spark, sf_dir).withColumn("pixels", im.to_luma(p, F.reverse(p), F.transform(p, lambda v: 255 - v))))


def minmax(spark, sf_dir):
    """Least and largest are those of the whole vector, also where it is longer than the grid."""
    return _flat(_placed(im.held(_vectors(spark, sf_dir).withColumn("pixels", im.normalize("minmax")))))


QUERIES = {
    "img_luma": luma,
    "img_equalize": lambda spark, sf_dir: _flat(im.equalize(_grids(spark, sf_dir))),
    "img_blur3": _map(im.blur),
    "img_minmax": minmax,
    "img_zscore": _map(lambda: im.normalize("zscore")),
    "img_clahe_identity": _map(lambda: im.normalize("clahe")),
    "img_flip": _map(im.flip),
    "img_rotate": _map(lambda: im.rotate(30.0)),
    "img_brightness": _on_unit(lambda: im.brightness(1.7)),
    "img_contrast": _on_unit(lambda: im.contrast(1.5)),
    "img_zoom": _map(lambda: im.zoom(1.5)),
    "img_sobel": sobel,
    "img_lbp": _map(im.lbp),
    "img_feature_stack": feature_stack,
    "img_fit": fit,
    "img_process": process,
    "img_augment": augment,
    "img_resize": resize,
    "img_failed_batch": failed_batch,
}

_G = f"WITH g AS ({GRIDS_DUCK}), x AS (SELECT image_id, i, i // 8 AS y, i % 8 AS x, pixels[i + 1] AS v, pixels AS p FROM g, range(64) AS r(i))"
_IN = "y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"


def _at(dy, dx):
    return f"p[i + {1 + 8 * dy + dx}]" if 1 + 8 * dy + dx >= 0 else f"p[i - {-(1 + 8 * dy + dx)}]"


_BLUR = " + ".join(f"{k} * {_at(dy, dx)}" for dy, row in zip((-1, 0, 1), ((1, 2, 1), (2, 4, 2), (1, 2, 1))) for dx, k in zip((-1, 0, 1), row))
_GX = f"({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)})"
_GY = f"({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)})"
_LBP = " + ".join(f"CASE WHEN {_at(dy, dx)} >= v THEN {1 << k} ELSE 0 END" for k, (dy, dx) in enumerate(((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))))
_MAG, _DIR = f"CASE WHEN {_IN} THEN sqrt({_GX} * {_GX} + {_GY} * {_GY}) ELSE 0e0 END", f"CASE WHEN {_IN} THEN atan2({_GY}, {_GX}) ELSE 0e0 END"
_LBPV = f"CASE WHEN {_IN} THEN ({_LBP}) / 255e0 ELSE 0e0 END"
_EQ = "floor((count(*) OVER (PARTITION BY image_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 255e0 / 64)"


def _px(expr, source="x"):
    return f"SELECT image_id, i::INT AS i, round({expr}, 8) AS v FROM {source}"


_PROC = f"""{_G}, e AS (SELECT image_id, i, y, x, {_EQ} AS v FROM x), el AS (SELECT image_id, list(v ORDER BY i) AS p FROM e GROUP BY 1),
b AS (SELECT image_id, i, CASE WHEN {_IN} THEN floor(({_BLUR}) / 16) ELSE v END AS v FROM e JOIN el USING (image_id)),
f AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM b WHERE image_id IN (SELECT image_id FROM g ORDER BY image_id LIMIT 100))"""

_BILINEAR = "CASE WHEN sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 THEN p[y0 * 8 + x0 + 1] * (1 - fx) * (1 - fy) + p[y0 * 8 + x1 + 1] * fx * (1 - fy) + p[y1 * 8 + x0 + 1] * (1 - fx) * fy + p[y1 * 8 + x1 + 1] * fx * fy ELSE 0e0 END"


def _turned(angle, source="x"):
    a = f"radians({angle!r}::DOUBLE)"
    return f"""s AS (SELECT *, (x - 4e0) * cos({a}) - (y - 4e0) * sin({a}) + 4e0 AS sx, (x - 4e0) * sin({a}) + (y - 4e0) * cos({a}) + 4e0 AS sy FROM {source}),
q AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy, least(floor(sx)::INT + 1, 7) AS x1, least(floor(sy)::INT + 1, 7) AS y1 FROM s)"""


def _augmented(seed=3):
    rng = random.Random(seed)
    angle, light, gap, scale = rng.uniform(-15, 15), rng.uniform(0.8, 1.2), rng.uniform(0.8, 1.2), rng.uniform(1.0, 1.2)
    mean = "avg(v) OVER (PARTITION BY image_id)"
    side = math.floor(8 / scale)
    noise = f"sqrt(-2 * ln(1 - {uniform_sql(seed, 0, 'image_id', 'i')})) * cos(2 * pi() * {uniform_sql(seed, 1, 'image_id', 'i')})"
    made = {
        "original": ("v", "u"), "flip": ("p[y * 8 + 8 - x]", "u"), "rotate": (_BILINEAR, "q"),
        "brightness": (f"greatest(least(v * {light!r}::DOUBLE, 1e0), 0e0)", "u"), "contrast": (f"greatest(least({mean} + (v - {mean}) * {gap!r}::DOUBLE, 1e0), 0e0)", "u"),
        "noise": (f"greatest(least(v + 0.02e0 * {noise}, 1e0), 0e0)", "u"),
        "zoom": (f"p[({(8 - side) // 2} + y * {side} // 8) * 8 + ({(8 - side) // 2} + x * {side} // 8) + 1]", "u"),
    }
    unit = "u AS (SELECT image_id, i, y, x, v / 255 AS v, list_transform(p, lambda e: e / 255) AS p FROM x)"
    return f"{_G}, {unit}, {_turned(angle, 'u')} " + " UNION ALL ".join(f"SELECT image_id::VARCHAR || ':{name}' AS image_id, i::INT AS i, round({expr}, 8) AS v FROM {source}" for name, (expr, source) in made.items())


# Triangle weights of an 8 to 4 reduction: centres at 0.5, 2.5, ..., reaching two pixels to each side.
_WEIGHT = "greatest(0e0, 1 - abs({j} - (({i} + 0.5e0) * 2 - 0.5e0)) / 2)"
_RESIZE = f"""{_G}, w AS (SELECT a, j, w / sum(w) OVER (PARTITION BY a) AS w FROM (SELECT a, j, {_WEIGHT.format(i='a', j='j')} AS w FROM range(4) AS o(a), range(8) AS k(j)))
SELECT image_id, (r.a * 4 + c.a)::INT AS i, round(sum(v * r.w * c.w), 8) AS v FROM x JOIN w r ON r.j = x.y JOIN w c ON c.j = x.x GROUP BY image_id, r.a, c.a"""

ORACLE = {
    "img_augment": _augmented(),
    "img_resize": _RESIZE,
    "img_failed_batch": f"{_PROC} SELECT image_id, i::INT AS i, CASE WHEN image_id % 3 = 0 THEN 0e0 ELSE round((v - m) / s, 8) END AS v FROM b, f",
    "img_luma": f"{_G} " + _px("floor((v * 2126 + p[64 - i] * 7152 + (255 - v) * 722) / 10000e0)"),
    "img_equalize": f"{_G} " + _px(_EQ),
    "img_blur3": f"{_G} " + _px(f"CASE WHEN {_IN} THEN floor(({_BLUR}) / 16) ELSE v END"),
    "img_minmax": f"{_G} " + _px("CASE WHEN list_max(p) > list_min(p) THEN (v - list_min(p)) / (list_max(p) - list_min(p)) ELSE v END"),
    "img_zscore": f"{_G} " + _px("CASE WHEN stddev_samp(v) OVER (PARTITION BY image_id) > 1e-8 THEN (v - avg(v) OVER (PARTITION BY image_id)) / stddev_samp(v) OVER (PARTITION BY image_id) ELSE v END"),
    "img_clahe_identity": f"{_G} " + _px("v"),
    "img_flip": f"{_G} " + _px("p[y * 8 + 8 - x]"),
    "img_rotate": f"{_G}, {_turned(30.0)} " + _px(_BILINEAR, "q"),
    "img_brightness": f"{_G} " + _px("greatest(least(v / 255 * 1.7e0, 1e0), 0e0)"),
    "img_contrast": f"{_G} " + _px("greatest(least(avg(v / 255) OVER (PARTITION BY image_id) + (v / 255 - avg(v / 255) OVER (PARTITION BY image_id)) * 1.5e0, 1e0), 0e0)"),
    "img_zoom": f"{_G} " + _px("p[(1 + y * 5 // 8) * 8 + (1 + x * 5 // 8) + 1]"),
    "img_sobel": f"{_G} SELECT image_id, i::INT AS i, round({_MAG}, 6) AS magnitude, round({_DIR}, 6) AS direction FROM x",
    "img_lbp": f"{_G} " + _px(_LBPV),
    "img_feature_stack": f"{_G} SELECT image_id, 4 AS channels, 256 AS n, round(sum(v) + sum({_MAG}) + sum({_DIR}) + sum({_LBPV}), 3) AS total FROM x GROUP BY 1",
    "img_fit": f"{_PROC} SELECT round(m, 8) AS mean, round(s, 8) AS std FROM f",
    "img_process": f"{_PROC} SELECT image_id, i::INT AS i, round((v - m) / s, 8) AS v FROM b, f",
}
