"""Image operators on rows (image_id, channels, height, width, pixels): pixels are doubles, channel by channel, row by row.

Kernels are array expressions over places, so an image never leaves its row and keys play no part; only resizing
uses more: it multiplies by two small matrices in NumPy.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .base import Guarded

#: Images that a fit reads, those with the smallest ids.
FIT_IMAGES = 100
_NORMS = ("minmax", "zscore", "histogram", "clahe", "none")


@dataclass(frozen=True)
class Grid:
    """Names of the columns that hold an image."""

    pixels: str = "pixels"
    channels: str = "channels"
    height: str = "height"
    width: str = "width"

    def cols(self) -> tuple[Column, Column, Column, Column]:
        return F.col(self.pixels), F.col(self.channels), F.col(self.height), F.col(self.width)


GRID = Grid()


def _each(p: Column, f) -> Column:
    """``f(place)`` for every place of a pixel array; empty arrays stay empty."""
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.size(p) - 1), f)).otherwise(p)


def _parts(i: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """(y, x) of a place within its channel."""
    return F.floor(F.pmod(i, h * w) / w).cast("int"), F.pmod(i, w)


def _inner(y: Column, x: Column, h: Column, w: Column) -> Column:
    return (y >= 1) & (y < h - 1) & (x >= 1) & (x < w - 1)


def _whole(v: Column) -> Column:
    """``floor`` as a double: NaN, infinities and what else a long can't hold are whole as they are."""
    return F.when(F.abs(v) < 9e15, F.floor(v).cast("double")).otherwise(v)


def to_luma(red: Column, green: Column, blue: Column) -> Column:
    """8-bit grey of three pixel arrays by the usual weights (an approximation of the decoder's own)."""
    rgb = F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))
    return F.transform(rgb, lambda v: _whole((v["r"] * 2126 + v["g"] * 7152 + v["b"] * 722) / 10000))


def resize(df: DataFrame, size: int, g: Grid = GRID) -> DataFrame:
    """Triangle-filtered resize of every channel to ``size`` x ``size``.

    Missing pixels add nothing; a channel without a pixel, or an image without an array, has none afterwards.
    """

    def weights(n: int) -> np.ndarray:
        ratio = n / size
        reach = max(ratio, 1.0)
        centre = (np.arange(size)[:, None] + 0.5) * ratio - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre) / reach)
        return w / w.sum(axis=1, keepdims=True)

    rest = [c for c in df.columns if c not in (g.pixels, g.height, g.width)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{g.height}` int, `{g.width}` int, `{g.pixels}` array<double>"])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index
            out = []
            for p, c, h, w in zip(b.column(at(g.pixels)).to_pylist(), *(b.column(at(x)).to_pylist() for x in (g.channels, g.height, g.width))):
                if p is None:
                    out.append(None)
                    continue
                img = np.array(p, float).reshape(c, h, w)
                lost = np.array([v is None for v in p]).reshape(c, h, w) if None in p else np.zeros((c, 1, 1), bool)
                img[np.broadcast_to(lost, img.shape)] = 0
                made = (weights(h) @ img @ weights(w).T).reshape(c, size * size).tolist()
                out.append([v for none, row in zip(lost.all(axis=(1, 2)), made) for v in ([None] * len(row) if none else row)])
            n = pa.array([size] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in rest), n, n, pa.array(out, pa.list_(pa.float64()))], names=[*rest, g.height, g.width, g.pixels])

    return df.mapInArrow(run, schema)


def equalize(df: DataFrame, g: Grid = GRID) -> DataFrame:
    """Pixels 0..255 replaced by the truncated share of pixels up to their value, times 255.

    The shares of the 256 values come from the sorted pixels of the row itself, so nothing is joined or shuffled.
    An image with pixels outside that range has no such table: each pixel is looked up among the sorted ones.
    """
    p = F.col(g.pixels)
    level = lambda v: F.coalesce(F.floor(v), F.lit(0))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def mapped(s: Column) -> Column:
        """The new pixels; ``s`` are the old ones, rising."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        upto = lambda v, at: F.coalesce(F.get(F.filter(at, lambda i: F.get(s, i) > v), F.lit(0)), F.size(s))
        share = lambda v, at: F.floor(upto(v, at).cast("long") * 255 / F.size(s)).cast("double")
        table = let(starts, lambda at: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: share(v, at)))
        known = let(table, lambda t: F.transform(p, lambda v: F.get(t, level(v).cast("int"))))
        inside = (F.get(s, F.lit(0)) >= 0) & (F.get(s, F.size(s) - 1) <= 255)
        return F.when(inside, known).otherwise(let(starts, lambda at: F.transform(p, lambda v: share(level(v), at))))

    new = let(F.array_sort(F.transform(p, level)), mapped)
    return df.withColumn(g.pixels, F.when(F.size(p) > 0, new).otherwise(p))


def blur(g: Grid = GRID) -> Column:
    """3 x 3 binomial kernel, truncated; border pixels are copied."""
    p, _, h, w = g.cols()

    def at(i):
        y, x = _parts(i, h, w)
        s = sum(k * F.get(p, i + dy * w + dx) for dy, row in zip((-1, 0, 1), ((1, 2, 1), (2, 4, 2), (1, 2, 1))) for dx, k in zip((-1, 0, 1), row))
        return F.when(_inner(y, x, h, w), F.floor(s / 16).cast("double")).otherwise(F.get(p, i))

    return _each(p, at)


def _mean(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / F.size(p)


def normalize(kind: str, fitted: tuple[float, float] | None = None, g: Grid = GRID) -> Column:
    """minmax, or zscore by ``fitted`` mean and deviation or else the image's own; constant images stay.

    histogram and clahe leave pixels as they are.
    """
    if kind not in _NORMS:
        raise ValueError(f"kind must be one of {_NORMS}")
    p = F.col(g.pixels)
    if kind == "minmax":
        lo, hi = F.array_min(p), F.array_max(p)
        return F.when(hi > lo, F.transform(p, lambda v: (v - lo) / (hi - lo))).otherwise(p)
    if kind == "zscore" and fitted is not None:
        return F.transform(p, lambda v: (v - fitted[0]) / F.lit(fitted[1] if fitted[1] else None))
    if kind == "zscore":
        stat = F.struct(_mean(p).alias("m"))
        std = F.transform(F.array(stat), lambda s: F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - s["m"]) * (v - s["m"])) / (F.size(p) - 1)))
        both = F.struct(_mean(p).alias("m"), F.when(F.size(p) > 1, F.get(std, F.lit(0))).alias("s"))
        return F.transform(F.array(both), lambda b: F.when(b["s"] > 1e-8, F.transform(p, lambda v: (v - b["m"]) / b["s"])).otherwise(p))[0]
    return p


def flip(g: Grid = GRID) -> Column:
    p, _, h, w = g.cols()
    return _each(p, lambda i: F.get(p, i + w - 1 - 2 * F.pmod(i, w)))


def rotate(degrees: float, g: Grid = GRID) -> Column:
    """Rotation about the middle by inverse mapping with bilinear interpolation; what comes from outside is 0."""
    p, _, h, w = g.cols()
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def at(i):
        y, x = _parts(i, h, w)
        dy, dx = y - h / 2, x - w / 2
        sx, sy = dx * cos - dy * sin + w / 2, dx * sin + dy * cos + h / 2
        x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
        fx, fy = sx - x0, sy - y0
        row = lambda k: i - y * w - x + F.least(y0 + k, h - 1) * w
        v = lambda k, j: F.get(p, row(k) + F.least(x0 + j, w - 1))
        mixed = v(0, 0) * (1 - fx) * (1 - fy) + v(0, 1) * fx * (1 - fy) + v(1, 0) * (1 - fx) * fy + v(1, 1) * fx * fy
        return F.when((sx >= 0) & (sx < w) & (sy >= 0) & (sy < h), mixed).otherwise(0.0)

    return _each(p, at)


def _unit(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))


def brightness(factor: float, g: Grid = GRID) -> Column:
    return F.transform(F.col(g.pixels), lambda v: _unit(v * factor))


def contrast(factor: float, g: Grid = GRID) -> Column:
    p = F.col(g.pixels)
    return F.transform(F.array(_mean(p)), lambda m: F.transform(p, lambda v: _unit(m + (v - m) * factor)))[0]


def noisy(df: DataFrame, sigma: float, key: str, seed: int = 0, g: Grid = GRID) -> DataFrame:
    """Normal noise, clamped to 0..1. It is a function of seed, key and place, so a repeated task draws the same."""
    p = F.col(g.pixels)
    u = lambda i, k: uniform(seed, k, F.col(key), i)
    normal = lambda i: F.sqrt(-2 * F.log(1 - u(i, 0))) * F.cos(2 * math.pi * u(i, 1))
    return df.withColumn(g.pixels, F.transform(p, lambda v, i: _unit(v + sigma * normal(i))))


def zoom(factor: float, g: Grid = GRID) -> Column:
    """Nearest neighbours of the centred crop of 1 / ``factor``; factors under 1 keep the offset at 0."""
    p, _, h, w = g.cols()
    nh, nw = F.floor(h / factor).cast("int"), F.floor(w / factor).cast("int")
    top, left = F.greatest(F.floor((h - nh) / 2), F.lit(0)).cast("int"), F.greatest(F.floor((w - nw) / 2), F.lit(0)).cast("int")

    def at(i):
        y, x = _parts(i, h, w)
        sy, sx = top + F.floor(y * nh / h).cast("int"), left + F.floor(x * nw / w).cast("int")
        return F.when((sy < h) & (sx < w), F.get(p, i - y * w - x + sy * w + sx)).otherwise(0.0)

    return _each(p, at)


def augment(df: DataFrame, key: str, seed: int = 0, g: Grid = GRID) -> DataFrame:
    """The images seven times, with ``variant``: original, flip, rotate, brightness, contrast, noise and zoom."""
    rng = random.Random(seed)
    angle, light, gap, scale = rng.uniform(-15, 15), rng.uniform(0.8, 1.2), rng.uniform(0.8, 1.2), rng.uniform(1.0, 1.2)
    made = {
        "original": df,
        "flip": df.withColumn(g.pixels, flip(g)),
        "rotate": df.withColumn(g.pixels, rotate(angle, g)),
        "brightness": df.withColumn(g.pixels, brightness(light, g)),
        "contrast": df.withColumn(g.pixels, contrast(gap, g)),
        "noise": noisy(df, 0.02, key, seed, g),
        "zoom": df.withColumn(g.pixels, zoom(scale, g)),
    }
    out = None
    for name, part in made.items():
        part = part.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sobel(g: Grid = GRID) -> Column:
    """Array of structs (magnitude, direction); 0 on the border."""
    p, _, h, w = g.cols()

    def at(i):
        y, x = _parts(i, h, w)
        v = lambda dy, dx: F.get(p, i + dy * w + dx)
        gx = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
        gy = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
        inner = _inner(y, x, h, w)
        return F.struct(F.when(inner, F.sqrt(gx * gx + gy * gy)).otherwise(0.0).alias("magnitude"), F.when(inner, F.atan2(gy, gx)).otherwise(0.0).alias("direction"))

    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.size(p) - 1), at)).otherwise(F.array().cast("array<struct<magnitude:double,direction:double>>"))


def lbp(g: Grid = GRID) -> Column:
    """Local binary pattern over eight neighbours, clockwise from the top left, divided by 255; 0 on the border."""
    p, _, h, w = g.cols()
    ring = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))

    def at(i):
        y, x = _parts(i, h, w)
        code = sum(F.when(F.get(p, i + dy * w + dx) >= F.get(p, i), float(1 << k)).otherwise(0.0) for k, (dy, dx) in enumerate(ring))
        return F.when(_inner(y, x, h, w), code / 255).otherwise(0.0)

    return _each(p, at)


def feature_stack(df: DataFrame, g: Grid = GRID) -> DataFrame:
    """Four maps for each channel: the image, Sobel magnitudes, directions and binary patterns."""
    edges = sobel(g)
    stack = F.concat(F.col(g.pixels), F.transform(edges, lambda e: e["magnitude"]), F.transform(edges, lambda e: e["direction"]), lbp(g))
    return df.withColumn(g.pixels, stack).withColumn(g.channels, F.col(g.channels) * 4)


@dataclass(frozen=True)
class ImageConfig:
    key: str = "image_id"
    size: int | None = None
    normalization: str = "zscore"
    equalize: bool = True
    blur: bool = True
    #: Statistics over images that are already normalised, as first written; otherwise over their pixels.
    fit_normalized: bool = False


def held(df: DataFrame) -> DataFrame:
    """``df`` with its pixels computed once.

    The next kernel, or a condition on its result, asks for every pixel several times, and the optimizer would put
    this kernel's expression in the place of each. A column that is not deterministic, always true, keeps it out.
    """
    return df.withColumn("__held", F.monotonically_increasing_id() >= 0).where("__held").drop("__held")


def process(df: DataFrame, config: ImageConfig, fitted: tuple[float, float] | None = None, normalized: bool = True, g: Grid = GRID) -> DataFrame:
    """resize -> equalise -> blur -> normalise."""
    out = resize(df, config.size, g) if config.size else df
    if config.equalize:
        out = held(equalize(out, g))
    if config.blur:
        out = held(out.withColumn(g.pixels, blur(g)))
    return held(out.withColumn(g.pixels, normalize(config.normalization, fitted, g))) if normalized else out


class ImagePreprocessor(Estimator):
    """Fit mean and population deviation over the pixels of the first images."""

    def __init__(self, config: ImageConfig | None = None):
        super().__init__()
        self.config = config or ImageConfig()

    def _fit(self, df: DataFrame) -> "ImageModel":
        c = self.config
        first = process(df.orderBy(c.key).limit(FIT_IMAGES), c, normalized=c.fit_normalized)
        row = first.select(F.explode(GRID.pixels).alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
        return ImageModel(c, (row[0] or 0.0, row[1] or 1.0))


class ImageModel(Model, Guarded):
    def __init__(self, config: ImageConfig, fitted: tuple[float, float] | None = None):
        super().__init__()
        self.config, self.fitted = config, fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        """Processed images; rows without usable pixels become zero images of their size."""
        self.check_fitted(self.fitted)
        g, c = GRID, self.config
        good = F.col(g.pixels).isNotNull() & (F.size(g.pixels) == F.col(g.channels) * F.col(g.height) * F.col(g.width))
        blank = F.array_repeat(F.lit(0.0), (F.col(g.channels) * (c.size * c.size if c.size else F.col(g.height) * F.col(g.width))).cast("int"))
        done = process(df.where(good), c, self.fitted)
        side = {g.height: F.lit(c.size), g.width: F.lit(c.size)} if c.size else {}
        bad = df.where(~F.coalesce(good, F.lit(False))).withColumns({g.pixels: blank, **side})
        return done.unionByName(bad.select(*done.columns))


PROFILES = {
    "ultrasound": ImageConfig(size=224, normalization="clahe"),
    "xray": ImageConfig(size=512, normalization="histogram"),
    "ct": ImageConfig(size=256, normalization="zscore"),
}
