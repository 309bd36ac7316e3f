"""Exact batch statistics in passes whose results are a few scalars, whatever the table holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that the last pass of a selection may sort in one task.
SELECT_ROWS = 50_000
_ACCURACY = 2_000


def clean(c: Column) -> Column:
    """NULL for NaN: the engine has one marker of missing values."""
    return F.when(F.isnan(c), None).otherwise(c)


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]], select_rows: int = SELECT_ROWS) -> dict[str, tuple[int, list[float | None]]]:
    """For each column the number n of its known values and the values at the 0-based ``ranks(n)``.

    Exact, and without sorting the table: percentile sketches bracket every rank, the values below the bracket
    are counted, and the bracket is narrowed until it holds at most ``select_rows`` values (or one value
    repeated), which are then sorted. All columns share each pass; a pass returns scalars.
    """
    slim = df.select(*[clean(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    first = slim.agg(*[f for i in range(len(columns)) for f in (F.count(f"c{i}"), F.min(f"c{i}"), F.max(f"c{i}"))]).first()
    n = [first[3 * i] for i in range(len(columns))]
    goals = {(i, r): None for i in range(len(columns)) if n[i] for r in ranks(n[i])}
    state = {g: (first[3 * g[0] + 1], first[3 * g[0] + 2], 0, n[g[0]]) for g in goals}  # low, high, values below low, values inside
    while any(v is None for v in goals.values()):
        for g, (lo, hi, _, _) in state.items():
            if lo == hi:
                goals[g] = lo
        open_ = [g for g, v in goals.items() if v is None]
        small = [g for g in open_ if state[g][3] <= select_rows]
        wide = [g for g in open_ if state[g][3] > select_rows]
        inside = lambda g: F.when(F.col(f"c{g[0]}").between(state[g][0], state[g][1]), F.col(f"c{g[0]}"))
        if small:
            found = slim.agg(*[F.get(F.array_sort(F.collect_list(inside(g))), g[1] - state[g][2]).alias(f"v{k}") for k, g in enumerate(small)]).first()
            goals.update({g: found[k] for k, g in enumerate(small)})
        if wide:
            share = lambda g: (g[1] - state[g][2]) / state[g][3]
            edges = slim.agg(*[F.percentile_approx(inside(g), [max(share(g) - 2 / _ACCURACY, 0.0), min(share(g) + 2 / _ACCURACY, 1.0)], _ACCURACY).alias(f"e{k}") for k, g in enumerate(wide)]).first()
            near = {g: tuple(edges[k]) for k, g in enumerate(wide)}
            counts = slim.agg(*[f for g in wide for c in [F.col(f"c{g[0]}")] for f in (F.sum((c < near[g][0]).cast("long")), F.sum(((c >= near[g][0]) & (c <= near[g][1])).cast("long")))]).first()
            for k, g in enumerate(wide):
                below, held = counts[2 * k], counts[2 * k + 1]
                lo, hi, old, size = state[g]
                if below <= g[1] < below + held:
                    if held == size:  # a sketch that cannot narrow: go on by its halves
                        mid = lo + (hi - lo) / 2
                        under = slim.agg(F.sum((F.col(f"c{g[0]}") <= mid).cast("long"))).first()[0]
                        state[g] = (lo, mid, old, under - old) if g[1] < under else (_above(slim, g[0], mid), hi, under, old + size - under)
                    else:
                        state[g] = (*near[g], below, held)
                elif g[1] < below:
                    top = slim.agg(F.max(F.when(F.col(f"c{g[0]}") < near[g][0], F.col(f"c{g[0]}")))).first()[0]
                    state[g] = (lo, top, old, below - old)
                else:
                    state[g] = (_above(slim, g[0], near[g][1]), hi, below + held, old + size - below - held)
    return {c: (n[i], [goals[i, r] for r in ranks(n[i])] if n[i] else []) for i, c in enumerate(columns)}


def _above(slim: DataFrame, i: int, edge: float) -> float:
    return slim.agg(F.min(F.when(F.col(f"c{i}") > edge, F.col(f"c{i}")))).first()[0]


def median(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians: the mean of the two middle values where their number is even."""
    found = order_statistics(df, columns, lambda n: sorted({(n - 1) // 2, n // 2}))
    return {c: sum(v) / len(v) if v else None for c, (_, v) in found.items()}


def quartile_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Bounds q1 - k * iqr and q3 + k * iqr from the values at places n div 4 and 3n div 4; None if n < 4."""
    found = order_statistics(df, columns, lambda n: [n // 4, 3 * n // 4])
    out = {}
    for c, (n, v) in found.items():
        out[c] = None if n < 4 else (v[0] - factor * (v[1] - v[0]), v[1] + factor * (v[1] - v[0]))
    return out


def modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Most frequent hundredth (truncated) of each column, the smallest of equals."""
    out = {}
    for c in columns:
        v = clean(F.col(f"`{c}`").cast("double"))
        top = df.where(v.isNotNull()).groupBy((v * 100).cast("long").alias("b")).count().orderBy(F.desc("count"), "b").first()
        out[c] = None if top is None else top["b"] / 100
    return out
