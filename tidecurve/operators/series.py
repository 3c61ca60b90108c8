"""Curves as one row per series: position-ordered arrays and what is computed on them in the JVM.

Long form is ``(series_id, i, value)`` with i = 0, 1, 2 ...; array form is
``(series_id, y)``.  Nothing here needs more than one shuffle by series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

KERNELS = ("flat", "hanning", "hamming", "bartlett", "blackman")
#: From this window on the array form costs more than a vectorised convolution.
LONG_WINDOW = 64


def to_arrays(long: DataFrame, *keep: str) -> DataFrame:
    """Long form to array form; ``keep`` are columns constant within a series."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "value")))
    return long.groupBy("series_id", *keep).agg(F.transform(ordered, lambda p: p["value"]).alias("y"))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Compute columns once per row, here.

    A plain projection may be folded into every place that uses the column,
    lambda bodies included, where it would be computed again for each element;
    a generator over one element is never folded.
    """
    names = list(columns)
    kept = [c for c in df.columns if c not in columns]
    made = df.withColumn("_made", F.explode(F.array(F.struct(*[columns[n].alias(n) for n in names]))))
    return made.select(*kept, *[F.col("_made")[n].alias(n) for n in names])


def to_long(arrays: DataFrame, *keep: str) -> DataFrame:
    return arrays.select("series_id", *keep, F.posexplode("y").alias("i", "value"))


def kernel(kind: str, w: int) -> list[float]:
    """Weights of a smoothing window, scaled to sum 1."""
    t = [2 * math.pi * k / (w - 1) for k in range(w)]
    shapes = {
        "flat": lambda: [1.0] * w,
        "hanning": lambda: [0.5 - 0.5 * math.cos(a) for a in t],
        "hamming": lambda: [0.54 - 0.46 * math.cos(a) for a in t],
        "bartlett": lambda: [1 - abs(2 * k / (w - 1) - 1) for k in range(w)],
        "blackman": lambda: [0.42 - 0.5 * math.cos(a) + 0.08 * math.cos(2 * a) for a in t],
    }
    if kind not in shapes:
        raise ValueError(f"unknown smoothing window {kind!r}; one of {', '.join(KERNELS)}")
    raw = shapes[kind]()
    return [v / sum(raw) for v in raw]


def _smoothed(weights: list[float]) -> Column:
    """Weighted moving mean of ``y`` with odd reflection at both ends."""
    w = len(weights)
    left, right = w // 2, (w - 1) // 2
    y, first, last = F.col("y"), F.element_at("y", 1), F.element_at("y", -1)
    # the padded curve is bound once by a one-element outer transform
    before = F.transform(F.reverse(F.slice(y, 1, left)), lambda v: 2 * first - v)
    after = F.transform(F.reverse(F.slice(y, F.size(y) - F.lit(right) + 1, F.lit(right))), lambda v: 2 * last - v)
    padded = F.concat(before, y, after)
    # the kernel is applied reversed; arrays hold the weights in the order they meet the padded curve
    taps = F.array(*[F.lit(v) for v in reversed(weights)])

    def over(curve: Column) -> Column:
        terms = lambda i: F.zip_with(F.slice(curve, i + 1, F.lit(w)), taps, lambda a, b: a * b)
        return F.transform(F.sequence(F.lit(0), F.size(curve) - w), lambda i: F.aggregate(terms(i), F.lit(0.0), lambda s, v: s + v))

    return F.element_at(F.transform(F.array(padded), over), 1)


def smooth(arrays: DataFrame, window: int, kind: str = "hanning") -> DataFrame:
    """Smooth ``y``; the length stays.

    Windows under 3 leave the curve as it is.  A curve shorter than the window
    is an error, raised when the row is computed.  A window of W covers W//2
    points before and (W-1)//2 after; ends continue by odd reflection.
    """
    if window < 3:
        return arrays
    weights = kernel(kind, window)
    short = F.raise_error(F.format_string("curve of %d points is shorter than the smoothing window %d", F.size("y"), F.lit(window)))
    if window <= LONG_WINDOW:
        return settled(arrays, y=F.when(F.size("y") >= window, _smoothed(weights)).otherwise(short.cast("array<double>")))

    taps = np.asarray(weights)

    @F.pandas_udf("array<double>")
    def convolved(column: pd.Series) -> pd.Series:
        def one(y: np.ndarray) -> np.ndarray:
            if len(y) < window:
                raise ValueError(f"curve of {len(y)} points is shorter than the smoothing window {window}")
            padded = np.concatenate([2 * y[0] - y[: window // 2][::-1], y, 2 * y[-1] - y[len(y) - (window - 1) // 2 :][::-1]])
            return np.convolve(padded, taps, mode="valid")

        return column.map(one)

    return arrays.withColumn("y", convolved("y"))


def resample(arrays: DataFrame, points: int | Column) -> DataFrame:
    """Linear interpolation of ``y`` on ``points`` equal steps from its first to its last point.

    A curve of that length is left as it is; one point is repeated.
    """
    m = F.lit(points) if isinstance(points, int) else points
    n = F.size("y")

    def at(k: Column) -> Column:
        x = k * (n - 1) / (m - 1)
        lo = F.least(F.floor(x).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        a, b = F.get("y", lo), F.get("y", hi)
        return a + (b - a) * (x - lo)

    stretched = F.transform(F.sequence(F.lit(0), m - 1), at)
    return settled(arrays, y=F.when((n == m) | (n == 0), F.col("y")).otherwise(stretched))


def mean_std(arrays: DataFrame) -> DataFrame:
    """Add ``mean`` and population ``std`` of ``y``."""
    n = F.size("y")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    with_mean = settled(arrays, mean=total(F.col("y")) / n)
    return settled(with_mean, std=F.sqrt(total(F.transform("y", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / n))


def znorm(arrays: DataFrame) -> DataFrame:
    """Zero mean, unit population deviation per series; a flat curve gives nulls.  Keeps ``mean`` and ``std``."""
    scaled = F.transform("y", lambda v: (v - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    return settled(mean_std(arrays), y=scaled)


def credits_trim(arrays: DataFrame, marks: DataFrame, compat: bool = False) -> DataFrame:
    """Cut each curve before its mark ``credits_at``; no mark, no cut.  ``compat``: a mark of 0 is no mark."""
    at = F.col("credits_at")
    cut = F.when(at.isNull() | (at == 0 if compat else F.lit(False)), F.col("y")).otherwise(F.slice("y", F.lit(1), F.greatest(at, F.lit(0))))
    return arrays.join(marks, "series_id", "left").withColumn("y", cut).drop("credits_at")


def window_length(w: float | None) -> Column:
    """Adaptive window: none is 7 % of the length, under 1 a share of it, else itself."""
    n = F.size("y")
    if w is None:
        return F.floor(n * F.lit(0.07)).cast("int")
    return F.floor(n * F.lit(w)).cast("int") if w < 1 else F.lit(int(w))


def position(partition: str, *order: str) -> Column:
    return (F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1).cast("bigint")


def prepare(arrays: DataFrame, marks: DataFrame | None, window: int, step: int, max_points: int | None, points: int, kind: str = "hanning") -> DataFrame:
    """The whole preparation: drop empty, trim, length filters, smooth, downsample, resample, normalise, index by id.

    ``max_points`` None: no curve is too long.
    """
    own = arrays.where(F.size("y") > 0)
    if marks is not None:
        own = credits_trim(own, marks)
    if window >= 1:
        own = own.where(F.size("y") > window)
    if max_points is not None:
        own = own.where(F.size("y") <= max_points)
    own = smooth(own, window, kind)
    if step > 1:
        own = settled(own, y=F.filter("y", lambda _, i: i % step == 0))
    return znorm(resample(own, points))


def rows(pdf: pd.DataFrame, y: str = "y") -> Iterator[np.ndarray]:
    return (np.asarray(v, float) for v in pdf[y])
