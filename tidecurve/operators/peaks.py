"""Peaks, suppression, merged highlights and boundary search along one curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

EDGES = (None, "rising", "falling", "both")


def peaks(long: DataFrame, edge: str | None = "rising", mph: float | None = None, threshold: float = 0.0, valley: bool = False) -> DataFrame:
    """Rows of ``(series_id, i, value)`` that are peaks.

    ``edge``: which side of a flat top counts (None: strict peaks only).  NaN
    and its neighbours are never peaks, nor are the first and last points.
    Valleys are peaks of the negated curve, and ``mph`` then bounds that.
    """
    if edge not in EDGES:
        raise ValueError(f"edge must be one of {EDGES}")
    w = Window.partitionBy("series_id").orderBy("i")
    x = -F.col("value") if valley else F.col("value")
    marked = long.withColumn("_x", x).withColumn("_p", F.lag("_x").over(w)).withColumn("_n", F.lead("_x").over(w))
    up, flat_up = F.col("_x") > F.col("_p"), F.col("_x") >= F.col("_p")
    down, flat_down = F.col("_x") > F.col("_n"), F.col("_x") >= F.col("_n")
    rising, falling = up & flat_down, flat_up & down
    kind = {None: up & down, "rising": rising, "falling": falling, "both": rising | falling}[edge]
    own = marked.where(F.col("_p").isNotNull() & F.col("_n").isNotNull() & ~F.isnan("_x") & ~F.isnan("_p") & ~F.isnan("_n") & kind)
    if mph is not None:
        own = own.where(F.col("_x") >= mph)
    if threshold > 0:
        own = own.where(F.least(F.col("_x") - F.col("_p"), F.col("_x") - F.col("_n")) >= threshold)
    return own.drop("_x", "_p", "_n")


def suppress(at: np.ndarray, height: np.ndarray, distance: int, keep_same: bool = False) -> np.ndarray:
    """Positions left after greedy suppression: tallest first, later position first among equals."""
    if distance <= 1 or not len(at):
        return np.sort(at)
    alive = np.ones(len(at), bool)
    for k in np.lexsort((-at, -height)):
        if alive[k]:
            near = np.abs(at - at[k]) <= distance
            alive &= ~(near & (height < height[k])) if keep_same else ~near
            alive[k] = True
    return np.sort(at[alive])


def distant_peaks(found: DataFrame, distance: int, keep_same: bool = False, valley: bool = False) -> DataFrame:
    """Suppress peaks within ``distance`` (inclusive) of a taller one, series by series."""
    kind = found.schema["series_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        height = (-pdf["value"] if valley else pdf["value"]).to_numpy(float)
        left = suppress(pdf["i"].to_numpy(), height, distance, keep_same)
        return pdf[pdf["i"].isin(left)].sort_values("i")

    return found.select("series_id", "i", "value").groupBy("series_id").applyInPandas(one, f"series_id {kind}, i bigint, value double")


def merge_extrema(points: list[tuple[float, str, str]], clip: float, min_dist: float = 0, step: int = 1) -> list[tuple[float, list[str]]]:
    """Join extrema ``(position, modality, kind)`` of several curves to highlights ``(position, tags)``.

    A highlight opens at the first point beyond ``clip + min_dist`` of the last
    highlight and takes in what follows within that reach of its last member.
    Two modalities make a pair that stands at its mean; one modality twice, or
    a third member, spoil it, and nothing remains of its members.  With
    ``min_dist`` nothing is taken in: every highlight is one point.
    """
    order, reach = sorted(points), clip + min_dist
    found: list[tuple[float, list[str]]] = []
    last, at = float("-inf"), 0
    while at < len(order):
        taken, at = [order[at]], at + 1
        if taken[0][0] - last <= reach:
            continue
        while not min_dist and taken and at < len(order) and order[at][0] - taken[-1][0] <= reach:
            pairs_up = len(taken) == 1 and order[at][1] != taken[0][1]
            taken, at = [*taken, order[at]] if pairs_up else [], at + 1
        if taken:
            last = sum(p for p, _, _ in taken) / len(taken)
            found.append((last, [f"{modality}-{kind}" for _, modality, kind in taken]))
    return found[::step]


def merged(extrema: DataFrame, clip: float, min_dist: float = 0, step: int = 1) -> DataFrame:
    """``(series_id, i, modality, kind)`` to ``(series_id, pos, tags)``."""
    kind = extrema.schema["series_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge_extrema(list(zip(pdf["i"].astype(float), pdf["modality"], pdf["kind"])), clip, min_dist, step)
        own = pdf.iloc[: len(out)][["series_id"]]  # never more highlights than extrema
        if not out:
            return own.assign(pos=0.0, tags="")
        return own.assign(pos=[p for p, _ in out], tags=["+".join(t) for _, t in out])

    return extrema.groupBy("series_id").applyInPandas(one, f"series_id {kind}, pos double, tags string")


def reverse_boundary(frames: DataFrame, misses: int = 5) -> DataFrame:
    """Where the closing run of hits begins: ``(series_id, boundary)``, null where none is found.

    ``frames(series_id, i, hits)``: the second half is read backwards; a run of
    ``misses`` frames without a hit stops the search; the boundary is the
    earliest frame reached with more than one hit.
    """
    by, back = Window.partitionBy("series_id"), Window.partitionBy("series_id").orderBy(F.desc("i"))
    half = frames.withColumn("_n", F.count(F.lit(1)).over(by)).where(F.col("i") >= F.floor(F.col("_n") / 2))
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    runs = half.withColumn("_run", F.sum((F.col("hits") > 0).cast("int")).over(so_far))
    missed = F.sum((F.col("hits") == 0).cast("int")).over(Window.partitionBy("series_id", "_run").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("_missed", missed).withColumn("_over", F.max((F.col("_missed") >= misses).cast("int")).over(so_far))
    reached = (F.col("_over") == 0) & (F.col("hits") > 1)
    return marked.groupBy("series_id").agg(F.min(F.when(reached, F.col("i"))).alias("boundary"))


def confidence_band(mean: Column, std: Column) -> tuple[Column, Column]:
    """Lower and upper edge of mean +- std kept within 0..1."""
    half = F.least(std, mean, 1 - mean)
    return F.greatest(mean - half, F.lit(0.0)), F.least(mean + half, F.lit(1.0))
