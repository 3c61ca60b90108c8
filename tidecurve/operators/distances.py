"""Distances between curves: envelope lower bound, warping family, correlation; and pairing curves up.

Curves are dealt to blocks, as many as the number of curves and of tasks asks
for.  A block is exchanged once, and one task reads two of them and measures
their pairs as matrices; so no task holds more than two blocks, what lists the
pairs hands them on strip by strip, and what keeps only the nearest keeps them
there already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidecurve.operators import series as S
from tidecurve.shared import cut, drop, tasks

#: Curves of a block at most, of one whose pairs are measured by strips, and of one whose distances are held at once; rows of a matrix measured at a time; its columns given before they are mirrored.
BLOCK_ROWS, WIDE_ROWS, TREE_ROWS, STRIP, CHUNK, PIECE = 2048, 8192, 4096, 64, 1024, 4


def block_count(n: int, workers: int, rows: int = BLOCK_ROWS) -> int:
    """Blocks for ``n`` curves: a few pairs of blocks for every task, and none over ``rows`` curves."""
    return max(1, min(n, math.ceil(math.sqrt(4 * workers))), math.ceil(n / rows))


def pairs(ids: DataFrame) -> DataFrame:
    """Every unordered pair once, ``a < b`` by ``series_id``: the ids of two blocks are laid out against each other, and no pair is tested but within one."""
    kind = ids.schema["series_id"].dataType.simpleString()

    def stream(low: pd.DataFrame, high: pd.DataFrame | None) -> Iterator[pa.RecordBatch]:
        a, b = low["series_id"].to_numpy(), (low if high is None else high)["series_id"].to_numpy()
        for i in range(0, len(a), STRIP):
            own, other = a[i : i + STRIP], b if high is not None else b[i:]
            above = np.triu(np.ones((len(own), len(other)), bool), 1).ravel() if high is None else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(other))[above]), pa.array(np.tile(other, len(own))[above])], ["a", "b"])

    return streamed(_blocks(ids.select("series_id"), WIDE_ROWS), stream, f"a {kind}, b {kind}")


#: Curves b to a function of curves a, which gives the distances of each a to each b.
Matrix = Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]
#: What a pair of blocks comes down to: of the ids, the curves and further columns of the lower and of the higher block, which is None where they are one.
Reduce = Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame]
#: The same bit by bit, in the columns of the result.
Stream = Callable[[pd.DataFrame, pd.DataFrame | None], Iterator[pa.RecordBatch]]


def ranged(arrays: DataFrame, *keep: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Written curves with the ``block`` of ids that follow each other to which they belong, of about ``rows`` at most."""
    return _blocks(arrays.select("series_id", "y", *keep), rows)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    own = cut(rows.where("series_id is not null"), "curves")
    blocks = block_count(own.count(), tasks(rows.sparkSession), most)
    dealt = cut(own.repartitionByRange(blocks, "series_id").withColumn("block", F.spark_partition_id()), "blocks")
    drop(own)
    return dealt


def _met(blocks: DataFrame) -> DataFrame:
    """``(low, rows_a, high, rows_b)`` of every pair of blocks, ``low <= high``.

    A block is one row in a partition of its own and is exchanged once; a task
    reads its two where they lie, so what is moved to disk does not grow with
    the number of pairs.
    """
    count = (blocks.agg(F.max("block")).collect()[0][0] or 0) + 1
    rows = F.collect_list(F.struct(*[c for c in blocks.columns if c != "block"]))
    packed = blocks.groupBy("block").agg(rows.alias("rows")).repartitionById(count, "block")
    x, y = packed.toDF("low", "rows_a"), packed.toDF("high", "rows_b")
    return x.join(y.hint("shuffle_replicate_nl"), F.col("low") <= F.col("high"))


def streamed(blocks: DataFrame, stream: Stream, schema: str) -> DataFrame:
    """``stream`` of every pair of blocks; all ids of the first are below all of the second."""

    def unpacked(rows: pa.ListScalar) -> pd.DataFrame:
        own = pa.Table.from_arrays(rows.values.flatten(), [f.name for f in rows.values.type]).to_pandas()
        return own.sort_values("series_id", ignore_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x, high, y in zip(*(batch.column(c) for c in ("low", "rows_a", "high", "rows_b"))):
                yield from stream(unpacked(x), None if low == high else unpacked(y))

    return _met(blocks).mapInArrow(run, schema)


def reduced(blocks: DataFrame, reduce: Reduce, schema: str) -> DataFrame:
    """``reduce`` of every pair of blocks; all ids of the first are below all of the second."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def stream(x: pd.DataFrame, y: pd.DataFrame | None) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(reduce(x, y), kinds, preserve_index=False)

    return streamed(blocks, stream, schema)


def stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(y, float) for y in rows["y"]]) if len(rows) else np.empty((0, 0))


def strips(x: np.ndarray, y: np.ndarray | None, matrix: Matrix) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(i, j, d)``: distances of the curves of x from i on to those of y from j on, strip by strip.

    y None: of x among themselves; only what lies above the diagonal, from
    ``d[0, 1]`` on, are pairs, the rest is infinite.
    """
    for c in range(0, len(x), CHUNK):
        near = matrix(x[c:] if y is None else y)
        for i in range(c, min(len(x), c + CHUNK), STRIP):
            d = near(x[i : min(i + STRIP, c + CHUNK)])
            if y is None:
                d = d[:, i - c :]
                d[np.tril_indices(len(d), 0, d.shape[1])] = np.inf
            yield i, 0 if y is not None else i, d


def listed(arrays: DataFrame, matrix: Matrix, digits: int | None = None, mirror: bool = False, core: str | None = None) -> DataFrame:
    """``(a, b, d)`` of every pair a < b by block matrices, strip by strip; curves must be of one length.

    ``digits``: distances are rounded.  ``mirror``: both directions of every
    pair and the zero diagonal.  ``core``: a column below which no distance of
    the curve is.
    """
    blocks = ranged(arrays, *[core] if core else [], rows=WIDE_ROWS)
    single = mirror and blocks.count() < 2  # a single curve is in no pair

    def stream(low: pd.DataFrame, high: pd.DataFrame | None) -> Iterator[pa.RecordBatch]:
        x, y, other = stacked(low), None if high is None else stacked(high), low if high is None else high
        ids, high_ids = low["series_id"].to_numpy(), other["series_id"].to_numpy()
        for i, j, d in strips(x, y, matrix):
            if core:
                d = np.maximum(d, np.maximum(low[core].to_numpy(float)[i : i + len(d), None], other[core].to_numpy(float)[None, j:]))
            yield from _batches(ids[i : i + len(d)], high_ids[j:], d, y is None, digits, mirror)
        if mirror and high is None and not single:
            yield _batch(ids, ids, np.zeros(len(ids)))

    kind = arrays.schema["series_id"].dataType.simpleString()
    return streamed(blocks, stream, f"a {kind}, b {kind}, d double")


def _batches(a: np.ndarray, b: np.ndarray, d: np.ndarray, upper: bool, digits: int | None, mirror: bool = False) -> Iterator[pa.RecordBatch]:
    """Distances of each a to each b as rows, ``upper``: only what lies above the diagonal.

    Rows go b by b, each with all of the strip's a, and what is mirrored comes
    right after its piece: so in a written result ids are runs and short
    repeats and a mirrored distance is a copy, of hardly any bytes.
    """
    d = d.T.ravel()
    d = (d if digits is None else rounded(d, digits)).reshape(len(b), len(a))
    own, other = np.broadcast_to(a, d.shape), np.broadcast_to(b[:, None], d.shape)
    above = np.tril(np.ones(d.shape, bool), -1) if upper else None
    if not mirror:
        yield _batch(*((v[above] if upper else v.ravel()) for v in (own, other, d)))
        return
    whole = len(b) // PIECE * PIECE
    for part, size in ((slice(0, whole), PIECE), (slice(whole, len(b)), len(b) - whole)):
        if size and part.start < part.stop:
            laid = lambda *sides: np.stack([v[part].reshape(-1, size * len(a)) for v in sides], 1).ravel()
            kept = laid(above, above) if upper else slice(None)
            yield _batch(laid(own, other)[kept], laid(other, own)[kept], laid(d, d)[kept])


def _batch(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, from_pandas=True)], ["a", "b", "d"])


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero in the decimal that is written for the number, as ``F.round`` has it."""
    with np.errstate(invalid="ignore"):
        k = np.abs(d) * 10.0**digits
        whole = np.floor(k)
        rest = k - whole - 0.5
        out = np.copysign((whole + (rest >= 0)) / 10.0**digits, d)
        # the product is off by less than this; which side of a half it lies on, the decimal tells
        close = np.flatnonzero((np.abs(rest) <= k * 1e-15) & np.isfinite(d))
    step = Decimal(1).scaleb(-digits)
    for i in close:
        out[i] = float(Decimal(repr(float(d[i]))).quantize(step, ROUND_HALF_UP, Context(prec=400)))
    return out


def measured(arrays: DataFrame, matrix: Matrix, nearest: int | None = None, both_ways: bool = False) -> DataFrame:
    """``(a, b, d)`` of every pair a < b by block matrices; curves must be of one length.

    ``nearest``: only the so many smallest ``(d, b)`` of each a that a pair of
    blocks has; the nearest of all are among them.  ``both_ways``: the pair is
    also given as (b, a), at the same distance, before the nearest are taken.
    """
    if nearest is None:
        return listed(arrays, matrix)
    kind = arrays.schema["series_id"].dataType.simpleString()

    def reduce(low: pd.DataFrame, high: pd.DataFrame | None) -> pd.DataFrame:
        high_ids = (low if high is None else high)["series_id"].to_numpy()
        ids, x, y = low["series_id"].to_numpy(), stacked(low), None if high is None else stacked(high)
        parts, bound = [(np.empty(0, int), np.empty(0, int), np.empty(0))], np.full(len(high_ids), np.inf)
        back = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for at, start, d in strips(x, y, matrix):
            pair = np.ones(d.shape, bool) if y is not None else np.triu(np.ones(d.shape, bool), 1)
            i, j = np.nonzero(pair & ~(d > _kth(d, nearest, 1)[:, None]))
            parts.append(_nearest(i + at, j + start, d[i, j], nearest))
            if both_ways:
                bound[start:] = np.fmin(bound[start:], _kth(d, nearest, 0))
                i, j = np.nonzero(pair & ~(d > bound[start:]))
                back.append((j + start, i + at, d[i, j]))
        a, b, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
        found = pd.DataFrame({"a": ids[a], "b": high_ids[b], "d": d})
        if not both_ways:
            return found
        b, a, d = _nearest(*(np.concatenate([p[k] for p in back]) for k in range(3)), nearest)
        return pd.concat([found, pd.DataFrame({"a": high_ids[b], "b": ids[a], "d": d})])

    return reduced(ranged(arrays, rows=WIDE_ROWS), reduce, f"a {kind}, b {kind}, d double")


def _kth(d: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th smallest along an axis, infinite where there are fewer."""
    return np.partition(d, k - 1, axis).take(k - 1, axis) if d.shape[axis] >= k else np.full(d.shape[1 - axis], np.inf)


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the k smallest ``(d, b)``."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
    kept = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
    return a[kept], b[kept], d[kept]


def tree_edges(arrays: DataFrame, matrix: Matrix, core: str | None = None) -> DataFrame:
    """``(a, b, d)``: the spanning trees of every block of curves and of every two blocks, which hold that of all curves.

    A heaviest edge of a circle is in no least tree, whatever else there is;
    ties go by ``(d, a, b)``.  ``core``: a column below which no distance of
    the curve is.  Curves without a distance are infinitely far.
    """
    kind = arrays.schema["series_id"].dataType.simpleString()

    def reduce(low: pd.DataFrame, high: pd.DataFrame | None) -> pd.DataFrame:
        # a block is sent whole, and the distances of parts of it are held at once
        cut_up = lambda rows: [rows[i : i + TREE_ROWS].reset_index(drop=True) for i in range(0, len(rows), TREE_ROWS)]
        first = cut_up(low)
        pairs = [(x, y) for x in first for y in cut_up(high)] if high is not None else [(x, first[j] if j > i else None) for i, x in enumerate(first) for j in range(i, len(first))]
        return pd.concat([tree(x, y) for x, y in pairs])

    def tree(low: pd.DataFrame, high: pd.DataFrame | None) -> pd.DataFrame:
        both = low if high is None else pd.concat([low, high])
        ids, n = both["series_id"].to_numpy(), len(low)
        x, y = stacked(low), None if high is None else stacked(high)
        full = np.full((n, n if y is None else len(y)), np.inf)
        for i, j, d in strips(x, y, matrix):
            full[i : i + len(d), j:] = np.where(np.isnan(d), np.inf, d)
        if y is None:
            full = np.fmin(full, full.T)
        if core:
            least = both[core].to_numpy(float)
            full = np.maximum(full, np.maximum(least[:n, None], least[None, n:] if y is not None else least[None]))
        a, b, d = _prim(full, None if y is None else n)
        return pd.DataFrame({"a": ids[a], "b": ids[b], "d": d})

    return reduced(ranged(arrays, *[core] if core else [], rows=WIDE_ROWS), reduce, f"a {kind}, b {kind}, d double")


def _prim(full: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``a < b, d`` of the least spanning tree by ``(d, a, b)``: of a square of distances, or (``split`` given) of its
    rows as nodes 0 to split - 1 against its columns as nodes from split on."""
    n = len(full) if split is None else sum(full.shape)
    key, other, out = np.full(n, np.inf), np.full(n, n), np.zeros(n, bool)
    edges, u = [], 0
    for _ in range(n - 1):
        out[u], key[u] = True, np.inf
        side, row = (slice(0, n), full[u]) if split is None else (slice(split, n), full[u]) if u < split else (slice(0, split), full[:, u - split])
        k, o = key[side], other[side]
        better = ~out[side] & ((row < k) | ((row == k) & (u < o)))
        k[better], o[better] = row[better], u
        left = np.flatnonzero((key == key.min()) & ~out & (other < n))
        low, high = np.minimum(left, other[left]), np.maximum(left, other[left])
        u = int(left[np.lexsort((high, low))[0]]) if len(left) > 1 else int(left[0])
        edges.append((min(u, other[u]), max(u, other[u]), key[u]))
    a, b, d = zip(*edges) if edges else ((), (), ())
    return np.array(a, int), np.array(b, int), np.array(d, float)


def weighed_sums(blocks: DataFrame, matrix: Matrix, weights: list[str], quantum: float) -> DataFrame:
    """``(series_id, *weights)``: for each curve the sum of the others' weights times their distance.

    Distances are multiples of ``quantum``, so the sums do not depend on their
    order where they are below 2 ** 53 of it.  Of two curves without weight
    nothing is measured.
    """
    kind = blocks.schema["series_id"].dataType.simpleString()

    def exact(d: np.ndarray) -> np.ndarray:
        d = np.rint(d / quantum) * quantum
        d[~np.isfinite(d)] = 0.0  # below the diagonal
        return d

    def reduce(low: pd.DataFrame, high: pd.DataFrame | None) -> pd.DataFrame:
        x, wx = stacked(low), low[weights].to_numpy(float)
        to_x = np.zeros_like(wx)
        if not wx.any() and (high is None or not high[weights].to_numpy().any()):
            return low[["series_id", *weights]].iloc[:0]
        if high is None:
            for i, j, d in strips(x, None, matrix):
                d = exact(d)
                to_x[i : i + len(d)] += d @ wx[j:]
                to_x[j:] += d.T @ wx[i : i + len(d)]
            return pd.DataFrame(to_x, columns=weights).assign(series_id=low["series_id"])
        y, wy = stacked(high), high[weights].to_numpy(float)
        to_y, has_x, has_y = np.zeros_like(wy), wx.any(1), wy.any(1)
        own = np.flatnonzero(has_x)
        for i, _, d in strips(x[own], y, matrix):
            d, at = exact(d), own[i : i + len(d)]
            to_x[at] += d @ wy
            to_y += d.T @ wx[at]
        own = np.flatnonzero(~has_x)
        for i, _, d in strips(x[own], y[has_y], matrix) if has_y.any() else ():
            to_x[own[i : i + len(d)]] += exact(d) @ wy[has_y]
        return pd.concat([pd.DataFrame(to, columns=weights).assign(series_id=of["series_id"]) for to, of in ((to_x, low), (to_y, high))])

    sums = reduced(blocks, reduce, ", ".join(f"{w} double" for w in weights) + f", series_id {kind}")
    return sums.groupBy("series_id").agg(*[F.sum(w).alias(w) for w in weights])


def envelope(y: str | Column, r: int) -> tuple[Column, Column]:
    """Lower and upper envelope: over positions k-r up to k+r, the last left out."""
    y = F.col(y) if isinstance(y, str) else y
    around = lambda k: F.slice(y, F.greatest(k - r, F.lit(0)) + 1, F.least(k + r, F.size(y)) - F.greatest(k - r, F.lit(0)))
    over = F.sequence(F.lit(0), F.size(y) - 1)
    return F.transform(over, lambda k: F.array_min(around(k))), F.transform(over, lambda k: F.array_max(around(k)))


def lb_keogh(y: str | Column, lower: str | Column, upper: str | Column) -> Column:
    """Root of the summed squared excess of ``y`` over the other curve's envelope; not symmetric."""
    over = F.zip_with(y, upper, lambda v, u: F.when(v > u, (v - u) * (v - u)).otherwise(0.0))
    under = F.zip_with(y, lower, lambda v, l: F.when(v < l, (v - l) * (v - l)).otherwise(0.0))
    both = F.zip_with(over, under, lambda p, q: p + q)
    return F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, v: s + v))


def lb_matrix(r: int) -> Matrix:
    """The bound of a against the envelope of b."""

    def against(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        n = y.shape[1]
        at = [(max(0, k - r), min(n, k + r)) for k in range(n)]
        lo, up = np.stack([y[:, s:e].min(1) for s, e in at]), np.stack([y[:, s:e].max(1) for s, e in at])
        lo[np.isnan(lo)], up[np.isnan(up)] = -np.inf, np.inf  # a gap in a curve exceeds nothing

        def matrix(x: np.ndarray) -> np.ndarray:
            if len(x) > len(y):  # the longer side is the vector
                return of_columns(x)
            total, t = np.zeros((len(x), len(y))), np.empty(len(y))
            for k, points in enumerate(x.T.tolist()):  # a point's envelope stays in the cache for all curves
                for row, v in zip(total, points):
                    if v == v:
                        np.maximum(lo[k], v, out=t)
                        np.minimum(t, up[k], out=t)
                        np.subtract(t, v, out=t)
                        np.multiply(t, t, out=t)
                        np.add(row, t, out=row)
            return np.sqrt(total, out=total)

        def of_columns(x: np.ndarray) -> np.ndarray:
            total, t, points = np.zeros((len(y), len(x))), np.empty(len(x)), np.ascontiguousarray(x.T)
            gaps = np.isnan(points).any()
            for row, low, high in zip(total, lo.T.tolist(), up.T.tolist()):
                for k, v in enumerate(points):
                    np.maximum(v, low[k], out=t)
                    np.minimum(t, high[k], out=t)
                    np.subtract(t, v, out=t)
                    if gaps:
                        t[np.isnan(t)] = 0.0
                    np.multiply(t, t, out=t)
                    np.add(row, t, out=row)
            return np.sqrt(total, out=total).T.copy()

        return matrix

    return against


def distance_matrix(arrays: DataFrame, r: int, nearest: int | None = None, both_ways: bool = False) -> DataFrame:
    """``(a, b, d)`` for a < b: the bound of a against the envelope of b.  Radius 0 is an error."""
    if r < 1:
        raise ValueError("the envelope radius must be at least 1")
    return measured(arrays, lb_matrix(r), nearest, both_ways)


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge and the zero diagonal."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    return edges.union(swapped).union(nodes.select("a", F.col("a").alias("b"), F.lit(0.0).alias("d")))


def dtw_squared(a: np.ndarray, b: np.ndarray, w: int | None = None) -> float:
    """Squared-cost time warping without the final root.

    ``w`` None or 0: unconstrained.  Otherwise row i may meet columns from
    i - w up to i + w, the last left out, w being at least the difference in
    length; where the last cell is out of reach the result is infinite.
    """
    n, m = len(a), len(b)
    if w:
        w = max(w, abs(n - m))
    before = np.full(m + 1, np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        # 1-based columns lo..hi hold the positions from i-1-w up to i-1+w, the last left out
        lo, hi = (max(0, i - 1 - w) + 1, min(m, i - 1 + w)) if w else (1, m)
        row = np.full(m + 1, np.inf)
        if hi >= lo:
            cost = (a[i - 1] - b[lo - 1 : hi]) ** 2
            reach = np.minimum(before[lo : hi + 1], before[lo - 1 : hi])
            # row[j] = cost + min(reach, row[j-1]) as a running minimum over prefix sums
            total = np.cumsum(cost)
            start = reach - np.concatenate([[0.0], total[:-1]])
            row[lo : hi + 1] = total + np.minimum.accumulate(start)
        before = row
    return float(before[m])


def dtw(a: np.ndarray, b: np.ndarray, w: int | None = None, unreachable: str = "inf") -> float:
    """Root of ``dtw_squared``.  ``unreachable`` "raise": an unreachable last cell is an error and not infinite."""
    found = dtw_squared(a, b, w)
    if unreachable == "raise" and math.isinf(found):
        raise ValueError(f"a band of {w} does not reach the last cell of curves of {len(a)} and {len(b)} points")
    return math.sqrt(found)


def fast_dtw(a: np.ndarray, b: np.ndarray, radius: int = 1) -> float:
    """Multi-resolution warping with absolute cost: solve at half resolution, refine within ``radius`` of its path."""
    return _refine(np.asarray(a, float), np.asarray(b, float), radius)[0]


def _refine(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[float, list[tuple[int, int]]]:
    n, m = len(a), len(b)
    if n < radius + 3 or m < radius + 3:
        return _banded(a, b, [(0, m - 1)] * n)
    half = lambda x: x[: len(x) // 2 * 2].reshape(-1, 2).mean(1)
    _, path = _refine(half(a), half(b), radius)
    low, high = np.full(n, m), np.full(n, -1)
    for i, j in path:
        for x in range(max(0, 2 * (i - radius)), min(n, 2 * (i + radius) + 2)):
            low[x] = min(low[x], max(0, 2 * (j - radius)))
            high[x] = max(high[x], min(m - 1, 2 * (j + radius) + 1))
    low[high < 0], high[high < 0] = max(0, m - 2 - 2 * radius), m - 1
    high[-1] = m - 1
    return _banded(a, b, list(zip(np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high))))


def _banded(a: np.ndarray, b: np.ndarray, band: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
    cells: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {}
    for i, (lo, hi) in enumerate(band):
        for j in range(lo, hi + 1):
            options = [(cells[p][0], p) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p in cells]
            best, back = min(options, default=(0.0 if (i, j) == (0, 0) else math.inf, None))
            cells[i, j] = (best + abs(a[i] - b[j]), back)
    at: tuple[int, int] | None = (len(a) - 1, len(b) - 1)
    total, path = cells[at][0], []
    while at is not None:
        path.append(at)
        at = cells[at][1]
    return total, path[::-1]


def spatio_temporal(a: np.ndarray, b: np.ndarray, w: int) -> float:
    """Root of the Euclidean distance of the first two points plus the squared-cost warping of the rest."""
    return math.sqrt(float(np.linalg.norm(a[:2] - b[:2])) + dtw_squared(a[2:], b[2:], w))


def dtw_squared_many(x: np.ndarray, y: np.ndarray, w: int | None = None) -> np.ndarray:
    """``dtw_squared`` of the rows of two matrices, pair by pair."""
    n, m = x.shape[1], y.shape[1]
    if w:
        w = max(w, abs(n - m))
    before = np.full((len(x), m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(1, n + 1):
        lo, hi = (max(0, i - 1 - w) + 1, min(m, i - 1 + w)) if w else (1, m)
        row = np.full((len(x), m + 1), np.inf)
        if hi >= lo:
            total = np.cumsum((x[:, i - 1, None] - y[:, lo - 1 : hi]) ** 2, 1)
            start = np.minimum(before[:, lo : hi + 1], before[:, lo - 1 : hi])
            start[:, 1:] -= total[:, :-1]
            row[:, lo : hi + 1] = total + np.minimum.accumulate(start, 1)
        before = row
    return before[:, m]


def dtw_many(x: np.ndarray, y: np.ndarray, w: int | None = None) -> np.ndarray:
    return np.sqrt(dtw_squared_many(x, y, w))


def spatio_temporal_many(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    return np.sqrt(np.linalg.norm(x[:, :2] - y[:, :2], axis=1) + dtw_squared_many(x[:, 2:], y[:, 2:], w))


def fast_dtw_many(x: np.ndarray, y: np.ndarray, radius: int = 1, chunk: int = 2000) -> np.ndarray:
    """``fast_dtw`` of the rows of two matrices, pair by pair."""
    parts = [_refine_many(x[k : k + chunk], y[k : k + chunk], radius)[0] for k in range(0, len(x), chunk)]
    out = np.concatenate(parts) if parts else np.empty(0)
    for k in np.flatnonzero(~np.isfinite(out)):  # gaps in a curve or in a band
        out[k] = fast_dtw(x[k], y[k], radius)
    return out


def _refine_many(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    (size, n), m = a.shape, b.shape[1]
    if n < radius + 3 or m < radius + 3:
        return _banded_many(a, b, np.zeros((size, n), int), np.full((size, n), m - 1))
    half = lambda x: x[:, : x.shape[1] // 2 * 2].reshape(size, -1, 2).mean(2)
    _, path = _refine_many(half(a), half(b), radius)
    low, high = np.full((size, n), m), np.full((size, n), -1)
    for k, i, j in path:
        first, last = np.maximum(0, 2 * (j - radius)), np.minimum(m - 1, 2 * (j + radius) + 1)
        for off in range(-2 * radius, 2 * radius + 2):
            x = 2 * i + off
            ok = (x >= 0) & (x < n)
            at = k[ok], x[ok]
            low[at], high[at] = np.minimum(low[at], first[ok]), np.maximum(high[at], last[ok])
    none = high < 0
    low[none], high[none] = max(0, m - 2 - 2 * radius), m - 1
    high[:, -1] = m - 1
    return _banded_many(a, b, np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1], np.maximum.accumulate(high, 1))


def _banded_many(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Totals, and paths from the last cell back as steps ``(pair, i, j)`` of the pairs still under way."""
    (size, n), m = a.shape, b.shape[1]
    cells, back = np.full((n + 1, m + 1, size), np.inf), np.zeros((n, m, size), np.int8)
    cells[0, 0] = 0.0
    x, y, low, high = (np.ascontiguousarray(v.T) for v in (a, b, low, high))
    for i in range(n):
        for j in range(low[i].min(), high[i].max() + 1):
            # the bands of many pairs are wide together and each is narrow: only pairs whose own band has the cell are looked at
            on = np.flatnonzero((low[i] <= j) & (j <= high[i]))
            slant, up, left = cells[i, j].take(on), cells[i, j + 1].take(on), cells[i + 1, j].take(on)
            side = np.minimum(up, left)
            back[i, j, on] = np.where(slant <= side, 0, np.where(up <= left, 1, 2))
            cells[i + 1, j + 1, on] = np.minimum(slant, side) + np.abs(x[i].take(on) - y[j].take(on))
    path, k = [], np.arange(size)
    i, j = np.full(size, n - 1), np.full(size, m - 1)
    while len(k):
        path.append((k, i, j))
        step = back[i, j, k]
        i, j = i - (step < 2), j - (step != 1)
        on = (i >= 0) & (j >= 0)
        k, i, j = k[on], i[on], j[on]
    return cells[n, m], path


def dtw_squared_matrix(w: int | None = None, width: int = 2048) -> Matrix:
    """``dtw_squared`` of each a to each b, of one length, by diagonals of cells: those of one do not depend on each other."""

    def against(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        n = y.shape[1]
        spans = [(s, max(0, s - n + 1, -((w - 1 - s) // 2) if w else 0), min(n - 1, s, (s + w) // 2 if w else s)) for s in range(2 * n - 1)]
        parts = [np.ascontiguousarray(y[c : c + width].T) for c in range(0, len(y), width)]

        def of(a: np.ndarray, points: np.ndarray) -> np.ndarray:
            # rows i + 1 of the cells (i, s - i) of this diagonal s and of the two before; infinite beside them
            new, last, before = np.full((3, n + 2, points.shape[1]), np.inf)
            before[0], cost = 0.0, np.empty_like(points)
            for s, i, j in spans:
                cells, c = new[i + 1 : j + 2], cost[: j - i + 1]
                np.minimum(last[i + 1 : j + 2], last[i : j + 1], out=cells)
                np.minimum(cells, before[i : j + 1], out=cells)
                np.subtract(points[s - j : s - i + 1][::-1], a[i : j + 1, None], out=c)
                np.multiply(c, c, out=c)
                np.add(cells, c, out=cells)
                new[i] = new[j + 2] = np.inf
                if s == 0:
                    before[0] = np.inf
                new, last, before = before, new, last
            return last[n]

        return lambda x: np.stack([np.concatenate([of(a, points) for points in parts]) for a in x])

    return against


def rooted(matrix: Matrix) -> Matrix:
    """``matrix`` with the root drawn."""

    def against(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        near = matrix(y)
        return lambda x: np.sqrt(near(x))

    return against


def spatio_temporal_matrix(w: int) -> Matrix:
    """``spatio_temporal`` of each a to each b."""

    def against(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        rest = dtw_squared_matrix(w)(y[:, 2:])
        return lambda x: np.sqrt(np.linalg.norm(x[:, None, :2] - y[None, :, :2], axis=2) + rest(x[:, 2:]))

    return against


Distance = Callable[[np.ndarray, np.ndarray], float]
Distances = Callable[[np.ndarray, np.ndarray], np.ndarray]


def row_by_row(many: Distances) -> Matrix:
    """``many`` of the rows of two matrices, pair by pair, for each a and each b."""

    def against(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: many(np.repeat(x, len(y), 0), np.tile(y, (len(x), 1))).reshape(len(x), len(y))

    return against


def pairwise(arrays: DataFrame, distance: Distance, matrix: Matrix | None = None, digits: int | None = None) -> DataFrame:
    """``(a, b, d)`` of every pair a < b by a Python distance.

    ``matrix`` measures two blocks at once and takes the place of ``distance``
    where all their curves are equally long.
    """

    def each(y: list[np.ndarray]) -> Callable[[list[np.ndarray]], np.ndarray]:
        return lambda x: np.array([[distance(p, q) for q in y] for p in x], float).reshape(len(x), len(y))

    def stream(low: pd.DataFrame, high: pd.DataFrame | None) -> Iterator[pa.RecordBatch]:
        other = low if high is None else high
        ids, high_ids = low["series_id"].to_numpy(), other["series_id"].to_numpy()
        if matrix and len({*map(len, low["y"]), *map(len, other["y"])}) == 1:
            found = strips(stacked(low), None if high is None else stacked(high), matrix)
        else:
            x, y = ([np.asarray(c, float) for c in side["y"]] for side in (low, other))
            found = ((i, i if high is None else 0, each(y[i if high is None else 0 :])(x[i : i + 1])) for i in range(len(x)))
        for i, j, d in found:
            yield from _batches(ids[i : i + len(d)], high_ids[j:], d, high is None, digits)

    kind = arrays.schema["series_id"].dataType.simpleString()
    return streamed(ranged(arrays), stream, f"a {kind}, b {kind}, d double")


def correlation_matrix(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """1 - Pearson correlation of curves of zero mean and unit deviation."""
    return lambda x: 1 - x @ y.T / y.shape[1]


def unit(arrays: DataFrame) -> DataFrame:
    """Curves of zero mean and unit deviation."""
    return S.znorm(arrays.select("series_id", "y")).select("series_id", "y")


def correlation_distance(arrays: DataFrame, digits: int | None = None) -> DataFrame:
    """1 - Pearson correlation of curves of equal length; null where one is flat."""
    return listed(unit(arrays), correlation_matrix, digits)
