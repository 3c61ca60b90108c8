"""Label maps, class weights and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: The eight emotions in label order.
EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")


def biclass(sentiment: Column) -> Column:
    """0 below zero, else 1: zero is positive."""
    return F.when(sentiment < 0, 0).when(sentiment.isNotNull(), 1)


def triclass(sentiment: Column, t: float = 0.5) -> Column:
    """0 below -t, 2 above t, else 1."""
    return F.when(sentiment < -t, 0).when(sentiment > t, 2).when(sentiment.isNotNull(), 1)


def valence_class(valence: Column, t: float = 0.25) -> Column:
    """0 below t, else 1; t itself is positive."""
    return F.when(valence < t, 0).when(valence.isNotNull(), 1)


def bin_label(score: Column) -> Column:
    """[0, 5) is 0, [5, 10) is 1, below 0 is -1, from 10 on null."""
    return F.when(score < 0, -1).when(score < 5, 0).when(score < 10, 1)


def label_map(names: tuple[str, ...]) -> Column:
    return F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])


def split_positional(rn: Column, n: Column, train: float = 0.8, valid: float = 0.1) -> Column:
    """train for the first int(.8 n) rows (rn from 0), valid for the next int(.1 n), test for the rest."""
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(valid))
    return F.when(rn < a, "train").when(rn < a + b, "valid").otherwise("test")


def class_weights(counts: DataFrame, count: str = "n") -> DataFrame:
    """``weight``: max/c scaled to sum 1; 0 for an empty class.  One row per class, so one task suffices."""
    everything = Window.partitionBy(F.lit(0))
    raw = F.when(F.col(count) == 0, 0.0).otherwise(F.max(count).over(everything) / F.col(count))
    return counts.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(everything)).drop("_raw")


def softmax(v: str, temperature: float = 1.0) -> Column:
    e = F.transform(v, lambda x: F.exp(x / F.lit(temperature)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(v: str) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def top_k(v: str, k: int) -> Column:
    """Indices of the k greatest values, greatest first, lower index on ties."""
    indexed = F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(indexed), 1, k), lambda s: s["i"])


def not_neutral(sentiment: Column, t: float = 0.5, compat: bool = False) -> Column:
    """Beyond t either way.  ``compat``: t itself is kept as well, as a reader of written records did."""
    return F.abs(sentiment) >= t if compat else F.abs(sentiment) > t


def present(*values: Column, compat: bool = False) -> Column:
    """All values known.  ``compat``: a zero counts as unknown."""
    kept = F.lit(True)
    for v in values:
        kept = kept & v.isNotNull() & ((v != 0) if compat else F.lit(True))
    return kept


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: the mean of the known values by weight; null where none is known or the weights are 0."""
    known = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(known), F.lit(0))


def running_mean_compat(items: list[tuple[float | None, float]]) -> float:
    """The order-dependent mean in which an unknown value's weight counts as the mean so far."""
    mean, total = 0.0, 0.0
    for value, weight in items:
        total += weight
        if value is not None and total:
            mean += (value - mean) * weight / total
    return mean


def clip_starts(length: int, window: int = 20, stride: int = 20, batch: int = 1, compat: bool = False) -> list[int]:
    """First seconds of the clips of a recording; ``compat``: within a batch clips step by the window, not the stride."""
    count = (length - window) // stride + 1 if length >= window else 0
    if not compat or batch <= 1:
        return [c * stride for c in range(count)]
    return [(c // batch) * batch * stride + (c % batch) * window for c in range(count)]
