"""Clustering of curves: k-means on the envelope bound, k-medoids, single linkage and density clustering.

Curves and edges stay distributed; only what is per cluster (k centroids or
medoids) or a spanning tree's n - 1 edges visits the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidecurve.operators import distances as D
from tidecurve.shared import cut, drop

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Curves whose spanning tree the driver takes, 24 bytes an edge; the distances it comes from are 10**13 then.
MOST_NODES = 5_000_000


def envelope_bound(r: int) -> Measure:
    """Distances of (n, L) curves to one centre by the envelope lower bound."""

    def measure(curves: np.ndarray, centre: np.ndarray) -> np.ndarray:
        n = len(centre)
        at = [(max(0, k - r), min(n, k + r)) for k in range(n)]
        lo, up = np.array([centre[s:e].min() for s, e in at]), np.array([centre[s:e].max() for s, e in at])
        return np.sqrt((np.clip(curves - up, 0, None) ** 2 + np.clip(lo - curves, 0, None) ** 2).sum(1))

    return measure


def spatial_bound(w: int, prune: int = 5) -> Measure:
    """Spatio-temporal distance; curves whose envelope bound exceeds the best so far are not warped."""
    bound = envelope_bound(prune)

    def measure(curves: np.ndarray, centre: np.ndarray) -> np.ndarray:
        lower, out = bound(curves, centre), np.full(len(curves), np.inf)
        for i in np.argsort(lower, kind="stable"):
            out[i] = D.spatio_temporal(curves[i], centre, w)
        return out

    return measure


def assign(arrays: DataFrame, centres: list[np.ndarray], measure: Measure) -> DataFrame:
    """``(series_id, cluster, dist, y)``: nearest centre, the lower number on ties."""
    kind = arrays.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                curves = np.stack([np.asarray(y, float) for y in batch["y"]])
                d = np.stack([measure(curves, c) for c in centres], 1)
                yield pd.DataFrame({"series_id": batch["series_id"], "cluster": d.argmin(1), "dist": d.min(1), "y": batch["y"]})

    return arrays.select("series_id", "y").mapInPandas(run, f"series_id {kind}, cluster int, dist double, y array<double>")


def centroids(assigned: DataFrame) -> DataFrame:
    """``(cluster, i, value)``: the mean curve of each cluster's members."""
    return assigned.select("cluster", F.posexplode("y").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("value"))


def seeds(arrays: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """k curves drawn by a seeded hash of their ids."""
    rows = arrays.orderBy(F.xxhash64(F.lit(seed), "series_id"), "series_id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters of {len(rows)} curves")
    return [np.asarray(r["y"], float) for r in rows]


def trained(own: DataFrame, k: int, iterations: int, measure: Measure, seed: int = 0) -> list[np.ndarray]:
    """The k centres after the iterations, or as soon as no centre moves; ``own`` is read once per iteration."""
    centres = seeds(own, k, seed)
    for _ in range(iterations):
        means = centroids(assign(own, centres, measure)).collect()  # k curves
        moved = [c.copy() for c in centres]
        for r in means:
            moved[r["cluster"]][r["i"]] = r["value"]
        if all(np.allclose(a, b, atol=1e-12) for a, b in zip(moved, centres)):
            break
        centres = moved
    return centres


def kmeans(arrays: DataFrame, k: int, iterations: int, measure: Measure, seed: int = 0) -> DataFrame:
    """``(series_id, cluster, dist)`` at the trained centres."""
    own = cut(arrays.select("series_id", "y"), "kmeans")
    return assign(own, trained(own, k, iterations, measure, seed), measure).drop("y")


def medoid_assign(full: DataFrame, medoids: list) -> DataFrame:
    """``(a, cluster, d)``: each node's nearest medoid over mirrored edges ``(a, b, d)``; smaller id on ties."""
    return full.where(F.col("b").isin(medoids)).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("cluster"), F.col("m.d").alias("d"))


def medoid_update(full: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(cluster, medoid)``: the member with the least mean distance within its cluster; smaller id on ties."""
    inside = full.join(assigned.select("a", "cluster"), "a").join(assigned.select(F.col("a").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other")
    mean = inside.groupBy("cluster", "a").agg(F.avg("d").alias("mean"))
    return mean.groupBy("cluster").agg(F.min(F.struct("mean", "a")).alias("m")).select("cluster", F.col("m.a").alias("medoid"))


def kmedoids(edges: DataFrame, k: int, rounds: int = 100, seed: int = 0) -> DataFrame:
    """``(a, cluster, d)``; the cluster is named by its medoid."""
    full = cut(D.mirrored(edges), "kmedoids")
    nodes = [r["a"] for r in full.select("a").distinct().orderBy(F.xxhash64(F.lit(seed), "a"), "a").limit(k).collect()]
    if len(nodes) < k:
        raise ValueError(f"{k} clusters of {len(nodes)} nodes")
    medoids = sorted(nodes)
    for _ in range(rounds):
        new = sorted(r["medoid"] for r in medoid_update(full, medoid_assign(full, medoids)).collect())
        if new == medoids:
            break
        medoids = new
    return medoid_assign(full, medoids)


def nearest_medoids(curves: DataFrame, medoids: dict[int, dict[int, tuple]], matrix: D.Matrix) -> DataFrame:
    """``(series_id, slot_<k>, medoid_<k>, d_<k> ...)``: the nearest of ``medoids[k] = {slot: (series_id, y)}``, smaller id on ties.

    Of two curves that with the smaller id is measured against the other, so
    distances are those of the matrix; a medoid has none to itself.
    """
    kind = curves.schema["series_id"].dataType.simpleString()
    known = sorted({x: y for own in medoids.values() for x, y in own.values()}.items())
    at = {x: i for i, (x, _) in enumerate(known)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = np.array([y for _, y in known], float)
        for batch in batches:
            if not len(batch):
                continue
            ids, x = batch["series_id"].to_numpy(), D.stacked(batch)
            below, above = matrix(centres)(x), matrix(x)(centres).T
            d = np.stack([np.where(ids < m, below[:, i], np.where(ids > m, above[:, i], 0.0)) for i, (m, _) in enumerate(known)], 1)
            out = {"series_id": batch["series_id"]}
            for k, own in medoids.items():
                slots = sorted(own, key=lambda s: own[s][0])
                columns = [at[own[s][0]] for s in slots]
                best = d[:, columns].argmin(1)
                out |= {f"slot_{k}": np.array(slots)[best], f"medoid_{k}": pd.Series([own[slots[i]][0] for i in best]), f"d_{k}": d[:, columns].min(1)}
            yield pd.DataFrame(out)

    return curves.select("series_id", "y").mapInPandas(run, f"series_id {kind}, " + ", ".join(f"slot_{k} int, medoid_{k} {kind}, d_{k} double" for k in medoids))


def _quantum(curves: DataFrame) -> float:
    """A power of two: sums of all distances of one curve, in steps of it, are exact in a double.

    No distance exceeds the root of the length times the range of the points.
    """
    n, size, high = curves.agg(F.count(F.lit(1)), F.max(F.size("y")), F.max(F.array_max(F.transform("y", lambda v: F.abs(v))))).collect()[0]
    most = 2 * (high or 0.0) * math.sqrt(max(1, size or 1)) * max(1, n)
    return 2.0 ** (math.ceil(math.log2(most)) - 52) if most > 0 else 2.0**-52


def best_medoids(labels: DataFrame, sums: DataFrame, slots: dict[int, list[int]]) -> dict[int, dict[int, object]]:
    """Of every k and slot the member with the least sum of distances to the members; smaller id on ties."""
    of = [F.struct(F.lit(k).alias("k"), F.col(f"slot_{k}").alias("slot"), F.array(*[F.col(f"w_{k}_{s}") if s in own else F.lit(None).cast("double") for s in range(max(own) + 1)])[F.col(f"slot_{k}")].alias("sum")) for k, own in slots.items()]
    rows = labels.join(sums, "series_id").select("series_id", F.inline(F.array(*of)))
    found: dict[int, dict[int, object]] = {k: {} for k in slots}
    for r in rows.groupBy("k", "slot").agg(F.min(F.struct("sum", "series_id"))["series_id"].alias("medoid")).collect():
        found[r["k"]][r["slot"]] = r["medoid"]
    return found


def trained_medoids(blocks: DataFrame, ks: list[int], matrix: D.Matrix, rounds: int = 100, seed: int = 0) -> dict[int, dict[int, tuple]]:
    """``{k: {slot: (series_id, y)}}`` of the curves in ``distances.ranged`` blocks, without their matrix.

    What the distances to every cluster add up to is kept for each curve, and
    a round measures only the curves that changed clusters against all others.
    """
    drawn = blocks.orderBy(F.xxhash64(F.lit(seed), "series_id"), "series_id").limit(max(ks)).collect()
    if len(drawn) < max(ks):
        raise ValueError(f"{max(ks)} clusters of {len(drawn)} nodes")
    medoids = {k: {s: (r["series_id"], r["y"]) for s, r in enumerate(sorted(drawn[:k], key=lambda r: r["series_id"]))} for k in ks}
    quantum, names = _quantum(blocks), [f"w_{k}_{s}" for k in ks for s in range(k)]
    labels = sums = None
    for _ in range(rounds):
        new = cut(nearest_medoids(blocks, medoids, matrix), "medoid-labels")
        if labels is None:
            moved = blocks.join(new, "series_id")
        else:
            was = labels.select("series_id", *[F.col(f"slot_{k}").alias(f"was_{k}") for k in ks])
            moved = blocks.join(new, "series_id").join(was, "series_id")
        weight = lambda k, s: (F.col(f"slot_{k}") == s).cast("double") - (0.0 if labels is None else (F.col(f"was_{k}") == s).cast("double"))
        weighed = moved.select("series_id", "y", "block", *[weight(k, s).alias(f"w_{k}_{s}") for k in ks for s in range(k)])
        change = D.weighed_sums(weighed, matrix, names, quantum)
        if sums is not None:
            change = change.unionByName(sums).groupBy("series_id").agg(*[F.sum(w).alias(w) for w in names])
        total = cut(change, "medoid-sums")
        if sums is not None:
            drop(labels, sums)
        labels, sums = new, total
        best = best_medoids(labels, sums, {k: sorted(own) for k, own in medoids.items()})
        if all({*best[k].values()} == {x for x, _ in medoids[k].values()} for k in ks):
            break
        curves = {r["series_id"]: r["y"] for r in blocks.where(F.col("series_id").isin([x for own in best.values() for x in own.values()])).collect()}
        medoids = {k: {s: (x, curves[x]) for s, x in best[k].items()} for k in ks}
    return medoids


def updated_medoids(blocks: DataFrame, labels: DataFrame, k: int, matrix: D.Matrix) -> DataFrame:
    """``(cluster, medoid)`` of ``nearest_medoids``: one step of ``trained_medoids``, without the matrix."""
    own, names = cut(labels, "medoid-labels"), [f"w_{k}_{s}" for s in range(k)]
    weighed = blocks.join(own, "series_id").select("series_id", "y", "block", *[(F.col(f"slot_{k}") == s).cast("double").alias(f"w_{k}_{s}") for s in range(k)])
    sums = D.weighed_sums(weighed, matrix, names, _quantum(blocks))
    inside = own.join(sums, "series_id").withColumn("sum", F.array(*names)[F.col(f"slot_{k}")])
    return inside.groupBy(F.col(f"medoid_{k}").alias("cluster")).agg(F.min(F.struct("sum", "series_id"))["series_id"].alias("medoid"))


def kmedoids_of(arrays: DataFrame, ks: list[int], matrix: D.Matrix) -> DataFrame:
    """``(series_id, medoid_<k>, d_<k> ...)`` at the trained medoids of every k, as ``kmedoids`` has them from edges."""
    blocks = D.ranged(arrays, rows=D.WIDE_ROWS)
    return nearest_medoids(blocks, trained_medoids(blocks, ks, matrix), matrix)


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest ``(a, b, d)`` by rounds of cheapest outgoing edges; ties by node ids."""
    spark = edges.sparkSession
    alive = cut(edges.select("a", "b", "d"), "tree-edges")
    part = alive.select("a").union(alive.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("part"))
    chosen = spark.createDataFrame([], alive.schema)
    while True:
        pa, pb = part.toDF("a", "pa"), part.toDF("b", "pb")
        between = alive.join(pa, "a").join(pb, "b").where("pa != pb").select("pa", "pb", F.struct("d", "a", "b").alias("e"))
        best = between.select(F.col("pa").alias("part"), "e").union(between.select(F.col("pb").alias("part"), "e")).groupBy("part").agg(F.min("e").alias("e"))
        taken = cut(best.select("e").distinct().select("e.a", "e.b", "e.d"), "tree-taken")
        if taken.isEmpty():
            return chosen
        chosen = cut(chosen.unionByName(taken), "tree-chosen")
        part = cut(_components(part, taken), "tree-parts")


def _components(part: DataFrame, links: DataFrame) -> DataFrame:
    """Merge parts along links: the least label spreads and jumps until nothing changes."""
    ends = links.join(part.toDF("a", "pa"), "a").join(part.toDF("b", "pb"), "b").select("pa", "pb")
    both = cut(ends.union(ends.select(F.col("pb").alias("pa"), F.col("pa").alias("pb"))).distinct(), "tree-links")
    label = part.select("part").distinct().select("part", F.col("part").alias("to"))
    while True:
        near = both.join(label.toDF("pb", "to"), "pb").groupBy(F.col("pa").alias("part")).agg(F.min("to").alias("least"))
        spread = label.join(near, "part", "left").select("part", "to", F.least("to", F.coalesce("least", "to")).alias("next"))
        # jump: follow the label's own label
        jump = spread.select(F.col("part").alias("next"), F.col("next").alias("far"))
        stepped = cut(spread.join(jump, "next", "left").select("part", "to", F.least("next", F.coalesce("far", "next")).alias("next")), "tree-labels")
        changed = stepped.where("to != next").isEmpty()
        label = stepped.select("part", F.col("next").alias("to"))
        if changed:
            return part.join(label, "part").select("node", F.col("to").alias("part"))


def _tree_edges(tree: DataFrame) -> list[tuple]:
    """The tree's edges ``(d, a, b)`` in order, after a check of their number."""
    kept = cut(tree, "tree")
    if kept.count() >= MOST_NODES:
        raise ValueError(f"a hierarchy over more than {MOST_NODES} curves")
    return [(r["d"], r["a"], r["b"]) for r in kept.orderBy("d", "a", "b").collect()]


def single_linkage(edges: DataFrame) -> DataFrame:
    """Merges ``(step, left, right, height, size)`` in order of height; new clusters are n, n + 1, ..."""
    tree = _tree_edges(spanning_tree(edges))
    nodes = sorted({x for _, a, b in tree for x in (a, b)})
    index, size = {x: i for i, x in enumerate(nodes)}, [1] * len(nodes)
    parent = list(range(len(nodes)))
    top = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for step, (d, a, b) in enumerate(tree):
        x, y = root(index[a]), root(index[b])
        left, right = sorted((top[x], top[y]))
        parent[y] = x
        size[x] += size[y]
        top[x] = len(nodes) + step
        out.append((step, left, right, float(d), size[x]))
    return edges.sparkSession.createDataFrame(out, "step int, left int, right int, height double, size int")


def core_distance(full: DataFrame, min_samples: int) -> DataFrame:
    """``(a, core)``: distance to the ``min_samples``-th neighbour, oneself included, over mirrored edges."""
    nth = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return full.withColumn("nth", nth).where(F.col("nth") == min_samples).select("a", F.col("d").alias("core"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    joined = edges.join(core, "a").join(core.toDF("b", "core_b"), "b")
    return joined.select("a", "b", F.greatest("d", "core", "core_b").alias("d"))


def hdbscan(edges: DataFrame, min_cluster_size: int = 5, min_samples: int = 5) -> DataFrame:
    """``(node, cluster)``, -1 for noise: spanning tree of mutual reachability, condensed, most stable clusters."""
    reach = mutual_reachability(edges, core_distance(D.mirrored(edges), min_samples))
    return _labelled(reach, min_cluster_size)


def hdbscan_of(arrays: DataFrame, r: int, min_cluster_size: int = 5, min_samples: int = 5) -> DataFrame:
    """``hdbscan`` of curves by their envelope bound, without the matrix: nearest neighbours, then the trees of blocks."""
    core = core_distance(D.distance_matrix(arrays, r, nearest=min_samples - 1, both_ways=True), min_samples - 1)
    own = arrays.select("series_id", "y").join(cut(core, "core").toDF("series_id", "core"), "series_id")
    return _labelled(D.tree_edges(own, D.lb_matrix(r), "core"), min_cluster_size)


def _labelled(reach: DataFrame, min_cluster_size: int) -> DataFrame:
    """The most stable clusters of edges of mutual reachability, or of all that a spanning tree may need."""
    tree = _tree_edges(spanning_tree(reach))
    nodes = sorted({x for _, a, b in tree for x in (a, b)})
    labels = _condense(nodes, tree, min_cluster_size)
    kind = reach.schema["a"].dataType.simpleString()
    return reach.sparkSession.createDataFrame([(x, c) for x, c in zip(nodes, labels)], f"node {kind}, cluster int")


def sizes_by_method(own: DataFrame, methods: str, ks: str, r: int, iterations: int = 5) -> DataFrame:
    """``(method, k, cluster, n)`` for every method of a comma-separated list and every k of another.

    No method needs the distance matrix.  Hierarchical
    clusters are the parts left when the k - 1 highest merges are undone.
    """
    out, tree, medoids = [], None, None
    for method in (m.strip() for m in methods.split(",")):
        for k in [int(v) for v in ks.split(",")] if method != "hdbscan" else [0]:
            if method == "kmeans":
                labels = kmeans(own, k, iterations, envelope_bound(r)).select("cluster")
            elif method == "kmedoids":
                medoids = medoids if medoids is not None else cut(kmedoids_of(own, sorted({int(v) for v in ks.split(",")}), D.lb_matrix(r)), "methods-medoids")
                labels = medoids.select(F.col(f"medoid_{k}").alias("cluster"))
            elif method == "hierarchical":
                tree = tree if tree is not None else cut(spanning_tree(D.tree_edges(D.unit(own), D.correlation_matrix)), "methods-tree")
                nodes = tree.select("a").union(tree.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("part"))
                highest = tree.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(k - 1)
                left = tree.join(highest.select("a", "b"), ["a", "b"], "left_anti")
                labels = _components(nodes, left).select(F.col("part").alias("cluster"))
            elif method == "hdbscan":
                labels = hdbscan_of(own, r, 4, 3).select("cluster")
            else:
                raise ValueError(f"unknown method {method!r}")
            out.append(labels.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(method).alias("method"), F.lit(k).alias("k"), "cluster", "n"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def _condense(nodes: list, tree: list[tuple], least: int) -> list[int]:
    n = len(nodes)
    index = {x: i for i, x in enumerate(nodes)}
    parent, made = list(range(n)), list(range(n))
    children: dict[int, tuple[int, int, float]] = {}
    size = {i: 1 for i in range(n)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, a, b in tree:
        x, y = root(index[a]), root(index[b])
        new = n + len(children)
        children[new] = (made[x], made[y], d)
        size[new] = size[made[x]] + size[made[y]]
        parent[y] = x
        made[x] = new
    if not children:
        return [-1] * n
    rate = lambda d: 1 / d if d > 0 else math.inf

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += children[v][:2]
        return out

    # clusters: (birth, parent cluster); points fall out of a cluster or it splits in two large parts
    birth, above, stability, tops = [0.0], [-1], [0.0], [n + len(children) - 1]
    work = [(n + len(children) - 1, 0)]
    while work:
        node, cluster = work.pop()
        if node < n:
            continue
        left, right, d = children[node]
        level = min(rate(d), 1e12)
        big = [c for c in (left, right) if size[c] >= least]
        if len(big) == 2:
            stability[cluster] += (level - birth[cluster]) * size[node]
            for c in big:
                birth.append(level)
                above.append(cluster)
                stability.append(0.0)
                tops.append(c)
                work.append((c, len(birth) - 1))
        else:
            stability[cluster] += (level - birth[cluster]) * sum(size[c] for c in (left, right) if size[c] < least)
            work += [(c, cluster) for c in big]
    value, keep, below = list(stability), [True] * len(birth), [[] for _ in birth]
    for k, c in enumerate(above):
        if c >= 0:
            below[c].append(k)
    for c in range(len(birth) - 1, -1, -1):
        own = below[c]
        if own and (c == 0 or sum(value[k] for k in own) > stability[c]):
            keep[c], value[c] = False, sum(value[k] for k in own)
    labels, number = [-1] * n, 0
    within = [False] * len(birth)  # lies in a kept cluster; parents come before their children
    for c in range(len(birth)):
        within[c] = above[c] >= 0 and (within[above[c]] or keep[above[c]])
        if keep[c] and not within[c] and c:
            for v in leaves(tops[c]):
                labels[v] = number
            number += 1
    return labels
