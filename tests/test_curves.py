"""Golden cases, numpy twins and properties of the curve operators."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidecurve.operators import cluster as C, distances as D, peaks as P, series as S


def frame(spark, *curves):
    return spark.createDataFrame([(k, [float(v) for v in y]) for k, y in enumerate(curves)], "series_id bigint, y array<double>")


def smoothed(spark, y, w, kind="hanning"):
    return np.array(S.smooth(frame(spark, y), w, kind).first()["y"])


@pytest.mark.parametrize("kind,w", [("flat", 8), ("hanning", 9), ("hamming", 4), ("bartlett", 7), ("blackman", 5), ("hanning", 100)])
def test_smooth_equals_convolution(spark, kind, w):
    rng = np.random.default_rng(w)
    y = rng.random(130)
    left, right = w // 2, (w - 1) // 2
    padded = np.concatenate([2 * y[0] - y[:left][::-1], y, 2 * y[-1] - y[len(y) - right :][::-1]])
    expected = np.convolve(padded, S.kernel(kind, w), mode="valid")
    assert np.allclose(smoothed(spark, y, w, kind), expected, atol=1e-12)


def test_smooth_edges(spark):
    assert np.allclose(smoothed(spark, [3.0] * 12, 5), 3.0)
    assert np.allclose(smoothed(spark, range(20), 7)[3:-3], range(3, 17))  # a line stays in the interior
    assert smoothed(spark, [1, 5, 2], 2).tolist() == [1, 5, 2]
    with pytest.raises(Exception, match="shorter than the smoothing window"):
        S.smooth(frame(spark, [1, 2]), 5).collect()
    with pytest.raises(ValueError):
        S.smooth(frame(spark, [1, 2, 3]), 3, "cubic")


def test_resample_and_znorm(spark):
    rng = np.random.default_rng(3)
    y = rng.random(17)
    got = S.resample(frame(spark, y), 40).first()["y"]
    assert np.allclose(got, np.interp(np.linspace(0, 16, 40), range(17), y))
    z = np.array(S.znorm(frame(spark, y)).first()["y"])
    assert abs(z.mean()) < 1e-12 and abs(z.std() - 1) < 1e-12
    assert S.znorm(frame(spark, [2, 2, 2])).first()["y"] == [None] * 3


def test_prepare_skips_empty_and_short(spark):
    out = S.prepare(frame(spark, [], [1] * 4, range(30)), None, 5, 1, 100, 10)
    assert [r["series_id"] for r in out.collect()] == [2]


def brute_dtw(a, b, w=None):
    n, m = len(a), len(b)
    if w:
        w = max(w, abs(n - m))
    best = np.full((n + 1, m + 1), math.inf)
    best[0, 0] = 0
    for i in range(n):
        for j in range(max(0, i - w), min(m, i + w)) if w else range(m):
            best[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(best[i, j + 1], best[i + 1, j], best[i, j])
    return math.sqrt(best[n, m])


def test_warping_distances():
    rng = np.random.default_rng(5)
    for n, m, w in ((12, 12, 3), (12, 9, 2), (9, 12, 0), (7, 7, 1), (10, 10, None)):
        a, b = rng.random(n), rng.random(m)
        assert np.isclose(D.dtw(a, b, w), brute_dtw(a, b, w), equal_nan=True)
    assert D.dtw(np.zeros(5), np.zeros(8), 3) == math.inf  # the last cell is out of reach
    a, b = rng.random(60), rng.random(60)
    exact = D._banded(a, b, [(0, 59)] * 60)[0]
    assert exact <= D.fast_dtw(a, b) <= 1.6 * exact
    assert D.fast_dtw(a, a) == 0


def test_bound_is_below_warping_and_pairs_come_once(spark):
    rng = np.random.default_rng(8)
    curves = [rng.random(30) for _ in range(9)]
    got = {(r["a"], r["b"]): r["d"] for r in D.distance_matrix(frame(spark, *curves), 4).collect()}
    assert len(got) == 36
    measure = C.envelope_bound(4)
    for (a, b), d in got.items():
        assert np.isclose(d, measure(np.array([curves[a]]), curves[b])[0])
        assert d <= D.dtw(curves[a], curves[b], 4) + 1e-9
    with pytest.raises(ValueError):
        D.distance_matrix(frame(spark, [1.0]), 0)


def long(spark, y):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "series_id bigint, i bigint, value double")


def found(df):
    return [r["i"] for r in df.orderBy("i").collect()]


def test_peaks(spark):
    flat = long(spark, [0, 1, 1, 0, 1, 1, 0])
    assert found(P.peaks(flat, None)) == []
    assert found(P.peaks(flat, "rising")) == [1, 4]
    assert found(P.peaks(flat, "falling")) == [2, 5]
    assert found(P.peaks(flat, "both")) == [1, 2, 4, 5]
    assert found(P.peaks(long(spark, [-2, 1, -2, 2, 1, 1, 3, 0]), threshold=2)) == [1, 6]
    assert found(P.peaks(long(spark, [0, 2, float("nan"), 2, 0, 3, 0]))) == [5]
    assert found(P.peaks(long(spark, [0, 1]))) == []
    assert found(P.peaks(long(spark, [3, 1, 3, 0, 3]), None, valley=True)) == [1, 3]
    steps = P.peaks(long(spark, [0, 1, 0, 2, 0, 3, 0, 2, 0, 1, 0]))
    assert found(P.distant_peaks(steps, 2)) == [1, 5, 9]


def test_suppression_prefers_later_of_equals():
    assert P.suppress(np.array([1, 3, 5]), np.array([1.0, 1.0, 1.0]), 2).tolist() == [1, 5]
    assert P.suppress(np.array([1, 3, 5]), np.array([1.0, 1.0, 1.0]), 2, True).tolist() == [1, 3, 5]


def points(*lists):
    return [(p, m, k) for at, m, k in lists for p in at]


@pytest.mark.parametrize(
    "given,expected",
    [
        (points(([0], "visual", "peak"), ([10], "audio", "valley")), [(0.0, ["visual-peak"]), (10.0, ["audio-valley"])]),
        (points(([0], "visual", "peak"), ([3], "visual", "valley")), []),
        (points(([0], "visual", "peak"), ([3], "audio", "valley")), [(1.5, ["visual-peak", "audio-valley"])]),
        (points(([0, 8], "visual", "peak"), ([4], "audio", "valley")), []),
        (
            points(([0, 20], "visual", "peak"), ([2, 50, 100], "visual", "valley"), ([22, 30, 52], "audio", "peak"), ([54, 102, 150], "audio", "valley")),
            [(21.0, ["visual-peak", "audio-peak"]), (30.0, ["audio-peak"]), (101.0, ["visual-valley", "audio-valley"]), (150.0, ["audio-valley"])],
        ),
    ],
)
def test_merge_golden(given, expected):
    assert P.merge_extrema(given, 5) == expected


def test_merge_long_and_step():
    given = points((range(0, 100, 20), "visual", "peak"), (range(10, 100, 20), "audio", "valley"))
    assert [p for p, _ in P.merge_extrema(given, 5)] == [float(x) for x in range(0, 100, 10)]
    assert [p for p, _ in P.merge_extrema(given, 5, step=3)] == [0.0, 30.0, 60.0, 90.0]


def test_boundary_search(spark):
    def boundary(hits):
        rows = [(1, i, h) for i, h in enumerate(hits)]
        return P.reverse_boundary(spark.createDataFrame(rows, "series_id bigint, i bigint, hits int")).first()["boundary"]

    assert boundary([0] * 20) is None
    assert boundary([2] * 10 + [0] * 4 + [3, 3, 0, 2, 1, 0]) == 10 + 4
    assert boundary([0] * 10 + [2] + [0] * 5 + [2, 2, 2, 2]) == 16  # five misses stop the search
    assert boundary([0] * 10 + [0, 2] + [0] * 4 + [2, 2, 2, 2]) == 11


def test_clusters(spark):
    rng = np.random.default_rng(2)
    base = [np.sin(np.linspace(0, 6, 30)), np.cos(np.linspace(0, 6, 30)) * 3]
    curves = [base[k % 2] + rng.normal(0, 0.02, 30) for k in range(16)]
    df = frame(spark, *curves)
    for rows in (
        [(r["series_id"], r["cluster"]) for r in C.kmeans(df, 2, 10, C.envelope_bound(2), seed=1).collect()],
        [(r["a"], r["cluster"]) for r in C.kmedoids(D.distance_matrix(df, 2), 2, seed=1).collect()],
        [(r["node"], r["cluster"]) for r in C.hdbscan(D.distance_matrix(df, 2), 4, 3).collect()],
    ):
        by = dict(rows)
        assert len({by[k] for k in range(0, 16, 2)}) == 1 and len({by[k] for k in range(1, 16, 2)}) == 1 and by[0] != by[1]
    with pytest.raises(ValueError):
        C.kmeans(df, 17, 1, C.envelope_bound(2))


def test_single_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.random((10, 2))
    edges = [(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(10) for j in range(i + 1, 10)]
    parent = list(range(10))
    root = lambda i: i if parent[i] == i else root(parent[i])
    heights = []
    for i, j, d in sorted(edges, key=lambda e: e[2]):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            heights.append(d)
    got = C.single_linkage(spark.createDataFrame(edges, "a bigint, b bigint, d double")).orderBy("step").collect()
    assert np.allclose([r["height"] for r in got], heights)
    assert got[-1]["size"] == 10


@pytest.mark.parametrize("name", ["kmedoids_assign", "elbow_error", "medoid_update", "kmedoids", "elbow_kmedoids", "medoid_mean_curve", "single_linkage", "hdbscan", "cluster_methods"])
def test_clusters_never_list_all_pairs(spark, sf, monkeypatch, name):
    """What is not quadratic itself keeps no table of all pairs, which the disk would not hold."""
    from tidecurve.plans import registry

    listed = D.measured

    def measured(arrays, matrix, nearest=None, both_ways=False):
        assert nearest is not None
        return listed(arrays, matrix, nearest, both_ways)

    monkeypatch.setattr(D, "measured", measured)
    assert registry.queries()[name](spark, sf).count()


def small_blocks(monkeypatch):
    for name, n in (("BLOCK_ROWS", 4), ("WIDE_ROWS", 4), ("TREE_ROWS", 3), ("STRIP", 2), ("CHUNK", 3)):
        monkeypatch.setattr(D, name, n)


def test_medoids_and_trees_equal_those_of_the_matrix(spark, monkeypatch):
    """Curves with many equal distances, in blocks of 4: the same medoids, trees and core distances as from all edges."""
    small_blocks(monkeypatch)
    rng = np.random.default_rng(8)
    df = frame(spark, *np.round(rng.normal(size=(23, 12)).cumsum(1)), *[np.arange(12.0)] * 4)
    edges, matrix = D.distance_matrix(df, 2).cache(), D.lb_matrix(2)
    of = lambda x: sorted(map(tuple, x.collect()))
    assert len(of(edges)) == 27 * 26 // 2
    many = of(C.kmedoids_of(df, [2, 3, 5], matrix))
    for at, k in enumerate((2, 3, 5)):
        assert [(r[0], r[1 + 3 * at + 1], pytest.approx(r[1 + 3 * at + 2])) for r in many] == of(C.kmedoids(edges, k))
    assert of(C.spanning_tree(D.tree_edges(df, matrix))) == of(C.spanning_tree(edges))
    core = C.core_distance(D.mirrored(edges), 4)
    assert of(C.core_distance(D.measured(df, matrix, 3, True), 3)) == of(core)
    assert of(C.spanning_tree(D.tree_edges(df.join(core.toDF("series_id", "core"), "series_id"), matrix, "core"))) == of(C.spanning_tree(C.mutual_reachability(edges, core)))


@pytest.mark.parametrize("name", ["distance_matrix", "matrix_mirror", "mutual_reachability", "pair_self_join", "corr_distance", "dtw_pairs", "fastdtw_pairs"])
def test_listed_pairs_are_not_exchanged_again(spark, sf, name):
    """A block goes through one exchange, not through one for each block that it meets; nothing joins or explodes pairs after."""
    from tidecurve.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert below and "Join" not in above and "Generate" not in plan and below.count("Join") == 1


def test_listed_pairs_equal_brute_force(spark, monkeypatch):
    """Blocks of 4, a missing id, equal and flat curves: every pair once, both ways with the diagonal, and below no core distance."""
    small_blocks(monkeypatch)
    rng = np.random.default_rng(4)
    y = np.round(rng.normal(size=(11, 8)).cumsum(1), 1)
    df = frame(spark, *y).withColumn("core", F.col("series_id") / 2).union(spark.sql("select cast(null as bigint), array_repeat(0D, 8), 1D"))
    bound = {(a, b): float(D.lb_matrix(2)(y[b : b + 1])(y[a : a + 1])[0, 0]) for a in range(11) for b in range(11) if a < b}
    of = lambda **kw: {(r["a"], r["b"]): r["d"] for r in D.listed(df, D.lb_matrix(2), **kw).collect()}
    assert of() == bound
    assert of(mirror=True) == bound | {(b, a): d for (a, b), d in bound.items()} | {(a, a): 0.0 for a in range(11)}
    assert of(core="core") == {(a, b): max(d, b / 2) for (a, b), d in bound.items()}
    assert sorted(map(tuple, D.pairs(df).collect())) == sorted(bound)
    assert not D.listed(df.where("series_id = 3"), D.lb_matrix(2), mirror=True).collect()


def written_bytes(path, a, b, d, **kw):
    """Rows of a strip as sorted tuples, and the bytes that each column takes as it is written."""
    rows = pa.Table.from_batches(list(D._batches(a, b, d, **kw)))
    pq.write_table(rows, path, compression="snappy", version="1.0", data_page_size=70_000)
    group = pq.ParquetFile(path).metadata.row_group(0)
    return sorted(zip(*rows.to_pydict().values())), [group.column(c).total_compressed_size for c in range(3)]


@pytest.mark.parametrize("upper", [False, True])
def test_mirrored_distance_is_written_as_a_copy(tmp_path, upper):
    a, b = np.arange(5000, 5064), np.arange(5000 if upper else 20_000, 25_001)
    d = np.round(np.abs(np.random.default_rng(3).normal(4.3, 1.3, (len(a), len(b)))), 4)
    one, (_, _, once) = written_bytes(tmp_path / "one", a, b, d, upper=upper, digits=4)
    two, (ids, other_ids, twice) = written_bytes(tmp_path / "two", a, b, d, upper=upper, digits=4, mirror=True)
    assert one == sorted((i, j, v) for i, row in zip(a.tolist(), d.tolist()) for j, v in zip(b.tolist(), row) if i < j)
    assert two == sorted(one + [(j, i, v) for i, j, v in one])
    assert twice < 1.3 * once and ids + other_ids < 0.3 * len(two)


@pytest.mark.parametrize(
    "matrix",
    [
        pytest.param(D.dtw_squared_matrix(5), id="dtw_sq_pairs"),
        pytest.param(D.rooted(D.dtw_squared_matrix(5)), id="dtw_pairs"),
        pytest.param(D.spatio_temporal_matrix(5), id="spatiotemporal_dist"),
    ],
)
def test_ids_of_warped_pairs_take_hardly_any_bytes(tmp_path, matrix):
    """A strip of 64 curves against a block of the warping queries: what is written is the distances."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(D.STRIP, 12)).cumsum(1), rng.normal(size=(D.BLOCK_ROWS, 12)).cumsum(1)
    a, b, d = np.arange(len(x)), np.arange(100, 100 + len(y)), matrix(y)(x)
    rows, (ids, other_ids, _) = written_bytes(tmp_path / "rows", a, b, d, upper=False, digits=6)
    assert rows == sorted((i, j, v) for i, row in zip(a.tolist(), D.rounded(d.ravel(), 6).reshape(d.shape).tolist()) for j, v in zip(b.tolist(), row))
    assert ids + other_ids < 0.25 * len(rows)


def test_rounded_equals_the_engine(spark):
    rng = np.random.default_rng(6)
    d = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-7, 9, 3000), rng.integers(-99_999, 99_999, 3000) / 1e5, [0.0, 1e300, 4503599627370496.5, 0.00005, 2.67495, 1.00005]])
    got = spark.createDataFrame([(float(v),) for v in d], "d double").select(F.round("d", 4)).collect()
    assert np.array_equal(D.rounded(d, 4), [r[0] for r in got])
    assert np.isnan(D.rounded(np.array([np.nan, np.inf]), 4)).tolist() == [True, False]


@pytest.mark.parametrize("n", [3, 4, 7, 31])
def test_warping_by_diagonals_equals_one_by_one(n):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(size=(6, n)).cumsum(1), 1), np.round(rng.normal(size=(9, n)).cumsum(1), 1)
    x[3, n // 2] = y[5, 1] = np.nan
    each = lambda f: [[f(a, b) for b in y] for a in x]
    for w in (None, 1, 2, 5):
        assert np.allclose(D.dtw_squared_matrix(w, 4)(y)(x), each(lambda a, b: D.dtw_squared(a, b, w)), equal_nan=True)
    assert np.allclose(D.spatio_temporal_matrix(5)(y)(x), each(lambda a, b: D.spatio_temporal(a, b, 5)), equal_nan=True)


def test_gaps_exceed_nothing_either_way():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(7, 10)), rng.normal(size=(5, 10))
    x[2, 3], y[1, 4], y[2] = np.nan, np.nan, np.nan
    d = D.lb_matrix(2)(y)(x)
    assert np.array_equal(d, np.concatenate([D.lb_matrix(2)(y)(x[k : k + 1]) for k in range(7)])) and np.isfinite(d).all() and not d[:, 2].any()


def test_credits_trim_compat(spark):
    marks = spark.createDataFrame([(0, 0), (1, 2)], "series_id bigint, credits_at int")
    df = frame(spark, [1, 2, 3], [1, 2, 3], [1, 2, 3])
    sizes = lambda compat: {r["series_id"]: len(r["y"]) for r in S.credits_trim(df, marks, compat).collect()}
    assert sizes(False) == {0: 0, 1: 2, 2: 3} and sizes(True) == {0: 3, 1: 2, 2: 3}


@pytest.mark.parametrize("n", [1, 3, 4, 7, 31, 60])
def test_warping_of_many_equals_one_by_one(n):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(size=(40, n)).cumsum(1), 1), np.round(rng.normal(size=(40, n)).cumsum(1), 1)
    x[3, n // 2] = np.nan
    each = lambda f: [f(a, b) for a, b in zip(x, y)]
    for w in (None, 1, 5):
        assert np.allclose(D.dtw_squared_many(x, y, w), each(lambda a, b: D.dtw_squared(a, b, w)), equal_nan=True)
        assert np.allclose(D.spatio_temporal_many(x, y, w), each(lambda a, b: D.spatio_temporal(a, b, w)), equal_nan=True)
    assert np.array_equal(D.fast_dtw_many(x, y, chunk=7), each(D.fast_dtw), equal_nan=True)


@pytest.mark.parametrize(
    "name,measure",
    [
        ("dtw_pairs", lambda x, y: brute_dtw(x, y, 5)),
        ("dtw_sq_pairs", lambda x, y: brute_dtw(x, y, 5) ** 2),
        ("fastdtw_pairs", D.fast_dtw),
        ("spatiotemporal_dist", lambda x, y: math.sqrt(np.linalg.norm(x[:2] - y[:2]) + brute_dtw(x[2:], y[2:], 5) ** 2)),
    ],
)
def test_warping_queries_measure_every_pair(spark, sf, name, measure):
    from tidecurve.plans import curves, registry

    own = {r["series_id"]: np.array(r["y"], float) for r in curves.prepared(spark, sf).collect()}
    got = {(r["a"], r["b"]): r["d"] for r in registry.queries()[name](spark, sf).collect()}
    assert got.keys() == {(a, b) for a in own for b in own if a < b} and len(got) > len(own)
    for (a, b), d in got.items():
        assert d == pytest.approx(measure(own[a], own[b]), abs=2e-6)


def brute_kmeans(own, centres):
    measure, curves = C.envelope_bound(5), np.array([own[k] for k in sorted(own)])
    for _ in range(20):
        near = np.stack([measure(curves, c) for c in centres], 1).argmin(1)
        centres = [curves[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)]
    return centres, np.stack([measure(curves, c) for c in centres], 1).min(1).mean()


def test_elbow_and_completion_use_trained_centres(spark, sf):
    from tidecurve.plans import curves, registry

    arrays, run = curves.prepared(spark, sf), lambda name: registry.queries()[name](spark, sf).collect()
    own = {r["series_id"]: np.array(r["y"], float) for r in arrays.collect()}
    errors = {r["k"]: r["error"] for r in run("elbow_kmeans")}
    assert sorted(errors) == [2, 3, 4, 5, 6]
    for k, error in errors.items():
        assert error == pytest.approx(brute_kmeans(own, C.seeds(arrays, k, 0))[1], abs=1e-4)

    centres, _ = brute_kmeans(own, C.seeds(arrays, 4, 0))
    heads = np.array([own[k][:5] for k in sorted(own)])
    near = np.stack([C.envelope_bound(5)(heads, c[:5]) for c in centres], 1).argmin(1)
    got = {(r["series_id"], r["i"]): (r["cluster"], r["value"]) for r in run("centroid_completion")}
    assert len(got) == 55 * len(own)
    for (series, i), (cluster, value) in got.items():
        assert cluster == near[sorted(own).index(series)] and value == pytest.approx(centres[cluster][i], abs=2e-6)

    ids = sorted(own)
    bound = np.array([C.envelope_bound(5)(np.array([own[a]] * len(ids)), own[b]) for a in ids for b in ids])[:, 0].reshape(len(ids), -1)
    d = np.triu(bound, 1) + np.triu(bound, 1).T
    for r in run("elbow_kmedoids"):
        drawn = [row["a"] for row in spark.createDataFrame([(i,) for i in ids], "a bigint").orderBy(F.xxhash64(F.lit(0), "a"), "a").limit(r["k"]).collect()]
        medoids = sorted(ids.index(x) for x in drawn)
        while True:
            member = np.array(medoids)[d[:, medoids].argmin(1)]
            new = sorted(min(np.flatnonzero(member == m), key=lambda x: (d[x, member == m].mean(), x)) for m in medoids)
            if new == medoids:
                break
            medoids = new
        assert r["error"] == pytest.approx(d[:, medoids].min(1).mean(), abs=1e-4)


def hot(spark, path, points):
    """Events of user 1, with ``points`` of them, and of user 2, with 30."""
    rows = spark.range(points + 30).selectExpr("id as event_id", f"if(id < {points}, 1L, 2L) as user_id", "timestamp_seconds(id) as ts", "sin(id / 50) as value", "'view' as event_type")
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["smooth_hann", "smooth_flat", "infer_window", "serve_shape", "prepare_ts"])
def test_long_curves_stay(spark, tmp_path, name):
    from tidecurve.plans import registry

    d = hot(spark, tmp_path, 10_500)
    got = {r["series_id"]: r["count"] for r in registry.queries()[name](spark, d).groupBy("series_id").count().collect()}
    assert got == {"infer_window": {1: 9, 2: 9}, "serve_shape": {1: 1, 2: 1}, "prepare_ts": {1: 60, 2: 60}}.get(name, {1: 10_500, 2: 30})
