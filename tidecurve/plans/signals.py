"""Queries over curves: smoothing, peaks, resampling, distances, clusters, serving."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidecurve.operators import cluster as C, distances as D, peaks as P, series as S
from tidecurve.plans.base import query
from tidecurve.plans.curves import LONG_ENOUGH, POINTS, PREPARED, RADIUS, SIGNAL, WINDOW, arrays, lb_sql, prepared, resample_sql, signal, smooth_sql, znorm_sql
from tidecurve.shared import cut
from tidecurve.sources.tables import table

BINNED = f"(select series_id, i, floor(value / 25) as value from {SIGNAL} q)"


def _long(a: DataFrame) -> DataFrame:
    return S.to_long(a).select("series_id", "i", F.round("value", 6).alias("value"))


def _rounded(sql: str) -> str:
    return f"select series_id, i::int as i, round(value, 6) as value from {sql} z"


def _enough(spark: SparkSession, d: str, window: int = WINDOW) -> DataFrame:
    return arrays(spark, d).where(F.size("y") > window)


@query("scan_signal", f"select series_id, i, value, event_type from {SIGNAL} q")
def scan_signal(spark, d):
    return signal(spark, d)


def _register_smooth(kind: str, w: int) -> None:
    name = "smooth_hann" if kind == "hanning" else f"smooth_{kind}"
    query(name, _rounded(smooth_sql(LONG_ENOUGH, w, kind)))(lambda spark, d: _long(S.smooth(_enough(spark, d), w, kind)))


for _kind, _w in (("flat", 8), ("hanning", 9), ("hamming", 8), ("bartlett", 7), ("blackman", 9)):
    _register_smooth(_kind, _w)

_NEIGHBOURS = "lag(value) over w as p, lead(value) over w as n"


def _register_peaks(name: str, edge: str | None, when: str, binned: bool = False, sign: str = "", **more) -> None:
    source = BINNED if binned else SIGNAL
    sql = f"""select series_id, i, {sign}value as value from (select series_id, i, value, {_NEIGHBOURS}
        from (select series_id, i, {sign}value as value from {source} q) window w as (partition by series_id order by i))
        where p is not null and n is not null and {when}"""

    def run(spark, d):
        long = signal(spark, d).select("series_id", "i", "value")
        if binned:
            long = long.withColumn("value", F.floor(F.col("value") / 25).cast("double"))
        return P.peaks(long, edge, **more)

    query(name, sql)(run)


_register_peaks("peaks_strict", None, "value > p and value > n")
_register_peaks("peaks_rising", "rising", "value > p and value >= n", binned=True)
_register_peaks("peaks_falling", "falling", "value >= p and value > n", binned=True)
_register_peaks("peaks_both", "both", "(value > p and value >= n or value >= p and value > n)", binned=True)
_register_peaks("valleys", None, "value > p and value > n", sign="-", valley=True)
_register_peaks("peaks_mph", None, "value > p and value > n and value >= 100", mph=100.0)
_register_peaks("peaks_threshold", None, "value > p and value > n and least(value - p, value - n) >= 30", threshold=30.0)


@query("peaks_mpd")
def peaks_mpd(spark, d):
    return P.distant_peaks(P.peaks(signal(spark, d).select("series_id", "i", "value"), None), 5)


@query("resample_linear", _rounded(resample_sql(SIGNAL, POINTS)))
def resample_linear(spark, d):
    return _long(S.resample(arrays(spark, d), POINTS))


@query("znorm", _rounded(znorm_sql(SIGNAL)))
def znorm(spark, d):
    return _long(S.znorm(arrays(spark, d)))


@query("series_mean_std", f"select series_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as n from {SIGNAL} q group by 1")
def series_mean_std(spark, d):
    return signal(spark, d).groupBy("series_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("value").alias("n"))


_MEANS = f"(select series_id, avg(value) as m, stddev_pop(value) as s from {SIGNAL} q group by 1)"


@query("mean_of_means", f"select round(avg(m), 6) as mean, round(avg(s), 6) as std from {_MEANS} q")
def mean_of_means(spark, d):
    per = S.mean_std(arrays(spark, d))
    return per.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("std"), 6).alias("std"))


@query("un_znorm", f"select z.series_id, z.i::int as i, round(z.value * g.s + g.m, 6) as value from {znorm_sql(SIGNAL)} z, (select avg(m) as m, avg(s) as s from {_MEANS} q) g")
def un_znorm(spark, d):
    z = S.znorm(arrays(spark, d))
    m, s = z.agg(F.avg("mean"), F.avg("std")).collect()[0]  # one row
    return _long(z.withColumn("y", F.transform("y", lambda v: v * F.lit(s) + F.lit(m))))


@query("range_norm", f"select series_id, i, round((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 6) as value from {SIGNAL} q window w as (partition by series_id)")
def range_norm(spark, d):
    w = Window.partitionBy("series_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return signal(spark, d).select("series_id", "i", F.round((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)), 6).alias("value"))


@query("adaptive_window", f"select series_id, n, floor(n * 0.07::double)::int as w_default, floor(n * 0.14::double)::int as w_share, 12 as w_fixed from (select series_id, count(*) as n from {SIGNAL} q group by 1)")
def adaptive_window(spark, d):
    return arrays(spark, d).select("series_id", F.size("y").cast("bigint").alias("n"), S.window_length(None).alias("w_default"), S.window_length(0.14).alias("w_share"), S.window_length(12).alias("w_fixed"))


@query("infer_window")
def infer_window(spark, d):
    """Squared change of the smoothed curve from one window to the next, W = 3 to 12."""
    base = cut(_enough(spark, d, 12), "window-curves")
    smoothed = [S.smooth(base, w).select("series_id", F.lit(w).alias("w"), "y") for w in range(3, 13)]
    out = smoothed[0]
    for s in smoothed[1:]:
        out = out.unionByName(s)
    before = F.lag("y").over(Window.partitionBy("series_id").orderBy("w"))
    change = F.aggregate(F.zip_with("y", "_before", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("_before", before).where("_before is not null").select("series_id", "w", F.round(change, 6).alias("change"))


_CLIPS = f"""(select series_id, c, s.i, s.value from (select *, floor((n - 20) / 10)::bigint + 1 as clips from
    (select *, count(*) over (partition by series_id) as n from {SIGNAL} q)) s, range(1000) t(c)
    where c < clips and s.i >= c * 10 and s.i < c * 10 + 20)"""


def _clips(spark, d):
    long = signal(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series_id")))
    last = F.floor((F.col("n") - 20) / 10)
    own = F.filter(F.sequence(F.greatest(F.floor((F.col("i") - 19) / 10), F.lit(0)), F.floor(F.col("i") / 10)), lambda c: (c * 10 <= F.col("i")) & (F.col("i") < c * 10 + 20) & (c <= last))
    return long.where("n >= 20").select("series_id", "i", "value", F.explode(own).alias("c"))


@query("sliding_count", f"select series_id, c, count(*) as n, round(avg(value), 6) as mean from {_CLIPS} q group by 1, 2")
def sliding_count(spark, d):
    return _clips(spark, d).groupBy("series_id", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("overlap_add", f"""with p as (select series_id, c, avg(value) as v from {_CLIPS} q group by 1, 2)
    select series_id, c * 10 + k as second, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, count(*) as n from p, range(20) t(k) group by 1, 2""")
def overlap_add(spark, d):
    clip = _clips(spark, d).groupBy("series_id", "c").agg(F.avg("value").alias("v"))
    spread = clip.select("series_id", "v", F.explode(F.sequence(F.col("c") * 10, F.col("c") * 10 + 19)).alias("second"))
    return spread.groupBy("series_id", "second").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.count("v").alias("n"))


@query("credits_trim", f"""select s.series_id, i, value from {SIGNAL} s left join (select user_id as series_id, count(*) filter (event_type = 'error') as mark from events group by 1) m
    on s.series_id = m.series_id where mark is null or i < 4 * mark""")
def credits_trim(spark, d):
    marks = table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg((4 * F.count_if(F.col("event_type") == "error")).cast("int").alias("credits_at"))
    return S.to_long(S.credits_trim(arrays(spark, d), marks)).select("series_id", F.col("i").cast("bigint").alias("i"), "value")


@query("filter_min_len", f"select series_id, count(*) as n from {SIGNAL} q group by 1 having count(*) > 60")
def filter_min_len(spark, d):
    return signal(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")


@query("filter_max_len", f"select series_id, count(*) as n from {SIGNAL} q group by 1 having count(*) <= 60")
def filter_max_len(spark, d):
    return signal(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 60")


@query("trim_ends", f"select series_id, i, value from (select *, count(*) over (partition by series_id) as n from {SIGNAL} q) where i >= 5 and i < n - 10")
def trim_ends(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return signal(spark, d).withColumn("n", n).where("i >= 5 and i < n - 10").select("series_id", "i", "value")


@query("downsample", f"select series_id, i // 4 as i, value from {SIGNAL} q where i % 4 = 0")
def downsample(spark, d):
    return signal(spark, d).where("i % 4 = 0").select("series_id", F.expr("i div 4").alias("i"), "value")


@query("positional_join", f"select a.series_id as a, b.series_id as b, a.i, a.value as value_a, b.value as value_b from {SIGNAL} a join {SIGNAL} b on b.series_id = a.series_id + 1 and a.i = b.i")
def positional_join(spark, d):
    a = signal(spark, d).select(F.col("series_id").alias("a"), "i", F.col("value").alias("value_a"))
    b = signal(spark, d).select(F.col("series_id").alias("b"), (F.col("series_id") - 1).alias("a"), "i", F.col("value").alias("value_b"))
    return a.join(b, ["a", "i"]).select("a", "b", "i", "value_a", "value_b")


_MODAL = "(select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events where event_type in ({}))"
_VISUAL, _AUDIO = _MODAL.format("'view','click'"), _MODAL.format("'purchase','signup'")


def _modality(spark, d, *kinds):
    own = table(spark, d, "events").where(F.col("event_type").isin(*kinds)).withColumn("i", S.position("user_id", "ts", "event_id"))
    return own.select(F.col("user_id").alias("series_id"), "i", "value")


@query("modality_align", f"select coalesce(v.series_id, a.series_id) as series_id, coalesce(v.i, a.i) as i, v.value as visual, a.value as audio from {_VISUAL} v full join {_AUDIO} a on v.series_id = a.series_id and v.i = a.i")
def modality_align(spark, d):
    v = _modality(spark, d, "view", "click").withColumnRenamed("value", "visual")
    a = _modality(spark, d, "purchase", "signup").withColumnRenamed("value", "audio")
    return v.join(a, ["series_id", "i"], "full_outer")


@query("confidence_band", """select event_id, greatest(m - h, 0) as lower, least(m + h, 1) as upper from
    (select *, least(s, m, 1 - m) as h from (select event_id, least(value / 100, 1) as m, (event_id % 7) / 10.0::double as s from events))""")
def confidence_band(spark, d):
    own = table(spark, d, "events").select("event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("m"), ((F.col("event_id") % 7) / 10).alias("s"))
    lower, upper = P.confidence_band(F.col("m"), F.col("s"))
    return own.select("event_id", lower.alias("lower"), upper.alias("upper"))


_HITS = f"(select series_id, i, case when event_type = 'error' then 2 when event_type = 'view' then 1 else 0 end as hits from {SIGNAL} q)"


@query("reverse_run_boundary", f"""with h as (select *, count(*) over (partition by series_id) as n from {_HITS} q),
    f as (select *, sum((hits > 0)::int) over (partition by series_id order by i desc) as run from h where i >= n // 2),
    m as (select *, sum((hits = 0)::int) over (partition by series_id, run order by i desc) as missed from f),
    o as (select *, max((missed >= 5)::int) over (partition by series_id order by i desc) as over_ from m)
    select series_id, min(case when over_ = 0 and hits > 1 then i end) as boundary from o group by 1""")
def reverse_run_boundary(spark, d):
    hits = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return P.reverse_boundary(signal(spark, d).withColumn("hits", hits))


@query("sample_grid", """select l_linenumber as fps, k, round(k * l_linenumber * 2.5)::bigint as frame from (select distinct l_linenumber from lineitem), range(1, 21) t(k)""")
def sample_grid(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("fps")).distinct()
    return own.select("fps", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("k")).select("fps", "k", F.round(F.col("k") * F.col("fps") * F.lit(2.5)).cast("bigint").alias("frame"))


@query("prepare_ts", f"select series_id, i::int as i, round(value, 5) as value from {PREPARED} z")
def prepare_ts(spark, d):
    return S.to_long(prepared(spark, d)).select("series_id", "i", F.round("value", 5).alias("value"))


# --- pairs and clusters --------------------------------------------------------------------------------------------
@query("pair_self_join", f"select a.series_id as a, b.series_id as b from (select distinct series_id from {SIGNAL} q) a join (select distinct series_id from {SIGNAL} q) b on a.series_id < b.series_id")
def pair_self_join(spark, d):
    return D.pairs(signal(spark, d).select("series_id").distinct())


_EDGES = lb_sql(PREPARED)


def edges(spark, d, **kept) -> DataFrame:
    return D.distance_matrix(prepared(spark, d), RADIUS, **kept)


@query("lb_keogh", f"select a, b, round(d, 4) as d from {lb_sql(PREPARED, 'e.series_id = x.series_id + 1')} z")
def lb_keogh(spark, d):
    """The bound of each curve with the next id, as its SQL has it; ``distance_matrix`` is the bound of all pairs."""
    lower, upper = D.envelope("y", RADIUS)
    own = cut(prepared(spark, d).select("series_id", "y", lower.alias("lo"), upper.alias("up")), "lb")
    other = own.select((F.col("series_id") - 1).alias("a"), F.col("series_id").alias("b"), "lo", "up")
    return own.select(F.col("series_id").alias("a"), "y").join(other, "a").select("a", "b", F.round(D.lb_keogh("y", "lo", "up"), 4).alias("d"))


@query("distance_matrix", f"select a, b, round(d, 4) as d from {_EDGES} z")
def distance_matrix(spark, d):
    return D.listed(prepared(spark, d), D.lb_matrix(RADIUS), 4)


@query("matrix_mirror", f"with e as (select * from {_EDGES} z) select a, b, round(d, 4) as d from e union all select b, a, round(d, 4) from e union all select distinct a, a, 0.0 from (select a from e union select b from e)")
def matrix_mirror(spark, d):
    return D.listed(prepared(spark, d), D.lb_matrix(RADIUS), 4, mirror=True)


def _warped(spark, d, measure: D.Distance, matrix: D.Matrix) -> DataFrame:
    """Every pair of curves once by a measure of the warping family."""
    return D.pairwise(prepared(spark, d), measure, matrix, 6)


@query("dtw_pairs")
def dtw_pairs(spark, d):
    return _warped(spark, d, lambda x, y: D.dtw(x, y, RADIUS), D.rooted(D.dtw_squared_matrix(RADIUS)))


@query("dtw_sq_pairs")
def dtw_sq_pairs(spark, d):
    return _warped(spark, d, lambda x, y: D.dtw_squared(x, y, RADIUS), D.dtw_squared_matrix(RADIUS))


@query("fastdtw_pairs")
def fastdtw_pairs(spark, d):
    return _warped(spark, d, D.fast_dtw, D.row_by_row(D.fast_dtw_many))


@query("spatiotemporal_dist")
def spatiotemporal_dist(spark, d):
    return _warped(spark, d, lambda x, y: D.spatio_temporal(x, y, RADIUS), D.spatio_temporal_matrix(RADIUS))


@query("corr_distance", f"""with z as (select * from {PREPARED} q) select x.series_id as a, y.series_id as b, round(1 - corr(x.value, y.value), 4) as d
    from z x join z y on x.i = y.i and x.series_id < y.series_id group by 1, 2""")
def corr_distance(spark, d):
    return D.correlation_distance(prepared(spark, d), 4)


@query("kmeans_lb")
def kmeans_lb(spark, d):
    return C.kmeans(prepared(spark, d), 5, 20, C.envelope_bound(RADIUS)).select("series_id", "cluster", F.round("dist", 6).alias("dist"))


@query("kmeans_spatio")
def kmeans_spatio(spark, d):
    return C.kmeans(prepared(spark, d), 3, 5, C.spatial_bound(RADIUS)).select("series_id", "cluster", F.round("dist", 6).alias("dist"))


_FIRST = f"(select series_id, row_number() over (order by series_id) - 1 as cluster from (select distinct series_id from {PREPARED} q) order by series_id limit 4)"
_STEP = f"""near as (select a as series_id, cluster, d from (select a, c.cluster, d, row_number() over (partition by a order by d, c.cluster) as r
    from {lb_sql(PREPARED, f'e.series_id in (select series_id from {_FIRST} f)')} l join {_FIRST} c on c.series_id = l.b) where r = 1)"""


def _first_step(spark, d) -> DataFrame:
    own = cut(prepared(spark, d).select("series_id", "y"), "step")
    first = [np.asarray(r["y"], float) for r in own.orderBy("series_id").limit(4).collect()]
    return C.assign(own, first, C.envelope_bound(RADIUS))


@query("nearest_centroid", f"with {_STEP} select series_id, cluster::int as cluster, round(d, 4) as dist from near")
def nearest_centroid(spark, d):
    return _first_step(spark, d).select("series_id", "cluster", F.round("dist", 4).alias("dist"))


_MEAN_CURVE = f"with {_STEP} select n.cluster::int as cluster, p.i::int as i, round(avg(p.value), 4) as value from near n join {PREPARED} p on n.series_id = p.series_id group by 1, 2"


@query("kmeans_step", _MEAN_CURVE)
def kmeans_step(spark, d):
    return C.centroids(_first_step(spark, d)).withColumn("value", F.round("value", 4))


@query("centroid_mean", f"select (series_id % 4)::int as cluster, i::int as i, round(avg(value), 4) as value from {PREPARED} q group by 1, 2")
def centroid_mean(spark, d):
    own = prepared(spark, d).select((F.col("series_id") % 4).cast("int").alias("cluster"), "y")
    return C.centroids(own).withColumn("value", F.round("value", 4))


@query("centroid_completion")
def centroid_completion(spark, d):
    """Nearest k-means cluster by the first five points; its centroid's points from the sixth on complete the curve."""
    own = cut(prepared(spark, d).select("series_id", "y"), "complete")
    centres = C.trained(own, 4, 20, C.envelope_bound(RADIUS))
    head = own.withColumn("y", F.slice("y", 1, 5))
    near = C.assign(head, [c[:5] for c in centres], C.envelope_bound(RADIUS)).select("series_id", "cluster")
    tails = spark.createDataFrame([(k, [float(v) for v in c[5:]]) for k, c in enumerate(centres)], "cluster int, tail array<double>")
    return near.join(F.broadcast(tails), "cluster").select("series_id", "cluster", F.posexplode("tail").alias("i", "value")).select("series_id", "cluster", (F.col("i") + 5).alias("i"), F.round("value", 6).alias("value"))


@query("kmedoids")
def kmedoids(spark, d):
    return C.kmedoids_of(prepared(spark, d), [4], D.lb_matrix(RADIUS)).select(F.col("series_id").alias("a"), F.col("medoid_4").alias("cluster"), F.round("d_4", 6).alias("d"))


_MEDOIDS = f"(select distinct series_id from {PREPARED} q order by 1 limit 4)"
_FULL = f"full_ as materialized (with e as materialized (select * from {_EDGES} z) select a, b, d from e union all select b, a, d from e union all select distinct a, a, 0.0 from (select a from e union select b from e))"
_MASSIGN = f"{_FULL}, near as (select a, b as cluster, d from (select *, row_number() over (partition by a order by d, b) as r from full_ where b in {_MEDOIDS}) where r = 1)"


def _medoids(spark, d):
    """The curves in blocks, and each with the nearest of the four smallest ids as medoids."""
    blocks = _related(spark, d)
    return blocks, C.nearest_medoids(blocks, {4: _smallest(blocks, 4)}, D.lb_matrix(RADIUS))


def _related(spark, d) -> DataFrame:
    """The curves in blocks; a single one is in no pair and none of the matrix's."""
    blocks = D.ranged(prepared(spark, d), rows=D.WIDE_ROWS)
    return blocks if blocks.count() > 1 else blocks.limit(0)


def _smallest(blocks: DataFrame, k: int) -> dict[int, tuple]:
    return {s: (r["series_id"], r["y"]) for s, r in enumerate(blocks.orderBy("series_id").limit(k).collect())}


@query("kmedoids_assign", f"with {_MASSIGN} select a, cluster, round(d, 4) as d from near")
def kmedoids_assign(spark, d):
    return _medoids(spark, d)[1].select(F.col("series_id").alias("a"), F.col("medoid_4").alias("cluster"), F.round("d_4", 4).alias("d"))


@query("medoid_update", f"""with {_MASSIGN}, m as (select x.cluster, f.a, avg(f.d) as mean from full_ f join near x on x.a = f.a join near y on y.a = f.b and y.cluster = x.cluster group by 1, 2)
    select cluster, a as medoid from (select *, row_number() over (partition by cluster order by mean, a) as r from m) where r = 1""")
def medoid_update(spark, d):
    return C.updated_medoids(*_medoids(spark, d), 4, D.lb_matrix(RADIUS)).select("cluster", "medoid")


@query("elbow_error", f"""with {_FULL}, ids as (select series_id, row_number() over (order by series_id) as r from (select distinct series_id from {PREPARED} q)),
    ks as (select k::int as k from range(2, 7) t(k)), near as (select k, f.a, min(f.d) as d from ks join ids on r <= k join full_ f on f.b = ids.series_id group by 1, 2)
    select k, round(sum(d) / count(*), 4) as error from near group by 1""")
def elbow_error(spark, d):
    """The step as its SQL has it: the smallest ids stand for centres.  ``elbow_kmeans`` and ``elbow_kmedoids`` train them."""
    blocks = _related(spark, d)
    smallest = _smallest(blocks, 6)
    near = C.nearest_medoids(blocks, {k: {i: smallest[i] for i in range(min(k, len(smallest)))} for k in range(2, 7)}, D.lb_matrix(RADIUS))
    return _errors(near).groupBy("k").agg(F.round(F.sum("d") / F.count(F.lit(1)), 4).alias("error"))


def _errors(near: DataFrame) -> DataFrame:
    return near.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d_{k}").alias("d")) for k in range(2, 7)])))


def _elbow(clustered) -> DataFrame:
    """Mean distance to the own centre of ``clustered(k)`` with its distance ``d``, for k = 2 to 6."""
    out = None
    for k in range(2, 7):
        own = clustered(k).agg(F.lit(k).alias("k"), F.round(F.sum("d") / F.count(F.lit(1)), 4).alias("error"))
        out = own if out is None else out.unionByName(own)
    return out


@query("elbow_kmeans")
def elbow_kmeans(spark, d):
    own = cut(prepared(spark, d).select("series_id", "y"), "elbow-curves")
    measure = C.envelope_bound(RADIUS)
    return _elbow(lambda k: C.assign(own, C.trained(own, k, 20, measure), measure).select(F.col("dist").alias("d")))


@query("elbow_kmedoids")
def elbow_kmedoids(spark, d):
    near = C.kmedoids_of(prepared(spark, d), list(range(2, 7)), D.lb_matrix(RADIUS))
    return _errors(near).groupBy("k").agg(F.round(F.sum("d") / F.count(F.lit(1)), 4).alias("error"))


@query("medoid_mean_curve")
def medoid_mean_curve(spark, d):
    """Mean curve of each trained k-medoids cluster, named by its medoid."""
    own = cut(prepared(spark, d).select("series_id", "y"), "medoid-curves")
    clusters = C.kmedoids_of(own, [4], D.lb_matrix(RADIUS)).select("series_id", F.col("medoid_4").alias("cluster"))
    return C.centroids(own.join(clusters, "series_id")).withColumn("value", F.round("value", 4))


@query("centre_dists")
def centre_dists(spark, d):
    """Distance of each curve to the trained centre of its k-means cluster."""
    return C.kmeans(prepared(spark, d), 4, 20, C.envelope_bound(RADIUS)).select("cluster", "series_id", F.round("dist", 4).alias("d"))


@query("cluster_methods")
def cluster_methods(spark, d):
    """Cluster sizes by every method for every k of a list; hdbscan finds its own number, 0 here."""
    own = cut(prepared(spark, d).select("series_id", "y"), "methods-curves")
    return C.sizes_by_method(own, "kmeans,kmedoids,hierarchical,hdbscan", "2,3", RADIUS)


_GROUPS = f"(select series_id, case when series_id % 3 = 0 then 'even' when series_id % 3 = 1 then 'odd' else 'rest' end as grp from (select distinct series_id from {PREPARED} q))"


@query("group_coherence", f"""select x.grp, round(avg(e.d), 4) as coherence, count(*) as pairs from {_EDGES} e join {_GROUPS} x on x.series_id = e.a join {_GROUPS} y on y.series_id = e.b and y.grp = x.grp
    group by 1 having count(distinct e.a) + 1 > 5""")
def group_coherence(spark, d):
    name = F.when(F.col("series_id") % 3 == 0, "even").when(F.col("series_id") % 3 == 1, "odd").otherwise("rest")
    done = None
    own = cut(prepared(spark, d).select("series_id", "y", name.alias("grp")), "coherence")
    for grp in ("even", "odd", "rest"):  # only pairs within a group are measured
        found = D.distance_matrix(own.where(F.col("grp") == grp), RADIUS)
        stats = found.agg(F.lit(grp).alias("grp"), F.round(F.avg("d"), 4).alias("coherence"), F.count(F.lit(1)).alias("pairs"), F.countDistinct("a").alias("members"))
        done = stats if done is None else done.unionByName(stats)
    return done.where(F.col("members") + 1 > 5).drop("members")


@query("ts_dists", f"select b as cluster, a as series_id, round(d, 4) as d from {lb_sql(PREPARED, f'e.series_id in {_MEDOIDS} and x.series_id % 4 = e.series_id % 4')} z")
def ts_dists(spark, d):
    lower, upper = D.envelope("y", RADIUS)
    own = cut(prepared(spark, d).select("series_id", "y", lower.alias("lo"), upper.alias("up")), "dists")
    ids = [r[0] for r in own.select("series_id").orderBy("series_id").limit(4).collect()]
    centres = own.where(F.col("series_id").isin(ids)).select(F.col("series_id").alias("cluster"), "lo", "up", (F.col("series_id") % 4).alias("k"))
    return own.select("series_id", "y", (F.col("series_id") % 4).alias("k")).join(F.broadcast(centres), "k").select("cluster", "series_id", F.round(D.lb_keogh("y", "lo", "up"), 4).alias("d"))


@query("closest_topk", f"select a, b, round(d, 4) as d, rank::int as rank from (select *, row_number() over (partition by a order by d, b) as rank from {_EDGES} z) where rank <= 10")
def closest_topk(spark, d):
    nth = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return edges(spark, d, nearest=10).withColumn("rank", nth).where("rank <= 10").withColumn("d", F.round("d", 4))


@query("single_linkage")
def single_linkage(spark, d):
    return C.single_linkage(D.tree_edges(D.unit(prepared(spark, d)), D.correlation_matrix)).withColumn("height", F.round("height", 6))


@query("core_distance", f"with {_FULL} select a, round(d, 4) as core from (select *, row_number() over (partition by a order by d, b) as r from full_) where r = 5")
def core_distance(spark, d):
    return _core(edges(spark, d, nearest=4, both_ways=True), 5).withColumn("core", F.round("core", 4))


def _core(nearest: DataFrame, min_samples: int) -> DataFrame:
    """Core distances from each curve's nearest others; the curve itself is the first neighbour."""
    return C.core_distance(nearest, min_samples - 1)


@query("mutual_reachability", f"""with {_FULL}, c as (select a, d as core from (select *, row_number() over (partition by a order by d, b) as r from full_) where r = 5)
    select f.a, f.b, round(greatest(f.d, x.core, y.core), 4) as d from full_ f join c x on x.a = f.a join c y on y.a = f.b where f.a < f.b""")
def mutual_reachability(spark, d):
    own = cut(prepared(spark, d).select("series_id", "y"), "reach")
    core = cut(_core(D.distance_matrix(own, RADIUS, nearest=4, both_ways=True), 5), "reach-core")
    return D.listed(own.join(core.withColumnRenamed("a", "series_id"), "series_id"), D.lb_matrix(RADIUS), 4, core="core")


@query("hdbscan")
def hdbscan(spark, d):
    return C.hdbscan_of(cut(prepared(spark, d), "hdbscan"), RADIUS, 4, 3)


@query("merge_extrema")
def merge_extrema(spark, d):
    return P.merged(_extrema(spark, d, 10), 5)


_MODALITIES = (("visual", ("view", "click")), ("audio", ("purchase", "signup")))


def _extrema(spark, d, distance: int) -> DataFrame:
    return _marked({m: cut(_modality(spark, d, *kinds), f"extrema-{m}") for m, kinds in _MODALITIES}, distance)


def _marked(curves: dict[str, DataFrame], distance: int, mph: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Peaks and valleys of every modality's written curves, ``(series_id, i, modality, kind)``."""
    out = None
    for modality, long in curves.items():
        for kind, valley, least in (("peak", False, mph[0]), ("valley", True, mph[1])):
            found = P.distant_peaks(P.peaks(long, None, mph=least, valley=valley), distance, valley=valley)
            own = found.select("series_id", "i", F.lit(modality).alias("modality"), F.lit(kind).alias("kind"))
            out = own if out is None else out.unionByName(own)
    return out


@query("highlights")
def highlights(spark, d):
    """Smooth, trim, range-normalise, find peaks and valleys of both modalities, merge, plan the clips."""
    curves = {}
    for modality, kinds in _MODALITIES:
        a = S.smooth(S.to_arrays(_modality(spark, d, *kinds)).where(F.size("y") > 10), 5)
        a = S.settled(a, y=F.slice("y", F.lit(3), F.greatest(F.size("y") - 4, F.lit(0))))
        a = S.settled(a, lo=F.array_min("y"), hi=F.array_max("y"))
        ranged = a.withColumn("y", F.transform("y", lambda v: (v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))
        curves[modality] = cut(S.to_long(ranged), f"highlights-{modality}")
    clips = P.merged(_marked(curves, 4, (0.85, -0.15)), 3)
    return clips.select("series_id", "pos", "tags", (300 + F.floor("pos") - 15).alias("start"), (300 + F.floor("pos") + 15).alias("end"))


# --- serving -------------------------------------------------------------------------------------------------------
def serve(spark: SparkSession, d: str, series: int, visual_window: int, audio_window: int, credits: DataFrame | None = None) -> DataFrame:
    """``(modality, i, value, std)`` of one series, each modality smoothed with its own window.

    The visual curve has a constant band; the audio curve's band is the
    deviation of its clips.  ``credits(series_id, credits_at)`` cuts the end.  A
    modality shorter than its window is left as it is.
    """
    out = None
    for (modality, kinds), window in zip(_MODALITIES, (visual_window, audio_window)):
        a = S.to_arrays(_modality(spark, d, *kinds).where(F.col("series_id") == series))
        a = S.credits_trim(a, credits) if credits is not None else a
        smoothed = S.smooth(a.where(F.size("y") >= window), window).unionByName(a.where(F.size("y") < window))
        std = F.lit(0.04) if modality == "visual" else F.coalesce(F.col("std"), F.lit(0.0))
        own = S.to_long(S.mean_std(smoothed), "std").select(F.lit(modality).alias("modality"), "i", "value", std.alias("std"))
        out = own if out is None else out.unionByName(own)
    return out


def _served_sql(modality: str, w: int, std: str) -> str:
    source = f"(select series_id, i, value from {_VISUAL if modality == 'visual' else _AUDIO} m where series_id = 7)"
    return f"""select '{modality}' as modality, i::int as i, round(value, 6) as value, round({std}, 6) as std from
        (select i, value, stddev_pop(value) over () as s from {smooth_sql(source, w, 'hanning')} z)"""


@query("serve_pred", f"{_served_sql('visual', 9, '0.04::double')} union all {_served_sql('audio', 5, 's')}")
def serve_pred(spark, d):
    return serve(spark, d, 7, 9, 5).withColumn("value", F.round("value", 6)).withColumn("std", F.round("std", 6))


@query("serve_shape", f"""select series_id, count(*) as points, round(min(value), 6) as low, round(max(value), 6) as high from {smooth_sql(LONG_ENOUGH, 9, 'hanning')} z group by 1""")
def serve_shape(spark, d):
    return S.to_long(S.smooth(_enough(spark, d), 9)).groupBy("series_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("cluster_view", f"""select series_id, (i - 6) // 5 as i, value from (select *, count(*) over (partition by series_id) as n from {SIGNAL} q) where i >= 6 and i < n - 6 and (i - 6) % 5 = 0""")
def cluster_view(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return signal(spark, d).withColumn("n", n).where("i >= 6 and i < n - 6 and (i - 6) % 5 = 0").select("series_id", F.expr("(i - 6) div 5").alias("i"), "value")
