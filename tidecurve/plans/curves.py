"""The curves the queries run on, and SQL building blocks that say the same for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecurve.operators import series as S
from tidecurve.sources.tables import table

WINDOW, POINTS, RADIUS = 9, 60, 5


def signal(spark: SparkSession, d: str) -> DataFrame:
    """``(series_id, i, value, event_type)``: each user's events in time order."""
    own = table(spark, d, "events").withColumn("i", S.position("user_id", "ts", "event_id"))
    return own.select(F.col("user_id").alias("series_id"), "i", "value", "event_type")


def arrays(spark: SparkSession, d: str) -> DataFrame:
    return S.to_arrays(signal(spark, d))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed, resampled to ``POINTS`` and normalised curves."""
    return S.prepare(arrays(spark, d), None, WINDOW, 1, None, POINTS)


SIGNAL = "(select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value, event_type from events)"


def smooth_sql(source: str, w: int, kind: str) -> str:
    a = f"2 * pi() * j / {w - 1}"
    shape = {
        "flat": "1.0", "hanning": f"0.5 - 0.5 * cos({a})", "hamming": f"0.54 - 0.46 * cos({a})",
        "bartlett": f"1 - abs(2.0 * j / {w - 1} - 1)", "blackman": f"0.42 - 0.5 * cos({a}) + 0.08 * cos(2 * {a})",
    }[kind]
    return f"""(with src as (select series_id, i, value, count(*) over (partition by series_id) as n from {source} q),
        ker as (select j, w / sum(w) over () as w from (select j, {shape} as w from range({w}) t(j))),
        need as (select s.series_id, s.i, s.n, k.w, s.i + {(w - 1) // 2} - k.j as p from src s, ker k where s.n >= {w}),
        place as (select *, case when p < 0 then -p - 1 when p > n - 1 then 2 * n - 1 - p else p end as q,
                     case when p < 0 then 0 when p > n - 1 then n - 1 end as e from need)
        select f.series_id, f.i, sum(f.w * case when f.e is null then x.value else 2 * y.value - x.value end) as value
        from place f join src x on x.series_id = f.series_id and x.i = f.q
        left join src y on y.series_id = f.series_id and y.i = f.e group by 1, 2)"""


def resample_sql(source: str, points: int) -> str:
    return f"""(with src as (select series_id, i, value, count(*) over (partition by series_id) as n from {source} q),
        spine as (select series_id, n, k, k * (n - 1)::double / {points - 1} as x from (select distinct series_id, n from src) u, range({points}) t(k))
        select s.series_id, s.k as i, a.value + (b.value - a.value) * (s.x - floor(s.x)) as value
        from spine s join src a on a.series_id = s.series_id and a.i = least(floor(s.x)::bigint, s.n - 1)
        join src b on b.series_id = s.series_id and b.i = least(floor(s.x)::bigint + 1, s.n - 1))"""


def znorm_sql(source: str) -> str:
    w = "over (partition by series_id)"
    return f"(select series_id, i, (value - avg(value) {w}) / nullif(stddev_pop(value) {w}, 0) as value from {source} q)"


LONG_ENOUGH = f"(select * exclude n from (select *, count(*) over (partition by series_id) as n from {SIGNAL} q) where n > {WINDOW})"
PREPARED = znorm_sql(resample_sql(smooth_sql(LONG_ENOUGH, WINDOW, "hanning"), POINTS))
_ENV = f"over (partition by series_id order by i rows between {RADIUS} preceding and {RADIUS - 1} following)"


def lb_sql(source: str, where: str = "x.series_id < e.series_id") -> str:
    return f"""(with z as (select * from {source} q), env as (select series_id, i, min(value) {_ENV} as lo, max(value) {_ENV} as up from z)
        select x.series_id as a, e.series_id as b,
               sqrt(sum(case when x.value > e.up then (x.value - e.up) ** 2 when x.value < e.lo then (x.value - e.lo) ** 2 else 0 end)) as d
        from z x join env e on x.i = e.i and {where} group by 1, 2)"""
