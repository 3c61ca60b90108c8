"""Queries over records: scans, filters, joins, aggregates, ordering, sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidecurve.functions import labels as L, text as X
from tidecurve.plans.base import query
from tidecurve.shared import cut
from tidecurve.sources.tables import table

_W = Window.partitionBy


def _count() -> Column:
    return F.count(F.lit(1))


# --- scans and shaping ---------------------------------------------------------------------------------------------
@query("valid_series", "select dirpath, bool_or(file_name ilike 'frame%') and sum(n_bytes) > 0 and bool_or(file_name = 'credits_index.txt') as valid from frame_files group by 1")
def valid_series(spark, d):
    own = table(spark, d, "frame_files").groupBy("dirpath")
    lower = F.lower("file_name")
    return own.agg((F.bool_or(lower.startswith("frame")) & (F.sum("n_bytes") > 0) & F.bool_or(F.col("file_name") == "credits_index.txt")).alias("valid"))


@query("valid_series_both", """select dirpath, count(*) filter (file_name ilike 'frame%') as nframes from frame_files group by 1
    having bool_or(file_name = 'credits_index.txt') and bool_or(file_name ilike 'frame%')""")
def valid_series_both(spark, d):
    frame = F.lower("file_name").startswith("frame")
    own = table(spark, d, "frame_files").groupBy("dirpath").agg(F.count_if(frame).alias("nframes"), F.bool_or(F.col("file_name") == "credits_index.txt").alias("marked"))
    return own.where("marked and nframes > 0").drop("marked")


@query("scan_filter_eq", "select title, dirpath from videopath where category = 'films'")
def scan_filter_eq(spark, d):
    return table(spark, d, "videopath").where("category = 'films'").select("title", "dirpath")


@query("not_null_both", "select msd_track_id, spotify_track_id from msdspotifymatch where spotify_track_id is not null and spotify_preview_url is not null")
def not_null_both(spark, d):
    return table(spark, d, "msdspotifymatch").where("spotify_track_id is not null and spotify_preview_url is not null").select("msd_track_id", "spotify_track_id")


@query("tsv_null_cast_dedup", "select title, arg_max(track_id, track_id) as track_id, arg_max(nullif(year, 0), track_id) filter (true) as year from songs where title is not null and nullif(year, 0) is not null group by 1")
def tsv_null_cast_dedup(spark, d):
    """Last row per title wins; an unknown year (0) is null and not considered."""
    own = table(spark, d, "songs").withColumn("year", F.nullif(F.col("year"), F.lit(0))).where("title is not null and year is not null")
    return own.groupBy("title").agg(F.max("track_id").alias("track_id"), F.max_by("year", "track_id").alias("year"))


@query("json_key_list", "select user_id, string_agg(k, ',' order by k, event_id) as ks from (select user_id, event_id, json_extract_string(props, '$.k') as k from events) group by 1")
def json_key_list(spark, d):
    own = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "event_id")))
    return own.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda p: p["k"]), ",").alias("ks"))


@query("json_project", "select event_id, json_extract_string(props, '$.k')::int as k, json_extract_string(props, '$.missing') as missing from events")
def json_project(spark, d):
    parsed = F.from_json("props", "k INT, missing STRING")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query("json_map_values", "select event_id, list_transform(json_keys(props), lambda k: json_extract_string(props, k))[1] as v from events")
def json_map_values(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(F.map_values(F.from_json("props", "map<string,string>")), 1).alias("v"))


@query("json_first_or_null", "select event_id, json_extract_string('{\"items\":[' || props || ']}', '$.items[0].k') as first, json_extract_string(props, '$.items[0].k') as none from events")
def json_first_or_null(spark, d):
    wrapped = F.concat(F.lit('{"items":['), "props", F.lit("]}"))
    return table(spark, d, "events").select("event_id", F.get_json_object(wrapped, "$.items[0].k").alias("first"), F.get_json_object("props", "$.items[0].k").alias("none"))


@query("majority_vote_filter", """select bc, count(*) filter (sent_biclass = 1) as agree, count(*) filter (sent_biclass = 0) as disagree from tfrecords where bc is not null
    group by 1 having count(*) filter (sent_biclass = 1) > count(*) filter (sent_biclass = 0)""")
def majority_vote_filter(spark, d):
    own = table(spark, d, "tfrecords").where("bc is not null").groupBy("bc").agg(F.count_if(F.col("sent_biclass") == 1).alias("agree"), F.count_if(F.col("sent_biclass") == 0).alias("disagree"))
    return own.where("agree > disagree")


@query("feature_enrich", "select t.rec_id, t.sent_reg::float as sent_reg, c.sentiment::float as sentiment from tfrecords t join concepts c on t.bc = c.bc where t.sent_reg is not null and t.emo is not null")
def feature_enrich(spark, d):
    own = table(spark, d, "tfrecords").select("rec_id", "bc", "sent_reg", "emo").dropna(subset=["sent_reg", "emo"])
    return own.join(table(spark, d, "concepts"), "bc").select("rec_id", F.col("sent_reg").cast("float").alias("sent_reg"), F.col("sentiment").cast("float").alias("sentiment"))


@query("count_per_partition", "select shard_path, count(*) as n from tfrecords group by 1")
def count_per_partition(spark, d):
    return table(spark, d, "tfrecords").groupBy("shard_path").agg(_count().alias("n"))


@query("to_json_counts", """select split, '{' || string_agg('"' || bc || '":' || n, ',' order by bc) || '}' as counts from (select split, bc, count(*) as n from tfrecords where bc is not null and split is not null group by 1, 2) group by 1""")
def to_json_counts(spark, d):
    own = table(spark, d, "tfrecords").where("bc is not null and split is not null").groupBy("split", "bc").agg(_count().alias("n"))
    return own.groupBy("split").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bc", "n"))))).alias("counts"))


@query("batch_ids", "select track_id, (row_number() over (order by track_id) - 1) // 50 as batch from songs")
def batch_ids(spark, d):
    return _numbered(table(spark, d, "songs").select("track_id"), "track_id").select("track_id", F.expr("rn div 50").alias("batch"))


def _numbered(df: DataFrame, *order: str | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Row numbers ``rn`` from 0 in order, over all rows or ``within`` groups, without one task seeing a whole group.

    A range partitioning orders the rows, counts per partition (and group) give
    each its offset, and ranks are local; so a hot group is spread over as many
    partitions as its size asks for.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.repartitionByRange(*[F.col(c) for c in within], *by).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("_part", *within).agg(_count().alias("_n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # one row per partition and group
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], "_offset")
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    local = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*by)) - 1
    numbered = placed.withColumn("_local", local).join(offsets, same).withColumn("rn", F.col("_local") + F.col("_offset"))
    return numbered.drop("_part", "_local", "_offset", "_p", *[f"_w{k}" for k in range(len(within))])


def _sized(df: DataFrame, group: str, size: str) -> DataFrame:
    """Add the number of rows of each group, nulls being one; counted before the shuffle, joined by value."""
    counts = df.groupBy(F.col(group).alias("_g")).agg(_count().alias(size))
    return df.join(counts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


@query("config_coalesce", "select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_totalprice end, case when o_orderkey % 2 = 0 then 2.0::double end, 1.0::double) as value from orders")
def config_coalesce(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(k % 3 == 0, F.col("o_totalprice")), F.when(k % 2 == 0, 2.0), F.lit(1.0)).alias("value"))


@query("clip_plan", "select event_id, 300 + floor(value)::bigint - 15 as start, 300 + floor(value)::bigint + 15 as end_, event_type || '+' || (event_id % 5) as name from events")
def clip_plan(spark, d):
    at = 300 + F.floor("value")
    return table(spark, d, "events").select("event_id", (at - 15).alias("start"), (at + 15).alias("end_"), F.concat_ws("+", "event_type", (F.col("event_id") % 5).cast("string")).alias("name"))


@query("video_inventory", "select dirpath, max(category) as category, max(ext) as ext, max(coalesce(num_frames, 0)) > 0 as has_frames, max(coalesce(num_frames, 0)) as num_frames from videopath group by 1")
def video_inventory(spark, d):
    frames = F.max(F.coalesce("num_frames", F.lit(0)))
    return table(spark, d, "videopath").groupBy("dirpath").agg(F.max("category").alias("category"), F.max("ext").alias("ext"), (frames > 0).alias("has_frames"), frames.alias("num_frames"))


# --- filters -------------------------------------------------------------------------------------------------------
@query("neutral_filter", "select concept, sentiment from concepts where sentiment < -0.5 or sentiment > 0.5")
def neutral_filter(spark, d):
    return table(spark, d, "concepts").where(L.not_neutral(F.col("sentiment"))).select("concept", "sentiment")


@query("valence_class", "select l_orderkey, l_linenumber, v, case when v < 0.25 then 0 else 1 end as valence from (select l_orderkey, l_linenumber, l_discount * 10 as v from lineitem) where not (v > 0.25 and v < 0.75)")
def valence_class(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("v"))
    return own.where("not (v > 0.25 and v < 0.75)").withColumn("valence", L.valence_class(F.col("v")))


@query("rating_threshold_counts", "select delta, count(*) filter (m < 5 - delta or m > 5 + delta) as kept from (select l_quantity / 5 as m from lineitem), (values (0.25::double), (0.5), (0.67), (1.0)) t(delta) group by 1")
def rating_threshold_counts(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_quantity") / 5).alias("m"))
    deltas = [0.25, 0.5, 0.67, 1.0]
    one = own.agg(*[F.count_if((F.col("m") < 5 - t) | (F.col("m") > 5 + t)).alias(f"k{i}") for i, t in enumerate(deltas)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("delta"), F.col(f"k{i}").alias("kept")) for i, t in enumerate(deltas)])))


_SPLIT = "case when rn < floor(n * 0.8::double) then 'train' when rn < floor(n * 0.8::double) + floor(n * 0.1::double) then 'valid' else 'test' end"


@query("split_positional", f"select rec_id, {_SPLIT} as part from (select rec_id, row_number() over (partition by bc order by rec_id) - 1 as rn, count(*) over (partition by bc) as n from tfrecords)")
def split_positional(spark, d):
    own = _sized(_numbered(table(spark, d, "tfrecords").select("rec_id", "bc"), "rec_id", within=("bc",)), "bc", "n")
    return own.select("rec_id", L.split_positional(F.col("rn"), F.col("n")).alias("part"))


@query("split_modulo", "select rec_id, case when rec_id % 1000 < 800 then 'train' when rec_id % 1000 < 900 then 'valid' else 'test' end as part from tfrecords")
def split_modulo(spark, d):
    m = F.pmod("rec_id", F.lit(1000))
    return table(spark, d, "tfrecords").select("rec_id", F.when(m < 800, "train").when(m < 900, "valid").otherwise("test").alias("part"))


@query("min_class_size", "select bc, count(*) as n from tfrecords where bc is not null group by 1 having count(*) >= 12")
def min_class_size(spark, d):
    return table(spark, d, "tfrecords").where("bc is not null").groupBy("bc").agg(_count().alias("n")).where("n >= 12")


@query("filter_isin", "select bc, concept from concepts where concept in ('dusty_comet', 'winter_bell', 'gentle_swan', 'noble_apple')")
def filter_isin(spark, d):
    return table(spark, d, "concepts").where(F.col("concept").isin("dusty_comet", "winter_bell", "gentle_swan", "noble_apple")).select("bc", "concept")


@query("filter_suffix", "select dirpath, movie_fn from videopath where regexp_matches(lower(movie_fn), '\\.(mp4|avi|mkv|webm)$') and not contains(lower(movie_fn), 'sample') and not starts_with(movie_fn, '.')")
def filter_suffix(spark, d):
    low = F.lower("movie_fn")
    return table(spark, d, "videopath").where(low.rlike(r"\.(mp4|avi|mkv|webm)$") & ~low.contains("sample") & ~F.col("movie_fn").startswith(".")).select("dirpath", "movie_fn")


@query("filter_size", "select file_id, n_bytes from frame_files where n_bytes / 1000000.0::double > 0.01::double")
def filter_size(spark, d):
    return table(spark, d, "frame_files").where(F.col("n_bytes") / 1e6 > 0.01).select("file_id", "n_bytes")


_GOOD = "duration_ms is not null and release_year is not null"


@query("good_bad_stats", f"""select count(*) filter ({_GOOD}) as good, count(*) filter (not ({_GOOD})) as bad, round(avg(duration_ms) filter ({_GOOD}), 3) as mean_duration,
    round(avg(release_year) filter ({_GOOD}), 6) as mean_year from spotify_items""")
def good_bad_stats(spark, d):
    good = F.col("duration_ms").isNotNull() & F.col("release_year").isNotNull()
    return table(spark, d, "spotify_items").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.round(F.avg(F.when(good, F.col("duration_ms"))), 3).alias("mean_duration"), F.round(F.avg(F.when(good, F.col("release_year"))), 6).alias("mean_year"))


@query("truthy_filter", "select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where l_discount <> 0 and l_tax <> 0")
def truthy_filter(spark, d):
    """Rows in which both are known; ``compat``, which also drops zeros, is what the SQL says."""
    kept = L.present(F.col("l_discount"), F.col("l_tax"), compat=True)
    return table(spark, d, "lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("present_filter", "select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where l_discount is not null and l_tax is not null")
def present_filter(spark, d):
    return table(spark, d, "lineitem").where(L.present(F.col("l_discount"), F.col("l_tax"))).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("filter_below_mean_plus_std", "select event_id, value from events where value < (select avg(value) + stddev_samp(value) from events)")
def filter_below_mean_plus_std(spark, d):
    own = table(spark, d, "events").select("event_id", "value")
    bound = own.agg((F.avg("value") + F.stddev_samp("value")).alias("b")).collect()[0]["b"]  # one number
    return own.where(F.col("value") < F.lit(bound))


@query("incremental_anti", "select track_id from songs where upper(track_id) not in (select upper(trim(msd_track_id)) from msdspotifymatch where msd_track_id is not null)")
def incremental_anti(spark, d):
    done = table(spark, d, "msdspotifymatch").select(F.upper(F.trim("msd_track_id")).alias("k")).distinct()
    return table(spark, d, "songs").select("track_id", F.upper("track_id").alias("k")).join(done, "k", "left_anti").select("track_id")


@query("point_lookup", "select concept, sentiment from concepts where bc = 48")
def point_lookup(spark, d):
    return table(spark, d, "concepts").where("bc = 48").select("concept", "sentiment")


@query("balance_classes", """select rec_id, sent_biclass from (select rec_id, sent_biclass, row_number() over (partition by sent_biclass order by rec_id) as rn, (select count(*) from tfrecords where sent_biclass = 1) as pos from tfrecords)
    where sent_biclass = 0 or (sent_biclass = 1 and rn <= pos // 2 + 1)""")
def balance_classes(spark, d):
    own = table(spark, d, "tfrecords").select("rec_id", "sent_biclass")
    positive = cut(_numbered(own.where("sent_biclass = 1"), "rec_id"), "balance")
    kept = positive.where(F.col("rn") <= positive.count() // 2).drop("rn")
    return own.where("sent_biclass = 0").unionByName(kept)


# --- joins ---------------------------------------------------------------------------------------------------------
@query("join_inner_lookup", "select t.rec_id, c.concept from tfrecords t join concepts c on t.bc = c.bc")
def join_inner_lookup(spark, d):
    return table(spark, d, "tfrecords").select("rec_id", "bc").join(table(spark, d, "concepts").select("bc", "concept"), "bc").select("rec_id", "concept")


@query("join_left_default", "select t.rec_id, coalesce(c.sentiment, 0.0) as sentiment from tfrecords t left join concepts c on t.bc = c.bc")
def join_left_default(spark, d):
    return table(spark, d, "tfrecords").select("rec_id", "bc").join(table(spark, d, "concepts").select("bc", "sentiment"), "bc", "left").select("rec_id", F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"))


@query("join_remap_default", "select t.rec_id, coalesce(m.idx, -1) as idx from tfrecords t left join (select bc, row_number() over (order by bc) - 1 as idx from concepts where sentiment > 0) m on t.bc = m.bc")
def join_remap_default(spark, d):
    remap = _numbered(table(spark, d, "concepts").where("sentiment > 0").select("bc"), "bc").select("bc", F.col("rn").alias("idx"))
    return table(spark, d, "tfrecords").select("rec_id", "bc").join(remap, "bc", "left").select("rec_id", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query("join_semi", "select track_id, title from songs where track_id in (select msd_track_id from msdspotifymatch)")
def join_semi(spark, d):
    return table(spark, d, "songs").select("track_id", "title").join(table(spark, d, "msdspotifymatch").select(F.col("msd_track_id").alias("track_id")), "track_id", "left_semi")


@query("join_anti", "select s.track_id from songs s where not exists (select 1 from msdspotifymatch m where m.msd_track_id = s.track_id)")
def join_anti(spark, d):
    return table(spark, d, "songs").select("track_id").join(table(spark, d, "msdspotifymatch").select(F.col("msd_track_id").alias("track_id")), "track_id", "left_anti")


@query("join_semi_anti_chain", """select distinct msd_track_id, spotify_track_id from msdspotifymatch m where spotify_track_id is not null and spotify_preview_url is not null
    and exists (select 1 from spotify_items p where p.spotify_track_id = m.spotify_track_id and p.duration_ms is not null) and not exists (select 1 from songs s where s.track_id = m.msd_track_id and s.year = 0)""")
def join_semi_anti_chain(spark, d):
    own = table(spark, d, "msdspotifymatch").where("spotify_track_id is not null and spotify_preview_url is not null").select("msd_track_id", "spotify_track_id").distinct()
    featured = table(spark, d, "spotify_items").where("duration_ms is not null").select("spotify_track_id")
    done = table(spark, d, "songs").where("year = 0").select(F.col("track_id").alias("msd_track_id"))
    return own.join(featured, "spotify_track_id", "left_semi").join(done, "msd_track_id", "left_anti")


_FUZZY = """with a as (select distinct p_name from part), scored as (select a.p_name, c.concept, round(case when greatest(length(a.p_name), length(c.concept)) = 0 then 100 else
    100.0 * (1 - levenshtein(a.p_name, c.concept)::double / greatest(length(a.p_name), length(c.concept))) end, 4) as score from a, (select distinct replace(concept, '_', ' ') as concept from concepts) c),
    ranked as (select *, row_number() over (partition by p_name order by score desc, concept desc) as rank from scored)"""


#: Names of one block of the other side that a name is compared with in one go.
FUZZY_BLOCK = 2000


def fuzzy_nearest(left: DataFrame, name: str, right: DataFrame, other: str, k: int, block: int = FUZZY_BLOCK) -> DataFrame:
    """``(name, other, score, rank)``: the ``k`` most alike of ``right`` for every name of ``left``; ties by the later name.

    The smaller side comes as arrays of at most ``block`` names, one row each;
    a name meets every array in an equi-join and keeps its ``k`` best of each
    right there, so no pair leaves its row.  Any size of ``right`` will do.
    """
    names = cut(right.select(F.col(other).alias("o")).where("o is not null").distinct(), "fuzzy")
    blocks = max(1, -(-names.count() // block))
    arrays = names.groupBy(F.pmod(F.xxhash64("o"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("o").alias("others"))
    own = left.select(F.col(name).alias("n")).where("n is not null").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = F.transform("others", lambda o: F.struct(X.ratio(F.col("n"), o).alias("score"), o.alias("o")))
    best = own.join(arrays, "block").select("n", F.explode(F.slice(F.sort_array(scored, asc=False), 1, k)).alias("m")).select("n", "m.*")
    rank = F.row_number().over(_W("n").orderBy(F.desc("score"), F.desc("o")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("n").alias(name), F.col("o").alias(other), "score", "rank")


def _fuzzy(spark, d, k: int) -> DataFrame:
    concepts = table(spark, d, "concepts").select(F.translate("concept", "_", " ").alias("concept"))
    return fuzzy_nearest(table(spark, d, "part"), "p_name", concepts, "concept", k)


@query("fuzzy_topk_join", f"{_FUZZY} select p_name, concept, score from ranked where rank = 1")
def fuzzy_topk_join(spark, d):
    return _fuzzy(spark, d, 1).drop("rank")


@query("fuzzy_top10", f"{_FUZZY} select p_name, concept, score, rank::int as rank from ranked where rank <= 10")
def fuzzy_top10(spark, d):
    return _fuzzy(spark, d, 10)


@query("fuzzy_indel")
def fuzzy_indel(spark, d):
    """Each part name's most alike concept by the indel ratio, over the ten nearest by edit distance."""
    ratio = F.pandas_udf(lambda a, b: pd.Series([round(X.indel_ratio(x, y), 4) for x, y in zip(a, b)]), "double")
    scored = _fuzzy(spark, d, 10).select("p_name", "concept", ratio("p_name", "concept").alias("score"))
    best = scored.groupBy("p_name").agg(F.max(F.struct("score", "concept")).alias("m"))
    return best.select("p_name", F.col("m.concept").alias("concept"), F.col("m.score").alias("score"))


@query("union_formats", "select 'songs' as fmt, track_id as id, title, null::varchar as album from songs union all select 'items', spotify_track_id, name, album from spotify_items")
def union_formats(spark, d):
    songs = table(spark, d, "songs").select(F.lit("songs").alias("fmt"), F.col("track_id").alias("id"), "title")
    items = table(spark, d, "spotify_items").select(F.lit("items").alias("fmt"), F.col("spotify_track_id").alias("id"), F.col("name").alias("title"), "album")
    return songs.unionByName(items, allowMissingColumns=True)


@query("explode_group", "select g as dataset, count(*) as n, min(title) as first_title from (select title, unnest(string_split(datasets, ',')) as g from videopath where datasets is not null) group by 1")
def explode_group(spark, d):
    own = table(spark, d, "videopath").where("datasets is not null").select("title", F.explode(F.split("datasets", ",")).alias("dataset"))
    return own.groupBy("dataset").agg(_count().alias("n"), F.min("title").alias("first_title"))


@query("lexicon_join_count", """with w as (select bc, unnest(string_split(concept, '_')) as word from concepts), l as (select word, sum(case when sentiment < 0 then 1 else 0 end)::bigint as neg, count(*) as n from
    (select sentiment, unnest(string_split(concept, '_')) as word from concepts) group by 1) select w.bc, sum(l.neg)::bigint as neg, sum(l.n)::bigint as n from w join l on w.word = l.word group by 1""")
def lexicon_join_count(spark, d):
    words = table(spark, d, "concepts").select("bc", "sentiment", F.explode(F.split("concept", "_")).alias("word"))
    lexicon = words.groupBy("word").agg(F.count_if(F.col("sentiment") < 0).alias("neg"), _count().alias("n"))
    return words.select("bc", "word").join(lexicon, "word").groupBy("bc").agg(F.sum("neg").alias("neg"), F.sum("n").alias("n"))


# --- aggregates ----------------------------------------------------------------------------------------------------
@query("repeat_mean_std", "select source, split, round(avg(sent_reg), 5) as mean, round(stddev_pop(sent_reg), 5) as std from tfrecords group by 1, 2")
def repeat_mean_std(spark, d):
    v = F.col("sent_reg").cast("double")
    return table(spark, d, "tfrecords").groupBy("source", "split").agg(F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_pop(v), 5).alias("std"))


@query("avg_item_mean_std", "select round(avg(m), 6) as mean, round(avg(s), 6) as std from (select l_orderkey, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1)")
def avg_item_mean_std(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return per.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("std"))


@query("weighted_avg", "select l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as mean from lineitem group by 1")
def weighted_avg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(L.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


@query("channel_stats", "select label, channel, round(avg(m), 5) as mean, round(avg(s), 5) as std from (select vec_id, label, k % 3 as channel, avg(x) as m, stddev_pop(x) as s from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as k from embeddings) group by 1, 2, 3) group by 1, 2")
def channel_stats(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("channel", (F.col("k") % 3).cast("bigint")).withColumn("x", F.col("x").cast("double"))
    per = own.groupBy("vec_id", "label", "channel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return per.groupBy("label", "channel").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.avg("s"), 5).alias("std"))


@query("count_by_label", "select split, sent_triclass, count(*) as n from tfrecords group by 1, 2")
def count_by_label(spark, d):
    return table(spark, d, "tfrecords").groupBy("split", "sent_triclass").agg(_count().alias("n"))


@query("distinct_dense_index", "select distinct bc, emo, dense_rank() over (order by bc) - 1 as idx from (select distinct bc, emo from tfrecords where bc is not null and emo is not null)")
def distinct_dense_index(spark, d):
    own = table(spark, d, "tfrecords").where("bc is not null and emo is not null").select("bc", "emo").distinct()
    index = _numbered(own.select("bc").distinct(), "bc").select("bc", F.col("rn").alias("idx"))
    return own.join(index, "bc")


@query("sorted_index", "select concept, row_number() over (order by concept) - 1 as idx from concepts")
def sorted_index(spark, d):
    return _numbered(table(spark, d, "concepts").select("concept"), "concept").select("concept", F.col("rn").alias("idx"))


@query("mode_tiebreak", "select bc, emo, n from (select bc, emo, count(*) as n, row_number() over (partition by bc order by count(*) desc, emo) as r from tfrecords where bc is not null and emo is not null group by 1, 2) where r = 1")
def mode_tiebreak(spark, d):
    own = table(spark, d, "tfrecords").where("bc is not null and emo is not null").groupBy("bc", "emo").agg(_count().alias("n"))
    best = own.groupBy("bc").agg(F.min(F.struct((-F.col("n")).alias("m"), "emo")).alias("b"))
    return best.select("bc", F.col("b.emo").alias("emo"), (-F.col("b.m")).alias("n"))


@query("argmax_label", "select user_id, arg_max(event_type, total) as event_type from (select user_id, event_type, sum(value) as total from events group by 1, 2) group by 1")
def argmax_label(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total")).groupBy("user_id").agg(F.max_by("event_type", "total").alias("event_type"))


@query("class_weights", "select label, n, round(r / sum(r) over (), 6) as weight from (select label, n, max(n) over ()::double / n as r from (select label, count(*) as n from embeddings group by 1))")
def class_weights(spark, d):
    counts = table(spark, d, "embeddings").groupBy("label").agg(_count().alias("n"))
    return L.class_weights(counts).withColumn("weight", F.round("weight", 6))


@query("hist_fixed", "select b as bin, count(v) as n from range(64) t(b) left join (select floor(value / 8)::bigint as v from events where value >= 0 and value < 512) on v = b group by 1")
def hist_fixed(spark, d):
    counted = table(spark, d, "events").where("value >= 0 and value < 512").groupBy(F.floor(F.col("value") / 8).alias("bin")).agg(_count().alias("n"))
    return spark.range(64).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("hist_range", """with r as (select min(value) as lo, max(value) as hi from events) select b as bin, count(v) as n from range(25) t(b) left join
    (select least(floor((value - lo) / ((hi - lo) / 25))::bigint, 24) as v from events, r) on v = b group by 1""")
def hist_range(spark, d):
    own = table(spark, d, "events").select("value")
    lo, hi = own.agg(F.min("value"), F.max("value")).collect()[0]  # one row
    at = F.least(F.floor((F.col("value") - lo) / F.lit((hi - lo) / 25)), F.lit(24))
    counted = own.groupBy(at.alias("bin")).agg(_count().alias("n"))
    return spark.range(25).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("density_2d", "select floor(l_quantity / 5)::bigint as qx, floor(l_discount * 50)::bigint as dy, count(*) as n from lineitem group by 1, 2")
def density_2d(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("qx"), F.floor(F.col("l_discount") * 50).alias("dy")).agg(_count().alias("n"))


@query("hist_weighted_avg", "select l_returnflag, (sum(b * n) // sum(n))::bigint as mean from (select l_returnflag, floor(l_quantity)::bigint as b, count(*) as n from lineitem group by 1, 2) group by 1")
def hist_weighted_avg(spark, d):
    hist = table(spark, d, "lineitem").groupBy("l_returnflag", F.floor("l_quantity").alias("b")).agg(_count().alias("n"))
    return hist.groupBy("l_returnflag").agg(F.expr("sum(b * n) div sum(n)").alias("mean"))


@query("describe_stats", "select event_type, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(*) as n from events group by 1")
def describe_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), _count().alias("n"))


@query("located_counts", "select category, count(*) filter (num_frames > 0) as located, count(*) filter (coalesce(num_frames, 0) = 0) as not_located from videopath group by 1")
def located_counts(spark, d):
    n = F.coalesce("num_frames", F.lit(0))
    return table(spark, d, "videopath").groupBy("category").agg(F.count_if(n > 0).alias("located"), F.count_if(n == 0).alias("not_located"))


@query("accuracy", "select round(avg(case when sent_biclass = (sent_reg >= 0)::int then 1.0::double else 0 end), 6) as accuracy, count(*) as n from tfrecords where sent_biclass is not null and sent_reg is not null")
def accuracy(spark, d):
    own = table(spark, d, "tfrecords").where("sent_biclass is not null and sent_reg is not null")
    return own.agg(F.round(F.avg((F.col("sent_biclass") == (F.col("sent_reg") >= 0).cast("int")).cast("double")), 6).alias("accuracy"), _count().alias("n"))


@query("split_stats", "select split, count(*) as n, round(avg(sent_reg) filter (split = 'train'), 5) as mean from tfrecords group by 1")
def split_stats(spark, d):
    v = F.when(F.col("split") == "train", F.col("sent_reg").cast("double"))
    return table(spark, d, "tfrecords").groupBy("split").agg(_count().alias("n"), F.round(F.avg(v), 5).alias("mean"))


@query("split_counts", "select split, count(*) as n from tfrecords where split in ('train', 'valid', 'test') group by 1")
def split_counts(spark, d):
    return table(spark, d, "tfrecords").where(F.col("split").isin("train", "valid", "test")).groupBy("split").agg(_count().alias("n"))


@query("batch_counts", "select split, count(*) // 16 as batches from tfrecords group by 1")
def batch_counts(spark, d):
    return table(spark, d, "tfrecords").groupBy("split").agg(F.floor(_count() / 16).alias("batches"))


@query("group_collect_list", "select bc, string_agg(rec_id::varchar, ',' order by rec_id) as ids from tfrecords where bc is not null and split = 'test' group by 1")
def group_collect_list(spark, d):
    own = table(spark, d, "tfrecords").where("bc is not null and split = 'test'").groupBy("bc")
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list("rec_id")), lambda v: v.cast("string")), ",").alias("ids"))


@query("batch_tail_drop", "select rec_id from (select rec_id, row_number() over (order by rec_id) - 1 as rn, (select count(*) from tfrecords) as n from tfrecords) where rn < n // 32 * 32")
def batch_tail_drop(spark, d):
    own = table(spark, d, "tfrecords").select("rec_id")
    return _numbered(own, "rec_id").where(F.col("rn") < own.count() // 32 * 32).select("rec_id")


@query("frame_at_position", """select v.series_id, v.i, f.file_id from (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) v
    join (select file_id, row_number() over (order by try_cast(regexp_extract(file_name, '(\\d+)', 1) as bigint) nulls first, file_name, file_id) - 1 as i from frame_files) f on v.i = f.i""")
def frame_at_position(spark, d):
    """The frame at each position of a curve, frames in natural order of their names."""
    own = table(spark, d, "frame_files").select("file_name", "file_id", _file_number().alias("number"))
    frames = _numbered(own, F.col("number").asc_nulls_first(), "file_name", "file_id").select(F.col("rn").alias("i"), "file_id")
    at = F.row_number().over(_W("user_id").orderBy("ts", "event_id")) - 1
    curve = table(spark, d, "events").select(F.col("user_id").alias("series_id"), at.cast("bigint").alias("i"))
    return curve.join(frames, "i").select("series_id", "i", "file_id")


@query("column_subset", "select o_orderkey, o_orderdate, o_totalprice from orders")
def column_subset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("whole_seconds", "select track_id, floor(duration * 1000)::bigint // 22050 as seconds from songs where duration is not null")
def whole_seconds(spark, d):
    """Samples over sample rate, divided as integers."""
    return table(spark, d, "songs").where("duration is not null").select("track_id", F.expr("floor(duration * 1000) div 22050").alias("seconds"))


# --- ordering and sets ---------------------------------------------------------------------------------------------
def _file_number() -> Column:
    """The first number in a file's name."""
    return F.try_to_number(F.regexp_extract("file_name", r"(\d+)", 1), F.lit("999999999999")).cast("bigint")


@query("natural_sort", "select dirpath, file_name, row_number() over (partition by dirpath order by try_cast(regexp_extract(file_name, '(\\d+)', 1) as bigint) nulls first, file_name, file_id) as pos, file_id from frame_files")
def natural_sort(spark, d):
    own = table(spark, d, "frame_files").select("dirpath", "file_name", "file_id", _file_number().alias("number"))
    numbered = _numbered(own, F.col("number").asc_nulls_first(), "file_name", "file_id", within=("dirpath",))
    return numbered.select("dirpath", "file_name", "file_id", (F.col("rn") + 1).alias("pos"))


@query("sorted_titles", "select title, row_number() over (order by title) - 1 as pos from (select distinct title from videopath where title is not null)")
def sorted_titles(spark, d):
    return _numbered(table(spark, d, "videopath").select("title").where("title is not null").distinct(), "title").select("title", F.col("rn").alias("pos"))


@query("seeded_shuffle")
def seeded_shuffle(spark, d):
    return table(spark, d, "tfrecords").select("rec_id").orderBy(F.xxhash64("rec_id", F.lit(17)))


@query("chunk_ids", "select rec_id, (row_number() over (order by rec_id) - 1) // 1000 as chunk from tfrecords")
def chunk_ids(spark, d):
    return _numbered(table(spark, d, "tfrecords").select("rec_id"), "rec_id").select("rec_id", F.expr("rn div 1000").alias("chunk"))


@query("union_all_tagged", "select 'visual' as tag, event_id from events where event_type = 'view' union all select 'audio', event_id from events where event_type = 'purchase'")
def union_all_tagged(spark, d):
    own = table(spark, d, "events")
    return own.where("event_type = 'view'").select(F.lit("visual").alias("tag"), "event_id").unionByName(own.where("event_type = 'purchase'").select(F.lit("audio").alias("tag"), "event_id"))


@query("union_distinct", "select l_suppkey as id from lineitem where l_discount > 0.08 union select l_suppkey from lineitem where l_tax > 0.07")
def union_distinct(spark, d):
    own = table(spark, d, "lineitem")
    return own.where("l_discount > 0.08").select(F.col("l_suppkey").alias("id")).union(own.where("l_tax > 0.07").select("l_suppkey")).distinct()


@query("except_ids", "select c_custkey from customer except select o_custkey from orders")
def except_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select("o_custkey")).distinct()


@query("distinct_ids", "select distinct spotify_track_id from msdspotifymatch where spotify_track_id is not null")
def distinct_ids(spark, d):
    return table(spark, d, "msdspotifymatch").where("spotify_track_id is not null").select("spotify_track_id").distinct()


@query("dedup_first", "select file_name, min(file_id) as file_id from frame_files group by 1")
def dedup_first(spark, d):
    return table(spark, d, "frame_files").groupBy("file_name").agg(F.min("file_id").alias("file_id"))


@query("rebalance_buckets", "select track_id, (row_number() over (order by track_id) - 1) // 100 as bucket from songs")
def rebalance_buckets(spark, d):
    return _numbered(table(spark, d, "songs").select("track_id"), "track_id").select("track_id", F.expr("rn div 100").alias("bucket"))


@query("repeat_rows", "select bc, k from concepts, range(4) t(k)")
def repeat_rows(spark, d):
    return table(spark, d, "concepts").select("bc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))
