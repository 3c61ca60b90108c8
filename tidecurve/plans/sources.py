"""Queries over the file formats: each writes a table in the format to the shared folder and reads it back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecurve.plans.base import query
from tidecurve.plans.curves import SIGNAL, signal
from tidecurve.shared import cut, fresh_dir
from tidecurve.sources import files, tfrecord
from tidecurve.sources.tables import table


def _text(df: DataFrame, path: str) -> str:
    """One text file, lines in order of the column ``k``."""
    df.repartitionByRange(1, "k").sortWithinPartitions("k").select("line").write.text(path)
    return path


def _curve_files(spark: SparkSession, d: str) -> str:
    """Curves of two kinds of header: odd series without confidence, even ones with it."""
    root = fresh_dir(spark, "curve-files")
    own = signal(spark, d)
    files.write_predictions(own.where("series_id % 2 = 1").select("series_id", "i", F.col("value").alias("Valence")), f"{root}/plain", "series_id", "i", ["Valence"])
    even = own.where("series_id % 2 = 0").select("series_id", "i", F.col("value").alias("Valence_mean"), F.lit(0.0).alias("Valence_std"))
    files.write_predictions(even, f"{root}/conf", "series_id", "i", ["Valence_mean", "Valence_std"])
    return root


@query("csv_curves", f"select series_id, i, value from {SIGNAL} q")
def csv_curves(spark, d):
    own = files.curves(spark, _curve_files(spark, d), r"series_id=(\d+)/", ("Valence", "Valence_mean"))
    return own.select(F.col("series").cast("bigint").alias("series_id"), "i", "value")


@query("csv_headerless", "select p_partkey as k, p_retailprice as price from part")
def csv_headerless(spark, d):
    path = fresh_dir(spark, "headerless")
    table(spark, d, "part").select("p_partkey", "p_retailprice").write.csv(path)
    return files.headerless(spark, path, "k bigint, price double")


@query("dir_listing", "select user_id % 2 = 0 as confident, count(distinct user_id) as files from events group by 1")
def dir_listing(spark, d):
    own = files.listing(spark, _curve_files(spark, d), "*.csv")
    return own.groupBy(F.col("dirpath").contains("/conf/").alias("confident")).agg(F.count_if(F.col("n_bytes") > 0).alias("files"))


@query("dir_valid_videos", "select 'v' || c_custkey as video, c_nationkey::bigint as nframes from customer where c_nationkey between 1 and 3 and c_custkey % 2 = 0")
def dir_valid_videos(spark, d):
    """A listing as a directory walk gives it: frames of every video, predictions of every second one."""
    videos = table(spark, d, "customer").where("c_nationkey <= 3").select(F.concat(F.lit("v"), "c_custkey").alias("v"), "c_custkey", F.col("c_nationkey").cast("int").alias("n"))
    frames = videos.where("n > 0").select(F.concat("v", F.lit("/frames")).alias("dirpath"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k.cast("string"))).alias("file_name"))
    preds = videos.where("c_custkey % 2 = 0").select(F.concat("v", F.lit("/preds")).alias("dirpath"), F.explode(F.array(F.lit("visual.csv"), F.lit("audio.csv"))).alias("file_name"))
    return files.valid_videos(frames.unionByName(preds).withColumn("n_bytes", F.lit(9)), ("visual.csv", "audio.csv"))


def _database(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = fresh_dir(spark, "sqlite") + ".db"
    cut(df.limit(0), "sqlite-folder")  # the application's folder is there
    files.write_sqlite(df, path, name)
    return path


@query("sqlite_filter", "select title, dirpath from videopath where category = 'films'")
def sqlite_filter(spark, d):
    path = _database(spark, table(spark, d, "videopath").select("category", "title", "dirpath"), "VideoPath")
    return files.sqlite_table(spark, path, "VideoPath", "title string, dirpath string", "category = 'films'")


@query("sqlite_not_null", "select msd_track_id, spotify_track_id from msdspotifymatch where spotify_track_id is not null and spotify_preview_url is not null")
def sqlite_not_null(spark, d):
    own = table(spark, d, "msdspotifymatch").select("msd_track_id", "spotify_track_id", "spotify_preview_url")
    return files.sqlite_table(spark, _database(spark, own, "MsdSpotifyMatch"), "MsdSpotifyMatch", "msd_track_id string, spotify_track_id string", "spotify_track_id is not null and spotify_preview_url is not null")


@query("sqlite_songs", "select track_id, title, artist_name, year, duration from songs union all select track_id, title, artist_name, year, duration from songs where year = 0")
def sqlite_songs(spark, d):
    """A full scan of a table written once and appended to once."""
    own = table(spark, d, "songs").select("track_id", "title", "artist_name", "year", "duration")
    path = _database(spark, own, "songs")
    files.write_sqlite(own.where("year = 0"), path, "songs", "append")
    return files.sqlite_table(spark, path, "songs", "track_id string, title string, artist_name string, year int, duration double")


@query("tsv_films", """select 'film ' || (o_orderkey % 500) as name, arg_max({'r': case when o_orderkey % 3 > 0 then floor(o_totalprice)::bigint end}, o_orderkey)['r'] as revenue,
    max(o_orderkey) as last, arg_max(o_orderstatus, o_orderkey) as genre from orders group by 1""")
def tsv_films(spark, d):
    own = table(spark, d, "orders")
    revenue = F.when(F.col("o_orderkey") % 3 > 0, F.floor("o_totalprice").cast("string")).otherwise("")
    genres = F.concat(F.lit('{"/m/1": "'), "o_orderstatus", F.lit('"}'))
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.lit("/m/0"), F.concat(F.lit("film "), F.col("o_orderkey") % 500), F.lit("2001"), revenue, F.lit(""), F.lit("{}"), F.lit("{}"), genres)
    path = _text(own.select(F.col("o_orderkey").alias("k"), line.alias("line")), fresh_dir(spark, "films"))
    return files.films(spark, path).select("name", "revenue", F.col("wiki_id").cast("bigint").alias("last"), F.element_at("genres", 1).alias("genre"))


@query("tsv_tropes", "select p_brand as movie, string_agg(p_type, '|' order by p_partkey) as tropes from part group by 1")
def tsv_tropes(spark, d):
    line = F.concat("p_type", F.lit("\t"), F.to_json(F.struct(F.col("p_brand").alias("movie"))))
    path = _text(table(spark, d, "part").select(F.col("p_partkey").alias("k"), line.alias("line")), fresh_dir(spark, "tropes"))
    return files.tropes(spark, path).select("movie", F.array_join("tropes", "|").alias("tropes"))


@query("tsv_summaries", "select (p_partkey % 700)::varchar as id, arg_max(p_name, p_partkey) as text from part group by 1")
def tsv_summaries(spark, d):
    line = F.concat_ws("\t", (F.col("p_partkey") % 700).cast("string"), "p_name")
    return files.summaries(spark, _text(table(spark, d, "part").select(F.col("p_partkey").alias("k"), line.alias("line")), fresh_dir(spark, "summaries")))


@query("json_infos", "select bc::varchar as id, concept as title, case when bc % 2 = 0 then '25' end as fps, null::varchar as uploader from concepts")
def json_infos(spark, d):
    """Descriptions in two files, each one JSON text over several lines."""
    path = fresh_dir(spark, "infos")
    info = F.struct(F.col("bc").cast("string").alias("id"), F.col("concept").alias("title"), F.when(F.col("bc") % 2 == 0, "25").alias("fps"), F.lit("x").alias("other"))
    own = table(spark, d, "concepts").groupBy((F.col("bc") % 2).alias("half")).agg(F.to_json(F.collect_list(info), {"pretty": "true"}).alias("line"))  # a fixed table
    own.write.partitionBy("half").text(path)
    return files.infos(spark, path).select("id", "title", "fps", "uploader")


@query("lexicon_concepts", "select concept as name, round(sentiment, 3) as sentiment, bc * 1000 as n from concepts")
def lexicon_concepts(spark, d):
    line = F.concat("concept", F.lit(" [sentiment: "), F.format_string("%.3f", F.round("sentiment", 3)), F.lit("] [#imgs: "), F.col("bc").cast("string"), F.lit(",000]"))
    path = _text(table(spark, d, "concepts").select(F.col("bc").alias("k"), F.explode(F.array(line, F.lit("no concept"))).alias("line")), fresh_dir(spark, "concepts"))
    return files.concept_lines(spark, path)


@query("lexicon_scores", "select concept, sentiment from concepts")
def lexicon_scores(spark, d):
    path = fresh_dir(spark, "scores")
    table(spark, d, "concepts").select("concept", "sentiment").write.csv(path)
    return files.headerless(spark, path, "concept string, sentiment double")


@query("lexicon_emotions", "select concept, case when bc % 3 = 1 then 'joy' when bc % 3 = 2 then 'joy,fear' else '' end as emotions from concepts")
def lexicon_emotions(spark, d):
    path = fresh_dir(spark, "emotions")
    own = table(spark, d, "concepts").select("concept", F.when(F.col("bc") % 3 > 0, 0.5).otherwise(0.0).alias("joy"), F.when(F.col("bc") % 3 == 2, 0.25).otherwise(0.0).alias("fear"))
    own.write.option("header", "true").csv(path)
    return files.wide_emotions(spark, path).select("concept", F.array_join(F.map_keys("emotions"), ",").alias("emotions"))


@query("lexicon_words", "select concept as word, 'anger,joy' as emotions from concepts where bc % 2 = 1 union all select concept, 'joy' from concepts where bc % 2 = 0")
def lexicon_words(spark, d):
    flags = F.array(F.lit("\tjoy\t1"), F.when(F.col("bc") % 2 == 1, "\tanger\t1").otherwise("\tanger\t0"))
    words = table(spark, d, "concepts").select((F.col("bc") + 1000).alias("k"), F.explode(F.transform(flags, lambda f: F.concat(F.col("concept"), f))).alias("line"))
    prose = spark.range(files.LEXICON_PROSE).select((F.col("id") - 1000).alias("k"), F.lit("prose\tanger\t1").alias("line"))
    path = _text(words.unionByName(prose), fresh_dir(spark, "words"))
    return files.emotion_words(spark, path).select("word", F.array_join("emotions", ",").alias("emotions"))


@query("csv_agreed", "select 'e' || (emo % 8) as emotion, rec_id::varchar as url from tfrecords where emo is not null and rec_id % 7 > rec_id % 5")
def csv_agreed(spark, d):
    path = fresh_dir(spark, "agreement")
    own = table(spark, d, "tfrecords").where("emo is not null").select(
        F.concat(F.lit("e"), F.col("emo") % 8).alias("emotion"), F.lit("x").alias("first"), F.col("rec_id").cast("string").alias("url"), F.expr("rec_id % 5").alias("disagree"), F.expr("rec_id % 7").alias("agree"))
    raw = fresh_dir(spark, "agreement-raw")
    own.repartition("emotion").write.partitionBy("emotion").csv(raw)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(path))
    for n, file in enumerate(fs.globStatus(fs_path(f"{raw}/emotion=*/*.csv")) or []):  # eight emotions
        emotion = file.getPath().getParent().getName().split("=")[1]
        fs.rename(file.getPath(), fs_path(f"{path}/{emotion}_{n}.csv"))
    return files.agreed(spark, path)


_EXAMPLE = "rec_id bigint, id string, h bigint, w bigint, img binary, sent_reg float, sent_biclass bigint"


def _example_files(spark: SparkSession, d: str) -> str:
    path = fresh_dir(spark, "tfrecord-files")
    own = table(spark, d, "tfrecords").select("rec_id", "id", "h", "w", "img", "sent_reg", "sent_biclass", F.coalesce("split", F.lit("none")).alias("shard"))
    cut(tfrecord.write(own, path, "shard", [c.split()[0] for c in _EXAMPLE.split(", ")]), "tfrecord-written")
    return path


@query("tfrecord_examples", "select rec_id, id, h, w, octet_length(img)::int as n_bytes, sent_reg, sent_biclass, coalesce(split, 'none') as shard from tfrecords")
def tfrecord_examples(spark, d):
    own = tfrecord.read(spark, _example_files(spark, d), _EXAMPLE)
    return own.select("rec_id", "id", "h", "w", F.octet_length("img").alias("n_bytes"), "sent_reg", "sent_biclass", F.regexp_extract("file", r"^(.*)-\d+\.tfrecord$", 1).alias("shard"))


@query("tfrecord_counts", "select coalesce(split, 'none') as shard, count(*) as n from tfrecords group by 1")
def tfrecord_counts(spark, d):
    own = tfrecord.read(spark, _example_files(spark, d), "rec_id bigint")
    return own.groupBy(F.regexp_extract("file", r"^(.*)-\d+\.tfrecord$", 1).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("csv_predictions", "select p_partkey as k, (p_partkey % 4)::int as split, round(p_retailprice / 3000, 6) as pos from part")
def csv_predictions(spark, d):
    path = fresh_dir(spark, "predictions")
    own = table(spark, d, "part").select((F.col("p_partkey") % 4).cast("int").alias("split"), F.col("p_partkey").alias("k"), F.round(F.col("p_retailprice") / 3000, 6).alias("pos"))
    files.write_predictions(own, path, "split", "k", ["k", "pos"])
    return spark.read.option("header", "true").schema("k bigint, pos double, split int").csv(path)
