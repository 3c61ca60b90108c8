"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecurve.llm import format_copies, linkage, packing, personal, sampling, split_overlap, tokens
from tidecurve.shared import cut
from tidecurve.sources.tables import table

SIGNATURE = ["bc", "sent_biclass"]
SONG_TEXT, SONG_EXACT = ["title", "artist_name"], ["year", "duration"]


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    held_out = F.col("split").isin("valid", "test")
    pairs, members = split_overlap.overlaps(table(spark, d, "tfrecords"), "rec_id", "img", "h", "w", F.col("split") == "train", held_out)
    return cut(pairs, "p1-pairs"), members


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = split_overlap.overlap_rows(*_overlaps(spark, d))
    return rows.select(
        F.least("evaluation_key", "training_key").alias("rec_id_a"), F.greatest("evaluation_key", "training_key").alias("rec_id_b")
    )


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "tfrecords").where(F.col("split").isin("valid", "test"))
    return split_overlap.overlap_counts(*_overlaps(spark, d), records, "rec_id", ["split", "source"])


def _sample_plan(spark: SparkSession, d: str) -> DataFrame:
    return sampling.plan_sample(table(spark, d, "tfrecords"), table(spark, d, "sample_targets"), SIGNATURE, "target_share", "min_rows", 0.2)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample_plan(spark, d).where("short").select(*SIGNATURE)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample_plan(spark, d)


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "tfrecords").select("rec_id", *SIGNATURE, "split", "source")
    return sampling.draw_sample(records, _sample_plan(spark, d), SIGNATURE, "rec_id")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(
        table(spark, d, "songs"), table(spark, d, "spotify_items"),
        key="track_id", title="title", artist="artist_name", length=F.col("duration"),
        other_key="spotify_track_id", other_title="name", other_artist="artists", other_length=F.col("duration_ms") / 1000,
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("track_id", "spotify_track_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = format_copies.copy_pairs(table(spark, d, "songs"), "track_id", SONG_TEXT, SONG_EXACT)
    return pairs.select(F.col("first_key").alias("track_id_a"), F.col("key").alias("track_id_b"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.collapsed(table(spark, d, "songs"), "track_id", SONG_TEXT, SONG_EXACT)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "p7-sizes")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.occurrences(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p4_found, p4_links, p3_found, p3_report, p3_sample, p5_found, p5_records, p6_ids, p7_containers, p7_report, p8_found, p8_redacted)}


def oracle_sql() -> dict[str, str]:
    need = "greatest(coalesce(t.min_rows, 0)::double, t.target_share * (select count(*) // 5 from tfrecords))"
    canon = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    title, artist = canon.format("title"), canon.format("artist_name")
    record = f"least({title}, {artist}) as k1, greatest({title}, {artist}) as k2, year as k3, duration as k4"
    songs = f"with s as (select track_id, title, artist_name, year, duration, {record} from songs where title is not null and artist_name is not null), g as (select *, min(track_id) over w as first_id, count(*) over w as copies from s window w as (partition by k1, k2, k3, k4))"
    return {
        "p3_found": f"""select t.bc, t.sent_biclass from sample_targets t
            left join (select bc, sent_biclass, count(*) as have from tfrecords group by all) c
            on t.bc = c.bc and t.sent_biclass = c.sent_biclass where coalesce(c.have, 0) < {need}""",
        "p5_found": f"{songs} select first_id as track_id_a, track_id as track_id_b from g where track_id <> first_id",
        "p5_records": f"{songs} select track_id, title, artist_name, year, duration, copies from g where track_id = first_id",
    }
