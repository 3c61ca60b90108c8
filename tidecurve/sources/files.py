"""Readers and writers of the file formats around the curves: CSV, TSV with JSON, JSON, lexicons, listings, SQLite.

Readers give DataFrames and read in parallel; where the order of lines counts,
a line's place is ``(file, start of its split, line)``.  Paths may be folders
or globs.  Empty inputs give empty results.
"""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The keys of a short film's description file.
INFO_KEYS = (
    "comment_count", "description", "display_id", "duration", "fps", "fulltitle", "id", "like_count", "subtitles", "title", "uploader", "uploader_id",
    "uploader_url", "upload_date", "view_count",
)
#: Columns of the film metadata, prose lines before the emotion lexicon.
FILM_COLUMNS = ("wiki_id", "freebase_id", "name", "date", "revenue", "runtime", "languages", "countries", "genres")
LEXICON_PROSE = 46


def curves(spark: SparkSession, path: str, series: str, columns: tuple[str, ...]) -> DataFrame:
    """``(series, i, value)`` of curve files with a header, one curve a file.

    ``series`` is a pattern whose first group cuts the series out of the path;
    of ``columns`` the first that a file has is read, so files with and
    without confidence may lie together.  A file with none of them is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", series, 1).alias("series"), "path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, file, content in zip(batch["series"], batch["path"], batch["content"]):
                if not content:
                    continue
                own = pd.read_csv(io.BytesIO(content))
                column = next((c for c in columns if c in own.columns), None)
                if column is None:
                    raise ValueError(f"{file} has none of {', '.join(columns)}")
                yield pd.DataFrame({"series": name, "i": range(len(own)), "value": own[column].astype(float)})

    return files.mapInPandas(parse, "series string, i bigint, value double")


def headerless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files without header, columns named and typed by ``schema``."""
    return spark.read.schema(schema).option("header", "false").csv(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(dirpath, file_name, n_bytes, modified_at)`` of all files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dirpath"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"))


def valid_videos(files: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """``(video, nframes)`` of the videos that have frames and all the ``needed`` prediction files, over a listing."""
    video = F.regexp_replace("dirpath", r"/(frames|preds)$", "")
    frame = F.col("dirpath").endswith("/frames") & (F.col("n_bytes") > 0)
    has = [F.bool_or(F.col("dirpath").endswith("/preds") & (F.col("file_name") == n)) for n in needed]
    found = files.groupBy(video.alias("video")).agg(F.count_if(frame).alias("nframes"), *[h.alias(f"_h{k}") for k, h in enumerate(has)])
    kept = F.col("nframes") > 0
    for k in range(len(needed)):
        kept = kept & F.col(f"_h{k}")
    return found.where(kept).select("video", "nframes")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, place)`` of text lines; ``place`` orders the lines of all files as they stand."""
    own = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return own.select("value", F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("line")).alias("place"))


def _cell(k: int) -> Column:
    return F.get(F.split("value", "\t", -1), F.lit(k))


def films(spark: SparkSession, path: str) -> DataFrame:
    """Film metadata, nine tab-separated columns; empty numbers are null; of equal names the last line stands.

    ``languages``, ``countries`` and ``genres`` are arrays of the JSON objects' values.
    """
    cells = lines(spark, path).select("place", *[_cell(k).alias(c) for k, c in enumerate(FILM_COLUMNS)])
    kinds = {"revenue": "bigint", "runtime": "double"}
    typed = [F.nullif(F.col(c), F.lit("")).try_cast(kinds[c]).alias(c) if c in kinds else F.map_values(F.from_json(c, "map<string,string>")).alias(c) if c in FILM_COLUMNS[6:] else F.col(c) for c in FILM_COLUMNS]
    whole = cells.select("place", F.struct(*typed).alias("film"))
    return whole.groupBy("film.name").agg(F.max_by("film", "place").alias("film")).select("film.*")


def tropes(spark: SparkSession, path: str) -> DataFrame:
    """``(movie, tropes)``: the keys, in line order, of each movie's lines ``key TAB {"movie": ...}``."""
    own = lines(spark, path).select("place", _cell(0).alias("trope"), F.get_json_object(_cell(1), "$.movie").alias("movie")).where("movie is not null")
    ordered = F.array_sort(F.collect_list(F.struct("place", "trope")))
    return own.groupBy("movie").agg(F.transform(ordered, lambda t: t["trope"]).alias("tropes"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of lines ``id TAB text``; of equal ids the last stands."""
    own = lines(spark, path).select("place", _cell(0).alias("id"), F.substring_index("value", "\t", -1).alias("text"))
    return own.groupBy("id").agg(F.max_by("text", "place").alias("text"))


def infos(spark: SparkSession, path: str) -> DataFrame:
    """Description files: the fixed keys as text, null where a file lacks one."""
    return spark.read.schema(", ".join(f"{k} string" for k in INFO_KEYS)).option("multiLine", "true").json(path)


def concept_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(name, sentiment, n)`` of lines ``name [sentiment: x] [#imgs: n]``; other lines are left out."""
    part = lambda p, k: F.regexp_extract("value", p, k)
    shape = r"^(\w+) \[sentiment: (-?[\d.]+)\] \[#imgs: ([\d,]+)\]"
    own = spark.read.text(path).where(F.col("value").rlike(shape))
    return own.select(part(shape, 1).alias("name"), part(shape, 2).cast("double").alias("sentiment"), F.replace(part(shape, 3), F.lit(","), F.lit("")).cast("bigint").alias("n"))


def wide_emotions(spark: SparkSession, path: str) -> DataFrame:
    """``(concept, emotions)``: a table with one column an emotion as maps of the scores above zero."""
    wide = spark.read.option("header", "true").csv(path)
    names = [c for c in wide.columns if c != "concept"]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").cast("double").alias("v")) for n in names])
    return wide.select("concept", F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0)).alias("emotions"))


def emotion_words(spark: SparkSession, path: str, prose: int = LEXICON_PROSE) -> DataFrame:
    """``(word, emotions)`` of lines ``word TAB emotion TAB flag`` behind ``prose`` lines; emotions flagged 1, sorted."""
    numbered = lines(spark, path).orderBy("place").limit(prose).select("place")
    own = lines(spark, path).join(numbered, "place", "left_anti").where(_cell(2) == "1")
    return own.groupBy(_cell(0).alias("word")).agg(F.array_sort(F.collect_set(_cell(1))).alias("emotions"))


def agreed(spark: SparkSession, path: str) -> DataFrame:
    """``(emotion, url)`` that more judges agree with than not; the emotion is the file name up to ``_``."""
    own = spark.read.schema("first string, url string, disagree int, agree int").csv(path)
    emotion = F.regexp_extract("_metadata.file_name", r"^([^_]*)_", 1)
    return own.select(emotion.alias("emotion"), "url", "disagree", "agree").where("agree > disagree").select("emotion", "url")


def _local(path: str) -> str:
    """A ``file:`` path as the operating system has it; the folder must be one that all machines mount."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is no mounted folder")
    return path.removeprefix("file://")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, where: str = "1 = 1", parts: int = 8) -> DataFrame:
    """Rows of one table of an SQLite file; ``where`` is evaluated by SQLite, ranges of row ids are read in parallel."""
    file = _local(path)
    columns = [c.split()[0] for c in schema.split(", ")]
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"').fetchone()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
            for batch in batches:
                for a, b in zip(batch["a"], batch["b"]):
                    chunks = pd.read_sql_query(f'select {", ".join(columns)} from "{name}" where rowid between ? and ? and ({where})', db, params=(int(a), int(b)), chunksize=10_000)
                    for own in chunks:
                        yield own.astype(object).where(own.notna(), None)

    step = max(1, -(-(high - low + 1) // parts))
    ranges = [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]
    return spark.createDataFrame(ranges, "a bigint, b bigint").repartition(max(1, len(ranges))).mapInPandas(scan, schema)


def write_sqlite(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Write a table of an SQLite file; rows stream through the driver, SQLite having one writer.  Modes: overwrite, append."""
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "float": "REAL"}
    columns = ", ".join(f'"{c}" {kinds.get(t, "TEXT")}' for c, t in df.dtypes)
    with sqlite3.connect(_local(path)) as db:
        if mode == "overwrite":
            db.execute(f'drop table if exists "{name}"')
        db.execute(f'create table if not exists "{name}" ({columns})')
        marks = ", ".join("?" * len(df.columns))
        db.executemany(f'insert into "{name}" values ({marks})', (tuple(r) for r in df.toLocalIterator()))


def write_predictions(df: DataFrame, path: str, by: str, order: str, columns: list[str]) -> None:
    """One CSV with header a value of ``by``, rows in ``order``: below ``path/<by>=<value>``."""
    placed = df.repartition(F.col(by)).sortWithinPartitions(by, order)
    placed.select(by, *columns).write.mode("overwrite").partitionBy(by).option("header", "true").csv(path)
