"""Problem 2: a checkpointed streaming compactor for stores of tiny files.

A file stream discovers every source file once and remembers it in its
checkpoint.  Each micro-batch writes, below its own deterministic ``batch=<id>``
and in overwrite mode, so that a retry replaces instead of adding:

``seen``       the files of the batch with their bytes and rows;
``manifest``   one short row per stored record: a 16-byte digest of what
               identifies it, the row's key, its place in the order;
``compacted``  the rows themselves that hold a record no earlier batch holds
               under a smaller key, in files of about ``target_bytes``;
``index``      record and key of those rows;
``stale``      keys of earlier batches' rows that a smaller key now replaces.

``publish`` then makes the next version of the list of live files: files that
hold stale rows and files under half the target are merged below
``merge=<version>``, all others stay as they are.  A version counts once its
list is written, so readers never see half a merge.

The number of files follows from the bytes of the files read and the share of
their rows that stays.  Rows go to files by a hash of their key, in the one
shuffle that also drops the others, and lie in order within each file.

Defined results: rows without a record (empty files, files that are no frames,
records without picture) belong to no case and are not written; null parts of
a record count as empty text; an empty store gives no files.  Extra columns are
carried into the compacted files untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidecurve.shared import cut, fresh_dir

TARGET_BYTES = 128 << 20
BATCH_BYTES = 8 << 30
MANIFEST = "record binary, rec_key bigint, place string"


def video_directory(path: str | Column) -> Column:
    """One spelling per directory: separators, ``.`` steps, case and a final ``frames`` folder dropped."""
    p = F.lower(F.trim(F.col(path) if isinstance(path, str) else path))
    p = F.regexp_replace(p, r"\\", "/")
    p = F.regexp_replace(p, r"(^|/)(\./+)+", "$1")
    p = F.regexp_replace(p, r"/(\./|/)*", "/")
    return F.regexp_replace(p, r"(/frames)?(/\.?)?$", "")


def frame_ordinal(name: str | Column) -> Column:
    """The ordinal in ``frame_<ordinal>_<h>h<mm>m<ss>s``, whatever a tool put around it; null for no frame."""
    digits = F.regexp_extract(name, r"(?i)frame_0*(\d+)_\d+h\d+m\d+s", 1)
    return F.when(digits != "", digits)


def image_name(id_: str | Column) -> Column:
    """Concept and image name out of a record id, in lower case."""
    low = F.lower(id_)
    at = r"([a-z]+_[a-z]+)[^a-z0-9]+(\d+_[0-9a-f]+)"
    named = F.concat_ws("/", F.regexp_extract(low, at, 1), F.regexp_extract(low, at, 2))
    return F.when(named != "/", named).otherwise(F.trim(low))


def digest(*parts: Column) -> Column:
    """16 bytes that stand for the parts; nulls count as empty text."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


@dataclass(frozen=True)
class Store:
    """A source table: its row key, what makes a record of a row, where rows lie together."""

    name: str
    key: str
    record: Callable[[], Column]
    holds: Callable[[], Column]
    place: Callable[[], Column]


FRAMES = Store(
    "frame_files", "file_id",
    lambda: digest(video_directory("dirpath"), frame_ordinal("file_name")),
    lambda: F.coalesce(F.col("n_bytes") != 0, F.lit(True)) & frame_ordinal("file_name").isNotNull() & F.col("dirpath").isNotNull(),
    lambda: video_directory("dirpath"),
)
EXAMPLES = Store(
    "tfrecords", "rec_id",
    lambda: digest(F.col("split"), image_name("id"), F.md5("img")),
    lambda: F.coalesce(F.octet_length("img") > 0, F.lit(False)) & F.col("id").isNotNull(),
    lambda: F.concat_ws("/", F.coalesce("split", F.lit("")), F.lpad(F.coalesce(F.col("bc").cast("string"), F.lit("")), 20, "0")),
)
STORES = [FRAMES, EXAMPLES]


class Compactor:
    """One store's compaction below ``root``; opened again with the same root it goes on where it stopped."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: Store, root: str, target_bytes: int = TARGET_BYTES, batch_bytes: int = BATCH_BYTES):
        self.spark, self.store, self.root, self.target, self.batch_bytes = spark, store, root, target_bytes, batch_bytes
        self.source = f"{sf_dir}/{store.name}.parquet"
        self.schema = spark.read.parquet(self.source).schema

    def _at(self, what: str) -> str:
        return f"{self.root}/{what}/{self.store.name}"

    def _written(self, what: str, shape: str, where: str = "true") -> DataFrame:
        """What the batches have written; ``where`` is a condition on the column ``batch``."""
        path = self._at(what)
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], f"{shape}, batch int").where(where)
        return self.spark.read.schema(f"{shape}, batch int").parquet(path).where(where)

    def start(self):
        # the last letter in brackets makes a glob of exactly this path, which may be a file or a folder
        stream = (
            self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", str(self.batch_bytes)).parquet(f"{self.source[:-1]}[{self.source[-1]}]")
            .select(F.struct("*").alias("row"), "_metadata.file_path", "_metadata.file_size")  # nested, so that no column's name can clash
        )
        return stream.writeStream.foreachBatch(self._batch).trigger(availableNow=True).option("checkpointLocation", self._at("progress")).start()

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        store, own = self.store, f"batch={batch_id:08d}"
        batch.groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self._at('seen')}/{own}")
        source = batch.select("row.*")
        held = source.where(store.holds()).select(
            store.record().alias("record"), F.col(store.key).cast("bigint").alias("rec_key"), store.place().alias("place"))
        held.write.mode("overwrite").parquet(f"{self._at('manifest')}/{own}")

        manifest = self.spark.read.schema(MANIFEST).parquet(f"{self._at('manifest')}/{own}")
        first = manifest.groupBy("record").agg(F.min(F.struct("rec_key", "place")).alias("f")).select("record", "f.*")
        before = self._written("index", "record binary, rec_key bigint", f"batch < {batch_id}").groupBy("record").agg(F.min("rec_key").alias("held"))
        met = first.join(before, "record", "left") if batch_id else first.withColumn("held", F.lit(None).cast("bigint"))
        kept = cut(met.where("held is null or rec_key < held"), "p2-kept")
        kept.select("record", "rec_key").write.mode("overwrite").parquet(f"{self._at('index')}/{own}")
        kept.where("held is not null").select(F.col("held").alias("rec_key")).write.mode("overwrite").parquet(f"{self._at('stale')}/{own}")

        seen = self.spark.read.parquet(f"{self._at('seen')}/{own}").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()[0]
        rows = kept.count()
        if rows:
            self._write(source, kept, seen["bytes"] * rows / max(1, seen["rows"]), f"{self._at('compacted')}/{own}")

    def _write(self, rows: DataFrame, kept: DataFrame, expected: float, to: str) -> None:
        """The rows whose keys are in ``kept(rec_key, place)``, in as many files as ``expected`` bytes fill."""
        files = max(1, math.ceil(expected / self.target))
        nested = rows.select(F.col(self.store.key).cast("bigint").alias("rec_key"), F.struct("*").alias("row"))
        placed = nested.repartition(files, "rec_key").join(kept.select("rec_key", "place").repartition(files, "rec_key"), "rec_key")
        placed.sortWithinPartitions("place", "rec_key").select("row.*").write.mode("overwrite").parquet(to)

    # --- versions ---------------------------------------------------------------------------------------------------
    def version(self) -> int:
        """Number of the last published version; 0 where there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._at('live')}/*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)

    def live(self) -> DataFrame:
        """``(path, bytes, records, through)`` of the live files of the last version."""
        shape, version = "path string, bytes bigint, records bigint, through int", self.version()
        return self.spark.read.schema(shape).parquet(f"{self._at('live')}/version={version:08d}") if version else self.spark.createDataFrame([], shape)

    def _files(self, path: str) -> list[tuple[str, int, int]]:
        own = self.spark.read.schema(self.schema).parquet(path)
        listed = own.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("n")).collect()  # few by construction
        return [(r["file_path"], r["file_size"], r["n"]) for r in listed]

    def publish(self) -> None:
        live = [(r["path"], r["bytes"], r["records"], r["through"]) for r in self.live().collect()]  # one short row per target_bytes of data
        through = max((f[3] for f in live), default=-1)
        done = [r["batch"] for r in self._written("seen", "path string", f"batch > {through}").select("batch").distinct().collect()]
        if not done:
            return
        files = [f[:3] for f in live]
        for b in sorted(done):
            path = f"{self._at('compacted')}/batch={b:08d}"
            files += self._files(path) if _exists(self.spark, path) else []
        stale = self._written("stale", "rec_key bigint", f"batch > {through}").select("rec_key").distinct()
        touched = set()
        if through >= 0 or len(done) > 1:
            keyed = self._rows([f[0] for f in files]).select(F.col(self.store.key).alias("rec_key"), "_metadata.file_path") if files else None
            touched = {r[0] for r in keyed.join(stale, "rec_key", "left_semi").select("file_path").distinct().collect()} if files else set()
        small = [f for f in files if f[1] < self.target / 2 and f[0] not in touched]
        merged = [f for f in files if f[0] in touched] + (small if len(small) > 1 or touched else [])
        version = self.version() + 1
        if merged:
            rows = self._rows([f[0] for f in merged])
            keys = rows.select(F.col(self.store.key).cast("bigint").alias("rec_key"), self.store.place().alias("place"))
            to = f"{self._at('compacted')}/merge={version:08d}"
            self._write(rows, keys.join(stale, "rec_key", "left_anti"), sum(f[1] for f in merged), to)
            gone = {f[0] for f in merged}
            files = [f for f in files if f[0] not in gone] + self._files(to)
        rows = [(*f, max(done)) for f in files]
        self.spark.createDataFrame(rows, "path string, bytes bigint, records bigint, through int").coalesce(1).write.mode("overwrite").parquet(f"{self._at('live')}/version={version:08d}")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        """The compacted store: every record once."""
        paths = [r["path"] for r in self.live().collect()]
        return self._rows(paths) if paths else self.spark.createDataFrame([], self.schema)

    def manifest(self) -> DataFrame:
        return self._written("manifest", MANIFEST)


def compact(spark: SparkSession, sf_dir: str, stores: list[Store], root: str, target_bytes: int = TARGET_BYTES, batch_bytes: int = BATCH_BYTES) -> list[Compactor]:
    """Drain every store's file stream and publish; again with the same ``root`` it reads new files only."""
    own = [Compactor(spark, sf_dir, s, root, target_bytes, batch_bytes) for s in stores]
    for query in [c.start() for c in own]:
        query.awaitTermination()
    for c in own:
        c.publish()
    return own


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def dropped(compactors: list[Compactor]) -> DataFrame:
    """``(store, rec_key)`` of the rows that hold a record and are not in the compacted store."""
    out = None
    for c in compactors:
        kept = c.rows().select(F.col(c.store.key).cast("bigint").alias("rec_key"))
        own = c.manifest().select(F.lit(c.store.name).alias("store"), "rec_key").join(kept, "rec_key", "left_anti").select("store", "rec_key")
        out = own if out is None else out.unionByName(own)
    return out


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped(compact(spark, sf_dir, STORES, fresh_dir(spark, "p2")))


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores compacted; each row reports one store, as read back from its live files."""
    out = None
    for c in compact(spark, sf_dir, STORES, fresh_dir(spark, "p2")):
        held = c.manifest().agg(F.count(F.lit(1)).alias("rows_with_record"))
        own = c.rows().where(c.store.holds()).select(F.col("_metadata.file_path").alias("path"), c.store.record().alias("record")).agg(
            F.countDistinct("record").alias("records"), F.count(F.lit(1)).alias("rows"), F.countDistinct("path").alias("files"))
        own = held.join(own, F.lit(True)).select(F.lit(c.store.name).alias("store"), "rows_with_record", "records", "rows", "files")  # one row each
        out = own if out is None else out.unionByName(own)
    return out


def frames_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct frames found below each video directory beside what the directory walk counted.

    A directory walked twice counts once, with its largest ``num_frames``.
    """
    walked = (
        spark.read.parquet(f"{sf_dir}/videopath.parquet").where("dirpath is not null")
        .groupBy(video_directory("dirpath").alias("directory")).agg(F.max("num_frames").cast("bigint").alias("num_frames"))
    )
    listed = (
        spark.read.parquet(f"{sf_dir}/frame_files.parquet").where(FRAMES.holds())
        .select(video_directory("dirpath").alias("directory"), frame_ordinal("file_name").alias("ordinal")).distinct()
        .groupBy("directory").agg(F.count(F.lit(1)).alias("frames"))
    )
    return (
        walked.join(listed, "directory", "full_outer")
        .select("directory", F.coalesce("frames", F.lit(0)).alias("frames"), "num_frames",
                (F.coalesce("frames", F.lit(0)) - F.col("num_frames")).alias("surplus"))
    )
