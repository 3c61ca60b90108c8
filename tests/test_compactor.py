"""The streaming compactor: spellings, retries, new files, sizes, hot records, empty stores."""

import datetime
import glob
import os

from tidecurve.plans import compaction
from tidecurve.streaming import compactor as K

T = datetime.datetime(2020, 1, 1)
FRAMES = "file_id bigint, dirpath string, file_name string, n_bytes bigint, checksum string, modified_at timestamp, listed_at timestamp"
EXAMPLES = "rec_id bigint, id string, img binary, split string, bc bigint, record string, size int, _file int"


def write(spark, tmp, frames, examples):
    spark.createDataFrame([(*f, None, T, T) for f in frames], FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp}/frame_files.parquet")
    spark.createDataFrame([(*e, None, "x", 1, 2) for e in examples], EXAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp}/tfrecords.parquet")


def run(spark, tmp, **sizes):
    return K.compact(spark, str(tmp), K.STORES, f"file://{tmp}/run", **sizes)


def surplus(own):
    return {(r["store"], r["rec_key"]) for r in K.dropped(own).collect()}


def held(own):
    return [sorted(r[c.store.key] for r in c.rows().collect()) for c in own]


def files(own):
    return [c.live().count() for c in own]


def test_records_across_spellings(spark, tmp_path):
    frames = [
        (1, "a/b/Film (1)", "frame_7_0h00m06s.jpg", 5), (2, "./a//b/Film (1)/frames/", "Copy_of_FRAME_0007_0H00M06S.JPG", 5), (3, "a/./b/film (1)/", "frame_7_0h00m06s (1).jpg.bak", 9),
        (4, "a/b/Film (1)", "frame_8_0h00m07s.jpg", 5), (5, "a/b/Film (1)", "frame_8_0h00m07s.jpg", 0), (6, "a/b/Film (1)", "thumb_7.jpg", 5), (7, None, "frame_7_0h00m06s.jpg", 5), (8, "a/b/c", None, 5),
    ]
    examples = [
        (1, "wild_coast/12_ab", b"xy", "train"), (2, " Wild_Coast-12_AB.jpg ", b"xy", "train"), (3, "wild_coast/12_ab", b"xy", "test"), (4, "wild_coast/12_ab", b"xz", "train"),
        (5, "dark_ticket/12_ab", b"xy", "train"), (6, "wild_coast/12_ab", None, "train"), (7, "wild_coast/12_ab", b"", "train"), (8, None, b"xy", "train"),
    ]
    write(spark, tmp_path, frames, examples)
    os.makedirs(f"{tmp_path}/frame_files.parquet.bak")  # a sibling is no source
    spark.createDataFrame([(99, "z", "frame_7_0h00m06s.jpg", 5, None, T, T)], FRAMES).write.mode("append").parquet(f"{tmp_path}/frame_files.parquet.bak")
    own = run(spark, tmp_path)
    assert surplus(own) == {("frame_files", 2), ("frame_files", 3), ("tfrecords", 2)}
    assert held(own) == [[1, 4], [1, 3, 4, 5]] and files(own) == [1, 1]
    assert own[1].rows().columns == spark.read.parquet(f"{tmp_path}/tfrecords.parquet").columns


def test_second_arrival_and_repeated_batch(spark, tmp_path):
    write(spark, tmp_path, [(2, "a/b", "frame_1_0h00m00s.jpg", 5), (5, "a/b", "frame_9_0h00m00s.jpg", 5)], [(2, "wild_coast/1_a", b"x", "train")])
    own = run(spark, tmp_path)
    assert held(own) == [[2, 5], [2]] and files(own) == [1, 1] and [c.version() for c in own] == [1, 1]
    own = run(spark, tmp_path)  # nothing new: nothing happens
    assert held(own) == [[2, 5], [2]] and [c.version() for c in own] == [1, 1]
    # copies arrive, one under a smaller key
    write(spark, tmp_path, [(1, "a/b", "frame_01_0h00m00s.jpg", 5)], [(3, "wild_coast-1_a", b"x", "train")])
    own = run(spark, tmp_path)
    assert held(own) == [[1, 5], [2]] and files(own) == [1, 1]
    assert surplus(own) == {("frame_files", 2), ("tfrecords", 3)}
    # the second batch is killed before its commit and runs again
    for name in ("frame_files", "tfrecords"):
        for f in (f"{tmp_path}/run/progress/{name}/commits/1", f"{tmp_path}/run/progress/{name}/commits/.1.crc"):
            os.remove(f)
        for f in glob.glob(f"{tmp_path}/run/compacted/{name}/batch=00000001/*"):
            os.remove(f)
    own = run(spark, tmp_path)
    assert held(own) == [[1, 5], [2]] and files(own) == [1, 1]
    assert own[0].manifest().count() == 3 and own[0]._written("seen", "path string").select("path").distinct().count() == own[0]._written("seen", "path string").count() == 2


def test_many_small_arrivals_stay_few_files(spark, tmp_path):
    for k in range(2):
        write(spark, tmp_path, [(10 * k + n, f"d{n % 3}", f"frame_{10 * k + n}_0h00m00s.jpg", 5) for n in range(10)], [(k, f"wild_coast/{k}_a", b"x", "train")])
        own = run(spark, tmp_path)
        assert files(own) == [1, 1] and held(own) == [list(range(10 * k + 10)), list(range(k + 1))]
    write(spark, tmp_path, [(100, "d0", "frame_100_0h00m00s.jpg", 5)], [(100, "wild_coast/100_a", b"x", "train")])
    write(spark, tmp_path, [(101, "d0", "frame_101_0h00m00s.jpg", 5)], [(101, "wild_coast/101_a", b"x", "train")])
    own = run(spark, tmp_path, batch_bytes=1)  # one file a batch
    assert files(own) == [1, 1] and len(held(own)[0]) == 22


def test_files_follow_the_target(spark, sf, tmp_path):
    own = K.Compactor(spark, f"{sf}/../sf0.01", K.EXAMPLES, f"file://{tmp_path}/run", target_bytes=150_000)
    own.start().awaitTermination()
    own.publish()
    sizes = [r["bytes"] for r in own.live().collect()]
    assert len(sizes) > 4 and max(sizes) <= 1.5 * 150_000 and min(sizes) >= 0.5 * 150_000


def test_hot_record_and_empty_store(spark, tmp_path):
    hot = [(k, "a/b", "frame_1_0h00m00s.jpg", 5) for k in range(300)] + [(1000 + k, "a/b", f"frame_{k + 2}_0h00m00s.jpg", 5) for k in range(600)]
    write(spark, tmp_path, hot, [])
    own = run(spark, tmp_path)
    assert surplus(own) == {("frame_files", k) for k in range(1, 300)} and files(own) == [1, 0] and held(own)[1] == []


def test_one_file_a_store_at_the_larger_scale(spark, sf):
    rows = {r["store"]: r for r in compaction.QUERIES["p2_compacted"](spark, f"{sf}/../sf0.1").collect()}
    assert all(r["files"] == 1 and r["rows"] == r["records"] < r["rows_with_record"] for r in rows.values()) and len(rows) == 2
