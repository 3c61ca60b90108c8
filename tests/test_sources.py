"""Readers and writers of files: what the queries over written tables do not reach."""

import sqlite3

import pytest

from tidecurve.functions import labels as L
from tidecurve.operators import distances as D
from tidecurve.sources import files, tfrecord as R


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_curves_of_both_headers(spark, tmp_path):
    put(tmp_path / "a" / "x.csv", "Valence\n1\n2.5\n")
    put(tmp_path / "b" / "x.csv", "Valence_mean,Valence_std\n3,0\n")
    put(tmp_path / "c" / "x.csv", "")
    got = sorted((r["series"], r["i"], r["value"]) for r in files.curves(spark, str(tmp_path), r"/([^/]+)/x\.csv", ("Valence", "Valence_mean")).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 2.5), ("b", 0, 3.0)]
    put(tmp_path / "d" / "x.csv", "pos,neg\n1,2\n")
    with pytest.raises(Exception, match="none of"):
        files.curves(spark, str(tmp_path), r"/([^/]+)/x\.csv", ("Valence",)).collect()


def test_listing_of_a_walked_folder(spark, tmp_path):
    for name in ("v1/frames/f1.jpg", "v1/frames/f2.jpg", "v1/preds/p.csv", "v2/frames/f1.jpg", "v3/preds/p.csv"):
        put(tmp_path / name, "x")
    put(tmp_path / "v4/frames/f1.jpg", "")
    put(tmp_path / "v4/preds/p.csv", "x")
    got = files.valid_videos(files.listing(spark, str(tmp_path)), ("p.csv",)).collect()
    assert [(r["video"].rsplit("/", 1)[1], r["nframes"]) for r in got] == [("v1", 2)]


def test_films_last_line_stands(spark, tmp_path):
    rows = ["1\tm\tOne\t2001\t5\t\t{}\t{}\t{\"/m\": \"Drama\", \"/n\": \"Noir\"}", "2\tm\tTwo\t\t\t90.5\t{}\t{}\t{}", "3\tm\tOne\t2002\t\tx\t{}\t{}\t{}"]
    got = {r["name"]: (r["wiki_id"], r["revenue"], r["runtime"], r["genres"]) for r in files.films(spark, put(tmp_path / "f.tsv", "\n".join(rows))).collect()}
    assert got == {"One": ("3", None, None, []), "Two": ("2", None, 90.5, [])}


def test_lines_that_are_no_concepts(spark, tmp_path):
    path = put(tmp_path / "c.txt", "warm_lamp [sentiment: -1.25] [#imgs: 1,200]\n\nnonsense\n")
    assert [tuple(r) for r in files.concept_lines(spark, path).collect()] == [("warm_lamp", -1.25, 1200)]


def test_sqlite_nulls_ranges_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "a.db")
    df = spark.createDataFrame([(k, None if k % 3 else f"t{k}", k / 2) for k in range(50)], "id bigint, title string, x double")
    files.write_sqlite(df, path, "t")
    got = files.sqlite_table(spark, path, "t", "id bigint, title string, x double", "id >= 10", parts=7)
    assert sorted(map(tuple, got.collect())) == sorted((k, None if k % 3 else f"t{k}", k / 2) for k in range(10, 50))
    files.write_sqlite(df.limit(0), path, "t")
    assert files.sqlite_table(spark, path, "t", "id bigint").count() == 0
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from t").fetchone() == (0,)


def test_checksum_of_a_known_text():
    crc = (int(R.checksums([b"123456789"])[0]) - R.MASK) % (1 << 32)
    assert ((crc >> 17) | (crc << 15)) & 0xFFFFFFFF == 0xE3069283  # the published check value
    assert len(R.checksums([])) == 0 and len(set(R.checksums([b"", b"a", b"ab"]).tolist())) == 3


def test_records_round_trip_and_broken_files():
    own = {"id": "ä_1", "h": -3, "img": bytes(range(256)) * 5, "sent_reg": 0.5, "none": None}
    records = [R.encode(own), R.encode({}), R.encode({"h": 1 << 40})]
    assert R.unframe(R.frame(records)) == records
    assert R.decode(records[0]) == {"id": ["ä_1".encode()], "h": [-3], "img": [own["img"]], "sent_reg": [0.5]}
    assert R.decode(records[2]) == {"h": [1 << 40]} and R.decode(records[1]) == {}
    broken = bytearray(R.frame(records))
    broken[20] ^= 1
    with pytest.raises(ValueError, match="checksums"):
        R.unframe(bytes(broken))
    with pytest.raises(ValueError, match="within a record"):
        R.unframe(R.frame(records)[:-3])
    assert R.unframe(b"") == []


def test_compatible_variants(spark):
    df = spark.createDataFrame([(0.5, 0.0, 2.0), (-0.6, 1.0, 1.0), (0.2, None, 5.0)], "s double, v double, w double")
    assert [r[0] for r in df.where(L.not_neutral(df.s)).select("s").collect()] == [-0.6]
    assert [r[0] for r in df.where(L.not_neutral(df.s, compat=True)).select("s").collect()] == [0.5, -0.6]
    assert df.where(L.present(df.v)).count() == 2 and df.where(L.present(df.v, compat=True)).count() == 1
    assert abs(df.agg(L.weighted_mean(df.v, df.w)).first()[0] - 1 / 3) < 1e-12
    assert L.running_mean_compat([(2.0, 1), (None, 1), (5.0, 2)]) == 2 + 3 * 2 / 4
    assert L.clip_starts(101, 20, 10) == [0, 10, 20, 30, 40, 50, 60, 70, 80]
    assert L.clip_starts(101, 20, 10, batch=2, compat=True)[:4] == [0, 20, 20, 40]


def test_unreachable_cell_is_an_error_on_request():
    import numpy as np

    a, b = np.zeros(3), np.zeros(5)
    assert D.dtw(a, b, 2) == float("inf")
    with pytest.raises(ValueError, match="does not reach"):
        D.dtw(a, b, 2, unreachable="raise")


def test_block_counts_grow_with_the_curves():
    assert D.block_count(0, 8) == 1 and D.block_count(3, 8) == 3 and D.block_count(1500, 8) == 6
    assert D.block_count(10_000_000, 4000) == -(-10_000_000 // D.BLOCK_ROWS)
