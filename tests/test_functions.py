
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecurve.functions import labels as L, text as X
from tidecurve.operators import pictures as I


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Mr. Smith went. He left! Why?", ["Mr. Smith went.", "He left!", "Why?"]),
        ("See example.com now. No end", ["See example.com now."]),
        ("A Ph.D. student came. It rained.", ["A Ph.D. student came.", "It rained."]),
        ('He said "stop." Then he ran.', ['He said "stop".', "Then he ran."]),
        ("nothing", []),
        ("", []),
        ("Made in the U.S. They sold it. Seen in the U.S. today.", ["Made in the U.S.", "They sold it.", "Seen in the U.S. today."]),
        ("By J. R. Poe of Acme Inc. He left. By Poe Ltd. today.", ["By J. R. Poe of Acme Inc", "He left.", "By Poe Ltd. today."]),
        ('"Who?!" Dr. No\nran "off!"', ['"Who"?', "!", 'Dr. No ran "off"!']),
        ("Wait... no", ["Wait.", ".", "."]),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, X.sentences(F.col("t")), t=text) == expected


def test_clocks(spark):
    assert one(spark, X.hms(F.col("s")), s=181) == "0h03m01s"
    assert one(spark, X.hms(F.col("s")), s=3876) == "1h04m36s"
    assert one(spark, X.clock(F.col("s")), s=3876) == "01:04:36"


def test_label_edges(spark):
    assert [one(spark, L.biclass(F.col("v")), v=v) for v in (-0.1, 0.0)] == [0, 1]
    assert [one(spark, L.triclass(F.col("v")), v=v) for v in (-0.6, -0.5, 0.5, 0.6)] == [0, 1, 1, 2]
    assert [one(spark, L.valence_class(F.col("v")), v=v) for v in (0.2, 0.25)] == [0, 1]
    assert [one(spark, L.bin_label(F.col("v")), v=float(v)) for v in (-1, 0, 5, 10)] == [-1, 0, 1, None]


@pytest.mark.parametrize("n,expected", [(1, (0, 0, 1)), (9, (7, 0, 2)), (10, (8, 1, 1)), (11, (8, 1, 2)), (25, (20, 2, 3))])
def test_split_counts(spark, n, expected):
    parts = [r["p"] for r in spark.range(n).select(L.split_positional(F.col("id"), F.lit(n)).alias("p")).collect()]
    assert tuple(parts.count(p) for p in ("train", "valid", "test")) == expected


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 35), ("b", 1), ("c", 5), ("d", 0)], "label string, n int")
    got = {r["label"]: r["weight"] for r in L.class_weights(df).collect()}
    assert np.allclose([got[k] for k in "abcd"], [1 / 43, 35 / 43, 7 / 43, 0])


def test_fuzzy_ratio(spark):
    assert X.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert X.indel_ratio("", "") == 100
    assert one(spark, X.ratio(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(100 * (1 - 3 / 7), abs=1e-4)


def test_scrambles_keep_pixels():
    a = np.arange(16 * 12 * 3, dtype=np.uint8).reshape(16, 12, 3)
    for f in (I.scramble_blocks, I.scramble_recursive):
        out = f(a, 3, np.random.default_rng(1))
        assert out.shape == a.shape and sorted(out.ravel()) == sorted(a.ravel())


def test_melgram_shape():
    assert I.log_melgram(np.zeros(30 * I.RATE)).shape == (96, 1407)
    assert I.log_melgram(np.zeros(20 * I.RATE)).shape == (96, 938)


def test_sentences_of_every_script(spark, tmp_path):
    from tidecurve.plans.functions import sentence_split

    texts = {
        1: "Der Bär schläft. Die Käfer nicht!", 2: "¿Dónde está? Aquí. Sí", 3: "Où va-t-il? À l'été.", 4: "Он ушёл. Она осталась!",
        5: "彼は行った. 雨だ!", 6: "Plain text. Mr. Smith left.", 7: "kein Ende ä", 8: None, 9: "naïve \U0001f600. Ende.",
    }
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))

    split = {
        1: ["Der Bär schläft.", "Die Käfer nicht!"], 2: ["¿Dónde está?", "Aquí."], 3: ["Où va-t-il?", "À l'été."], 4: ["Он ушёл.", "Она осталась!"],
        5: ["彼は行った.", "雨だ!"], 6: ["Plain text.", "Mr. Smith left."], 9: ["naïve \U0001f600.", "Ende."],
    }
    expected = {k: (sum(map(len, s)), len(s), s[0], s[-1]) for k, s in split.items()}
    got = {r["doc_id"]: (r["chars"], r["n"], r["first_sentence"], r["last_sentence"]) for r in sentence_split(spark, str(tmp_path)).collect()}
    assert got == expected


def test_melgram_hears_the_whole_curve(spark, tmp_path):
    from tidecurve.plans.functions import melgram

    points = 2048 + 256 * 4
    rows = spark.range(points + 30).selectExpr("id as event_id", f"if(id < {points}, 1L, 2L) as user_id", "timestamp_seconds(id) as ts", "if(id < 2048, 0d, sin(id))  as value", "'view' as event_type")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["series_id"]: r for r in melgram(spark, str(tmp_path)).collect()}
    assert {k: r["frames"] for k, r in got.items()} == {1: 1 + points // 256, 2: 9}
    assert got[1]["level"] > -100  # silence up to point 2048, sound after it


def test_augmented_crops():
    a = np.arange(10 * 6 * 3, dtype=np.uint8).reshape(10, 6, 3)
    seen = {I.augment(a, 8, 4, np.random.default_rng(k)).tobytes() for k in range(60)}
    views = {v[y : y + 8, x : x + 4][:, ::f].tobytes() for v in (a,) for y in range(3) for x in range(3) for f in (1, -1)}
    assert seen <= views and len(seen) > 10
    padded = I.augment(a, 12, 6, np.random.default_rng(0), flip=False)
    assert padded.shape == (12, 6, 3) and not padded[[0, -1]].any() and (padded[1:-1] == a).all()


def test_jpeg_headers():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x10"
    assert I.jpeg_channels(head + b"\x03" + bytes(9)) == 3 and I.jpeg_channels(head + b"\x01" + bytes(9)) == 1
    assert I.jpeg_channels(b"PNG") is None and I.jpeg_channels(b"") is None and I.jpeg_channels(b"\xff\xd8") is None


def test_settings():
    from tidecurve.functions import settings

    defaults = {"dan": {"emo": {"lr": 0.1, "epochs": None}}, "vgg": {"emo": {"lr": 0.2, "epochs": 20}}, "batch": 16}
    assert settings.merged({"lr": None, "epochs": None, "batch": None, "x": None}, defaults, "dan", "emo") == {"lr": 0.1, "epochs": 20, "batch": 16, "x": None}
    assert settings.merged({"lr": 3}, defaults, "dan", "emo") == {"lr": 3} and settings.inverted_ids("0,1,3") == "3,2,0"
