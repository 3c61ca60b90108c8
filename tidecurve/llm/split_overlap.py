"""Problem 1: evaluation records that the training split also holds, exactly or nearly.

The records here are pictures, so their canonical form takes the place of
case, punctuation and white space: margins, size, exposure, colour and
direction drop out (see ``picture_hash``).  Evaluation hashes are joined with training hashes;
what shares a bucket and is close by its 64-bit signature is compared cell by
cell on the canonical forms.

Equal pictures are one picture from the start: only distinct ones are hashed
and compared, and rows come back by membership at the end, so a picture that
fills a third of the table costs one comparison per partner.  A bucket of many
nearly equal pictures is split: its training side is dealt to salts of about
``HOT`` pictures each, and the evaluation side asks every salt.

Defined results: a row with null or empty bytes, bytes that do not fit
height x width x 3, or a single colour belongs to no case; a row with a null
split is neither evaluation nor training; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidecurve.llm import picture_hash as H
from tidecurve.shared import cut

#: Likeness of canonical forms from which two pictures are the same one.
SAME = 0.96
#: Signature bits of 64 that may differ.
APART = 24
CHUNK = 2048
#: Training pictures of one bucket that meet in one task.
HOT = 256


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK].reset_index(drop=True)
            rows, forms = [], []
            for (h, w), group in part.groupby(["h", "w"], sort=False):
                pixels = np.frombuffer(b"".join(group["img"]), np.uint8).reshape(len(group), int(h), int(w), 3)
                kept, own = H.canonical(pixels)
                rows.append(group.index.to_numpy()[kept])
                forms.append(H.pack_form(own))
            if rows:
                out = part.loc[np.concatenate(rows), ["key", "train", "picture"]].reset_index(drop=True)
                out["form"] = [f.tobytes() for f in np.concatenate(forms)]
                yield out


def _unpack(column: pd.Series) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 2, H.FINE, H.FINE)
    return H.unpack_form(flat)


def _hash_rows(ids: pd.Series, codes: np.ndarray, signatures: np.ndarray) -> pd.DataFrame:
    """Rows (bucket, signature, turn, id) of (n, turns, k) codes."""
    n, turns, k = codes.shape
    each = np.repeat(np.arange(n), turns * k)
    return pd.DataFrame({
        "bucket": codes.reshape(-1), "signature": np.repeat(signatures.reshape(-1), k),
        "turn": np.tile(np.repeat(np.arange(turns, dtype=np.int32), k), n), "id": ids.to_numpy()[each],
    })


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            forms = _unpack(part["form"])
            for variant in (0, 1):
                codes, _, signatures = H.hashes(forms[:, variant], H.TURNS // 2)
                yield _hash_rows(part["id"], codes[:, :, None], signatures)


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            forms = _unpack(part["form"])
            for variant in (0, 1):
                _, probes, signatures = H.hashes(forms[:, variant], H.TURNS)
                yield _hash_rows(part["id"], probes, signatures)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            a, b, turn = _unpack(part["form_a"]), _unpack(part["form_b"]), part["turn"].to_numpy()
            best = np.full(len(part), -1.0)
            for t in np.unique(turn):
                own = np.flatnonzero(turn == t)
                for x, y in ((0, 0), (0, 1), (1, 0)):
                    best[own] = np.maximum(best[own], H.likeness(H.turned(a[own, x], int(t)), b[own, y]))
            yield part.assign(likeness=best)[["picture_a", "picture_b", "likeness"]]


def overlaps(df: DataFrame, key: str, img: str, height: str, width: str, train: Column, evaluate: Column) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``.

    ``pairs(picture_a, picture_b, likeness)``: distinct evaluation pictures
    with the distinct training pictures that are the same; ``members(key,
    train, picture)``: the rows that hold each picture.
    """
    rows = df.select(
        F.col(key).alias("key"), train.alias("train"), F.col(img).alias("img"), F.col(height).alias("h"), F.col(width).alias("w"), evaluate.alias("evaluate")
    ).where((F.col("train") | F.col("evaluate")) & (F.octet_length("img") > 0) & (F.octet_length("img") == F.col("h") * F.col("w") * 3))
    named = rows.select("key", "train", F.unhex(F.md5(F.concat("img", F.concat_ws("x", "h", "w").cast("binary")))).alias("picture"), "h", "w", "img")
    kind = rows.schema["key"].dataType.simpleString()
    members = cut(named.mapInPandas(_forms, f"key {kind}, train boolean, picture binary, form binary"), "p1-forms")
    distinct = members.groupBy("picture", "train").agg(F.min("form").alias("form"))
    pictures = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "p1-pictures")  # written, so the numbers stay
    shape = "bucket bigint, signature bigint, turn int, id bigint"
    index = cut(pictures.where("train").mapInPandas(_index, shape), "p1-index")
    probes = pictures.where("not train").mapInPandas(_probe, shape)
    # how many salts a bucket is dealt to; only the few hot ones are listed
    hot = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    index = index.join(hot, "bucket", "left").select(
        "bucket", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("signature").alias("signature_b"), F.col("turn").alias("turn_b"), F.col("id").alias("id_b"))
    probes = probes.join(hot, "bucket", "left").select(
        "bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "signature", "turn", F.col("id").alias("id_a"))
    # both turned, they are close: so is the training picture to the other turned by the difference
    turn = (F.expr("turn div 4").cast("int") * 4 + F.pmod(F.col("turn") % 4 - F.col("turn_b"), F.lit(4))).alias("turn")
    near = (
        probes.join(index, ["bucket", "salt"])
        .where(F.bit_count(F.col("signature").bitwiseXOR(F.col("signature_b"))) <= APART)
        .select("id_a", "id_b", turn).distinct()
    )
    forms_a = pictures.where("not train").select(F.col("id").alias("id_a"), F.col("picture").alias("picture_a"), F.col("form").alias("form_a"))
    forms_b = pictures.where("train").select(F.col("id").alias("id_b"), F.col("picture").alias("picture_b"), F.col("form").alias("form_b"))
    compared = near.join(forms_a, "id_a").join(forms_b, "id_b").mapInPandas(_compare, "picture_a binary, picture_b binary, likeness double")
    same = compared.where(F.col("likeness") >= SAME).groupBy("picture_a", "picture_b").agg(F.max("likeness").alias("likeness"))
    return same, members.drop("form")


def overlap_rows(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(evaluation_key, training_key, likeness)``: every pair of rows."""
    ours = members.where("not train").select(F.col("picture").alias("picture_a"), F.col("key").alias("evaluation_key"))
    theirs = members.where("train").select(F.col("picture").alias("picture_b"), F.col("key").alias("training_key"))
    return pairs.join(ours, "picture_a").join(theirs, "picture_b").select("evaluation_key", "training_key", "likeness")


def overlap_counts(pairs: DataFrame, members: DataFrame, df: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Per split and source: rows, rows whose picture the training split holds, and pairs of rows.

    Pairs are counted by multiplying group sizes, without expanding them.
    """
    held = members.where("train").groupBy(F.col("picture").alias("picture_b")).agg(F.count(F.lit(1)).alias("n"))
    partners = pairs.join(held, "picture_b").groupBy(F.col("picture_a").alias("picture")).agg(F.sum("n").alias("partners"))
    ours = members.where("not train").select(F.col("key").alias(key), "picture").join(partners, "picture").select(key, "partners")
    return (
        df.select(key, *groups).join(ours, key, "left").groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("rows"), F.count("partners").alias("overlapping_rows"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))
    )
