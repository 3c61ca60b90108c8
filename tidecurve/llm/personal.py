"""Problem 8: personal information in free text, found and replaced by typed placeholders.

The recogniser is the skip-chain conditional random field of ``pii_model``.
Words are counted over all texts; the field is trained on a sample of at most
``SAMPLE`` texts, whose labels come from general evidence, and then applied to
every text, whole.  The model is a few megabytes whatever the corpus' size.

Defined results: null, empty and blank texts hold nothing; positions are
0-based code points of the stored text; a repeated text gives its occurrences
again for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidecurve.llm import pii_lexer, pii_model

#: Bound of the labelled sample.
SAMPLE = 3000
#: Characters of text predicted together.
TOGETHER = 400_000


#: A word as ``pii_lexer`` cuts it, and one with a capital inside a sentence.
_WORD, _INNER = r"\p{L}+(?:['\-]\p{L}+)*", r"(?<=\p{L} )\p{Lu}(?=\p{Ll})\p{L}*(?:['\-]\p{L}+)*"


def words(texts: DataFrame, column: str) -> pii_model.Vocabulary:
    """The vocabulary by counts over all texts: only words in a share of the documents, or capital ones, come back."""
    own = F.regexp_extract_all(F.translate(column, "’", "'"), F.lit(_WORD), F.lit(0))
    inner = F.regexp_extract_all(F.translate(column, "’", "'"), F.lit(_INNER), F.lit(0))
    cased = F.transform(own, lambda w: F.struct(F.lower(w).alias("w"), F.when(w == F.lower(w), 1).when((w == F.upper(w)) & (F.length(w) > 1), 3).otherwise(2).alias("k")))
    marked = F.concat(
        F.transform(F.array_distinct(F.transform(own, F.lower)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("k"))), cased,
        F.transform(inner, lambda w: F.struct(F.lower(w).alias("w"), F.lit(4).alias("k"))))
    rows = texts.where(F.length(F.trim(column)) > 0)
    documents = rows.count()
    counted = rows.select(F.explode(marked).alias("m")).groupBy("m.w").agg(*[F.count_if(F.col("m.k") == k).alias(f"c{k}") for k in range(5)])
    least = max(pii_model.LEAST_DOCS, pii_model.LEAST_SHARE * documents)
    # at most (words of a text) / LEAST_SHARE words, whatever the number of texts
    kept = counted.where((F.col("c0") >= least) | ((F.col("c4") >= 2) & (F.col("c0") >= least / 4))).collect()
    return pii_model.vocabulary_of({r["w"]: tuple(r[f"c{k}"] for k in range(5)) for r in kept}, documents)


def fit(texts: DataFrame, key: str, column: str, sample: int = SAMPLE) -> pii_model.Model:
    """Count words over all texts and train on the ``sample`` texts whose keys hash lowest."""
    picked = texts.where(F.length(F.trim(column)) > 0).orderBy(F.xxhash64(key), key).limit(sample).select(column).collect()
    return pii_model.train([r[0] for r in picked], words(texts, column))


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for key, text in zip(batch["key"], batch["text"]):
        keys.append(key)
        texts.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _recognise(model: pii_model.Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    tokens = [pii_lexer.cut(t)[1] for t in texts]
    labels = pii_model.predict(model, tokens)
    return [pii_model.entities(model, t, y) for t, y in zip(tokens, labels)]


def occurrences(df: DataFrame, key: str, column: str, model: pii_model.Model | None = None) -> DataFrame:
    """``(key, kind, start_pos, end_pos)``, one row per occurrence."""
    shipped = df.sparkSession.sparkContext.broadcast(model or fit(df, key, column))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, texts in _chunks(batch):
                rows = [(k, kind, s, e) for k, found in zip(keys, _recognise(shipped.value, texts)) for s, e, kind in found]
                yield pd.DataFrame(rows, columns=["key", "kind", "start_pos", "end_pos"])

    rows = df.where(F.length(column) > 0).select(F.col(key).alias("key"), F.col(column).alias("text"))
    shape = f"key {rows.schema['key'].dataType.simpleString()}, kind string, start_pos bigint, end_pos bigint"
    return rows.mapInPandas(run, shape).withColumnRenamed("key", key)


def redacted(df: DataFrame, key: str, column: str, model: pii_model.Model | None = None) -> DataFrame:
    """``(key, text, replaced)``: every row's text with placeholders such as ``[PHONE]``, the rest unchanged."""
    shipped = df.sparkSession.sparkContext.broadcast(model or fit(df, key, column))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, texts in _chunks(batch):
                out = []
                for k, text, found in zip(keys, texts, _recognise(shipped.value, texts)):
                    parts, at = [], 0
                    for start, end, kind in found:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                        at = end
                    out.append((k, "".join(parts) + text[at:], len(found)))
                yield pd.DataFrame(out, columns=["key", "text", "replaced"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    done = rows.where("text is not null").mapInPandas(run, f"key {kind}, text string, replaced int")
    nulls = rows.where("text is null").select("key", "text", F.lit(0).alias("replaced"))
    return done.unionByName(nulls).withColumnRenamed("key", key)
