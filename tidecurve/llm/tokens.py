"""Problem 6: every text as its list of token ids by a public byte-level BPE vocabulary.

The corpus' words are counted in the JVM; the frequent ones, with their ids,
are compiled into one minimal transducer (see ``transducer``), which is written
to the shared folder, sent to every executor once and memory-mapped by its
Python workers.  Each batch of texts walks its distinct words through the
transducer in byte order; a word it lacks is merged exactly, so the lexicon's
size changes the speed and never the ids.  A lexicon once built can be passed
to later runs.

Defined results: a null or empty text gives an empty list; a blank text gives
the ids of its characters; strings of special tokens are ordinary text; a
document of any length is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecurve.llm.transducer import Transducer, compile_lexicon
from tidecurve.shared import cut, fresh_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A word is frequent from this share of all words on, so there are at most 100,000.
LEXICON_SHARE = 1e-5
#: Characters of text encoded together.
TOGETHER = 4_000_000
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one word: always the lowest rank, leftmost first; O(n log n)."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 once merged away
    before, heap = list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:  # one of its parts has changed
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def frequent_words(texts: DataFrame, column: str, share: float = LEXICON_SHARE) -> list[str]:
    """The words that are ``share`` of all words of all texts at least: no more than 1 / share."""
    words = texts.select(F.explode(F.regexp_extract_all(column, F.lit(PATTERN), F.lit(0))).alias("word"))
    counted = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "p6-words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    return [r["word"] for r in counted.where((F.col("n") >= share * total) & (F.length("word") <= 64)).select("word").collect()]


class Lexicon:
    """The shipped transducer and vocabulary; picklable, opened lazily in each worker."""

    def __init__(self, lexicon_file: str, vocabulary_file: str) -> None:
        self.lexicon_file, self.vocabulary_file = lexicon_file, vocabulary_file

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        """A function from texts to their ids."""
        import regex

        ranks = load_ranks(SparkFiles.get(self.vocabulary_file))
        lexicon = Transducer.open(SparkFiles.get(self.lexicon_file))
        split = regex.compile(PATTERN).findall

        def encode(texts: list[str]) -> list[list[int]]:
            cut_up = [split(t) for t in texts]
            raw = sorted({w.encode() for w in set().union(*cut_up)})
            ids = {word.decode(): known or merge(word, ranks) for word, known in zip(raw, lexicon.walk(raw))}
            return [[i for w in words for i in ids[w]] for words in cut_up]

        return encode


def _encoded(encode: Callable[[list[str]], list[list[int]]], column: pa.Array) -> Iterator[list[int]]:
    """Ids of each text of a column, ``TOGETHER`` characters at a time."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield from encode(texts)
            texts, size = [], 0
    if texts:
        yield from encode(texts)


def build_lexicon(texts: DataFrame, column: str, vocabulary: str = VOCABULARY, share: float = LEXICON_SHARE) -> Lexicon:
    spark = texts.sparkSession
    ranks = load_ranks(vocabulary)
    block = compile_lexicon({raw: merge(raw, ranks) for raw in {w.encode() for w in frequent_words(texts, column, share) or [" "]}})
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    path = f"{fresh_dir(spark, 'p6')}/{name}"
    _write(spark, path, block)
    spark.sparkContext.addFile(path)
    own = f"vocabulary-{uuid.uuid4().hex}.tiktoken"
    with open(vocabulary, "rb") as file:
        _write(spark, f"{path}.d/{own}", file.read())
    spark.sparkContext.addFile(f"{path}.d/{own}")
    return Lexicon(name, own)


def _write(spark: SparkSession, path: str, block: bytes) -> None:
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(block))
    finally:
        out.close()


def encode_texts(df: DataFrame, key: str, column: str, lexicon: Lexicon | None = None) -> DataFrame:
    """``(key, ids ARRAY<INT>)``, one row for every row of ``df``."""
    lexicon = lexicon or build_lexicon(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lexicon.encoder()
        for batch in batches:
            offsets, flat = [0], []
            for own in _encoded(encode, batch.column(1)):
                flat += own
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(np.asarray(offsets, np.int32), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, key: str, column: str, lexicon: Lexicon | None = None) -> DataFrame:
    """``(key, n_tokens)``: the length of each text in tokens; 0 for a null or empty one."""
    lexicon = lexicon or build_lexicon(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lexicon.encoder()
        for batch in batches:
            sizes = [len(own) for own in _encoded(encode, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint").select(F.col("key").alias(key), "n_tokens")
