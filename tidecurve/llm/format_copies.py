"""Problem 5: records that differ only in formatting, by radix partitioning and tries.

A record's canonical bytes are its text fields, composed (NFC), case-folded
and stripped of everything but letters, digits and accents, sorted so that
the order of the fields does not matter, followed by the fields that must be
equal as they are.

1. every task folds its rows into small tries and emits one row per terminal
   (bytes, count, smallest key): a group holding a third of all rows leaves a
   task as one row per trie;
2. the terminals are bucketed by their first bytes.  A bucket over the limit
   is cut further behind the longest prefix its members share, until it fits
   or holds a single value;
3. each bucket becomes one trie whose terminals carry the counters.

The list of oversized buckets stays a table, and each round of cutting is
written before the next, so no round repeats another's work.

Defined results: a row with a null text field belongs to no record; null
equals null in exact fields; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidecurve.shared import cut, tasks

BUCKET_LIMIT = 50_000
LOCAL_TRIE_ROWS = 100_000


def canonical_text(text: str) -> str:
    """Composed, case-folded, letters, digits and accents only."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    if folded.isalnum():
        return folded
    return "".join(c for c in folded if c.isalnum() or unicodedata.category(c)[0] == "M")


@F.pandas_udf(T.BinaryType())
def _canonical(fields: pd.DataFrame, exact: pd.Series) -> pd.Series:
    rows = zip(*(fields[c] for c in fields.columns))
    return pd.Series(
        ["\x1f".join([*sorted(map(canonical_text, row)), tail]).encode() for row, tail in zip(rows, exact)],
        dtype=object,
    )


class CountingTrie:
    """Path-compressed byte trie; a terminal holds a counter and the smallest key.

    A node is ``[label, children by first byte, count, smallest key]``.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, None]
        self.terminals = 0

    def add(self, word: bytes, count: int, key) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [word[at:], {}, count, key]
                self.terminals += 1
                return
            label = child[0]
            if word.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, most = 1, min(len(label), len(word) - at)
            while same < most and label[same] == word[at + same]:
                same += 1
            upper = [label[:same], {label[same]: child}, 0, None]
            child[0] = label[same:]
            node[1][word[at]] = upper
            node, at = upper, at + same
        self.terminals += node[2] == 0
        node[2] += count
        node[3] = key if node[3] is None or key < node[3] else node[3]

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            word = before + node[0]
            if node[2]:
                yield word, node[2], node[3]
            stack.extend((word, child) for child in node[1].values())


def _terminals(trie: CountingTrie) -> pd.DataFrame:
    rows = list(trie)
    return pd.DataFrame({"bytes": [r[0] for r in rows], "copies": [r[1] for r in rows], "first_key": [r[2] for r in rows]})


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = CountingTrie()
    for batch in batches:
        for word, key in zip(batch["bytes"], batch["key"]):
            trie.add(word, 1, key)
        if trie.terminals >= LOCAL_TRIE_ROWS:
            yield _terminals(trie)
            trie = CountingTrie()
    if trie.terminals:
        yield _terminals(trie)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; one trie lives at a time."""
    trie, at = CountingTrie(), None
    for batch in batches:
        for bucket, word, count, key in zip(batch["bucket"], batch["bytes"], batch["copies"], batch["first_key"]):
            if bucket != at:
                if trie.terminals:
                    yield _terminals(trie)
                trie, at = CountingTrie(), bucket
            trie.add(word, count, key)
    if trie.terminals:
        yield _terminals(trie)


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@F.pandas_udf(T.IntegerType())
def _shared(lo: pd.Series, hi: pd.Series) -> pd.Series:
    return pd.Series([_shared_prefix(bytes(a), bytes(b)) for a, b in zip(lo, hi)], dtype="int32")


def radix_buckets(terminals: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Add ``bucket``, a prefix of ``bytes`` that at most ``limit`` terminals share.

    A bucket of one single value stays as it is, whatever its size: its
    terminals are already folded, one per local trie.
    """
    bucketed = terminals.withColumn("bucket", F.expr("substring(bytes, 1, 1)"))
    while True:
        big = (
            bucketed.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
            .where((F.col("n") > limit) & (F.col("lo") != F.col("hi")))
        )
        # a bucket whose shortest member ends where the others go on keeps that member's own bytes
        deeper = cut(big.select("bucket", (_shared(F.col("lo"), F.col("hi")) + 1).alias("deeper")).where("deeper > octet_length(bucket)"), "p5-cuts")
        if deeper.isEmpty():
            return bucketed
        split = bucketed.join(deeper, "bucket", "left").withColumn("bucket", F.expr("if(deeper is null, bucket, substring(bytes, 1, deeper))"))
        bucketed = cut(split.drop("deeper"), "p5-buckets")


def canonical_rows(df: DataFrame, key: str, text: list[str], exact: list[str]) -> DataFrame:
    """``key`` and canonical ``bytes`` of every row without a null text field."""
    tail: Column = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"e{i}") for i, c in enumerate(exact)]))
    present = F.lit(True)
    for c in text:
        present = present & F.col(c).isNotNull()
    fields = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(text)])
    return df.where(present).select(F.col(key).alias("key"), _canonical(fields, tail).alias("bytes"))


def count_copies(rows: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(bytes, copies, first_key)``, one row per distinct ``bytes`` of ``rows(key, bytes)``."""
    kind = rows.schema["key"].dataType.simpleString()
    shape = f"bytes binary, copies bigint, first_key {kind}"
    terminals = cut(rows.mapInPandas(_fold, shape), "p5-terminals")
    bucketed = radix_buckets(terminals, limit)
    return (
        bucketed.repartition(tasks(rows.sparkSession), "bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(_count, shape)
    )


def copy_pairs(df: DataFrame, key: str, text: list[str], exact: list[str]) -> DataFrame:
    """``(first_key, key)``: the smallest key of each record with each of its other keys."""
    rows = cut(canonical_rows(df, key, text, exact), "p5-rows")
    groups = count_copies(rows).where("copies > 1")
    return rows.join(groups, "bytes").where("key != first_key").select("first_key", "key")


def collapsed(df: DataFrame, key: str, text: list[str], exact: list[str]) -> DataFrame:
    """One row per record: the row of its smallest key, with ``copies``."""
    rows = cut(canonical_rows(df, key, text, exact), "p5-rows")
    groups = count_copies(rows).select(F.col("first_key").alias(key), "copies")
    return df.select(key, *text, *exact).join(groups, key)
