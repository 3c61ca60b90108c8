"""TFRecord files of ``tf.train.Example`` records, read and written in Arrow batches without any other library.

A record is its length, a checksum of the length, the bytes and a checksum of
the bytes.  The bytes are a protocol-buffer map from feature names to lists of
bytes, floats or integers.  Checksums are CRC-32C, masked; they are verified on
reading and computed for a whole batch at once.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidecurve.sources.files import _local

#: The reversed polynomial of CRC-32C and the constant of its mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


def checksums(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of every part; one step a byte position, all parts together."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])[order] if len(parts) else np.zeros(0, np.int64)
    table, state = _table(), np.full(len(parts), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # parts with a byte at that position
    for k, n in enumerate(longer):
        state[:n] = table[(state[:n] ^ flat[starts[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    crc = np.empty(len(parts), np.uint32)
    crc[order] = state ^ np.uint32(0xFFFFFFFF)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode(features: dict[str, bytes | str | float | int | None]) -> bytes:
    """One record; unknown values are left out."""
    entries = b""
    for name, value in features.items():
        if value is None:
            continue
        if isinstance(value, str):
            value = value.encode()
        if isinstance(value, (bytes, bytearray)):
            body = _field(1, _field(1, bytes(value)))
        elif isinstance(value, (float, np.floating)):
            body = _field(2, _field(1, struct.pack("<f", value)))
        else:
            body = _field(3, _field(1, _varint(int(value))))
        entries += _field(1, _field(1, name.encode()) + _field(2, body))
    return _field(1, entries)


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, 0, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, kind, data[at : at + size]
            at += size


def decode(record: bytes) -> dict[str, list]:
    """Feature name to its list of values."""
    out: dict[str, list] = {}
    for _, _, features in _fields(record):
        for _, _, entry in _fields(features):
            parts = {n: body for n, _, body in _fields(entry)}
            values: list = []
            for kind, _, body in _fields(parts.get(2, b"")):
                for _, wire, item in _fields(body):
                    if kind == 1:
                        values.append(item)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(item) // 4}f", item)
                    else:
                        listed = [item] if wire == 0 else [v for v in _packed(item)]
                        values += [v - (1 << 64) if v >> 63 else v for v in listed]
            out[parts[1].decode()] = values
    return out


def _packed(data: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            yield value
            value = shift = 0


def frame(records: list[bytes]) -> bytes:
    sizes = [struct.pack("<Q", len(r)) for r in records]
    return b"".join(s + struct.pack("<I", a) + r + struct.pack("<I", b) for s, a, r, b in zip(sizes, checksums(sizes), records, checksums(records)))


def unframe(content: bytes, name: str = "") -> list[bytes]:
    records, sizes, marks, at = [], [], [], 0
    while at < len(content):
        size = struct.unpack_from("<Q", content, at)[0]
        if at + 16 + size > len(content):
            raise ValueError(f"{name} ends within a record")
        sizes.append(content[at : at + 8])
        records.append(content[at + 12 : at + 12 + size])
        marks.append((*struct.unpack_from("<I", content, at + 8), *struct.unpack_from("<I", content, at + 12 + size)))
        at += 16 + size
    if not np.array_equal(np.stack([checksums(sizes), checksums(records)], 1) if records else np.zeros((0, 2)), np.array(marks, np.uint32).reshape(-1, 2)):
        raise ValueError(f"{name} fails its checksums")
    return records


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, <features>)``: the features of ``schema``, null where a record lacks one; longer lists give their first value."""
    kinds = [c.split() for c in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                rows = []
                for record in unframe(content, file):
                    own = decode(record)
                    values = [(own.get(name) or [None])[0] for name, _ in kinds]
                    rows.append([file, *(v.decode() if kind == "string" and v is not None else v for v, (_, kind) in zip(values, kinds))])
                yield pd.DataFrame(rows, columns=["file", *(name for name, _ in kinds)], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content").mapInPandas(parse, f"file string, {schema}")


def write(df: DataFrame, path: str, shard: str, features: list[str]) -> DataFrame:
    """Write one file a value of ``shard`` and task below the mounted folder ``path``; ``(file, records)`` of what was written.

    Files are written under another name and then renamed, and are named by
    shard and task, so a repeated task replaces its own.
    """
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, open_files, counts = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            for name, own in batch.groupby("_shard", sort=False):
                file = f"{name}-{task:05d}.tfrecord"
                if file not in open_files:
                    open_files[file] = open(f"{folder}/.{file}.part", "wb")
                rows = own[features].astype(object).where(own[features].notna(), None)
                records = [encode(dict(zip(features, r))) for r in rows.itertuples(index=False)]
                open_files[file].write(frame(records))
                counts[file] = counts.get(file, 0) + len(records)
        for file, handle in open_files.items():
            handle.close()
            os.replace(f"{folder}/.{file}.part", f"{folder}/{file}")
        yield pd.DataFrame({"file": list(counts), "records": list(counts.values())})

    return df.withColumn("_shard", F.col(shard).cast("string")).mapInPandas(put, "file string, records bigint")
