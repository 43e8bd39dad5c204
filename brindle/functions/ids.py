"""Identifiers and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def uuid5(namespace: str, name: Column) -> Column:
    """A name-based UUID (version 5) as lower-case text."""
    raw = uuid.UUID(namespace).bytes
    h = F.sha1(F.concat(F.lit(raw), name.cast("binary")))
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def record_id(namespace: str, tenant: Column, type_id: Column, created_at: Column, key: Column) -> Column:
    """The id of a usage record: tenant, type, whole microseconds and idempotency key, separated by 0x1F."""
    return uuid5(namespace, F.concat_ws(SEPARATOR, tenant, type_id, F.unix_micros(created_at).cast("string"), key))


def murmur3(data: list[bytes], seed: int = 0) -> np.ndarray:
    """32-bit Murmur3 of each byte string, all strings a block at a time."""
    size = np.array([len(d) for d in data], np.int64)
    width = int(-(-size.max(initial=1) // 4)) * 4
    raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), "<u4").reshape(len(data), -1).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & mask
    h = np.full(len(data), seed, np.uint64)
    for i in range(raw.shape[1]):
        k = turn(raw[:, i] * np.uint64(0xCC9E2D51) & mask, 15) * np.uint64(0x1B873593) & mask
        full = size >= 4 * (i + 1)
        tail = ~full & (size > 4 * i)
        mixed = (turn(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
        h = np.where(full, mixed, np.where(tail, h ^ k, h))
    h ^= size.astype(np.uint64)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & mask
    return (h ^ (h >> np.uint64(16))).astype(np.uint32)


def partition_of(key: Column, n: int) -> Column:
    """The log partition of a key: Murmur3 (32 bits, seed 0) without its top bit, modulo n.  Null stays null."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            h = murmur3([k.encode() if k is not None else b"" for k in keys]) & 0x7FFFFFFF
            yield pd.Series((h % n).astype("int32")).where(keys.notna().to_numpy()).astype("Int32")

    return run(key)


def manifest_root(hashes: Column) -> Column:
    """SHA-256 over the concatenated hex hashes of parts, in order."""
    return F.sha2(F.array_join(hashes, ""), 256)
