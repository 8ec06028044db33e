"""Murmur3 (x86, 32 bits) for routing; Spark's own hash() is another variant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = 0xFFFFFFFF


def _turn(x: int, n: int) -> int:
    return (x << n | x >> 32 - n) & _M


def murmur3(text: str, seed: int = 0) -> int:
    """Of the UTF-8 bytes, unsigned."""
    data, h = text.encode(), seed
    blocks = len(data) & ~3
    for i in range(0, blocks, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _M
        h = _turn(h ^ (_turn(k, 15) * 0x1B873593 & _M), 13) * 5 + 0xE6546B64 & _M
    if tail := data[blocks:]:
        h ^= _turn(int.from_bytes(tail, "little") * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


def murmur3_all(texts: list[str | None]) -> np.ndarray:
    """murmur3() of many texts, all of one length at once; null counts as empty."""
    data, out = [(t or "").encode() for t in texts], np.empty(len(texts), np.int64)
    size = np.array([len(d) for d in data], np.int64)
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        padded = np.zeros((len(at), (n + 3) // 4 * 4), np.uint8)
        padded[:, :n] = np.frombuffer(b"".join([data[i] for i in at]), np.uint8).reshape(len(at), n)
        words, h = padded.view("<u4"), np.zeros(len(at), np.uint32)
        for i in range(words.shape[1]):
            k = turn(words[:, i] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64) if 4 * i + 4 <= n else h ^ k
        h ^= np.uint32(n)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[at] = h ^ h >> np.uint32(16)
    return out


@F.pandas_udf(T.LongType())
def murmur3_column(text: pd.Series) -> pd.Series:
    return pd.Series(murmur3_all([None if pd.isna(t) else t for t in text]))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a routing key, or of a document's id."""
    return F.lit(0) if shards == 1 else (murmur3_column(key) % shards).cast("int")
