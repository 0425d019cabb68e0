"""MurmurHash3 (32 bit, seed 0) over Arrow batches, and the tokens of a hash ring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def murmur3(keys: list[bytes]) -> np.ndarray:
    """Hashes of all keys at once; keys of one length share a matrix of little-endian words."""
    out = np.zeros(len(keys), np.uint32)
    sizes = np.array([len(k) for k in keys])
    with np.errstate(over="ignore"):
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            block = np.zeros((len(at), (n + 3) // 4 * 4), np.uint8)
            block[:, :n] = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n)
            words = block.view("<u4") if n else np.zeros((len(at), 0), np.uint32)
            h = np.zeros(len(at), np.uint32)
            for c in range(words.shape[1]):
                k = _rotated(words[:, c] * _C1, 15) * _C2
                h ^= k
                if c < n // 4:
                    h = _rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(n)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[at] = h ^ (h >> np.uint32(16))
    return out


@F.pandas_udf(T.LongType())
def murmur3_32(keys: pd.Series) -> pd.Series:
    """The hash of a binary column as an unsigned value in a long; null for null."""
    known = keys.notna()
    out = pd.Series(np.zeros(len(keys), np.int64), index=keys.index, dtype="Int64")
    out[known] = murmur3([bytes(k) for k in keys[known]]).astype(np.int64)
    out[~known] = pd.NA
    return out


def token_key(node, index):
    """node id bytes followed by the index as eight big-endian bytes."""
    return F.concat(node.cast("binary"), F.unhex(F.lpad(F.hex(index), 16, "0")))
