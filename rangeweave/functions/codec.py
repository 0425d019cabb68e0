"""Records packed into opaque entry payloads, and back, over Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tags of the payload's first byte.
NONE, LZ4, ZSTD = 0, 1, 2


def encode(records: list[tuple[bytes, bytes]], codec: int = NONE) -> bytes:
    """Tag, then for each record key length, key, value length, value; lengths are big-endian 32-bit."""
    body = b"".join(struct.pack(">I", len(k)) + k + struct.pack(">I", len(v)) + v for k, v in records)
    if codec == ZSTD:
        body = zstandard.ZstdCompressor().compress(body)
    elif codec == LZ4:  # a raw block behind its size
        body = struct.pack("<I", len(body)) + pa.Codec("lz4_raw").compress(body, asbytes=True)
    elif codec != NONE:
        raise ValueError(f"unknown codec tag {codec}")
    return bytes([codec]) + body


def decode(payload: bytes, count: int) -> list[tuple[bytes, bytes]]:
    if not payload:
        raise ValueError("empty payload: no codec tag")
    codec, body = payload[0], payload[1:]
    if codec == ZSTD:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    elif codec == LZ4:
        if len(body) < 4:
            raise ValueError("truncated payload")
        size = struct.unpack_from("<I", body)[0]
        try:
            body = pa.Codec("lz4_raw").decompress(body[4:], decompressed_size=size, asbytes=True)
        except OSError as e:
            raise ValueError("broken LZ4 payload") from e
    elif codec != NONE:
        raise ValueError(f"unknown codec tag {codec}")
    at, out = 0, []

    def piece():
        nonlocal at
        if at + 4 > len(body):
            raise ValueError("truncated payload")
        n = struct.unpack_from(">I", body, at)[0]
        if at + 4 + n > len(body):
            raise ValueError("truncated payload")
        at += 4 + n
        return body[at - n : at]

    for _ in range(count):
        out.append((piece(), piece()))
    return out


def encode_payload(codec: int = NONE):
    """Column function: array<struct<key, value>> to payload."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda rows: encode([(bytes(r["key"]), bytes(r["value"])) for r in rows], codec))

    return run


_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))


@F.pandas_udf(_PAIRS)
def decode_payload(payload: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "value": v} for k, v in decode(bytes(p), int(n))] for p, n in zip(payload, count, strict=True)])


def encoded_entries(records: DataFrame, codec: int = NONE) -> DataFrame:
    """(range_id, entry_id, record_count, data) from records with key and value, in batch order."""
    rows = F.array_sort(F.collect_list(F.struct("batch_offset", F.col("key").alias("key"), F.col("value").cast("binary").alias("value"))))
    packed = F.transform(rows, lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))
    return records.groupBy("range_id", "entry_id").agg(F.count(F.lit(1)).alias("record_count"), packed.alias("rows")).select(
        "range_id", "entry_id", "record_count", encode_payload(codec)("rows").alias("data")
    )


def decoded_records(entries: DataFrame) -> DataFrame:
    """(range_id, entry_id, batch_offset, key, value): the inverse of :func:`encoded_entries`."""
    rows = entries.select("range_id", "entry_id", F.posexplode(decode_payload("data", "record_count")).alias("batch_offset", "r"))
    return rows.select("range_id", "entry_id", F.col("batch_offset").cast("long").alias("batch_offset"), "r.key", "r.value")
