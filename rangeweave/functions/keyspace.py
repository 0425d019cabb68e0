"""Functions on keys and bounds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(padded_hex: Column, i: Column) -> Column:
    return F.conv(F.substring(padded_hex, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def midpoint(start: Column, end: Column) -> Column:
    """the byte-wise average of two bounds, padded with zero bytes to the longer one, with half bytes carried to the right.

    A sum of more than 8 bits loses its carry to the left, as in the system that this models; callers
    check that the result is strictly inside (F2), so such a split doesn't happen.
    """
    n = F.greatest(F.octet_length(start), F.octet_length(end), F.lit(1))
    s, e = (F.rpad(F.hex(x), 2 * n, "0") for x in (start, end))
    init = F.struct(F.lit(0).alias("carry"), F.lit("").alias("out"))

    def step(acc, i):
        value = acc["carry"] * 256 + _byte(s, i) + _byte(e, i)
        return F.struct((value % 2).alias("carry"), F.concat(acc["out"], F.lpad(F.hex(F.floor(value / 2) % 256), 2, "0")).alias("out"))

    return F.unhex(F.aggregate(F.sequence(F.lit(0), n - 1), init, step, lambda acc: acc["out"]))


def inside(point: Column, start: Column, end: Column) -> Column:
    """F2."""
    return (start < point) & (point < end)


def saturating_sub(a: Column, b: Column) -> Column:
    """F7 on unsigned ids kept as longs."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def saturating_add(a: Column, b: Column) -> Column:
    """the largest long stands for "no end" and absorbs."""
    most = F.lit(2**63 - 1)
    return F.when(a > most - b, most).otherwise(a + b)


def merged_span(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """F8: the key space of two neighbours."""
    return F.struct(F.least(start1, start2).alias("keyspace_start"), F.greatest(end1, end2).alias("keyspace_end"))


def frame_crc(kind: Column, count: Column, payload: Column) -> Column:
    """CRC-32 over kind byte, big-endian count and payload length, and the payload."""
    be = lambda x, n: F.unhex(F.lpad(F.hex(x), n, "0"))
    return F.crc32(F.concat(be(kind, 2), be(count, 8), be(F.octet_length(payload), 8), payload))


def dissemination_count(n: Column) -> Column:
    """Three times the rounded-up binary logarithm, three at least."""
    return F.greatest(F.lit(3).cast("long"), (3 * F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long"))
