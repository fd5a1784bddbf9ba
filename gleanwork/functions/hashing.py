"""Content hashes and 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def hash_prefix(sha: Column, n: int = 12) -> Column:
    return F.substring(sha, 1, n)


def hash_bits(hex_hash: Column) -> Column:
    """16 hex digits as a long; the top bit becomes the sign."""
    return F.conv(hex_hash, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")
