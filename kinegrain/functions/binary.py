"""Fixed-layout fields of binary columns, decoded by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(content: Column, offset: int, size: int, little: bool = True) -> Column:
    """An unsigned integer of up to 7 bytes at ``offset``; null beyond the end."""
    total = None
    for k in range(size):
        at = offset + (size - 1 - k if little else k)
        byte = F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("bigint")
        total = byte if total is None else total * 256 + byte
    return F.when(F.octet_length(content) >= offset + size, total)


def signed(content: Column, offset: int, size: int, little: bool = True) -> Column:
    v = unsigned(content, offset, size, little)
    return F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v)


def rational(numerator: Column, denominator: Column) -> Column:
    """A quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(numerator.cast("double") / denominator)


def magic(content: Column) -> Column:
    """Kind of a file by its first bytes: tiff, fpgy, fpg2, xml or unknown."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.substring(content, 1, 256).cast("string")
    return (
        F.when(head.isin("49492A00", "4D4D002A"), "tiff").when(head == "46504759", "fpgy").when(head == "46504732", "fpg2")
        .when(F.ltrim(text).startswith("<"), "xml").otherwise("unknown"))
