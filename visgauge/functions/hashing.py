"""Keys and digests, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column, digits: int = 24) -> Column:
    """The first hex digits of the SHA-256 of parts joined by line feeds; a null part is written as a NUL character, so
    that it keeps its place."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.char(F.lit(0))) for p in parts]), 256), 1, digits)


def salted_order(value: Column, salt: str) -> Column:
    """A sort key that puts values in an order that looks random and never changes for a salt."""
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), value.cast("string")), 256)


def row_digest(value: Column) -> Column:
    """A number for each value whose sum over rows, whatever their order, tells whether two sets of rows are equal."""
    return F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of 16 digits."""
    x, y = (F.conv(c, 16, -10).cast("long") for c in (a, b))
    return F.bit_count(x.bitwiseXOR(y))


def bits(flags: Column) -> Column:
    """Up to 64 flags as the bits of a bigint, the first one lowest."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.arrays_zip(flags.alias("f"), F.sequence(F.lit(0), F.size(flags) - 1).alias("i")), F.lit(0).cast("long"), lambda acc, x: F.when(x["f"], acc.bitwiseOR(F.call_function("shiftleft", one, x["i"]))).otherwise(acc))
