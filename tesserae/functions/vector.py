"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def md5_bytes(text: Column) -> Column:
    """The sixteen bytes of a text's MD5 as numbers from 0 to 255."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.md5(text), 2 * i + 1, 2), 16, 10).cast("int"))
