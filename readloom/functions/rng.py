"""Counter-based random columns: a draw depends on its seed and counters alone, not on partitioning or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *counters: Column) -> Column:
    """In [0, 1): the first 32 bits of the md5 of seed:counter:..., which other SQL engines can repeat."""
    text = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in counters])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fast_uniform(seed: int, *counters: Column) -> Column:
    """In [0, 1) by xxhash64, for bulk draws."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *counters), 11).cast("double") / float(1 << 53)


def adler32(text: Column) -> Column:
    """Of the text's UTF-8 bytes, from their sums: 1 + all bytes, and each byte as often as there are bytes from it on, plus the count."""
    n = F.octet_length(text)
    digits = F.hex(F.encode(text, "UTF-8"))
    code = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    sums = F.aggregate(places, F.struct(F.lit(1).cast("bigint").alias("a"), n.cast("bigint").alias("b")), lambda s, i: F.struct((s["a"] + code(i)).alias("a"), (s["b"] + code(i) * (n - i + 1)).alias("b")))
    return F.pmod(sums["b"], F.lit(65521)) * 65536 + F.pmod(sums["a"], F.lit(65521))


def exponential(u: Column, mean: Column) -> Column:
    return -F.log(1 - u) * mean


def normal(u1: Column, u2: Column) -> Column:
    """Box-Muller; 1 - u1 is never 0."""
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)


def lognormal_parameters(mean: float, std: float) -> tuple[float, float]:
    """(mu, sigma) of a log-normal variable of that mean and standard deviation."""
    if std == 0:
        return math.log(mean), 0.0
    return math.log(mean * mean / math.sqrt(std * std + mean * mean)), math.sqrt(math.log(1 + std * std / (mean * mean)))
