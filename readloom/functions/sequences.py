"""Column functions on reads: reverse complement, slices, lengths, Phred strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import lognormal_parameters, normal

#: Complements of bases, and the Phred range and offset of FASTQ.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
PHRED_LEAST, PHRED_MOST, PHRED_OFFSET = 0, 40, 33


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def piece(seq: Column, start: Column, length: Column) -> Column:
    """length characters from start, counted from 0."""
    return F.substring(seq, (start + 1).cast("int"), length.cast("int"))


def read_length(u1: Column, u2: Column, mean: float, std: float, least: int, genome_length: Column) -> Column:
    """A log-normal length cut to [least, genome_length]; the genome's end wins. Without spread: the mean, or the genome."""
    mu, sigma = lognormal_parameters(mean, std)
    if sigma == 0:
        return F.least(F.lit(int(mean)).cast("bigint"), genome_length)
    drawn = F.exp(F.lit(mu) + F.lit(sigma) * normal(u1, u2)).cast("bigint")
    return F.least(F.greatest(drawn, F.lit(least).cast("bigint")), genome_length)


def start_of(u: Column, genome_length: Column, length: Column) -> Column:
    """Uniform over all places where the read fits."""
    return F.floor(u * (genome_length - length + 1)).cast("bigint")


def phred_char(q: Column) -> Column:
    return F.chr(F.least(F.greatest(q, F.lit(PHRED_LEAST)), F.lit(PHRED_MOST)).cast("int") + PHRED_OFFSET)


def constant_quality(length: Column, mean: float) -> Column:
    """The Phred string of a run whose qualities don't vary."""
    return F.repeat(phred_char(F.lit(mean)), length.cast("int"))


def words_upper(text: Column) -> Column:
    return F.upper(F.split_part(F.trim(text), F.lit(" "), F.lit(1)))
