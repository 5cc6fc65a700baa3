"""Column functions on file names and numbers meant for people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FASTQ = r"(?i)\.(fastq|fq)(\.gz)?$"
FASTA = r"(?i)\.(fa|fasta|fna)(\.gz)?$"
#: Names of barcode folders, and the form of an assembly accession.
BARCODE = r"(?i)^(barcode\d+|bc\d+|unclassified)$"
ACCESSION = r"^GC[AF]_\d{9}\.\d+$"


def is_sequencing_file(name: Column) -> Column:
    return name.rlike(FASTQ) & ~name.startswith(".")


def is_barcode(name: Column) -> Column:
    return name.rlike(BARCODE)


def is_accession(text: Column) -> Column:
    return text.rlike(ACCESSION)


def extension(name: Column) -> Column:
    """Of outputs made from that source."""
    return F.when(name.endswith(".gz"), ".fastq.gz").otherwise(".fastq")


def stem(name: Column, pattern: str = FASTQ) -> Column:
    return F.regexp_replace(name, pattern, "")


def numbered(prefix: Column, kind: str, index: Column, ext: Column) -> Column:
    """prefix_kind_0007.ext; kind is chunk or reads."""
    return F.format_string(f"%s_{kind}_%04d%s", prefix, index.cast("int"), ext)


def barcode_name(index: Column) -> Column:
    return F.format_string("barcode%02d", (index + 1).cast("int"))


def barcode_names(pattern: str, n: int) -> list[str]:
    """The user's format pattern for 1 to n. Raises ValueError if it doesn't tell 1 from 2, or gives nothing."""
    try:
        made = [pattern.format(i) for i in range(1, max(n, 2) + 1)]
    except (IndexError, KeyError, ValueError) as e:
        raise ValueError(f"barcode pattern {pattern!r} doesn't format a number") from e
    if not all(made) or made[0] == made[1]:
        raise ValueError(f"barcode pattern {pattern!r} doesn't name barcodes apart")
    return made[:n]


def glob_regex(pattern: str) -> str:
    """A file-name glob as a regular expression for rlike."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i:end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", r"\\") + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def human_bytes(n: Column) -> Column:
    """Half-way values go to the even digit."""
    in_ = lambda i, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**i), 1))
    out, units = in_(5, "PB"), ["B", "KB", "MB", "GB", "TB"]
    for i in range(len(units) - 1, -1, -1):
        out = F.when(n < F.lit(1024.0 ** (i + 1)), in_(i, units[i])).otherwise(out)
    return out


def human_time(s: Column) -> Column:
    """Half-way values go up."""
    s = s.cast("double")
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))


def bytes_text(n: float) -> str:
    """human_bytes() of a number that the driver has."""
    unit = next((u for u in ("B", "KB", "MB", "GB", "TB") if n < 1024 or (n := n / 1024) < 0), "PB")
    return f"{n:.1f} {unit}"
