"""Fill-in-the-middle forms of documents by marker injection: an escaped text gets a marker behind each unit, and ranked parts are cut at markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\u0001", "\u0002"
#: What stands for an escape and for a marker of the text itself.
OWN_ESCAPE, OWN_MARK = ESCAPE + "\u0004", ESCAPE + "\u0003"


@dataclass(frozen=True)
class Form:
    """The sentinels, and of 100 documents how many are transformed, and of 100 transformed ones how many have the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    suffix_first: int = 20
    seed: int = 1

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if any(x in y for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j) or any(y.startswith(x[k:]) for x in marks for y in marks for k in range(1, len(x))):
            raise ValueError("no sentinel may hold another, nor end as one starts")



def escaped(text: Column) -> Column:
    """text without a marker."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OWN_ESCAPE)), F.lit(MARK), F.lit(OWN_MARK))


def unescaped(text: Column) -> Column:
    """The inverse of escaped(), for parts cut at markers too: what is left of an escape is always followed by its sign."""
    return F.replace(F.replace(text, F.lit(OWN_MARK), F.lit(MARK)), F.lit(OWN_ESCAPE), F.lit(ESCAPE))


def marked(text: Column, unit: str = "[A-Za-z]++|[^A-Za-z]") -> Column:
    """An escaped text with a marker behind every unit. An escape and its sign are one unit, as is the character they stand for.

    unit must match any character that isn't a letter as a unit of its own.
    """
    return F.regexp_replace(text, f"{ESCAPE}[\u0003\u0004]|{unit}", f"$0{MARK}")


def parts(text: Column, lo: Column, hi: Column, n: Column) -> tuple[Column, Column, Column]:
    """The first lo of a marked text's n units, those up to hi, and the rest, without markers and escapes."""
    plain = lambda c: unescaped(F.replace(c, F.lit(MARK)))
    cut = lambda c, k: F.call_function("substring_index", c, F.lit(MARK), k.cast("int"))
    return plain(cut(text, lo)), plain(cut(cut(text, hi), lo - hi)), plain(cut(text, hi - n - 1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that seed and doc_id decide; a null id counts as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output: each whole text as it is or in one of the two orders.

    docs: doc_id, text; other columns play no part, whatever their names. Null text: empty, n is 0 and the form plain. A text
    that holds a sentinel is plain, so that every output can be undone. A null id draws as an empty one; rows of one id draw alike.
    No rows: no rows. Rows don't meet: no shuffle, and a task holds a text at a time.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), form.seed), 1)])
    d = d.withColumn("marked", marked(escaped(F.col("text"))))
    d = d.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(MARK)))).cast("long"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    holds = F.contains("text", F.lit(form.prefix)) | F.contains("text", F.lit(form.suffix)) | F.contains("text", F.lit(form.middle))
    kind = F.when((F.col("text") == "") | holds | (F.col("h3") % 100 >= form.rate), "plain").when(F.col("h4") % 100 < form.suffix_first, "spm").otherwise("psm")
    d = d.select("doc_id", "text", "marked", "n", kind.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    cut = parts(F.col("marked"), F.col("lo"), F.col("hi"), F.col("n"))
    d = d.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", c).alias(name) for c, name in zip(cut, ("prefix", "middle", "suffix"), strict=True)])
    p, s, m = F.lit(form.prefix), F.lit(form.suffix), F.lit(form.middle)
    out = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    return d.withColumn("output", F.coalesce(out, "text"))


def restore(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The text of an output, from the output and its form alone: a transformed one holds each sentinel once."""
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(before(after(output, form.prefix), form.suffix), after(output, form.middle), before(after(output, form.suffix), form.middle))
    spm = F.concat(before(after(output, form.prefix), form.middle), after(output, form.middle), before(after(output, form.suffix), form.prefix))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)
