"""Line deduplication by a fixed-depth log-template tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

FIELD = "<*>"
DIGIT = re.compile(r"\d")
LINE = "doc_id string, node binary, no int, tokens int, leaf long, line long, masked string"


def masked_lines(docs: DataFrame, min_tokens: int, depth: int, min_fixed: float, min_exact: int) -> DataFrame:
    """LINE's columns of every line of at least min_exact tokens; of fewer than min_tokens, it stays as it is. A token with a digit is a variable field; a line of
    which less than min_fixed is without digits, such as a row of numbers, stays as it is, and its masked is empty. The leaf of the tree is the number of tokens and the first depth of them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, node, text in zip(batch["doc_id"], batch["node"], batch["text"], strict=True):
                for no, line in enumerate(text.split("\n")):
                    tokens = line.split()
                    if len(tokens) >= min_exact:
                        masked = whole = " ".join(tokens)
                        if len(tokens) < min_tokens:
                            masked = ""
                        elif DIGIT.search(line):
                            fields = [FIELD if DIGIT.search(t) else t for t in tokens]
                            if len(tokens) - fields.count(FIELD) >= min_fixed * len(tokens):
                                tokens = fields
                                masked = whole = " ".join(tokens)
                            else:
                                masked = ""
                        leaf = xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:depth])}".encode())
                        line_ = xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass"))
                        rows.append((doc, node, no, len(tokens), leaf - (1 << 63), line_ - (1 << 63), masked))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    # the id travels as text: pandas would make floats of longs beside nulls
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "node", "text").mapInPandas(split, LINE).withColumn("doc_id", F.col("doc_id").cast("long"))


def keys(tokens: Column, depth: int, salts: int) -> Column:
    """Up to `salts` hashes of a line's tokens at two places after the leading ones: all pairs of places of a short line, a spread of them of a long one.
    Lines of one template share each key that misses its fields. Two places or fewer are keys by themselves."""
    rest = F.size(tokens) - depth
    pairs = F.when(rest > 2, (rest.cast("long") * (rest - 1) / 2).cast("long")).otherwise(F.greatest(rest, F.lit(1)).cast("long"))

    # one step after another, for Spark would reckon t and high anew wherever one lambda names them
    long = F.size(tokens) > depth + 2
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.least(pairs, F.lit(salts).cast("long")) - 1), lambda k: F.pmod(k * 1_000_003 + 17, pairs))
    at = F.transform(at, lambda t: F.struct(t.alias("t"), F.when(long, F.floor((1 + F.sqrt(1 + 8 * t)) / 2).cast("long")).otherwise(t).alias("high")))
    at = F.transform(at, lambda x: F.struct(F.when(long, x["t"] - (x["high"] * (x["high"] - 1) / 2).cast("long")).otherwise(x["t"]).alias("low"), x["high"].alias("high")))
    return F.transform(at, lambda x: F.xxhash64("leaf", x["low"], x["high"], F.get(tokens, (x["low"] + depth).cast("int")), F.get(tokens, (x["high"] + depth).cast("int"))))


def templates(lines: DataFrame, min_constant: float, min_share: float, depth: int, salts: int = 16) -> DataFrame:
    """(leaf, line, template): lines of one leaf that agree but for their variable fields have one template.

    Lines of a leaf that share a key of two more tokens are a group; a leaf has any number of them, whatever its size, and a
    line is in several. A token that two distinct lines and min_share of a group's have at a position is constant there, any
    other a field; a line counts once, however many texts hold it, so frequent variants have the template of their rarer ones.
    Of the forms in which at least min_constant of a line is constant, that of the most texts is its template. A line
    without one stays as it is. Lines come summed up, so a line of very many documents is one.
    """
    once = lines.groupBy("leaf", "line", "node").agg(F.max(F.col("masked") != "").alias("open"))
    each = materialize(once.groupBy("leaf", "line").agg(F.max("open").alias("open"), F.count(F.lit(1)).alias("docs")), "distinct-lines")
    # small tables of hot keys are written before they are joined, so that Spark can split the rows that meet them
    leaves = materialize(each.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count_if("open").alias("wide")).where("n > 1"), "leaves")
    each = materialize(each.join(leaves, "leaf").select("leaf", "line", "docs", (F.col("open") & (F.col("wide") > 1)).alias("open")), "lines")
    masked = lines.where("masked <> ''").groupBy("leaf", "line").agg(F.min("masked").alias("masked"))
    several = masked.join(each.where("open").select("leaf", "line", "docs"), ["leaf", "line"])
    several = materialize(several.select("leaf", "line", "docs", F.split("masked", " ").alias("tokens")), "several")
    keyed = several.select("leaf", "line", F.explode(keys(F.col("tokens"), depth, salts)).alias("key"))
    groups = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line")).alias("x")).where("n > 1"), "keys")
    # keys of the same lines are one group
    member = keyed.join(groups, "key").select("leaf", "line", F.xxhash64("leaf", "n", "x").alias("group"), "n").distinct()
    member = materialize(member.join(several, ["leaf", "line"]), "groups")
    counts = member.select("group", "n", F.posexplode("tokens").alias("pos", "token")).groupBy("group", "n", "pos", "token").agg(F.count(F.lit(1)).alias("c"))
    constant = (F.col("c") > 1) & (F.col("c") >= min_share * F.col("n")) & (F.col("token") != FIELD)
    places = counts.groupBy("group", "pos").agg(F.collect_list(F.when(constant, F.col("token"))).alias("held"))
    known = materialize(places.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "held"))).alias("places")), "places")
    form = F.zip_with("tokens", "places", lambda t, p: F.when(F.array_contains(p["held"], t), t).otherwise(FIELD))
    # by explode, or the condition on share would be pushed below and make the form once more
    formed = member.join(known, "group").select("leaf", "line", "docs", F.explode(F.array(form)).alias("form"))
    share = F.size(F.filter("form", lambda t: t != FIELD)) / F.size("form")
    formed = formed.select("leaf", "line", "docs", share.alias("share"), F.xxhash64(F.array_join("form", " ")).alias("general"))
    formed = materialize(formed.where(F.col("share") >= min_constant).distinct(), "forms")
    support = formed.groupBy("leaf", "general").agg(F.sum("docs").alias("support"))
    general = formed.join(support, ["leaf", "general"]).groupBy("leaf", "line").agg(F.max_by("general", F.struct("support", "share", "general")).alias("general"))
    return each.select("leaf", "line").join(general, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("general", "line").alias("template"))


def drop_recurring(docs: DataFrame, *, min_tokens: int = 5, depth: int = 3, min_constant: float = 0.7, min_share: float = 0.34, min_docs: int = 3, long_tokens: int = 50, min_fixed: float = 0.5, min_exact: int | None = None) -> DataFrame:
    """All columns of docs, text without the lines whose template recurs across documents, and n_lines and n_dropped.

    docs: doc_id, text and any others; columns named n_lines or n_dropped are replaced, n_chars follows the text if it is
    there. A template recurs if min_docs different texts hold it, or two if it has long_tokens tokens. Its first line, by
    doc_id and place, stays, so that nothing is lost to the corpus; copies of a text are treated alike, for whole copies are
    another operator's business. Lines of fewer than min_tokens tokens stay, or, if min_exact
    is given, count as they are from so many tokens on.

    Null and empty texts stay as they are. Null doc_id: after all numbers. Repeated rows are treated alike. A line, leaf or
    text with very many rows is summed up before it meets others, or joined by a key that Spark can split. No rows: no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    node = F.unhex(F.md5(F.encode("text", "UTF-8")))
    with scratch(docs.sparkSession):
        lines = materialize(masked_lines(docs.where("text is not null").select("doc_id", "text", node.alias("node")), min_tokens, depth, min_fixed, min_tokens if min_exact is None else min_exact), "masked")
        of = materialize(templates(lines, min_constant, min_share, depth), "templates")
        lines_of = materialize(lines.select("doc_id", "node", "no", "tokens", "leaf", "line").join(of, ["leaf", "line"]).select("doc_id", "node", "no", "tokens", "leaf", "template"), "matched")
        # copies of a text have the same lines at the same places, so the first id and the first place are those of one copy; single numbers are hashed, a struct would be sorted
        by_text = lines_of.groupBy("leaf", "template", "node").agg(F.max("tokens").alias("tokens"), F.min("doc_id").alias("doc_id"), F.min("no").alias("no"))
        first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "no", "node")
        found = by_text.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("texts"), F.max("tokens").alias("tokens"), F.min(first).alias("first"))
        found = found.where((F.col("texts") >= min_docs) | ((F.col("texts") > 1) & (F.col("tokens") >= long_tokens)))
        found = materialize(found.select("leaf", "template", F.col("first.node").alias("first_node"), F.col("first.no").alias("first_no")), "found")
        drops = lines_of.select("leaf", "template", "node", "no").join(found, ["leaf", "template"]).where("node <> first_node or no <> first_no")
        drops = materialize(drops.groupBy("node").agg(F.array_sort(F.collect_set("no")).alias("__drops")), "drops", keep=True).withColumnRenamed("node", "__of")
    out = docs.select(*kept, node.alias("__node")).join(drops, F.col("__node") == F.col("__of"), "left")
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__drops", i)), "\n")
    out = out.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0))).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)))
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    out = out.withColumn("text", F.when(F.col("n_dropped") > 0, left).otherwise(F.col("text")))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*kept, "n_lines", "n_dropped")
