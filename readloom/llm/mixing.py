"""Mixing sources to target weights by pivotal dependent rounding. DataFrame expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, uniform

WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<h:bigint,doc_id:bigint,size:bigint,base:bigint,x:double>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, n_rows, target): shares of all sizes by weight, each at most cap times its source, the excess reshared by weight.

    Sources take the weights in turn, by code point, null last. Raising all targets together until a source reaches its
    cap gives the same fixed point as resharing again and again: target = least(cap * size, level * weight). One row a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")).withColumn("w", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("n", F.row_number().over(by)).withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - full) / rest)
    level = F.min_by("level", F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("n"))).over(Window.partitionBy())
    return s.withColumn("target", F.least("most", level * F.col("w"))).select("source", "source_size", "n_rows", F.coalesce("target", F.lit(0.0)).alias("target"))


#: The first level: the documents of a chunk share one fraction y and come by size, largest first. Each is paired with all that
#: follow it, as one partner with the same fraction: mass moves until the document, or else the partner, is 0 or 1.
#: So a large document is settled early, at the cost of many small ones, and what stays undecided is a small one.
FIRST = """
(acc, e) -> transform(array(acc.rest - e.size), rest -> transform(array(
    if(acc.y <= 0 or acc.y >= 1, 5, if(rest <= 0, 6, transform(array(named_struct(
        'up', least((1 - acc.y) * e.size, acc.y * rest),
        'down', least(acc.y * e.size, (1 - acc.y) * rest))), d ->
      if({u} * (d.up + d.down) < d.down,
         if((1 - acc.y) * e.size <= acc.y * rest, 1, 2),
         if(acc.y * e.size <= (1 - acc.y) * rest, 3, 4)))[0]))), k -> named_struct(
  'y', case k when 1 then greatest(acc.y - (1 - acc.y) * e.size / rest, 0D) when 3 then least(acc.y + acc.y * e.size / rest, 1D) when 4 then 1D when 5 then acc.y else 0D end,
  'rest', rest,
  'c', if(k in (2, 4, 6), named_struct('h', e.h, 'doc_id', e.doc_id, 'size', e.size, 'base', e.base, 'x', acc.y + case k when 2 then acc.y * rest / e.size when 4 then -(1 - acc.y) * rest / e.size else 0D end), acc.c),
  'out', if(k in (2, 4, 6), acc.out, concat(acc.out, array(named_struct('doc_id', e.doc_id, 'size', e.size, 'copies', e.base + case k when 1 then 1L when 3 then 0L else bigint(acc.y) end))))))[0])[0]
"""

#: One step of the pivotal method on carrier acc.c and item e, both fractional in x, with sizes as prices: mass moves from one
#: to the other until one is 0 or 1, at odds that keep each one's expectation and, always, the sum of size * x.
STEP = """
(acc, e) -> if(acc.c is null, named_struct('c', e, 'out', acc.out), transform(array(
    transform(array(named_struct(
        'up', least((1 - acc.c.x) * acc.c.size, e.x * e.size),
        'down', least(acc.c.x * acc.c.size, (1 - e.x) * e.size))), d ->
      if({u} * (d.up + d.down) < d.down,
         if((1 - acc.c.x) * acc.c.size <= e.x * e.size, 1, 2),
         if(acc.c.x * acc.c.size <= (1 - e.x) * e.size, 3, 4)))[0]), k -> named_struct(
  'c', case k
    when 1 then named_struct('h', e.h, 'doc_id', e.doc_id, 'size', e.size, 'base', e.base, 'x', e.x - (1 - acc.c.x) * acc.c.size / e.size)
    when 2 then named_struct('h', acc.c.h, 'doc_id', acc.c.doc_id, 'size', acc.c.size, 'base', acc.c.base, 'x', acc.c.x + e.x * e.size / acc.c.size)
    when 3 then named_struct('h', e.h, 'doc_id', e.doc_id, 'size', e.size, 'base', e.base, 'x', e.x + acc.c.x * acc.c.size / e.size)
    else named_struct('h', acc.c.h, 'doc_id', acc.c.doc_id, 'size', acc.c.size, 'base', acc.c.base, 'x', acc.c.x - (1 - e.x) * e.size / acc.c.size) end,
  'out', concat(acc.out, array(case k
    when 1 then named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'copies', acc.c.base + 1)
    when 2 then named_struct('doc_id', e.doc_id, 'size', e.size, 'copies', e.base)
    when 3 then named_struct('doc_id', acc.c.doc_id, 'size', acc.c.size, 'copies', acc.c.base)
    else named_struct('doc_id', e.doc_id, 'size', e.size, 'copies', e.base + 1) end))))[0])
"""


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, fan_in: int = 128) -> DataFrame:
    """One row a document with the number of copies that the mix takes.

    docs: doc_id, text, source; other columns play no part, whatever their names. Returns doc_id, size, source,
    source_size, target, copies, taken. Every document of a source wants target / source_size copies; the whole part is
    certain, and the fractions are settled by pivotal rounding: chunks of about fan_in documents of one source are
    settled, each leaves at most one, small, document undecided, and these meet again, fan_in chunks at a time, until a source has one
    left, which a coin decides. A source's taken words so differ from its target by less than one document, as a rule a small one.
    A hot source is only more chunks. Coins are hashes of seed and rows, so reruns agree.

    Null text: size 0, no copies. Null source: a source of its own. Null or repeated doc_id: each row is decided by itself.
    No rows: no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # rows that agree are counted before they are shuffled and numbered after, so that they are dealt out like any others
    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("same"))
    runs = same.select("doc_id", "source", "size", "same", F.explode(F.expr("sequence(0L, (same - 1) div 65536)")).alias("run"))
    nth = F.explode(F.expr("sequence(run * 65536, least(same, (run + 1) * 65536) - 1)")).alias("nth")
    rows = materialize(runs.select("doc_id", "source", "size", nth), "mix-sizes")
    targets = materialize(source_targets(rows, weights, cap), "mix-targets").withColumnRenamed("source", "s")
    x = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("x", x).withColumn("base", F.floor("x"))
    rows = rows.withColumn("x", F.col("x") - F.col("base"))
    key = ["source", "source_size", "target"]
    sure = rows.where("x <= 0").select(*key, "doc_id", "size", F.col("base").alias("copies"))
    of = lambda n: F.ceil(n / F.lit(float(fan_in))).cast("long")
    chunks = max(1, -(-(targets.agg(F.max("n_rows")).first()[0] or 0) // fan_in))  # of the largest source
    level = (rows.where("x > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "nth"))
             .withColumn("chunks", of(F.col("n_rows"))).select(*key, "chunks", F.pmod("h", F.col("chunks")).alias("chunk"), F.struct("h", "doc_id", "size", "base", "x").alias("item")))
    done, depth = [sure], 0
    while True:
        u = f"(shiftrightunsigned(xxhash64({int(seed)}, {depth}, acc.c.h, e.h, acc.c.doc_id, e.doc_id, acc.c.x, e.x), 11) / {float(1 << 53)!r}D)"
        start = f"'c', cast(null as {ITEM}), 'out', cast(array() as array<struct<doc_id:bigint,size:bigint,copies:bigint>>))"
        if depth:
            settle = f"aggregate(array_sort(items), named_struct({start}, {STEP.format(u=u)})"
        else:
            by = "array_sort(items, (a, b) -> case when a.size <> b.size then if(a.size > b.size, -1, 1) when a.h <> b.h then if(a.h < b.h, -1, 1) when a.doc_id <> b.doc_id then if(a.doc_id < b.doc_id, -1, 1) else 0 end)"
            u = f"(shiftrightunsigned(xxhash64({int(seed)}, e.h, e.doc_id, acc.rest), 11) / {float(1 << 53)!r}D)"
            settle = f"aggregate({by}, named_struct('y', items[0].x, 'rest', aggregate(items, 0L, (a, e) -> a + e.size), {start}, {FIRST.format(u=u)})"
        folded = level.groupBy(*key, "chunks", "chunk").agg(F.collect_list("item").alias("items"))
        folded = materialize(folded.select(*key, "chunks", "chunk", F.expr(settle).alias("r")).select(*key, "chunks", "chunk", "r.c", "r.out"), "mix-level")
        done.append(folded.select(*key, F.explode("out").alias("o")).select(*key, "o.*"))
        depth += 1
        if chunks == 1:
            break
        chunks = -(-chunks // fan_in)
        level = folded.where("c is not null").withColumn("chunks", of(F.col("chunks"))).select(*key, "chunks", F.pmod("chunk", "chunks").alias("chunk"), F.col("c").alias("item"))
    last = F.col("c.base") + (uniform(F.lit(seed), F.col("c.h"), F.col("c.doc_id")) < F.col("c.x")).cast("long")
    done.append(folded.where("c is not null").select(*key, "c.doc_id", "c.size", last.alias("copies")))
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it; see mix(). Rows that agree in doc_id, size and source share their copies, as evenly as they go, by a hash of their columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__words"), F.col("source").alias("__of")).agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows"))
    rest = [c for c in docs.columns if c != "text"]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    d = docs.withColumn("__key", F.sha2(F.to_json(F.struct(*rest, F.md5(F.encode("text", "UTF-8")).alias("__text")), exact), 256))
    # rows that agree in every column are one row with a count, before they are shuffled; numbering reads keys, never texts
    same = d.groupBy("__key", F.col("doc_id").cast("long").alias("__doc"), size.alias("__size"), F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("__same"))
    same = same.join(taken.where("__all > 0"), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__words")) & F.col("__source").eqNullSafe(F.col("__of")))
    before = F.sum("__same").over(Window.partitionBy("__id", "__words", "__of").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__same")
    own = same.withColumn("__before", before).withColumn("__own", F.expr("__same * (__all div __rows) + greatest(0L, least(__same, __all % __rows - __before))"))
    own = materialize(own.where("__own > 0").select(F.col("__key").alias("__k"), "__own"), "mix-own")
    rows = d.groupBy("__key").agg(F.any_value(F.struct(*docs.columns)).alias("__row")).join(own, F.col("__key") == F.col("__k"))
    runs = rows.select("__row", F.explode(F.expr("sequence(0L, (__own - 1) div 1024)")).alias("__run"), "__own")
    first = runs.where("__run = 0")
    later = runs.where("__run > 0").repartition("__run", F.col("__row.doc_id"))  # of rows that are taken very often
    copies = F.explode(F.expr("sequence(__run * 1024, least(__own, (__run + 1) * 1024) - 1)")).alias("__copy")
    return first.unionByName(later).select("__row", copies).select("__row.*")
