"""Genome resolution: aliases, cascades of lookups, the best of several candidates, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import naming
from readloom.sources.snapshots import Snapshots
from readloom.storage import written

#: Assembly levels from best to worst, domains by taxid, and parts of names that tell eukaryotes.
LEVELS = ["Complete Genome", "Chromosome", "Scaffold", "Contig"]
DOMAINS = {2: "bacteria", 2157: "archaea", 2759: "eukaryota"}
EUKARYOTES = ["saccharomyces", "candida", "aspergillus", "cryptococcus", "fusarium", "penicillium", "neurospora", "schizosaccharomyces"]


def by_alias(rows: DataFrame, key: str, aliases: DataFrame, known: DataFrame, name: str = "canonical") -> DataFrame:
    """rows with the canonical name of key, case apart: an alias' target, or the key itself, if it is known; null on a miss.

    aliases: alias, target; known: name. Spark broadcasts the dimensions where their size allows.
    """
    a = aliases.select(F.lower("alias").alias("__alias"), F.lower("target").alias("__target"))
    k = known.select(F.lower("name").alias(f"__{name}")).distinct()
    d = rows.join(a, F.lower(key) == F.col("__alias"), "left").withColumn("__key", F.coalesce("__target", F.lower(key)))
    return d.join(k, F.col("__key") == F.col(f"__{name}"), "left").withColumn(name, F.col(f"__{name}")).drop("__alias", "__target", "__key", f"__{name}")


def cascade(rows: DataFrame, key: str, *sources: tuple[str, DataFrame, str, Column | None]) -> DataFrame:
    """rows with ref and source of the first source that has the key. sources: (name, table, its key's column, condition on rows); tables hold ref."""
    d, refs, names = rows, [], []
    for i, (name, t, k, only) in enumerate(sources):
        t = t.select(F.lower(F.col(k).cast("string")).alias(f"__k{i}"), F.col("ref").alias(f"__r{i}"))
        on = F.lower(F.col(key).cast("string")) == F.col(f"__k{i}")
        d = d.join(t, on & only if only is not None else on, "left")
        refs.append(F.col(f"__r{i}"))
        names.append(F.when(F.col(f"__r{i}").isNotNull(), F.lit(name)))
    return d.withColumn("ref", F.coalesce(*refs)).withColumn("source", F.coalesce(*names)).drop(*[c for i in range(len(sources)) for c in (f"__k{i}", f"__r{i}")])


def level_rank(level: Column) -> Column:
    """0 to 3, 99 for an unknown level; none counts as Contig."""
    table = F.create_map(*[F.lit(x) for i, level_ in enumerate(LEVELS) for x in (level_, i)])
    return F.coalesce(F.try_element_at(table, F.coalesce(level, F.lit("Contig"))), F.lit(99)).cast("bigint")


def best_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key; ties must be settled by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def domain_of(taxids: Column, name: Column) -> Column:
    """By the first known taxid of a lineage, else by name, else bacteria."""
    table = F.create_map(*[F.lit(x) for k, v in DOMAINS.items() for x in (k, v)])
    hit = F.try_element_at(F.filter(F.transform(taxids, lambda t: F.try_element_at(table, t.cast("int"))), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(hit, F.when(F.lower(name).rlike("|".join(EUKARYOTES)), "eukaryota"), F.lit("bacteria"))


ASSEMBLY = "accession string, assembly_info struct<assembly_level:string>, organism struct<organism_name:string,lineage:array<string>>, classification struct<lineage:array<string>>"


def assemblies(lines: DataFrame, text: str = "value") -> DataFrame:
    """accession, name, taxids, rank, domain of JSON lines; bad lines and those without an accession are left out.

    A lineage is the organism's, or else the classification's; its elements are objects with a tax_id or bare numbers.
    """
    r = lines.select(F.from_json(text, ASSEMBLY).alias("r")).where("r.accession is not null")
    lineage = F.coalesce("r.organism.lineage", "r.classification.lineage", F.array().cast("array<string>"))
    taxids = F.transform(lineage, lambda x: F.coalesce(F.get_json_object(x, "$.tax_id"), x).try_cast("bigint"))
    d = r.select("r.accession", F.coalesce("r.organism.organism_name", F.lit("")).alias("name"), taxids.alias("taxids"), level_rank(F.col("r.assembly_info.assembly_level")).alias("rank"))
    return d.withColumn("domain", domain_of(F.col("taxids"), F.col("name")))


#: Columns of a lookup: what kind of key it answers (species or taxid), the key, and the genome.
LOOKUP = ["kind", "key", "name", "accession", "domain"]


def tagged(requests: DataFrame, lookups: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """requests with ref_name, ref_accession, ref_source, ref_domain of the genome each asks for, and miss, why there is none.

    requests: kind, key, name, accession, resolver, domain; further columns stay. kind accession: a well-formed key is its own answer, of the
    source ncbi. kind organism: one with an accession is its own answer, of its resolver; another is looked up as a species. species and taxid are looked
    up by key, case apart, in the first of lookups that has it. lookups: (source, table of LOOKUP, domains that it isn't asked about); a lookup that
    holds a column source gives that. Other kinds, null keys and keys that no lookup has are misses. Repeated requests stay as often as they come.

    One join: lookups are put together by key first, a short list a key, so that a hot key's requests can be split.
    """
    all_ = None
    for rank, (source, t, without) in enumerate(lookups):
        own = F.coalesce(F.col("source"), F.lit(source)) if "source" in t.columns else F.lit(source)
        t = t.select("kind", F.lower("key").alias("key"), F.struct(F.lit(rank).alias("rank"), "accession", "name", own.alias("source"), "domain", F.array(*map(F.lit, without)).cast("array<string>").alias("without")).alias("r"))
        all_ = t if all_ is None else all_.unionByName(t)
    best = all_.where("r.accession is not null").groupBy(F.col("kind").alias("__kind"), F.col("key").alias("__key"), F.col("r.rank").alias("rank")).agg(F.min("r").alias("r"))
    best = best.groupBy("__kind", "__key").agg(F.array_sort(F.collect_list("r")).alias("__refs"))  # one a lookup at most
    kind = F.when(F.col("kind") == "organism", F.when(F.col("accession").isNull(), F.lit("species"))).when(F.col("kind").isin("species", "taxid"), F.col("kind"))
    d = requests.withColumn("__asked", kind).withColumn("__lower", F.lower("key"))
    d = d.join(best, (F.col("__asked") == F.col("__kind")) & (F.col("__lower") == F.col("__key")), "left")
    hit = F.get(F.filter("__refs", lambda r: ~F.coalesce(F.array_contains(r["without"], F.col("domain")), F.lit(False))), F.lit(0))
    d = d.withColumn("__hit", hit)
    formed = (F.col("kind") == "accession") & naming.is_accession(F.col("key"))
    known = (F.col("kind") == "organism") & F.col("accession").isNotNull()
    pick = lambda direct, organism, found: F.when(formed, direct).when(known, organism).otherwise(found)
    d = d.withColumns({
        "ref_name": pick(F.coalesce("name", "key"), F.coalesce("name", "key"), F.col("__hit.name")),
        "ref_accession": pick(F.col("key"), F.col("accession"), F.col("__hit.accession")),
        "ref_source": pick(F.lit("ncbi"), F.col("resolver"), F.col("__hit.source")),
        "ref_domain": pick(F.coalesce("domain", F.lit("bacteria")), F.coalesce("domain", F.when(F.col("resolver") == "ncbi", "eukaryota").otherwise("bacteria")), F.col("__hit.domain")),
    })
    why = F.when(F.col("kind") == "accession", "malformed accession").when(F.col("kind").isin("organism", "species", "taxid"), "not found").otherwise("unknown kind")
    return d.withColumn("miss", F.when(F.col("ref_accession").isNull(), why)).drop("__asked", "__lower", "__kind", "__key", "__refs", "__hit")


def through(requests: DataFrame, cache: Snapshots, lookups: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """tagged() with the cache as the first lookup, and cached, whether it came from there; what other lookups have found for a key is put into the cache.

    cache: a Snapshots of LOOKUP and source, by kind and key. Without lookups it is an offline resolution.
    """
    d = tagged(requests, [("cache", cache.read().withColumn("source", F.concat(F.lit("cache:"), "source")), []), *lookups])
    d = d.withColumn("cached", F.coalesce(F.startswith("ref_source", F.lit("cache:")), F.lit(False))).withColumn("ref_source", F.regexp_replace("ref_source", "^cache:", ""))
    d = written(d, "resolved")
    asked = F.when(F.col("kind") == "taxid", "taxid").otherwise("species")
    found = d.where("miss is null and not cached").where(F.col("kind").isin("species", "taxid") | ((F.col("kind") == "organism") & F.col("accession").isNull()))
    cache.put(found.select(asked.alias("kind"), "key", F.col("ref_name").alias("name"), F.col("ref_accession").alias("accession"), F.col("ref_domain").alias("domain"), F.col("ref_source").alias("source")))
    return d
