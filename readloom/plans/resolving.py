"""Genome resolution on dimension tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from readloom import catalog
from readloom.operators import planning as P
from readloom.operators import resolving as R
from readloom.plans.registry import query, table
from readloom.sources.snapshots import Snapshots
from readloom.storage import shared_dir


@query("alias_lookup", """
WITH a AS (SELECT lower(r_name) AS alias, min(lower(n_name)) AS target FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), k AS (SELECT DISTINCT lower(n_name) AS name FROM nation),
q AS (SELECT n_nationkey::BIGINT AS id, n_name AS key FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region UNION ALL SELECT 200, 'nowhere')
SELECT id, key, k.name AS canonical FROM q LEFT JOIN a ON lower(key) = alias LEFT JOIN k ON coalesce(target, lower(key)) = k.name""")
def alias_lookup(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("alias")).agg(F.min(F.lower("n_name")).alias("target"))
    q = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("key")).unionByName(r.select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.col("r_name").alias("key")))
    q = q.unionByName(spark.range(1).select(F.lit(200).cast("bigint").alias("id"), F.lit("nowhere").alias("key")))
    return R.by_alias(q, "key", a, n.select(F.col("n_name").alias("name"))).select("id", "key", "canonical")


@query("resolve_cascade", """
WITH q AS (SELECT c_custkey AS id, c_nationkey AS k, c_mktsegment AS domain FROM customer), cache AS (SELECT n_nationkey AS k, 'cache:' || n_name AS ref FROM nation WHERE n_nationkey % 3 = 0),
first AS (SELECT n_nationkey AS k, 'first:' || n_name AS ref FROM nation WHERE n_nationkey % 2 = 0), second AS (SELECT n_nationkey AS k, 'second:' || n_name AS ref FROM nation WHERE n_nationkey % 5 <> 1)
SELECT id, coalesce(a.ref, b.ref, c.ref) AS ref, CASE WHEN a.ref IS NOT NULL THEN 'cache' WHEN b.ref IS NOT NULL THEN 'first' WHEN c.ref IS NOT NULL THEN 'second' END AS source
FROM q LEFT JOIN cache a ON q.k = a.k LEFT JOIN first b ON q.k = b.k AND q.domain <> 'BUILDING' LEFT JOIN second c ON q.k = c.k""")
def resolve_cascade(spark, sf):
    n = table(spark, sf, "nation")
    ref = lambda name, keep: n.where(keep).select(F.col("n_nationkey").alias("k"), F.concat(F.lit(f"{name}:"), "n_name").alias("ref"))
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    d = R.cascade(q, "c_nationkey", ("cache", ref("cache", "n_nationkey % 3 = 0"), "k", None), ("first", ref("first", "n_nationkey % 2 = 0"), "k", F.col("c_mktsegment") != "BUILDING"), ("second", ref("second", "n_nationkey % 5 <> 1"), "k", None))
    return d.select("id", "ref", "source")


@query("best_assembly", """
WITH s AS (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Contig' WHEN 1 THEN 'Scaffold' WHEN 2 THEN 'Chromosome' WHEN 3 THEN 'Complete Genome' WHEN 4 THEN 'Draft' END AS level FROM supplier),
r AS (SELECT *, CASE coalesce(level, 'Contig') WHEN 'Complete Genome' THEN 0 WHEN 'Chromosome' THEN 1 WHEN 'Scaffold' THEN 2 WHEN 'Contig' THEN 3 ELSE 99 END::BIGINT AS rank FROM s)
SELECT s_nationkey, s_suppkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY rank, s_suppkey) AS n FROM r) WHERE n = 1""")
def best_assembly(spark, sf):
    k = F.col("s_suppkey")
    level = F.when(k % 6 == 0, "Contig").when(k % 6 == 1, "Scaffold").when(k % 6 == 2, "Chromosome").when(k % 6 == 3, "Complete Genome").when(k % 6 == 4, "Draft")
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", R.level_rank(level).alias("rank"))
    return R.best_of(s, ["s_nationkey"], ["rank", "s_suppkey"])


@query("json_lineage", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE (props->>'$.k')::BIGINT % 5 WHEN 0 THEN 'bacteria' WHEN 1 THEN 'archaea' WHEN 2 THEN 'eukaryota' WHEN 3 THEN 'eukaryota' ELSE 'bacteria' END AS domain FROM events""")
def json_lineage(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    tax = F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).when(k % 5 == 1, F.array(F.lit(2157), F.lit(2))).when(k % 5 == 2, F.array(F.lit(131567), F.lit(2759))).otherwise(F.array().cast("array<int>"))
    name = F.when(k % 5 == 3, "Candida albicans").otherwise("Unknown sp.")
    return table(spark, sf, "events").select("event_id", k.alias("k"), R.domain_of(tax, name).alias("domain"))


@query("semi_anti_cache", """
SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS cached, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders))::BIGINT AS missing FROM customer GROUP BY 1""")
def semi_anti_cache(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    both = c.join(o, on, "left_semi").select("c_mktsegment", F.lit(1).alias("hit")).unionByName(c.join(o, on, "left_anti").select("c_mktsegment", F.lit(0).alias("hit")))
    return both.groupBy("c_mktsegment").agg(F.count_if(F.col("hit") == 1).alias("cached"), F.count_if(F.col("hit") == 0).alias("missing"))


@query("alias_listing", "SELECT n_regionkey::BIGINT AS region, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def alias_listing(spark, sf):
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))


REQUESTS = """q AS (SELECT 'species' AS kind, n_name AS key, n_regionkey = 0 AS eukaryote FROM nation UNION ALL SELECT 'taxid', s_suppkey::VARCHAR, false FROM supplier UNION ALL SELECT 'accession', CASE WHEN c_custkey % 9 = 0 THEN 'GCX_' ELSE 'GCF_' END || lpad(c_custkey::VARCHAR, 9, '0') || '.1', false FROM customer),
first AS (SELECT 'species' AS kind, lower(n_name) AS key, 'F' || n_nationkey AS accession FROM nation WHERE n_nationkey % 3 = 0),
second AS (SELECT 'species' AS kind, lower(n_name) AS key, 'S' || n_nationkey AS accession FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'taxid', s_suppkey::VARCHAR, 'T' || s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)"""


def requests(spark, sf):
    """Names (those of one region as eukaryotes), taxids and accessions, some of them malformed, and two lookups, of which the first isn't asked about eukaryotes."""
    n, s, k = table(spark, sf, "nation"), table(spark, sf, "supplier"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    plain = lambda d, kind, key, domain=none: d.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), none.alias("name"), none.alias("accession"), none.alias("resolver"), domain.alias("domain"))
    q = plain(n, "species", F.col("n_name"), F.when(F.col("n_regionkey") == 0, "eukaryota")).unionByName(plain(s, "taxid", F.col("s_suppkey")))
    q = q.unionByName(plain(table(spark, sf, "customer"), "accession", F.concat(F.when(k % 9 == 0, "GCX_").otherwise("GCF_"), F.lpad(k.cast("string"), 9, "0"), F.lit(".1"))))
    found = lambda d, kind, key, accession: d.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), key.cast("string").alias("name"), accession.alias("accession"), F.lit("bacteria").alias("domain"))
    name, no = F.col("n_name"), F.col("n_nationkey").cast("string")
    first = found(n.where("n_nationkey % 3 = 0"), "species", F.upper(name), F.concat(F.lit("F"), no))
    second = found(n.where("n_nationkey % 2 = 0"), "species", name, F.concat(F.lit("S"), no)).unionByName(found(s.where("s_suppkey % 7 <> 0"), "taxid", F.col("s_suppkey"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))))
    return q, [("first", first, ["eukaryota"]), ("second", second, [])]


@query("multi_source_resolve", f"""
WITH {REQUESTS}, r AS (SELECT q.kind, CASE WHEN q.kind = 'accession' THEN CASE WHEN q.key LIKE 'GCF%' THEN q.key END WHEN NOT eukaryote AND first.accession IS NOT NULL THEN first.accession ELSE second.accession END AS ref
  FROM q LEFT JOIN first ON q.kind = first.kind AND lower(q.key) = first.key LEFT JOIN second ON q.kind = second.kind AND lower(q.key) = second.key)
SELECT kind, count(ref)::BIGINT AS found, count_if(ref IS NULL)::BIGINT AS missed, min(ref) AS least_ref, max(ref) AS most_ref, round(1.0::DOUBLE / sum(count(ref)) OVER () * count(ref), 9) AS share FROM r GROUP BY 1""")
def multi_source_resolve(spark, sf):
    """Names, taxids and accessions resolved at once, with what is missed."""
    q, lookups = requests(spark, sf)
    d = R.tagged(q, lookups).groupBy("kind").agg(F.count("ref_accession").alias("found"), F.count("miss").alias("missed"), F.min("ref_accession").alias("least_ref"), F.max("ref_accession").alias("most_ref"))
    return P.renormalised(d, "found").select("kind", "found", "missed", "least_ref", "most_ref", F.round("share", 9).alias("share"))


@query("resolution_cache", f"""
WITH {REQUESTS}, r AS (SELECT q.kind, lower(q.key) AS key, CASE WHEN NOT eukaryote AND first.accession IS NOT NULL THEN first.accession ELSE second.accession END AS accession, CASE WHEN NOT eukaryote AND first.accession IS NOT NULL THEN 'first' ELSE 'second' END AS source
  FROM q LEFT JOIN first ON q.kind = first.kind AND lower(q.key) = first.key LEFT JOIN second ON q.kind = second.kind AND lower(q.key) = second.key WHERE q.kind <> 'accession')
SELECT kind, key, accession, source, true AS again FROM r WHERE accession IS NOT NULL""")
def resolution_cache(spark, sf):
    """What a cache holds after half of the requests and then all are resolved, and whether a third time, without any lookup, gives the same for each."""
    q, lookups = requests(spark, sf)
    cache = Snapshots(spark, f"{shared_dir(spark)}/readloom/cache-{uuid.uuid4().hex}", "kind string, key string, name string, accession string, domain string, source string", ("kind", "key"))
    R.through(q.where(F.pmod(F.xxhash64("key"), F.lit(2)) == 0), cache, lookups)
    R.through(q, cache, lookups)
    offline = R.through(q, cache, []).where("cached").select(F.col("kind").alias("k"), F.lower("key").alias("l"), "ref_accession", "ref_source").distinct()
    same = (F.col("kind") == F.col("k")) & (F.col("key") == F.col("l"))
    d = cache.read().join(offline, same, "left")
    return d.select("kind", "key", "accession", "source", F.coalesce((F.col("accession") == F.col("ref_accession")) & (F.col("source") == F.col("ref_source")), F.lit(False)).alias("again"))


def quoted(v) -> str:
    return f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


MOCKS = "o(community, org_pos, name, resolver, abundance, accession, domain) AS (VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in catalog.placed()) + ")"
OTHERS = "a(alias, target) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in catalog.ALIASES.items()) + ")"


#: Communities in order of their names, which tables' rows are dealt to.
NAMES = sorted({r[0] for r in catalog.placed()})
DEALT = "CASE {key} % " + str(len(NAMES)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


def dealt(key):
    return F.get(F.array(*map(F.lit, NAMES)), (key % len(NAMES)).cast("int"))


@query("mock_catalogue", f"""
WITH {MOCKS}, {OTHERS}, g AS (SELECT target, string_agg(alias, ', ' ORDER BY alias) AS aliases FROM a GROUP BY 1), c AS (SELECT {DEALT.format(key='c_custkey')} AS community, count(*)::BIGINT AS samples FROM customer GROUP BY 1)
SELECT community, samples, count(*)::BIGINT AS organisms, round(sum(abundance), 6) AS total, min(aliases) AS aliases FROM o JOIN c USING (community) LEFT JOIN g ON community = target GROUP BY 1, 2""")
def mock_catalogue(spark, sf):
    """Communities with their aliases, weights and samples: customers are samples, dealt to communities."""
    o = catalog.organisms(spark).groupBy("community").agg(F.count(F.lit(1)).alias("organisms"), F.round(F.sum("abundance"), 6).alias("total"))
    a = catalog.aliases(spark).groupBy("target").agg(F.array_join(F.sort_array(F.collect_list("alias")), ", ").alias("aliases"))
    c = table(spark, sf, "customer").groupBy(dealt(F.col("c_custkey")).alias("community")).agg(F.count(F.lit(1)).alias("samples"))
    return c.join(o, "community").join(a, F.col("community") == F.col("target"), "left").select("community", "samples", "organisms", "total", "aliases")


@query("mock_apportion", f"""
WITH {MOCKS}, c AS (SELECT {DEALT.format(key='o_orderkey')} AS community, count(*)::BIGINT AS reads FROM orders GROUP BY 1),
f AS (SELECT *, count(*) OVER (PARTITION BY community) AS k, CASE WHEN abundance > 0 AND floor(abundance * reads) < 1 THEN 1 ELSE floor(abundance * reads)::BIGINT END AS fl, abundance * reads - floor(abundance * reads) AS rem FROM o JOIN c USING (community)),
g AS (SELECT *, reads - sum(fl) OVER (PARTITION BY community) AS gap, row_number() OVER (PARTITION BY community ORDER BY rem DESC, org_pos) AS r, coalesce(sum(greatest(fl - 1, 0)) OVER (PARTITION BY community ORDER BY fl DESC, org_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f)
SELECT community, org_pos, name, (CASE WHEN k = 1 THEN reads WHEN gap > 0 THEN fl + (r <= gap)::INT ELSE fl - least(greatest(fl - 1, 0), greatest(-gap - prior, 0)) END)::BIGINT AS n FROM g""")
def mock_apportion(spark, sf):
    """The orders are reads, dealt to communities and apportioned to their organisms by abundance."""
    c = table(spark, sf, "orders").groupBy(dealt(F.col("o_orderkey")).alias("community")).agg(F.count(F.lit(1)).alias("reads"))
    o = catalog.organisms(spark).join(c, "community")
    return P.apportioned(o, F.col("reads"), idx="org_pos", weight="abundance", by=["community"]).select("community", "org_pos", "name", "n")


@query("assembly_reports", """
SELECT 'GCF_' || s_suppkey AS accession, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 99 ELSE 3 END::BIGINT AS rank, CASE s_suppkey % 4 WHEN 0 THEN '1,2157' WHEN 1 THEN '2759' WHEN 2 THEN '9,2' ELSE '' END AS taxids,
  CASE s_suppkey % 4 WHEN 0 THEN 'archaea' WHEN 1 THEN 'eukaryota' ELSE 'bacteria' END AS domain FROM supplier WHERE s_suppkey % 6 <> 0""")
def assembly_reports(spark, sf):
    """JSON lines with lineages of objects, of numbers, of the classification and without one; each sixth line is cut off."""
    k = F.col("s_suppkey")
    level = F.when(k % 5 == 0, '"Complete Genome"').when(k % 5 == 1, '"Scaffold"').when(k % 5 == 2, '"Draft"').when(k % 5 == 3, '"Contig"').otherwise("null")
    lineage = F.when(k % 4 == 0, ',"lineage":[{"tax_id":1},{"tax_id":2157,"name":"x [1,2]"}]').when(k % 4 == 1, ',"lineage":[2759]').otherwise("")
    more = F.when(k % 4 == 2, ',"classification":{"lineage":[9,{"tax_id":2}]}').otherwise("")
    line = F.concat(F.lit('{"accession":"GCF_'), k.cast("string"), F.lit('","assembly_info":{"assembly_level":'), level, F.lit('},"organism":{"organism_name":"'), F.col("s_name"), F.lit('"'), lineage, F.lit("}"), more, F.lit("}"))
    lines = table(spark, sf, "supplier").select(F.when(k % 6 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    d = R.assemblies(lines)
    return d.select("accession", "name", "rank", F.array_join(F.transform("taxids", lambda t: t.cast("string")), ",").alias("taxids"), "domain")
