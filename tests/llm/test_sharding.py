import itertools
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.llm import queries, sharding


def test_flow_moves_the_fewest_bytes():
    for supply, cap in itertools.product([[9, 0, 3], [5, 5, 5], [1, 20, 2]], [[4, 4, 4, 11], [8, 8, 7], [23, 0, 0]]):
        flow = sharding.min_cost_flow(supply, cap)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(cap))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(max(0, s - (cap[i] if i < len(cap) else 0)) for i, s in enumerate(supply))


def test_flow_heeds_costs():
    assert sharding.min_cost_flow([4], [4, 4], lambda i, j: [3, 1][j]) == {(0, 1): 4}
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_query(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    most = max(r["size"] for r in rows)
    assert all(abs(x - sum(sizes) / 16) <= 2 * most for x in sizes)
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["size"] == len(docs[r["doc_id"]].encode()) + 1 for r in rows)


def test_odd_rows_and_empty_tables(spark, odd):
    files, _ = sharding.reshard(odd, F.pmod(F.xxhash64("source"), F.lit(3)), 3, 4)
    got = files.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r["doc_id"]), str(r["text"])) for r in odd.collect())
    assert sorted(map(str, files.select("shard", "slot").distinct().collect())) == sorted(map(str, files.select("shard", "slot").collect()))
    files, plan = sharding.reshard(odd.limit(0), F.lit(0), 3, 4)
    assert files.count() == 0 and plan == []


def test_what_fits_stays(spark):
    d = spark.createDataFrame([(i, "x" * 99) for i in range(40)], "doc_id long, text string")
    files, plan = sharding.reshard(d, F.pmod("doc_id", F.lit(4)), 4, 4)
    assert all(i == j for i, _, _, j in plan)
    assert all(r["shard"] == r["doc_id"] % 4 for r in files.collect())


def test_untouched_shards_keep_their_files(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * 99, i % 4 if i < 160 else 0) for i in range(200)], "doc_id long, text string, shard int")
    d = d.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("doc_id"))) - 1)
    before = {r["doc_id"]: (r["shard"], r["slot"]) for r in d.collect()}
    files, plan = sharding.reshard(d, F.col("shard"), 4, 5, str(tmp_path / "new"), slot=F.col("slot"))
    rows = files.collect()
    assert sharding.untouched(plan, 5) == [1, 2, 3] and {x.name for x in (tmp_path / "new").glob("shard=*")} == {"shard=0", "shard=4"}
    assert all((r["shard"], r["slot"]) == before[r["doc_id"]] for r in rows if r["shard"] in (1, 2, 3))
    assert sorted(r["doc_id"] for r in rows) == list(range(200))
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(40))
    assert sorted(sharding.reshard(d, F.col("shard"), 4, 5)[0].groupBy("shard").count().collect()) == [(s, 40) for s in range(5)]
