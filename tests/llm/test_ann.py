import re

import numpy as np

from readloom.llm import ann, queries


def brute(rows, every=20, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[ids[q]] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in w} & {v for v, _ in got.get(q, [])}) / max(1, len(w)) for q, w in want.items()])


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = ranked(queries.op7_ann(spark, sf)), brute(rows)
    assert recall(got, want) >= 0.95
    x = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s - np.dot(np.array(x[q], float), np.array(x[v], float))) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_the_forest_is_used_on_the_given_tables(spark, sf, monkeypatch):
    """Queries of them are answered by prefixes, not by the root, and recall holds there too: given and spread lengths."""
    levels = []
    kept = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df, name: (levels.append(out) if name == "levels" else None, out)[1] if (out := kept(df, name)) is not None else None)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(8)
    spread = [(i, [float(v * n) for v in x]) for (i, x), n in zip(rows, np.exp(0.5 * rng.normal(size=len(rows))), strict=True)]
    for some in (rows, spread):
        got = ranked(ann.search(spark.createDataFrame(some, "vec_id long, embedding array<double>")))
        assert recall(got, brute(some)) >= 0.95
        found = [r["level"] for r in levels.pop().collect()]
        assert found.count(0) <= len(found) / 5 and (some is spread or set(found) == {-1})


def test_prefixes_of_larger_tables(spark):
    """Enough rows that queries stop above the root, one prefix that is split, and copies."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(3000, 16)), rng.normal(size=16) + 0.05 * rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(1, 16)), 400, axis=0)])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = ranked(ann.search(d, every=200, block=300)), brute(rows, 200)
    assert recall(got, want) >= 0.9
    assert [v for v, _ in got[3600][:3]] == [3601, 3602, 3603]


def test_no_group_holds_all_queries(spark, monkeypatch):
    """30 vectors in 100 copies each, so that 1,500 queries share a few prefixes of a few rows: no group has many queries, and none is lost."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 8))
    rows = [(i, [float(v) for v in x[i % 30]]) for i in range(3000)]
    kind = type(spark.range(0).groupBy())
    groups, kept = [], kind.applyInPandas

    def seen(grouped, f, schema):
        groups.append(grouped._df.groupBy("tree", "slot", *[c for c in ("part", "turn") if c in grouped._df.columns]).agg({"query": "sum"}).agg({"sum(query)": "max"}).first()[0])
        return kept(grouped, f, schema)

    monkeypatch.setattr(kind, "applyInPandas", seen)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ranked(ann.search(d, every=2, trees=8, crowd=200))
    assert groups and max(groups) <= 2 * 200 * 1.5
    want = brute(rows, 2)
    assert all([s for _, s in got[q]] == [s for _, s in want[q]] for q in want) or recall(got, want) >= 0.95


def test_nothing_that_is_larger_in_memory_than_its_file_is_broadcast(spark):
    """Exploded strings of the queries have 24 rows each here and looked small enough for the driver; no broadcast has more rows than there are queries, and none holds vectors."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(1000, 8)))]
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList()
        return [ran.apply(i) for i in range(ran.size())]

    last = max((run.executionId() for run in executions()), default=-1)  # old ones are forgotten, so their number tells nothing
    got = ranked(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=8))
    assert recall(got, brute(rows)) >= 0.9
    runs, held = [run for run in executions() if run.executionId() > last], []
    for run in runs:
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size() if node.name() == "BroadcastExchange" else 0)):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    held.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
        inputs = re.findall(r"BroadcastExchange.*\nInput \[\d+\]: \[(.*)\]", run.physicalPlanDescription())
        assert not any(re.search(r"\b(embedding|q|vec)#", x) for x in inputs)
    assert len(runs) > 5 and max(held, default=0) <= 50


def test_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x *= np.exp(rng.normal(size=(20_000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(ranked(ann.search(d, every=200)), brute(rows, 200)) >= 0.9


def test_odd_vectors_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (40, [nan, 1.0])]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, node string, codes string")
    assert ranked(ann.search(d)) == {0: [(8, 2.0), (20, 1.0), (1, 0.5)], 20: [(8, 2.0), (0, 1.0), (1, 0.5)]}
    assert ann.search(d.limit(0)).count() == 0
