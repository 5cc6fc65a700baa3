import re
from collections import Counter

import pytest

from readloom.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """By resharing again and again. sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def verify(rows, docs, slack):
    sizes, taken = {}, {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= slack


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op6_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    verify(rows, docs, max(len(WORD.findall(t)) for _, t, _ in docs))
    assert sorted(rows) == sorted(queries.op6_mixing(spark, sf).collect())


def test_a_hot_source_over_levels(spark):
    docs = [(i, "w " * (1 + i * 37 % 90), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(d, fan_in=8).collect()
    assert len(rows) == 900
    verify(rows, docs, 91)


def test_expectations_hold(spark):
    """A document's copies average its fraction: over 400 documents of one size in one chunk tree, and of each size over some seeds."""
    docs = [(i, "w " * (20 if i % 2 else 5), "a" if i < 400 else "b") for i in range(480)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    tot: dict = {}
    for seed in range(4):
        for r in mixing.mix(d, seed=seed, fan_in=16).collect():
            t = tot.setdefault((r["source"], r["size"]), [0, 0, r["target"] / r["source_size"]])
            t[0] += r["copies"]
            t[1] += 1
    for copies, n, want in tot.values():
        assert abs(copies / n - want) < 4 * 0.5 / n**0.5


def test_rows_that_repeat_are_dealt_out(spark):
    """A third of all rows agree in everything: each is decided by itself, chunks stay small, and reruns agree."""
    docs = [(7, "w " * 10, "a")] * 700 + [(i, "w " * (i % 30 + 1), "b") for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(d, fan_in=16).collect()
    assert len(rows) == 1400
    verify(rows, docs, 31)
    assert sorted(rows) == sorted(mixing.mix(d.repartition(7), fan_in=16).collect())
    assert mixing.mixed(d, fan_in=16).count() == sum(r["copies"] for r in rows)


def test_mixed_rows_that_agree_are_spread(spark):
    """A third of all rows agree in every column; others share id, size and source only. Copies are shared evenly, and no row loses its columns."""
    docs = [(7, "w " * 10, "a", 0)] * 3000 + [(8, f"x{i} y", "a", i) for i in range(40)] + [(i, "w " * (i % 30 + 1), "b", i) for i in range(100, 600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(5)
    want: dict = {}
    for r in mixing.mix(d).collect():
        want.setdefault((r["doc_id"], r["size"], r["source"]), []).append(r["copies"])
    got: dict = {}
    for r in mixing.mixed(d).collect():
        assert tuple(r) in docs[:1] or tuple(r) in docs[3000:]
        got.setdefault((r["doc_id"], len(WORD.findall(r["text"])), r["source"]), Counter())[tuple(r)] += 1
    assert {k: sum(v.values()) for k, v in got.items()} == {k: sum(v) for k, v in want.items() if sum(v)}
    assert got[7, 10, "a"][docs[0]] > 1024
    eights = [got.get((8, 2, "a"), Counter())[r] for r in docs[3000:3040]]
    assert max(eights) - min(eights) <= 1


def test_odd_rows_and_empty_tables(spark, odd):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(docs)
    verify(rows, docs, 60_000)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.where("text is not null").count() == sum(r["copies"] for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0
