import zlib

import pytest
from pyspark.sql import functions as F

from readloom.llm import queries, toxicity


def test_composition_runs_both():
    a = toxicity.Transducer("0", {("0", "x"): ("1", "y", 1.0)})
    b = toxicity.Transducer("0", {("0", "y"): ("0", "z", 2.0)})
    c = toxicity.compose(a, b, "xy")
    assert c.step[("0", "0"), "x"] == (("1", "0"), "z", 3.0) and c.step[("1", "0"), "x"] == (("1", "0"), "x", 0.0)


def test_clauses_not_words():
    s = toxicity.Scorer(dict.fromkeys(toxicity.SEED["I"], 1.0))
    one = lambda t: sum(s.clauses(t))
    assert one("you are an idiot") > one("an idiot") > one("he is not an idiot") > 0
    assert one("they said idiot") < one("idiot")
    assert one("I will kill you") > 0 and one("kill the process") < one("you kill")
    assert s.clauses("a fine day. nothing else") == [] and len(s.clauses("idiot! moron.")) == 2


def test_learned_words_and_prefixes(spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        extra = ["blargh", f"zorp{'abcdefgh'[i % 8]}x"][i // 6 % 2] if toxic else ""
        rows.append((i, " ".join(f"plain{chr(97 + (i * k) % 26)}" for k in range(1, 30)) + f" {extra} more words."))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    got = toxicity.score(d, model).join(y, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert got and all(r["predicted"] == r["toxic"] for r in got)


def test_held_out_labels_are_never_read(spark):
    d = spark.createDataFrame([(i, f"text {i} idiot") for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    y = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    flipped = y.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(d, y) == toxicity.fit(d, flipped)
    assert {r["doc_id"] for r in d.where(toxicity.held_out(F.col("doc_id"))).collect()} == set(held)


def test_rows_of_one_id_speak_once(spark):
    """Documents that share a labelled id add nothing to the training table, so the sample bounds what the driver reads."""
    d = spark.createDataFrame([(i, f"text {i % 40} {'blargh' if i % 4 == 0 else 'fine'}") for i in range(400)], "doc_id long, text string")
    more = d.unionByName(spark.range(5000).selectExpr("4L doc_id", "concat('zzz ', id) text"))
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    assert toxicity.fit(d, y) == toxicity.fit(more, y)


def test_query_on_held_out_rows(spark):
    """Where there are labels enough to learn from."""
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_toxicity(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], y[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in y]
    good, bad = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.93 and sum(t == p for _, t, p in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, nulls)).count() == odd.count()
    assert model.score([]) == pytest.approx(toxicity.Model({}, model.scale).score([]))
