import hashlib
import re

import pytest
from pyspark.sql import functions as F

from readloom.llm import fim, queries

WEIRD = [
    "", "a", "one two  three\n", "\u0001\u0002\u0003\u0004 \u0001a\u0002\u0003b\u0002\u0004\u0001", "\u0002\u0003\u0002\u0004", "naïve \U0001f600\U0001f600 x1y2İı", "holds <P> here", "<S", "<M>", "$0 \\1 $x",
    "<<>>MPS<", "\r\n\t\x00z\x7f", "word " * 4000, None,
]


def brute(doc, text, seed=1, rate=90, first=20):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lo, hi = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    spm = h[3] % 100 < first
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows(d, form=fim.Form()):
    out = fim.transform(d, form)
    return out.select("doc_id", "n", "form", F.length("prefix"), F.length("middle"), "output", fim.restore(F.col("output"), F.col("form"), form), "text").collect()


def test_brute_force_and_round_trip(spark):
    d = spark.createDataFrame([(i, t) for i in range(25) for t in WEIRD], "doc_id long, text string")
    got = rows(d)
    assert len(got) == 25 * len(WEIRD)
    for r in got:
        assert tuple(r[1:6]) == brute(r[0], r["text"])
        assert r[6] == r["text"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows_and_empty_table(spark, odd):
    got = rows(odd)
    assert sorted((str(r[0]), *map(str, r[1:6])) for r in got) == sorted((str(r[0]), *map(str, brute(r[0], r[1]))) for r in odd.select("doc_id", "text").collect())
    assert all(r[6] == r["text"] for r in got)
    assert rows(odd.where("false")) == []


def test_other_sentinels(spark):
    form = fim.Form("[pre]", "[suf]", "[mid]", rate=100, suffix_first=50, seed=7)
    d = spark.createDataFrame([(i, f"a[b]c d{i} [pre ]suf] <P>") for i in range(40)], "doc_id long, text string")
    got = rows(d, form)
    assert all(r[6] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"psm", "spm"}
    for marks in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Form(*marks)


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in queries.op12_fim(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc, text in docs:
        n, form, p, m, out = brute(doc, text)
        assert tuple(got[doc]) == (doc, n, form, p, m, sha(out), sha(text or ""))


def test_no_shuffle_and_no_python(spark, sf):
    plan = queries.op12_fim(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
