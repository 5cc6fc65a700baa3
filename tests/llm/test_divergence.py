import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np

from readloom.llm import divergence, queries


def brute(rows, least=3, top=200):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        n[lang, source].update(found)
        df[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 1), sum(c.values()) + len(kept))) for t in kept}
        q, own = p(whole), {s: p(count[s]) for s in sources}
        for s in sources:
            pair = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-((own[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and own[s][t] > q[t]]
            out += [(lang, s, "pair", x[2], -x[0], i) for i, x in enumerate(sorted(pair), 1)] + [(lang, s, "term", x[2], -x[0], i) for i, x in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def rows(d, **how):
    return sorted(tuple(r) for r in divergence.audit(d, **how).collect())


def made(spark, n=400, seed=5):
    rng = random.Random(seed)
    words = ["a", "B", "b", "été", "Été", "z￿", "z\U00010000", "it's", "x1y", "ß"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    sources, langs = ["s1", "s2", "S3", "ä", "z￿", "z\U00010000", None, ""], ["en", "de", None, "lonely"]
    data = [(rng.choice(langs[:3]), rng.choice(sources[: 1 + rng.randrange(8)]), " ".join(rng.choice(words[: 5 + rng.randrange(120)]) for _ in range(rng.randrange(0, 40)))) for _ in range(n)]
    data += [("lonely", "one", "only here once"), ("lonely", "two", None), ("en", "silent", ""), ("en", "silent", None), ("xx", "single", "t t t")] + [data[0]] * 5
    return data, spark.createDataFrame(data, "lang string, source string, text string")


def test_brute_force(spark):
    data, d = made(spark)
    want = brute(data)
    assert rows(d) == want
    assert {r[4] for r in want if r[0] == "lonely"} == {0}
    assert rows(d.repartition(7), width=3, top=4) == brute(data, top=4)  # many pieces
    assert rows(d, least=1) == brute(data, least=1)


def test_dense_blocks_of_a_piece(spark, monkeypatch):
    data, d = made(spark, 60)
    groups = {}
    pieces = divergence.encoded(divergence.term_counts(d.fillna("")), 1, 4096).where("lang = 'en'").toPandas()
    import pandas as pd

    names = sorted({s or "" for lang, s, _ in data if lang == "en"}, key=str.encode)
    assert len(pieces) >= 1
    piece = pieces.iloc[:1]
    groups = pd.DataFrame({"source": names, "total": [10_000 + 7 * i for i in range(len(names))]})
    want = divergence.compare(piece, groups, 500, 50)
    monkeypatch.setattr(divergence, "CELLS", 20)
    assert divergence.compare(piece, groups, 500, 50).equals(want)


def test_shares_are_exact():
    big = 8 * 10**15
    for c, total, v in ((big - 5, big, 3), (0, big, 10**6), (10**13 + 1, big, 7), (2, 5, 1)):
        assert divergence.shares(np.array([c]), total, v).tolist() == [1 + 10**9 * (c + 1) // (total + v)]


def test_odd_rows_and_empty_table(spark, odd):
    more = odd.unionByName(odd).unionByName(odd)
    assert rows(more) == brute([tuple(r) for r in more.select("lang", "source", "text").collect()])
    assert rows(odd.where("false")) == []


def test_query(spark, sf):
    docs = queries.table(spark, sf, "documents").select("lang", "source", "text").collect()
    assert sorted(tuple(r) for r in queries.op11_divergence(spark, sf).collect()) == brute([tuple(r) for r in docs])
