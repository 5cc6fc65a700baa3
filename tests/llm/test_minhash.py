import random
from collections import defaultdict

import numpy as np

from readloom.llm import common, components, minhash, queries
from readloom.llm.components import connected_components


def shingles(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, least=0.8):
    """doc_id -> smallest doc_id of its class."""
    sets = [(i, shingles(t or "")) for i, t in docs]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if (not x and not y) or (x | y and len(x & y) >= least * len(x | y)):
                up[top(a)] = top(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[top(k)].append(i)
    return {i: min(v) for v in low.values() for i in v}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, 300, dtype=np.uint64)
    w = rng.uniform(0.5, 5, 300)
    v = w * rng.uniform(0.5, 2, 300)
    m = 4000
    s = minhash.prob_minhash([(h, w), (h, v), (h[:200], w[:200]), (h[:0], w[:0])], m)
    want = sum(1 / np.maximum(w / w[i], v / v[i]).sum() for i in range(300))
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert abs((s[0] == s[2]).mean() - sum(1 / (w / w[i]).sum() for i in range(200))) < 0.04
    assert not s[3].any()
    alone = minhash.prob_minhash([(h[:200], w[:200])], m)
    assert (alone[0] == s[2]).all()  # a set's signature doesn't depend on its company


def test_query_matches_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_minhash_dedup(spark, sf).collect()}
    assert got == brute(docs)


def test_groups_of_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for c in range([2, 3, 40, 9, 1, 25][g]):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()}
    assert got == brute(docs)
    kept = [r["doc_id"] for r in minhash.deduplicated(d).collect()]
    assert sorted(kept) == sorted(set(brute(docs).values()))


def test_a_large_group_a_little_under_the_threshold(spark):
    """Thousands of edits of one text, most of them 0.55 to 0.85 alike: a few classes, and very many texts alone."""
    rng, base, texts = random.Random(11), [f"w{i}" for i in range(150)], set()
    while len(texts) < 2000:
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            words[rng.randrange(150)] = f"new{rng.randrange(400)}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    names: dict = {}
    at = [(i, names.setdefault(x, len(names))) for i, t in enumerate(texts) for x in shingles(t)]
    m = np.zeros((len(texts), len(names)), np.float32)
    m[tuple(np.array(at).T)] = 1
    both, n = m @ m.T, m.sum(axis=1)
    near = both * 1.8 >= 0.8 * (n[:, None] + n) - 1e-3
    want, left = np.arange(len(texts)), True
    while left:
        low = np.where(near, want, len(texts)).min(axis=1)
        left, want = bool((low < want).any()), low
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 100 < len(set(want.tolist())) < 1900
    assert got == dict(enumerate(want.tolist()))


def test_prefix_pairs_lose_no_link(spark):
    rng, texts = random.Random(3), []
    for _ in range(150):
        words = [f"w{i}" for i in range(rng.choice([30, 40, 42]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    nodes = spark.createDataFrame([(i, len(s), i % 7) for i, s in enumerate(sets)], "uid long, n int, label long")
    got = {(r["p"]["uid"], r["q"]["uid"]) for r in minhash.prefix_pairs(nodes, d, 5, 0.8).collect()}
    every = [(i, j) for j in range(len(sets)) for i in range(j) if i % 7 != j % 7]
    links = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links and links <= got and len(got) < len(every) / 2


def test_texts_of_shared_passages_are_not_paired_with_each_other(spark):
    """Texts of 8 of 12 passages, so that every shingle is common: what is listed grows no faster than texts and links."""

    def listed(n):
        rng = random.Random(7)
        passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
        texts = sorted({" ".join(passages[i] for i in rng.sample(range(12), 8)) for _ in range(n)})
        names: dict = {}
        at = np.array([(i, names.setdefault(x, len(names))) for i, t in enumerate(texts) for x in shingles(t)])
        m = np.zeros((len(texts), len(names)), np.float32)
        m[tuple(at.T)] = 1
        size = m.sum(axis=1)
        alike = np.triu(m @ m.T * 1.8 >= 0.8 * (size[:, None] + size) - 1e-3, 1)
        d = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
        nodes = spark.createDataFrame([(i, int(k), i) for i, k in enumerate(size)], "uid long, n int, label long")
        got = [tuple(sorted((r["a"], r["b"]))) for r in minhash.prefix_pairs(nodes, d, 5, 0.8).selectExpr("p.uid a", "q.uid b").collect()]
        links = set(map(tuple, np.argwhere(alike).tolist()))
        assert links <= set(got)
        return texts, len(links), len(got)

    texts, links, rows = listed(400)
    _, more, most = listed(1600)
    print(f"400 texts: {links} links, {rows} listed; 1600: {more} links, {most} listed")
    assert most / rows <= (1600 + more) / (400 + links) and most < 1600 * 1599 / 2 / 20
    docs = list(enumerate(texts))
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)


def test_outliers_of_a_group_of_near_copies_are_not_paired_with_its_members(spark):
    """Texts of one class with one or two edits, four alone with three, and others alone with four to six: close to all of them, alike with none, though other texts quote their edits."""
    rng, base, texts = random.Random(13), [f"w{i}" for i in range(150)], {}
    for i in range(600):
        words = list(base)
        edits = rng.choice([1, 2]) if i < 450 else 3 if i < 454 else rng.choice([4, 5, 6])
        for at in rng.sample(range(150), edits):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.setdefault(" ".join(words), edits)
        if edits > 3:  # another text quotes what is new, so that all shingles are shared ones
            quoted = [" ".join(words[max(at - 4, 0) : at + 5]) for at in range(150) if words[at] != base[at]]
            texts[" ".join(quoted + [f"own{rng.randrange(10**6)}" for _ in range(90)])] = edits
    sets = [shingles(t) for t in texts]
    label = [0 if k < 3 else i + 1 for i, k in enumerate(texts.values())]
    every = [(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j]]
    links = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    d = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    nodes = spark.createDataFrame([(i, len(s), label[i]) for i, s in enumerate(sets)], "uid long, n int, label long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in minhash.prefix_pairs(nodes, d, 5, 0.8).selectExpr("p.uid a", "q.uid b").collect()}
    print(f"{len(every)} pairs, {len(links)} links, {len(got)} listed")
    assert links and links <= got and len(got) < len(every) / 20


def test_what_is_settled_is_not_reckoned_again(spark, monkeypatch):
    """A class and texts that share buckets with it, alike with none: labels don't change after the first links, so what is open is found once and no further pivots are tried."""
    made = []

    def noted(df, name, **options):
        made.append(name)
        return common.materialize(df, name, **options)

    monkeypatch.setattr(minhash, "materialize", noted)
    monkeypatch.setattr(components, "materialize", noted)
    rng, base, docs = random.Random(17), [f"w{i}" for i in range(150)], []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), 1 if i < 80 else rng.choice([4, 5, 6])):
            words[at] = f"new{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and 10 < len(set(got.values())) <= 41
    print(made)
    assert made.count("early") == 1  # it comes to the exact join of what is open
    assert made.count("named") == made.count("mixed") == made.count("open") == 1
    made.clear()
    star = connected_components(spark.createDataFrame([(1, i) for i in range(2, 50)] + [(60, 51), (51, 61), (60, 51)], "a long, b long"))
    assert {r["node"]: r["component"] for r in star.collect()} == {**dict.fromkeys(range(1, 50), 1), 51: 51, 60: 51, 61: 51} and star.count() == 52
    assert made.count("edges") == 1  # stars take no round


def test_components_of_random_edges(spark):
    rng = random.Random(19)
    for nodes, edges in ((300, 200), (300, 330), (60, 900)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
        up = list(range(nodes))
        for _ in range(nodes):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        got = [(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()]
        assert sorted(got) == [(i, up[i]) for i in sorted({x for p in pairs if p[0] != p[1] for x in p})]


def test_repeated_passages_match_brute_force(spark):
    """Pairs of nearly equal sets whose repeat counts are opposite."""
    rng, docs = random.Random(9), []
    for _ in range(60):
        x, y = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        docs += [" ".join(x * 20 + y), " ".join(x + y * 20)]
    docs = list(enumerate(docs))
    want = brute(docs)
    assert len(set(want.values())) == 60
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()} == want


def test_odd_rows_and_empty_tables(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[6] == 6 and by[7] == 7
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 5  # 1, 3, 6, 7 and the text without id
    assert minhash.near_duplicates(odd.limit(0)).count() == 0 and minhash.deduplicated(odd.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 7), (200, 300), (300, 250)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
