import hashlib

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import fingerprints as fp
from readloom.llm import queries
from readloom.llm.shingles import shingle_hashes


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_hashes_name_shingles():
    a = "One two three four five six seven"
    assert len(shingle_hashes(a)) == 3
    assert set(shingle_hashes("x  y\n" + a)) >= set(shingle_hashes(a.upper()))
    assert len(shingle_hashes("")) == 0 and len(shingle_hashes("two words")) == 1
    assert shingle_hashes("a b")[0] != shingle_hashes("ab")[0]


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 9000)]
    a, b = " ".join(words[:6000]), " ".join(words[2000:])
    x, y = fp.sketch(a), fp.sketch(b)
    A, B = shingles(a), shingles(b)
    assert abs(fp.resemblance(x, y) - jaccard(A, B)) < 0.12
    assert abs(fp.containment(x, y) - len(A & B) / len(A)) < 0.15
    assert abs(fp.distinct(x) / len(A) - 1) < 0.2
    both = np.unique(np.concatenate([shingle_hashes(a), shingle_hashes(b)]))[:256]
    assert (fp.merge(x, y) == both).all() and (fp.from_text(fp.to_text(x)) == x).all()
    assert fp.resemblance(fp.sketch(""), fp.sketch("")) == 1.0 and fp.resemblance(x, fp.sketch("")) == 0.0


def test_merging_groups(spark):
    d = spark.createDataFrame([("g", list(range(i, i + 50))) for i in range(20)] + [("h", [3, 3, 1])], "g string, hashes array<long>")
    got = {r["g"]: r["hashes"] for r in fp.merge_groups(d, "g", k=10).collect()}
    assert got == {"g": list(range(10)), "h": [1, 3]}


def check(docs, rows):
    """docs in descending order of doc_id."""
    by = {r["doc_id"]: r for r in rows}
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        n, r = len(t), by[k]
        edited = t[: n - n // 2] + after[: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))) < 0.15
        assert abs(r["near_next"] - jaccard(shingles(t), shingles(after))) < 0.15


def test_query(spark, sf):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = queries.op2_fingerprints(spark, sf).collect()
    assert len(rows) == len(docs)
    check(docs, rows)
    by = {}
    for r in rows:
        by.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())


def test_odd_rows_and_empty_tables(spark, odd):
    one_each = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = sorted(((r["doc_id"], r["text"] or "") for r in one_each.collect()), reverse=True)
    for parts in (1, 3, 9):
        rows = fp.fingerprint_edits(one_each, parts=parts).collect()
        assert len(rows) == len(docs)
        check(docs, rows)
    assert fp.fingerprint_edits(odd).count() == odd.count()
    assert fp.fingerprint_edits(odd.limit(0)).count() == 0
    assert fp.fingerprint_edits(odd.where(F.col("doc_id") == 6)).first()["near_next"] == 1.0


def test_a_third_without_ids_and_a_third_of_one_id(spark):
    """Ties and nulls are spread over ranges; each row's next is the following one, in one cycle."""
    rows = [(i, f"text {i} of a row that has an id of its own") for i in range(300)]
    rows += [(150, f"text {i} of one id that very many rows have") for i in range(300)] + [(None, f"text {i} of a row without an id") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    step = lambda doc, text, after: (doc, text, after)
    for parts in (1, 4, 12):
        out = fp.with_next(d, step, "doc_id string, text string, after string", parts)
        got = out.collect()
        after = {r["text"]: r["after"] for r in got}
        ids = {t: i for i, t in rows}
        assert len(got) == len(after) == 900 and sorted(after.values()) == sorted(after)
        at, seen = next(t for i, t in rows if i == 299), []
        for _ in range(900):
            seen.append(ids[at])
            at = after[at]
        assert seen == sorted(seen, key=lambda i: -1 if i is None else i, reverse=True)
        if parts == 12:
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
            assert max(sizes) < 3 * 900 / 12
