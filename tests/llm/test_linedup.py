import random

from readloom.llm import linedup, queries


def run(spark, texts, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in linedup.drop_recurring(d, **options).collect()}


def test_variable_fields_are_one_template(spark):
    texts = [f"intro {chr(97 + i) * 5} is here alone today\nPosted by user{i} on 2024-01-{i + 10} at 1{i}:00 from desk\nend {chr(110 + i) * 4}" for i in range(5)]
    got = run(spark, texts)
    assert [got[i]["n_dropped"] for i in range(5)] == [0, 1, 1, 1, 1]
    assert got[0]["text"] == texts[0] and got[1]["text"] == "intro bbbbb is here alone today\nend oooo"


def test_wordy_fields_become_fields(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "anna"]
    texts = [f"own words number {chr(97 + i)}\nThis report was filed by {n} for the northern office of the service" for i, n in enumerate(names)]
    assert [r["n_dropped"] for _, r in sorted(run(spark, texts).items())] == [0, 1, 1, 1, 1, 1]


def test_what_stays(spark):
    same = "Only two different texts hold this rather short line"
    texts = [f"{same}\na", f"{same}\nb", f"{same}\nb", "tiny line\nc", "tiny line\nd", "tiny line\ne", "tiny line\nf"]
    assert all(r["n_dropped"] == 0 for r in run(spark, texts).values())  # two texts and a copy; lines under five tokens


def test_a_leaf_holds_several_templates(spark):
    """Four templates of a quarter each, with the same number of tokens and the same leading words, among unrelated lines."""
    ends = ["alpha beta gamma delta epsilon {} zeta", "one two three four five {} six", "red green blue black white {} grey", "north south east west up {} down"]
    texts = [f"own {chr(97 + k)}{chr(97 + i)}\nThe same start {e.format('name' + chr(97 + i) + 'x')}" for i in range(5) for k, e in enumerate(ends)]
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts += [f"other {word()}\nThe same start {' '.join(word() for _ in range(7))}" for _ in range(100)]
    assert [r["n_dropped"] for _, r in sorted(run(spark, texts).items())] == [0] * 4 + [1] * 16 + [0] * 100


def test_frequent_variants_are_one_template(spark):
    """Each value of the field is in three texts, but for the last two, which are in one."""
    names = [chr(97 + v) * 4 for v in range(12) for _ in range(3)] + ["rare", "seldom"]
    texts = [f"own {chr(97 + i % 26)}{chr(97 + i // 26)}\nThis report was filed by {n} for the northern office of the service" for i, n in enumerate(names)]
    assert [r["n_dropped"] for _, r in sorted(run(spark, texts).items())] == [0] + [1] * 37


def test_short_lines_that_recur(spark):
    texts = [f"own {chr(97 + i)}\nAll rights reserved.\n\nPage {i}" for i in range(4)]
    assert [r["n_dropped"] for _, r in sorted(run(spark, texts, min_exact=1).items())] == [0, 1, 1, 1]
    assert not any(r["n_dropped"] for r in run(spark, texts).values())


def test_rows_of_numbers_stay(spark):
    texts = [f"own {chr(97 + i)}\n{i}2 {i}4 {i}6 {i}8 9{i}\n7 8 9 10 11" for i in range(6)]
    assert [r["n_dropped"] for _, r in sorted(run(spark, texts).items())] == [0] + [1] * 5  # what recurs as it is goes


def test_long_passages_need_two_texts(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = run(spark, [f"a\n{passage}\nz", f"b\n{passage}", "other text"])
    assert [got[i]["n_dropped"] for i in range(3)] == [0, 1, 0] and got[1]["text"] == "b"


def test_query_matches_brute_force_on_equal_lines(spark, sf):
    """Lines that three or more different texts hold are dropped but for the first; no line that only one text holds is, unless its template recurs."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    holders = {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            if len(line.split()) >= 5:
                holders.setdefault(" ".join(line.split()), {}).setdefault(docs[i], i)
    for r in queries.op4_line_dedup(spark, sf).collect():
        left = [" ".join(x.split()) for x in (r["text"] or "").split("\n")]
        gone = [x for x in docs[r["doc_id"]].split("\n") if " ".join(x.split()) not in left]
        assert len(docs[r["doc_id"]].split("\n")) == r["n_lines"]
        for line in (" ".join(x.split()) for x in docs[r["doc_id"]].split("\n")):
            h = holders.get(line, {})
            if len(h) >= 3 and min(h.values()) != r["doc_id"] and docs[min(h.values())] != docs[r["doc_id"]]:
                assert line not in left
        assert len(gone) <= r["n_dropped"]


def test_odd_rows_and_empty_tables(spark, odd):
    got = linedup.drop_recurring(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r["text"]) for r in odd.collect())
    assert linedup.drop_recurring(odd.limit(0)).count() == 0


def test_keys_are_reckoned_once(spark):
    """The place of a pair is worked out in one place of the plan, and short lines give each pair of places after the leading tokens one key."""
    d = spark.createDataFrame([(1, ["a", "b", "c", *(f"t{i}" for i in range(n))]) for n in range(9)], "leaf long, tokens array<string>")
    keyed = d.select("tokens", linedup.keys(d["tokens"], 3, 16).alias("keys"))
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("pmod(") == 1
    for r in keyed.collect():
        n = len(r["tokens"]) - 3
        assert len(set(r["keys"])) == len(r["keys"]) == min(16, n * (n - 1) // 2 if n > 2 else max(n, 1))
