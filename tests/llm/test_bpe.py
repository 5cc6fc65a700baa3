import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm import bpe, queries

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


PIECES = ["a", "aa", "the", "ing", "B", "'S", "'t", "'re", " ", "\n\t", "12", "½", "١", "!", "...", "é", "é", "İ", "Σ", "αΣ ", "ﬁ", "ẞ", "漢字", "\U0001f600", "‍", "\x1c", "\u0085", "\x00", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "Ġ", "</w>", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_like_the_library(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_like_the_library, "t") else test_like_the_library.t
    test_like_the_library.t = t
    assert np.frombuffer(bpe.Encoder(PATH)([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_runs_and_long_words(library):
    rng = np.random.default_rng(3)
    texts = ["a" * k for k in range(80)] + ["ab" * k + "a" for k in range(40)] + ["".join(rng.choice(list("abcdefgh"), 20_000)), "=" * 5_000, "é" * 999]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(PATH)(texts)] == [library[0](t) for t in texts]


def test_store_is_bounded(library):
    e = bpe.Encoder(PATH, most=50)
    for k in range(20):
        texts = [f"word{k} other{i} qx{'z' * i}" for i in range(30)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [library[0](t) for t in texts]
    assert len(e.seen) < 200


def test_odd_rows_and_empty_table(spark, odd, library):
    d = odd.withColumnRenamed("h", "ids_").drop("ids")
    got = bpe.decode(bpe.encode(d, PATH), PATH)
    assert got.columns == [c for c in d.columns if c != "text"] + ["ids", "n_tokens", "decoded"]
    want = sorted((str(r["doc_id"]), len(ids := library[0](r["text"])), np.array(ids, "<u4").tobytes(), library[1](ids)) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got.collect()) == want
    both = bpe.encode(odd.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)), PATH, back=True, most=3, chars=40)
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in both.collect()) == want
    assert bpe.decode(bpe.encode(d.where("false"), PATH), PATH).count() == 0


def test_ids_that_are_not_known(spark):
    d = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f")), (2, None)], "i int, ids binary")
    assert bpe.decode(d.where("i = 2"), PATH).first()["decoded"] is None
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(d, PATH).collect()


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library[0](text)
        assert tuple(got[doc]) == (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library[1](ids).encode()).hexdigest())


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(P.path("byte_bpe_50k.json"))
