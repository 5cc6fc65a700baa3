"""Ids of whole texts by a BPE with word ends, merged in rounds over many words at a time, and the texts that ids decode to."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

NONE = np.iinfo(np.int32).max


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where Latin-1 prints it, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A tokenizers file of the kind read here: NFC, lower case, words by one pattern, bytes, BPE whose last symbol has a suffix, no decoder.

    Raises ValueError for a file that asks for something else, rather than to give other ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps, before = spec["model"], (spec["normalizer"] or {}).get("normalizers", []), (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "dropout") if model.get(k) is not None] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        kinds = [x["type"] for x in steps], [x["type"] for x in before], spec["post_processor"], spec["decoder"]
        blanks = [x for x in steps if x["type"] == "Replace"]
        if odd or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, None) or blanks[0]["pattern"] != {"Regex": r"\s+"} or before[0]["behavior"] != "Removed" or not before[0]["invert"] or before[1]["use_regex"] or before[1]["add_prefix_space"]:
            raise ValueError(f"{path} asks for steps that aren't known here")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are more than a spelling")
        self.words = regex.compile(before[0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.spelled = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        signs = byte_signs()
        self.inner, self.last = (np.array([vocab[c + end] for c in signs], np.int64) for end in ("", suffix))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(len(self.tokens), -1)
        made[self.merged] = np.arange(len(pairs))
        if (np.maximum(made[keys >> 32], made[keys & 0xFFFFFFFF]) >= np.arange(len(pairs))).any() or len({*self.merged.tolist()}) < len(pairs):
            raise ValueError(f"{path} ranks a pair before the merge that makes its symbol, so that rounds don't equal single merges")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where they don't merge: a binary search over the sorted keys of all pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit bytes.

        The symbols of all words lie in one flat array. In a round, every word merges all places of its lowest-rank pair, from the
        left where they overlap, until no word has a pair left; only ranks beside a merge are looked up anew, and words that are
        done leave the array. That equals one merge at a time, as a pair made by a merge never ranks before that merge.
        """
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size)
        sym = self.inner[flat]
        sym[end - 1] = self.last[flat[end - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_at, done = [], []
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(start, len(sym)))
            low = np.minimum.reduceat(rank, start)
            if (over := low == NONE).any():
                gone = np.repeat(over, length)
                done_at.append(word[gone])
                done.append(sym[gone])
                keep = ~gone
                sym, word, rank = sym[keep], word[keep], rank[keep]
                low, length = low[~over], length[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of a run of overlapping places every other one merges
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            here = hit - np.arange(len(hit))  # a place moves left by the symbols that went before it
            sym, word, rank = sym[keep], word[keep], rank[keep]
            near = np.unique(np.concatenate([here, here[here > 0] - 1]))
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.rank(sym[near], sym[near + 1])
        at, ids = np.concatenate([np.empty(0, np.int64), *done_at]), np.concatenate([np.empty(0, np.int64), *done])
        ids = ids[np.argsort(at, kind="stable")].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(at, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts. Short words that were met are kept, up to about most of them, so that new words alone are merged.

    Texts are taken some at a time, of about chars characters, which bounds the words that are held at once; a longer text is taken by itself.
    """

    def __init__(self, path: str, most: int = 200_000, chars: int = 1 << 20):
        self.v, self.most, self.chars, self.seen = vocabulary(path), most, chars, {}
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in self.v.special.items()}

    def split(self, text: str) -> list[str]:
        """Words, and the spellings of special tokens, which are looked for in the text as it is; a word never equals one, for a pattern's words hold no letters beside other signs.

        Small letters are taken letter by letter, so that a capital sigma becomes the same one at a word's end too. White space
        parts words whatever its kind and length.
        """
        plain = lambda x: self.v.words.findall(unicodedata.normalize("NFC", x).replace("Σ", "σ").lower())
        if self.v.spelled is None or not any(k in text for k in self.special):
            return plain(text)
        out, at = [], 0
        for m in self.v.spelled.finditer(text):
            out += [*plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + plain(text[at:])

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            if some and size + len(text) > self.chars:
                out += self.some(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + self.some(some)

    def some(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.seen) > self.most:
            self.seen = {}
        seen = self.seen
        new = list({w for ws in split for w in ws if w not in seen and w not in self.special})
        now = dict(zip(new, self.v.encode([w.encode() for w in new]), strict=True)) if new else {}
        seen.update((w, ids) for w, ids in now.items() if len(w) < 64)
        look = {**now, **self.special}
        return [b"".join([seen.get(w) or look[w] for w in ws]) for ws in split]


def decoded(ids: bytes, tokens: np.ndarray) -> str:
    """The tokens of ids, special ones too, joined by blanks, which is what a file without a decoder asks for. An id that the vocabulary doesn't have raises IndexError."""
    return " ".join(tokens[np.frombuffer(ids, "<u4")])


def encode(docs: DataFrame, path: str, text: str = "text", back: bool = False, most: int = 100_000, chars: int = 1 << 20) -> DataFrame:
    """docs' columns but text, with ids (little-endian 32-bit, binary) and n_tokens, as the tokenizers library gives them by the file at path without added special tokens, truncation and padding;
    with back also decoded, what decode() makes of ids.

    Null text: empty, which has no ids. Whole texts, whatever their length; rows don't meet, so nothing is shuffled; a task holds an Arrow batch of texts, and ids and
    words of about chars characters of them, besides a store of about most words. path: a file that every executor has. No rows: no rows. Other columns stay, but
    for those named ids, n_tokens or decoded, which are replaced.
    """
    made = [T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if back else [])]
    kept = [f for f in docs.schema if f.name not in (text, "ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(path, most), np.array(vocabulary(path).tokens, dtype=object)
        for batch in batches:
            for a, b in slices(batch.column(0), chars):
                ids = encoder([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()])
                columns = [c.slice(a, b - a) for c in batch.columns[1:]] + [pa.array(ids, pa.binary())]
                if back:
                    columns.append(pa.array([decoded(x, tokens) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + made])

    rows = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType(kept + made))
    return rows.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with decoded, the text of ids by decoded(). Null ids decode to null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = np.array(vocabulary(path).tokens, dtype=object)
        for batch in batches:
            yield pd.Series([None if b is None else decoded(b, tokens) for b in batch], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(run, "string")("ids"))
