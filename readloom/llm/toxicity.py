"""Toxicity by a weighted finite-state pattern grammar over clauses, with a lexicon and a scale learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Seed words of the lexical transducer, by symbol, in English, German, French and Spanish. I insult, T threat, Y target, N negation, R reported speech.
SEED = {
    "I": "idiot idiots moron morons scum trash loser losers stupid worthless pathetic disgusting clown dumb vermin filth imbecile cretin idioten dumm abschaum ungeziefer versager imbécile crétin ordure vermine idiota idiotas imbécil estúpido escoria".split(),
    "T": "kill hurt destroy beat shoot stab burn hang murder crush töten umbringen erschießen verprügeln tuer frapper égorger matar golpear apuñalar".split(),
    "Y": "you your yours u he him she her they them these those people everyone du dich dir ihr euch toi vous vos ustedes vosotros".split(),
    "N": "not no never neither nor isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine nie niemals ne pas jamais nunca jamás".split(),
    "R": "said says say told wrote claimed claims quoted reported reports according called sagte sagt schrieb laut déclaré écrit selon dijo dice escribió según".split(),
}
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+")
STOPS = frozenset(".!?;:\n")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: step[state, symbol] = (state, output, weight); absent: the state stays, the symbol passes, weight 0."""

    start: str
    step: dict = field(default_factory=dict)

    def move(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.step.get((state, symbol), (state, symbol, 0.0))


def compose(a: Transducer, b: Transducer, alphabet: str) -> Transducer:
    """a, then b on what a puts out; weights add up. States are pairs, found from the start on."""
    start, step = (a.start, b.start), {}
    todo, seen = [start], {start}
    while todo:
        s = todo.pop()
        for x in alphabet:
            p, y, v = a.move(s[0], x)
            q, z, w = b.move(s[1], y)
            step[s, x] = ((p, q), z, v + w)
            if (p, q) not in seen:
                seen.add((p, q))
                todo.append((p, q))
    return Transducer(start, step)


#: Input: I T Y N R and o for other words. Output also i and t (under negation or in reported speech).
ALPHABET, INNER = "ITYNRo", "ITYNRoit"


def grammar() -> Transducer:
    """Negation reaches two words on; reported speech the rest of its clause; a threat counts with a target near it, an insult
    counts alone and more with one. Weights are added to the log of what the lexicon gives."""
    soft = math.log(0.8)
    negation = Transducer("0", {("0", "N"): ("2", "N", 0.0), **{("2", x): ("1", x, 0.0) for x in "TYRo"}, **{("1", x): ("0", x, 0.0) for x in "TYRo"}, ("2", "N"): ("2", "N", 0.0), ("1", "N"): ("2", "N", 0.0), ("2", "I"): ("1", "i", soft), ("1", "I"): ("0", "i", soft), ("2", "T"): ("1", "t", 2 * soft), ("1", "T"): ("0", "t", 2 * soft)})
    reported = Transducer("0", {("0", "R"): ("1", "R", 0.0), ("1", "I"): ("1", "i", soft), ("1", "T"): ("1", "t", soft), ("1", "i"): ("1", "i", soft)})
    target = Transducer("0", {("0", "Y"): ("1", "Y", 0.0), ("1", "I"): ("1", "I", math.log(1.1)), ("1", "i"): ("1", "i", math.log(1.05)), ("0", "T"): ("0", "t", math.log(0.3)), ("0", "t"): ("0", "t", math.log(0.3))})
    return compose(compose(negation, reported, INNER), target, INNER)


class Scorer:
    """Clause weights of whole texts, by a lexicon of words and prefixes (ending in *) and the composed grammar."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.machine, self.seen, self.most = lexicon, grammar(), {}, most
        self.fixed = {w: s for s, ws in SEED.items() if s != "I" for w in ws}

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.seen.get(word)
        if found is None:
            w = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
            found = ("I", w) if w > 0 else (self.fixed.get(word, "o"), 1.0)
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[word] = found
        return found

    def clauses(self, text: str) -> list[float]:
        """The weight of each clause that the grammar matches; a clause ends at a stop or a line's end."""
        out, state, total, any_ = [], self.machine.start, 0.0, False
        step, seen = self.machine.step, self.seen
        for word in WORDS.findall(text.lower()):
            if word[0] in STOPS:
                if any_:
                    out.append(total)
                state, total, any_ = self.machine.start, 0.0, False
                continue
            sym, w = seen.get(word) or self.symbol(word)
            if sym == "o" and state == self.machine.start:
                continue
            state, _, v = step[state, sym]
            if sym in "IT":
                total, any_ = total + w * math.exp(v), True
        return [*out, total] if any_ else out


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def signals(weights: list[float]) -> tuple[float, float]:
    return max(weights, default=0.0), math.log1p(sum(weights))


@dataclass
class Model:
    lexicon: dict[str, float]
    scale: tuple[float, float, float]

    def score(self, weights: list[float]) -> float:
        m, s = signals(weights)
        z = self.scale[0] + self.scale[1] * m + self.scale[2] * s
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, chance: float = 0.05) -> Model:
    """Learn a lexicon and a scale from labelled rows that aren't held out.

    docs: doc_id, text. labels: doc_id, toxic. At most sample rows are used, those of the smallest hash of doc_id; of documents that
    share a doc_id the smallest text is used. On about
    three quarters, words and prefixes are kept that toxic documents hold far more often, if a likelihood-ratio test says so
    at the level chance, shared by all that were tested (so the evidence that is asked for follows the number of words, in
    small and large samples alike), without prefixes that a longer entry explains better. On the rest, which did not choose
    them, a logistic scale is fitted to the grammar's signals. No labels: the seed insults and a fixed scale. The lexicon is
    as large as the sample's significant words, which the sample bounds.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    picked = materialize(known.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample), "labelled")
    train = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic"), F.any_value("h").alias("h"))
    train = train.select("text", "toxic", (F.pmod(F.col("h"), F.lit(4)) == 0).alias("scale"))
    train = materialize(train, "training")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                words = {w for w in WORDS.findall(text.lower()) if w[0] not in STOPS}
                (toxic if y else clean).update({f for w in words for f in features(w)})
                n[y > 0] += 1
        yield pd.DataFrame({"f": ["", *toxic], "a": [n[1], *toxic.values()], "b": 0})
        yield pd.DataFrame({"f": ["", *clean], "a": 0, "b": [n[0], *clean.values()]})

    # copies of a text speak once
    counts = train.where("not scale").select("text", "toxic").distinct().mapInPandas(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = materialize(counts.where("a >= 3"), "counts")
    n = counts.where("f = ''").first() or {"a": 0, "b": 0}
    lexicon = dict.fromkeys(SEED["I"], 1.0)
    if n["a"] and n["b"]:
        a, b, na, nb = F.col("a"), F.col("b"), float(n["a"]), float(n["b"])
        term = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
        rate = (a + b) / (na + nb)
        ratio = 2 * (term(a, rate * na) + term(b, rate * nb) + term(na - a, (1 - rate) * na) + term(nb - b, (1 - rate) * nb))
        odds = F.ln(((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1)))
        tested = counts.where("f <> ''")
        evidence = NormalDist().inv_cdf(1 - chance / 2 / max(1, tested.count())) ** 2
        best = tested.select("f", "a", "b", ratio.alias("g"), odds.alias("w")).where((F.col("g") >= evidence) & (F.col("w") >= 2.0))
        lexicon = lexicon | {f: w / 4 for f, w in unexplained(best.collect())}  # significant words of the sample

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in batches:
            got = [signals(scorer.clauses(t)) for t in batch["text"]]
            yield pd.DataFrame({"m": [x[0] for x in got], "s": [x[1] for x in got], "y": batch["toxic"].to_numpy()})

    points = train.where("scale").mapInPandas(measure, "m double, s double, y int").toPandas()  # at most a quarter of sample
    return Model(lexicon, logistic(points) if len(points) and 0 < points["y"].sum() < len(points) else (-4.0, 4.0, 4.0))


def unexplained(entries: list) -> list[tuple[str, float]]:
    """(f, w) of entries, without prefixes that owe most of their toxic documents to one longer entry, which clean documents hold less often."""
    longer: dict[str, list] = {}
    for x in entries:
        for k in PREFIXES:
            if len(x["f"].removesuffix("*")) >= k and x["f"] != x["f"][:k] + "*":
                longer.setdefault(x["f"][:k] + "*", []).append(x)
    return [(r["f"], r["w"]) for r in sorted(entries, key=lambda r: r["f"]) if not any(x["a"] >= 0.6 * r["a"] and x["b"] * r["a"] < r["b"] * x["a"] for x in longer.get(r["f"], []))]


def logistic(points: pd.DataFrame, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float, float]:
    """Newton's method on (1, m, s), slightly drawn towards zero."""
    x = np.column_stack([np.ones(len(points)), points["m"], points["s"]])
    y, w = points["y"].to_numpy(float), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with score (0 to 1) and predicted. Whole texts; null and empty texts get the score of no clause.

    Columns of docs named score or predicted are replaced. The model is a bounded lexicon and three numbers.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.lexicon)
        for batch in texts:
            yield pd.Series([model.score(scorer.clauses(t)) if t else model.score([]) for t in batch], dtype=float)

    scored = docs.select(*kept, rate(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
