"""Toxicity from two class-conditional Kneser-Ney models with shared backoff counts.

Both classes have their own discounted counts of words and word pairs (texts that hold them). The mass that a discount
frees goes to counts that the classes share: for a word, in how many contexts it follows another; for a pair,
its second word's class chance at a mass of PRIOR shared counts. An expression that is rare in both classes so weighs
nearly the same in both and drops out of the comparison; none is cut away.

A text is scored by the difference of the two log-likelihoods divided by its length, together with
two more figures of the same log ratios: the mean of its telling expressions and the second largest. The words of
toxic texts are few among many, and without these two the noise of all others hides them. A
logistic curve fitted on labelled texts that gave no counts maps the three to a score between 0 and 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import blocks, fold, table, text_bytes
from shelfspark.session import ship, written

STRIP = b".,;:!?\"'()[]{}*#$%&|<>"
DISCOUNT = 0.75
PRIOR = 10.0  # shared pseudo-count of an expression
SAMPLE = 4000  # labelled texts per class, about; the documented bound of the fit
FLUSH = 200_000
CUT = 0.3  # score from which a text counts as toxic
STRONG = 1.0  # log ratio from which an expression counts as telling


def words_of(data: bytes) -> Iterator[bytes]:
    for words in blocks(data):
        for w in words:
            w = w.strip(STRIP)
            if w:
                yield w


def sample_of(labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """About `bound` labelled ids per class of the learning folds, drawn by a hash of the id: (doc_id, toxic)."""
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    lab = lab.where(fold(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = lab.agg(F.count_if(F.expr("toxic = 1")).alias("n1"), F.count_if(F.expr("toxic = 0")).alias("n0")).first()
    part = lambda k: min(1.0, bound / max(1, n[k]))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    return lab.where(draw < F.when(F.col("toxic") == 1, part("n1")).otherwise(part("n0")) * 1_000_000)


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts per class that hold a word (a is empty) or a word pair: (a, b, n0, n1)."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pd.DataFrame:
        grams = list(seen[0].keys() | seen[1].keys())
        out = pd.DataFrame({"a": [a for a, _ in grams], "b": [b for _, b in grams], "n0": [seen[0][g] for g in grams], "n1": [seen[1][g] for g in grams]})
        seen[0].clear()
        seen[1].clear()
        return out

    for pdf in batches:
        for data, toxic in zip(pdf["t"], pdf["toxic"]):
            words = list(words_of(data))
            seen[toxic].update({(b"", w) for w in words})
            seen[toxic].update(set(zip(words, words[1:])))
            if len(seen[0]) + len(seen[1]) > FLUSH:
                yield rows()
    if seen[0] or seen[1]:
        yield rows()


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (w, k, x) and pairs (k, x) from (a, b, n0, n1): logs of toxic by ordinary, k a 64-bit key of the words."""
    words = counts.where(F.octet_length("a") == 0).select(F.col("b").alias("w"), "n0", "n1")
    pairs = counts.where(F.octet_length("a") > 0)
    follows = pairs.groupBy(F.col("b").alias("w")).agg(F.count(F.lit(1)).alias("follows"))
    words = written(words.join(follows, "w", "left").fillna(0, ["follows"]), "words")
    t = words.agg(F.count(F.lit(1)).alias("v"), *[F.sum(c).alias(c) for c in ("n0", "n1", "follows")]).first()  # one row
    total = [max(1.0, t[f"n{c}"] or 0) for c in (0, 1)]
    both = sum(total)
    kept = lambda c: F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))
    shared = F.col("follows") * F.lit(DISCOUNT * t["v"] / both / max(1.0, t["follows"] or 0)) + F.lit(PRIOR / both)
    words = words.withColumns({f"p{c}": kept(c) / F.lit(total[c]) + shared for c in (0, 1)}).withColumn("k", F.xxhash64("w"))
    first = words.select(F.col("w").alias("a"), F.col("k").alias("ka"))
    second = words.select(F.col("w").alias("b"), F.col("k").alias("kb"), "p0", "p1")
    # the mass that the discounts free is PRIOR shared counts in both classes: it cancels where a pair is unknown
    mass = lambda c: kept(c) * F.lit(both / (2 * total[c])) + F.lit(2 * PRIOR) * F.col(f"p{c}") / (F.col("p0") + F.col("p1"))
    met = pairs.join(first, "a").join(second, "b").select(F.shiftleft("ka", 1).bitwiseXOR(F.col("kb")).alias("k"), F.log(mass(1) / mass(0)).alias("x"))
    return words.select("w", "k", F.log(F.col("p1") / F.col("p0")).alias("x")), met


class Model:
    """Log ratios of the two classes for the expressions of the sample, and the curve of the score."""

    def __init__(self, words: list[bytes], keys: np.ndarray, ratio: np.ndarray, pairs: np.ndarray, pair_ratio: np.ndarray):
        self.words = {w: i for i, w in enumerate(words)}
        self.keys, self.ratio = np.append(keys, 0).astype(np.int64), np.append(ratio, 0.0)
        order = np.argsort(pairs)
        self.pairs, self.pair_ratio = pairs[order], pair_ratio[order].astype(np.float32)
        self.curve = np.array([0.0, 0.0, 0.0, 0.0])

    def features(self, data: bytes) -> tuple[float, float, float]:
        """Mean log ratio, mean of the telling ones, second largest (of a text of one word: of that word, halved)."""
        unknown = len(self.words)
        total = strong = 0.0
        count, top, last = 0, [], None
        for words in blocks(data):
            ids = [self.words.get(w.strip(STRIP), unknown) for w in words]
            if not ids:
                continue
            arr = np.array(ids if last is None else [last, *ids], dtype=np.int64)
            x = self.ratio[arr]
            if len(self.pairs) and len(arr) > 1:
                key = (self.keys[arr[:-1]] << 1) ^ self.keys[arr[1:]]
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                met = (self.pairs[at] == key) & (arr[:-1] < unknown) & (arr[1:] < unknown)
                x[1:] = np.where(met, self.pair_ratio[at], x[1:])
            if last is not None:
                x = x[1:]
            last = ids[-1]
            total += float(x.sum())
            strong += float(x[x > STRONG].sum())
            count += len(x)
            top = sorted([*top, *np.partition(x, -2)[-2:]] if len(x) > 1 else [*top, x[0]])[-2:]
        if not count:
            return 0.0, 0.0, 0.0
        return total / count, strong / count, float(top[0]) if len(top) > 1 else float(top[0]) / 2

    def score(self, data: bytes) -> float:
        z = float(self.curve[0] + np.dot(self.curve[1:], shaped(np.array([self.features(data)]))[0]))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def shaped(f: np.ndarray) -> np.ndarray:
    """Features on a bounded scale, so that no single text decides the curve."""
    return np.column_stack([np.clip(f[:, 0], -1, 1) * 4, np.clip(f[:, 1], 0, 0.2) * 20, np.clip(f[:, 2], -1, 6)])


def fit_curve(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; without both classes, a steep curve on the second largest."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-8.0, 1.0, 1.0, 3.0])
    x = np.column_stack([np.ones(len(y)), shaped(f)])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Learn from at most about `bound` labelled texts per class of the folds 0, 1 and 3.

    Two thirds of them give the counts, one third the curve. Null labels, null ids and null
    texts teach nothing; an id labelled twice takes its larger label. The model holds all
    expressions of the texts that gave counts; they are collected and broadcast, so `bound` bounds it.
    """
    ship(docs.sparkSession)
    chosen = F.broadcast(sample_of(labels, bound))  # about 2 * bound rows
    text = docs.where("text IS NOT NULL").select("doc_id", text_bytes().alias("t")).join(chosen, "doc_id")
    text = written(text.select("t", "toxic", (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(3)) == 0).alias("curve")), "labelled")
    counts = text.where("NOT curve").select("t", "toxic").mapInPandas(count_grams, "a binary, b binary, n0 long, n1 long")
    counts = written(counts.groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    words, pairs = (df.toArrow() for df in log_ratios(counts))
    model = Model(words["w"].to_pylist(), words["k"].to_numpy(), words["x"].to_numpy(), pairs["k"].to_numpy(), pairs["x"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = np.array([shared.value.features(t) for t in pdf["t"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1], "c": f[:, 2], "y": pdf["toxic"].to_numpy()})

    seen = text.where("curve").select("t", "toxic").mapInPandas(measure, "a double, b double, c double, y int").toPandas()  # bounded by the sample
    model.curve = fit_curve(seen[["a", "b", "c"]].to_numpy(float), seen["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score column of a text; null is scored as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return toxic_score(text_bytes(text))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of `docs` that score below `cut`, with all their columns; every copy of a row gets the same score."""
    return docs.where(score(docs, fit(docs, labels)) < cut)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, repeated rows included; a null text is scored as the empty one, a null id is in the fold of the empty text."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
