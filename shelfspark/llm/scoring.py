"""Language-model scores: marginal probability of a text over all subword segmentations.

The vocabulary and its scores exist already: the scores give the first piece probabilities, by
which one round of expectation over every distinct training word, weighted by its count, gives
the model's. The probability of a word sums over all its segmentations by a forward recursion in
log space, computed once per distinct word; a text is its words and one end.

Words are counted over the whole corpus. The most frequent ones go to every task in a table of
bounded size; all others meet their scores in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.lattice import VOCABULARY, Walk, byte_name, expected, forward, load
from shelfspark.llm.text import blocks, fold, table, text_bytes
from shelfspark.session import ship, written

FREQUENT = 100_000  # words in the table that goes to every task
FLUSH = 200_000
PRIOR = 1000.0  # uses of a piece that the existing scores are worth, over all pieces
ROUNDS = 1
TOGETHER = 20_000  # words that enter one walk together
LOG10 = math.log(10.0)


def first_weights(scores: dict[str, float]) -> dict[str, float]:
    """Log-probabilities from existing scores: a score is minus the rank of a piece, its chance falls as 1 / rank.

    Bytes come after the last rank.
    """
    last = -min(s for s in scores.values() if s > -1e8)
    inverse = {p: 1.0 / (10.0 + (last if p.startswith("<0x") else -s)) for p, s in scores.items() if s > -1e8}
    inverse |= {byte_name(b): inverse.get(byte_name(b), 1.0 / (10.0 + last)) for b in range(256)}
    total = sum(inverse.values())
    return {p: math.log(v / total) for p, v in inverse.items()}


def walk_of(weights: dict[str, float]) -> Walk:
    return Walk(weights, [weights[byte_name(b)] for b in range(256)])


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, c, n): uses in training texts and in all texts."""
    train, every = Counter(), Counter()

    def rows() -> pd.DataFrame:
        every.update(train)
        out = pd.DataFrame({"word": list(every), "n": list(every.values())})
        out["c"] = [train.get(w, 0) for w in every]
        train.clear()
        every.clear()
        return out[["word", "c", "n"]]

    for pdf in batches:
        for data, held in zip(pdf["t"], pdf["held"]):
            for words in blocks(data):
                (every if held else train).update(words)
            if len(train) + len(every) > FLUSH:
                yield rows()
    if train or every:
        yield rows()


def spelled(words) -> dict[str, bytes]:
    return {w.decode("utf-8", "surrogateescape"): w for w in words}


class Table:
    """What the scoring of texts needs: scores of frequent words, and those of the end."""

    def __init__(self, known: dict[bytes, tuple[bool, float, float]], end: tuple[bool, float, float]):
        self.known, self.end = known, end


def learn(words: DataFrame, ends: int, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Log-probabilities of pieces and of the end, from the distinct words (word, c) and the number of training texts.

    The expected uses of a piece are summed over all training words in Spark; the driver gets one
    number per piece of the vocabulary.
    """
    weights = first_weights(load(vocabulary))
    prior = {p: math.exp(w) for p, w in weights.items()}
    end = 0.0
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(weights)

        def uses(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            walk, into = walk_of(shared.value), {}
            for pdf in batches:
                for at in range(0, len(pdf), TOGETHER):
                    part = pdf.iloc[at : at + TOGETHER]
                    times = dict(zip(spelled(part["word"]), part["c"].tolist()))
                    for word, alpha in forward(walk, times):
                        expected(walk, alpha, times[word], into)
            if into:
                yield pd.DataFrame({"piece": list(into), "uses": list(into.values())})

        found = words.where("c > 0").select("word", "c").mapInPandas(uses, "piece string, uses double")
        got = {r["piece"]: r["uses"] for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}  # at most the vocabulary
        total = sum(got.values()) + PRIOR + ends + 1.0
        weights = {p: math.log((got.get(p, 0.0) + PRIOR * prior[p]) / total) for p in weights}
        end = math.log((ends + 1.0) / total)
    return weights, end


def score(docs: DataFrame, held: Column, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs` (doc_id, text).

    A null text is the empty one: it has the end as its only token. Repeated rows are scored each. Without
    training texts every count is zero and the pieces keep the existing scores.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select("doc_id", held.alias("held"), text_bytes().alias("t"))
    words = rows.select("t", "held").mapInPandas(count_words, "word binary, c long, n long")
    words = written(words.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = rows.where("NOT held").count()
    seen = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (seen["n"] or 0) + ends, seen["v"] + (1 if ends else 0)
    weights, end = learn(words, ends, vocabulary)
    shared = spark.sparkContext.broadcast(weights)

    def base(c: int) -> float:
        return math.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def word_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = walk_of(shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                got = {w: alpha[-1] / LOG10 for w, alpha in forward(walk, spelled(part["word"]))}
                out = part.assign(score=[got[w] for w in spelled(part["word"])], base=[base(c) for c in part["c"].tolist()], known=part["c"] > 0)
                yield out[["word", "n", "known", "base", "score"]]

    words = written(words.mapInPandas(word_scores, "word binary, n long, known boolean, base double, score double"), "scores")
    # the lowest count that at most `frequent` words reach; a sorted limit would send that many rows per task
    counts = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    run = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = counts.withColumn("cum", F.sum("words").over(run)).where(F.col("cum") <= frequent).agg(F.min("n")).first()[0]
    top = [] if least is None else words.where(F.col("n") >= least).collect()  # at most `frequent` rows
    known = {bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in top}
    facts = spark.sparkContext.broadcast(Table(known, (ends > 0, base(ends), end / LOG10)))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per text with what the frequent words give, and a row (word) per other word of it."""
        task, number = TaskContext.get().partitionId() << 40, 0
        table_ = facts.value
        get = table_.known.get
        for pdf in batches:
            whole, rare = [], []
            for doc_id, held, data in zip(pdf["doc_id"], pdf["held"], pdf["t"]):
                rid, number = task + number, number + 1
                tokens, other = 1, Counter()
                hits = int(table_.end[0])
                b, s = [table_.end[1]], [table_.end[2]]
                for words_ in blocks(data):
                    tokens += len(words_)
                    for w, k in Counter(words_).items():
                        f = get(w)
                        if f is None:
                            other[w] += k
                        else:
                            hits += k * f[0]
                            b.append(k * f[1])
                            s.append(k * f[2])
                whole.append((rid, doc_id, held, None, tokens, hits, math.fsum(b), math.fsum(s)))
                rare += [(rid, None, None, w, k, None, None, None) for w, k in other.items()]
                if len(rare) > FLUSH:
                    yield frame(whole + rare)
                    whole, rare = [], []
            yield frame(whole + rare)

    def frame(found: list) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["rid", "doc_id", "held", "word", "k", "hits", "b", "s"])
        return out.astype({"rid": "int64", "held": "boolean", "k": "int64", "hits": "Int64", "b": "float64", "s": "float64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "held", "t").mapInPandas(
        texts, "rid long, doc_id string, held boolean, word binary, k long, hits long, b double, s double"
    )
    found = written(found, "texts")
    each = found.where("word IS NOT NULL").select("rid", "word", "k").join(words, "word")
    each = each.groupBy("rid").agg(
        F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.col("base")).alias("mb"), F.sum(F.col("k") * F.col("score")).alias("ms")
    )
    out = found.where("word IS NULL").join(each, "rid", "left")
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("held").alias("held_out"), F.col("k").alias("n_tokens"),
        (F.col("hits") + F.coalesce("more", none)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("mb", zero)).alias("base_score"), (F.col("s") + F.coalesce("ms", zero)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold(F.col("doc_id"), 5) == 1)
