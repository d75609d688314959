"""Token counts: best unigram segmentations, computed once per shared prefix of the distinct pre-tokens.

The scores are those stored in an existing vocabulary; nothing is trained. A byte that spells an
unknown character scores less than every piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.lattice import VOCABULARY, Walk, best_counts, load
from shelfspark.llm.text import SPACE, table, text_bytes
from shelfspark.session import ship

TOGETHER = 4 << 20  # bytes of text whose distinct words enter the trie together
KEPT = 300_000  # words whose counts a task remembers
UNKNOWN = 10.0  # that much below the worst piece


def together(texts: list[bytes]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(text, words) pairs, case kept, about TOGETHER bytes at a time; a long text comes in several."""
    held, size = [], 0
    for i, data in enumerate(texts):
        pos = 0
        while pos < len(data):
            found = SPACE.search(data, pos + TOGETHER) if pos + TOGETHER < len(data) else None
            end = found.start() if found else len(data)
            held.append((i, data[pos:end].split()))
            size += end - pos
            pos = end
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with n_words and n_tokens of `text`; a null text has none of either. Rows with equal texts have equal counts."""
    spark = ship(docs.sparkSession)
    pieces = load(vocabulary)  # bounded by the vocabulary file
    shared = spark.sparkContext.broadcast((pieces, [min(pieces.values()) - UNKNOWN] * 256))

    @F.pandas_udf("struct<n_words: long, n_tokens: long>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        walk, known = Walk(*shared.value), {}
        for texts in batches:
            values = texts.tolist()
            n_words, n_tokens = [0] * len(values), [0] * len(values)
            for some in together(values):
                if len(known) > KEPT:
                    known.clear()
                new = {w for _, words in some for w in words if w not in known}
                spelled = {w.decode("utf-8", "replace"): w for w in new}
                known.update((spelled[w], n) for w, n in best_counts(walk, spelled))
                for i, words in some:
                    n_words[i] += len(words)
                    n_tokens[i] += sum(map(known.__getitem__, words))
            yield pd.DataFrame({"n_words": n_words, "n_tokens": n_tokens})

    out = docs.withColumn("__n", counts(text_bytes()))
    keep = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    return out.select(*keep, "__n.n_words", "__n.n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
