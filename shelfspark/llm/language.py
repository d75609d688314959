"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. Three letters in a row are bound into one vector by
multiplying the vectors of the letters, permuted by their place; a text is the bundle (sum) of its
letter trigrams, a language the bundle of its texts. A text takes the language with the largest
cosine. Runs of other characters count as one word border, which has a vector too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import fold, table
from shelfspark.session import ship

SIZE = 1024  # components of a vector
SEED = 11
BLOCK = 1 << 20  # characters of a text that are encoded at a time
BATCH = 256  # texts that are bundled by one matrix product
GRAMS = 16_384  # trigram vectors in one product
UNKNOWN = "und"


class Encoder:
    """Trigram vectors of one worker; the letter table covers all of Unicode."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > 65536:
                self.letters.clear()
            self.letters[c] = np.random.default_rng([SEED, c]).choice(np.array([-1, 1], dtype=np.float32), self.size)
        return self.letters[c]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty((len(grams), self.size), dtype=np.float32)
        for i, g in enumerate(grams.tolist()):
            a, b, c = self.letter(g >> 42), self.letter(g >> 21 & 0x1FFFFF), self.letter(g & 0x1FFFFF)
            out[i] = np.roll(a, 2) * np.roll(b, 1) * c
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams of a text, as numbers, and their counts; none for a text without letters."""
        keys, counts = [], []
        carry = np.zeros(1, dtype=np.int64)
        letters = False
        for at in range(0, len(text), BLOCK):
            c = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            c[~self.alpha[c]] = 0
            letters = letters or bool(c.any())
            c = np.concatenate([carry, c] if at + BLOCK < len(text) else [carry, c, [0]])
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            carry = c[-2:]
            g = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
            k, n = np.unique(g[c[1:-1] != 0], return_counts=True)  # no border in the middle
            keys.append(k)
            counts.append(n)
        if not letters:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(keys) == 1:
            return keys[0], counts[0]
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

    def bundle(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vectors of texts given by their trigrams and counts."""
        out = np.zeros((len(found), self.size), dtype=np.float32)
        if not any(len(k) for k, _ in found):
            return out
        every, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        n = np.concatenate([c for _, c in found])
        for lo in range(0, len(every), GRAMS):
            here = (back >= lo) & (back < lo + GRAMS)
            dense = np.zeros((len(found), min(GRAMS, len(every) - lo)), dtype=np.float32)
            dense[row[here], back[here] - lo] = n[here]
            out += dense @ self.cached(every[lo : lo + GRAMS])
        return out

    def cached(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted trigrams; those of the last call are reused."""
        known, old = getattr(self, "last", (np.zeros(0, dtype=np.int64), np.zeros((0, self.size), dtype=np.float32)))
        out = np.empty((len(grams), self.size), dtype=np.float32)
        at = np.searchsorted(known, grams)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == grams) if len(known) else np.zeros(len(grams), dtype=bool)
        out[hit] = old[at[hit]]
        out[~hit] = self.vectors(grams[~hit])
        self.last = (grams, out)
        return out


def profiles(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Bundled vector per language of (text, lang), from rows in which both are not null.

    Each task bundles its own texts, so a language sends one vector per task, however many texts it has;
    the driver gets one vector per language.
    """
    ship(docs.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sums, counts = Encoder(size), {}, {}

        def settle() -> None:
            for lang, seen in counts.items():
                k = np.array(sorted(seen), dtype=np.int64)
                n = np.array([seen[g] for g in k.tolist()], dtype=np.float64)
                total = sums.setdefault(lang, np.zeros(size))
                for lo in range(0, len(k), GRAMS):
                    total += n[lo : lo + GRAMS] @ enc.vectors(k[lo : lo + GRAMS])
            counts.clear()

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                seen = counts.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in enc.grams(text))):
                    seen[g] = seen.get(g, 0) + n
                if sum(map(len, counts.values())) > 500_000:
                    settle()
        settle()
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(partial, "lang string, v array<double>")
    whole = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: np.array([x["x"] for x in r["v"]], dtype=np.float64) for r in whole.collect()}  # one row per language


def predict(docs: DataFrame, known: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """`docs` (id columns and text) with lang_pred and score: the nearest profile and its cosine, cut at 0.

    A null text, a text without letters, and every text while nothing was learned get `und` and 0.
    Of equal cosines the first language by name wins. Texts are encoded whole, in blocks.
    """
    ship(docs.sparkSession)
    langs = sorted(x for x in known if known[x].any())
    unit = np.array([known[x] / np.linalg.norm(known[x]) for x in langs]).reshape(len(langs), size).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((langs, unit))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = Encoder(size)
        names, protos = shared.value
        for texts in batches:
            lang, score = [], []
            values = texts.tolist()
            for at in range(0, len(values), BATCH):
                found = [enc.grams(t) if isinstance(t, str) else (np.zeros(0, dtype=np.int64),) * 2 for t in values[at : at + BATCH]]
                v = enc.bundle(found)
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ protos.T) / np.maximum(norm, 1e-9)[:, None] if len(names) else np.zeros((len(v), 1))
                best = cos.argmax(axis=1)
                ok = (norm > 0) & bool(names)
                lang += [names[b] if k else UNKNOWN for b, k in zip(best, ok)]
                score += [float(min(1.0, max(0.0, cos[i, b]))) if k else 0.0 for i, (b, k) in enumerate(zip(best, ok))]
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn("__found", nearest("text")).select(*[c for c in docs.columns if c != "text"], "__found.lang_pred", "__found.score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    known = profiles(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), known)
