"""Ranked lexical search by a dual tree: coordinate maxima over items and documents bound whole batches.

The terms of the items are the coordinates. A document has in every coordinate what an occurrence there
adds per unit of the term's weight; an item has the weights of its terms. Documents of a batch
and items of a block stand in two hierarchies whose nodes hold the maxima of every coordinate, so the inner
product of two nodes is at least the score of any item and document below them. A pair of nodes is left
when that bound is less than the weakest k-th score among the node's items, so no pair that could enter
a result, or tie with its last place, is lost.

All documents take part. Tasks search their documents and hand on at most k per item; the results
of the tasks are ranked at the end. A sample of the documents is searched first: k-th scores
among some documents are never above those among all, so they prune from the first batch on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.text import table, text_bytes
from shelfspark.session import ship, written

TOP = 10  # documents per item
FAN = 8  # children of a node
LEAF = 16  # documents of a lowest node
BATCH = 2048  # documents of a hierarchy
CELLS = 4_000_000  # coordinates times nodes of a level that are held at once
ITEM_BYTES = 4 << 20  # text of the items that are searched together; more items come in several parts
SEEDS = 64  # one document in so many gives the first k-th scores
PIECE = 1 << 20  # bytes of a text that are split at a time
SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # A-Z lower-cased, what is no term a space
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
VECTORS = "doc_id long, n long, term array<int>, tf array<int>"
FOUND = "q long, item_id long, doc_id long, score long"


def term_counts(data: bytes) -> Counter:
    """Occurrences of the terms of a text."""
    out: Counter = Counter()
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        out.update(data[at:end].translate(SPACES).split())
        at = end
    return out


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf) of every row: its terms in all, and those in `terms`, by position, with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, term, tf = [], [], []
            for data in batch.column(1):
                counts = term_counts(data.as_py())
                n.append(sum(counts.values()))
                hits = [(known[t], c) for t, c in counts.items() if t in known]
                term.append([i for i, _ in hits])
                tf.append([c for _, c in hits])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, ints), pa.array(tf, ints)], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(counted, VECTORS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def maxima(rows: np.ndarray, fan: int = FAN) -> list[np.ndarray]:
    """Levels of a hierarchy, the rows first: maxima per coordinate of every `fan` nodes, up to one node."""
    levels = [rows]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), fan), axis=0))
    return levels


class Block:
    """Items that are searched together, in a hierarchy, with the best documents found so far."""

    def __init__(self, items: list[tuple[int, int | None, np.ndarray]], weights: np.ndarray, least: np.ndarray, k: int):
        """`items` are (q, item_id, terms), `weights` and `least` are of all terms and all q."""
        self.cols = np.unique(np.concatenate([t for _, _, t in items]))
        local = np.full(len(weights), -1, dtype=np.int64)
        local[self.cols] = np.arange(len(self.cols))
        self.local, self.k = local, k
        w = np.zeros((len(items), len(self.cols)), dtype=np.int64)
        for row, (_, _, terms) in enumerate(items):
            w[row, local[terms]] = weights[terms]
        order = np.argsort(w.argmax(axis=1), kind="stable")  # items with the same rarest term stand together
        self.items = [items[i] for i in order]
        self.w = w[order]
        self.levels = [m.astype(np.float64) for m in maxima(self.w)]
        self.most = self.w.max(axis=0)
        self.least = least[[q for q, _, _ in self.items]].astype(np.float64)  # k-th scores so far
        none = np.empty(0, dtype=np.int64)
        self.best = [(none, none, none.astype(bool)) for _ in self.items]  # scores, ids, which ids are no nulls

    def weakest(self) -> list[np.ndarray]:
        out = [self.least]
        for level in self.levels[1:]:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
            assert len(out[-1]) == len(level)
        return out

    def search(self, ids: np.ndarray, known: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Search documents given by their ids and by (row, term, value) entries."""
        col = self.local[term]
        held = col >= 0
        row, col, value = row[held], col[held], value[held]
        if not len(row):
            return
        # documents in the order of the coordinate that can add most, so that nodes hold alike ones
        heavy = np.lexsort((-self.most[col] * value, row))
        first = np.ones(len(heavy), dtype=bool)
        first[1:] = row[heavy][1:] != row[heavy][:-1]
        lead = heavy[first]
        ranked = row[lead][np.lexsort((-value[lead], col[lead]))]
        place = np.full(len(ids), -1, dtype=np.int64)
        place[ranked] = np.arange(len(ranked))
        at = place[row]
        order = np.argsort(at, kind="stable")
        at, col, value = at[order], col[order], value[order]
        size = LEAF * max(1, min(BATCH // LEAF, CELLS // max(1, len(self.cols))))
        for start in range(0, len(ranked), size):
            s, e = np.searchsorted(at, [start, start + size])
            self.batch(ids[ranked[start : start + size]], known[ranked[start : start + size]], at[s:e] - start, col[s:e], value[s:e])

    def batch(self, ids: np.ndarray, known: np.ndarray, at: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        n = -(-len(ids) // LEAF)
        low = np.zeros((n, len(self.cols)), dtype=np.int64)
        np.maximum.at(low, (at // LEAF, col), value)
        docs = [m.astype(np.float64) for m in maxima(low)]
        weakest = self.weakest()
        i, d = len(self.levels) - 1, len(docs) - 1
        alive = np.ones((1, 1), dtype=bool)
        while True:
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return
            bound = self.levels[i][rows] @ docs[d][cols].T * (1 + 1e-9)
            alive[np.ix_(rows, cols)] &= (bound > 0) & (bound >= weakest[i][rows][:, None])
            if i == 0 and d == 0:
                break
            if i:
                i -= 1
                alive = np.repeat(alive, FAN, axis=0)[: len(self.levels[i])]
            if d:
                d -= 1
                alive = np.repeat(alive, FAN, axis=1)[:, : len(docs[d])]
        starts = np.searchsorted(at, np.arange(len(ids) + 1))
        for s in range(0, len(self.items), FAN):
            nodes = np.flatnonzero(alive[s : s + FAN].any(axis=0))
            if not len(nodes):
                continue
            some = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            some = some[some < len(ids)]
            lens = starts[some + 1] - starts[some]
            begin = np.cumsum(lens) - lens
            entry = np.arange(lens.sum()) + np.repeat(starts[some] - begin, lens)
            scores = np.add.reduceat(self.w[s : s + FAN, col[entry]] * value[entry], begin, axis=1)
            for j, score in enumerate(scores):
                self.keep(s + j, score, ids[some], known[some])

    def keep(self, item: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        near = (score > 0) & (score >= self.least[item])
        if not near.any():
            return
        s, x, y = (np.concatenate([a, b[near]]) for a, b in zip(self.best[item], (score, ids, known)))
        order = np.lexsort((x, y, -s))[: self.k]
        self.best[item] = (s[order], x[order], y[order])
        if len(order) == self.k:
            self.least[item] = max(self.least[item], s[order[-1]])

    def found(self) -> Iterator[pa.RecordBatch]:
        for (q, item, _), (s, x, y) in zip(self.items, self.best):
            if len(s):
                ids = pa.array(x, pa.int64(), mask=~y)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), pa.int64()), pa.array([item] * len(s), pa.int64()), ids, pa.array(s)], ["q", "item_id", "doc_id", "score"])


def dealt(items: list[tuple[int, int | None, np.ndarray]]) -> list[list[tuple[int, int | None, np.ndarray]]]:
    """Items in blocks whose hierarchies hold about CELLS coordinates."""
    out: list = [[]]
    terms = 0
    for item in items:
        if out[-1] and (len(out[-1]) + 1) * (terms + len(item[2])) > CELLS:
            out.append([])
            terms = 0
        out[-1].append(item)
        terms += len(item[2])
    return out


def searched(rows: DataFrame, items: list, weights: np.ndarray, least: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """The best k documents of every task per item, as far as they reach `least`: (q, item_id, doc_id, score), from `vectors`."""
    shared = rows.sparkSession.sparkContext.broadcast((dealt(items), weights, least))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, w, floor = shared.value
        blocks = [Block(part, w, floor, k) for part in parts]
        for batch in batches:
            ids, n, term, tf = (batch.column(c) for c in range(4))
            known = np.asarray(ids.is_valid())
            row = np.repeat(np.arange(len(n)), np.asarray(term.value_lengths()))
            tf = np.asarray(tf.flatten()).astype(np.int64)
            m = 10 + (90 * np.asarray(n) * n_docs) // length
            value = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            for block in blocks:
                block.search(np.asarray(ids.fill_null(0)), known, row, np.asarray(term.flatten()), value)
        for block in blocks:
            yield from block.found()

    return rows.where(F.size("term") > 0).mapInArrow(task, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_part(docs: DataFrame, queries: list[tuple[int | None, bytes]], k: int, seeds: int) -> DataFrame | None:
    """(q, item_id, rank, doc_id, score) for some (item_id, text); None if no document has a term."""
    words = [(item, list(term_counts(text))) for item, text in queries]
    terms = sorted({t for _, ts in words for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    rows = written(vectors(docs, terms), "vectors")
    total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not total[0]:
        return None
    df = rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row per term of the items
    weights = np.zeros(len(terms), dtype=np.int64)
    for r in df:
        weights[r["term"]] = weight(total[0], r["df"])
    items = [(q, item, np.array([number[t] for t in ts], dtype=np.int64)) for q, (item, ts) in enumerate(words) if ts]
    if not items:
        return None
    least = np.zeros(len(words), dtype=np.int64)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seeds)) == 0)
    first = ranked(searched(some, items, weights, least, *total, k), k).where(F.col("rank") == k)
    for r in first.select("q", "score").collect():  # a number per item
        least[r["q"]] = r["score"]
    return ranked(written(searched(rows, items, weights, least, *total, k), "found"), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, seeds: int = SEEDS) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: (item_id, rank, doc_id, score).

    Ranks run from 1, by score, then by ascending doc_id (null first). Every row of `docs` is a document of its own and every row
    of `items` an item of its own, so repeated rows give repeated results; null and empty texts have no terms.
    Items are searched in parts of about ITEM_BYTES of text, each of which reads the documents again.
    """
    spark = ship(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long"), text_bytes().alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(size / ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        found = search_part(docs, [(r["item_id"], bytes(r["text"])) for r in part.collect()], k, seeds)  # bounded by ITEM_BYTES
        if found is not None:
            found = found.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
            out = found if p == 0 else out.unionByName(found)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM d),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t, n),
m AS (SELECT rid, doc_id, CAST(10 + (90 * len(w) * n) // l AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)),
r AS (SELECT q, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN df USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
