"""Near duplicates by SimHash fingerprints and an inverted index over their byte positions.

A fingerprint is a row of bytes at fixed positions. Fingerprints that differ in few bits agree
in most byte positions, so the index lists, for fixed sets of positions, the fingerprints with
equal bytes there; pairs that meet in a list have their shared positional bytes tallied, pairs
that reach the guaranteed minimum are verified bit by bit. Single positions would make lists of
1/256 of the corpus and pairs without end, so the lists are keyed by sets of positions of which
a qualifying pair must share one.

Exact copies share one fingerprint and enter the index once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.components import components
from shelfspark.llm.text import blocks, table, text_bytes, text_key
from shelfspark.session import ship, written

SEED = 42
DISTANCE = 2  # differing bits that still link
SHORT = 128  # list length up to which all its pairs are tallied; longer lists take the exact way of `neighbours`
SLOTS = list(combinations(range(4), 2))  # two of four 16-bit parts: 2 differing bits leave two parts whole


def shingle_hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of k words; a text of fewer words is one run, a text without words none."""
    carry: list[bytes] = []
    full = False
    for words in blocks(data):
        words = carry + words
        if len(words) < k:
            carry = words
            continue
        full = True
        joined = b" ".join(words)
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        runs = [joined[s : e - 1] for s, e in zip(ends, ends[k:])]
        yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype="<u8", count=len(runs))
        carry = words[1 - k :] if k > 1 else []
    if not full and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype="<u8")


def fingerprint_of(data: bytes, k: int) -> int:
    """64-bit SimHash as a signed integer; 0 for a text without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(data, k):
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str = "text", k: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, k) for t in texts], dtype="int64")

    return simhash(text_bytes(text))


def runs(batches: Iterator[pd.DataFrame], key: list[str], limit: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Groups of sorted batches: (rows, True) for a whole group of 2 to `limit` rows, (rows, False) for parts of a longer one."""
    held: list[pd.DataFrame] = []
    size, hot = 0, False

    def flush():
        nonlocal held, size, hot
        if held and (hot or size > 1):
            yield pd.concat(held) if len(held) > 1 else held[0], not hot
        held, size, hot = [], 0, False

    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        cols = [pdf[c].to_numpy() for c in key]
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = last is None or last != tuple(c[0] for c in cols)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in cols)
        starts = np.flatnonzero(new)
        if not len(starts) or starts[0] > 0:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], len(pdf))
        alone = ends - starts == 1
        for j, (s, e) in enumerate(zip(starts, ends)):
            if new[s]:
                yield from flush()
            if alone[j] and j < len(starts) - 1 and not held and new[s]:
                continue  # a group of one row
            held.append(pdf.iloc[s:e])
            size += e - s
            if size > limit:
                yield pd.concat(held) if len(held) > 1 else held[0], False
                held, hot = [], True
    yield from flush()


def pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared positional bytes and differing bits of pairs of fingerprints."""
    x = (a ^ b).view(np.uint8).reshape(-1, 8)
    return (x == 0).sum(axis=1), np.bitwise_count(x).sum(axis=1)


def scan_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of short lists, and the neighbours (x) of the members (y) of long ones: (slot, x, y); slot -1 is a link."""
    for rows, short in runs(batches, ["slot", "part"], SHORT):
        fp = rows["fp"].to_numpy().astype("<i8")
        if short:
            i, j = pairs_of(len(fp))
            shared, bits = tally(fp[i], fp[j])
            ok = (shared >= 8 - DISTANCE) & (bits <= DISTANCE)
            if ok.any():
                yield pd.DataFrame({"slot": np.full(ok.sum(), -1, dtype=np.int32), "x": fp[i][ok], "y": fp[j][ok]})
            continue
        slot = int(rows["slot"].iloc[0])
        free = [b for part in range(4) if part not in SLOTS[slot] for b in range(16 * part, 16 * part + 16)]
        flips = np.concatenate([np.zeros(1, dtype="<u8"), np.uint64(1) << np.array(free, dtype="<u8")]).view("<i8")
        yield pd.DataFrame({"slot": np.int32(slot), "x": (fp[:, None] ^ flips[None, :]).ravel(), "y": np.repeat(fp, len(flips))})


def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from the first member of a neighbour's list to the others (at most 33: all are one flip away from it)."""
    for rows, _ in runs(batches, ["slot", "x"], 64):
        y = rows["y"].to_numpy()
        yield pd.DataFrame({"a": y[0], "b": y[1:]})


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links whose components are those of all pairs of `fp` values that differ in at most DISTANCE = 2 bits.

    Every list of up to SHORT fingerprints has all its pairs tallied and verified. Members of a
    longer list agree in its four bytes; two of them differ in at most 2 of the other 32 bits exactly
    when some value is at most one flip away from both, so each member is listed under its 33
    neighbours and the members of such a list, all within 2 bits of each other, are joined to one
    of them. That is exact and linear in the length of the list.
    """
    part = lambda i: F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(0xFFFF)
    lists = [F.struct(F.lit(s).alias("slot"), (F.shiftleft(part(i), 16) + part(j)).alias("part")) for s, (i, j) in enumerate(SLOTS)]
    postings = fps.select("fp", F.explode(F.array(*lists)).alias("at")).select("at.slot", "at.part", "fp")
    postings = postings.repartition("slot", "part").sortWithinPartitions("slot", "part", "fp")
    found = written(postings.mapInPandas(scan_lists, "slot int, x long, y long"), "lists")
    direct = found.where("slot = -1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = found.where("slot >= 0").repartition("slot", "x").sortWithinPartitions("slot", "x", "y")
    return direct.union(near.mapInPandas(star, "a long, b long"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of rows with (doc_id, fp): the smallest id among linked fingerprints.

    Rows with a null id take part and get the component of their fingerprint; a component of null
    ids alone has a null component_id. Repeated rows stay.
    """
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "roots")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(written(best, "best"), "root").select("fp", "component_id"), "named")
    return docs.join(named, "fp")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the component of its 3-word fingerprint; null and empty texts have fingerprint zero."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    docs = written(docs.select("doc_id", fingerprint().alias("fp")), "documents")
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row of `docs` per group of near copies, with all its columns: the one with the smallest doc_id.

    Groups are connected by fingerprints of k-word shingles that differ in at most DISTANCE bits, as in `links`; the distance
    alone decides. Rows with equal ids and texts count as one; a null id is the smallest. Null and empty texts
    and texts without words have fingerprint zero and are copies of each other.
    """
    ship(docs.sparkSession)
    rows = written(docs.select("doc_id", text_key().alias("key"), fingerprint(k=k).alias("fp")), "documents")
    fps = written(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("least")), "fingerprints")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = written(named.groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("least").alias("least")), "kept").select("least.*")
    copies = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key", F.lit(True).alias("more"))
    copies = written(copies, "repeated")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    kept = kept.join(copies, same(kept, copies), "left").select(kept["doc_id"], kept["key"], "more")
    out = docs.select(F.struct("*").alias("row"), "doc_id", text_key().alias("key"))
    kept = written(kept, "kept")
    out = out.join(kept, same(out, kept)).select("row", out["doc_id"], out["key"], "more")
    single = out.where("more IS NULL").select("row.*")
    if copies.isEmpty():
        return single
    return single.unionByName(out.where("more").dropDuplicates(["doc_id", "key"]).select("row.*"))
