"""Byte-level BPE: encoding by recursive queries per partition, decoding by ordered aggregation.

Every task holds the merge table (left id, right id, merged id) of a rank file in an in-process
DuckDB. The different pre-tokens of some texts become rows (word, pos, id), one per byte. A recursive
query joins neighbours with the merge table and contracts, in every word, the leftmost pair
of the least rank, until no neighbours are in the table. Decoding joins (run, pos, id) rows with
the vocabulary and aggregates the bytes in the order of pos.

A pre-token that is a token itself is that token, as in the tiktoken library. The recursion keeps the
rows of all rounds, so words enter it in slices with a bounded sum of squared lengths; a word of
more than LONG bytes, which alone would need as many rounds as bytes, is contracted by a heap of its
pairs in the same order (leftmost least rank first), which gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import table
from shelfspark.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
TOGETHER = 2 << 20  # characters of text whose new words are encoded together
LONG = 128  # bytes of a word up to which the recursive query contracts it
ROWS = 3_000_000  # rows of all rounds of one recursive query
KEPT = 1_000_000  # words that a worker remembers
TOKENS = 1 << 20  # ids that are decoded together
SAFE = re.compile(r"\S(?= \S)")  # a pre-token ends here whatever stands around
CODERS: dict[str, Coder] = {}  # of this worker: later tasks go on with the words of earlier ones

MERGE = """
WITH RECURSIVE parts AS (
  SELECT 0 AS step, word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS following FROM start
  UNION ALL
  (WITH least AS (
     SELECT word, min((CAST(merged AS BIGINT) << 32) + pos) AS best FROM parts JOIN merges ON first = id AND second = following GROUP BY word),
   hit AS (
     SELECT word, CAST(best & 4294967295 AS INTEGER) AS place, CAST(best >> 32 AS INTEGER) AS merged, following AS beyond
     FROM least JOIN parts USING (word) WHERE pos = (best & 4294967295) + 1)
   SELECT step + 1, word, CASE WHEN pos > place THEN pos - 1 ELSE pos END, CASE WHEN pos = place THEN merged ELSE id END,
     CASE WHEN pos = place THEN beyond WHEN pos = place - 1 THEN merged ELSE following END
   FROM parts JOIN hit USING (word) WHERE pos <> place + 1)
)
SELECT word, id FROM parts JOIN (SELECT word, max(step) AS step FROM parts GROUP BY word) USING (word, step) ORDER BY word, pos
"""
JOIN = "SELECT run, string_agg(bytes, '' ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY run"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(first, second, merged) ids of every token that two tokens spell, one row per way."""
    ways = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return np.array(ways, dtype=np.int32).reshape(-1, 3)


def contracted(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: a heap of its neighbouring pairs, leftmost least rank first."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end of the part that starts at a position; start of the one before
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if 0 <= at and end[at] < n:
            beyond = end[end[at]]
            rank = ranks.get(word[at:beyond])
            if rank is not None:
                heapq.heappush(heap, (rank, at, beyond))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, beyond = heapq.heappop(heap)
        if end[at] < 0 or end[at] >= n or end[end[at]] != beyond:
            continue  # one of its parts has changed since
        middle = end[at]
        end[middle], end[at] = -1, beyond
        if beyond < n:
            before[beyond] = at
        offer(before[at])
        offer(at)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Coder:
    """Encoder and decoder of one task; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        rows = pd.DataFrame(merges, columns=["first", "second", "merged"])
        spelled = pd.DataFrame({"id": np.fromiter(ranks.values(), dtype=np.int32), "bytes": [t.decode("latin-1") for t in ranks]})
        self.put("rows", rows)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")
        self.put("spelled", spelled)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM spelled")

    def put(self, name: str, rows: pd.DataFrame) -> None:
        import pyarrow as pa

        self.db.register(name, pa.Table.from_pandas(rows, preserve_index=False))

    def merge(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) of words of up to LONG bytes, by the recursive query."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        pos = (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.put("start", pd.DataFrame({"word": word, "pos": pos, "id": self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]}))
        rows = self.db.sql(MERGE).to_arrow_table()
        data = rows["id"].to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(rows["word"].to_numpy(), minlength=len(words)))
        return zip(words, (data[s:e] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())))

    def learn(self, new: set[str]) -> None:
        """Put the ids of new pre-tokens into `words`."""
        short: list[bytes] = []
        for w in new:
            data = w.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is not None:
                self.words[w] = rank.to_bytes(4, "little")
            elif len(data) <= LONG:
                short.append(data)
            else:
                self.words[w] = np.array(contracted(data, self.ranks), dtype="<u4").tobytes()
        short.sort(key=len)
        at = 0
        while at < len(short):
            end, cost = at, 0
            while end < len(short) and cost < ROWS:
                cost += len(short[end]) * (len(short[end]) + 1) // 2
                end += 1
            self.words.update((w.decode("utf-8"), ids) for w, ids in self.merge(short[at:end]))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, concatenated per text."""
        if len(self.words) > KEPT:
            self.words.clear()
        cut = [self.find(t) for t in texts]
        known = [list(map(self.words.get, words)) for words in cut]
        open_ = [i for i, ids in enumerate(known) if None in ids]
        self.learn({w for i in open_ for w, ids in zip(cut[i], known[i]) if ids is None})
        for i in open_:
            known[i] = list(map(self.words.__getitem__, cut[i]))
        return [b"".join(ids) for ids in known]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """Bytes of the tokens of some texts."""
        ids = np.frombuffer(b"".join(texts), dtype="<u4").astype(np.int32)
        run = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) // 4 for t in texts])
        self.put("tokens", pd.DataFrame({"run": run, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        found, out = self.db.sql(JOIN).to_arrow_table(), [b""] * len(texts)
        for i, text in zip(found["run"].to_pylist(), found["bytes"].to_pylist()):
            out[i] = text.encode("latin-1")
        return out


def task_coder(key: str, shared) -> Coder:
    """The coder of this worker for the vocabulary and pattern with this key."""
    if key not in CODERS:
        CODERS.clear()
        CODERS[key] = Coder(*shared.value)
    return CODERS[key]


def blocks(text: str) -> Iterator[str]:
    """A long text in parts of about TOGETHER characters, cut where a pre-token surely ends."""
    at = 0
    while at < len(text):
        found = SAFE.search(text, at + TOGETHER) if at + TOGETHER < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def groups(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, or parts of long ones, with their numbers, about TOGETHER characters at a time."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in blocks(text):
            at.append(i)
            held.append(part)
            size += len(part)
            if size >= TOGETHER:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def coder(docs: DataFrame, path: str, pattern: str | None):
    """A function that gives a task its coder, from tables that are broadcast (bounded by the rank file)."""
    import public_tokenizers

    spark = ship(docs.sparkSession)
    ranks, pattern = load(path), pattern or public_tokenizers.PATTERN
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, merge_table(ranks), pattern))
    return lambda: task_coder(key, shared)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with `ids`: the token ids of `text` as little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens; equal texts have equal ids; special tokens are ordinary text. A column
    `ids` of the input is replaced. Long texts are encoded in parts that end where a pre-token ends.
    """
    make = coder(docs, path or vocabulary_path(), pattern)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = make()
        for texts in batches:
            yield pd.Series(encoded(c, texts.tolist()), dtype=object)

    return docs.withColumn("ids", ids(F.coalesce(F.col("text"), F.lit(""))))


def encoded(c: Coder, texts: list[str]) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in texts]
    for at, some in groups(texts):
        for i, ids in zip(at, c.encode(some)):
            out[i].append(ids)
    return [b"".join(parts) for parts in out]


def decoded(c: Coder, texts: list[bytes]) -> list[bytes]:
    """Bytes of the tokens of some texts, about TOKENS ids at a time; a long text comes in several parts."""
    out: list[list[bytes]] = [[] for _ in texts]
    at, held, size = [], [], 0
    for i, ids in enumerate(texts):
        for start in range(0, len(ids), 4 * TOKENS):
            at.append(i)
            held.append(ids[start : start + 4 * TOKENS])
            size += len(held[-1])
            if size >= 4 * TOKENS:
                for j, data in zip(at, c.decode(held)):
                    out[j].append(data)
                at, held, size = [], [], 0
    for j, data in zip(at, c.decode(held)):
        out[j].append(data)
    return [b"".join(parts) for parts in out]


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows` with `bytes`: the bytes of the tokens in `ids`, as `encode` makes them; a null is no token.

    The bytes of ids that end inside a character are no text, so they stay bytes. An id that the
    rank file lacks adds nothing. A column `bytes` of the input is replaced.
    """
    make = coder(rows, path or vocabulary_path(), None)

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = make()
        for ids in batches:
            yield pd.Series(decoded(c, ids.tolist()), dtype=object)

    return rows.withColumn("bytes", data(F.coalesce(F.col("ids"), F.lit(b""))))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: `encode`, then `decode` of its ids, in one pass."""
    make = coder(docs, path or vocabulary_path(), None)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = make()
        for texts in batches:
            ids = encoded(c, texts.tolist())
            sha = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]
            yield pd.DataFrame({"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": sha(ids), "decoded_sha256": sha(decoded(c, ids))})

    out = docs.select("doc_id", digests(F.coalesce(F.col("text"), F.lit(""))).alias("found"))
    return out.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, its ids and what they decode to; null and empty texts have no tokens."""
    return round_trip(table(spark, sf_dir, "documents"))
