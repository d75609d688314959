"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Texts are normalised to lower-case words. A benchmark item gives its windows of ten words (all
its words as one window if it has fewer). The set of windows is broadcast after its size was
checked, every window of every text is looked up in it by equality, and the words inside the
windows that occur are the contaminated spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import lower_ascii, table, text_key
from shelfspark.session import written

SIZE = 10  # words of a window
BLOCK = 2048  # window starts handled together, so that a long text is not one array of windows
BROADCAST = 64 << 20  # bytes of window text up to which the set is broadcast
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing A-Z
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, -1), "")


def windows(w: str, starts: Column, size: int) -> Column:
    """Windows of `size` words of the array column `w` at its first `starts` positions: array of (i, n, h), h a hash of the words."""
    last = F.least(starts, F.size(w) - size + 1)

    def one(i: Column) -> Column:
        return F.struct(i.alias("i"), F.lit(size).alias("n"), F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]).alias("h"))

    none = F.array().cast("array<struct<i:int,n:int,h:bigint>>")
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), one)).otherwise(none)


def test_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, n, h, win) of every benchmark item with words, written; a null id is the empty id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words().alias("w")).where(F.size("w") > 0)
    every = F.lit(None).cast("array<struct<i:int,n:int,h:bigint>>")
    for n in range(1, size):
        every = F.when(F.size("w") == n, windows("w", F.lit(1), n)).otherwise(every)
    every = F.when(F.size("w") >= size, windows("w", F.size("w"), size)).otherwise(every)
    found = items.select("item", "w", F.explode(every).alias("x"))
    return written(found.select("item", "x.n", "x.h", F.array_join(F.slice("w", F.col("x.i"), F.col("x.n")), " ").alias("win")).distinct(), "windows")


def fits(side: DataFrame, text: str, limit: int = BROADCAST) -> bool:
    """Whether the text and the row overhead of a written side stay below `limit` bytes."""
    return (side.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0) <= limit


def sized(side: DataFrame, text: str, limit: int = BROADCAST) -> DataFrame:
    """Broadcast a written side whose text and row overhead stay below `limit` bytes; join by a shuffle beyond it."""
    return F.broadcast(side) if fits(side, text, limit) else side


def cut(docs: DataFrame, size: int) -> DataFrame:
    """(key, first, w): the words of texts in blocks of BLOCK window starts that overlap, so that every window lies whole in one."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))
    parts = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("w", s + 1, F.lit(BLOCK + size - 1)).alias("w")))
    return docs.select("key", words().alias("w")).select("key", F.explode(parts).alias("b")).select("key", "b.first", "b.w")


def hits(docs: DataFrame, tests: DataFrame, size: int = SIZE, limit: int = BROADCAST) -> DataFrame:
    """(key, pos, n, win): windows of texts that are in the test set, once per different text.

    `docs` holds (key, text). A set of up to `limit` bytes is broadcast. A larger one meets the hashes of the windows in a
    shuffle, a few numbers per window; the words are fetched again, by block, for those that meet.
    """
    lengths = sorted(r["n"] for r in tests.select("n").distinct().collect())  # at most `size` values
    if not lengths:
        lengths = [size]
    blocks = cut(docs, size)
    each = [windows("w", F.lit(BLOCK), n) for n in lengths]
    every = F.explode(each[0] if len(each) == 1 else F.concat(*each)).alias("x")
    known = tests.select("n", "h", "win").distinct()
    if fits(known, "win", limit):
        scanned = blocks.select("key", "first", "w", every).select("key", "first", "w", "x.i", "x.n", "x.h")
        met = scanned.join(F.broadcast(known), ["n", "h"])
    else:
        scanned = blocks.select("key", "first", every).select("key", "first", "x.i", "x.n", "x.h")
        met = written(scanned.join(known, ["n", "h"]), "met")
        some = docs.join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        met = met.join(cut(some, size), ["key", "first"])
    text = F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")
    # words are verified only where the hash meets: an equality would become a join key, computed for every window
    same = F.startswith("win", text) & F.startswith(text, F.col("win"))
    return met.where(same).select("key", (F.col("first") + F.col("i") - 1).alias("pos"), "n", "win").distinct()


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, limit: int = BROADCAST) -> DataFrame:
    """(key, at, items) per contaminated text: positions of its hit words and ids of its items, written.

    Null and empty texts have no words and are never hit; rows with equal texts share one row here.
    """
    tests = test_windows(benchmark, size)
    found = written(hits(docs.select(text_key().alias("key"), "text"), tests, size, limit), "hits")
    spans = found.select("key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at"))
    spans = spans.distinct().groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("at"))
    ids = found.select("key", "n", "win").distinct().join(sized(tests, "win", limit), ["n", "win"]).select("key", "item").distinct()
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return written(spans.join(ids, "key"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """Rows of `docs` without benchmark passages, with all their columns, whatever their names.

    remove="documents" drops every row whose text holds a window; remove="spans" keeps it and cuts
    the hit words together with the separators before them. Null and empty texts stay; rows with equal texts fare alike, repeated
    rows stay repeated; an empty benchmark removes nothing.
    """
    found = report(docs, benchmark).select("key", "at")
    keyed = docs.select(F.struct("*").alias("row"), text_key().alias("key"))
    if remove == "documents":
        return keyed.join(found, "key", "left_anti").select("row.*")
    out = keyed.join(found, "key", "left").withColumn("gaps", F.when(F.col("at").isNotNull(), F.split("row.text", WORD, -1)))
    kept = F.transform(
        F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)),
        lambda w, i: F.when(F.array_contains("at", i), F.lit("")).otherwise(F.concat(F.get("gaps", i), w)),
    )
    whole = F.concat(F.array_join(kept, ""), F.element_at("gaps", -1))
    return out.select(F.when(F.col("at").isNull(), F.col("row")).otherwise(F.col("row").withField("text", whole)).alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, repeated rows included; a null text has no words, a null item id is the empty id."""
    docs = table(spark, sf_dir, "documents")
    found = report(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", text_key().alias("key"), F.size(words()).cast("long").alias("n_words"))
    out = rows.join(found, "key", "left")
    n = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(n("at")).alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0).cast("long")).otherwise(n("items")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("at").isNotNull().alias("contaminated"),
    )


_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_LOWER} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i+l-1], ' ') AS win
       FROM (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, l, i, array_to_string(w[i:i+l-1], ' ') AS win
       FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT rid, i, l, item FROM dw JOIN bw USING (l, win)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
