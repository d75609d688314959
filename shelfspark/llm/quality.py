"""Quality rules and the frequency of lines across the documents of a host, in DataFrame functions alone.

Lines are normalised and hashed; a line that stands in too many documents of its host is
boilerplate and is removed, and a document of which less than half remains is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import let, table, text_key
from shelfspark.session import written

SPACE = r"[\x20\x09-\x0D]+"
LIMIT = 10  # documents of a host that a line may stand in
DEPLETED = 0.5  # share of its words that a kept document keeps
LINES = "array<struct<h:bigint,n:int>>"


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE, -1), "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def repeated(w: str) -> Column:
    """Words of the array column `w` that lie in a window of three words found twice or more."""

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)

    def places(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, k: F.coalesce(F.get(s, i + k)["h"] == F.get(s, i)["h"], F.lit(False))
        twice = lambda s: F.filter(s, lambda x, i: same(s, i, F.lit(1)) | F.when(i > 0, same(s, i, F.lit(-1))).otherwise(F.lit(False)))
        return let(order, lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(3)]))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), places(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) > 3, some).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, key, base counts, lines) of (doc_id, text, source); null is the empty text, a null source the host `unknown`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("host"), text_key().alias("key"), text.alias("t"))
    # a line counts if it has a word
    d = d.withColumn("w", words(F.col("t"))).withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    lines = F.transform("l", lambda x: F.struct(line_hash(x).alias("h"), F.size(words(x)).alias("n"))).cast(LINES)
    n = lambda c: c.cast("long")
    return d.select(
        "doc_id", "host", "key", n(F.size("w")).alias("n_words"), n(F.length(F.regexp_replace("t", SPACE, ""))).alias("word_chars"),
        n(F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        n(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), n(repeated("w")).alias("n_repeat_words"), lines.alias("lines"),
    )


def frequent(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, h) of lines that stand in more than `limit` documents of their host, written; every row is a document."""
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    return written(counts.where(F.col("docs") > limit).select("host", "h"), "frequent")


def removals(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(host, key, removed, drop): words and hashes of the frequent lines of a text; written. Equal texts of a host share a row."""
    each = rows.select("host", "key", F.posexplode("lines").alias("i", "x")).select("host", "key", "i", "x.h", "x.n")
    hit = each.join(common, ["host", "h"]).groupBy("host", "key", "i").agg(F.max("n").alias("n"), F.max("h").alias("h"))
    return written(hit.groupBy("host", "key").agg(F.sum("n").alias("removed"), F.collect_set("h").alias("drop")), "removals")


def judged(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Base counts, base_failed, kept, and drop (hashes of lines to remove) per row of `docs`."""
    rows = written(measures(docs), "measures")
    out = rows.drop("lines").join(removals(rows, frequent(rows, limit)), ["host", "key"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    whole = F.coalesce("removed", F.lit(0)) <= F.col("n_words") * (1 - DEPLETED)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & whole)


def clean(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Kept rows of `docs`, with all their columns, whatever their names, and without their frequent lines.

    Null and empty texts fail the base rules and go; a null source is the host `unknown`; every repeated row counts as a document.
    """
    found = judged(docs.select("doc_id", "text", "source"), limit).where("kept").select("host", "key", "drop").dropDuplicates(["host", "key"])
    out = docs.select(F.struct("*").alias("row"), text_key().alias("key"), F.coalesce("source", F.lit("unknown")).alias("host")).join(found, ["host", "key"])
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x: ~F.array_contains("drop", line_hash(x))), "\n")
    return out.select(F.when(F.col("drop").isNull(), F.col("row")).otherwise(F.col("row").withField("text", left)).alias("row")).select("row.*")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, repeated rows included; null is the empty text, which fails the base rules, a null source the host `unknown`."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*COLUMNS)


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, 'unknown') AS host, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
l AS (SELECT rid, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '{_W}')) AS n
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY rid),
f AS (SELECT host, norm FROM l GROUP BY ALL HAVING count(DISTINCT rid) > {LIMIT}),
r AS (SELECT rid, sum(n) AS removed FROM l JOIN f USING (host, norm) GROUP BY rid),
x AS (SELECT rid, i, w[i:i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM x) WHERE c > 1),
q AS (SELECT rid, count(DISTINCT j) AS rep FROM (SELECT rid, unnest(range(i, i + 3)) AS j FROM p) GROUP BY rid),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN dl USING (rid) LEFT JOIN q USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed <= n_words * CAST({1 - DEPLETED} AS DOUBLE) AS kept FROM o
"""
