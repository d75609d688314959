"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree of domains, languages and sources by their weights. A node that
cannot use its part (its documents repeat at most a given number of epochs) takes what it has,
and its siblings share the rest by their weights; only when all children of a node are used up
does the shortage reach the node's own siblings. Each leaf then fills its budget with whole
epochs of its documents and the prefix of one more, in an order drawn by a seed per epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.text import table, text_key
from shelfspark.session import written

LEVELS = ("domain", "language", "src")
DOMAINS = (("web", 0, 7), ("reference", 8, 13), ("community", 14, 19))  # by the number of the source
WEIGHTS = {
    "domain": {"web": 5, "reference": 3, "community": 2},
    "language": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "src": {"src0": 2},
}  # unlisted nodes weigh 1
EPOCHS = 4
SEED = 7
SHARE = (1, 1)  # budget as a share of all tokens
SPACE = r"[\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE, -1), "")).cast("long")


def domain(source: str = "source") -> Column:
    number = F.regexp_extract(F.col(source), "^src([0-9]{1,6})$", 1)
    out = F.lit("other")
    for name, lo, hi in DOMAINS:
        inside = F.when(number != "", number.cast("int").between(lo, hi)).otherwise(F.lit(False))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def fill(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Budgets of the children of every parent: (parent, level, budget), from rows with (cap, budget of the parent).

    Children are taken from the one with the least supply per weight. As long as one has no more than
    its part of what is left, it takes all it has; the others share the rest by their weights. A
    window holds the children of one node, a row each.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w"), level)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(30,0)")
    d = nodes.withColumn("w", weight(level, weights)).where("w > 0")
    d = d.withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero))
    d = d.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    d = d.withColumn("fits", F.when(F.col("cap") * F.col("left_w") <= F.col("left_b") * F.col("w"), 1).otherwise(0))
    d = d.withColumn("short", F.min("fits").over(upto))
    d = d.withColumn("rest_b", F.col("budget") - F.coalesce(F.sum(F.when(F.col("short") == 1, F.col("cap"))).over(every), zero))
    d = d.withColumn("rest_w", F.sum(F.when(F.col("short") == 0, F.col("w")).otherwise(zero)).over(every))
    part = F.when(F.col("short") == 1, F.col("cap")).otherwise(F.expr("(rest_b * w) div rest_w"))
    return d.select(*parent, level, part.cast("decimal(30,0)").alias("part"))


def budgets(leaves: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(domain, language, src, supply, docs, target) from (domain, language, src, supply, docs)."""
    leaves = leaves.withColumn("cap", (F.col("supply") * epochs).cast("decimal(30,0)"))
    tokens_ = leaves.agg(F.sum("supply")).first()[0] or 0  # one number
    total, parent = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("cap").cast("decimal(30,0)").alias("cap"))
        if total is None:
            nodes = nodes.withColumn("budget", F.lit(int(tokens_) * share[0] // share[1]).cast("decimal(30,0)"))
        else:
            nodes = nodes.join(total.withColumnRenamed("part", "budget"), parent)
        total = written(fill(nodes, parent, level, weights), "budgets")
        parent = [*parent, level]
    return leaves.join(total, parent).select(*LEVELS, "supply", "docs", F.col("part").cast("long").alias("target"))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("kid")).cast("binary"))


def plan(rows: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, share=SHARE, seed: int = SEED) -> DataFrame:
    """(domain, language, src, target, whole, last): whole epochs of a leaf, and the last key of its partial one (null: none).

    The prefix is found in two steps: tokens per range of the key, about as many ranges as the
    square root of the leaf's documents, then the documents of the one range in which the
    budget ends. No task holds more than that of a leaf.
    """
    on = list(LEVELS)
    leaves = rows.groupBy(*on).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("docs"))
    leaves = budgets(written(leaves, "leaves"), weights, epochs, share)
    whole = F.when(F.col("supply") > 0, F.expr("target div supply")).otherwise(F.lit(0))
    leaves = leaves.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("supply"))
    leaves = written(leaves.withColumn("ranges", F.ceil(F.sqrt("docs")).cast("long")), "leaves")
    part = rows.join(leaves.where("rest > 0").select(*on, "whole", "ranges", "rest"), on)
    part = part.select(*on, "tokens", "rest", "ranges", order_key(F.col("whole"), seed).alias("key"))
    start = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    part = part.withColumn("bin", F.floor(start * F.col("ranges") / F.lit(2.0**32)))
    bins = part.groupBy(*on, "bin", "rest").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("cum", F.sum("t").over(run)).where((F.col("cum") >= F.col("rest")) & (F.col("cum") - F.col("t") < F.col("rest")))
    ends = written(ends.select(*on, "bin", (F.col("rest") - F.col("cum") + F.col("t")).alias("need")), "ends")
    inside = part.select(*on, "bin", "key", "tokens").join(ends, [*on, "bin"])
    inside = inside.groupBy(*on, "need", "key").agg(F.sum("tokens").alias("t"))  # exact repeats share a key
    run = Window.partitionBy(*on).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("cum", F.sum("t").over(run)).where(F.col("cum") >= F.col("need")).groupBy(*on).agg(F.min("key").alias("last"))
    return written(leaves.join(last, on, "left").select(*on, "target", "whole", "last"), "plan")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with its leaf (null language or source: unknown), order id and tokens."""
    kid = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_key())
    node = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    cols = [domain().alias("domain"), node("lang").alias("language"), node("source").alias("src"), tokens().alias("tokens"), kid.alias("kid")]
    return docs.select(F.struct("*").alias("row"), *cols)


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, share=SHARE, seed: int = SEED) -> DataFrame:
    """(row, domain, language, src, tokens, epoch): every selected document once per epoch it is in.

    A prefix ends with the document that reaches the budget, so a leaf exceeds it by less than one
    document (exact repeats of a row go together). Empty and null texts have no tokens and come
    with the prefix they fall in; a leaf without tokens gives nothing.
    """
    rows = keyed(docs)
    narrow = written(rows.select(*LEVELS, "tokens", "kid"), "rows")
    chosen = plan(narrow, weights, epochs, share, seed)
    out = rows.join(chosen, list(LEVELS))
    more = F.when(order_key(F.col("whole"), seed) <= F.col("last"), 1).otherwise(0)
    out = out.withColumn("n", F.col("whole") + more).where("n > 0")
    return out.select("row", *LEVELS, "tokens", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch"))


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("row.doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), "epoch")


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CAST(CASE {cases} ELSE 1 END AS HUGEINT)"


def _fill_sql(name: str, parents: list[str], level: str, above: str) -> str:
    p = ", ".join(parents)
    using = f"USING ({p})"
    return f"""
{name}_a AS (SELECT {p}, {level}, sum(cap) AS cap FROM leaf GROUP BY ALL),
{name}_b AS (SELECT {name}_a.*, {above}.part AS budget, {_weight_sql(level)} AS w FROM {name}_a JOIN {above} {using}),
{name}_c AS (SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb,
  sum(w) OVER (PARTITION BY {p}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
  FROM {name}_b WINDOW o AS (PARTITION BY {p} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level})),
{name}_d AS (SELECT *, min(CASE WHEN cap * lw <= lb * w THEN 1 ELSE 0 END)
  OVER (PARTITION BY {p} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS short FROM {name}_c),
{name} AS (SELECT {p}, {level}, CASE WHEN short = 1 THEN cap ELSE
  ((budget - sum(CASE WHEN short = 1 THEN cap ELSE 0 END) OVER (PARTITION BY {p})) * w) // greatest(sum(CASE WHEN short = 0 THEN w ELSE 0 END) OVER (PARTITION BY {p}), 1) END AS part
  FROM {name}_d)"""


_DOMAIN = "CASE " + " ".join(
    f"WHEN regexp_matches(source, '^src[0-9]{{1,6}}$') AND CAST(regexp_extract(source, '^src([0-9]{{1,6}})$', 1) || '' AS VARCHAR) IN ({', '.join(repr(str(i)) for i in range(lo, hi + 1))}) THEN '{n}'"
    for n, lo, hi in DOMAINS
) + " ELSE 'other' END"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS src,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS t,
  coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS kid FROM documents),
leaf AS (SELECT 1 AS root, domain, language, src, sum(t) AS supply, sum(t) * {EPOCHS} AS cap FROM d GROUP BY ALL),
total AS (SELECT 1 AS root, sum(supply) * {SHARE[0]} // {SHARE[1]} AS part FROM leaf),
{_fill_sql("lv1", ["root"], "domain", "total")},
{_fill_sql("lv2", ["root", "domain"], "language", "lv1")},
{_fill_sql("lv3", ["root", "domain", "language"], "src", "lv2")},
target AS (SELECT leaf.*, part, CASE WHEN supply > 0 THEN part // supply ELSE 0 END AS whole FROM leaf JOIN lv3 USING (root, domain, language, src)),
k AS (SELECT d.*, whole, part - whole * supply AS rest, md5('{SEED}|' || CAST(whole AS VARCHAR) || '|' || kid) AS key FROM d JOIN target USING (domain, language, src)),
c AS (SELECT *, sum(t) OVER (PARTITION BY domain, language, src ORDER BY key) AS cum FROM k),
cut AS (SELECT domain, language, src, min(key) AS last FROM c WHERE rest > 0 AND cum >= rest GROUP BY ALL),
n AS (SELECT k.*, CAST(whole AS BIGINT) + CASE WHEN key <= last THEN 1 ELSE 0 END AS n FROM k LEFT JOIN cut USING (domain, language, src))
SELECT doc_id, domain, language, src, t AS n_tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM n
"""
