"""Merkle manifest of a dataset: content-addressed records and proofs by descent.

Every row is a leaf. The leaves of a source, in the order of their ids, are the lowest level of a tree whose
nodes are the digests of up to three children; the roots of the sources are the leaves of one more tree
of that kind. What is stored are records from a digest to the digests of its children, in pages of up to
three levels under the digest at the page's top. A proof is found by descent: requests start at the root,
read the page that the digest at hand addresses, take the child that the next digit of their rank names
and collect the other children; the collected path segments, reversed, are the proof.

Requests with the same ranks so far descend as one, so a level moves a row per page, not per request.
Ranks are numbered range by range: no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.text import let, table
from shelfspark.session import written

FAN = 3  # children of a node
LEVELS = 3  # levels of a page
PAGE = FAN**LEVELS
SEGMENT = "array<struct<l:string,r:string>>"  # siblings before and after, as concatenated digests


def field(value: Column) -> Column:
    """A value as an input of a digest: `-` if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def level_up(digests: Column) -> Column:
    """Digests of every FAN consecutive ones, the last of fewer."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i, F.lit(FAN)), ""), 256))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `i`, the position within `group` from 0 in `order`, and `n`, the rows of the group; written.

    Rows are dealt by ranges of (group, order), numbered inside each range, and shifted by the sizes of the
    ranges before. A group of any size is spread over as many ranges as it needs.
    """
    dealt = rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, name)
    inside = Window.partitionBy("range", group).orderBy(*order)
    sizes = dealt.groupBy("range", group).agg(F.count(F.lit(1)).alias("m"))  # a row per range and group in it
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        F.col("range").alias("range_"), F.col(group).alias("group_"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("shift"),
        F.sum("m").over(Window.partitionBy(group)).alias("n"),
    )
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1)
    numbered = numbered.join(shift, (F.col("range") == F.col("range_")) & (F.col(group) == F.col("group_")))
    out = numbered.withColumn("i", (F.col("at") + F.col("shift")).cast("long"))
    return written(out.select(*rows.columns, "i", "n"), name)


def build(leaves: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """Pages of every round and the root of every group: ([(digest, page)], (group, digest, round)), from (group, digest, i, n).

    A round raises runs of PAGE nodes by LEVELS levels, a group that fits one run only as far as its root.
    `page` holds the levels below `digest`, lowest first. A root of round r is on top of r rounds of pages.
    """
    pages, tops, level, left = [], [], leaves.select(group, "digest", "i", "n"), True
    while left:
        tops.append(level.where("n = 1").select(group, "digest", F.lit(len(pages)).alias("round")))
        run = level.where("n > 1").groupBy(group, F.expr(f"i div {PAGE}").alias("i"), "n")
        run = run.agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "digest"))).alias("run"))
        # up to PAGE digests; the levels above them, as high as the group needs
        low = F.transform("run", lambda x: x["digest"])
        tall = lambda k: F.col("n") > F.lit(FAN**k)
        none = F.lit(None).cast("array<string>")
        made = run.withColumn("l0", low).withColumn("l1", level_up(F.col("l0")))
        for k in range(2, LEVELS + 1):
            made = made.withColumn(f"l{k}", F.when(tall(k - 1), level_up(F.col(f"l{k - 1}"))).otherwise(none))
        every = [F.col(f"l{k}") for k in range(LEVELS + 1)]
        top = F.get(F.coalesce(*reversed(every)), F.lit(0))
        below = F.filter(F.array(*every), lambda x: x.isNotNull())
        made = made.select(group, "i", F.ceil(F.col("n") / PAGE).cast("long").alias("n"), top.alias("digest"), F.slice(below, 1, F.size(below) - 1).alias("page"))
        made = written(made, "pages")
        pages.append(made.select("digest", "page").dropDuplicates(["digest"]))
        level = made.select(group, "i", "n", "digest")
        left = not made.isEmpty()
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    return pages[:-1], every


def segments(page: Column, offset: Column) -> Column:
    """Siblings on the way from the top of a page to its lowest digest at `offset`, from the top."""

    def at(levels: Column) -> Column:
        def one(nodes: Column, k: Column) -> Column:
            here = F.floor(offset / F.pow(F.lit(FAN), k)).cast("int")
            first = here - here % FAN
            return F.struct(
                F.array_join(F.slice(nodes, first + 1, here - first), "").alias("l"),
                F.array_join(F.slice(nodes, here + 2, F.greatest(first + FAN - 1 - here, F.lit(0))), "").alias("r"),
            )

        return F.reverse(F.transform(levels, one))

    return let(page, at)


def descend(pages: list[DataFrame], tops: DataFrame, requests: DataFrame, group: str) -> DataFrame:
    """`requests`, rows with (group, i), with `digest` of the leaf they reach and `path`, its siblings from the root down.

    `tops` has (group, digest, round, path), the path being what lies above the group's root.
    """
    wanted = [requests]
    for _ in pages:  # ranks without their lower digits: a row per page that is needed
        up = wanted[-1].select(group, F.expr(f"i div {PAGE}").alias("i")).distinct()
        wanted.append(written(up, "wanted"))
    here = tops.where(F.col("round") == len(pages)).select(F.col(group).alias("group_"), F.lit(0).cast("long").alias("i_"), "digest", "path")
    for k in reversed(range(len(pages))):
        found = here.join(pages[k], "digest")
        rows = wanted[k].join(found, (F.col(group) == F.col("group_")) & (F.expr(f"i div {PAGE}") == F.col("i_")))
        offset = (F.col("i") % PAGE).cast("int")
        reached = F.get(F.get("page", F.lit(0)), offset).alias("digest")
        rows = rows.select(*[c for c in wanted[k].columns], reached, F.concat("path", segments(F.col("page"), offset)).alias("path"))
        small = tops.where(F.col("round") == k).select(F.col(group).alias("group_"), "digest", "path")
        if k:
            # groups that end below this round join here
            rows = rows.withColumnsRenamed({group: "group_", "i": "i_"}).select("group_", "i_", "digest", "path")
            here = written(rows.unionByName(small.withColumn("i_", F.lit(0).cast("long"))), "reached")
        else:
            alone = requests.join(small, F.col(group) == F.col("group_")).drop("group_")
            here = rows.unionByName(alone.select(*rows.columns))
    if not pages:
        here = requests.join(here, F.col(group) == F.col("group_")).drop("group_", "i_")
    return here


def folded(leaf: Column, path: Column) -> Column:
    """Root from a leaf and its siblings, which come from the root down."""
    return F.aggregate(F.reverse(path), leaf, lambda digest, s: F.sha2(F.concat(s["l"], digest, s["r"]), 256))


def proof(path: Column) -> Column:
    """All siblings from the leaf up, left to right, as concatenated digests."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["l"], s["r"])), "")


class Manifest:
    """The stored trees of a dataset: `pages` and `tops` of the sources, `root` over their subroots."""

    def __init__(self, leaves: DataFrame):
        self.pages, tops = build(leaves, "kind")
        tops = written(tops, "tops")
        roots = leaves.where("i = 0").select("kind", "source").join(tops, "kind").withColumn("all", F.lit(0))
        roots = ranked(roots.withColumnRenamed("round", "depth"), "all", ["source", "kind"], "subroots")
        self.above, top = build(roots, "all")
        self.root = written(top.select("all", "digest", "round", F.array().cast(SEGMENT).alias("path")), "root")
        self.tops = written(
            descend(self.above, self.root, roots.select("kind", "depth", "all", "i"), "all").select("kind", "digest", F.col("depth").alias("round"), "path"),
            "tops",
        )

    def proofs(self, requests: DataFrame) -> DataFrame:
        """Rows with (kind, i) and their `digest` and `path`."""
        return descend(self.pages, self.tops, requests, "kind")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, kind, source, digest, other, i, n) of every row: its source, leaf, the leaf of its `tampered` text, and rank.

    Null fields count as `-`. Rows of one source with equal ids are ordered by their leaves, a null id comes first; repeated
    rows are leaves of their own.
    """
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_of(tampered))
    rows = docs.select("doc_id", field(F.col("source")).alias("kind"), "source", leaf_of(F.col("text")).alias("digest"), other.alias("other"))
    return ranked(written(rows, "leaves"), "kind", ["doc_id", "digest"], "leaves")


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of `docs`.

    The manifest is that of `docs`; where `tampered` is not null, the leaf that is folded up the proof is
    that of the row with this text. An empty table has no root and no rows.
    """
    rows = leaves(docs, tampered)
    manifest = Manifest(rows)
    found = manifest.proofs(rows.select("doc_id", "kind", "i", "other"))
    subroots = manifest.tops.select(F.col("kind").alias("kind_"), F.col("digest").alias("subroot"))
    root = manifest.root.select(F.col("digest").alias("root"))
    one = root.scalar()
    found = found.join(subroots, F.col("kind") == F.col("kind_")).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", one.alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document; where the checksum of its id is even, its text without line feeds is what is verified (a null id: of the empty text)."""
    odd = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2
    return verify(table(spark, sf_dir, "documents"), F.when(odd == 0, F.replace("text", F.lit("\n"), F.lit(""))))


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, key: str, start: str) -> str:
    """Levels of the trees over `start` (key, i, n, digest), and the siblings of every node below a root."""
    return f"""
{name} AS (SELECT {key}, 0 AS level, i, n, digest FROM {start}
  UNION ALL SELECT {key}, level + 1, i // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {key}, level, i // {FAN}),
{name}_near AS (SELECT a.{key}, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a LEFT JOIN {name} b ON a.{key} = b.{key} AND a.level = b.level AND a.i // {FAN} = b.i // {FAN} AND a.i <> b.i WHERE a.n > 1 GROUP BY ALL)"""


# the checksum of the id, a bit at a time: -1 shifts, another number is a byte
_CRC = """list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CASE WHEN c = '' THEN [] ELSE [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] END)),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, CAST(4294967295 AS BIGINT))"""
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_field("source")} AS kind, {_leaf("text")} AS leaf,
  CASE WHEN text IS NOT NULL AND {_CRC} % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
start AS (SELECT rid, doc_id, source, kind, other, leaf AS digest, count(*) OVER (PARTITION BY kind) AS n,
  row_number() OVER (PARTITION BY kind ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM d),
{_tree("low", "kind", "start")},
sub AS (SELECT kind, any_value(source) AS source FROM start GROUP BY kind),
subs AS (SELECT 0 AS whole, kind, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM sub JOIN low USING (kind) WHERE low.n = 1),
{_tree("high", "whole", "subs")},
up AS (SELECT rid, kind, 0 AS level, i, coalesce(other, digest) AS fold, '' AS proof FROM start
  UNION ALL SELECT rid, kind, level + 1, i // {FAN}, sha256(l || fold || r), proof || l || r FROM up JOIN low_near USING (kind, level, i)),
mid AS (SELECT up.rid, up.fold, up.proof, subs.i, subs.digest AS subroot FROM up JOIN low USING (kind, level, i) JOIN subs USING (kind) WHERE low.n = 1),
over_ AS (SELECT rid, 0 AS level, i, fold, proof, subroot FROM mid
  UNION ALL SELECT rid, level + 1, i // {FAN}, sha256(l || fold || r), proof || l || r, subroot FROM over_ JOIN high_near USING (level, i))
SELECT doc_id, start.digest AS leaf, subroot, high.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = high.digest AS verified
FROM over_ JOIN high USING (level, i) JOIN start USING (rid) WHERE high.n = 1
"""
