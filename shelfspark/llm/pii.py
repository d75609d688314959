"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base identifiers (e-mail, IP, card, phone) are matched by pattern and check digit. They are the
seeds: the words before them induce lexical patterns, and each pattern extracts every
identifier-like string that follows its words. Patterns and instances form a graph that is scored in
rounds (a pattern by the share of its instances that are trusted, an instance by the patterns
that extract it); patterns of high confidence then mark identifiers that no base rule accepts.

Expressions that repeat a group are possessive or guarded by a look-behind: they match what the
plain forms match, without recursion or quadratic retries on long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import let, table, text_key
from shelfspark.session import written

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# identifier-like strings that the base rules may refuse
EMAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9.-]++"
IP_LIKE = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
NUMBER = r"\(?[0-9](?:[\x20()./-]{0,2}[0-9])++"
ANY = "|".join([EMAIL, IP, PHONE, EMAIL_LIKE, IP_LIKE, NUMBER])
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SETTLED = 0.01  # change of a confidence below which the scores have settled
SUPPORT = 4  # different seeds that a trusted pattern has at least
SEEDED = 0.2  # share of seeds among the instances of a trusted pattern, at least
CONFIDENCE = 0.8
SPAN = "array<struct<kind:int,start:int,end:int>>"
FOUND = "array<struct<value:string,start:int,end:int,before:string>>"


def running(a: Column, step: int = 512) -> Column:
    """Running sums of an array of ints, in blocks, so that no long array is copied per element."""
    zero = F.array().cast("array<int>")
    last = lambda acc, base: F.coalesce(F.try_element_at(acc, F.lit(-1)), base)

    def of(arr: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(arr) - 1, F.lit(step)), lambda s: F.slice(arr, s + 1, F.lit(step)))
        return let(cut, bases)

    def bases(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        inside = lambda p, b: F.aggregate(p, zero, lambda acc, x: F.concat(acc, F.array(last(acc, b) + x)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: inside(p, F.get(b, i)))))

    return let(a, of)


def two_words(gap: Column) -> Column:
    """The last two words of a text, lower-cased, without spaces, colons and equal signs after them; empty if it has no two."""
    back = F.regexp_extract(F.reverse(gap), r"^[\s:=]*+(\S++\s++\S++)", 1)
    return F.regexp_replace(F.lower(F.reverse(back)), r"\s+", " ")


def matches(text: Column, pattern: str, guard: str, context: Callable[[Column], Column] = lambda gap: F.lit("")) -> Column:
    """Leftmost non-overlapping matches of a text with code point offsets and the `context` of what stands before them: FOUND."""

    def placed(m: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(starts(m, gaps), lambda s: F.transform(m, lambda v, i: row(v, i, s, gaps))))

    def starts(m: Column, gaps: Column) -> Column:
        shift = lambda v, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0))
        return running(F.transform(m, shift))

    def row(v: Column, i: Column, s: Column, gaps: Column) -> Column:
        at = F.get(s, i)
        return F.struct(v.alias("value"), at.alias("start"), (at + F.length(v)).alias("end"), context(F.get(gaps, i)).alias("before"))

    none = F.array().cast(FOUND)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    return F.when(F.rlike(text, F.lit(guard)), found.cast(FOUND)).otherwise(none)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def worth(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def is_ip(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"))


def is_card(v: Column) -> Column:
    return F.when(F.length(digits(v)).between(16, 19), luhn(digits(v))).otherwise(F.lit(False))


def is_phone(v: Column) -> Column:
    return F.length(digits(v)).between(8, 15)


VALID = {"email": lambda v: F.lit(True), "ip": is_ip, "card": is_card, "phone": is_phone}
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def base_spans(text: Column) -> Column:
    """Base identifiers of a text by kind, then start: SPAN."""

    def one(k: int, kind: str) -> Column:
        ok = F.filter(matches(text, BASE[kind], GUARDS[kind]), lambda x: VALID[kind](x["value"]))
        return F.transform(ok, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*[one(k, kind) for k, kind in enumerate(KINDS)]).cast(SPAN)


def candidates(text: Column) -> Column:
    """Identifier-like strings: array of (kind, value, start, end, before, seed); seed 1 is one that a base rule accepts."""

    def row(x: Column) -> Column:
        v = x["value"]
        whole = lambda p: F.rlike(v, F.lit(f"^(?:{p})$"))
        n = F.length(digits(v))
        seed = (
            F.when(whole(EMAIL), F.lit(0)).when(whole(IP) & is_ip(v), F.lit(1)).when(whole(PHONE) & is_phone(v), F.lit(3))
            .when(whole(CARD) & is_card(v), F.lit(2))
        )
        loose = (
            F.when(F.rlike(v, F.lit(r"@|[\[(]at[\])]")), F.lit(0)).when(F.rlike(v, F.lit(r"^(?:[0-9A-Fa-f]+:){3}")), F.lit(1))
            .when(whole(IP), F.lit(1)).when(n.between(12, 19), F.lit(2)).when(n.between(7, 11), F.lit(3))
        )
        return F.struct(
            F.coalesce(seed, loose).alias("kind"), F.lower(v).alias("value"), x["start"].alias("start"), x["end"].alias("end"),
            x["before"].alias("before"),
            F.when(seed.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("seed"),
        )

    rows = F.transform(matches(text, ANY, r"[0-9@]|[\[(]at[\])]", two_words), row)
    return F.filter(rows, lambda x: x["kind"].isNotNull() & (x["before"] != ""))


def patterns(found: DataFrame, settled: float = SETTLED) -> DataFrame:
    """(kind, before, confidence, support, every) of lexical patterns, from candidates (kind, value, before, seed).

    The graph links a pattern with every instance it extracts. In each round a pattern's confidence is the
    trust in its instances of that kind, over all instances that follow its words in any kind,
    plus one; an instance that is no seed is trusted as much as the patterns that extract it jointly say. Trust
    only grows from round to round; the rounds end when no confidence has grown by `settled` or more, which takes at
    most 1 / settled of them for any one pattern.
    """
    edges = written(found.groupBy("kind", "before", "value").agg(F.max("seed").alias("seed")), "edges")
    every = written(edges.groupBy("before").agg(F.count(F.lit(1)).alias("every")), "contexts")
    trust = written(edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("trust")), "trust")
    scored = None
    while True:
        good = edges.join(trust, ["kind", "value"]).groupBy("kind", "before").agg(F.sum("trust").alias("good"), F.sum("seed").alias("support"))
        step = good.join(every, "before").select("kind", "before", (F.col("good") / (F.col("every") + 1)).alias("confidence"), "support", "every")
        step = written(step, "patterns")
        if scored is not None:
            before = scored.select("kind", "before", F.col("confidence").alias("last"))
            if step.join(before, ["kind", "before"]).where(F.col("confidence") - F.col("last") >= settled).isEmpty():
                return step
        scored = step
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        said = edges.join(scored, ["kind", "before"]).groupBy("kind", "value").agg(F.max("seed").alias("s"), (1 - F.exp(doubt)).alias("t"))
        trust = written(said.select("kind", "value", F.greatest(F.col("s").cast("double"), "t").alias("trust")), "trust")


def discovered(staged: DataFrame) -> DataFrame:
    """(key, more): spans that trusted patterns add to a text, from (key, base, found); written.

    `found` lists the candidates of each different text.
    """
    rows = staged.where(F.size("found") > 0).select("key", "base", F.explode("found").alias("x")).select("key", "base", "x.*")
    enough = (F.col("support") >= SUPPORT) & (F.col("support") >= F.lit(SEEDED) * F.col("every"))
    trusted = patterns(rows).where((F.col("confidence") >= CONFIDENCE) & enough)
    trusted = written(trusted.select("kind", "before"), "trusted")
    new = rows.where("seed = 0").join(trusted, ["kind", "before"])
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    span = F.struct("kind", "start", "end")
    return written(new.where(clear).groupBy("key").agg(F.array_sort(F.collect_set(span)).cast(SPAN).alias("more")), "discovered")


def staged_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", text_key().alias("key"), base_spans(text).alias("base"), candidates(text).alias("found"))


def listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in angle brackets; of overlapping spans the first, then the longest counts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), s["kind"] + 1), F.lit(">"))
        taken = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    return F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def united(spans: Column) -> Column:
    """Runs of overlapping spans as one span each, of the kind of the first, then longest: SPAN."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    span = lambda kind, start, end: F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"))
    start = F.struct(F.array().cast(SPAN).alias("out"), span(F.lit(0), F.lit(0), F.lit(0)).alias("run"))
    ended = lambda acc: F.when(acc["run"]["end"] > 0, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        run = acc["run"]
        longer = F.struct(acc["out"].alias("out"), span(run["kind"], run["start"], F.greatest(run["end"], -s["back"])).alias("run"))
        return F.when(s["start"] < run["end"], longer).otherwise(F.struct(ended(acc).alias("out"), span(s["kind"], s["start"], -s["back"]).alias("run")))

    return F.aggregate(order, start, step, ended)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, personal data in `text` replaced, overlapping spans as one; null texts stay null, other texts stay as they are."""
    seen = written(staged_of(docs.select("text")).select("key", "base", "found").where(F.size("found") > 0).dropDuplicates(["key"]), "candidates")
    none = F.array().cast(SPAN)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.struct("*").alias("row"), text_key().alias("key"), base_spans(text).alias("base")).join(discovered(seen), "key", "left")
    spans = F.concat("base", F.coalesce("more", none))
    return out.withColumn("spans", spans).select(
        F.when(F.size("spans") > 0, F.col("row").withField("text", redacted(F.col("row.text"), united(F.col("spans"))))).otherwise(F.col("row")).alias("row")
    ).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have no spans; rows with equal texts have equal spans; counts are of base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = written(staged_of(docs).drop("text"), "staged")
    more = discovered(rows.where(F.size("found") > 0).select("key", "base", "found").dropDuplicates(["key"]))
    out = rows.select("doc_id", "key", "base").join(more, "key", "left")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select(
        "doc_id", *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"),
    )
