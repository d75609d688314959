"""Exact statistics over whole columns that never gather a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.expr import with_scalars
from shelfspark.session import written

SLACK = 0.0025  # half width of the rank bracket, five times the sketch error
ACCURACY = 2_000
WIDTH = 2 * SLACK + 2 / ACCURACY  # share of the rows that can lie between the ends of a bracket
MOST = 1_000_000  # rows between the ends of a bracket that are ranked without narrowing it again


def _narrow(vals: DataFrame, brackets: list[dict], most: int) -> None:
    """Moves the ends of each bracket in rounds, until at most `most` rows lie strictly between them.

    A round counts the rows up to and inside the open brackets, then sketches the inside alone, so the inside shrinks to
    under a hundredth whatever the ties: copies of an end do not count as inside. Two passes and a few numbers per round.
    """
    most = max(most, int(2 / SLACK))
    while True:
        wide = [b for b in brackets if b["room"] > most]
        if not wide:
            return
        inside = [(F.col(b["col"]) > b["lo"]) & (F.col(b["col"]) < b["hi"]) for b in wide]
        counted = [F.struct(F.count_if(F.col(b["col"]) <= b["lo"]).alias("upto"), F.count_if(c).alias("m")) for b, c in zip(wide, inside)]
        counts = vals.agg(*[c.alias(f"c{i}") for i, c in enumerate(counted)]).first()
        todo = []
        for i, (b, within) in enumerate(zip(wide, inside)):
            m, pos = counts[i]["m"], b["prob"] * (b["n"] - 1)
            b["room"] = m
            first, last = (f(pos) + 1 - counts[i]["upto"] for f in (math.floor, math.ceil))  # ranks among the inside
            if last < 1:
                b["hi"], b["room"] = b["lo"], 0
            elif first > m:
                b["lo"], b["room"] = b["hi"], 0
            elif m > most:
                todo.append((b, within, first, last, m))
        if todo:
            ends = [[max(0.0, first / m - SLACK), min(1.0, last / m + SLACK)] for _, _, first, last, m in todo]
            found = vals.agg(*[
                F.percentile_approx(F.when(within, F.col(b["col"])), e, ACCURACY).alias(f"q{i}") for i, ((b, within, *_), e) in enumerate(zip(todo, ends))
            ]).first()
            for i, (b, _, first, last, m) in enumerate(todo):
                lo, hi = found[i]
                b["lo"] = lo if first >= 1 else b["lo"]
                b["hi"] = hi if last <= m else b["hi"]
                b["room"] = math.ceil(m * WIDTH) + 2


def quantiles(df: DataFrame, cols: list[str], probs: list[float], most: int = MOST) -> DataFrame:
    """Exact linear-interpolated quantiles of whole columns: (name, prob, value).

    A mergeable sketch brackets each wanted rank; brackets that may hold more than `most` rows between their ends are
    narrowed in rounds. A last pass counts the values below a bracket on the map side and shuffles
    only the distinct values inside it, which a spillable running sum ranks: at most `most` (800 at least) and the two ends
    reach one task, whatever the size of the column. A bracket narrower than a few ranks spans the whole column.
    """
    probs = [float(p) for p in probs]
    wanted = [(j, c, i, p) for j, c in enumerate(cols) for i, p in enumerate(probs)]
    vals = df.select(*[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(cols)])
    points = [max(0.0, p - SLACK) for p in probs] + [min(1.0, p + SLACK) for p in probs]
    sketch = vals.agg(
        *[
            F.struct(
                F.count(f"v{j}").alias("n"), F.min(f"v{j}").alias("mn"), F.max(f"v{j}").alias("mx"),
                F.percentile_approx(f"v{j}", points, ACCURACY).alias("q"),
            ).alias(f"s{j}")
            for j in range(len(cols))
        ]
    )
    found = sketch.first()  # one row: a few numbers per column
    ends = []
    for j, _, i, p in wanted:
        at = found[f"s{j}"]
        few = at["n"] * SLACK < 2
        lo, hi = (at["mn"], at["mx"]) if few else (at["q"][i], at["q"][len(probs) + i])
        ends.append({"col": f"v{j}", "prob": p, "n": at["n"], "lo": lo, "hi": hi, "room": 0 if few else math.ceil(at["n"] * WIDTH)})
    _narrow(vals, ends, most)
    bracket = [(b["n"], F.lit(b["lo"]).cast("double"), F.lit(b["hi"]).cast("double")) for b in ends]
    below = vals.agg(*[F.count_if(F.col(f"v{j}") < bracket[k][1]).alias(f"b{k}") for k, (j, _, _, _) in enumerate(wanted)])
    # one row per wanted quantile: bounded by the call
    cells = [
        F.struct(F.lit(k).alias("k"), F.lit(c).alias("name"), F.lit(p).alias("prob"), F.lit(bracket[k][0]).alias("n"), F.col(f"b{k}").alias("b"))
        for k, (_, c, _, p) in enumerate(wanted)
    ]
    asked = below.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    hits = [
        F.when(F.col(f"v{j}").between(bracket[k][1], bracket[k][2]), F.struct(F.lit(k).alias("k"), F.col(f"v{j}").alias("v")))
        for k, (j, _, _, _) in enumerate(wanted)
    ]
    inside = vals.select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.k", "x.v")
    counted = inside.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("cum", F.sum("c").over(run)).join(F.broadcast(asked), "k")
    pos = F.col("prob") * (F.col("n") - 1)
    rank = F.col("cum") + F.col("b")
    picked = ranked.groupBy("k", "name", "prob", "n").agg(
        F.min(F.when(rank >= F.floor(pos) + 1, F.col("v"))).alias("lower"),
        F.min(F.when(rank >= F.ceil(pos) + 1, F.col("v"))).alias("upper"),
    )
    part = pos - F.floor(pos)
    return picked.select("name", "prob", (F.col("lower") + (F.col("upper") - F.col("lower")) * part).alias("value"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per wanted (source column, probability)."""
    cols = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    q = quantiles(df, cols, probs)
    return q.agg(
        *[
            F.max(F.when((F.col("name") == c) & (F.col("prob") == p), F.col("value"))).alias(out)
            for out, (c, p) in wanted.items()
        ]
    )


def median_row(df: DataFrame, cols: list[str]) -> DataFrame:
    return quantile_row(df, {c: (c, 0.5) for c in cols})


def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls of each column become the median of the whole column."""
    med = median_row(df, cols).select(*[F.col(c).alias(f"__m_{c}") for c in cols])
    wide = with_scalars(df, med)
    return wide.select(
        *[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def mode_of(df: DataFrame, c: str) -> Column:
    """Most frequent value, the smallest on ties, as a scalar."""
    top = (
        df.where(F.col(c).isNotNull())
        .groupBy(c)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(c).asc())
        .limit(1)
    )
    return top.select(c).scalar()


def ranked_values(df: DataFrame, cols: list[str], cuts: int = 200) -> DataFrame:
    """Distinct values of text columns with their position in sorted order, from 0, and their row
    count: (name, value, code, n).

    Each column's values are split at up to `cuts` of them, drawn as one minimum hash per
    hash bucket (a rerun draws the same ones). Every range is numbered on its own and
    shifted by the size of the ranges before it, so no task sees more than about 1/cuts
    of the values and a hot value is one row.
    """
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cols])
    long = df.select(F.explode(items).alias("x")).select("x.name", "x.value").where("value IS NOT NULL")
    vals = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("rows"))
    vals = written(vals, "values")  # feeds three branches
    h = F.xxhash64("value")
    picks = vals.groupBy("name", F.pmod(h, F.lit(cuts)).alias("b")).agg(F.min_by("value", F.struct(h, "value")).alias("cut"))
    picks = picks.groupBy("name").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    # one row per column with at most `cuts` values
    ranged = vals.join(F.broadcast(picks), "name").select(
        "name", "value", "rows", F.size(F.filter("cuts", lambda x: x <= F.col("value"))).alias("part")
    )
    sizes = ranged.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("name", "part").orderBy("value")
    return (
        ranged.withColumn("pos", F.row_number().over(inside) - 1)
        .join(F.broadcast(shift), ["name", "part"])
        .select("name", "value", (F.col("pos") + F.col("shift")).cast("bigint").alias("code"), F.col("rows").alias("n"))
    )


def sized_join(df: DataFrame, side: DataFrame, on, how: str = "left", max_rows: int = 500_000) -> DataFrame:
    """Join a derived side that is usually short.

    The side is written once and counted from the file footers. Up to `max_rows` it is
    broadcast; a longer one takes a shuffle join, where adaptive execution splits hot keys.
    """
    return df.join(sized(written(side, "side"), max_rows), on, how)


def sized(side: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """A written side with a broadcast hint when it is short enough."""
    return F.broadcast(side) if side.count() <= max_rows else side


def corr(a: str, b: str) -> Column:
    """Pearson correlation of the rows that have both values; null when one of them is constant.

    The built-in `corr` raises a division error on constant columns in ANSI mode.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)
