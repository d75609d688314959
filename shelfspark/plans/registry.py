"""Query registry: a Spark build and its independent SQL twin under one key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.panel import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OWNER: dict[str, str] = {}  # key -> plans module
CTES: dict[str, str] = {}  # shared SQL views, in dependency order

TYPES = {"i": ("bigint", "BIGINT"), "d": ("date", "DATE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}

# scaled amounts from this size on have no fraction that a double could hold
WHOLE = 9007199254740992.0


def _spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.replace("\n", " ").split(","):
        name, _, kind = item.strip().partition(":")
        out.append((name, kind))
    return out


def rounded(c: Column, places: int) -> Column:
    """Half up in plain double arithmetic; the built-in round goes through decimal text, which another engine need not do."""
    scaled = c.cast("double") * F.lit(10.0**places)
    return F.when(F.abs(scaled) < F.lit(WHOLE), F.floor(scaled + F.lit(0.5)) / F.lit(10.0**places)).otherwise(c.cast("double"))


def rounded_sql(c: str, places: int) -> str:
    x, by = f"CAST({c} AS DOUBLE)", f"CAST(1e{places} AS DOUBLE)"
    return f"CASE WHEN abs({x} * {by}) < CAST({WHOLE} AS DOUBLE) THEN floor({x} * {by} + CAST(0.5 AS DOUBLE)) / {by} ELSE {x} END"


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Select, cast and round the result columns named in `spec` (x:6 rounds to 6 places)."""
    cols = []
    for name, kind in _spec(spec):
        c = F.col(f"`{name}`")
        if kind.isdigit():
            c = rounded(c, int(kind))
        elif kind:
            c = c.cast(TYPES[kind][0])
        cols.append(c.alias(name))
    return df.select(*cols)


def shaped_sql(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _spec(spec):
        quoted = f'"{name}"'
        if kind.isdigit():
            cols.append(f"{rounded_sql(quoted, int(kind))} AS {quoted}")
        elif kind:
            cols.append(f"CAST({quoted} AS {TYPES[kind][1]}) AS {quoted}")
        else:
            cols.append(quoted)
    return f"SELECT {', '.join(cols)} FROM ({with_views(sql)}) result"


def with_views(sql: str) -> str:
    """Put the shared views that `sql` mentions in front of it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(key: str, spec: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"duplicate query {key}")
    OWNER[key] = build.__module__.rsplit(".", 1)[-1]
    QUERIES[key] = lambda spark, sf_dir: shaped(build(Tables(spark, sf_dir)), spec)
    if sql is not None:
        ORACLES[key] = shaped_sql(sql, spec)


CTES["panel"] = """
SELECT p_brand AS product_name,
       CONCAT('CAT', CAST(CAST(SUBSTRING(p_brand, 7) AS INT) % 5 AS VARCHAR)) AS category,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start,
       CAST(SUM(l_quantity) AS DOUBLE) AS sales_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS price,
       CAST(SUM(p_size) AS DOUBLE) AS stock_on_hand,
       CASE WHEN SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) > 5 * COUNT(*) THEN 1 ELSE 0 END AS promotion,
       CASE WHEN MONTH(CAST(date_trunc('week', l_shipdate) AS DATE)) IN (11, 12) THEN 1 ELSE 0 END AS holiday_flag,
       MAX(l_returnflag) AS weather,
       MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS availability
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand, date_trunc('week', l_shipdate)
"""

CTES["daily"] = """
SELECT p_brand AS product_name,
       CONCAT('CAT', CAST(CAST(SUBSTRING(p_brand, 7) AS INT) % 5 AS VARCHAR)) AS category,
       CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(l_quantity) AS DOUBLE) AS sales_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS price,
       CAST(SUM(p_size) AS DOUBLE) AS stock_on_hand,
       CASE WHEN SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) > 5 * COUNT(*) THEN 1 ELSE 0 END AS promotion,
       CASE WHEN MONTH(CAST(l_shipdate AS DATE)) IN (11, 12) THEN 1 ELSE 0 END AS holiday_flag,
       MAX(l_returnflag) AS weather,
       MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS availability
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand, CAST(l_shipdate AS DATE)
"""
