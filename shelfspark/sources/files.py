"""CSV, JSON and Parquet in and out, and the mapping of messy uploads to the canonical table."""

from __future__ import annotations

import csv
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.expr import KEY
from shelfspark.operators.cleaning import coerce_date, coerce_numeric

# Canonical columns with their candidate names in order of preference.
CANDIDATES = {
    "date": ["date", "week_start", "ds", "timestamp", "time", "week"],
    "product": ["product", "product_name", "sku", "item", "item_name", "name"],
    "sales_qty": ["sales_qty", "quantity", "units", "order_quantity", "orders", "y", "sales", "qty"],
    "price": ["price", "unit_price", "selling_price", "mrp", "cost"],
    "stock_on_hand": ["stock_on_hand", "stock", "inventory", "on_hand"],
    "category": ["category", "department", "aisle", "dept"],
    "store": ["store", "store_id", "location", "region"],
}
REQUIRED = ["date", "product", "sales_qty"]
NUMBERS = ["sales_qty", "price", "stock_on_hand"]


def _reader(spark: SparkSession, lines: bool):
    """Quoted fields double their quotes; with `lines` they may also hold line breaks, and a file is one task."""
    return spark.read.option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", lines)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """UTF-8 CSV with a header; types come from `schema`, or from the whole file when it is unknown.

    `lines` reads quoted line breaks; files are then read whole, one task each.
    """
    reader = _reader(spark, lines).option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    # dates stay text: only the numeric and boolean types are inferred
    return reader.option("inferSchema", True).option("preferDate", False).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def deduped_names(names: list[str]) -> list[str]:
    """Repeated headers get _dup1, _dup2; then lower case, stripped, separators to _ and collisions _1."""
    out, seen = [], {}
    for n in names:
        k = seen.get(n, 0)
        out.append(n if k == 0 else f"{n}_dup{k}")
        seen[n] = k + 1
    clean, seen = [], {}
    for n in out:
        n = n.lower().strip().replace(" ", "_").replace("-", "_").replace("/", "_")
        k = seen.get(n, 0)
        clean.append(n if k == 0 else f"{n}_{k}")
        seen[n] = k + 1
    return clean


def guess_mapping(names: list[str]) -> dict[str, str]:
    """Canonical name to source name: an exact candidate first, then one contained in a header."""
    mapping: dict[str, str] = {}
    for canonical, options in CANDIDATES.items():
        free = [n for n in names if n not in mapping.values()]
        exact = next((o for o in options if o in free), None)
        part = next((n for o in options if len(o) > 2 for n in free if o in n), None)
        if exact or part:
            mapping[canonical] = exact or part
    return mapping


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their header line. Every task gives one line per file it starts; the driver gets the list of files."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = rows.where("file_block_start = 0").withColumn("i", F.monotonically_increasing_id())
    found = first.groupBy("file_path").agg(F.min_by("value", "i").alias("head")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: r["file_path"]):
        out.setdefault(r["head"].lstrip("\ufeff"), []).append(r["file_path"])
    return out


def _raw_upload(spark: SparkSession, files: list[str], head: str, lines: bool) -> DataFrame:
    """All columns of files with the same header as text under clean unique names."""
    names = deduped_names([h or f"column_{i}" for i, h in enumerate(next(csv.reader([head])))])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _reader(spark, lines).option("header", True).option("enforceSchema", True).schema(schema).csv(files)


def ingest_canonical(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """A messy CSV upload, a file or a folder of them, as the canonical typed table.

    Files with different headers are mapped each by its own. Raises when a required column has no
    source; `ingest_rejects` lists rows whose date or product could not be read. `lines` as in `scan_csv`.
    """
    found = headers(spark, path)
    if not found:
        raise ValueError(f"no header in {path}")
    parts = [_canonical(_raw_upload(spark, files, head, lines), mapping) for head, files in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _canonical(raw: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    mapping = mapping or guess_mapping(raw.columns)
    missing = [c for c in REQUIRED if mapping.get(c) not in raw.columns]
    if missing:
        raise ValueError(f"no column found for {missing}")
    present = {c: s for c, s in mapping.items() if s in raw.columns}
    named = raw.select(*[F.col(f"`{s}`").alias(c) for c, s in present.items()])
    named = coerce_date(named, "date")
    named = coerce_numeric(named, [c for c in NUMBERS if c in present])
    empty = {c: F.lit(None).cast("double" if c in NUMBERS else "string") for c in CANDIDATES if c not in present}
    return named.withColumns(empty).select(*CANDIDATES) if empty else named.select(*CANDIDATES)


def ingest_rejects(canonical: DataFrame) -> DataFrame:
    """Rows of the canonical table that lack a date or a product, with the reason."""
    reason = F.when(F.col("date").isNull(), "date").when(F.col("product").isNull(), "product")
    return canonical.withColumn("reason", reason).filter("reason IS NOT NULL")


def sink_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return scan_csv(df.sparkSession, path, df.schema)


def sink_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def sink_by_product(df: DataFrame, path: str) -> DataFrame:
    """One folder per product. Rows are gathered by product first so that each folder gets few files."""
    df.repartition(KEY).write.mode("overwrite").partitionBy(KEY).parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_files(spark: SparkSession, path: str, since: datetime.datetime) -> DataFrame:
    """Rows of the Parquet files under `path` written at or after `since`."""
    stamp = F.lit(since.timestamp()).cast("timestamp")
    df = spark.read.parquet(path)
    return df.withColumn("__t", F.col("_metadata.file_modification_time")).filter(F.col("__t") >= stamp).drop("__t")
