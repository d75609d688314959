"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20  # bytes of a text that are split into words at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def text_bytes(c: str = "text") -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def text_key(c: str = "text") -> Column:
    """128-bit key of a text: rows with equal texts share every result that depends on the text alone."""
    return F.md5(text_bytes(c))


def blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, a block of about BLOCK bytes at a time."""
    pos, size = 0, len(data)
    while pos < size:
        end = pos + BLOCK
        if end < size:
            found = SPACE.search(data, end)
            end = found.start() if found else size
        yield data[pos:end].lower().split()
        pos = end


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character kept; plain ASCII takes the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and pass it to `body`; lambdas would evaluate it per element."""
    return F.transform(F.array(value), body)[0]
