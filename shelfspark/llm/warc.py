"""WARC archives: writing pages, and a sequential reader.

Every record is a gzip member of its own. The reader decompresses incrementally, a chunk of the
archive at a time, frames each record by its Content-Length and verifies block and payload
digests; it holds one record, never an archive. Archives are written and read by tasks through
the file system of the shared folder; the manifest, a table, names those of tasks that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.text import table, text_bytes
from shelfspark.session import new_path, ship, written

LEAST_REVISIT = 0  # payload bytes from which an equal payload is a revisit
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class Broken(ValueError):
    """An archive that breaks the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One gzip member. A revisit holds the HTTP head alone, whose Content-Length is that of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = head + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + END + block + END) + packer.flush()


class Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, stream, raw: bytes):
        self.stream, self.raw, self.out, self.unpack = stream, raw, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.unpack.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise Broken("archive ends inside a record")
        try:
            self.out += self.unpack.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise Broken(f"record is not a gzip member: {e}") from e
        self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark))
            if not self.more():
                raise Broken("record without an end of its header")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise Broken("record is shorter than its Content-Length")
        found = bytes(self.out[:n])
        del self.out[:n]
        return found

    def rest(self) -> bytes:
        while self.more():
            if len(self.out) > CHUNK:
                raise Broken("record is longer than its Content-Length")
        return bytes(self.out)


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(stream) -> Iterator[dict]:
    """Records of an archive in order: headers as `fields`, the payload, its full length, and whether the digests agree."""
    raw = stream.read(CHUNK)
    while raw:
        member = Member(stream, raw)
        head = member.until(END)
        if not head.startswith(b"WARC/"):
            raise Broken("record without a version line")
        f = fields(head)
        if not f.get("content-length", "").isdigit():
            raise Broken("record without a Content-Length")
        block = member.take(int(f["content-length"]))
        if member.rest() != END:
            raise Broken("record does not end after its Content-Length")
        http, _, payload = block.partition(END)
        size = int(fields(http).get("content-length", len(payload)))
        ok = f.get("warc-block-digest") == f"sha1:{digest(block)}"
        if f.get("warc-type") == "response":
            ok = ok and size == len(payload) and f.get("warc-payload-digest") == f"sha1:{digest(payload)}"
        yield {"fields": f, "payload": payload, "size": size, "verified": ok}
        raw = member.raw or stream.read(CHUNK)


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write (page_id, url, html) as archives; the manifest (path, records), written.

    A null html is the empty payload. Of pages with equal payloads of at least `least` bytes, those with the
    smallest page_id are responses and the others revisit it; a null id counts as the largest,
    and pages that all have null ids are responses. Repeated rows each give a record.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(groups.where("n > 1 AND first IS NOT NULL").select("sha", "first"), "payloads")
    rows = rows.join(shared, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    folder = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []
        for pdf in batches:
            for page_id, url, payload, first in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["first"]):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                ids = [None if pd.isna(x) else int(x) for x in (page_id, first)]
                data = record(ids[0], url, payload, ids[1], "response" if ids[1] is None else "revisit")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((path, count))
        if out is not None:
            out.close()
            done.append((path, count))
        yield pd.DataFrame(done, columns=["path", "records"])

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("first").cast("string").alias("first"))
    manifest = written(rows.mapInPandas(write, "path string, records long"), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


COLUMNS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives of a manifest (path, folder), an archive per task at a time; a broken archive fails the job."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda s: (lambda m: int(m[1]) if m else None)(re.match(r"<urn:page:(-?\d+)>$", s or ""))
        for pdf in batches:
            for path, folder in zip(pdf["path"], pdf["folder"]):
                files, _ = fs.FileSystem.from_uri(folder)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in records(stream):
                        f = r["fields"]
                        rows.append((
                            number(f.get("warc-record-id")), f.get("warc-target-uri"), r["payload"] if payloads else None, r["size"],
                            f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("warc-type"), number(f.get("warc-refers-to")), r["verified"],
                        ))
                        held += len(r["payload"]) * payloads
                        if len(rows) >= 5000 or held >= 32 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = manifest.select("path", "folder").repartitionByRange(max(1, manifest.count()), "path")
    return spread.mapInPandas(read, COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, 5 * CAST(i // 4 AS INT) + 1, 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS verified
FROM g
"""
