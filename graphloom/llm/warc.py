"""WARC archives: writing, reading and revisit resolution (operator 4).

Archives are written by Spark's text sink: a row is one record, the record end
(two line breaks) is the line separator, and every file is one gzip stream of
whole WARC/1.1 records. Spark's commit protocol makes files appear whole even
if executors are lost. Readers follow Content-Length, so a payload may hold
anything, record boundaries included.

Deduplication shuffles headers only: of the records with equal payload digests
and at least ``LEAST`` bytes, that with the smallest id is a response, others
become revisit records that name it and carry no payload. Payloads are read
where they lie and written at once: the files of the input are taken in batches
whose revisits number no more than ``FLAGS`` (and those of one file), and the
list of a batch's revisits is broadcast to it. Resolving joins revisits to the
responses that they name and takes the payload's size there.

A null payload is empty. Rows that repeat both id and payload are the same
record and are all written alike. A null id is the largest id; if all ids of a
group are null, its records are all responses. Payloads under ``LEAST`` bytes
are always responses.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, new_path, small_batches, table

LEAST = 100
#: Payload bytes of an archive file, about.
FILE_BYTES = 32 << 20
#: Payload bytes of an archive file at most, unless one payload has more; readers load a file whole.
MOST_BYTES = 1 << 30
#: Revisits that are broadcast at once, about 64 bytes each.
FLAGS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_LAST = (1 << 63) - 1


def headers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", more: tuple[Column, ...] = ()) -> DataFrame:
    """(id, bytes, digest, ...) of every payload."""
    raw = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("id"), F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw, 256).alias("digest"), *more)


def in_files(pages: DataFrame) -> DataFrame:
    """``pages`` if its rows know the file that they come from; a plan that is no plain scan is written first."""
    try:
        pages.select("_metadata.file_path")
        return pages
    except AnalysisException:
        return materialise(pages, "warc-pages")


def batches(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files (path, revisits) in runs of at most ``most`` revisits, or one file."""
    out, room = [], 0
    for path, n in sorted(files):
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(path)
        room -= n
    return out


def originals(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, original) of the payloads that more than one record has; original is the smallest id."""
    many = heads.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n"))
    return many.filter((F.col("n") > 1) & F.col("original").isNotNull()).select("digest", "original")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def _name(id_: Column) -> Column:
    """Record id of a page: a UUID made of a hash of its id, so that a revisit can name a record that another task writes."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES, flags: int = FLAGS, date: str = DATE) -> DataFrame:
    """Write deduplicated archives of ``pages``; returns the headers (id, bytes, digest)."""
    pages, file = in_files(pages), F.col("_metadata.file_path")
    heads = materialise(headers(pages, id_col, payload_col, (file.alias("file"),)), "warc-headers")
    size = heads.agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("most")).first()
    per_file = max(1, min(file_bytes // max(1, (size.b or 0) // max(1, size.n)), MOST_BYTES // max(1, size.most or 0)))
    again = heads.filter(F.col("bytes") >= least).join(originals(heads, least), "digest").filter(~F.col("id").eqNullSafe(F.col("original")))
    again = materialise(again.select("file", "id", "digest", "original"), "warc-revisits")
    files = heads.select("file").distinct().join(again.groupBy("file").agg(F.count("*").alias("n")), "file", "left")
    runs = batches([(r.file, r.n or 0) for r in files.collect()], flags)  # a row an input file
    for k, run in enumerate(runs or [[]]):
        mine = lambda c: c.isin(run) if len(runs) > 1 else F.lit(True)  # noqa: E731,B023
        told = F.broadcast(again.filter(mine(F.col("file"))).groupBy("id", "digest").agg(F.min("original").alias("original")))  # `flags` rows at most, or one file's
        _write(pages.filter(mine(file)), told, f"{path}/run-{k:06d}", id_col, url_col, payload_col, per_file, date)
    return heads.drop("file")


def _write(pages: DataFrame, told: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, per_file: int, date: str) -> None:
    """One run of archives; ``told`` (id, digest, original) names its revisits."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col(url_col) if url_col in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(url.cast("string"), r"[\r\n]", "%0A"), F.lit("about:blank")).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    told = told.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "original")
    rows = rows.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _line("WARC-Refers-To", _name(F.col("original"))))).otherwise(F.lit("")),
        _line("Content-Type", "text/html"),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Stream(io.RawIOBase):
    """Bytes of a gzip file, unpacked as they are read."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.z, self.rest = memoryview(raw), 0, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, b):
        while not self.rest and (self.at < len(self.raw) or self.z.unconsumed_tail):
            part = self.z.unconsumed_tail
            if not part:
                part = self.raw[self.at : self.at + 65_536]
                self.at += len(part)
            self.rest = self.z.decompress(part, 1 << 20)
            if self.z.eof:  # archives may hold one gzip member a record
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
        n = min(len(b), len(self.rest))
        b[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def records(raw: bytes):
    """(header fields by lower-case name, payload) of every record of an archive file, plain or gzip."""
    f = io.BufferedReader(_Stream(raw), 1 << 20) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        body = f.read(size)
        if len(body) != size:
            raise ValueError("the record is cut short")
        yield fields, body


_READ = "record_id string, record_type string, page_id string, url string, digest string, refers_to string, bytes long, digest_holds boolean"


def read(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """One row a record of the archives under ``path``; ``digest_holds`` tells whether a response's payload has its digest."""

    small_batches(spark)

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                rows = []
                for h, body in records(raw):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    kind = h["warc-type"]
                    row = (h["warc-record-id"], kind, h.get("warc-page-id") or None, h.get("warc-target-uri"), digest, h.get("warc-refers-to"), len(body), kind == "revisit" or hashlib.sha256(body).hexdigest() == digest)
                    rows.append((*row, body) if payload else row)
                    if len(rows) == 5_000 or payload and len(rows) == 200:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    schema = _READ + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, schema)


def resolve(heads: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and ``original``: for a revisit, of the response that it names (null if that is missing); else its own."""
    responses = heads.filter("record_type = 'response'").groupBy("record_id", "digest").agg(F.min("bytes").alias("_bytes"), F.min(F.col("page_id").cast("long")).alias("_page"))
    named = responses.select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), "_bytes", "_page")
    revisit = F.col("record_type") == "revisit"
    joined = heads.filter(revisit).join(named, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    found = joined.select(*heads.columns, F.col("_bytes").alias("payload_bytes"), F.col("_page").alias("original"))
    own = heads.filter(~revisit).select(*heads.columns, F.col("bytes").alias("payload_bytes"), F.lit(None).cast("long").alias("original"))
    return own.unionByName(found)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    rows = resolve(materialise(read(spark, path), "warc-read"))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("original").alias("refers_to"), "digest_holds")


OP4_SQL = """
WITH h AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
  true AS digest_holds
FROM f
"""
