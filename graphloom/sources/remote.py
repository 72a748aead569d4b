"""Plugs for services: conversion of files by polling, web search, stored prompts, object stores, and registries of stores and extractors.

Nothing here opens a connection by itself. A service is an object or function
that the caller brings; it runs on the executors where rows are many, and its
failures are rows.
"""

from __future__ import annotations

import io
import mimetypes
import re
import time
import zipfile
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Polls of a conversion, and seconds between them; fixed values.
POLLS, POLL_WAIT = 180, 10
CONVERTED = "path string, success boolean, extracted_text string, images array<struct<name:string,content:binary>>, error_message string"


class Converter(Protocol):
    """A service that turns files into archives of Markdown and images."""

    def submit(self, name: str, content: bytes) -> str:
        """The id of the new batch."""

    def status(self, batch: str) -> dict:
        """{file_name, state, full_zip_url, err_msg} of every file, under data.extract_result; other shapes mean: ask again."""

    def download(self, url: str) -> bytes: ...


def batch_states(client: Converter, batches: Iterable[str]) -> list[tuple[str, str, str]]:
    """(batch, file, state) of submitted batches."""
    out = []
    for b in batches:
        for r in (client.status(b).get("data") or {}).get("extract_result") or []:
            out.append((b, r.get("file_name"), r.get("state")))
    return out


def unpacked(raw: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """The first Markdown file at the top of a zip archive, and its images."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        texts = sorted(n for n in names if n.endswith(".md") and "/" not in n)
        images = [(n, z.read(n)) for n in names if re.search(r"\.(png|jpe?g|gif|bmp|webp)$", n.lower())]
        return (z.read(texts[0]).decode("utf-8") if texts else ""), images


def convert(client: Converter, name: str, content: bytes, *, polls: int = POLLS, wait: float = POLL_WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[str, list[tuple[str, bytes]]]:
    """Text and images of one file: submit, ask until it is done, fetch, unpack."""
    batch = client.submit(name, content)
    for _ in range(polls):
        for r in (client.status(batch).get("data") or {}).get("extract_result") or []:
            if r.get("file_name") != name:
                continue
            if r.get("state") == "done":
                if not r.get("full_zip_url"):
                    raise ValueError("the conversion is done but names no archive")
                return unpacked(client.download(r["full_zip_url"]))
            if r.get("state") == "failed":
                raise ValueError(r.get("err_msg") or "the conversion failed")
        sleep(wait)
    raise TimeoutError(f"the conversion is not done after {polls} polls")


def converted(found: DataFrame, client: Converter, **options) -> DataFrame:
    """A result row a file (path, content): Markdown, images, or why there are none."""

    def run(frames):
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                try:
                    text, images = convert(client, path.rpartition("/")[2], bytes(raw), **options)
                    rows.append((path, True, text, [{"name": n, "content": b} for n, b in images], None))
                except Exception as e:
                    rows.append((path, False, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "success", "extracted_text", "images", "error_message"])

    return found.select("path", "content").mapInPandas(run, CONVERTED)


def images_of(results: DataFrame) -> DataFrame:
    """path, idx, name, content: a row an image of a converted file."""
    return results.select("path", F.posexplode("images").alias("idx", "i")).select("path", "idx", "i.name", "i.content")


def document_flags(found: DataFrame) -> DataFrame:
    """path, file_name, size, has_text, has_images, is_encrypted of PDF files, from their bytes."""
    text = F.decode("content", "iso-8859-1")
    has = lambda word: F.contains(text, F.lit(word))
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.length("content").cast("long").alias("size"), has("/Font").alias("has_text"), (has("/Subtype/Image") | has("/Subtype /Image")).alias("has_images"), has("/Encrypt").alias("is_encrypted"))


def searched(queries: DataFrame, search: Callable[[str, int], list[dict]], col: str = "query", most: int = 5) -> DataFrame:
    """query, rank, title, url, content, error: the first ``most`` finds of each query; a search that fails is a row with its error."""

    def run(frames):
        for f in frames:
            rows = []
            for q in f[col]:
                try:
                    rows += [(q, k, r.get("title"), r.get("url"), r.get("content"), None) for k, r in enumerate(search(q, most)[:most], 1)]
                except Exception as e:
                    rows.append((q, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["query", "rank", "title", "url", "content", "error"]).astype({"rank": "Int32"})

    return queries.select(col).mapInPandas(run, "query string, rank int, title string, url string, content string, error string")


class Prompts:
    """Stored prompt texts by name and label; {{variables}} are filled in. What the registry lacks, or fails to give, comes from ``local``."""

    def __init__(self, fetch: Callable[[str, str], str] | None = None, local: dict[str, str] | None = None):
        self.fetch, self.local = fetch, local or {}

    def text(self, name: str, label: str = "production", **values) -> str:
        found = None
        if self.fetch:
            try:
                found = self.fetch(name, label)
            except Exception:
                found = None
        found = found or self.local.get(name)
        if found is None:
            raise KeyError(f"there is no prompt {name}")
        return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m.group(1), m.group())), found)


# objects


def uploads(spark: SparkSession, items: Iterable[tuple[str, bytes, str | None]]) -> DataFrame:
    """filename, content, content_type of uploaded parts; a missing type is guessed by the name."""
    rows = [(n, bytes(b), t or content_type(n)) for n, b, t in items]
    return spark.createDataFrame(rows, "filename string, content binary, content_type string")


def content_type(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "application/octet-stream"


class Objects:
    """Buckets under a root that Spark's file systems reach (a folder, or any store with a driver)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, bucket: str, key: str = ""):
        if not bucket or ".." in (bucket + "/" + key).split("/"):
            raise ValueError("a bucket and a key inside of it are needed")
        return self._path(f"{self.root}/{bucket}/{key}" if key else f"{self.root}/{bucket}")

    def url(self, bucket: str, key: str) -> str:
        """Where an object can be read; stores without signatures give its plain address."""
        return f"{self.root}/{bucket}/{key}"

    def put(self, bucket: str, key: str, content: bytes) -> dict:
        """Store an object; its bucket is made if need be, and an older object goes."""
        self._fs.mkdirs(self._at(bucket))
        out = self._fs.create(self._at(bucket, key), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return {"bucket": bucket, "key": key, "size": len(content), "content_type": content_type(key)}

    def exists(self, bucket: str, key: str) -> bool:
        return self._fs.exists(self._at(bucket, key))

    def stat(self, bucket: str, key: str) -> dict:
        s = self._fs.getFileStatus(self._at(bucket, key))
        return {"size": s.getLen(), "modified": s.getModificationTime(), "content_type": content_type(key)}

    def get(self, bucket: str, key: str) -> bytes:
        r = self.spark.read.format("binaryFile").load(self.url(bucket, key)).select("content").first()
        return bytes(r.content)

    def delete(self, bucket: str, key: str) -> bool:
        return self._fs.delete(self._at(bucket, key), False)

    def listed(self, bucket: str, prefix: str = "") -> DataFrame:
        """key, size, modified of the objects of a bucket whose key begins with ``prefix``."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{bucket}")
        key = F.substring_index("path", f"/{bucket}/", -1)
        return rows.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(F.startswith("key", F.lit(prefix)))


def stored(files: DataFrame, put: Callable[[str, bytes], None]) -> DataFrame:
    """path, success, error of many objects (path, content) that executors store by ``put``, which must be idempotent."""

    def run(frames):
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"]):
                try:
                    put(path, bytes(raw))
                    rows.append((path, True, None))
                except Exception as e:
                    rows.append((path, False, str(e)))
            yield pd.DataFrame(rows, columns=["path", "success", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, success boolean, error string")


# registries and settings


class Registry:
    """Implementations of a kind by name."""

    def __init__(self, base: type):
        self.base, self.known = base, {}

    def register(self, name: str, kind: type) -> None:
        if not (isinstance(kind, type) and issubclass(kind, self.base)):
            raise TypeError(f"{kind} is no {self.base.__name__}")
        self.known[name.lower()] = kind

    def make(self, name: str, *args, **options):
        if name.lower() not in self.known:
            raise ValueError(f"unknown: {name}; known: {', '.join(self.names())}")
        return self.known[name.lower()](*args, **{k: v for k, v in options.items() if v is not None})

    def names(self) -> list[str]:
        return sorted(self.known)


def origins(value) -> list[str]:
    """A list setting: a list, a JSON array, or parts between commas, with or without brackets."""
    import json

    if isinstance(value, list):
        return value
    if not isinstance(value, str):
        return []
    try:
        return json.loads(value)
    except ValueError:
        bare = value.startswith("[") and value.endswith("]")
        inner = value.strip("[]").strip() if bare else value
        return [x.strip().strip("\"'") if bare else x.strip() for x in inner.split(",")] if inner or not bare else []


def database_url(user: str, password: str, host: str, port: str | int, name: str, driver: str = "mysql") -> str:
    from urllib.parse import quote

    return f"jdbc:{driver}://{host}:{port}/{name}?user={quote(user, safe='')}&password={quote(password, safe='')}"


def similar_vectors(rows: DataFrame, vector: list[float], k: int, id_col: str, vec_col: str) -> DataFrame:
    """id, score of the ``k`` rows whose vectors have the largest cosine with one vector; ties to the smaller id."""
    x = F.array(*map(F.lit, map(float, vector)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, u: acc + u)
    y = F.col(vec_col).cast("array<double>")
    scored = rows.filter(F.size(vec_col) == len(vector)).select(id_col, (dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).alias("score"))
    return scored.filter(~F.isnan("score")).orderBy(F.desc("score"), id_col).limit(k)


def segments(documents: DataFrame, id_col: str = "document_id", col: str = "segments") -> DataFrame:
    """id, segment, content of parsed documents' segments; blank ones do not count."""
    each = documents.select(id_col, F.posexplode(col).alias("segment", "s")).select(id_col, "segment", F.col("s.content").alias("content"))
    return each.filter(F.col("content").isNotNull() & F.col("content").rlike(r"(?U)\S"))


def processed_to(results: DataFrame, path: str) -> DataFrame:
    """Texts of processed files written under ``path``, a folder a file type; returns a row a file with ``output`` (null if it failed)."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    good = results.filter("success").select(F.regexp_replace("file_type", r"^\.", "").alias("kind"), F.to_json(F.struct("path", F.col("extracted_text").alias("text"))).alias("value"))
    good.write.partitionBy("kind").mode("errorifexists").text(path)
    return results.select("path", "file_type", "success", F.when(F.col("success"), F.concat(F.lit(path.rstrip("/") + "/kind="), F.regexp_replace("file_type", r"^\.", ""))).alias("output"), name.alias("name"), "error_message")
