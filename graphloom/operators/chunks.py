"""Token spans, sentences and chunks of documents.

Spans and sentence-aware chunks carry state from token to token, so they run as
Arrow-batched functions, one document at a time; the paragraph chunker is a
fold of built-in functions.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ABBREVIATIONS, strip
from ..session import materialise

#: By kind. Only a whole run of letters and digits can begin an acronym, so that no run is read again for each of its tokens.
_token = re.compile(r"(?:(?<![A-Za-z0-9])([A-Za-z0-9]++(?:/[A-Za-z0-9]++)+))|([A-Za-z]+)|([0-9]+)|([^A-Za-z0-9\s]+)")
_KINDS = (None, "ACRONYM", "WORD", "NUMBER", "PUNCTUATION")
SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("idx", T.IntegerType()), ("type", T.StringType()), ("token", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("nl", T.BooleanType()))]))
MAX_CHARS = 1_000
PARAGRAPH_CHARS = 5_000
OVERLAP = 500


def spans(text: str | None) -> list[tuple[int, str, str, int, int, bool]]:
    out, before = [], 0
    text = text or ""
    for k, m in enumerate(_token.finditer(text)):
        a, b = m.span()
        gap = a - before
        nl = gap > 0 < k and (text[before] in "\n\r" if gap == 1 else "\n" in (g := text[before:a]) or "\r" in g)
        out.append((k, _KINDS[m.lastindex], m[0], a, b, nl))
        before = b
    return out


def places(text: str | None) -> list[tuple[int, int]]:
    """Where tokens begin and end."""
    return [m.span() for m in _token.finditer(text or "")]


def words(text: str | None) -> list[str]:
    """The tokens alone."""
    return [m[0] for m in _token.finditer(text or "")]


@F.pandas_udf(SPANS)
def token_spans(text: pd.Series) -> pd.Series:
    """Tokens with code-point spans; nl tells of a line break before a token."""
    keys = ("idx", "type", "token", "start", "end", "nl")
    return pd.Series([[dict(zip(keys, t)) for t in spans(x)] for x in text])


def interval(start: int, end: int) -> tuple[int, int]:
    """A range of tokens."""
    if start < 0 or start >= end:
        raise ValueError(f"not a range of tokens: {start} to {end}")
    return start, end


def char_interval(toks, start: int, end: int) -> tuple[int, int]:
    """Characters of a range of tokens."""
    start, end = interval(start, end)
    if end > len(toks):
        raise ValueError(f"there are {len(toks)} tokens, not {end}")
    return toks[start][3], toks[end - 1][4]


def tokens_text(text: str, toks, start: int, end: int) -> str:
    """The text of a range of tokens, with what stands between them."""
    a, b = char_interval(toks, start, end)
    return text[a:b]


def sentence_range(text: str, toks, start: int) -> tuple[int, int]:
    """The rest of the sentence that holds token ``start``."""
    if not 0 <= start < len(toks):
        raise IndexError(f"there is no token {start}")
    return start, next(e for e in sentence_ends(text, toks) if e > start)


def sentence_ends(text: str, toks) -> list[int]:
    """Index after the last token of each sentence."""
    out = []
    for k, (_, kind, t, _, end, _) in enumerate(toks):
        stop = kind == "PUNCTUATION" and t[-1] in ".?!" and (toks[k - 1][2] if k else "") + t not in ABBREVIATIONS
        if not stop and k + 1 < len(toks) and toks[k + 1][5]:
            stop = "\n" in text[end : toks[k + 1][3]] and toks[k + 1][2][0].isupper()
        if stop:
            out.append(k + 1)
    if toks and (not out or out[-1] < len(toks)):
        out.append(len(toks))
    return out


def sentence_chunks_of(text: str | None, most: int, toks: list | None = None) -> list[tuple[int, int]]:
    """Token ranges of chunks of at most ``most`` characters: whole sentences while they fit; a sentence that does not is cut at its last line start, else at a token; what is left of it stands alone. ``toks``: the text's spans, if they are known."""
    toks = spans(text) if toks is None else toks
    ends = sentence_ends(text or "", toks)
    width = lambda a, b: toks[b - 1][4] - toks[a][3]
    out, at, cut, s = [], 0, False, 0
    while at < len(toks):
        while ends[s] <= at:
            s += 1
        stop = ends[s]
        if width(at, at + 1) > most:
            out.append((at, at + 1))
            cut, at = at + 1 < stop, at + 1
            continue
        if width(at, stop) > most:
            line, here = 0, at + 1
            for k in range(at, stop):
                if toks[k][5]:
                    line = k
                if width(at, k + 1) > most:
                    here = line if line > at else here
                    break
                here = k + 1
            out.append((at, here))
            at, cut = here, True
            continue
        here = stop
        if not cut:
            j = s + 1
            while j < len(ends) and width(at, ends[j]) <= most:
                here, j = ends[j], j + 1
        cut = False
        out.append((at, here))
        at = here
    return out


_CHUNKS = "array<struct<chunk_id:int,tok_start:int,tok_end:int,char_start:int,char_end:int,text:string>>"
_CHUNKS_OUT = pa.list_(pa.struct([*((c, pa.int32()) for c in ("chunk_id", "tok_start", "tok_end", "char_start", "char_end")), ("text", pa.string())]))


def sentence_chunks(docs: DataFrame, text_col: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """A row a chunk: every column of the document but its text, then chunk_id, token and character ranges, text."""

    @F.arrow_udf(_CHUNKS)
    def cut(text: pa.Array) -> pa.Array:
        out = []
        for x in text.to_pylist():
            toks = spans(x)
            rows = []
            for k, (a, b) in enumerate(sentence_chunks_of(x, most, toks)):
                rows.append({"chunk_id": k, "tok_start": a, "tok_end": b, "char_start": toks[a][3], "char_end": toks[b - 1][4], "text": x[toks[a][3] : toks[b - 1][4]]})
            out.append(rows)
        return pa.array(out, _CHUNKS_OUT)

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(*rest, F.explode(cut(F.col(text_col))).alias("_c")).select(*rest, "_c.*")


def paragraph_chunks(text: Column, most: int = PARAGRAPH_CHARS, overlap: int = OVERLAP, sep: str = "\n\n") -> Column:
    """array<string>: paragraphs packed while their lengths (separators not counted) stay within ``most``; a new chunk begins with the last ``overlap`` characters of the one before."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc, p):
        cur = acc["cur"]
        full = (F.length(cur) + F.length(p) > most) & (cur != "")
        tail = F.concat(F.when(F.length(cur) > overlap, F.substring(cur, -overlap, overlap) if overlap else F.lit("")).otherwise(cur if overlap else F.lit("")), F.lit(sep))
        return F.struct(F.when(full, F.array_append(acc["done"], strip(cur))).otherwise(acc["done"]).alias("done"), F.concat(F.when(full, tail).otherwise(cur), p, F.lit(sep)).alias("cur"))

    def end(acc):
        last = strip(acc["cur"])
        return F.when(last != "", F.array_append(acc["done"], last)).otherwise(acc["done"])

    quoted = re.escape(sep)
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), quoted, -1), zero, add, end)


def batches(chunks: DataFrame, size: int, *order: str) -> DataFrame:
    """Chunks with ``batch``, their place in the whole order cut into runs of ``size``.

    Places come from counts of range partitions, so no task sees all rows.
    """
    return with_places(chunks, list(order), "_place").withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def with_places(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with their place (from 0) in a total order.

    Rows are ranged and sorted once and written with the number of their range
    and their place in it; the sizes of the ranges, a row each, make places of
    the whole. No task sees all rows, and both readings see the same ranges.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    stored = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("_at", 33)
    n = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("_part", before.alias("_before"))
    placed = stored.withColumn("_part", part).join(F.broadcast(n), "_part")  # a row a range
    return placed.withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_part", "_before", "_at")


def duplicate_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that more than one document has."""
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")
